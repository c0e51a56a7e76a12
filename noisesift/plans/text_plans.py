"""Queries for text encoding (F1-F7) and final training rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import AUG_METHODS, with_views
from noisesift.functions import text as T
from noisesift.operators import joins, sampling, shape
from noisesift.plans.curation import CLEAN_SPLIT_SQL
from noisesift.plans.registry import register
from noisesift.plans.shaping import METHOD_LIST_SQL

TRAIN_TOKENS_SQL = r"""
tl AS (SELECT index, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS tl FROM corpus),
toks AS (SELECT index, unnest(tl) AS token, unnest(range(len(tl))) AS pos FROM tl),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INT) AS id
          FROM (SELECT token, count(*) AS n FROM toks GROUP BY token)
          QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 30000)"""


def _ids_sql(src: str, keep: int, name: str) -> str:
    return f"""{name} AS (SELECT t.index, list(coalesce(v.id, 3) ORDER BY t.pos) AS ids
        FROM {src} t LEFT JOIN vocab v USING (token) WHERE t.pos < {keep} GROUP BY t.index)"""


#: tokens of the vocabulary, about as many as the pretrained tokenizers of the tasks have
VOCAB = 30_000


def _train_vocab(spark: SparkSession, d: str):
    return T.build_vocab(fixtures.corpus(spark, d), "text", VOCAB)


def _join_ids(col: str):
    return F.array_join(F.col(col), " ")


@register("f1_encode_text", with_views("corpus") + "," + TRAIN_TOKENS_SQL + "," + _ids_sql("toks", 126, "enc") + """
SELECT tr.index, array_to_string(list_resize([0] || coalesce(e.ids, []) || [2], 128, 1), ' ') AS encode
FROM corpus tr LEFT JOIN enc e ON tr.index = e.index""")
def f1_encode_text(spark: SparkSession, d: str):
    tr = fixtures.corpus(spark, d)
    return T.encode_text(tr, _train_vocab(spark, d), "text", "index", 128).select("index", _join_ids("encode").alias("encode"))


PAIR_TOKENS_SQL = r"""
s AS (SELECT index, 1 AS side, list_filter(string_split_regex(sentence1, '\s+'), lambda x: x <> '') AS tl FROM pairs
      UNION ALL SELECT index, 2, list_filter(string_split_regex(sentence2, '\s+'), lambda x: x <> '') FROM pairs),
ptoks AS (SELECT index, side, unnest(tl) AS token, unnest(range(len(tl))) AS pos FROM s),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INT) AS id
          FROM (SELECT token, count(*) AS n FROM ptoks GROUP BY token)
          QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 30000),
pa AS (SELECT * FROM ptoks WHERE side = 1), pb AS (SELECT * FROM ptoks WHERE side = 2)"""


def _pair_vocab(spark: SparkSession, d: str):
    p = fixtures.pairs(spark, d)
    corpus = p.select(F.col("sentence1").alias("text")).unionByName(p.select(F.col("sentence2").alias("text")))
    return T.build_vocab(corpus, "text", VOCAB)


@register("f2_encode_pair", with_views("pairs") + "," + PAIR_TOKENS_SQL + "," + _ids_sql("pa", 125, "ea") + "," + _ids_sql("pb", 126, "eb") + """
SELECT p.index, array_to_string(list_resize([0] || coalesce(ea.ids, []) || [2, 2] || coalesce(eb.ids, []) || [2], 256, 1), ' ') AS encode
FROM pairs p LEFT JOIN ea ON p.index = ea.index LEFT JOIN eb ON p.index = eb.index""")
def f2_encode_pair(spark: SparkSession, d: str):
    p = fixtures.pairs(spark, d)
    return T.encode_pair(p, _pair_vocab(spark, d), "sentence1", "sentence2", "index", 256).select("index", _join_ids("encode").alias("encode"))


@register("f3_fit_length", with_views("corpus") + "," + TRAIN_TOKENS_SQL + "," + _ids_sql("toks", 128, "enc") + """
SELECT tr.index, array_to_string(list_resize(coalesce(e.ids, []), 128, 1), ' ') AS ids
FROM corpus tr LEFT JOIN enc e ON tr.index = e.index""")
def f3_fit_length(spark: SparkSession, d: str):
    tr = fixtures.corpus(spark, d)
    x = T.token_ids(tr, _train_vocab(spark, d), "text", "index", 128, "ids")
    return x.select("index", F.array_join(T.fit_length("ids", 128), " ").alias("ids"))


@register("f4_attention_mask", with_views("corpus") + "," + TRAIN_TOKENS_SQL + "," + _ids_sql("toks", 126, "enc") + """
SELECT tr.index, array_to_string(list_transform(list_resize([0] || coalesce(e.ids, []) || [2], 128, 1), lambda x: CASE WHEN x = 1 THEN 0 ELSE 1 END), ' ') AS mask
FROM corpus tr LEFT JOIN enc e ON tr.index = e.index""")
def f4_attention_mask(spark: SparkSession, d: str):
    tr = fixtures.corpus(spark, d)
    x = T.encode_text(tr, _train_vocab(spark, d), "text", "index", 128)
    return x.select("index", F.array_join(T.attention_mask("encode"), " ").alias("mask"))


@register("f5_splice_separator", with_views("pairs") + "," + PAIR_TOKENS_SQL + "," + _ids_sql("pa", 126, "ea") + "," + _ids_sql("pb", 126, "eb") + """
SELECT p.index, array_to_string([0] || coalesce(ea.ids, []) || [2] || [2, 2] || coalesce(eb.ids, []) || [2], ' ') AS spliced
FROM pairs p LEFT JOIN ea ON p.index = ea.index LEFT JOIN eb ON p.index = eb.index""")
def f5_splice_separator(spark: SparkSession, d: str):
    p = fixtures.pairs(spark, d)
    v = _pair_vocab(spark, d)
    x = T.multi_token_ids(p, v, {"a": ("sentence1", 126), "b": ("sentence2", 126)}, "index")
    joined = F.concat(F.array(F.lit(0)), F.col("a"), F.array(F.lit(2)), F.array(F.lit(0)), F.col("b"), F.array(F.lit(2)))
    return x.select("index", F.array_join(T.splice_separator(joined), " ").alias("spliced"))


@register("f6_collate_ragged", with_views("train", "aug") + "," + CLEAN_SPLIT_SQL + f"""
, cb AS (SELECT index, (row_number() OVER (ORDER BY md5(concat_ws('-', index, '42')), index) - 1) // 8 AS batch_id FROM clean),
a AS (SELECT origin, origin * 10 + list_position({METHOD_LIST_SQL}, aug_method) AS aug_id FROM aug
      WHERE aug_method IN ('CharswapAug', 'WordnetAug') AND readability > 20 AND readability < 200),
r AS (SELECT a.origin, a.aug_id, cb.batch_id, row_number() OVER (PARTITION BY a.origin ORDER BY a.aug_id) - 1 AS rk,
             count(*) OVER (PARTITION BY a.origin) AS n FROM a JOIN cb ON a.origin = cb.index),
m AS (SELECT batch_id, max(n) AS mx FROM r GROUP BY batch_id),
x AS (SELECT r.*, m.mx, unnest(range(0, CAST(ceil((m.mx - r.rk) / r.n) AS BIGINT))) AS k FROM r JOIN m USING (batch_id))
SELECT origin AS index, batch_id, CAST(rk + k * n AS BIGINT) AS slot, aug_id FROM x""")
def f6_collate_ragged(spark: SparkSession, d: str):
    train = shape.alias_target(fixtures.train(spark, d))
    clean, _ = sampling.stratified_split(train, 0.9)
    cb = sampling.shuffle_batches(clean, 8).select("index", "batch_id")
    a = shape.filter_interval(shape.filter_methods(fixtures.aug(spark, d), ["CharswapAug", "WordnetAug"]), 20, 200)
    a = a.select("origin", (F.col("origin") * 10 + F.array_position(F.array(*[F.lit(m) for m in AUG_METHODS]), F.col("aug_method"))).alias("aug_id"))
    return T.collate_ragged(a, cb, "origin", "aug_id").select("index", "batch_id", "slot", "aug_id")


@register("f7_check_uniform_length", with_views("corpus") + """
SELECT 'train' AS tbl, CAST(128 AS INT) AS min_len, CAST(128 AS INT) AS max_len, count(*) AS n FROM corpus
UNION ALL SELECT 'aug', 128, 128, count(*) FROM aug""".replace("FROM aug", "FROM (" + fixtures.VIEW_SQL["aug"] + ")"))
def f7_check_uniform_length(spark: SparkSession, d: str):
    v = T.vocab_tokenizer(_train_vocab(spark, d))
    tr = T.encode_text(fixtures.corpus(spark, d), v, "text", "index", 128)
    au = fixtures.aug(spark, d).withColumn("aug_id", F.col("origin") * 10 + F.array_position(F.array(*[F.lit(m) for m in AUG_METHODS]), F.col("aug_method")))
    au = T.encode_text(au, v, "text", "aug_id", 128)
    stats = T.length_stats({"train": tr, "aug": au})
    T.check_uniform_length(tr, au, stats=stats)
    return stats.select("tbl", "min_len", "max_len", "n")


@register("b7_training_rows", with_views("train", "corpus") + "," + CLEAN_SPLIT_SQL + "," + TRAIN_TOKENS_SQL + "," + _ids_sql("toks", 126, "enc") + """
SELECT array_to_string(list_resize([0] || coalesce(e.ids, []) || [2], 128, 1), ' ') AS encode, m.class
FROM meta m LEFT JOIN enc e ON m.index = e.index""")
def b7_training_rows(spark: SparkSession, d: str):
    train = shape.alias_target(fixtures.train(spark, d))
    _, meta = sampling.stratified_split(train, 0.9)
    enc = T.encode_text(meta, _train_vocab(spark, d), "text", "index", 128, carry=["class"])
    return shape.training_rows(enc, "eval").select(_join_ids("encode").alias("encode"), "class")



# The augmented rows of one method and interval whose origin is in the clean part, encoded like the rest.
AUG_ENC_SQL = _ids_sql("toks", 126, "enc") + r""",
au AS (SELECT a.origin AS index, c.class, a.text, a.readability, a.cola FROM aug a JOIN clean c ON a.origin = c.index
       WHERE a.aug_method = 'CharswapAug' AND a.readability > 20 AND a.readability < 200),
atl AS (SELECT index, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS tl FROM au),
atoks AS (SELECT index, unnest(tl) AS token, unnest(range(len(tl))) AS pos FROM atl),
""" + _ids_sql("atoks", 126, "aenc") + """,
ce AS (SELECT c.*, array_to_string(list_resize([0] || coalesce(e.ids, []) || [2], 128, 1), ' ') AS encode FROM clean c LEFT JOIN enc e USING (index)),
me AS (SELECT c.*, array_to_string(list_resize([0] || coalesce(e.ids, []) || [2], 128, 1), ' ') AS encode FROM meta c LEFT JOIN enc e USING (index)),
ae AS (SELECT c.*, array_to_string(list_resize([0] || coalesce(e.ids, []) || [2], 128, 1), ' ') AS encode FROM au c LEFT JOIN aenc e USING (index))"""
B7_VIEWS = with_views("train", "aug", "corpus") + "," + CLEAN_SPLIT_SQL + "," + TRAIN_TOKENS_SQL + "," + AUG_ENC_SQL


def _three_parts(spark: SparkSession, d: str):
    """Clean, meta and augmented rows, encoded."""
    train = shape.alias_target(fixtures.train(spark, d))
    clean, meta = sampling.stratified_split(train, 0.9)
    a = shape.filter_interval(shape.filter_methods(fixtures.aug(spark, d), ["CharswapAug"]), 20, 200)
    a = a.withColumnRenamed("origin", "index").join(clean.select("index", "class"), "index")
    vocab = T.vocab_tokenizer(_train_vocab(spark, d))
    return [T.encode_text(df, vocab, "text", "index", 128, carry=["class", "readability", "cola"]) for df in (clean, meta, a)]


@register("b7_training_rows_aligned", B7_VIEWS + """
SELECT c.encode AS encode_raw, c.class AS class_raw, a.encode AS encode_aug, a.class AS class_aug FROM ce c JOIN ae a USING (index)""")
def b7_training_rows_aligned(spark: SparkSession, d: str):
    clean, _, a = _three_parts(spark, d)
    both = joins.flatten_sides(joins.align(clean, a.withColumnRenamed("index", "origin")))
    out = shape.training_rows(both, "aligned")
    return out.withColumns({c: _join_ids(c) for c in ("encode_raw", "encode_aug")})


@register("b7_training_rows_zipped", B7_VIEWS + """,
cp AS (SELECT *, row_number() OVER (ORDER BY index) - 1 AS p FROM ce), mp AS (SELECT *, row_number() OVER (ORDER BY index) - 1 AS p FROM me),
ap AS (SELECT *, row_number() OVER (ORDER BY index) - 1 AS p FROM ae),
n AS (SELECT (SELECT count(*) FROM cp) AS nc, (SELECT count(*) FROM mp) AS nm, (SELECT count(*) FROM ap) AS na),
pos AS (SELECT unnest(range(0, (SELECT greatest(nc, nm, na) FROM n))) AS i)
SELECT cp.encode AS encode_clean, cp.class AS class_clean, cp.readability AS readability_clean, cp.cola AS cola_clean, mp.encode AS encode_meta, mp.class AS class_meta,
       ap.encode AS encode_aug, ap.class AS class_aug, ap.readability AS readability_aug, ap.cola AS cola_aug
FROM pos, n, cp, mp, ap WHERE cp.p = i % nc AND mp.p = i % nm AND ap.p = i % na""")
def b7_training_rows_zipped(spark: SparkSession, d: str):
    parts = _three_parts(spark, d)
    target = sampling.align_target(*(p.count() for p in parts))
    same = {n: sampling.length_align(p, target, order_col="index") for n, p in zip(("clean", "meta", "aug"), parts, strict=True)}
    out = shape.training_rows(joins.zip_positional(same), "zipped")
    return out.withColumns({f"encode_{n}": _join_ids(f"encode_{n}") for n in same})
