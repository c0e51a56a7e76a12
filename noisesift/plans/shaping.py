"""Queries for shaping (B), filters (C), joins (D) and set operations (I)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import AUG_METHODS, with_views
from noisesift.operators import joins, sampling, shape
from noisesift.plans.curation import CLEAN_SPLIT_SQL, curated_pairs
from noisesift.plans.registry import register
from noisesift.session import table

METHOD_LIST_SQL = "['" + "','".join(AUG_METHODS) + "']"


def _method_of(doc_id):
    return F.element_at(F.array(*[F.lit(m) for m in AUG_METHODS]), (F.pmod(doc_id, F.lit(5)) + 1).cast("int"))


# ------------------------------------------------------------------ B
@register("b1_pad_scores", with_views("aug") + """
SELECT origin, aug_method, CAST(10.0 AS DOUBLE) AS readability, readability AS readability1,
       cola AS readability2, CAST(0.5 AS DOUBLE) AS cola FROM aug""")
def b1_pad_scores(spark: SparkSession, d: str):
    a = fixtures.aug(spark, d).withColumnsRenamed({"readability": "ReadScore", "cola": "ColaScore"})
    _t, a2, pair_mode = shape.pad_scores(fixtures.train(spark, d).drop("readability", "cola"), a)
    assert pair_mode
    return a2.select("origin", "aug_method", "readability", "readability1", "readability2", "cola")


@register("b2_score_columns", with_views("aug") + """
SELECT origin, aug_method, readability FROM aug""")
def b2_score_columns(spark: SparkSession, d: str):
    a = fixtures.aug(spark, d)
    return a.select("origin", "aug_method", *shape.score_columns(a, "any"))


@register("b3_alias_target", with_views("train") + "SELECT index, label, label AS class FROM train")
def b3_alias_target(spark: SparkSession, d: str):
    return shape.alias_target(fixtures.train(spark, d)).select("index", "label", "class")


@register("b4_strip_suffix", with_views("train", "aug") + "," + CLEAN_SPLIT_SQL + """
SELECT a.origin, a.aug_method, a.readability, a.text FROM clean c JOIN aug a ON c.index = a.origin
WHERE a.aug_method IN ('CharswapAug', 'WordnetAug') AND a.readability > 20 AND a.readability < 200""")
def b4_strip_suffix(spark: SparkSession, d: str):
    aligned = curated_pairs(spark, d)
    aug_side = aligned.select(*[c for c in aligned.columns if c.endswith("_aug")])
    return shape.strip_suffix(aug_side, "_aug").select("origin", "aug_method", "readability", "text")


@register("b5_assign_columns_by_arity", with_views("train", "pairs") + """
SELECT index, CAST(label AS BIGINT) AS label, text, readability, CAST(NULL AS VARCHAR) AS sentence1, CAST(NULL AS VARCHAR) AS sentence2 FROM train
UNION ALL
SELECT index, CAST(label AS BIGINT) AS label, NULL, NULL, sentence1, sentence2 FROM pairs""")
def b5_assign_columns_by_arity(spark: SparkSession, d: str):
    t = fixtures.train(spark, d).select("index", "label", "text", "readability").toDF("c0", "c1", "c2", "c3")
    p = fixtures.pairs(spark, d).select("index", "sentence1", "label", "sentence2").toDF("c0", "c1", "c2", "c3")
    a = shape.assign_columns_by_arity(t, "train")
    b = shape.assign_columns_by_arity(p, "dev")
    return shape.union_methods(a.withColumn("label", F.col("label").cast("bigint")), b.withColumn("label", F.col("label").cast("bigint")))


@register("b6_pair_text", with_views("pairs") + """
SELECT index, sentence1 || '</s></s>' || sentence2 AS text, sentence1 AS text1, ' </s> ' || sentence2 AS text2 FROM pairs""")
def b6_pair_text(spark: SparkSession, d: str):
    p = fixtures.pairs(spark, d)
    return shape.pair_text(shape.pair_text(p, "prep"), "eval").select("index", "text", "text1", "text2")


# ------------------------------------------------------------------ C
@register("c1_filter_methods", with_views("aug") + """
SELECT origin, aug_method, readability FROM aug WHERE aug_method IN ('CharswapAug', 'WordnetAug')""")
def c1_filter_methods(spark: SparkSession, d: str):
    return shape.filter_methods(fixtures.aug(spark, d), "CharswapAug,WordnetAug").select("origin", "aug_method", "readability")


@register("c2_filter_interval", with_views("aug") + """
SELECT origin, aug_method, readability FROM aug WHERE readability > 20 AND readability < 200""")
def c2_filter_interval(spark: SparkSession, d: str):
    return shape.filter_interval(fixtures.aug(spark, d), 20, 200).select("origin", "aug_method", "readability")


@register("c3_filter_interval_pair", with_views("aug") + """
SELECT origin, aug_method, readability1, readability2 FROM (
  SELECT origin, aug_method, readability AS readability1, CAST((readability + 100) % 250 AS DOUBLE) AS readability2 FROM aug)
WHERE readability1 > 20 AND readability1 < 200 AND readability2 > 20 AND readability2 < 200""")
def c3_filter_interval_pair(spark: SparkSession, d: str):
    a = fixtures.aug(spark, d).select(
        "origin", "aug_method", F.col("readability").alias("readability1"),
        ((F.col("readability") + 100) % 250).cast("double").alias("readability2"),
    )
    return shape.filter_interval_pair(a, 20, 200)


@register("c4_filter_all_scores", with_views("aug") + """
SELECT origin, aug_method, readability, cola FROM aug WHERE readability > 0.4 AND readability < 200""")
def c4_filter_all_scores(spark: SparkSession, d: str):
    a = fixtures.aug(spark, d).select("origin", "aug_method", "readability", "cola")
    return shape.filter_all_scores(a, 0.4, 200)


@register("c5_require_nonempty", with_views("aug") + """
SELECT origin, aug_method FROM aug WHERE readability > 240 AND readability < 250""")
def c5_require_nonempty(spark: SparkSession, d: str):
    return shape.require_nonempty(shape.filter_interval(fixtures.aug(spark, d), 240, 250)).select("origin", "aug_method")


@register("c6_filter_tags", with_views("run_log") + """
SELECT experiment, version, metric, event_id, value FROM run_log WHERE contains(metric, 'Test') AND contains(metric, 'acc')""")
def c6_filter_tags(spark: SparkSession, d: str):
    return shape.filter_tags(fixtures.run_log(spark, d), ("acc", "Test")).select("experiment", "version", "metric", "event_id", "value")


@register("c7_drop_null_rows", with_views("train", "aug") + """
SELECT a.origin, a.aug_method, t.label FROM aug a JOIN train t ON a.origin = t.index""")
def c7_drop_null_rows(spark: SparkSession, d: str):
    labelled = joins.attach_label(fixtures.aug(spark, d).select("origin", "aug_method"), fixtures.train(spark, d))
    return shape.drop_null_rows(labelled)


# ------------------------------------------------------------------ D
@register("d1_attach_label", with_views("train", "aug") + """
SELECT a.origin, a.aug_method, t.label FROM aug a LEFT JOIN train t ON a.origin = t.index""")
def d1_attach_label(spark: SparkSession, d: str):
    return joins.attach_label(fixtures.aug(spark, d).select("origin", "aug_method"), fixtures.train(spark, d))


D2_SIDES_SQL = """
side1 AS (SELECT aug_method, origin, CASE WHEN v = 0 THEN text ELSE replace(text, 'e', 'E') END AS sentence1
          FROM aug, (VALUES (0), (1)) AS s(v)),
side2 AS (SELECT aug_method, origin, concat(text, ' #', CAST(v AS VARCHAR)) AS sentence2 FROM aug, (VALUES (0), (1), (2)) AS s(v))"""


def _d2_sides(spark: SparkSession, d: str):
    a = fixtures.aug(spark, d)
    s1 = a.select("aug_method", "origin", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).select(
        "aug_method", "origin",
        F.when(F.col("v") == 0, F.col("text")).otherwise(F.replace(F.col("text"), F.lit("e"), F.lit("E"))).alias("sentence1"))
    s2 = a.select("aug_method", "origin", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v")).select(
        "aug_method", "origin", F.concat(F.col("text"), F.lit(" #"), F.col("v").cast("string")).alias("sentence2"))
    return s1, s2


@register("d2_pair_sides", with_views("aug") + "," + D2_SIDES_SQL + """
SELECT s1.aug_method, s1.origin, md5(sentence1) AS sentence1_md5, md5(sentence2) AS sentence2_md5
FROM side1 s1 JOIN side2 s2 ON s1.aug_method = s2.aug_method AND s1.origin = s2.origin""")
def d2_pair_sides(spark: SparkSession, d: str):
    s1, s2 = _d2_sides(spark, d)
    # each text is hashed whole where it is made, once, and not once a pair: the join moves digests
    s1 = s1.select("aug_method", "origin", F.md5("sentence1").alias("sentence1_md5"))
    s2 = s2.select("aug_method", "origin", F.md5("sentence2").alias("sentence2_md5"))
    return joins.pair_sides(s1, s2).select("aug_method", "origin", "sentence1_md5", "sentence2_md5")


@register("d3_align", with_views("train", "aug") + "," + CLEAN_SPLIT_SQL + """
SELECT c.index AS index_raw, c.class AS class_raw, c.readability AS readability_raw,
       a.origin AS origin_aug, a.aug_method AS aug_method_aug, a.readability AS readability_aug
FROM clean c JOIN aug a ON c.index = a.origin
WHERE a.aug_method IN ('CharswapAug', 'WordnetAug') AND a.readability > 20 AND a.readability < 200""")
def d3_align(spark: SparkSession, d: str):
    return curated_pairs(spark, d).select("index_raw", "class_raw", "readability_raw", "origin_aug", "aug_method_aug", "readability_aug")


@register("d4_keep_train_origins", with_views("train", "aug") + "," + CLEAN_SPLIT_SQL + """
SELECT origin, aug_method FROM aug WHERE origin IN (SELECT index FROM clean)""")
def d4_keep_train_origins(spark: SparkSession, d: str):
    train = shape.alias_target(fixtures.train(spark, d))
    clean, _ = sampling.stratified_split(train, 0.9)
    return joins.keep_train_origins(fixtures.aug(spark, d).select("origin", "aug_method"), clean)


def _run_configs(spark: SparkSession, d: str):
    docs = table(spark, d, "documents")
    cfg = F.create_map(
        F.lit("aug_method"), _method_of(F.col("doc_id")), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"),
        F.lit("gpus_per_trial"), F.lit("0.5"), F.lit("version_no"), F.col("doc_id").cast("string"),
    )
    return docs.select(F.col("doc_id").alias("version_no"), cfg.alias("config"))


@register("d5_skip_finished", f"""
WITH planned AS (SELECT doc_id AS version_no, {METHOD_LIST_SQL}[doc_id % 5 + 1] AS aug_method, lang, source FROM documents),
fin AS (SELECT aug_method, lang, source, count(*) AS done FROM planned p JOIN labels l ON p.version_no = l.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY aug_method, lang, source ORDER BY version_no) - 1 AS pos FROM planned)
SELECT version_no + (SELECT count(*) FROM labels) AS version_no, aug_method, lang, source
FROM r LEFT JOIN fin USING (aug_method, lang, source) WHERE pos >= coalesce(done, 0)""")
def d5_skip_finished(spark: SparkSession, d: str):
    planned = _run_configs(spark, d)
    finished = planned.join(table(spark, d, "labels").select(F.col("doc_id").alias("version_no")), "version_no", "left_semi")
    finished = finished.withColumn("config", F.map_concat("config", F.create_map(F.lit("path"), F.lit("runs/x"))))
    n_existing = table(spark, d, "labels").count()
    out = joins.skip_finished(planned, finished, ["aug_method", "lang", "source", "gpus_per_trial", "version_no"], n_existing)
    return out.select("version_no", F.col("config")["aug_method"].alias("aug_method"),
                      F.col("config")["lang"].alias("lang"), F.col("config")["source"].alias("source"))


# trials whose configs hold two, three or no compared keys; each finished config fits at most one of them
@register("d5_skip_finished_subsets", f"""
WITH planned AS (SELECT doc_id AS version_no, {METHOD_LIST_SQL}[doc_id % 5 + 1] AS aug_method, lang, source, doc_id % 3 AS kind FROM documents),
fin AS (SELECT p.* FROM planned p JOIN labels l ON p.version_no = l.doc_id WHERE l.quality = 1),
three AS (SELECT version_no, row_number() OVER (PARTITION BY aug_method, lang, source ORDER BY version_no) AS r, aug_method, lang, source FROM planned WHERE kind = 0),
had AS (SELECT aug_method, lang, source, count(*) AS n FROM fin GROUP BY ALL),
left3 AS (SELECT t.* FROM three t LEFT JOIN had USING (aug_method, lang, source) WHERE t.r > coalesce(n, 0)),
took AS (SELECT aug_method, lang, source, count(*) AS n FROM three GROUP BY ALL),
rest AS (SELECT lang, source, sum(greatest(had.n - coalesce(took.n, 0), 0)) AS n FROM had LEFT JOIN took USING (aug_method, lang, source) GROUP BY ALL),
two AS (SELECT version_no, row_number() OVER (PARTITION BY lang, source ORDER BY version_no) AS r, lang, source FROM planned WHERE kind = 1),
left2 AS (SELECT t.* FROM two t LEFT JOIN rest USING (lang, source) WHERE t.r > coalesce(n, 0)),
took2 AS (SELECT lang, source, count(*) AS n FROM two GROUP BY ALL),
rest1 AS (SELECT source, sum(greatest(rest.n - coalesce(took2.n, 0), 0)) AS n FROM rest LEFT JOIN took2 USING (lang, source) GROUP BY ALL),
one AS (SELECT version_no, row_number() OVER (PARTITION BY source ORDER BY version_no) AS r, source FROM planned WHERE kind = 2),
left1 AS (SELECT t.* FROM one t LEFT JOIN rest1 USING (source) WHERE t.r > coalesce(n, 0))
SELECT version_no, 3 AS n_keys FROM left3 UNION ALL SELECT version_no, 2 FROM left2 UNION ALL SELECT version_no, 1 FROM left1""")
def d5_skip_finished_subsets(spark: SparkSession, d: str):
    every = _run_configs(spark, d)
    kept = F.when(F.col("version_no") % 3 == 0, F.array(F.lit("aug_method"), F.lit("lang"), F.lit("source"))).when(F.col("version_no") % 3 == 1, F.array(F.lit("lang"), F.lit("source"))).otherwise(F.array(F.lit("source")))
    planned = every.withColumn("config", F.map_filter("config", lambda k, v: F.array_contains(kept, k) | k.isin("gpus_per_trial", "version_no")))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("version_no"))
    out = joins.skip_finished(planned, every.join(good, "version_no", "left_semi"))
    return out.select("version_no", (F.size("config") - 2).alias("n_keys"))


@register("d6_expand_grid", with_views("aug") + """
, m AS (SELECT DISTINCT aug_method FROM aug), l AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT source FROM documents)
SELECT CAST(row_number() OVER (ORDER BY aug_method, lang, source) - 1 AS BIGINT) AS version_no, aug_method, lang, source, '4' AS batch_size
FROM m, l, s""")
def d6_expand_grid(spark: SparkSession, d: str):
    docs = table(spark, d, "documents")
    lists = (
        fixtures.aug(spark, d).select(F.lit("aug_method").alias("param"), F.col("aug_method").alias("value"))
        .unionByName(docs.select(F.lit("lang").alias("param"), F.col("lang").alias("value")))
        .unionByName(docs.select(F.lit("source").alias("param"), F.col("source").alias("value")))
    )
    g = joins.expand_grid(spark, lists, ["aug_method", "lang", "source"], base={"batch_size": "4"})
    return g.select("version_no", "aug_method", "lang", "source", F.col("config")["batch_size"].alias("batch_size"))


@register("d7_zip_positional", with_views("train", "aug") + "," + CLEAN_SPLIT_SQL + f"""
, a AS (SELECT origin * 10 + list_position({METHOD_LIST_SQL}, aug_method) AS aug_id FROM aug
        WHERE aug_method IN ('CharswapAug', 'WordnetAug') AND readability > 20 AND readability < 200
          AND origin IN (SELECT index FROM clean)),
cp AS (SELECT index, row_number() OVER (ORDER BY index) - 1 AS p FROM clean),
mp AS (SELECT index, row_number() OVER (ORDER BY index) - 1 AS p FROM meta),
ap AS (SELECT aug_id, row_number() OVER (ORDER BY aug_id) - 1 AS p FROM a),
n AS (SELECT (SELECT count(*) FROM cp) AS nc, (SELECT count(*) FROM mp) AS nm, (SELECT count(*) FROM ap) AS na),
pos AS (SELECT unnest(range(0, (SELECT greatest(nc, nm, na) FROM n))) AS i)
SELECT CAST(i AS BIGINT) AS pos, cp.index AS index_clean, mp.index AS index_meta, ap.aug_id AS aug_id_aug
FROM pos, n, cp, mp, ap WHERE cp.p = i % nc AND mp.p = i % nm AND ap.p = i % na""")
def d7_zip_positional(spark: SparkSession, d: str):
    train = shape.alias_target(fixtures.train(spark, d))
    clean, meta = sampling.stratified_split(train, 0.9)
    a = shape.filter_interval(shape.filter_methods(fixtures.aug(spark, d), ["CharswapAug", "WordnetAug"]), 20, 200)
    a = joins.keep_train_origins(a, clean)
    a = a.select((F.col("origin") * 10 + F.array_position(F.array(*[F.lit(m) for m in AUG_METHODS]), F.col("aug_method"))).alias("aug_id"))
    c, m = clean.select("index"), meta.select("index")
    target = sampling.align_target(c.count(), m.count(), a.count())
    return joins.zip_positional({
        "clean": sampling.length_align(c, target, order_col="index"),
        "meta": sampling.length_align(m, target, order_col="index"),
        "aug": sampling.length_align(a, target, order_col="aug_id"),
    })


BANK8_SQL = """
bank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY w, vec_id) AS slot FROM weighted) WHERE slot <= 8)"""


@register("d8_score_against_bank", with_views("weighted") + "," + BANK8_SQL + """
SELECT q.vec_id, count(b.vec_id) AS n_bank, round(max(list_dot_product(q.embedding, b.embedding)), 6) AS max_dot,
       round(sum(list_dot_product(q.embedding, b.embedding)), 6) AS sum_dot
FROM weighted q LEFT JOIN bank b ON q.label = b.label GROUP BY q.vec_id""")
def d8_score_against_bank(spark: SparkSession, d: str):
    from noisesift.operators import contrast

    w = fixtures.weighted(spark, d).withColumnRenamed("label", "class")
    bank = contrast.bank_topk(w.select("class", F.col("embedding").alias("vec"), F.col("w").alias("score"), "vec_id"), 8)
    q = joins.score_against_bank(w.select("vec_id", "class", F.col("embedding").alias("vec")), bank, method="builtin")
    return q.select(
        "vec_id", F.size("bank_dots").cast("bigint").alias("n_bank"),
        F.round(F.array_max("bank_dots"), 6).alias("max_dot"),
        F.round(F.aggregate("bank_dots", F.lit(0.0), lambda a, b: a + b), 6).alias("sum_dot"),
    )


@register("d8_score_against_bank_arrow", with_views("weighted") + "," + BANK8_SQL + """
SELECT q.vec_id, count(b.vec_id) AS n_bank, round(max(list_dot_product(q.embedding, b.embedding)), 6) AS max_dot,
       round(sum(list_dot_product(q.embedding, b.embedding)), 6) AS sum_dot
FROM weighted q LEFT JOIN bank b ON q.label = b.label GROUP BY q.vec_id""")
def d8_score_against_bank_arrow(spark: SparkSession, d: str):
    from noisesift.operators import contrast

    w = fixtures.weighted(spark, d).withColumnRenamed("label", "class")
    bank = contrast.bank_topk(w.select("class", F.col("embedding").alias("vec"), F.col("w").alias("score"), "vec_id"), 8)
    q = joins.score_against_bank(w.select("vec_id", "class", F.col("embedding").alias("vec")), bank, method="arrow")
    return q.select(
        "vec_id", F.size("bank_dots").cast("bigint").alias("n_bank"),
        F.round(F.array_max("bank_dots"), 6).alias("max_dot"),
        F.round(F.aggregate("bank_dots", F.lit(0.0), lambda a, b: a + b), 6).alias("sum_dot"),
    )


@register("d9_batch_partners", with_views("weighted") + """
SELECT a.vec_id, count(b.vec_id) AS n_partners, CAST(sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS BIGINT) AS n_same
FROM weighted a JOIN weighted b ON a.batch_id = b.batch_id AND a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def d9_batch_partners(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d)
    p = joins.batch_partners(w, "vec_id", "batch_id", ["label"], max_batch=64)
    return p.select(
        "vec_id", F.size("partners").cast("bigint").alias("n_partners"),
        F.size(F.filter("partners", lambda m: m["label"] == F.col("label"))).cast("bigint").alias("n_same"),
    ).where(F.col("n_partners") > 0)


@register("d9_batch_partners_tiles", with_views("weighted") + """
SELECT a.vec_id, count(b.vec_id) AS n_partners, CAST(sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS BIGINT) AS n_same
FROM weighted a JOIN weighted b ON a.vec_id // 100 = b.vec_id // 100 AND a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def d9_batch_partners_tiles(spark: SparkSession, d: str):
    """Batches of 100 rows in tiles of 16: a row comes once per tile."""
    w = fixtures.weighted(spark, d).withColumn("batch_id", F.floor(F.col("vec_id") / 100))
    p = joins.batch_partners(w, "vec_id", "batch_id", ["label"], max_batch=16)
    same = F.size(F.filter("partners", lambda m: m["label"] == F.col("label")))
    return p.groupBy("vec_id").agg(F.sum(F.size("partners")).alias("n_partners"), F.sum(same).alias("n_same")).where("n_partners > 0")


@register("d8_score_against_bank_blocks", with_views("weighted") + "," + BANK8_SQL + """
SELECT q.vec_id, count(b.vec_id) AS n_bank, round(max(list_dot_product(q.embedding, b.embedding)), 6) AS max_dot,
       round(sum(list_dot_product(q.embedding, b.embedding)), 6) AS sum_dot
FROM weighted q LEFT JOIN bank b ON q.label = b.label GROUP BY q.vec_id""")
def d8_score_against_bank_blocks(spark: SparkSession, d: str):
    """The bank in blocks of 1,000 doubles, about two vectors a class each."""
    from noisesift.operators import contrast, tiles

    w = fixtures.weighted(spark, d).withColumnRenamed("label", "class")
    bank = contrast.bank_topk(w.select("class", F.col("embedding").alias("vec"), F.col("w").alias("score"), "vec_id"), 8)
    q = tiles.score_blocks(w.select("vec_id", "class", F.col("embedding").alias("vec")), bank, cells=1000)
    return q.select(
        "vec_id", F.size("bank_dots").cast("bigint").alias("n_bank"),
        F.round(F.array_max("bank_dots"), 6).alias("max_dot"),
        F.round(F.aggregate("bank_dots", F.lit(0.0), lambda a, b: a + b), 6).alias("sum_dot"),
    )


# ------------------------------------------------------------------ I
@register("i1_union_methods", with_views("aug") + """
SELECT origin, aug_method, text, NULL::DOUBLE AS readability FROM aug WHERE aug_method IN ('CharswapAug', 'ChecklistAug')
UNION ALL SELECT origin, aug_method, NULL, readability FROM aug WHERE aug_method NOT IN ('CharswapAug', 'ChecklistAug')""")
def i1_union_methods(spark: SparkSession, d: str):
    a = fixtures.aug(spark, d)
    texts = ["CharswapAug", "ChecklistAug"]
    x = [a.where(F.col("aug_method") == m).select("origin", "aug_method", "text") for m in texts]
    y = [a.where(F.col("aug_method") == m).select("origin", "aug_method", "readability") for m in fixtures.AUG_METHODS if m not in texts]
    return shape.union_methods(*x, *y)


@register("i2_union_raw_aug", with_views("train", "aug") + """
SELECT index, NULL::BIGINT AS origin, label, readability, cola FROM train
UNION ALL
SELECT NULL, a.origin, t.label, a.readability, a.cola FROM aug a LEFT JOIN train t ON a.origin = t.index
WHERE a.readability > 20 AND a.readability < 200
UNION ALL
SELECT NULL, a.origin, t.label, a.readability, a.cola FROM aug a LEFT JOIN train t ON a.origin = t.index
WHERE a.readability > 0.1 AND a.readability < 200""")
def i2_union_raw_aug(spark: SparkSession, d: str):
    t = fixtures.train(spark, d).select("index", "label", "readability", "cola")
    a = joins.attach_label(fixtures.aug(spark, d).select("origin", "readability", "cola"), fixtures.train(spark, d))
    return shape.union_raw_aug(t, shape.filter_all_scores(a, 20, 200), shape.filter_all_scores(a, 0.1, 200))


@register("i3_config_difference", """
WITH c AS (SELECT doc_id, lang, source, n_chars % 3 AS bucket FROM documents),
p AS (SELECT a.doc_id, a.lang AS la, a.source AS sa, a.bucket AS ba, b.lang AS lb, b.source AS sb, b.bucket AS bb
      FROM c a JOIN c b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, concat_ws(',',
         CASE WHEN la IS DISTINCT FROM lb THEN 'lang=' || la END,
         CASE WHEN sa IS DISTINCT FROM sb THEN 'source=' || sa END) AS diff
FROM p""")
def i3_config_difference(spark: SparkSession, d: str):
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"),
                     F.lit("bucket_path"), (F.col("n_chars") % 3).cast("string")).alias("cfg"),
    )
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("cfg").alias("cfg_next"))
    j = docs.join(nxt, "doc_id")
    diff = shape.config_difference(F.col("cfg"), F.col("cfg_next"), ignore=["path"])
    txt = F.transform(F.array_sort(diff), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return j.select("doc_id", F.array_join(txt, ",").alias("diff"))


@register("i4_distinct_labels", with_views("train") + "SELECT DISTINCT label FROM train")
def i4_distinct_labels(spark: SparkSession, d: str):
    return shape.distinct_labels(fixtures.train(spark, d), "label")


@register("c6_filter_tags_any", with_views("run_log") + """
SELECT experiment, version, metric, event_id FROM run_log WHERE contains(metric, 'Test') OR contains(metric, 'Val')""")
def c6_filter_tags_any(spark: SparkSession, d: str):
    return shape.filter_tags(fixtures.run_log(spark, d), ("Test", "Val"), mode="any").select("experiment", "version", "metric", "event_id")
