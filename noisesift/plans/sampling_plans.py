"""Queries for sampling, splitting and batching (E)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import with_views
from noisesift.operators import joins, sampling, shape
from noisesift.plans.curation import CLEAN_SPLIT_SQL
from noisesift.plans.registry import register
from noisesift.plans.shaping import D2_SIDES_SQL


def hexfrac_sql(expr: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('-', {expr}, '{seed}')), 1, 8)) AS BIGINT) / 4294967296.0"


def _train(spark, d):
    return shape.alias_target(fixtures.train(spark, d))


@register("e1_sample_per_group", with_views("aug") + "," + D2_SIDES_SQL.replace("AS sentence1\n", "AS sentence1, v AS v1\n").replace("AS sentence2 FROM", "AS sentence2, v AS v2 FROM") + """
, j AS (SELECT s1.aug_method, s1.origin, v1, v2, concat_ws('-', s1.aug_method, s1.origin, v1, v2) AS pair_id
        FROM side1 s1 JOIN side2 s2 ON s1.aug_method = s2.aug_method AND s1.origin = s2.origin)
SELECT aug_method, origin, v1, v2 FROM (
  SELECT *, row_number() OVER (PARTITION BY aug_method, origin ORDER BY md5(concat_ws('-', pair_id, '42')), pair_id) AS rn FROM j)
WHERE rn <= 2""")
def e1_sample_per_group(spark: SparkSession, d: str):
    a = fixtures.aug(spark, d)
    s1 = a.select("aug_method", "origin", F.explode(F.array(F.lit(0), F.lit(1))).alias("v1"))
    s2 = a.select("aug_method", "origin", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v2"))
    j = joins.pair_sides(s1, s2).withColumn("pair_id", F.concat_ws("-", "aug_method", "origin", "v1", "v2"))
    return sampling.sample_per_group(j, ["aug_method", "origin"], "pair_id", 2).select("aug_method", "origin", "v1", "v2")


STRAT_SQL = """
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('-', index, '42')), index) AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM train)"""


@register("e2_stratified_take", with_views("train") + "," + STRAT_SQL + """
SELECT index, label FROM r WHERE rk <= floor(300.0 / (SELECT count(*) FROM train) * n + 0.5)""")
def e2_stratified_take(spark: SparkSession, d: str):
    return sampling.stratified_take(_train(spark, d), 300).select("index", "label")


@register("e3_stratified_split", with_views("train") + "," + STRAT_SQL + """
SELECT index, label, CASE WHEN rk <= floor(0.9 * n + 0.5) THEN 'first' ELSE 'second' END AS part FROM r""")
def e3_stratified_split(spark: SparkSession, d: str):
    return sampling.split_parts(_train(spark, d), 0.9, "class").select("index", "label", "part")


@register("e4_random_split", with_views("train") + """
, r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', index, '7')), index) AS rk, count(*) OVER () AS n FROM train)
SELECT index, CASE WHEN rk <= floor(0.8 * n + 0.5) THEN 'first' ELSE 'second' END AS part FROM r""")
def e4_random_split(spark: SparkSession, d: str):
    return sampling.split_parts(_train(spark, d), 0.8, None, "index", 7).select("index", "part")


@register("e5_split_report", with_views("train") + "," + CLEAN_SPLIT_SQL + """
SELECT 'clean' AS part, class, count(*) AS n FROM clean GROUP BY class
UNION ALL SELECT 'meta', class, count(*) FROM meta GROUP BY class""")
def e5_split_report(spark: SparkSession, d: str):
    clean, meta = sampling.stratified_split(_train(spark, d), 0.9)
    return sampling.split_report({"clean": clean, "meta": meta})


OVERSAMPLE_SQL = """
cnt AS (SELECT label AS class, count(*) AS n FROM train GROUP BY label),
top AS (SELECT max(n) AS m FROM cnt),
ranked AS (SELECT index, label AS class, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('-', index, '42')), index) AS rk FROM train),
copies AS (SELECT c.class, j, c.n, concat_ws('-', 'copy', c.class, j) AS sample_id
           FROM cnt c, top, LATERAL (SELECT unnest(range(0, top.m - c.n)) AS j)),
picked AS (SELECT r.index, r.class, c.sample_id FROM copies c JOIN ranked r ON r.class = c.class
           AND r.rk = CAST(('0x' || substr(md5(concat_ws('-', c.sample_id, '42')), 1, 12)) AS BIGINT) % c.n + 1),
balanced AS (SELECT index, class, CAST(index AS VARCHAR) AS sample_id, false AS is_copy FROM ranked
             UNION ALL SELECT index, class, sample_id, true FROM picked)"""


@register("e6_oversample_to_max", with_views("train") + "," + OVERSAMPLE_SQL + """
SELECT sample_id, index, class, is_copy FROM balanced""")
def e6_oversample_to_max(spark: SparkSession, d: str):
    return sampling.oversample_to_max(spark, _train(spark, d)).select("sample_id", "index", "class", "is_copy")


@register("e7_round_robin_batches", with_views("train") + "," + OVERSAMPLE_SQL + """
, firsts AS (SELECT class, row_number() OVER (ORDER BY min(index), class) - 1 AS cord FROM balanced GROUP BY class),
nc AS (SELECT count(*) AS c FROM firsts),
nmax AS (SELECT max(k) AS m FROM (SELECT count(*) AS k FROM balanced GROUP BY class)),
rr AS (SELECT b.sample_id, b.class,
              (row_number() OVER (PARTITION BY b.class ORDER BY md5(concat_ws('-', b.sample_id, '42')), b.sample_id) - 1) * (SELECT c FROM nc) + f.cord AS pos
       FROM balanced b JOIN firsts f ON b.class = f.class)
SELECT sample_id, class, CAST(pos AS BIGINT) AS pos, CAST(pos // 4 AS BIGINT) AS batch_id FROM rr
WHERE pos < ((SELECT m FROM nmax) * (SELECT c FROM nc)) // 4 * 4""")
def e7_round_robin_batches(spark: SparkSession, d: str):
    bal = sampling.oversample_to_max(spark, _train(spark, d))
    b = sampling.round_robin_batches(bal, 4, "class", "sample_id", first_seen="index")
    return b.select("sample_id", "class", "pos", "batch_id")


@register("e8_chunkify", with_views("corpus") + """
SELECT index, CAST((row_number() OVER (ORDER BY index) - 1) % 3 AS INT) AS chunk FROM corpus""")
def e8_chunkify(spark: SparkSession, d: str):
    from noisesift.operators.ranking import ordered_position

    return sampling.chunkify(ordered_position(fixtures.corpus(spark, d).select("index"), "index"), 3).select("index", "chunk")


@register("e9_length_align", with_views("train", "aug") + "," + CLEAN_SPLIT_SQL + """
, t AS (SELECT count(*) AS target FROM aug WHERE origin IN (SELECT index FROM clean)),
cp AS (SELECT index, row_number() OVER (ORDER BY index) - 1 AS p, count(*) OVER () AS n FROM clean),
pos AS (SELECT unnest(range(0, (SELECT target FROM t))) AS i)
SELECT CAST(i AS BIGINT) AS pos, index FROM pos JOIN cp ON cp.p = i % cp.n""")
def e9_length_align(spark: SparkSession, d: str):
    clean, _ = sampling.stratified_split(_train(spark, d), 0.9)
    target = joins.keep_train_origins(fixtures.aug(spark, d), clean).count()
    return sampling.length_align(clean.select("index"), target, order_col="index").select("pos", "index")


@register("e10_shuffle_batches", with_views("corpus") + """
, r AS (SELECT index, row_number() OVER (ORDER BY md5(concat_ws('-', index, '42')), index) - 1 AS pos, count(*) OVER () AS n FROM corpus)
SELECT index, pos, pos // 32 AS batch_id FROM r WHERE pos < n // 32 * 32""")
def e10_shuffle_batches(spark: SparkSession, d: str):
    return sampling.shuffle_batches(fixtures.corpus(spark, d).select("index"), 32, drop_last=True).select("index", "pos", "batch_id")


@register("e10_eval_batches", with_views("corpus") + """
SELECT index, row_number() OVER (ORDER BY index) - 1 AS pos, (row_number() OVER (ORDER BY index) - 1) // 32 AS batch_id FROM corpus""")
def e10_eval_batches(spark: SparkSession, d: str):
    return sampling.shuffle_batches(fixtures.corpus(spark, d).select("index"), 32, shuffle=False, drop_last=False).select("index", "pos", "batch_id")


@register("e11_flip_labels", with_views("train", "aug") + f"""
, a AS (SELECT a.origin, a.aug_method, t.label FROM aug a JOIN train t ON a.origin = t.index)
SELECT origin, aug_method, CASE WHEN {hexfrac_sql("concat_ws(':', origin, aug_method)")} < 0.4 THEN 1 - label ELSE label END AS label,
       label AS orig_label, {hexfrac_sql("concat_ws(':', origin, aug_method)")} < 0.4 AS is_flipped FROM a""")
def e11_flip_labels(spark: SparkSession, d: str):
    a = joins.attach_label(fixtures.aug(spark, d).select("origin", "aug_method"), fixtures.train(spark, d)).dropna()
    f = sampling.flip_labels(a, 0.4, 2, "label", F.concat_ws(":", "origin", "aug_method"))
    return f.select("origin", "aug_method", "label", "orig_label", "is_flipped")


@register("e11_flip_labels_multiclass", with_views("weighted") + f"""
SELECT vec_id, CASE WHEN {hexfrac_sql("vec_id")} < 0.3
                    THEN CAST((label + 1 + floor({hexfrac_sql("vec_id", 43)} * 9)) % 10 AS INT) ELSE label END AS label,
       label AS orig_label, {hexfrac_sql("vec_id")} < 0.3 AS is_flipped FROM weighted""")
def e11_flip_labels_multiclass(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d)
    return sampling.flip_labels(w, 0.3, 10, "label", "vec_id").select("vec_id", "label", "orig_label", "is_flipped")


@register("e12_pair_loaders", with_views("train") + "," + CLEAN_SPLIT_SQL + """
, b AS (SELECT DISTINCT (row_number() OVER (ORDER BY md5(concat_ws('-', index, '42')), index) - 1) // 32 AS base_batch_id FROM clean),
m AS (SELECT DISTINCT (row_number() OVER (ORDER BY index) - 1) // 8 AS meta_batch_id FROM meta)
SELECT i % (SELECT count(*) FROM b) AS base_batch_id, i % (SELECT count(*) FROM m) AS meta_batch_id
FROM range((SELECT greatest((SELECT count(*) FROM b), (SELECT count(*) FROM m)))) AS r(i)""")
def e12_pair_loaders(spark: SparkSession, d: str):
    clean, meta = sampling.stratified_split(_train(spark, d), 0.9)
    base = sampling.shuffle_batches(clean, 32)
    mb = sampling.shuffle_batches(meta, 8, shuffle=False)
    return sampling.pair_loaders(base, mb).select("base_batch_id", "meta_batch_id")


@register("e12_pair_loaders_longer_meta", with_views("train") + "," + CLEAN_SPLIT_SQL + """
, b AS (SELECT DISTINCT (row_number() OVER (ORDER BY md5(concat_ws('-', index, '42')), index) - 1) // 128 AS base_batch_id FROM clean),
m AS (SELECT DISTINCT (row_number() OVER (ORDER BY index) - 1) // 2 AS meta_batch_id FROM meta)
SELECT i % (SELECT count(*) FROM b) AS base_batch_id, i % (SELECT count(*) FROM m) AS meta_batch_id
FROM range((SELECT greatest((SELECT count(*) FROM b), (SELECT count(*) FROM m)))) AS r(i)""")
def e12_pair_loaders_longer_meta(spark: SparkSession, d: str):
    clean, meta = sampling.stratified_split(_train(spark, d), 0.9)
    base = sampling.shuffle_batches(clean, 128)
    mb = sampling.shuffle_batches(meta, 2, shuffle=False)
    return sampling.pair_loaders(base, mb).select("base_batch_id", "meta_batch_id")


@register("e13_batch_mix", with_views("train", "aug") + "," + CLEAN_SPLIT_SQL + """
SELECT 'clean' AS source, index, NULL::BIGINT AS origin, class FROM clean
UNION ALL SELECT 'aug', NULL, a.origin, c.class FROM aug a JOIN clean c ON a.origin = c.index""")
def e13_batch_mix(spark: SparkSession, d: str):
    clean, _ = sampling.stratified_split(_train(spark, d), 0.9)
    a = joins.attach_label(fixtures.aug(spark, d).select("origin"), clean.select("index", "class"), "class")
    a = joins.keep_train_origins(a, clean)
    return sampling.batch_mix(clean.select("index", "class"), a).select("source", "index", "origin", "class")


@register("e1_pair_sample", with_views("aug") + f"""
, s1 AS (SELECT aug_method, origin, v AS v1, concat_ws('-', aug_method, origin, v) AS sid1 FROM aug, (VALUES (0), (1)) AS t(v)),
s2 AS (SELECT aug_method, origin, v AS v2, concat_ws('-', aug_method, origin, v) AS sid2 FROM aug, (VALUES (0), (1), (2)) AS t(v)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY aug_method, origin ORDER BY md5(concat_ws('-', sid1, '42')), sid1) AS i,
              count(*) OVER (PARTITION BY aug_method, origin) AS n1 FROM s1),
r2 AS (SELECT *, row_number() OVER (PARTITION BY aug_method, origin ORDER BY md5(concat_ws('-', sid2, '43')), sid2) AS j,
              count(*) OVER (PARTITION BY aug_method, origin) AS n2 FROM s2),
pk AS (SELECT aug_method, origin, n1, n2, n1 * n2 AS nn, least(n1 * n2, 2) AS m,
              {hexfrac_sql("concat_ws(chr(1), aug_method, origin)")} AS u
       FROM (SELECT DISTINCT aug_method, origin, n1 FROM r1) JOIN (SELECT DISTINCT aug_method, origin, n2 FROM r2) USING (aug_method, origin)),
ix AS (SELECT aug_method, origin, n2, CAST(floor((k + u) * nn / m) AS BIGINT) AS idx
       FROM (SELECT *, unnest(range(0, m)) AS k FROM pk)),
sel AS (SELECT aug_method, origin, idx // n2 + 1 AS i, idx % n2 + 1 AS j FROM ix)
SELECT sel.aug_method, sel.origin, r1.v1, r2.v2 FROM sel JOIN r1 USING (aug_method, origin, i) JOIN r2 USING (aug_method, origin, j)""")
def e1_pair_sample(spark: SparkSession, d: str):
    a = fixtures.aug(spark, d)
    s1 = a.select("aug_method", "origin", F.explode(F.array(F.lit(0), F.lit(1))).alias("v1"))
    s1 = s1.withColumn("sid1", F.concat_ws("-", "aug_method", "origin", "v1"))
    s2 = a.select("aug_method", "origin", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v2"))
    s2 = s2.withColumn("sid2", F.concat_ws("-", "aug_method", "origin", "v2"))
    return joins.pair_sides_sampled(s1, s2, 2, "sid1", "sid2").select("aug_method", "origin", "v1", "v2")
