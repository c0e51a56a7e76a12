"""Curation pipeline: filter, stratified split, semi-join, align (the flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.operators import joins, sampling, shape
from noisesift.plans.registry import register

# Settings of the flagship run (FIXTURES.md minimum slice).
METHODS = ("CharswapAug", "WordnetAug")
LO, HI = 20.0, 200.0
CLEAN_FRAC = 0.9
SEED = 42


def curated_pairs(spark: SparkSession, sf_dir: str, methods=METHODS, lo=LO, hi=HI, clean_frac=CLEAN_FRAC, seed=SEED) -> DataFrame:
    """Aligned (clean, augmented) rows after the method/interval filters and the stratified split."""
    train = shape.alias_target(fixtures.train(spark, sf_dir))
    aug = shape.filter_interval(shape.filter_methods(fixtures.aug(spark, sf_dir), methods), lo, hi)
    clean, _meta = sampling.stratified_split(train, clean_frac, "class", "index", seed)
    aug = joins.keep_train_origins(aug, clean)
    return joins.flatten_sides(joins.align(clean, aug))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = curated_pairs(spark, sf_dir)
    return aligned.groupBy(F.col("class_raw").alias("class"), F.col("aug_method_aug").alias("aug_method")).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.countDistinct("origin_aug").alias("origins"),
        F.round(F.avg("readability_aug"), 6).alias("mean_readability"),
    )


CLEAN_SPLIT_SQL = """
ranked AS (SELECT *, label AS class,
                  row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('-', index, '42')), index) AS rk,
                  count(*) OVER (PARTITION BY label) AS n FROM train),
clean AS (SELECT * FROM ranked WHERE rk <= floor(0.9 * n + 0.5)),
meta AS (SELECT * FROM ranked WHERE rk > floor(0.9 * n + 0.5))"""

register("slice_curation", fixtures.with_views("train", "aug") + "," + CLEAN_SPLIT_SQL + """
, a AS (SELECT * FROM aug WHERE aug_method IN ('CharswapAug', 'WordnetAug')
        AND readability > 20 AND readability < 200 AND origin IN (SELECT index FROM clean))
SELECT c.class, a.aug_method, count(*) AS pairs, count(DISTINCT a.origin) AS origins,
       round(avg(a.readability), 6) AS mean_readability
FROM clean c JOIN a ON c.index = a.origin GROUP BY 1, 2""")(flagship)
