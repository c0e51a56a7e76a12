"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.session import ensure_checkpoint_dir, scratch_dir, table

__all__ = ["ORACLES", "QUERIES", "checked_ids", "components", "hashed_sample", "query", "staged", "table"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query function under ``name``, with its DuckDB SQL if it has one."""

    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: ids that a join may broadcast (8 bytes each); larger sides are shuffled
BROADCAST_IDS = 4_000_000


def checked_ids(ids: DataFrame) -> DataFrame:
    """A stored one-column table of ids, marked for broadcast if its counted size allows it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def hashed_sample(df: DataFrame, k: int, id_col: str, text_col: str, *more: str) -> list:
    """At most ``k`` rows ``(t, *more)`` of smallest hash of id and text, in that order.

    Rows above the hash that about a fifth more than ``k`` rows lie under are left out in
    their tasks, so that is all that reaches the driver, however many tasks there are.
    """
    rows = df.count()
    h = F.xxhash64(id_col, text_col)
    picked = df.select(h.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *more)
    if rows > k:
        picked = picked.where(F.pmod("h", F.lit(1 << 31)) < F.lit(int((1 << 31) * min(1.0, 1.2 * k / rows))))
    return picked.orderBy(F.pmod("h", F.lit(1 << 31)), "h", "t").limit(k).collect()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(id, component_id)``, the smallest id of each.

    Alternating large-star / small-star steps, each one a shuffle of the links;
    the number of rounds grows with the logarithm of the longest chain. Ids that
    occur in no link are not returned. Empty links give an empty result. Nothing
    but two totals per round reaches the driver.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small_low, "u")
        small = pairs.select("u", F.col("m").alias("v")).union(pairs.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return edges.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("id"), "component_id").union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )
