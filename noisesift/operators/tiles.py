"""Banks and batches of any size: blocks and tiles whose partial results merge.

A bank is written once, cut into blocks of bounded size by a hash of (class, slot), and each
block goes to the tasks as a broadcast of its own. A batch is cut into tiles; every ordered pair
of tiles is a group. Either way a row's softmax denominator comes as one log-sum-exp per
block or tile, and these merge exactly: ``lse = m + log sum exp(lse_i - m)``. The bank never
stands in one row, one broadcast or the driver as a whole, and no group holds a batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from noisesift.functions.vectors import logsumexp
from noisesift.session import scratch_dir

BLOCK_CELLS = 4_000_000  # doubles of a bank in one broadcast (32 MB)
TILE_ROWS = 2048


def np_logsumexp(a: np.ndarray) -> np.ndarray:
    """Per row; a row without entries gives -inf."""
    if not a.shape[1]:
        return np.full(len(a), -np.inf)
    m = a.max(axis=1, keepdims=True)
    safe = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return (safe + np.log(np.exp(a - safe).sum(axis=1, keepdims=True)))[:, 0]


def bank_blocks(bank: DataFrame, key: str, vec: str, cells: int = BLOCK_CELLS) -> list:
    """Broadcasts of ``{class: (slots, matrix)}``, each of about ``cells`` doubles; null classes have no bank."""
    spark = bank.sparkSession
    rows = bank.select(F.col(key).alias("c"), F.col("slot").cast("long").alias("slot"), F.col(vec).cast("array<double>").alias("v")).where("c IS NOT NULL")
    held = scratch_dir(spark, "bank")
    rows.write.parquet(held)
    rows = spark.read.schema(rows.schema).parquet(held)
    total = rows.agg(F.sum(F.size("v"))).first()[0] or 0
    n, out = max(1, -(-total // cells)), []
    for k in range(n):
        part: dict = {}
        # one block of the bank at a time is on the driver
        for r in sorted(rows.where(F.pmod(F.xxhash64("c", "slot"), F.lit(n)) == k).collect(), key=lambda r: r["slot"]):
            part.setdefault(r["c"], ([], []))
            part[r["c"]][0].append(r["slot"])
            part[r["c"]][1].append(r["v"])
        out.append(spark.sparkContext.broadcast({c: (np.array(s), np.array(v, dtype=float)) for c, (s, v) in part.items()}))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def score_blocks(queries: DataFrame, bank: DataFrame, vec: str = "vec", key: str = "class", cells: int = BLOCK_CELLS) -> DataFrame:
    """D8. ``queries`` with ``bank_dots`` (by slot), whatever the size of the bank.

    With several blocks the queries are written once, scored block by block in one job, and only
    (row, slot, dot) lists meet again by row.
    """
    spark, blocks = queries.sparkSession, bank_blocks(bank, key, vec, cells)
    fields = [StructField("slots", ArrayType(LongType())), StructField("dots", ArrayType(DoubleType()))]

    def scored(df: DataFrame, block, schema: StructType, keep: list[str]) -> DataFrame:
        def score(batches):
            b = block.value
            for pdf in batches:
                slots, dots = np.empty(len(pdf), dtype=object), np.empty(len(pdf), dtype=object)
                slots[:] = [np.zeros(0, np.int64)] * len(pdf)  # a class without a bank, or null
                dots[:] = [np.zeros(0)] * len(pdf)
                for c, at in pdf.groupby(key).indices.items():
                    if c in b:
                        found = np.stack(pdf[vec].to_numpy()[at]) @ b[c][1].T
                        for i, row in zip(at, found, strict=True):
                            slots[i], dots[i] = b[c][0], row
                yield pdf[keep].assign(slots=slots, dots=dots)

        return df.mapInPandas(score, schema)

    if len(blocks) == 1:
        out = scored(queries, blocks[0], StructType([*queries.schema.fields, *fields]), queries.columns)
        return out.withColumnRenamed("dots", "bank_dots").drop("slots")
    held = scratch_dir(spark, "queries")
    queries.withColumn("__row", F.monotonically_increasing_id()).write.parquet(held)
    rows = spark.read.parquet(held)
    slim = StructType([StructField("__row", LongType()), *fields])
    parts = _union([scored(rows.select("__row", key, vec), b, slim, ["__row"]) for b in blocks])
    one = F.flatten(F.collect_list(F.arrays_zip("slots", "dots")))
    dots = parts.groupBy("__row").agg(F.transform(F.array_sort(one), lambda s: s["dots"]).alias("bank_dots"))
    return rows.join(dots, "__row").drop("__row")


def info_nce_blocks(queries: DataFrame, bank: DataFrame, temperature: float = 0.07, key: str = "class", vec: str = "vec", cells: int = BLOCK_CELLS) -> DataFrame:
    """J4, whatever the size of the bank: each block gives a row its log-sum-exp over that block's
    negatives, merged by row with the positive pair."""
    spark, blocks, t = queries.sparkSession, bank_blocks(bank, key, vec, cells), float(temperature)
    cols = ["batch_id", key, "q", "q_aug", "k"]
    kt = queries.schema[key].dataType.simpleString()
    several = len(blocks) > 1
    rows = queries.select(*cols, *([F.monotonically_increasing_id().alias("__row")] if several else []))
    if several:
        held = scratch_dir(spark, "queries")
        rows.write.parquet(held)
        rows = spark.read.parquet(held)

    def scored(block, first: bool) -> DataFrame:
        def score(batches):
            b = block.value
            for pdf in batches:
                outs = []
                for c, g in pdf.groupby(key, dropna=False):
                    k = np.stack(g["k"].to_numpy())
                    mine = None if pd.isna(c) else b.get(c)
                    for side, name in enumerate(("q", "q_aug")):
                        q = np.stack(g[name].to_numpy())
                        pos = (q * k).sum(axis=1) / t
                        logits = q @ mine[1].T / t if mine is not None else np.zeros((len(q), 0))
                        lse = np_logsumexp(np.concatenate([pos[:, None], logits], axis=1) if first else logits)
                        out = pd.DataFrame({"batch_id": g["batch_id"].to_numpy(), key: pd.Series([None if pd.isna(c) else c] * len(q), dtype=object), "lse": lse, "pos": pos})
                        outs.append(out.assign(row=2 * g["__row"].to_numpy() + side) if several else out.assign(row=0))
                if outs:
                    yield pd.concat(outs, ignore_index=True)

        return rows.mapInPandas(score, f"batch_id long, {key} {kt}, lse double, pos double, row long")

    parts = _union([scored(b, k == 0) for k, b in enumerate(blocks)])
    if several:
        whole = parts.where("lse > double('-inf')").groupBy("row")
        parts = whole.agg(F.first("batch_id").alias("batch_id"), F.first(key).alias(key), logsumexp(F.collect_list("lse")).alias("lse"), F.first("pos").alias("pos"))
    return parts.groupBy("batch_id", key).agg(F.avg(F.col("lse") - F.col("pos")).alias("loss"), F.count(F.lit(1)).alias("n"))


def tiled(df: DataFrame, batch: str, rows: int) -> DataFrame:
    """Adds ``__tile`` and ``__tiles``: batches cut into tiles of about ``rows`` rows (a batch within it is one tile)."""
    n = df.groupBy(batch).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("__tiles")).withColumnRenamed(batch, "__b")
    row = df.withColumn("__row", F.monotonically_increasing_id())
    out = row.join(n, F.col(batch).eqNullSafe(F.col("__b"))).drop("__b")
    return out.withColumn("__tile", F.pmod(F.xxhash64("__row"), F.col("__tiles")).cast("int"))


def supervised_contrast_tiles(df: DataFrame, temperature: float = 0.07, base_temperature: float = 0.07, vec: str = "vec", label: str = "class",
                              batch: str = "batch_id", aug_vecs: Sequence[str] = (), tile: int = TILE_ROWS) -> DataFrame:
    """J5, whatever the size of a batch: per anchor and tile a log-sum-exp, the sum and the number of same-class
    similarities, merged by anchor. ``aug_vecs``: columns of augmented views; each counts as one more row of the
    batch with the row's label. Output as ``contrast.supervised_contrast``."""
    t, scale = float(temperature), float(temperature / base_temperature)
    views = F.explode(F.array(*[F.col(c).cast("array<double>") for c in (vec, *aug_vecs)]))
    rows = df.select(F.col(batch).alias("b"), F.col(label).alias("y"), views.alias("v"))
    cut = tiled(rows, "b", tile)
    others = F.transform(F.sequence(F.lit(0), F.col("__tiles") - 1), lambda j: F.struct(F.col("__tile").alias("i"), j.alias("j"), F.lit(True).alias("anchor")))
    asked = F.transform(F.sequence(F.lit(0), F.col("__tiles") - 1), lambda i: F.struct(i.alias("i"), F.col("__tile").alias("j"), F.lit(False).alias("anchor")))
    to = F.concat(others, F.filter(asked, lambda s: s["i"] != s["j"]))  # in its own tile a row is both
    sent = cut.select("b", "__row", "y", "v", F.explode(to).alias("to")).select("b", "to.*", "__row", "y", "v")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        y, _ = pd.factorize(pdf["y"])
        x, a = np.stack(pdf["v"].to_numpy()), np.flatnonzero(pdf["anchor"].to_numpy())
        o = a if own else np.flatnonzero(~pdf["anchor"].to_numpy())
        if not len(a):
            return pd.DataFrame({"b": [], "row": [], "lse": [], "pos": [], "npos": []})
        s = x[a] @ x[o].T / t
        off = ~np.eye(len(a), dtype=bool) if own else np.ones(s.shape, dtype=bool)
        same = (y[a][:, None] == y[o][None, :]) & off & (y[a] >= 0)[:, None]
        return pd.DataFrame({"b": pdf["b"].iloc[0], "row": pdf["__row"].to_numpy()[a], "lse": np_logsumexp(np.where(off, s, -np.inf)),
                             "pos": np.where(same, s, 0.0).sum(axis=1), "npos": same.sum(axis=1)})

    bt = df.schema[batch].dataType.simpleString()
    parts = sent.groupBy("b", "i", "j").applyInPandas(pair, f"b {bt}, row long, lse double, pos double, npos long")
    some = F.when(F.col("lse") > float("-inf"), F.col("lse"))  # a tile of the row alone has nothing to add
    whole = parts.groupBy("b", "row").agg(logsumexp(F.collect_list(some)).alias("lse"), F.sum("pos").alias("pos"), F.sum("npos").alias("npos"))
    anchors = whole.where("npos > 0").select("b", (-F.lit(scale) * (F.col("pos") / F.col("npos") - F.col("lse"))).alias("l"))
    return anchors.groupBy(F.col("b").alias(batch)).agg(F.avg("l").alias("loss"), F.count(F.lit(1)).alias("anchors"))
