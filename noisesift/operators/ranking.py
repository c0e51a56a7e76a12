"""Exact, skew-safe ranks and positions.

Stratified splits, balanced batches and positional joins all need a row's rank
inside a key (class) or inside the whole table. A plain
``Window.partitionBy(class)`` sends each class to one task; with two or three
classes that is two or three tasks for the whole table. Instead each key is cut
into ``16**digits`` ranges of the order itself (the leading hex digits of the
md5 order key, or any caller-given monotone bucket), ranked inside
``(key, range)`` by a window that spreads over many tasks, and shifted by the
row count of the earlier ranges of the same key. Those counts form a table of
at most ``keys * 16**digits`` rows, built by a map-side partial aggregate; AQE
broadcasts it when its measured size is small and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42
DEFAULT_DIGITS = 4  # 65536 ranges per key: a key holding 33 TB splits into ~0.5 GB windows


def hash_order(id_col: str | Column, seed: int = DEFAULT_SEED) -> Column:
    """Deterministic shuffle key: md5 of "<id>-<seed>" (identical in DuckDB)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("-", c.cast("string"), F.lit(str(seed))))


def hash_fraction(id_col: str | Column, seed: int = DEFAULT_SEED) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of the md5 order key."""
    h = hash_order(id_col, seed)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Equi-join on ``keys`` that treats null keys as equal (``<=>``), so rows whose key
    is null (an unlabeled row, say) keep their group instead of vanishing. The right
    side's key columns are dropped, as with ``join(on=[...])``."""
    keys = list(keys)
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    if broadcast:
        r = F.broadcast(r)
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    if not cond:
        raise ValueError("keyed_join needs at least one key")
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    rank_col: str = "rank",
    count_col: str | None = None,
) -> DataFrame:
    """1-based rank of each row inside ``keys`` by ``order`` (a total order).

    ``bucket`` must be monotone in ``order`` (rows of a lower bucket sort first).
    Adds ``rank_col`` and, if given, ``count_col`` = rows in the key.
    """
    keys = list(keys)
    b = "__bucket"
    x = df.withColumn(b, bucket)
    counts = x.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    if keys:
        offsets = counts.select(
            *keys, b,
            F.coalesce(F.sum("__n").over(by_key.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
            F.sum("__n").over(by_key).alias("__total"),
        )
    else:
        # A single key: the offsets table has one row per bucket, bounded by 16**digits.
        offsets = counts.select(
            b,
            F.coalesce(F.sum("__n").over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
            F.sum("__n").over(Window.partitionBy()).alias("__total"),
        )
    local = Window.partitionBy(*keys, b).orderBy(*order)
    ranked = keyed_join(x.withColumn("__local", F.row_number().over(local)), offsets, [*keys, b])
    out = ranked.withColumn(rank_col, (F.col("__off") + F.col("__local")).cast("bigint"))
    if count_col:
        out = out.withColumn(count_col, F.col("__total").cast("bigint"))
    return out.drop(b, "__local", "__off", "__total")


def hashed_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: int = DEFAULT_SEED,
    rank_col: str = "rank",
    count_col: str | None = None,
    digits: int = DEFAULT_DIGITS,
) -> DataFrame:
    """Rank inside ``keys`` in the seeded md5 order of ``id_col`` (ties by id)."""
    h = hash_order(id_col, seed)
    return rank_within(
        df.withColumn("__h", h), keys, [F.col("__h"), F.col(id_col)],
        F.substring(F.col("__h"), 1, digits), rank_col, count_col,
    ).drop("__h")


ROWS_PER_RANGE = 50_000
MOST_RANGES = 4096


def range_splits(df: DataFrame, order: Column) -> list[float]:
    """Borders of ranges of about ``ROWS_PER_RANGE`` rows by a numeric order (approximate quantiles,
    ``MOST_RANGES`` at most); a small table is one range."""
    x = df.select(order.cast("double").alias("__od"))
    n = min(MOST_RANGES, x.count() // ROWS_PER_RANGE)
    cuts = x.approxQuantile("__od", [i / n for i in range(1, n)], 1.0 / (4 * n)) if n > 1 else []
    finite = sorted({c for c in cuts if c == c and abs(c) != float("inf")})
    return [float("-inf"), *(finite or [0.0]), float("inf")]  # a table without finite values is cut anywhere


def ordered_position(
    df: DataFrame,
    order_col: str,
    keys: Sequence[str] = (),
    pos_col: str = "pos",
    count_col: str | None = None,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """0-based position inside ``keys`` by a numeric ``order_col`` (then ``tiebreak``; the
    whole order must be unique per key).

    Ranges lie at approximate quantiles of the order over all rows, so a burst of rows
    (which only a hot key can have) gets ranges in proportion. Nulls sort first and NaN last, as in a plain window.
    """
    # Ranges at approximate quantiles, found by binary search in the JVM (pyspark.ml Bucketizer).
    from pyspark.ml.feature import Bucketizer

    keys, value = list(keys), F.col(order_col).cast("double")
    x = df.withColumn("__od", value)
    # "keep" puts NaN into a range after all others
    x = Bucketizer(splits=range_splits(df, value), inputCol="__od", outputCol="__bq", handleInvalid="keep").transform(x)
    bucket = F.when(F.col("__od").isNull(), F.lit(-1)).otherwise(F.col("__bq")).cast("long")
    out = rank_within(x, keys, [F.col(order_col), *[F.col(t) for t in tiebreak]], bucket, "__rank1", count_col)
    return out.withColumn(pos_col, F.col("__rank1") - 1).drop("__rank1", "__od", "__bq")


def value_starts(df: DataFrame, col: str, start: str = "start", count: str = "count") -> DataFrame:
    """One row per distinct value of a numeric column: its rows, and the rows before it in order.

    The values are counted first (one aggregate), then summed up per range and within each
    range; nulls come first and NaN last.
    """
    from pyspark.ml.feature import Bucketizer

    od = F.col(col).cast("double")
    vals = df.groupBy(col).agg(F.count(F.lit(1)).alias(count)).withColumn("__od", od)
    splits = range_splits(df, od)
    vals = Bucketizer(splits=splits, inputCol="__od", outputCol="__bq", handleInvalid="keep").transform(vals)
    vals = vals.withColumn("__b", F.when(F.col("__od").isNull(), F.lit(-1)).otherwise(F.col("__bq")).cast("long")).drop("__od", "__bq")
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = vals.groupBy("__b").agg(F.sum(count).alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy("__b").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    ran = vals.withColumn("__w", F.coalesce(F.sum(count).over(within), F.lit(0))).join(offsets, "__b")
    return ran.select(col, count, (F.col("__off") + F.col("__w")).alias(start))
