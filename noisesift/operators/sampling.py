"""Sampling, splitting and batching (E).

Randomness is a seeded md5 of the row id, identical in every evaluation and in
DuckDB, so a split is the same on every run and after any task retry. Ranks
inside a class use the skew-safe helper in ``ranking`` (a class may hold most
of the table); global positions use the same helper with no key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisesift.operators.ranking import (
    DEFAULT_DIGITS, DEFAULT_SEED, hash_fraction, hash_order, hashed_rank, keyed_join, ordered_position,
)


def sample_per_group(df: DataFrame, keys: Sequence[str], id_col: str, n: int = 2, seed: int = DEFAULT_SEED) -> DataFrame:
    """E1. At most ``n`` random rows per group.

    A literal limit on ``row_number`` plans as ``WindowGroupLimit`` partial +
    final: every map task keeps only ``n`` rows per group before the shuffle,
    so a hot group costs ``n`` rows per task, not its size.
    """
    w = Window.partitionBy(*keys).orderBy(hash_order(id_col, seed), F.col(id_col))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.lit(n)).drop("__rn")


def _part_size(n: Column, size: float, total: Column) -> Column:
    """Rows of a class that go to the first part: ``floor(frac*n + 0.5)``."""
    frac = F.lit(float(size)) if size < 1 else F.lit(float(size)) / total
    return F.floor(frac * n + F.lit(0.5))


MAX_LOCAL_CUTS = 100_000  # classes whose cuts are sent to the tasks; more are joined


def split_parts(
    df: DataFrame,
    size: float,
    class_col: str | None = "class",
    id_col: str = "index",
    seed: int = DEFAULT_SEED,
    part_col: str = "part",
) -> DataFrame:
    """E2/E3/E4. Tag rows ``first``/``second``; the first part holds ``size`` rows
    (a count when ``size >= 1``, else a fraction), stratified by ``class_col``
    (``None`` = unstratified, for regression).

    Equal to ranking every row in md5 order and cutting at ``floor(frac*n + 0.5)``,
    but without ranking or moving the table: rows are counted by class and md5 range
    (``16**digits`` of them), the range that holds a class's last row of the first part
    is ranked alone, and that row's (hash, id) is the class's cut. Finding the cuts reads
    the class and id columns; the table itself is read once and compared with them.
    """
    keys = [class_col] if class_col else ["__one"]
    digits = DEFAULT_DIGITS
    x = df if class_col else df.withColumn("__one", F.lit(0))
    x = x.withColumn("__h", hash_order(id_col, seed)).withColumn("__b", F.substring("__h", 1, digits))
    counts = x.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__nb"))
    by_key = Window.partitionBy(*keys)
    total = F.lit(float(df.count())) if size >= 1 else F.lit(1.0)  # one scalar for a count
    ranges = counts.select(
        *keys, "__b", "__nb",
        F.coalesce(F.sum("__nb").over(by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__nb").over(by_key).alias("__n"),
    ).withColumn("__k", _part_size(F.col("__n"), size, total))
    over = F.col("__off") + F.col("__nb") > F.col("__k")  # the first such range holds the cut
    edges = ranges.groupBy(*keys).agg(
        F.min(F.when(over, F.col("__b"))).alias("__eb"), F.min(F.when(over, F.struct("__b", (F.col("__k") - F.col("__off")).alias("need"))))["need"].alias("__need")
    )
    near = keyed_join(x.select(*keys, id_col, "__h", "__b"), edges.select(*keys, F.col("__eb").alias("__b"), "__need"), [*keys, "__b"])
    place = Window.partitionBy(*keys, "__b").orderBy("__h", id_col)  # one range per class
    last = near.withColumn("__r", F.row_number().over(place)).where(F.col("__r") == F.col("__need")).select(*keys, F.struct("__h", id_col).alias("__cut"))
    cuts = keyed_join(edges.drop("__need"), last, keys, "left").select(*keys, "__eb", "__cut")
    found = cuts.limit(MAX_LOCAL_CUTS + 1).collect()  # one row a class
    if len(found) <= MAX_LOCAL_CUTS:
        cuts = F.broadcast(df.sparkSession.createDataFrame(found, cuts.schema))
    at = F.struct(F.col("__h"), F.col(id_col))
    first = F.col("__eb").isNull() | (F.col("__b") < F.col("__eb")) | ((F.col("__b") == F.col("__eb")) & F.coalesce(at <= F.col("__cut"), F.lit(False)))
    tagged = keyed_join(x, cuts, keys).withColumn(part_col, F.when(first, F.lit("first")).otherwise(F.lit("second")))
    return tagged.drop("__h", "__b", "__eb", "__cut", "__one")


def stratified_take(df: DataFrame, train_count: float, class_col: str = "class", id_col: str = "index", seed: int = DEFAULT_SEED) -> DataFrame:
    """E2. Stratified subsample; ``-1`` keeps everything."""
    if train_count == -1:
        return df
    return split_parts(df, train_count, class_col, id_col, seed, "__p").where(F.col("__p") == "first").drop("__p")


def stratified_split(
    df: DataFrame, clean_count: float, class_col: str | None = "class", id_col: str = "index", seed: int = DEFAULT_SEED
) -> tuple[DataFrame, DataFrame]:
    """E3/E4. Disjoint (clean, meta) parts; ``-1`` gives the whole table twice."""
    if clean_count == -1:
        return df, df
    tagged = split_parts(df, clean_count, class_col, id_col, seed, "__p")
    return (
        tagged.where(F.col("__p") == "first").drop("__p"),
        tagged.where(F.col("__p") == "second").drop("__p"),
    )


def split_report(parts: dict[str, DataFrame], class_col: str = "class") -> DataFrame:
    """E5. Rows per (part, class)."""
    frames = [d.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name)) for name, d in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("part", class_col, "n")


COPY_CHUNK = 100_000  # copies generated per task-sized chunk in E6


def oversample_to_max(spark: SparkSession, df: DataFrame, class_col: str = "class", id_col: str = "index", seed: int = DEFAULT_SEED) -> DataFrame:
    """E6. Top up every class to the largest class size with repeats drawn from it.

    Originals are all kept (``is_copy = false``); ``sample_id`` is unique
    (the id for originals, ``copy-<class>-<j>`` for copies). Copy ``j`` of class
    ``c`` takes the row of rank ``md5(copy-c-j-seed) mod n_c + 1``, joined on
    ``(class, rank)``. Copies are generated without a driver round-trip: each
    class's deficit is cut into chunks of ``COPY_CHUNK`` (a small table),
    the chunks are spread over tasks and exploded there.
    """
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("__nc"))
    # Largest class size over the per-class table (one row per class).
    top = F.max("__nc").over(Window.partitionBy())
    per_class = counts.select(class_col, "__nc", (top - F.col("__nc")).alias("__d")).where(F.col("__d") > 0)
    chunks = per_class.select(class_col, "__nc", "__d",
                              F.explode(F.sequence(F.lit(0), F.ceil(F.col("__d") / F.lit(COPY_CHUNK)).cast("long") - 1)).alias("__c"))
    chunks = chunks.repartition(class_col, "__c")
    copy_j = F.explode(F.sequence(F.col("__c") * F.lit(COPY_CHUNK),
                                  F.least((F.col("__c") + 1) * F.lit(COPY_CHUNK), F.col("__d")) - 1))
    copies = chunks.select(class_col, "__nc", copy_j.alias("__j"))
    copy_id = F.concat_ws("-", F.lit("copy"), F.col(class_col).cast("string"), F.col("__j").cast("string"))
    copies = copies.select(
        class_col,
        (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", copy_id, F.lit(str(seed)))), 1, 12), 16, 10).cast("bigint"), F.col("__nc")) + 1).alias("__rk"),
        copy_id.alias("sample_id"),
    )
    ranked = hashed_rank(df, [class_col], id_col, seed, "__rk")
    base = df.withColumns({"is_copy": F.lit(False), "sample_id": F.col(id_col).cast("string")})  # originals need no rank
    picked = keyed_join(ranked, copies, [class_col, "__rk"]).withColumn("is_copy", F.lit(True)).drop("__rk")
    return base.unionByName(picked)


def round_robin_batches(
    df: DataFrame, batch_size: int, class_col: str = "class", id_col: str = "index", seed: int = DEFAULT_SEED, first_seen: str | None = None
) -> DataFrame:
    """E7. Class-balanced batches: shuffle inside each class, cycle the classes in
    first-seen order (smallest ``first_seen`` value, default ``id_col``), emit full
    batches only. Assumes the classes are already balanced (E6); the cycle stops
    when the largest class runs out, as in the reference.
    Adds ``batch_id`` and ``pos`` (position in the stream).

    The class order, the class count and the largest class come from a per-class table
    (one row per class) joined on the class; nothing reaches the driver."""
    order_col = first_seen or id_col
    per_class = df.groupBy(class_col).agg(F.min(order_col).alias("__first"), F.count(F.lit(1)).alias("__nc"))
    whole = Window.partitionBy()
    per_class = per_class.select(
        class_col,
        (F.row_number().over(Window.orderBy("__first", class_col)) - 1).alias("__cord"),  # one row per class
        F.count(F.lit(1)).over(whole).alias("__classes"), F.max("__nc").over(whole).alias("__most"),
    )
    r = hashed_rank(df, [class_col], id_col, seed, "__rk")
    pos = (F.col("__rk") - 1) * F.col("__classes") + F.col("__cord")
    full = F.floor(F.col("__most") * F.col("__classes") / F.lit(batch_size)) * F.lit(batch_size)
    out = keyed_join(r, per_class, [class_col]).withColumn("pos", pos.cast("bigint")).where(F.col("pos") < full)
    return out.withColumn("batch_id", (F.col("pos") / F.lit(batch_size)).cast("bigint")).drop("__rk", "__cord", "__classes", "__most")


def chunkify(df: DataFrame, n: int, pos_col: str = "pos") -> DataFrame:
    """E8. Item ``i`` goes to chunk ``i % n``."""
    return df.withColumn("chunk", F.pmod(F.col(pos_col), F.lit(n)).cast("int"))


def length_align(df: DataFrame, target: int, pos_col: str = "pos", order_col: str = "index") -> DataFrame:
    """E9. Extend (cyclically) or cut a table to ``target`` rows: output row
    ``i`` is source row ``i mod len``. Each source row is repeated
    ``ceil((target - p)/len)`` times by a per-row explode (fan-out spreads over
    all rows). Adds the output position ``pos_col``."""
    n = df.count()
    if n == 0:
        raise ValueError("cannot align an empty table")
    p = ordered_position(df, order_col, pos_col="__src")
    p = p.where(F.col("__src") < F.lit(target))
    reps = F.ceil((F.lit(target) - F.col("__src")) / F.lit(n)).cast("int")
    out = p.withColumn("__rep", F.explode(F.sequence(F.lit(0), reps - 1)))
    return out.withColumn(pos_col, (F.col("__src") + F.col("__rep") * F.lit(n)).cast("bigint")).drop("__rep", "__src")


def align_target(clean_n: int, meta_n: int, aug_n: int, mode: str = "max") -> int:
    """E9 target length: the largest of the three, or clean size (``no_aug_data``),
    or meta size (``meta_only``)."""
    if mode == "no_aug_data":
        return clean_n
    if mode == "meta_only":
        return meta_n
    return max(clean_n, meta_n, aug_n)


def shuffle_batches(
    df: DataFrame, batch_size: int, id_col: str = "index", shuffle: bool = True, drop_last: bool = False, seed: int = DEFAULT_SEED
) -> DataFrame:
    """E10. Fixed-size batches; seeded shuffle for training, id order for evaluation.
    ``drop_last`` drops the last partial batch (never use it for evaluation)."""
    if shuffle:
        p = hashed_rank(df, [], id_col, seed, "__rk").withColumn("pos", F.col("__rk") - 1).drop("__rk")
    else:
        p = ordered_position(df, id_col, pos_col="pos")
    out = p.withColumn("batch_id", (F.col("pos") / F.lit(batch_size)).cast("bigint"))
    if drop_last:
        n = df.count()
        out = out.where(F.col("pos") < F.lit((n // batch_size) * batch_size))
    return out


def flip_labels(df: DataFrame, p: float, n_classes: int = 2, label_col: str = "class", id_col: str | Column = "index", seed: int = DEFAULT_SEED) -> DataFrame:
    """E11. Replace the label with a different class with probability ``p``.

    Binary: ``1 - y``. Multiclass: ``(y + 1 + h) mod C`` with ``h`` uniform in
    ``0..C-2``. Keeps the original in ``orig_<label>`` and ``is_flipped``.
    """
    u = hash_fraction(id_col, seed)
    flip = u < F.lit(p)
    if n_classes == 2:
        new = F.lit(1) - F.col(label_col)
    else:
        h = F.floor(hash_fraction(id_col, seed + 1) * F.lit(n_classes - 1))
        new = F.pmod(F.col(label_col) + F.lit(1) + h, F.lit(n_classes))
    t = df.schema[label_col].dataType
    return df.withColumns({
        f"orig_{label_col}": F.col(label_col),
        "is_flipped": flip,
        label_col: F.when(flip, new.cast(t)).otherwise(F.col(label_col)),
    })


def pair_loaders(base_batches: DataFrame, meta_batches: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """E12. One pair per step, as many steps as the longer side has batches; the shorter
    side is cycled. Batch ids run from 0. An empty side gives no pairs."""
    sides = [df.agg(F.countDistinct(batch_col)).first()[0] for df in (base_batches, meta_batches)]
    steps = base_batches.sparkSession.range(max(sides) if all(sides) else 0)
    n_base, n_meta = (max(n, 1) for n in sides)
    return steps.select(
        F.col("id").alias("step"), (F.col("id") % F.lit(n_base)).alias("base_batch_id"), (F.col("id") % F.lit(n_meta)).alias("meta_batch_id")
    )


def batch_mix(clean: DataFrame, aug: DataFrame, no_aug_data: bool = False) -> DataFrame:
    """E13. Clean and augmented rows stacked (clean only with ``no_aug_data``)."""
    c = clean.withColumn("source", F.lit("clean"))
    if no_aug_data:
        return c
    return c.unionByName(aug.withColumn("source", F.lit("aug")), allowMissingColumns=True)
