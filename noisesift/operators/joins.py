"""Joins (D).

Equi-joins are left to Catalyst + AQE (broadcast when the measured side is
small, sort-merge otherwise, skew splitting for hot keys). Explicit
``broadcast`` is used only where the small side has a bound known before the
join (a bank of K slots per class; a grid whose size was computed first).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.operators.ranking import ordered_position
from noisesift.session import scratch_dir, staged

# Config keys skipped when comparing planned and finished trials.
UNINTERESTED_KEYS = ("gpus_per_trial", "version_no", "path")

# Largest bank (rows) or grid lookup that is broadcast without a further check.
BROADCAST_ROW_LIMIT = 5_000_000


def attach_label(aug: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """D1. Left join ``aug.origin = train.index``; unmatched label is null."""
    t = train.select(F.col("index").alias("origin"), F.col(label).alias(label))
    return aug.drop(label).join(t, "origin", "left") if label in aug.columns else aug.join(t, "origin", "left")


def pair_sides(side1: DataFrame, side2: DataFrame, keys: Sequence[str] = ("aug_method", "origin")) -> DataFrame:
    """D2. Inner join of the two augmented sides on ``(aug_method, origin)``."""
    return side1.join(side2, list(keys), "inner")


def align(clean: DataFrame, aug: DataFrame) -> DataFrame:
    """D3. One row per augmented row with its clean row; both sides kept whole as structs.

    Output: ``raw struct<clean columns>``, ``aug struct<aug columns>``.
    """
    c = clean.select(F.col("index").alias("__k"), F.struct(*[F.col(x) for x in clean.columns]).alias("raw"))
    a = aug.select(F.col("origin").alias("__k"), F.struct(*[F.col(x) for x in aug.columns]).alias("aug"))
    return c.join(a, "__k").drop("__k")


def flatten_sides(df: DataFrame, sides: Sequence[str] = ("raw", "aug")) -> DataFrame:
    """B4 companion of D3: ``raw.x -> x_raw``, ``aug.x -> x_aug``."""
    cols: list[Column] = []
    for s in sides:
        for f in df.schema[s].dataType.fieldNames():
            cols.append(F.col(f"{s}.{f}").alias(f"{f}_{s}"))
    rest = [F.col(c) for c in df.columns if c not in sides]
    return df.select(*rest, *cols)


def keep_train_origins(aug: DataFrame, clean: DataFrame) -> DataFrame:
    """D4. Left semi join: augmented rows whose origin is a clean-part index."""
    return aug.join(clean.select(F.col("index").alias("origin")), "origin", "left_semi")


def config_signature(config: Column, keys: Sequence[str]) -> Column:
    """Canonical string of the given keys of a config map (null when a key is missing)."""
    parts = [F.concat(F.lit(k + "="), config[k]) for k in sorted(keys)]
    return F.concat(*[x for p in parts for x in (p, F.lit("\u0001"))]) if parts else F.lit("")


def planned_keys(keys: Sequence[str], ignore: Sequence[str] = UNINTERESTED_KEYS) -> list[str]:
    return [k for k in keys if not any(s in k for s in ignore)]


def skip_finished(
    planned: DataFrame,
    finished: DataFrame,
    keys: Sequence[str] | None = None,
    existing_runs: int = 0,
    ignore: Sequence[str] = UNINTERESTED_KEYS,
    config_col: str = "config",
    version_col: str = "version_no",
) -> DataFrame:
    """D5. Bag anti-join of planned trials against finished runs.

    A planned trial is finished when every kept key that it has (of ``keys``, or all) stands in a
    finished config with the same value (null equals null); that config may hold more keys. Each finished config
    cancels at most one trial, the earliest by ``version_col``; ties of versions are broken by the config.
    Trials with different key sets are taken the largest key set first, so that a general trial does not use up
    the run that only a specific one fits. Surviving versions shift by ``existing_runs``.

    The key sets (their number is that of distinct grids, not of trials) are found first; for each one
    the finished configs are cut to those keys and met by signature. With one key set the finished side is a count
    per signature (map-side partial aggregate); only planned rows whose signature is finished are ranked, by the
    skew-safe position helper. With several, each set's planned and finished rows are paired by rank and the used
    configs leave, one written table a set.
    """
    def kept_key(k: Column) -> Column:
        named = k.isin(*keys) if keys is not None else F.lit(True)
        return reduce(lambda a, s: a & ~F.contains(k, F.lit(s)), ignore, named)

    own = F.map_filter(config_col, lambda k, v: kept_key(k))
    trials = planned.withColumn("__own", own).withColumn("__set", F.array_sort(F.map_keys("__own")))
    sets = [r[0] for r in trials.select("__set").where("__set IS NOT NULL").distinct().collect()]
    sets.sort(key=lambda ks: (-len(ks), ks))
    value = lambda c, k: F.concat(F.lit(k + "="), F.coalesce(F.concat(F.lit("v"), c[k]), F.lit("n")), F.lit("\u0001"))

    def signature(c: Column, ks: Sequence[str]) -> Column:
        return F.concat(F.lit(""), *[value(c, k) for k in ks])

    def holds(ks: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.map_contains_key(config_col, F.lit(k)) for k in ks], F.col(config_col).isNotNull())

    def ranked(df: DataFrame, order: str) -> DataFrame:
        tie = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config_col))))
        return ordered_position(df.withColumn("__tie", tie), order, ["__sig"], "__pos", tiebreak=["__tie"]).drop("__tie")

    left, kept = finished, [trials.where("__set IS NULL")]  # a trial without a config is never finished
    for i, ks in enumerate(sets):
        mine = (trials.where(F.col("__set") == F.array(*[F.lit(k) for k in ks]).cast("array<string>")) if len(sets) > 1 else trials.where("__set IS NOT NULL")).withColumn("__sig", signature(F.col(config_col), ks))
        fits = left.where(holds(ks)).withColumn("__sig", signature(F.col(config_col), ks))
        done = fits.groupBy("__sig").agg(F.count(F.lit(1)).alias("__done"))
        met = mine.join(done, "__sig", "left")
        rows = ranked(staged(met.where("__done IS NOT NULL"), "met"), version_col).where(F.col("__pos") >= F.col("__done"))
        kept += [met.where("__done IS NULL"), rows.drop("__pos")]
        if i + 1 < len(sets):
            used = mine.groupBy("__sig").agg(F.count(F.lit(1)).alias("__n"))
            numbered = ranked(fits.withColumn("__any", F.xxhash64("__sig", F.to_json(config_col))), "__any").drop("__any")
            rest = numbered.join(used, "__sig", "left").where(F.col("__pos") >= F.coalesce("__n", F.lit(0))).select(finished.columns)
            rest = rest.unionByName(left.where(~F.coalesce(holds(ks), F.lit(False))).select(finished.columns))
            path = scratch_dir(planned.sparkSession, "finished")
            rest.write.parquet(path)
            left = planned.sparkSession.read.schema(rest.schema).parquet(path)
    out = reduce(DataFrame.unionByName, [k.select(planned.columns) for k in kept])
    return out.withColumn(version_col, F.col(version_col) + F.lit(existing_runs))


def expand_grid(spark: SparkSession, lists: DataFrame, order: Sequence[str], base: dict[str, str] | None = None) -> DataFrame:
    """D6. Cartesian product of per-parameter value lists, without a cross join.

    ``lists``: rows ``(param string, value string)`` and, if the lists have an order,
    ``pos``: values are then taken in that order and repeated ones kept; without it
    they are taken distinct and sorted. The product size is computed first from the
    per-parameter counts; trial ``i`` (``version_no``, product order, last
    parameter fastest) is decoded from ``spark.range`` by mixed radix, and each
    digit is looked up by an equi-join on ``(param, pos)``.
    ``base`` is the general config merged under every trial (grid values win).
    """
    if "pos" in lists.columns:
        vals = ordered_rank_text(lists.select("param", "value", "pos"), "pos")
    else:
        vals = ordered_rank_text(lists.select("param", "value").distinct())
    sizes = dict(vals.groupBy("param").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per parameter
    total = 1
    for p in order:
        total *= int(sizes.get(p, 0))
    strides, s = {}, 1
    for p in reversed(order):
        strides[p] = s
        s *= int(sizes.get(p, 0)) or 1
    ids = spark.range(total).withColumnRenamed("id", "version_no")
    lookup = vals if sum(sizes.values()) > BROADCAST_ROW_LIMIT else F.broadcast(vals)
    out = ids
    for p in order:
        pos = ((F.col("version_no") / F.lit(strides[p])).cast("long") % F.lit(int(sizes[p])))
        lk = lookup.where(F.col("param") == p).select(F.col("pos").alias(f"__pos_{p}"), F.col("value").alias(p))
        out = out.withColumn(f"__pos_{p}", pos).join(lk, f"__pos_{p}").drop(f"__pos_{p}")
    entries = []
    for k, v in (base or {}).items():
        if k not in order:
            entries += [F.lit(k), F.lit(v)]
    for p in order:
        entries += [F.lit(p), F.col(p)]
    return out.withColumn("config", F.create_map(*entries))


def ordered_rank_text(vals: DataFrame, by: str = "value") -> DataFrame:
    """0-based position of each value inside its parameter, by ``by`` (lists are small)."""
    from pyspark.sql import Window

    return vals.withColumn("pos", F.row_number().over(Window.partitionBy("param").orderBy(by)) - 1)


def zip_positional(tables: dict[str, DataFrame], pos_col: str = "pos") -> DataFrame:
    """D7. Join tables that carry the same 0-based position column; columns get ``_<name>``."""
    frames = []
    for name, df in tables.items():
        frames.append(df.select(pos_col, *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != pos_col]))
    return reduce(lambda a, b: a.join(b, pos_col), frames)


BANK_COLLECT_CELLS = 50_000_000  # largest bank shipped as one broadcast variable


def score_against_bank(queries: DataFrame, bank: DataFrame, vec: str = "vec", key: str = "class",
                       method: str = "auto") -> DataFrame:
    """D8. For each query row, the dots with every bank vector of its class.

    ``bank``: ``(class, slot, vec, score)``, at most K slots per class (a fixed
    bound). Adds ``bank_dots array<double>`` ordered by slot. ``builtin``: each
    class's bank gathered into one array, broadcast-joined and dotted with
    higher-order functions (small banks). ``arrow``: a small bank as one broadcast
    variable, each Arrow batch of queries scored per class by one matrix
    product. ``auto``: the bank in broadcast blocks of bounded size (``tiles.score_blocks``).
    """
    if method == "auto":
        from noisesift.operators.tiles import score_blocks

        return score_blocks(queries, bank, vec, key)
    if method == "arrow":
        return _score_against_bank_arrow(queries, bank, vec, key)
    n_bank = bank.count()  # bounded by K x classes; checked before it is broadcast
    per_class = bank.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", F.col(vec).alias("v")))).alias("__bank"))
    j = queries.join(F.broadcast(per_class) if n_bank <= BROADCAST_ROW_LIMIT else per_class, key, "left")
    dots = F.transform(
        F.coalesce(F.col("__bank"), F.array().cast(per_class.schema["__bank"].dataType)),
        lambda s: F.aggregate(F.zip_with(F.col(vec), s["v"], lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b),
    )
    return j.withColumn("bank_dots", dots).drop("__bank")


def _score_against_bank_arrow(queries: DataFrame, bank: DataFrame, vec: str, key: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    cells = bank.select(F.size(vec).alias("d")).agg(F.sum("d")).first()[0] or 0
    if cells > BANK_COLLECT_CELLS:
        return score_against_bank(queries, bank, vec, key, method="auto")
    rows = bank.select(key, "slot", vec).collect()  # bounded by the check above
    banks: dict = {}
    for r in sorted(rows, key=lambda r: (r[key], r["slot"])):
        banks.setdefault(r[key], []).append(r[vec])
    bc = queries.sparkSession.sparkContext.broadcast({c: np.asarray(v, dtype=float) for c, v in banks.items()})
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    out_schema = StructType([*queries.schema.fields, StructField("bank_dots", ArrayType(DoubleType()))])

    def score(batches):
        b = bc.value
        for pdf in batches:
            dots = np.empty(len(pdf), dtype=object)
            dots[:] = [np.zeros(0)] * len(pdf)  # a class without a bank, or null
            for c, at in pdf.groupby(key).indices.items():
                bk = b.get(c)
                if bk is not None:
                    found = np.stack(pdf[vec].to_numpy()[at]) @ bk.T
                    dots[at] = list(found) if found.ndim == 1 else np.array([*found, None], dtype=object)[:-1]
            yield pdf.assign(bank_dots=dots)

    return queries.mapInPandas(score, out_schema)


def batch_partners(df: DataFrame, id_col: str, batch_col: str, payload: Sequence[str], max_batch: int = 4096) -> DataFrame:
    """D9 (re-aimed). Every row gets the other members of its batch as arrays of about ``max_batch``.

    Pairs are never emitted as rows. A batch of up to ``max_batch`` rows gives each row one array;
    a larger one is cut into tiles, and a row comes once per tile with that tile's members, so
    no array holds the batch. Ids are unique in a batch; rows without a batch have no partners and are left out.
    """
    from noisesift.operators.tiles import tiled

    cut = tiled(df.where(F.col(batch_col).isNotNull()), batch_col, max_batch)
    members = cut.groupBy(F.col(batch_col).alias("__mb"), F.col("__tile").alias("__mt")).agg(
        F.collect_list(F.struct(F.col(id_col).alias("pid"), *[F.col(c) for c in payload])).alias("__m"))
    each = cut.withColumn("__tile", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    j = each.join(members, (F.col(batch_col) == F.col("__mb")) & (F.col("__tile") == F.col("__mt")))
    return j.withColumn("partners", F.filter("__m", lambda m: m["pid"] != F.col(id_col))).drop("__m", "__mb", "__mt", "__row", "__tile", "__tiles")


def pair_sides_sampled(side1: DataFrame, side2: DataFrame, n: int, id1: str, id2: str,
                       keys: Sequence[str] = ("aug_method", "origin"), seed: int = 42) -> DataFrame:
    """D2 + E1 fused for scale: at most ``n`` distinct pairs per key, without forming all
    ``n1 x n2`` pairs of a key first.

    Rows of each side are ranked inside the key (skew-safe); per key the pair index
    space ``[0, n1*n2)`` is sampled systematically, ``idx_k = floor((k + u) N / m)``
    for ``k < m = min(n, N)`` with ``u`` a seeded hash fraction of the key (every pair
    has inclusion probability ``m / N``); ``idx`` decodes to ranks
    ``(idx div n2 + 1, idx mod n2 + 1)`` fetched by equi-joins.
    """
    from noisesift.operators.ranking import hash_fraction, hashed_rank

    keys = list(keys)
    r1 = hashed_rank(side1, keys, id1, seed, "__i", "__n1")
    r2 = hashed_rank(side2, keys, id2, seed + 1, "__j", "__n2")
    c1 = r1.groupBy(*keys).agg(F.max("__n1").alias("__n1"))
    c2 = r2.groupBy(*keys).agg(F.max("__n2").alias("__n2"))
    per_key = c1.join(c2, keys).withColumn("__N", F.col("__n1") * F.col("__n2")) \
        .withColumn("__m", F.least(F.col("__N"), F.lit(n)))
    u = hash_fraction(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys]), seed)
    picks = per_key.select(*keys, "__n2", "__N", "__m", u.alias("__u"),
                           F.explode(F.sequence(F.lit(0), F.col("__m") - 1)).alias("__k"))
    idx = F.floor((F.col("__k") + F.col("__u")) * F.col("__N") / F.col("__m")).cast("bigint")
    picks = picks.select(*keys, (F.floor(idx / F.col("__n2")) + 1).cast("bigint").alias("__i"),
                         (F.pmod(idx, F.col("__n2")) + 1).cast("bigint").alias("__j"))
    out = picks.join(r1.drop("__n1"), [*keys, "__i"]).join(r2.drop("__n2"), [*keys, "__j"])
    return out.drop("__i", "__j")
