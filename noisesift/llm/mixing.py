"""Mixing sources to target weights along a time-varying curriculum, with SQL functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share the words of the whole table; a target stops at ``CAP`` times its source's
size and the excess is reshared by weight until none is above. With the sources
sorted by ``CAP * size / weight`` the fair level is found in one ordered pass.

Choice: a source is passed as often as its target holds it whole; of the rest,
documents in hash order are taken while they fit; of those left, the ones no larger than what
is missing, again in hash order while they fit, and so on until none fits; then the one document
whose size comes closest to what is missing, if that brings the source nearer. Whole documents only.

Curriculum: source s has the schedule ``weight(t) = target * (1 + slope * (2t - 1))``
over training time 0..1. The integral of the schedule is its cumulative demand;
a copy whose words lie at share u of what the source gives is trained at the time
t at which the demand reaches u. Documents are range-sorted by that position.

Scale: the running sums inside a source are taken per (source, 1/4096 of the hash
range) and offset by a small table of range sums, so a hot source is split 4096
ways; only slim rows (id, source, size, hash) are shuffled.

Defined results: null text counts as empty and has size 0; documents of size 0
are never taken; a null source is a source of its own; repeated rows are mixed
once each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisesift.llm.common import query, staged, table

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
CAP = 3
SALTS = 256
#: repeated keys that a join may broadcast
BROADCAST_KEYS = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.expr(rf"regexp_count({text}, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: ordinal, source_size, target. ``sizes``: source, size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source, not a document
    per = per.withColumn("ordinal", F.row_number().over(everything) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("room", cap * F.col("source_size").cast("double"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("room") / F.col("weight"), "ordinal")
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    per = per.withColumn("used", F.sum("room").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("open", F.sum("weight").over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.col("total") - F.coalesce("used", F.lit(0.0))) / F.col("open")
    per = per.withColumn("level", F.when(level <= F.col("room") / F.col("weight"), level)).withColumn("level", F.max("level").over(whole))
    target = F.least("room", F.coalesce(F.col("level") * F.col("weight"), F.col("room")))
    return per.select("source", "ordinal", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: size, source_size, target, copies, taken and the positions of its copies."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(f"`{text_col}`").alias("size"))
    slim = staged(slim.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("h", 1, 3)), "sizes")
    sources = staged(source_targets(slim, weights, cap), "sources")
    parts = slim.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    in_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(in_source), F.lit(0)).alias("before"))
    parts = parts.join(sources, parts["source"].eqNullSafe(sources["source"])).drop(sources["source"])

    in_part = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = slim.withColumn("ran", F.sum("size").over(in_part))
    both = ran.alias("r").join(parts.alias("p"), F.expr("r.source <=> p.source AND r.part = p.part"))
    both = both.select("r.doc_id", "r.source", "r.size", "r.h", "r.part", "ordinal", "source_size", "target", (F.col("ran") + F.col("before")).alias("ran"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    both = both.withColumn("passes", passes)
    rest = F.when(F.col("passes") < cap, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)
    both = both.withColumn("rest", rest).withColumn("extra", (F.col("ran") <= F.col("rest")) & (F.col("size") > 0))
    both = staged(both, "mix")

    # what the prefix leaves open in each source is filled from the documents that fit
    reached = both.groupBy("source").agg(F.max(F.when(F.col("extra"), F.col("ran"))).alias("reached"), F.max("rest").alias("rest"))
    gap = staged(reached.select(F.col("source").alias("gap_source"), (F.col("rest") - F.coalesce("reached", F.lit(0))).alias("gap")), "gaps")
    left = staged(both.where("NOT extra AND size > 0").select("doc_id", "source", "size", "h", "part", "ran"), "left")
    more, gap = _filled(left, gap)
    both = both.join(more, F.expr("source <=> more_source AND ran = more_ran AND size > 0"), "left")
    both = both.withColumn("extra", F.col("extra") | F.col("more_ran").isNotNull()).drop("more_source", "more_ran")
    left = left.join(more, F.expr("source <=> more_source AND ran = more_ran"), "left_anti").join(gap, F.expr("source <=> gap_source"))
    left = left.withColumn("miss", F.abs(F.col("size") - F.col("gap"))).where("miss < gap")
    best = left.groupBy("gap_source").agg(F.min(F.struct("miss", "h", "doc_id", "size", "ran")).alias("best"))
    best = best.select("gap_source", F.col("best.doc_id").alias("best_id"), F.col("best.ran").alias("best_ran"))
    out = both.join(best, F.expr("source <=> gap_source"), "left")
    chosen = F.col("doc_id").eqNullSafe(F.col("best_id")) & F.col("ran").eqNullSafe(F.col("best_ran")) & ~F.col("extra") & (F.col("size") > 0)
    copies = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("extra") | F.coalesce(chosen, F.lit(False)), 1).otherwise(0)).otherwise(0)
    out = out.withColumn("copies", copies.cast("int"))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("ordinal") % len(slopes) + 1).cast("int"))
    out = out.withColumn("slope", slope).withColumn("middle", F.col("ran") - F.col("size") / 2)
    position = (
        "transform(if(copies > 0, sequence(0, copies - 1), cast(array() as array<int>)), c -> least(1D, (c * source_size + middle) / target))"
    )
    out = out.withColumn("shares", F.expr(position))
    # demand(t) = t + slope * (t * t - t); its inverse at u
    out = out.withColumn("positions", F.expr("transform(shares, u -> 2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)))"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
        F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1).alias("position"), "positions",
    )


def _filled(left: DataFrame, gap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(more_source, more_ran)`` taken to fill the gaps, and the gaps still open.

    ``ran``, a running sum of sizes above 0, names a row within its source. A round takes, in hash order, while they fit,
    documents no larger than their source's gap; each source with such a document takes one at least. Only the first ranges of
    a source, whose sizes reach the gap, are sorted.
    """
    took = []
    while True:
        fits = left.join(F.broadcast(gap), F.expr("source <=> gap_source")).where("size <= gap")  # a row a source
        for t in took:
            fits = fits.join(t.select("more_source", "more_ran"), F.expr("source <=> more_source AND ran = more_ran"), "left_anti")
        sums = fits.groupBy("gap_source", "part").agg(F.sum("size").alias("sum"), F.first("gap").alias("gap"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("gap_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = sums.withColumn("before", before).where("before < gap").select(F.col("gap_source").alias("s"), F.col("part").alias("p"), "before")
        in_part = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "ran").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = fits.join(first, F.expr("source <=> s AND part = p")).withColumn("upto", F.sum("size").over(in_part) + F.col("before"))
        new = staged(rows.where("upto <= gap").select(F.col("source").alias("more_source"), F.col("ran").alias("more_ran"), "size"), "more")
        filled = new.groupBy(F.col("more_source").alias("s")).agg(F.sum("size").alias("filled"))
        took.append(new)
        if new.isEmpty():
            break
        gap = staged(gap.join(filled, F.expr("gap_source <=> s"), "left").select("gap_source", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")), "gaps")
    out = took[0]
    for t in took[1:]:
        out = out.unionByName(t)
    return out.select("more_source", "more_ran"), gap


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mixed corpus: rows of ``docs``, once a copy, range-sorted by training position; same columns.

    Rows are matched to their plan by id, source and size; on both sides the rows that
    repeat these are numbered, and matched by their number too.
    """
    names = docs.columns
    plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    taken = [f"_{k}" for k in range(len(names))]  # the rows' own columns go under numbers, so no name can clash
    docs = docs.toDF(*taken)
    id_col, text_col, source_col = (taken[names.index(c)] for c in (id_col, text_col, source_col))
    key = ["_id", "_src", "_size"]
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_size"), F.col("positions").alias("_at"))
    repeated = staged(plan.where("_size > 0").groupBy(*key).count().where("count > 1").select(*key), "repeated")
    several = repeated.count()
    plan = plan.where("size(_at) > 0")
    rows = docs.withColumn("_id", F.col(f"`{id_col}`")).withColumn("_src", F.col(f"`{source_col}`")).withColumn("_size", n_words(f"`{text_col}`"))
    if several:
        few = F.broadcast(repeated) if several <= BROADCAST_KEYS else repeated
        again = _matched(_numbered(_matched(rows, few, key, "left_semi"), key), _numbered(_matched(plan, few, key, "left_semi"), key), [*key, "_number"])
        rows, plan = _matched(rows, few, key, "left_anti"), _matched(plan, few, key, "left_anti")
    joined = _matched(rows, plan, key).select(*taken, "_at")
    if several:
        joined = joined.unionByName(again.select(*taken, "_at"))
    laid = joined.withColumn("_position", F.explode("_at"))
    return laid.repartitionByRange("_position").sortWithinPartitions("_position").select(*taken).toDF(*names)


def _matched(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null meeting null."""
    right = right.select(*[F.col(c).alias(f"_r{c}") if c in key else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    out = left.join(right, on, how)
    return out if how != "inner" else out.drop(*[f"_r{c}" for c in key])


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows numbered from 0 within their key; a key is numbered in ``SALTS`` parts, laid end to end."""
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered").withColumn("_salt", F.pmod("_row", F.lit(SALTS)))
    parts = rows.groupBy(*key, "_salt").count()
    before = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    in_part = Window.partitionBy(*key, "_salt").orderBy("_row")
    out = _matched(rows.withColumn("_number", F.row_number().over(in_part)), parts, [*key, "_salt"])
    return out.withColumn("_number", F.col("_number") + F.col("_before")).drop("_row", "_salt", "_before")


@query("op10_curriculum_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.drop("source", "positions").orderBy(F.col("position").asc_nulls_last(), "doc_id")
