"""Run-log analytics and trial selection.

A run log is ``(experiment, version, metric, wall_time, value, ...)``. All
selection is declarative: ranks over bounded groups, ``max_by``, semi-joins.
Ordering within a (run, tag) uses the skew-safe position helper, because one
run may hold a large share of all rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisesift.operators.ranking import ordered_position
from noisesift.operators.shape import tag_has_all
from noisesift.session import staged

RUN = ("experiment", "version")

# Path markers of the run-log layout.
VERSION_MARKER = "version_"
DEFAULT_MARKER = "DEFAULT_"


def read_run_logs(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """A7. Keep rows whose path contains ``version_``; experiment = 3rd-last path
    part, version = 2nd-last (5th-last when the path contains ``DEFAULT_``)."""
    parts = F.split(F.col(path_col), "/")
    version = F.when(F.col(path_col).contains(DEFAULT_MARKER), F.element_at(parts, -5)).otherwise(F.element_at(parts, -2))
    return paths.where(F.col(path_col).contains(VERSION_MARKER)).withColumns(
        {"experiment": F.element_at(parts, -3), "version": version})


def step_by_time(log: DataFrame, run: Sequence[str] = RUN, tag: str = "metric", time_col: str = "wall_time",
                 tiebreak: str = "event_id", step: str = "step") -> DataFrame:
    """H1. 0-based step of each value within (run, tag) by wall time (a rank, X9).

    Times become microseconds without any time-zone conversion (NTZ stays NTZ), so the
    order is the same on every cluster time zone."""
    kind = log.schema[time_col].dataType.typeName()
    if kind == "timestamp_ntz":
        us = F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col(time_col))
    elif kind == "timestamp":
        us = F.unix_micros(F.col(time_col))
    else:  # float seconds, as in the reference's wall_time
        us = F.col(time_col).cast("double")
    t = log.withColumn("__t", us)
    return ordered_position(t, "__t", [*run, tag], step, tiebreak=[tiebreak]).drop("__t")


def _no_nan(value: str) -> Column:
    return F.nanvl(F.col(value).cast("double"), F.lit(0.0))


def _selected(log: DataFrame, parts: Sequence[str], tag: str) -> Column:
    return tag_has_all(F.col(tag), parts)


def rows_at_best_step(log: DataFrame, parts: Sequence[str] = ("acc", "Test"), run: Sequence[str] = RUN,
                      tag: str = "metric", step: str = "step", value: str = "value") -> DataFrame:
    """H2. Per run: the step with the largest selected-metric value (earliest step on ties),
    then every row of the run at that step. NaN counts as 0."""
    sel = log.where(_selected(log, parts, tag))
    best = sel.groupBy(*run).agg(F.max_by(F.col(step), F.struct(_no_nan(value), -F.col(step))).alias("__best"))
    return log.join(best, list(run)).where(F.col(step) == F.col("__best")).drop("__best")


def run_final_rows(log: DataFrame, parts: Sequence[str] = ("acc", "Test"), run: Sequence[str] = RUN,
                   tag: str = "metric", step: str = "step", value: str = "value", at_step: int = 1) -> DataFrame:
    """H3. Rows at step ``at_step`` whose tag contains ``Test``, each with ``interested`` =
    the run's largest selected-metric value (0 when it has none or NaN)."""
    best = log.where(_selected(log, parts, tag)).groupBy(*run).agg(F.max(value).alias("interested"))
    rows = log.where((F.col(step) == F.lit(at_step)) & F.col(tag).contains("Test"))
    out = rows.join(best, list(run), "left")
    return out.withColumn("interested", F.when(F.col("interested").isNull() | F.isnan("interested"), F.lit(0.0)).otherwise(F.col("interested")))


def best_run(final_rows: DataFrame, group: str = "experiment", version: str = "version", score: str = "interested") -> DataFrame:
    """H4. Per group the run with the strictly largest score; the first run (by version)
    wins ties; NaN counts as 0. Returns that run's rows.

    The final rows (one a run and tag) are written once; the best run is one aggregate over them."""
    rows = staged(final_rows, "final_rows")
    runs = rows.select(group, version, F.coalesce(F.nanvl(F.col(score), F.lit(0.0)), F.lit(0.0)).alias("__s"))
    best = runs.groupBy(group).agg(_best_of("__s", version)["name"].alias(version))
    return rows.join(best, [group, version], "left_semi")


def _best_of(score: str, name: str, *carry: str) -> Column:
    """The row of largest ``score``, ties to the smallest ``name`` (null last), as a struct: one aggregate, partial
    in the map tasks, so a group of any size is spread over many tasks. Rows without a score are not chosen."""
    row = F.struct((F.lit(0.0) - F.col(score)).alias("neg"), F.col(name).isNull().alias("unnamed"), F.col(name).alias("name"), *carry)
    return F.min(F.when(F.col(score).isNotNull(), row))


def metrics_wide(rows: DataFrame, metrics: Sequence[str] | None = None, group: str = "experiment",
                 tag: str = "metric", value: str = "value", step: str = "step") -> DataFrame:
    """H5. One row per group, one column per metric; the value of the largest step wins."""
    g = rows.groupBy(group)
    p = g.pivot(tag, list(metrics)) if metrics is not None else g.pivot(tag)
    return p.agg(F.max_by(value, step))


def chosen_hyper(log: DataFrame, configs: DataFrame, key: str, run: Sequence[str] = RUN, config_col: str = "config",
                 group: str = "experiment") -> DataFrame:
    """H11. Tag each run's group with ``<key>_<value>`` from its config; drop runs lacking the key."""
    c = configs.select(*run, F.col(config_col)[key].alias("__v")).where(F.col("__v").isNotNull())
    j = log.join(c, list(run))
    return j.withColumn(group, F.concat(F.col(group), F.lit(f"_{key}_"), F.col("__v"))).drop("__v")


def halving_survivors(history: DataFrame, grace: int = 5, eta: int = 2, max_t: int = 100,
                      trial: str = "trial", it: str = "iteration", metric: str = "value") -> DataFrame:
    """H9. Successive halving read from a finished history: at rungs grace*eta^k < max_t,
    the trials still alive that reached the rung keep the top ceil(n/eta) by metric.
    Returns ``(rung, trial, value, rank)`` of the kept trials per rung."""
    rungs, r = [], grace
    while r < max_t:
        rungs.append(r)
        r *= eta
    # the rows of all rungs are taken from the history in one pass; a rung then reads what is written
    reached = history.where(F.col(it).isin(rungs) & F.col(trial).isNotNull())
    reached = staged(reached.select(trial, F.col(it).alias("rung"), _no_nan(metric).alias("value")), "rungs")
    alive, kept_all = None, None
    for rung in rungs:
        at = reached.where(F.col("rung") == F.lit(rung)).select(trial, "value", (-F.col("value")).alias("__neg"))
        if alive is not None:
            at = at.join(alive, trial, "left_semi")
        ranked = ordered_position(at, "__neg", [], "__p", "__n", tiebreak=[trial]).withColumn("rank", F.col("__p") + 1)
        kept = ranked.where(F.col("rank") <= F.ceil(F.col("__n") / F.lit(eta))).drop("__n", "__p", "__neg").withColumn("rung", F.lit(rung))
        kept = staged(kept, "rung")  # the next rung reads it twice
        kept_all = kept if kept_all is None else kept_all.unionByName(kept)
        alive = kept.select(trial)
    return kept_all.select("rung", trial, "value", "rank")


def best_trial(history: DataFrame, trial: str = "trial", it: str = "iteration", metric: str = "value",
               group: Sequence[str] = ()) -> DataFrame:
    """H10. Per group: the trial whose best value over all iterations is largest, with that
    value and the iteration where it occurred (earliest on ties; ties between trials by trial).
    NaN counts as 0."""
    per = history.groupBy(*group, trial).agg(
        F.max(_no_nan(metric)).alias("best_value"),
        F.max_by(F.col(it), F.struct(_no_nan(metric), -F.col(it))).alias("best_iteration"),
    )
    best = per.groupBy(*group).agg(_best_of("best_value", trial, "best_value", "best_iteration").alias("__b")).where("__b IS NOT NULL")
    return best.select(*group, F.col("__b.name").alias(trial), "__b.best_value", "__b.best_iteration")


# -------------------------------------------------------------- H8 plateau
def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plateau_events(history: DataFrame, init: float, mode: str = "min", factor: float = 0.1, patience: int = 10,
                   min_hyper: float = 0.0, threshold: float = 1e-4, threshold_mode: str = "rel", cooldown: int = 0,
                   eps: float = 1e-8, trial: str = "trial", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """H8. Plateau detector folded over each trial's metric history in epoch order:
    best with relative/absolute threshold, bad-epoch count, patience, cooldown, and the
    multiplicative reduction of a hyper-parameter value floored at ``min_hyper``
    (X7: the value is reduced, not the epoch). One row per (trial, epoch); a missing or NaN
    metric is never better.

    The fold runs in the JVM (``aggregate`` over the sorted history with a struct as state); a
    trial's history is one row per epoch, so an array is bounded by the epoch count."""
    if factor >= 1.0:
        raise ValueError("factor must be < 1")
    worst = float("inf") if mode == "min" else float("-inf")
    event = "struct<epoch: bigint, metric: double, hyper: double, best: double, bad_epochs: int, reduced: boolean>"

    def better(cur: Column, best: Column) -> Column:
        if threshold_mode == "rel":
            bar = best * (1 - threshold if mode == "min" else 1 + threshold)
        else:
            bar = best - threshold if mode == "min" else best + threshold
        return cur.isNotNull() & ~F.isnan(cur) & (cur < bar if mode == "min" else cur > bar)

    def state(best: Column, bad: Column, cool: Column, hyper: Column) -> Column:
        return F.struct(best.alias("best"), bad.cast("int").alias("bad"), cool.cast("int").alias("cool"), hyper.cast("double").alias("hyper"))

    def step(acc: Column, row: Column) -> Column:
        seen = F.struct(better(row["metric"], acc["s"]["best"]).alias("better"), acc["s"].alias("s"))
        rated = _let(seen, lambda v: state(
            F.when(v["better"], row["metric"]).otherwise(v["s"]["best"]),
            F.when(v["better"] | (v["s"]["cool"] > 0), 0).otherwise(v["s"]["bad"] + 1),
            F.greatest(v["s"]["cool"] - 1, F.lit(0)), v["s"]["hyper"]))
        over = _let(rated, lambda v: F.struct(v.alias("s"), (v["bad"] > patience).alias("over"), F.greatest(v["hyper"] * factor, F.lit(min_hyper)).alias("new")))
        cut = _let(over, lambda v: F.struct(v["s"].alias("s"), v["over"].alias("over"), v["new"].alias("new"), (v["over"] & (v["s"]["hyper"] - v["new"] > eps)).alias("cut")))

        def close(v: Column) -> Column:
            done = state(v["s"]["best"], F.when(v["over"], 0).otherwise(v["s"]["bad"]), F.when(v["over"], cooldown).otherwise(v["s"]["cool"]), F.when(v["cut"], v["new"]).otherwise(v["s"]["hyper"]))
            return _let(done, lambda d: F.struct(d.alias("s"), F.array_append(acc["out"], F.struct(
                row["epoch"].alias("epoch"), row["metric"].alias("metric"), d["hyper"].alias("hyper"), d["best"].alias("best"), d["bad"].alias("bad_epochs"), v["cut"].alias("reduced"))).alias("out")))

        return _let(cut, close)

    h = history.select(F.col(trial).cast("string").alias("trial"), F.struct(F.col(epoch).cast("long").alias("epoch"), F.col(metric).cast("double").alias("metric")).alias("row"))
    start = F.struct(state(F.lit(worst), F.lit(0), F.lit(0), F.lit(init)).alias("s"), F.array().cast(f"array<{event}>").alias("out"))
    runs = h.groupBy("trial").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return runs.select("trial", F.explode(F.aggregate("rows", start, step)["out"]).alias("e")).select("trial", "e.*")


# -------------------------------------------------------------- J17 sweep
TRIALS_PER_PASS = 100_000  # their bounds are on the driver


def sweep(trials: DataFrame, aug: DataFrame, label: str = "label", score: str = "readability") -> DataFrame:
    """J17. Evaluate many curation settings in one pass.

    ``trials``: ``(trial_id, methods array<string>, lo, hi)``; ``methods`` null = all (also rows
    without a method). Rows are added up per method and elementary interval: the trials'
    bounds cut the scores into points and gaps, found by binary search in the JVM. A running sum over
    the intervals meets every trial at its two bounds, so a trial is a difference of two sums, whatever
    the number of rows or of distinct scores. Per trial: rows kept, rows of classes 0 and 1, mean score
    (``sweep_by_class`` has the rows of every class). Trials that keep no row are not in the result.
    """
    sums = {
        "rows_kept": F.count(F.lit(1)),
        "n_class0": F.count(F.when(F.col("label") == 0, 1)),
        "n_class1": F.count(F.when(F.col("label") == 1, 1)),
        "total": F.sum("score"),
    }
    found = _sweep_sums(trials, aug, label, score, sums, False)
    return found.select("trial_id", "rows_kept", "n_class0", "n_class1", (F.col("total") / F.col("rows_kept")).alias("mean_score"))


def sweep_by_class(trials: DataFrame, aug: DataFrame, label: str = "label", score: str = "readability") -> DataFrame:
    """J17 for any number of classes: rows kept per (trial, class)."""
    return _sweep_sums(trials, aug, label, score, {"rows_kept": F.count(F.lit(1))}, True).withColumnRenamed("label", label)


def _sweep_sums(trials: DataFrame, aug: DataFrame, label: str, score: str, sums: dict[str, Column], by_class: bool) -> DataFrame:
    n = trials.count()
    if n > TRIALS_PER_PASS:
        parts = -(-n // TRIALS_PER_PASS)
        own = [trials.where(F.pmod(F.xxhash64("trial_id"), F.lit(parts)) == k) for k in range(parts)]
        return reduce(DataFrame.unionByName, [_sweep_part(t, aug, label, score, sums, by_class) for t in own])
    return _sweep_part(trials, aug, label, score, sums, by_class)


def _sweep_part(trials: DataFrame, aug: DataFrame, label: str, score: str, sums: dict[str, Column], by_class: bool) -> DataFrame:
    from pyspark.ml.feature import Bucketizer

    inf = float("inf")
    value = F.col(score).cast("double") + F.lit(0.0)  # no negative zero
    lo, hi = (F.col(c).cast("double") + F.lit(0.0) for c in ("lo", "hi"))
    cuts = sorted({r[0] for r in trials.select(F.explode(F.array(lo, hi))).distinct().collect() if r[0] is not None and abs(r[0]) < inf}) or [0.0]

    def place(df: DataFrame, x: Column, out: str) -> DataFrame:
        """Bounds up to x plus bounds below x: odd at a bound, even in a gap."""
        up = Bucketizer(splits=[-inf, *cuts, inf], inputCol="__x", outputCol="__up", handleInvalid="keep")
        down = Bucketizer(splits=[-inf, *[-c + 0.0 for c in reversed(cuts)], inf], inputCol="__y", outputCol="__down", handleInvalid="keep")
        return down.transform(up.transform(df.withColumns({"__x": x, "__y": -x + F.lit(0.0)}))).withColumn(
            out, (F.col("__up") + F.lit(len(cuts)) - F.col("__down")).cast("int")).drop("__x", "__y", "__up", "__down")

    group = ["to", *(["label"] if by_class else [])]
    rows = aug.select("aug_method", F.col(label).alias("label"), value.alias("score")).where(F.abs("score") < inf)  # no null, NaN or infinity lies inside
    cells = place(rows, F.col("score"), "at").groupBy("aug_method", "at", *group[1:]).agg(*[c.alias(k) for k, c in sums.items()])
    to = F.array_compact(F.array(F.concat(F.lit("="), "aug_method"), F.lit("*")))
    cells = cells.select(F.explode(to).alias("to"), "at", *group[1:], *sums, F.lit(None).cast(trials.schema["trial_id"].dataType).alias("trial_id"), F.lit(0).alias("sign"))

    wanted = F.explode(F.coalesce(F.transform(F.filter("methods", lambda m: m.isNotNull()), lambda m: F.concat(F.lit("="), m)), F.array(F.lit("*"))))
    asked = trials.where(lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo)).select("trial_id", wanted.alias("to"), lo.alias("lo"), hi.alias("hi"))
    asked = place(place(asked, F.when(F.abs("lo") < inf, F.col("lo")).otherwise(0.0), "a"), F.when(F.abs("hi") < inf, F.col("hi")).otherwise(0.0), "b")
    first = F.when(F.col("lo") == -inf, F.lit(-1)).when(F.col("lo") == inf, F.lit(2 * len(cuts) + 1)).otherwise(F.col("a"))  # sums up to and with lo go
    last = F.when(F.col("hi") == -inf, F.lit(-1)).when(F.abs("hi") < inf, F.col("b") - 1).otherwise(F.lit(2 * len(cuts) + 1))  # those below hi stay
    ends = F.explode(F.array(F.struct(last.alias("at"), F.lit(1).alias("sign")), F.struct(first.alias("at"), F.lit(-1).alias("sign"))))
    asked = asked.where(last > first).select("trial_id", "to", ends.alias("end")).select("trial_id", "to", "end.*")
    if by_class:
        known = cells.select(F.col("to").alias("__to"), "label").distinct()
        asked = asked.join(known, F.col("to") == F.col("__to")).drop("__to")
    asked = asked.select("to", "at", *group[1:], *[F.lit(0).cast(cells.schema[k].dataType).alias(k) for k in sums], "trial_id", "sign")
    # rows of a window: the intervals of a method and the ends of its trials, not the table's rows
    run = Window.partitionBy(*group).orderBy("at", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    run_sums = cells.unionByName(asked).select("trial_id", "sign", *group[1:], *[F.sum(k).over(run).alias(k) for k in sums]).where("sign <> 0")
    out = run_sums.groupBy("trial_id", *group[1:]).agg(*[F.sum(F.col("sign") * F.coalesce(k, F.lit(0))).alias(k) for k in sums])
    return out.where("rows_kept > 0")
