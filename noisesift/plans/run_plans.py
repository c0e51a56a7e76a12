"""Queries for run-log analytics (A7, H1-H5, H8-H11) and the curation sweep."""

from __future__ import annotations

import itertools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import with_views
from noisesift.operators import joins, runs
from noisesift.plans.registry import register

STEP_SQL = """
, s AS (SELECT *, row_number() OVER (PARTITION BY experiment, version, metric ORDER BY wall_time, event_id) - 1 AS step FROM run_log)"""
LOG = with_views("run_log") + STEP_SQL


def _log(spark: SparkSession, d: str):
    return runs.step_by_time(fixtures.run_log(spark, d))


@register("h1_step_by_time", LOG + " SELECT experiment, version, metric, event_id, step FROM s")
def h1_step_by_time(spark: SparkSession, d: str):
    return _log(spark, d).select("experiment", "version", "metric", "event_id", "step")


@register("h2_rows_at_best_step", LOG + """
, b AS (SELECT experiment, version, step AS best FROM (
          SELECT *, row_number() OVER (PARTITION BY experiment, version ORDER BY value DESC, step) AS rn
          FROM s WHERE contains(metric, 'acc') AND contains(metric, 'Test')) WHERE rn = 1)
SELECT s.experiment, s.version, s.metric, s.step, s.value FROM s JOIN b ON s.experiment = b.experiment AND s.version = b.version AND s.step = b.best""")
def h2_rows_at_best_step(spark: SparkSession, d: str):
    return runs.rows_at_best_step(_log(spark, d)).select("experiment", "version", "metric", "step", "value")


FINAL_SQL = """
, i AS (SELECT experiment, version, max(value) AS interested FROM s WHERE contains(metric, 'acc') AND contains(metric, 'Test') GROUP BY ALL),
f AS (SELECT s.experiment, s.version, s.metric, s.value, coalesce(i.interested, 0.0) AS interested
      FROM s LEFT JOIN i ON s.experiment = i.experiment AND s.version = i.version WHERE s.step = 1 AND contains(s.metric, 'Test'))"""

BEST_SQL = """
, br AS (SELECT experiment, version FROM (
           SELECT experiment, version, row_number() OVER (PARTITION BY experiment ORDER BY interested DESC, version) AS rn
           FROM (SELECT DISTINCT experiment, version, interested FROM f)) WHERE rn = 1),
bf AS (SELECT f.* FROM f JOIN br ON f.experiment = br.experiment AND f.version = br.version)"""


@register("h3_run_final_rows", LOG + FINAL_SQL + " SELECT experiment, version, metric, value, interested FROM f")
def h3_run_final_rows(spark: SparkSession, d: str):
    return runs.run_final_rows(_log(spark, d)).select("experiment", "version", "metric", "value", "interested")


@register("h4_best_run", LOG + FINAL_SQL + BEST_SQL + " SELECT experiment, version, metric, value FROM bf")
def h4_best_run(spark: SparkSession, d: str):
    return runs.best_run(runs.run_final_rows(_log(spark, d))).select("experiment", "version", "metric", "value")


@register("h5_metrics_wide", LOG + FINAL_SQL + BEST_SQL + """
SELECT experiment, max(value) FILTER (WHERE metric = 'Test/acc') AS "Test/acc",
       max(value) FILTER (WHERE metric = 'Test/f1') AS "Test/f1", max(value) FILTER (WHERE metric = 'Test/loss') AS "Test/loss"
FROM bf GROUP BY experiment""")
def h5_metrics_wide(spark: SparkSession, d: str):
    best = runs.best_run(runs.run_final_rows(_log(spark, d))).withColumn("step", F.lit(1))
    return runs.metrics_wide(best, ["Test/acc", "Test/f1", "Test/loss"])


def _plateau_step_sql(prev: str) -> str:
    """One fold step (mode min, rel threshold 1e-4, factor 0.5, patience 2, floor 0.01,
    cooldown 1) as nested selects over the previous state ``prev`` joined to the epoch."""
    return f"""
SELECT trial, i, epoch, metric, best,
       CASE WHEN trig THEN 0 ELSE bad2 END AS bad,
       CASE WHEN trig THEN 1 ELSE cool1 END AS cool,
       CASE WHEN trig AND hyper - greatest(hyper * 0.5, 0.01) > 1e-8 THEN greatest(hyper * 0.5, 0.01) ELSE hyper END AS hyper,
       trig AND hyper - greatest(hyper * 0.5, 0.01) > 1e-8 AS reduced
FROM (SELECT *, bad2 > 2 AS trig FROM (
  SELECT *, CASE WHEN cool > 0 THEN cool - 1 ELSE cool END AS cool1, CASE WHEN cool > 0 THEN 0 ELSE bad1 END AS bad2 FROM (
    SELECT r.trial, r.i, r.epoch, r.metric, p.cool, p.hyper,
           CASE WHEN r.metric < p.best * (1 - 1e-4) THEN r.metric ELSE p.best END AS best,
           CASE WHEN r.metric < p.best * (1 - 1e-4) THEN 0 ELSE p.bad + 1 END AS bad1
    FROM {prev})))"""


H8_SQL = with_views("run_log") + """
, h AS (SELECT version AS trial, CAST(dayofmonth(wall_time) AS BIGINT) AS epoch, avg(value) AS metric
        FROM run_log WHERE metric = 'Train/Loss' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY epoch) - 1 AS i FROM h),
s AS (SELECT trial, -1::BIGINT AS i, 0::BIGINT AS epoch, 0.0::DOUBLE AS metric, 'inf'::DOUBLE AS best, 0::INT AS bad, 0::INT AS cool,
             1.0::DOUBLE AS hyper, false AS reduced
      FROM r WHERE i = 0)"""
H8_SQL = H8_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "s AS (SELECT trial, -1 AS i", "s(trial, i, epoch, metric, best, bad, cool, hyper, reduced) AS (SELECT trial, -1 AS i") \
    .replace("FROM r WHERE i = 0)", "FROM r WHERE i = 0\n  UNION ALL" + _plateau_step_sql("s p JOIN r ON r.trial = p.trial AND r.i = p.i + 1") + ")")
H8_SQL += """
SELECT trial, epoch, metric, hyper, best, CAST(bad AS INT) AS bad_epochs, reduced FROM s WHERE i >= 0"""


@register("h8_plateau_events", H8_SQL)
def h8_plateau_events(spark: SparkSession, d: str):
    log = fixtures.run_log(spark, d).where(F.col("metric") == "Train/Loss")
    hist = log.groupBy(F.col("version").alias("trial"), F.dayofmonth("wall_time").alias("epoch")).agg(F.avg("value").alias("metric"))
    return runs.plateau_events(hist, init=1.0, mode="min", factor=0.5, patience=2, min_hyper=0.01, cooldown=1)


HIST_SQL = LOG + """
, h AS (SELECT version AS trial, step + 1 AS iteration, value FROM s WHERE metric = 'Test/acc')"""


def _hist(spark: SparkSession, d: str):
    log = _log(spark, d).where(F.col("metric") == "Test/acc")
    return log.select(F.col("version").alias("trial"), (F.col("step") + 1).alias("iteration"), "value")


@register("h9_halving_survivors", HIST_SQL + """
, a5 AS (SELECT trial, value, row_number() OVER (ORDER BY value DESC, trial) AS rank, count(*) OVER () AS n FROM h WHERE iteration = 5),
k5 AS (SELECT trial, value, rank FROM a5 WHERE rank <= ceil(n / 2)),
a10 AS (SELECT trial, value, row_number() OVER (ORDER BY value DESC, trial) AS rank, count(*) OVER () AS n
        FROM h WHERE iteration = 10 AND trial IN (SELECT trial FROM k5)),
k10 AS (SELECT trial, value, rank FROM a10 WHERE rank <= ceil(n / 2))
SELECT 5 AS rung, trial, value, rank FROM k5 UNION ALL SELECT 10, trial, value, rank FROM k10""")
def h9_halving_survivors(spark: SparkSession, d: str):
    return runs.halving_survivors(_hist(spark, d), grace=5, eta=2, max_t=20)


def halving_sql(rungs: list[int]) -> str:
    """DuckDB text of ``runs.halving_survivors`` over the rungs, each on the survivors of the one before."""
    sql, before = HIST_SQL, ""
    for t in rungs:
        sql += f""",
a{t} AS (SELECT trial, value, row_number() OVER (ORDER BY value DESC, trial) AS rank, count(*) OVER () AS n FROM h WHERE iteration = {t}{before}),
k{t} AS (SELECT trial, value, rank FROM a{t} WHERE rank <= ceil(n / 2))"""
        before = f" AND trial IN (SELECT trial FROM k{t})"
    return sql + "\n" + " UNION ALL ".join(f"SELECT {t} AS rung, trial, value, rank FROM k{t}" for t in rungs)


@register("h9_halving_survivors_all_rungs", halving_sql([5, 10, 20, 40, 80]))
def h9_halving_survivors_all_rungs(spark: SparkSession, d: str):
    return runs.halving_survivors(_hist(spark, d), grace=5, eta=2, max_t=100)


@register("h10_best_trial", LOG + """
, h AS (SELECT experiment, version AS trial, step + 1 AS iteration, value FROM s WHERE metric = 'Val/acc'),
per AS (SELECT experiment, trial, max(value) AS best_value, arg_max(iteration, value * 1e6 - iteration) AS best_iteration FROM h GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY best_value DESC, trial) AS rn FROM per)
SELECT experiment, trial, best_value, best_iteration FROM ranked WHERE rn = 1""")
def h10_best_trial(spark: SparkSession, d: str):
    log = _log(spark, d).where(F.col("metric") == "Val/acc")
    h = log.select("experiment", F.col("version").alias("trial"), (F.col("step") + 1).alias("iteration"), "value")
    return runs.best_trial(h, group=["experiment"]).select("experiment", "trial", "best_value", "best_iteration")


@register("h11_chosen_hyper", with_views("run_log") + """
, cfg AS (SELECT concat('exp', CAST(user_id % 10 AS VARCHAR)) AS experiment, concat('version_', CAST(user_id AS VARCHAR)) AS version,
                 json_extract_string(arg_min(props, event_id), '$.k') AS k FROM events GROUP BY user_id)
SELECT r.experiment || '_k_' || c.k AS experiment, r.version, r.metric, r.event_id
FROM run_log r JOIN cfg c ON r.experiment = c.experiment AND r.version = c.version WHERE c.k IS NOT NULL""")
def h11_chosen_hyper(spark: SparkSession, d: str):
    from noisesift.session import table

    ev = table(spark, d, "events")
    cfg = ev.groupBy("user_id").agg(F.min_by("props", "event_id").alias("props")).select(
        F.concat(F.lit("exp"), (F.col("user_id") % 10).cast("string")).alias("experiment"),
        F.concat(F.lit("version_"), F.col("user_id").cast("string")).alias("version"),
        F.from_json("props", "map<string,string>").alias("config"),
    )
    out = runs.chosen_hyper(fixtures.run_log(spark, d), cfg, "k")
    return out.select("experiment", "version", "metric", "event_id")


A7_PATH_SQL = """
, p AS (SELECT event_id, CASE WHEN metric = 'Val/acc' THEN 'runs/' || experiment || '/run-' || version[9:] || '/events.out'
                              WHEN event_id % 2 = 0 THEN 'runs/' || experiment || '/' || version || '/events.out'
                              ELSE 'runs/' || version || '/x/' || experiment || '/DEFAULT_/events.out' END AS path FROM run_log)"""


@register("a7_read_run_logs", with_views("run_log") + A7_PATH_SQL + """
SELECT event_id, string_split(path, '/')[-3] AS experiment,
       CASE WHEN contains(path, 'DEFAULT_') THEN string_split(path, '/')[-5] ELSE string_split(path, '/')[-2] END AS version
FROM p WHERE contains(path, 'version_')""")
def a7_read_run_logs(spark: SparkSession, d: str):
    log = fixtures.run_log(spark, d)
    path = (
        F.when(F.col("metric") == "Val/acc", F.concat(F.lit("runs/"), "experiment", F.lit("/run-"), F.substring("version", 9, 100), F.lit("/events.out")))
        .when(F.col("event_id") % 2 == 0, F.concat(F.lit("runs/"), "experiment", F.lit("/"), "version", F.lit("/events.out")))
        .otherwise(F.concat(F.lit("runs/"), "version", F.lit("/x/"), "experiment", F.lit("/DEFAULT_/events.out")))
    )
    paths = log.select("event_id", path.alias("path"))
    return runs.read_run_logs(paths).select("event_id", "experiment", "version")


# Sweep grid: method sets x open intervals (configuration, not data).
SWEEP_METHODS = [None, ["CharswapAug"], ["WordnetAug"], ["CharswapAug", "EasydataAug"]]
SWEEP_LO = [0.0, 20.0, 50.0]
SWEEP_HI = [150.0, 200.0, 250.0]


def sweep_trials(spark: SparkSession):
    rows = [(i, m, lo, hi) for i, (m, lo, hi) in enumerate(itertools.product(SWEEP_METHODS, SWEEP_LO, SWEEP_HI))]
    return spark.createDataFrame(rows, "trial_id long, methods array<string>, lo double, hi double")


def _sweep_values_sql() -> str:
    vals = []
    for i, (m, lo, hi) in enumerate(itertools.product(SWEEP_METHODS, SWEEP_LO, SWEEP_HI)):
        ms = "NULL" if m is None else "[" + ", ".join(f"'{x}'" for x in m) + "]"
        vals.append(f"({i}, {ms}, {lo}, {hi})")
    return ", ".join(vals)


@register("j17_sweep", with_views("train", "aug") + f"""
, t AS (SELECT * FROM (VALUES {_sweep_values_sql()}) AS t(trial_id, methods, lo, hi)),
a AS (SELECT a.aug_method, a.readability, tr.label FROM aug a LEFT JOIN train tr ON a.origin = tr.index)
SELECT CAST(t.trial_id AS BIGINT) AS trial_id, count(*) AS rows_kept,
       CAST(sum(CASE WHEN a.label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_class0,
       CAST(sum(CASE WHEN a.label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_class1, avg(a.readability) AS mean_score
FROM t JOIN a ON (t.methods IS NULL OR list_contains(t.methods, a.aug_method))
WHERE a.readability > t.lo AND a.readability < t.hi GROUP BY t.trial_id""")
def j17_sweep(spark: SparkSession, d: str):
    aug = joins.attach_label(fixtures.aug(spark, d).select("origin", "aug_method", "readability"), fixtures.train(spark, d))
    return runs.sweep(sweep_trials(spark), aug)


@register("j17_sweep_by_class", with_views("train", "aug") + f"""
, t AS (SELECT * FROM (VALUES {_sweep_values_sql()}) AS t(trial_id, methods, lo, hi)),
a AS (SELECT a.aug_method, a.readability, tr.label FROM aug a LEFT JOIN train tr ON a.origin = tr.index)
SELECT CAST(t.trial_id AS BIGINT) AS trial_id, a.label, CAST(count(*) AS BIGINT) AS rows_kept
FROM t JOIN a ON (t.methods IS NULL OR list_contains(t.methods, a.aug_method))
WHERE a.readability > t.lo AND a.readability < t.hi GROUP BY t.trial_id, a.label""")
def j17_sweep_by_class(spark: SparkSession, d: str):
    aug = joins.attach_label(fixtures.aug(spark, d).select("origin", "aug_method", "readability"), fixtures.train(spark, d))
    return runs.sweep_by_class(sweep_trials(spark), aug)
