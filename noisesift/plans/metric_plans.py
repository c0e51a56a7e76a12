"""Queries for metrics and epoch aggregates."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import with_views
from noisesift.functions import metrics as M
from noisesift.plans.registry import register

PRED = with_views("predictions")


def _pred(spark: SparkSession, d: str):
    return fixtures.predictions(spark, d)


def _binary(spark: SparkSession, d: str):
    p = _pred(spark, d)
    return p.select("vec_id", (F.col("label") % 2).alias("y"), (F.col("pred") % 2).alias("p"))


def _regression(spark: SparkSession, d: str):
    return _pred(spark, d).select("vec_id", F.element_at("logits", 1).alias("x"), F.col("label").cast("double").alias("y"))


BIN_SQL = ", b AS (SELECT vec_id, label % 2 AS y, pred % 2 AS p FROM predictions)"
REG_SQL = ", r AS (SELECT vec_id, logits[1] AS x, CAST(label AS DOUBLE) AS y FROM predictions)"


def _prf_sql(tp: str, fp: str, fn: str, prefix: str) -> str:
    return f"""CASE WHEN ({tp}) + ({fp}) = 0 THEN 0.0 ELSE ({tp}) / (({tp}) + ({fp}))::DOUBLE END AS {prefix}precision,
       CASE WHEN ({tp}) + ({fn}) = 0 THEN 0.0 ELSE ({tp}) / (({tp}) + ({fn}))::DOUBLE END AS {prefix}recall,
       CASE WHEN 2 * ({tp}) + ({fp}) + ({fn}) = 0 THEN 0.0 ELSE 2 * ({tp}) / (2 * ({tp}) + ({fp}) + ({fn}))::DOUBLE END AS {prefix}f1"""


TP = "sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END)"
FP = "sum(CASE WHEN y <> 1 AND p = 1 THEN 1 ELSE 0 END)"
FN = "sum(CASE WHEN y = 1 AND p <> 1 THEN 1 ELSE 0 END)"
NTP = "sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END)"
NFP = "sum(CASE WHEN y <> 0 AND p = 0 THEN 1 ELSE 0 END)"
NFN = "sum(CASE WHEN y = 0 AND p <> 0 THEN 1 ELSE 0 END)"


@register("g1_accuracy", PRED + "SELECT avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS acc FROM predictions")
def g1_accuracy(spark: SparkSession, d: str):
    return M.accuracy(_pred(spark, d))


@register("g2_binary_prf", PRED + BIN_SQL + f" SELECT {_prf_sql(TP, FP, FN, 'pos_')} FROM b")
def g2_binary_prf(spark: SparkSession, d: str):
    return M.binary_prf(_binary(spark, d), "y", "p")


@register("g3_negative_prf", PRED + BIN_SQL + f" SELECT {_prf_sql(NTP, NFP, NFN, 'neg_')} FROM b")
def g3_negative_prf(spark: SparkSession, d: str):
    return M.negative_prf(_binary(spark, d), "y", "p")


@register("g4_micro_prf", PRED + """SELECT avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS precision,
       avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS recall, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS f1 FROM predictions""")
def g4_micro_prf(spark: SparkSession, d: str):
    return M.micro_prf(_pred(spark, d))


@register("g4_classification_report", PRED + BIN_SQL + f""" SELECT avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS acc,
       {_prf_sql(TP, FP, FN, 'pos_')}, {_prf_sql(NTP, NFP, NFN, 'neg_')} FROM b""")
def g4_classification_report(spark: SparkSession, d: str):
    return M.classification_report(_binary(spark, d), "y", "p")


@register("g5_confusion_matrix", PRED + "SELECT label AS y_true, pred AS y_pred, count(*) AS n FROM predictions GROUP BY ALL")
def g5_confusion_matrix(spark: SparkSession, d: str):
    return M.confusion_matrix(_pred(spark, d))


@register("g6_pearson", with_views("predictions") + REG_SQL + " SELECT corr(x, y) AS pearson FROM r")
def g6_pearson(spark: SparkSession, d: str):
    return M.pearson(_regression(spark, d), "x", "y")


@register("g7_task_metric_cola", PRED + BIN_SQL + """
, c AS (SELECT sum(CASE WHEN y = 1 AND p = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p = 0 THEN 1.0 ELSE 0 END) AS tn,
               sum(CASE WHEN y = 0 AND p = 1 THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p = 0 THEN 1.0 ELSE 0 END) AS fn FROM b)
SELECT CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
            ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS matthews FROM c""")
def g7_task_metric_cola(spark: SparkSession, d: str):
    return M.task_metric(_binary(spark, d), "cola", "y", "p")


@register("g7_task_metric_mrpc", PRED + BIN_SQL + f""" SELECT avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS accuracy,
       CASE WHEN 2 * {TP} + {FP} + {FN} = 0 THEN 0.0 ELSE 2 * {TP} / (2 * {TP} + {FP} + {FN})::DOUBLE END AS f1 FROM b""")
def g7_task_metric_mrpc(spark: SparkSession, d: str):
    return M.task_metric(_binary(spark, d), "mrpc", "y", "p")


@register("g7_task_metric_stsb", with_views("predictions") + REG_SQL + """
, rk AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM r)
SELECT corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM rk""")
def g7_task_metric_stsb(spark: SparkSession, d: str):
    return M.task_metric(_regression(spark, d).withColumnRenamed("x", "pred").withColumnRenamed("y", "label"), "stsb", "label", "pred", "vec_id") \
        .withColumnRenamed("pearson", "pearson")


CE_SQL = """
, lse AS (SELECT vec_id, batch_id, label, logits, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS l FROM predictions)"""


@register("g8_cross_entropy", PRED + CE_SQL + " SELECT vec_id, round(l - logits[label + 1], 6) AS loss FROM lse")
def g8_cross_entropy(spark: SparkSession, d: str):
    p = _pred(spark, d)
    return p.select("vec_id", F.round(M.cross_entropy("logits", "label"), 6).alias("loss"))


@register("g8_mse", with_views("predictions") + REG_SQL + " SELECT avg((x - y) * (x - y)) AS mse FROM r")
def g8_mse(spark: SparkSession, d: str):
    r = _regression(spark, d)
    return r.agg(F.avg(M.squared_error("x", "y")).alias("mse"))


@register("g9_epoch_means", with_views("run_log") + """
SELECT CAST(dayofmonth(wall_time) AS INT) AS epoch, metric AS name, avg(value) AS mean_value FROM run_log GROUP BY ALL""")
def g9_epoch_means(spark: SparkSession, d: str):
    log = fixtures.run_log(spark, d).select(F.dayofmonth("wall_time").alias("epoch"), F.col("metric").alias("name"), "value")
    return M.epoch_means(log)


@register("g10_batch_mean_loss", PRED + CE_SQL + """
, bm AS (SELECT batch_id, avg(l - logits[label + 1]) AS m FROM lse GROUP BY batch_id)
SELECT avg(m) AS batch_mean_loss, count(*) AS batches FROM bm""")
def g10_batch_mean_loss(spark: SparkSession, d: str):
    p = _pred(spark, d).select("batch_id", M.cross_entropy("logits", "label").alias("loss"))
    return M.batch_mean_loss(p)


@register("g11_weight_norm", with_views("weighted") + " SELECT batch_id // 4 AS epoch, sqrt(sum(w * w)) AS weight_norm FROM weighted GROUP BY ALL")
def g11_weight_norm(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d).withColumn("epoch", (F.col("batch_id") / 4).cast("bigint"))
    return M.weight_norm(w)


@register("g12_phase_times", with_views("run_log") + """
SELECT CAST(dayofmonth(wall_time) AS INT) AS epoch, metric AS phase, sum(value) AS seconds FROM run_log GROUP BY ALL""")
def g12_phase_times(spark: SparkSession, d: str):
    log = fixtures.run_log(spark, d).select(F.dayofmonth("wall_time").alias("epoch"), F.col("metric").alias("phase"), F.col("value").alias("seconds"))
    return M.phase_times(log)


@register("g13_method_census", with_views("train", "aug") + """
SELECT aug_method, count(*) AS rows, (SELECT count(DISTINCT aug_method) FROM aug) AS n_methods,
       (SELECT count(*) FROM aug) / (SELECT count(*) FROM train)::DOUBLE AS aug_raw_ratio FROM aug GROUP BY aug_method""")
def g13_method_census(spark: SparkSession, d: str):
    return M.method_census(fixtures.aug(spark, d), fixtures.train(spark, d))
