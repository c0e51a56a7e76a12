"""Queries for the Column helpers F8-F13."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import with_views
from noisesift.functions import vectors as V
from noisesift.plans.registry import register


@register("f8_score_bucket", with_views("aug") + """
SELECT origin, aug_method, CAST(trunc((readability - 0.0) / 2.5) AS BIGINT) AS bucket FROM aug""")
def f8_score_bucket(spark: SparkSession, d: str):
    return fixtures.aug(spark, d).select("origin", "aug_method", V.score_bucket("readability", 0.0, 250.0, 100).alias("bucket"))


@register("f9_l2_normalize", with_views("weighted") + """
, n AS (SELECT vec_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 1e-12) AS nrm FROM weighted)
SELECT vec_id, round(embedding[1] / nrm, 6) AS v1, round(list_sum(list_transform(embedding, lambda x: (x / nrm) * (x / nrm))), 6) AS sq FROM n""")
def f9_l2_normalize(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d).withColumn("u", V.l2_normalize("embedding"))
    return w.select("vec_id", F.round(F.element_at("u", 1), 6).alias("v1"),
                    F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sq"))


@register("f10_dot", with_views("weighted") + """
SELECT vec_id, round(list_dot_product(embedding, list_reverse(embedding)), 6) AS d FROM weighted""")
def f10_dot(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d)
    return w.select("vec_id", F.round(V.dot("embedding", F.reverse("embedding")), 6).alias("d"))


@register("f11_softmax", with_views("predictions") + """
, s AS (SELECT vec_id, logits, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS lse FROM predictions)
SELECT vec_id, round(lse, 6) AS lse, round(exp(list_max(logits) - lse), 6) AS p_max,
       round(list_sum(list_transform(logits, lambda x: exp(x - lse))), 6) AS p_sum, round(logits[1] - lse, 6) AS logp0 FROM s""")
def f11_softmax(spark: SparkSession, d: str):
    p = fixtures.predictions(spark, d)
    x = V.with_softmax(p, "logits", "p").withColumn("lp", V.log_softmax("logits")).withColumn("lse", V.logsumexp("logits"))
    return x.select("vec_id", F.round("lse", 6).alias("lse"), F.round(F.array_max("p"), 6).alias("p_max"),
                    F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 6).alias("p_sum"),
                    F.round(F.element_at("lp", 1), 6).alias("logp0"))


@register("f12_argmax", with_views("weighted") + """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS arg FROM weighted""")
def f12_argmax(spark: SparkSession, d: str):
    return fixtures.weighted(spark, d).select("vec_id", V.argmax("embedding").alias("arg"))


# a fixed gate layer on all 64 components
W13 = [[((31 * k + 17 * j) % 13 - 6) / 8 for j in range(64)] for k in range(2)]
B13 = [0.1, -0.2]


def _affine_sql(k: int) -> str:
    return " + ".join([*(f"({x}) * embedding[{j + 1}]" for j, x in enumerate(W13[k])), f"({B13[k]})"])


@register("f13_gate_pieces", with_views("weighted") + f"""
, a AS (SELECT vec_id, w, [{_affine_sql(0)}, {_affine_sql(1)}] AS h FROM weighted)
SELECT vec_id, round(1.0 / (1.0 + exp(-(w * 10 - 5))), 6) AS sig, round(greatest(h[1], 0.0), 6) AS relu1,
       round(h[1], 6) AS h0, round(h[2], 6) AS h1 FROM a""")
def f13_gate_pieces(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d)
    h = V.affine(W13, B13, "embedding")
    return w.select("vec_id", F.round(V.sigmoid(F.col("w") * 10 - 5), 6).alias("sig"),
                    F.round(V.relu(F.element_at(h, 1)), 6).alias("relu1"),
                    F.round(F.element_at(h, 1), 6).alias("h0"), F.round(F.element_at(h, 2), 6).alias("h1"))
