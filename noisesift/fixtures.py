"""Shared test views over the driver tables (see FIXTURES.md section 3).

Each view exists twice: as a DataFrame builder for Spark and as SQL text for the
DuckDB oracle. Both compute the same rows; scores and weights are synthetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.session import table

# Augmentation method names, in the order of the method index k.
AUG_METHODS = ["CharswapAug", "ChecklistAug", "EasydataAug", "EmbeddingAug", "WordnetAug"]


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("index"),
        "text",
        F.col("quality").alias("label"),
        "toxic",
        (F.col("n_chars") % 250).cast("double").alias("readability"),
        F.lit(0.5).cast("double").alias("cola"),
    )


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with all its columns and the scores of ``train``; labels are null where it has none."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("index"),
        "text",
        F.col("quality").alias("label"),
        "toxic",
        (F.col("n_chars") % 250).cast("double").alias("readability"),
        F.lit(0.5).cast("double").alias("cola"),
        "lang",
        "source",
        "n_chars",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, labelled or not."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "text")


def _aug_text(k: Column, text: Column) -> Column:
    return (
        F.when(k == 0, F.replace(text, F.lit("e"), F.lit("3")))
        .when(k == 1, F.replace(text, F.lit("o"), F.lit("0")))
        .when(k == 2, F.concat(text, F.lit(" again")))
        .when(k == 3, F.replace(text, F.lit(" the "), F.lit(" ")))
        .otherwise(F.replace(text, F.lit("a"), F.lit("@")))
    )


def aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Five variants per document, generated per row (no join): a bounded explode.
    methods = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("aug_method")) for k, m in enumerate(AUG_METHODS)])
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.explode(methods).alias("m"))
    k = F.col("m.k")
    return d.select(
        F.col("doc_id").alias("origin"),
        F.col("m.aug_method").alias("aug_method"),
        _aug_text(k, F.col("text")).alias("text"),
        ((F.col("n_chars") + 37 * k) % 250).cast("double").alias("readability"),
        F.lit(0.5).cast("double").alias("cola"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("sentence1"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    return a.join(b, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("index"),
        "sentence1",
        "sentence2",
        (F.col("conv_id") % 3).cast("int").alias("label"),
    )


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.floor(F.col("vec_id") / F.lit(32.0)).cast("bigint").alias("batch_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("embedding"),
        (((F.col("vec_id") * 37 + 11) % 101).cast("double") / F.lit(100.0)).alias("w"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    metric = (
        F.when(F.col("event_type") == "view", "Test/acc")
        .when(F.col("event_type") == "click", "Test/f1")
        .when(F.col("event_type") == "purchase", "Test/loss")
        .when(F.col("event_type") == "error", "Val/acc")
        .otherwise("Train/Loss")
    )
    return ev.select(
        F.concat(F.lit("exp"), (F.col("user_id") % 10).cast("string")).alias("experiment"),
        F.concat(F.lit("version_"), F.col("user_id").cast("string")).alias("version"),
        metric.alias("metric"),
        F.col("ts").alias("wall_time"),
        "event_id",
        "value",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`weighted` with 10 logits (a fixed linear head on the whole vector) and the argmax prediction."""
    w = weighted(spark, sf_dir).withColumn("logits", F.expr(LOGITS_SPARK))
    logits = F.col("logits")
    return w.select(
        "vec_id", "batch_id", "label", "w", "embedding",
        "logits",
        (F.array_position(logits, F.array_max(logits)) - 1).cast("int").alias("pred"),
    )


# the head's entry for output k and component j: ((31 k + 17 j) mod 13 - 6) / 6
LOGITS_SPARK = """
transform(sequence(0, 9), k -> aggregate(
  transform(embedding, (x, j) -> x * (((31 * k + 17 * j) % 13) - 6) / 6D), 0D, (a, x) -> a + x))"""
LOGITS_DUCK = """
list_transform(range(0, 10), lambda k: list_sum(list_transform(embedding, lambda x, j: x * (((31 * k + 17 * (j - 1)) % 13) - 6) / 6.0)))"""

# ---------------------------------------------------------------- DuckDB text
VIEW_SQL = {
    "train": """
SELECT d.doc_id AS index, d.text, l.quality AS label, l.toxic,
       CAST(d.n_chars % 250 AS DOUBLE) AS readability, CAST(0.5 AS DOUBLE) AS cola
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "aug": """
SELECT d.doc_id AS origin, m.aug_method,
       CASE m.k WHEN 0 THEN replace(d.text,'e','3') WHEN 1 THEN replace(d.text,'o','0')
                WHEN 2 THEN d.text || ' again'
                WHEN 3 THEN replace(d.text,' the ',' ')
                ELSE replace(d.text,'a','@') END AS text,
       CAST((d.n_chars + 37*m.k) % 250 AS DOUBLE) AS readability, CAST(0.5 AS DOUBLE) AS cola
FROM documents d CROSS JOIN (VALUES (0,'CharswapAug'),(1,'ChecklistAug'),(2,'EasydataAug'),
                                    (3,'EmbeddingAug'),(4,'WordnetAug')) AS m(k, aug_method)""",
    "corpus": """
SELECT doc_id AS index, text FROM documents""",
    "pairs": """
SELECT a.conv_id * 100 + a.turn AS index, a.text AS sentence1, b.text AS sentence2,
       CAST(a.conv_id % 3 AS INT) AS label
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "weighted": """
SELECT vec_id, CAST(floor(vec_id / 32.0) AS BIGINT) AS batch_id, label,
       CAST(embedding AS DOUBLE[]) AS embedding,
       CAST((vec_id * 37 + 11) % 101 AS DOUBLE) / 100.0 AS w FROM embeddings""",
    "run_log": """
SELECT concat('exp', CAST(user_id % 10 AS VARCHAR)) AS experiment,
       concat('version_', CAST(user_id AS VARCHAR)) AS version,
       CASE event_type WHEN 'view' THEN 'Test/acc' WHEN 'click' THEN 'Test/f1'
                       WHEN 'purchase' THEN 'Test/loss' WHEN 'error' THEN 'Val/acc'
                       ELSE 'Train/Loss' END AS metric,
       ts AS wall_time, event_id, value FROM events""",
    "predictions": f"""
SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS pred
FROM (SELECT vec_id, batch_id, label, w, embedding, {LOGITS_DUCK} AS logits FROM weighted)""",
}

# Views that other views read.
_DEPENDS = {"predictions": ["weighted"]}


def with_views(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` prefix for an oracle query (dependencies first)."""
    ordered: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, []):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in ordered) + "\n"
