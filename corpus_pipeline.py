"""The corpus pipeline: five stages over ``documents``, each one written and read again.

1. ``quality``: documents that the quality classifier rejects go.
2. ``near_dedup``: of each group of near-duplicates (shingles of five words,
   similarity 0.8) the one of smallest id stays. Groups are of rows, not of ids: rows that
   share an id or have none are told apart by their other columns, so a differing text stays.
3. ``secrets``: every found secret is replaced by ``[SECRET]``.
4. ``mixing``: documents are repeated or left out so that the sources come to
   their target weights, in the order of the curriculum.
5. ``packing``: the texts are tokenised and packed into sequences of 1024 ids.

All stages but the last return the columns of ``documents``, and extra columns as they
came, whatever their names. Null and empty texts are kept by ``near_dedup`` (they are like no other
text, but rows equal in every column are one) and ``secrets``, never taken by ``mixing`` (size 0); what ``quality`` does
with them is its own decision. Ties go to the smaller id. An empty table passes every stage.

The stages hold
trained models and a tokenizer, so the pipeline has no SQL form; the tests
compare it with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import checked_ids, staged, table
from noisesift.llm.minhash import near_duplicates
from noisesift.llm.mixing import mix
from noisesift.llm.packing import pack_documents
from noisesift.llm.quality import drop_rejected
from noisesift.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs)


def _row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a column that names each of them, and that column's name.

    An id that no other row has names its row. Rows without an id, or with one that is
    repeated, get numbers above all ids; of those that are equal in every column one stays.
    """
    top = docs.agg(F.max("doc_id")).first()[0]
    odd = staged(docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").select(F.col("doc_id").alias("_odd")), "odd")
    if odd.isEmpty():
        return docs, "doc_id"
    name = "_row"
    while name in docs.columns:
        name += "_"
    meets = F.col("doc_id").eqNullSafe(F.col("_odd"))
    plain = docs.join(checked_ids(odd), meets, "left_anti").withColumn(name, F.col("doc_id"))
    several = staged(docs.join(checked_ids(odd), meets, "left_semi").dropDuplicates(), "odd")
    several = several.withColumn(name, F.lit((top or 0) + 1) + F.monotonically_increasing_id())
    return staged(plain.unionByName(several), "rows"), name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name = _row_ids(docs)
    groups = near_duplicates(rows, n=5, id_col=name)
    if name != "doc_id":  # the one that stays has the smallest id, not the smallest number
        ids = rows.select(F.col("doc_id").alias("_id"), F.col(name).alias("_number"))
        own = staged(groups.join(ids, F.col("doc_id") == F.col("_number")).select("doc_id", "component_id", F.struct(F.col("_id").isNull(), "_id", "doc_id").alias("_by")), "groups")
        first = own.groupBy("component_id").agg(F.min("_by").alias("_first"))
        groups = own.join(first, "component_id").select("doc_id", F.col("_by").eqNullSafe(F.col("_first")).alias("kept"))
    gone = checked_ids(staged(groups.where("NOT kept").select(F.col("doc_id").alias(name)), "gone"))
    return rows.join(gone, name, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
