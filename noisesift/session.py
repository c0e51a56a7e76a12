"""Session, table and scratch-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "noisesift") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("NOISESIFT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; create a local one only when unset (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster (HDFS / object store)")
        conf = tempfile.mkdtemp(prefix="noisesift-ckpt-")  # local mode only (tests, single machine)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def zip_package(path: str) -> None:
    """This package as a zip. Python imports a folder of a zip only if it holds an ``__init__.py``."""
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (a zip through ``addPyFile``)."""
    sc = spark.sparkContext
    if getattr(sc, "_noisesift_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="noisesift-zip-"), "noisesift.zip")
    zip_package(path)
    sc.addPyFile(path)
    sc._noisesift_shipped = True


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """The rows written once to the shared folder and read back: several readers take one computation, and lineage ends there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
