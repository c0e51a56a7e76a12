"""Queries whose Python functions name something of their module run on workers that have the package only as the shipped zip."""

import os
import random
import subprocess
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tools.oracle_check import rows_of

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FILES = ["a3_read_augmented_csv", "a4_route_by_side", "a6_write_csv"]
VECTORS = ["j13_batch_scorer", "j15_gate_fit", "j1_instance_weight_arrow", "j1_instance_weight_deep", "j4_info_nce_arrow", "j4_info_nce_blocks",
           "j5_supervised_contrast_arrow", "j5_supervised_contrast_aug", "j5_supervised_contrast_tiles", "j8_bank_apply_batch"]
STREAMS = ["k1_stream_bank_weight", "k1_stream_bank_weight_batches", "k2_stream_bank_time", "k2_stream_bank_time_batches", "k3_stream_profile"]

RUN = """
import sys
out, names = sys.argv[1], sys.argv[2:]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config(map={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC",
    "spark.checkpoint.dir": f"{out}/shared", "spark.sql.warehouse.dir": f"{out}/warehouse"}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def seen(batches):
    import importlib.util
    for pdf in batches:
        yield pdf.assign(id=int(importlib.util.find_spec("noisesift") is not None))

assert spark.range(1).mapInPandas(seen, "id long").first()[0] == 0, "workers have the repository"
sys.path.insert(0, REPO)  # of this process; workers do not see it
import __spark_entry__
found = __spark_entry__.queries()
for name in names:
    found[name](spark, f"{out}/tables").write.parquet(f"{out}/result/{name}")
"""


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(19)
    at = tmp_path_factory.mktemp("workers")
    words = ["the", "one,", 'say "no"', "two\nlines", "a  e", "é", "ooo"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(40)]
    docs = {"doc_id": list(range(40)), "text": texts, "lang": ["en", None] * 20, "source": ["s"] * 40, "n_chars": [len(x) for x in texts]}
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    vectors = {"vec_id": list(range(160)), "embedding": [[rng.gauss(0, 0.1) for _ in range(64)] for _ in range(160)], "label": [rng.randrange(10) for _ in range(160)]}
    os.makedirs(at / "tables")
    for name, cols, types in (("documents", docs, kinds), ("embeddings", vectors, [pa.int64(), pa.list_(pa.float32()), pa.int32()])):
        pq.write_table(pa.table({c: pa.array(v, t) for (c, v), t in zip(cols.items(), types, strict=True)}), at / f"tables/{name}.parquet")
    return at


@pytest.mark.parametrize("names", [FILES, VECTORS, STREAMS], ids=["files", "vectors", "streams"])
def test_queries_on_workers_without_the_repository(tables, tmp_path, names):
    import __spark_entry__

    os.symlink(tables / "tables", tmp_path / "tables")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", RUN.replace("REPO", repr(REPO)), str(tmp_path), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-4000:]
    con, oracles = duckdb.connect(), __spark_entry__.oracle_sql()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/tables/{t}.parquet')")
    for name in names:
        want = con.sql(oracles[name]).to_arrow_table()
        got = pq.read_table(tmp_path / "result" / name)
        cols = sorted(want.column_names)
        assert sorted(got.column_names) == cols
        assert rows_of(got.to_pylist(), cols) == rows_of(want.to_pylist(), cols), name
        assert got.num_rows
