"""Embedding near-duplicates by spherical-cap filters from a structured random product code.

A filter is a direction: after a random rotation the coordinates are cut into
``BLOCKS`` blocks, each with a code book of ``BOOK`` random unit vectors, and every
combination of one code word a block is a direction (64**3 = 262,144 of them).
A vector passes a filter if its scalar product with the direction exceeds the
height of its cap, which lies ``CAP_DEPTH`` under its best direction (so that no
vector is left without filters); the passing combinations are list-decoded block by block, pruned
by the best that the blocks still open can add, never by trying all directions.
Two vectors at cosine 0.98 share most of their filters; ``CODES`` independent
codes drive the chance of sharing none below one in a million (measured in the
tests on random pairs at exactly 0.98).

Vectors that share a filter meet in its bucket and are verified in double
precision. Equal vectors are one class first. A bucket larger than ``BLOCK`` is
split into blocks, and every pair of blocks is a group of its own, so no task
holds an unbounded bucket; a group returns, for each of its vectors, how many
others it links to (each link counted in the smallest filter that both share)
and one peer of its part of the link graph, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors of a null label, link with nothing; vectors of different
length are never compared; repeated rows are vectors of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import components, query, staged, table

BLOCKS, BOOK, CODES = 3, 64, 4
CAP_DEPTH = 0.25  # under the best direction, in standard deviations of a random direction's product
BLOCK = 512
_codes: dict[int, list] = {}


def codes(dim: int) -> list:
    """The product codes for vectors of one length: (rotation, code books)."""
    if dim not in _codes:
        rng = np.random.default_rng([dim, 77])
        made = []
        for _ in range(CODES):
            rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            books = []
            for cols in np.array_split(np.arange(dim), min(BLOCKS, dim)):
                book = rng.standard_normal((BOOK, len(cols)))
                books.append((cols, book / np.linalg.norm(book, axis=1, keepdims=True)))
            made.append((rotation, books))
        _codes[dim] = made
    return _codes[dim]


def list_decode(unit: np.ndarray, depth: float = CAP_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """All filters exceeded by unit vectors: (row, filter) pairs, block by block with pruning."""
    rows_out, filters_out = [], []
    n, dim = unit.shape
    for c, (rotation, books) in enumerate(codes(dim)):
        turned = unit @ rotation
        scores = [turned[:, cols] @ book.T for cols, book in books]
        unit_of_score = 1 / np.sqrt(max(len(cols) for cols, _ in books))  # deviation of a random direction's product
        rest = np.zeros((n, len(books) + 1))
        for k in range(len(books) - 1, -1, -1):
            rest[:, k] = rest[:, k + 1] + scores[k].max(axis=1)
        bound = rest[:, 0] - depth * unit_of_score  # rest[:, 0] is the product with the best direction
        row, got, code = np.arange(n), np.zeros(n), np.zeros(n, dtype=np.int64)
        for k, s in enumerate(scores):
            total = got[:, None] + s[row]
            i, word = np.nonzero(total >= (bound[row] - rest[row, k + 1])[:, None])
            row, got, code = row[i], total[i, word], code[i] * BOOK + word
        rows_out.append(row)
        filters_out.append(code * CODES + c)
    return np.concatenate(rows_out), np.concatenate(filters_out)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(column: pa.Array):
    """(rows, matrix) for each vector length in a batch."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, _matrix(column.take(pa.array(rows)))


def filter_keys(classes: DataFrame) -> DataFrame:
    """Rows (label, dim, filter, rep) for every filter that a class's vector exceeds."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for rows, m in _by_length(part.column("embedding")):
                    row, code = list_decode(_unit(m))
                    row = rows[row]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("label").take(pa.array(row)), pa.array(np.full(len(row), m.shape[1], dtype=np.int32)), pa.array(code), part.column("rep").take(pa.array(row))],
                        names=["label", "dim", "filter", "rep"],
                    )

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "rep", "embedding").mapInArrow(run, f"label {label}, dim int, filter long, rep long")


def _labels(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable over a symmetric link matrix, for every index."""
    n = len(link)
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(link, low[None, :], n).min(axis=1))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _group(at: int, threshold: float, rep: np.ndarray, weight: np.ndarray, side: np.ndarray, unit: np.ndarray, filters: list[np.ndarray], pair: bool):
    """Link counts and peers in one group; ``at`` is the filter that the group belongs to."""
    link = unit @ unit.T >= threshold
    if pair:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    if not link.any():
        return None
    some = np.flatnonzero(link.any(axis=1))
    link = link[np.ix_(some, some)]
    owner = np.repeat(np.arange(len(some)), [len(filters[i]) for i in some])
    flat = np.concatenate([filters[i] for i in some])
    early = flat < at
    counted = link
    if early.any():
        names, column = np.unique(flat[early], return_inverse=True)
        has = np.zeros((len(some), len(names)), dtype=np.float32)
        has[owner[early], column] = 1
        counted = link & (has @ has.T < 0.5)
    links = counted @ weight[some]
    order = np.argsort(rep[some], kind="stable")
    low = _labels(link[np.ix_(order, order)])
    peer = np.empty(len(some), dtype=np.int64)
    peer[order] = rep[some][order][low]
    return rep[some], links, peer


def links_of(classes: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Rows (rep, links, peer): links counted in one group, and a member of the group linked to it."""
    keys = staged(filter_keys(classes), "filters")
    sizes = keys.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    parts = sizes.select("label", "dim", "filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    shared = keys.join(parts, ["label", "dim", "filter"])
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    shared = shared.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shared = shared.select("label", "dim", "filter", "rep", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    of_rep = keys.groupBy("rep").agg(F.sort_array(F.collect_set("filter")).alias("filters"))  # bounded by the filters of one vector
    vectors = classes.select("rep", F.col("n").alias("weight"), "embedding").join(of_rep, "rep")
    rows = shared.join(vectors, "rep").repartition("label", "dim", "filter", "i", "j").sortWithinPartitions("label", "dim", "filter", "i", "j", "rep")
    rows = rows.select("label", "dim", "filter", "i", "j", "rep", "side", "weight", "embedding", "filters")

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None

        def close():
            rb = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if rb.num_rows < 2:
                return None
            filters = rb.column("filters")
            cuts, flat = filters.offsets.to_numpy(), filters.values.to_numpy()
            return _group(
                now[2], threshold, rb.column("rep").to_numpy(), rb.column("weight").to_numpy(), rb.column("side").to_numpy(),
                _unit(_matrix(rb.column("embedding"))), [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], now[3] != now[4],
            )

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_pylist() for k in range(5)]
            keys = list(zip(*cols, strict=True))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            out = []
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                if now is not None and keys[x] != now and held:
                    out.append(close())
                    held = []
                now = keys[x]
                held.append(b.slice(x, y - x))
            yield from _rows(out)
        if held:
            yield from _rows([close()])

    return rows.mapInArrow(run, "rep long, links long, peer long")


def _rows(found):
    found = [f for f in found if f is not None]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=["rep", "links", "peer"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    usable = F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) "
        "AND abs(x) < double('infinity')), false) AND exists(embedding, x -> x <> 0)"
    )
    v = v.withColumn("usable", F.coalesce(usable, F.lit(False)))
    v = v.withColumn("x1", F.xxhash64("embedding")).withColumn("x2", F.xxhash64(F.lit(1), "embedding"))
    classes = v.where("usable").groupBy("label", "x1", "x2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = staged(classes, "vectors")
    found = staged(links_of(classes, threshold), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    of_class = classes.select("label", "x1", "x2", "rep", "n").join(counts, "rep", "left").join(groups, F.col("rep") == F.col("id"), "left")
    of_class = of_class.select(
        "label", "x1", "x2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), F.lit(True).alias("usable")
    )
    out = v.select("vec_id", "label", "x1", "x2", "usable").join(of_class, ["label", "x1", "x2", "usable"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL_OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


@query("op2_embedding_near_dedup", SQL_OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
