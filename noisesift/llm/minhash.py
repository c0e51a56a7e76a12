"""MinHash near-duplicate documents by a multi-index Hamming join.

Every document's set of word shingles gets a signature of ``CHUNKS * WIDTH``
b-bit symbols (b = 16), one per minhash. Two signatures are at Hamming distance
the number of symbols in which they differ. The signature is split into
``CHUNKS`` chunks; by the pigeonhole principle two signatures within
``CHUNKS * (ERRORS + 1) - 1`` differ in at most ``ERRORS`` symbols of some chunk,
so each signature is indexed under every chunk with every choice of ``ERRORS``
symbols left out, and equal keys meet. With 12 chunks of 6 symbols and one error
all pairs within distance 23 of 72 are guaranteed to meet; a pair of similarity
0.8 (14.4 symbols differ on average) stays apart in all twelve chunks with a
chance of 3 in a million. Every meeting pair that the signatures do not rule out
(further apart than six standard deviations) is confirmed on the full sets.

Skew: documents of equal sets are one class before anything is joined. In a
bucket every member is compared with one pivot only, the member that meets most
others. Members that are connected to it need no more comparison among each other;
a member that is not is compared with those of the pivot's group that an exact
bound leaves possible (they added a same shingle to the pivot's, or are smaller
than the pivot by enough), so a group of copies costs about its size and no link
between different texts is lost.

Defined results: null or wordless text has an empty set and links with nothing;
fewer words than a shingle make one shingle of them all; rows that share an id
are versions of one document and fall in one group; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import checked_ids, components, query, staged, table

CHUNKS, WIDTH, ERRORS = 12, 6, 1
SYMBOLS = CHUNKS * WIDTH
MAX_DISTANCE = 34  # 72 symbols at similarity 0.8 differ in 14.4 on average, standard deviation 3.4
BLOCK_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # lower-cases A-Z
_MASKS = _rng.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64)
_ODDS = _rng.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ones = np.ones(n, dtype=np.uint64)
            up, down = ones * np.uint64(_BASE), ones * np.uint64(_INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and each text's word bounds."""
    n = len(data)
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    bounds = np.concatenate([[0], ends])
    firsts = bounds[:-1][bounds[:-1] < n]
    opens[firsts] = solid[firsts]
    closes = np.empty(n, dtype=bool)
    closes[:-1] = solid[:-1] & ~solid[1:]
    if n:
        closes[-1] = solid[-1]
    lasts = bounds[1:][bounds[1:] > 0] - 1
    closes[lasts] = solid[lasts]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _powers.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    words = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return words, np.searchsorted(start, bounds)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: first row, distinct shingle hashes laid end to end, bounds of each row's."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
        stop = min(stop, len(texts))
        words, at = word_hashes(raw[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row])
        sh = words.copy()
        for k in range(1, min(n, len(words))):
            sh[:-k] = _mix(sh[:-k] * np.uint64(_BASE) + words[k:])
        sets = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= n:
                sets.append(np.unique(sh[a : b - n + 1]))
            elif b > a:
                h = np.uint64(b - a) * np.ones(1, dtype=np.uint64)
                for k in range(a, b):
                    h = _mix(h * np.uint64(_BASE) + words[k])
                sets.append(h)
            else:
                sets.append(words[:0])
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        yield row, np.concatenate(sets), bounds
        row = stop


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """b-bit minhash symbols of non-empty sets laid end to end, one row a set."""
    out = np.empty((len(bounds) - 1, SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS):
        low = np.minimum.reduceat((values ^ _MASKS[k]) * _ODDS[k], bounds[:-1])
        out[:, k] = _mix(low).astype(np.uint16)
    return out


def document_sets(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its set's size, its identity (128 bits) and its signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for b in batches:
            for row, values, bounds in shingle_sets(b.column(1), n):
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                cols = [np.zeros(len(size), dtype=np.int64) for _ in range(2)]
                sigs: list[bytes | None] = [None] * len(size)
                if len(some):
                    tight = np.concatenate([[0], np.cumsum(size[some])])
                    for c, salt in zip(cols, (1, 2), strict=True):
                        c[some] = np.add.reduceat(_mix(values + np.uint64(salt)), tight[:-1]).view(np.int64)
                    for i, s in zip(some, signatures(values, tight), strict=True):
                        sigs[i] = s.tobytes()
                ids = b.column(0).slice(row, len(size))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), *map(pa.array, cols), pa.array(sigs, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """Rows (key, rep): every chunk of every signature with each choice of symbols left out."""
    assert ERRORS == 1

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
                keys = np.empty((len(sig), CHUNKS, WIDTH), dtype=np.uint64)
                for left_out in range(WIDTH):
                    h = np.full(sig.shape[:2], left_out + 1, dtype=np.uint64) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH + 1)
                    for w in range(WIDTH):
                        if w != left_out:
                            h = _mix(h * np.uint64(_BASE) + sig[:, :, w])
                    keys[:, :, left_out] = h
                reps = np.repeat(part.column(0).to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(reps)], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and signatures do not rule the similarity out."""
    side = {s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "ab"}
    sized = pairs.join(side["a"], "a").join(side["b"], "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
                yield b.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= MAX_DISTANCE))

    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """The full shingle sets of the documents whose ids are needed, sorted, as bytes."""

    def run(batches):
        for b in batches:
            for row, values, bounds in shingle_sets(b.column(1), n):
                some = [values[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(some)), pa.array(some, pa.binary())], names=["doc_id", "shingles"])

    return docs.join(needed, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, with_added: bool = False) -> DataFrame:
    """Pairs (a, b) with set sizes, shared shingles, and the first of b's shingles that a lacks.

    Of those as many as b's prefix holds: two sets can only link if they share one
    of their first ``size - percent * size + 1`` shingles in any common order.
    """

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                there = x[np.minimum(at, len(x) - 1)] == y if len(x) else np.zeros(len(y), dtype=bool)
                added = y[~there][: len(y) * (100 - percent) // 100 + 1].view(np.int64) if with_added else ()
                out.append((len(x), len(y), int(there.sum()), added))
            if out:
                na, nb, n_both, added = zip(*out, strict=True)
                cols = [pa.array(c, pa.int64()) for c in (na, nb, n_both)]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *cols, pa.array(added, pa.list_(pa.int64()))], names=["a", "b", "na", "nb", "n_both", "added"])

    joined = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    joined = joined.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, na long, nb long, n_both long, added array<long>")


def _pivot_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (a, b): every member b of a bucket of two or more with a pivot a that covers it.

    A bucket's pivot is its member that meets most others over all buckets: the
    text that a group of copies was made from, if it is there. A member's home is
    the most met pivot of all its buckets. A bucket whose members share one home is
    covered by it; only the others need their own pivot.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(keys.join(sizes, "key"), "buckets")
    popular = members.groupBy("rep").agg(F.sum("n").alias("meets"))
    best = members.join(popular, "rep").groupBy("key").agg(F.max(F.struct("meets", (-F.col("rep")).alias("minus"))).alias("top"))
    placed = staged(members.select("key", "rep").join(best, "key"), "buckets")
    homes = staged(placed.groupBy("rep").agg((-F.max("top")["minus"]).alias("home")), "homes")
    mixed = placed.select("key", "rep").join(homes, "rep").groupBy("key").agg(F.min("home").alias("x"), F.max("home").alias("y")).where("x <> y").select("key")
    own = placed.join(mixed, "key", "left_semi").select((-F.col("top.minus")).alias("a"), F.col("rep").alias("b"))
    return own.union(homes.select("home", "rep")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest linked id), kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = staged(document_sets(docs, n), "sets")
    classes = staged(
        sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")),
        "classes",
    )
    met = staged(_pivot_pairs(chunk_keys(classes)), "pairs")
    crowd = met.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    lone = _plausible(met.join(crowd, "a", "left_anti"), classes, percent)
    first = staged(lone.unionByName(met.join(crowd, "a", "left_semi")), "pairs")
    needed = staged(first.select(F.col("a").alias("doc_id")).union(first.select("b")).distinct(), "needed")
    full = staged(_sets_of(docs, checked_ids(needed), n), "full")
    linked_by_sets = f"n_both > 0 AND n_both * 100 >= (na + nb - n_both) * {percent}"
    seen = staged(_compare(first, full, percent, with_added=True), "compared")
    joined = staged(components(seen.where(linked_by_sets).select("a", "b")), "groups")

    # Whoever is connected to its pivot needs no more comparison with the others that are. A stray s,
    # which is not, can link to another x of the pivot P's group only if both added a same shingle to
    # P's, or, sharing no added one, if x is smaller than P by what s lacks:
    # size(x) <= size(P) - (size(P or s) - size(P and s) / 0.8).
    of_a, of_b = (joined.select(F.col("id").alias(c), F.col("component_id").alias(f"of_{c}")) for c in "ab")
    seen = seen.join(of_a, "a", "left").join(of_b, "b", "left").withColumn("of_b", F.coalesce("of_b", "b"))
    apart = F.expr(f"NOT ({linked_by_sets})") & (F.coalesce("of_a", "a") != F.col("of_b"))
    seen = staged(seen.select("a", "b", "nb", "n_both", "of_b", "added", apart.alias("stray"), F.expr(f"n_both * 100 / {percent} - nb + n_both").alias("most")), "seen")
    strays = seen.where("stray")
    # each pair of strays once, none within a component, none of sizes too different
    once = f"b <> other AND of_b <> of_other AND (NOT other_stray OR b < other) AND least(nb, size) * 100 >= greatest(nb, size) * {percent}"
    others = seen.select(
        "a", F.col("b").alias("other"), F.col("of_b").alias("of_other"), F.col("stray").alias("other_stray"), F.col("nb").alias("size"), F.col("n_both").alias("other_both"), "added"
    )
    # Of the shingles that a linking pair shares, at most the smaller n_both lie in P, so c others are added
    # by both; the first of them stands c - 1 places or more before the end of either list of added ones.
    by_added = strays.select("a", "b", "nb", "n_both", "of_b", F.posexplode("added").alias("i", "shingle")).join(
        others.select("*", F.posexplode("added").alias("j", "shingle")).drop("added"), ["a", "shingle"]
    )
    c = f"greatest(1, ceil((nb + size) * {percent} / {100 + percent}D - least(n_both, other_both) - 1e-6))"
    by_added = by_added.where(f"{once} AND i + {c} <= nb - n_both AND j + {c} <= size - other_both")

    def size_bin(size) -> F.Column:
        return F.floor(F.log(1.05, size)).cast("int")

    least = F.ceil(F.col("nb") * percent / 100)
    smaller = strays.where(F.col("most") >= least).select(
        "a", "b", "nb", "of_b", "most", F.explode(F.sequence(size_bin(least), size_bin(F.col("most")))).alias("bin")
    )
    # a stray may be the smaller one of two strays as well, so here each order counts
    by_size = smaller.join(others.drop("added").withColumn("bin", size_bin(F.col("size"))), ["a", "bin"]).where(
        f"b <> other AND of_b <> of_other AND size <= most AND size * 100 >= nb * {percent}"
    )
    rest = by_added.select("b", "other").union(by_size.select("b", "other"))
    rest = rest.select(F.least("b", "other").alias("a"), F.greatest("b", "other").alias("b")).distinct()
    more = _compare(staged(_plausible(rest, classes, percent), "pairs"), full, percent).where(linked_by_sets).select("a", "b")

    groups = components(joined.select(F.col("component_id").alias("a"), F.col("id").alias("b")).union(more))
    of_class = classes.join(groups, F.col("rep") == F.col("id"), "left").select("s1", "s2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s GROUP BY ALL),
e AS (SELECT rep, unnest(sh) AS x FROM c),
d AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n_both FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
      WHERE a.x IN (SELECT x FROM d) GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
      WHERE 100 * n_both >= 80 * (na.n_shingles + nb.n_shingles - n_both)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT rep, rep FROM c),
r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
m AS (SELECT a AS rep, min(b) AS low FROM r GROUP BY 1)
SELECT s.doc_id, n_shingles,
       CASE WHEN n_shingles = 0 THEN s.doc_id ELSE m.low END AS component_id,
       (CASE WHEN n_shingles = 0 THEN s.doc_id ELSE m.low END) = s.doc_id AS kept
FROM s JOIN n USING (doc_id) JOIN c ON list_sort(s.sh) = c.sh JOIN m ON m.rep = c.rep
"""


@query("op3_minhash_near_dedup", SQL_OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2)
