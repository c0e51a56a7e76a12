"""Quality classifier: weak labellers, expectation-maximisation, a hashed linear scorer.

Ten overlapping heuristics vote good, bad or nothing on every document. The
votes of the whole corpus are counted by pattern (at most 3**10 patterns);
expectation-maximisation on those counts estimates each labeller's accuracy and
the share of good documents, without any true label, and gives every pattern
its posterior. The posteriors of a bounded sample (``SAMPLE_DOCS`` documents of
smallest id hash, a documented bound) train a linear scorer on hashed word
shapes, which scores every whole text; a document is rejected where its score is
under ``THRESHOLD``.

Defined results: null text counts as empty; a text without words has no shapes
and is rejected; repeated rows are scored once each; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import hashed_sample, query, table
from noisesift.llm.minhash import _SPACE, BLOCK_BYTES, word_hashes

SAMPLE_DOCS = 4000
BUCKETS = 1 << 16
THRESHOLD = 0.5
REPEAT = 0  # the bucket of a word that repeats the one before it
NOTHING, BAD, GOOD = 0, 1, 2
LABELLERS = ("case", "symbols", "cells", "repeats", "runs", "words", "lengths", "sentences", "echo", "variety")

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*!|<>{}[]~^\\=+@"]] = True
# a word's shape: letters by case, digits and white space by class, other ASCII as it is, the rest one class
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("0"), ord("a")
_SHAPE[_SPACE] = 32


def blocks(texts: pa.Array):
    """(first row, bytes, ends of the texts in them) for blocks of about ``BLOCK_BYTES``."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1))
        yield row, raw[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row]
        row = stop


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def votes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Votes of all labellers on texts laid end to end, one row a text."""
    bounds = np.concatenate([[0], ends])
    upper, lower, symbol = (_per_text(m[data], bounds) for m in (_UPPER, _LOWER, _SYMBOL))
    pipes, stops = _per_text(data == ord("|"), bounds), _per_text(data == ord("."), bounds)
    doubled = np.zeros(len(data), dtype=bool)
    if len(data):
        doubled[1:] = (data[1:] == data[:-1]) & _SYMBOL[data[1:]]
    doubled = _per_text(doubled, bounds)
    solid = _per_text(~_SPACE[data], bounds)
    words, at = word_hashes(data, ends)
    n = np.diff(at)
    some = np.maximum(n, 1)
    twins, thirds = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    if len(words) > 1:
        twins[1:] = words[1:] == words[:-1]
        thirds[2:] = twins[2:] * twins[1:-1]
    twins, thirds = _per_text(twins, at), _per_text(thirds, at)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.int64)
    chars = np.maximum(solid, 1)

    def vote(bad, good):
        return np.where(bad, BAD, np.where(good, GOOD, NOTHING))

    mean = solid / some
    cols = [
        vote(upper > 0.3 * np.maximum(upper + lower, 1), (upper < 0.1 * (upper + lower)) & (n >= 5)),
        vote(symbol > 0.08 * chars, (symbol < 0.02 * chars) & (n >= 5)),
        vote(pipes > 0.1 * some, np.zeros(len(n), dtype=bool)),
        vote((twins > 0.3 * some) & (n >= 5), (twins < 0.1 * some) & (n >= 20)),
        vote(doubled > 0.1 * some, (doubled < 0.01 * some) & (n >= 20)),
        vote(n < 1, n >= 10),
        vote((mean > 14) & (n >= 5), (mean > 2) & (mean < 9) & (n >= 5)),
        vote((stops < 0.005 * n) & (n >= 40), (stops > 0.02 * n) & (n >= 10)),
        vote((thirds > 0.2 * some) & (n >= 5), (thirds < 0.02 * some) & (n >= 20)),
        vote((distinct < 0.12 * n) & (n >= 20), (distinct > 0.3 * n) & (n >= 20)),
    ]
    return np.stack(cols, axis=1).astype(np.int64)


# what is believed of a labeller before any count, by class: a bad vote on a good document is rare
PRIOR_VOTES = np.array([[0.01, 0.5, 0.5], [0.01, 0.01, 1.0]])
_PLACES = 3 ** np.arange(len(LABELLERS))


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over vote patterns: posterior of good for each, the labellers' vote shares by class, share of good."""
    patterns = np.array(sorted(counts), dtype=np.int64)
    if not len(patterns):
        return {}, np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    n = np.array([counts[int(p)] for p in patterns], dtype=float)
    v = patterns[:, None] // _PLACES % 3
    one_hot = np.stack([v == k for k in range(3)], axis=2).astype(float)
    one_hot[:, :, NOTHING] = 0  # an abstention says nothing about the class
    lean = 1 + (v == GOOD).sum(axis=1) - 2.0 * len(LABELLERS) * (v == BAD).sum(axis=1)
    post = 1 / (1 + np.exp(-lean))
    shares, prior = np.zeros((2, len(LABELLERS), 3)), 0.5
    for _ in range(rounds):
        for c, q in enumerate((1 - post, post)):
            got = np.einsum("p,plk->lk", n * q, one_hot) + PRIOR_VOTES[c] * 0.02 * n.sum()
            shares[c] = got / got.sum(axis=1, keepdims=True)
        prior = float(((n * post).sum() + 1) / (n.sum() + 2))
        like = np.einsum("plk,clk->pc", one_hot, np.log(shares)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return {int(p): float(q) for p, q in zip(patterns, post, strict=True)}, shares, prior


def shapes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' run-collapsed shapes, and each text's bounds among them."""
    shape = _SHAPE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    firsts = ends[:-1][ends[:-1] < len(data)]
    keep[firsts] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    # lower and upper case must stay apart in the word hash, which folds A-Z
    marks = np.where(shape[keep] == ord("A"), 1, shape[keep]).astype(np.uint8)
    words, at = word_hashes(marks, kept_before[ends])
    bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
    spelled, _ = word_hashes(data, ends)
    if len(bucket) > 1:
        bucket[1:][spelled[1:] == spelled[:-1]] = REPEAT
    return bucket, at


def fit(texts: list[str], targets: np.ndarray, epochs: int = 6, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Logistic regression on mean hashed shapes by stochastic gradient steps, to soft targets."""
    w, bias = np.zeros(BUCKETS), 0.0
    rows = []
    for text in texts:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        idx, _ = shapes(raw, np.array([len(raw)]))
        ids, n = np.unique(idx, return_counts=True)
        rows.append((ids, n / max(1, n.sum())))
    rng = np.random.default_rng(5)
    for epoch in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, x = rows[k]
            miss = targets[k] - 1 / (1 + np.exp(-(bias + w[ids] @ x)))
            step = rate / (1 + epoch)
            w[ids] += step * miss * x
            bias += 0.01 * step * miss
    return w, bias


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(weights, bias, posteriors by pattern, vote shares, share of good) of a table."""

    def run(batches):
        found: dict[int, int] = {}
        for b in batches:
            for _, data, ends in blocks(b.column(0)):
                for p, n in zip(*np.unique(votes(data, ends) @ _PLACES, return_counts=True), strict=True):
                    found[int(p)] = found.get(int(p), 0) + int(n)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select(text_col).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r["pattern"]: r["n"] for r in counted.collect()}  # at most 3**10 rows
    posterior, shares, prior = estimate(counts)
    sample = hashed_sample(docs, SAMPLE_DOCS, id_col, text_col)
    texts = [r["t"] for r in sample]
    targets = []
    for t in texts:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        targets.append(posterior[int((votes(raw, np.array([len(raw)])) @ _PLACES)[0])])
    w, bias = fit(texts, np.array(targets))
    return w, bias, posterior, shares, prior


def classify(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: ``carry`` columns, ``posterior``, ``score`` and ``kept``."""
    w, bias, posterior, *_ = model or train(docs, id_col, text_col)
    kept = [F.col(f"`{c}`") for c in carry]
    fields = docs.select(*kept).schema if carry else []
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)

    def run(batches):
        for b in batches:
            score, post = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for row, data, ends in blocks(b.column(0)):
                idx, at = shapes(data, ends)
                total = np.concatenate([[0.0], np.cumsum(w[idx])])
                n = np.diff(at)
                z = bias + (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
                score[row : row + len(n)] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0)
                post[row : row + len(n)] = [posterior.get(int(p), 0.5) for p in votes(data, ends) @ _PLACES]
            cols = [*b.columns[1:], pa.array(post), pa.array(score), pa.array(score >= THRESHOLD)]
            yield pa.RecordBatch.from_arrays(cols, names=[*carry, "_posterior", "_score", "_kept"])

    scored = docs.select(F.col(text_col).alias("_text"), *kept).mapInArrow(run, ddl + "_posterior double, _score double, _kept boolean")
    return scored


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected documents; same columns."""
    return classify(docs, id_col=id_col, text_col=text_col, carry=tuple(docs.columns)).where("_kept").select(*[f"`{c}`" for c in docs.columns])


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, carry=("doc_id",)).select(
        "doc_id", F.col("_posterior").alias("posterior"), F.col("_score").alias("score"), F.col("_kept").alias("kept")
    )
