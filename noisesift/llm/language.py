"""Language ID by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the 3- and 4-byte grams of its lower-cased words, with a
mark at either end of a word, hashed to ``BUCKETS`` rows of an embedding table; the
mean of its subwords' embeddings goes through a linear softmax. Embeddings and
softmax are trained by stochastic gradient descent in numpy. As the model is
linear, a text's logits are the mean of one small vector a subword, so the whole
of every text is scored by a table lookup.

Training texts come only from documents whose crc32(id) mod 3 is not 1 and whose
lang is known, a bounded sample of ``SAMPLE_DOCS`` of smallest id hash (documented
bound), and a run of ``TRAIN_GRAMS`` subwords at a random place of each is used
a step; scoring reads whole texts. A temperature, fitted on the tenth of the sample
kept out of training, calibrates the probabilities, and a score under the
``REJECT_SHARE`` quantile of the right answers there is marked as not accepted.

Defined results: null text, or text without a letter, is ``und`` with score 0; with
no training text everything is ``und``; repeated rows are scored once each; an empty
table gives an empty result. lang, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import hashed_sample, query, table
from noisesift.llm.minhash import _SPACE
from noisesift.llm.quality import blocks

SAMPLE_DOCS = 4000
TRAIN_GRAMS = 400
BUCKETS = 1 << 15
DIM = 16
EPOCHS = 6
REJECT_SHARE = 0.01
GRAMS = (3, 4)

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 32
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))  # the pattern also takes numbers like a superscript two


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of texts laid end to end, and each text's bounds among them."""
    # a space before every text, so a gram may start at a word's mark and none spans two texts
    bounds = np.concatenate([[0], ends])
    marked = np.insert(_FOLD[data], bounds, 32) if len(data) else np.full(len(bounds), 32, dtype=np.uint32)
    places = bounds + np.arange(len(bounds))
    gap = marked == 32
    out, where = [], []
    for k in GRAMS:
        n = len(marked) - k + 1
        if n <= 0:
            continue
        h = np.zeros(n, dtype=np.uint32)
        inner = np.zeros(n, dtype=bool)
        for j in range(k):
            h = h * np.uint32(0x01000193) + marked[j : j + n]
            if 0 < j < k - 1:
                inner |= gap[j : j + n]
        ok = np.flatnonzero(~inner & ~(gap[:n] & gap[k - 1 : k - 1 + n]))
        h = h[ok] * np.uint32(2654435761) + np.uint32(k)
        out.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64))
        where.append(ok)
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64)
    at = sum(np.searchsorted(w, places) for w in where)
    flat, spot = np.concatenate(out), np.concatenate(where)
    return flat[np.argsort(spot, kind="stable")], at


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray, float, float]:
    """(languages, logits by subword, temperature, least accepted score)."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32), 1.0, 0.0
    rng = np.random.default_rng(3)
    target = np.array([names.index(x) for x in langs])
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        bags.append(grams(raw, np.array([len(raw)]))[0])
    kept_out = np.arange(len(bags)) % 10 == 9
    table_ = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM
    head = np.zeros((DIM, len(names)))
    use = np.flatnonzero(~kept_out) if (~kept_out).any() else np.arange(len(bags))
    steps, total = 0, EPOCHS * len(use)
    for _ in range(EPOCHS):
        for i in rng.permutation(use):
            steps += 1
            bag = bags[i]
            if not len(bag):
                continue
            start = int(rng.integers(0, max(1, len(bag) - TRAIN_GRAMS + 1)))
            ids, n = np.unique(bag[start : start + TRAIN_GRAMS], return_counts=True)
            share = n / n.sum()
            mean = share @ table_[ids]
            miss = _softmax(mean @ head)
            miss[target[i]] -= 1
            rate = 0.5 * (1 - steps / (total + 1))
            back = head @ miss
            head -= rate * np.outer(mean, miss)
            # the gradient of a subword is its share of the mean's, spread as if alone
            table_[ids] -= rate * np.sqrt(share)[:, None] * back
    logits = (table_ @ head).astype(np.float32)
    z = np.array([logits[b].mean(axis=0) if len(b) else np.zeros(len(names)) for b in bags])
    held = np.flatnonzero(kept_out) if kept_out.any() else np.arange(len(bags))
    heats = np.geomspace(0.05, 5, 40)
    loss = [-np.log(_softmax(z[held] / h)[np.arange(len(held)), target[held]] + 1e-12).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(z[held] / heat)
    right = p.argmax(axis=1) == target[held]
    least = float(np.quantile(p.max(axis=1)[right], REJECT_SHARE)) if right.any() else 0.0
    return names, logits / np.float32(heat), heat, least


def _held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    known = docs.where(~F.coalesce(_held_out(id_col), F.lit(True)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = hashed_sample(known.withColumn("_lang", F.col(lang_col)), SAMPLE_DOCS, id_col, text_col, "_lang")
    rows = [r for r in rows if has_letter(r["t"])]
    return fit([r["t"] for r in rows], [r["_lang"] for r in rows])


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score, accepted."""
    names, logits, _, least = model
    shared = docs.sparkSession.sparkContext.broadcast(logits)  # BUCKETS x languages

    def run(batches):
        logits = shared.value
        for b in batches:
            pred: list[str] = []
            score = np.zeros(b.num_rows)
            for row, data, ends in blocks(b.column(1)):
                flat, at = grams(data, ends)
                n = np.diff(at)
                if names:
                    part = np.zeros((len(flat) + 1, len(names)))
                    np.cumsum(logits[flat], axis=0, dtype=np.float64, out=part[1:])
                    p = _softmax((part[at[1:]] - part[at[:-1]]) / np.maximum(n, 1)[:, None])
                    best = p.argmax(axis=1)
                for k in range(len(n)):
                    text = b.column(1)[row + k].as_py()
                    if not names or text is None or not has_letter(text):
                        pred.append("und")
                    else:
                        pred.append(names[best[k]])
                        score[row + k] = p[k, best[k]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array((score >= least) & (score > 0))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def in_training(doc_id: int | None) -> bool:
    """Whether a document may be learned from (the rule of the query, in Python)."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1
