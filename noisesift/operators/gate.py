"""The trained gate (J1 in full, J10, J11's clip, J15).

A gate weighs a row by its label and features: embeddings of the label and of bucketed
scores beside the feature vector, any number of hidden layers, a sigmoid output
(``Gate``). It is trained by looking one step of the head ahead: how the loss on held-out
rows after the step moves with each row's weight (J10) is carried back through the gate.
Per task one array of the gate's size leaves, added up in Spark; data never reaches the
driver, which holds the gate, the head and their gradients only. Parameters go to the
tasks as broadcasts.

A row without a label, with a label the gate does not know or without features has no
weight (null) and takes no part in training. A score that is null or NaN adds a zero embedding, one
outside its range the nearest bucket's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.operators.weights import GateParams
from noisesift.session import scratch_dir


@dataclass
class ScoreTable:
    """Embeddings of a score column cut into equal buckets of ``[lo, hi)`` (F8)."""

    col: str
    lo: float
    hi: float
    table: np.ndarray  # [buckets, e]

    def bucket(self, values: np.ndarray) -> np.ndarray:
        """Bucket numbers, -1 where there is no score."""
        n = len(self.table)
        known = ~np.isnan(values)
        at = np.trunc((np.where(known, values, self.lo) - self.lo) / ((self.hi - self.lo) / n))
        return np.where(known, np.clip(at, 0, n - 1), -1).astype(int)


@dataclass
class Gate:
    """``sigmoid(Wn relu(... relu(W1 [emb(y); x; scores] + b1) ...) + bn) * scale``, one output."""

    class_emb: np.ndarray  # [C, e]
    layers: list[tuple[np.ndarray, np.ndarray]]  # (W [out, in], b [out]), the last one with one output
    scale: float = 1.0
    scores: list[ScoreTable] = field(default_factory=list)

    @classmethod
    def of(cls, p: GateParams) -> Gate:
        if p.w2.shape[0] != 1:
            raise ValueError("only a gate of one output can be trained")
        return cls(p.class_emb, [(p.w1, p.b1), (p.w2, p.b2)], p.scale)

    def arrays(self) -> list[np.ndarray]:
        return [self.class_emb, *(a for layer in self.layers for a in layer), *(s.table for s in self.scores)]

    def with_arrays(self, arrays: Sequence[np.ndarray]) -> Gate:
        k = 1 + 2 * len(self.layers)
        layers = [(arrays[i], arrays[i + 1]) for i in range(1, k, 2)]
        return replace(self, class_emb=arrays[0], layers=layers, scores=[replace(s, table=t) for s, t in zip(self.scores, arrays[k:], strict=True)])

    def columns(self, df: DataFrame, x: str, y: str) -> list:
        return [F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"),
                *(F.col(s.col).cast("double").alias(f"s{k}") for k, s in enumerate(self.scores))]

    def inputs(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rows that can be weighed, their input, labels and buckets."""
        dim = self.layers[0][0].shape[1] - self.class_emb.shape[1] - sum(s.table.shape[1] for s in self.scores)
        y = pdf["y"].to_numpy(float)
        ok = np.array([v is not None and len(v) == dim for v in pdf["x"]], dtype=bool)
        ok &= (y >= 0) & (y < len(self.class_emb))  # also false for NaN
        y = y[ok].astype(int)
        x = np.stack(pdf["x"].to_numpy()[ok]) if ok.any() else np.zeros((0, dim))
        buckets = [s.bucket(pdf[f"s{k}"].to_numpy(float)[ok]) for k, s in enumerate(self.scores)]
        parts = [np.where(b[:, None] >= 0, s.table[np.maximum(b, 0)], 0.0) for s, b in zip(self.scores, buckets, strict=True)]
        return ok, np.concatenate([self.class_emb[y], x, *parts], axis=1), y, buckets

    def forward(self, inputs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Weights, and the input of each layer."""
        ins = [inputs]
        for w, b in self.layers[:-1]:
            ins.append(np.maximum(ins[-1] @ w.T + b, 0.0))
        w, b = self.layers[-1]
        return self.scale / (1.0 + np.exp(-(ins[-1] @ w.T + b)[:, 0])), ins

    def backward(self, coef: np.ndarray, weight: np.ndarray, ins: list[np.ndarray], y: np.ndarray, buckets: list[np.ndarray]) -> list[np.ndarray]:
        """Sum over rows of ``coef`` times the weight's derivative by each of ``arrays()``."""
        d = (coef * weight * (1 - weight / self.scale))[:, None]
        grads: list[np.ndarray] = []
        for k in range(len(self.layers) - 1, -1, -1):
            grads[:0] = [d.T @ ins[k], d.sum(axis=0)]
            d = d @ self.layers[k][0]
            if k:
                d = d * (ins[k] > 0)
        e = self.class_emb.shape[1]
        emb = np.zeros_like(self.class_emb)
        np.add.at(emb, y, d[:, :e])
        at, tables = d.shape[1] - sum(s.table.shape[1] for s in self.scores), []
        for s, b in zip(self.scores, buckets, strict=True):
            g = np.zeros_like(s.table)
            np.add.at(g, b[b >= 0], d[b >= 0, at : at + s.table.shape[1]])
            tables.append(g)
            at += s.table.shape[1]
        return [emb, *grads, *tables]


def formula_gate(n_classes: int, dim: int, hidden: Sequence[int] = (8,), emb: int = 4, scale: float = 2.0, scores: Sequence[tuple[str, float, float, int, int]] = ()) -> Gate:
    """Parameters from an index rule (shared with the SQL oracle); ``scores``: (column, lo, hi, buckets, embedding size)."""

    def f(n: int, m: int, salt: int) -> np.ndarray:
        return ((np.arange(n * m).reshape(n, m) * 37 + salt) % 101 - 50) / 500.0

    sizes = [emb + dim + sum(s[4] for s in scores), *hidden, 1]
    layers = [(f(b, a, 7 + 6 * k), f(1, b, 11 + 6 * k)[0]) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))]
    return Gate(f(n_classes, emb, 3), layers, scale, [ScoreTable(c, lo, hi, f(n, e, 5 + k)) for k, (c, lo, hi, n, e) in enumerate(scores)])


def gate_weight(df: DataFrame, gate: Gate, x: str = "x", y: str = "y", out: str = "weight") -> DataFrame:
    """J1 with score embeddings and any depth: one matrix product a layer per Arrow batch."""
    sent = df.sparkSession.sparkContext.broadcast(gate)

    @F.pandas_udf("double")
    def weigh(row: pd.DataFrame) -> pd.Series:
        ok, inputs, _, _ = sent.value.inputs(row)
        found = np.full(len(row), np.nan)
        found[ok] = sent.value.forward(inputs)[0]
        return pd.Series(found).astype("Float64").where(ok)

    return df.withColumn(out, weigh(F.struct(*gate.columns(df, x, y))))


def _residuals(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """softmax(theta x) minus the one-hot label, a row each."""
    z = x @ theta.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1.0
    return p


def _added(df: DataFrame, sums, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Run ``sums(pdf) -> {name: array}`` over all batches; one array a task and name, added up in Spark."""

    def partials(batches):
        acc = {n: np.zeros(k) for n, k in sizes.items()}
        for pdf in batches:
            for n, v in sums(pdf).items():
                acc[n] += v
        yield pd.DataFrame({"name": list(acc), "g": list(acc.values())})

    cells = df.mapInPandas(partials, "name string, g array<double>").select("name", F.posexplode("g").alias("at", "g"))
    out = {n: np.zeros(k) for n, k in sizes.items()}
    for r in cells.groupBy("name", "at").agg(F.sum("g").alias("g")).collect():  # model-sized
        out[r["name"]][r["at"]] = r["g"]
    return out


def clip_norm(grads: list[np.ndarray], most: float) -> list[np.ndarray]:
    """J11. All arrays scaled by one factor so that their common norm is ``most`` at the highest."""
    norm = float(np.sqrt(sum(np.sum(g * g) for g in grads)))
    return [g * (most / norm) for g in grads] if norm > most else grads


@dataclass
class GateFit:
    gate: Gate
    theta: np.ndarray  # [classes, dim]
    weights: DataFrame  # the augmented rows with ``w`` of the trained gate
    steps: DataFrame  # step, name, value: gamma, norm (of the carried gradient), stepped


def gate_fit(spark: SparkSession, aug: DataFrame, clean: DataFrame | None, val: DataFrame, gate: Gate, n_classes: int, dim: int,
             steps: int, eta: float = 0.5, gate_rate: float = 1.0, gradient_steps: int = 1, clip: float | None = 5.0,
             theta: np.ndarray | None = None, x: str = "x", y: str = "y") -> GateFit:
    """J15 with J10 on the gate.

    Each step: the head (linear softmax, SGD) looks one step ahead, ``theta' = theta - eta *
    grad[(mean(w l)_aug + mean(l)_clean) / 2]`` with the gate's weights; ``meta_grad_i = -(eta / 2N)
    <grad l_i(theta), grad L_val(theta')>`` is carried back through the gate and added up over
    the rows to ``g``; ``dw = g + gamma * dw`` of the step before, with ``gamma = (1 - eta) <g'_val,
    g_val> / |g_val|^2``. Every ``gradient_steps`` steps the gate moves by ``-gate_rate * dw`` (of norm
    ``clip`` at most) and ``dw`` starts from zero again. The head then takes its step. Without
    ``clean`` the blend is the weighted loss alone. An empty ``val`` gives zero gradients: the gate stays.

    The rows' features are written once to the shared folder; a step is three passes over them.
    """
    half = 0.5 if clean is not None else 1.0
    theta = np.zeros((n_classes, dim)) if theta is None else theta.copy()
    parts = [(aug, "aug"), (val, "val")] + ([(clean, "clean")] if clean is not None else [])
    for df, part in parts:
        cols = gate.columns(df, x, y) if part == "aug" else [F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")]
        df.select(*cols).write.parquet(base := scratch_dir(spark, f"gate-{part}"))
        parts[parts.index((df, part))] = (spark.read.parquet(base), part)
    rows = {part: df for df, part in parts}
    blank = Gate(np.zeros((n_classes, 0)), [(np.zeros((1, dim)), np.zeros(1))])  # reads plain rows

    def head_sums(at: np.ndarray, weighing: Gate | None):
        sent = spark.sparkContext.broadcast((at, weighing or blank))

        def sums(pdf):
            th, g = sent.value
            ok, inputs, labels, _ = g.inputs(pdf)
            if not ok.any():
                return {}
            xs = np.stack(pdf["x"].to_numpy()[ok])
            r = _residuals(th, xs, labels)
            w = g.forward(inputs)[0] if weighing is not None else np.ones(len(xs))
            return {"g": ((r * w[:, None]).T @ xs).ravel(), "n": float(len(xs))}

        return sums

    def gradient(part: str, at: np.ndarray, weighing: Gate | None = None) -> tuple[np.ndarray, int]:
        found = _added(rows[part], head_sums(at, weighing), {"g": n_classes * dim, "n": 1})
        n = int(found["n"][0])
        return found["g"].reshape(n_classes, dim) / max(n, 1), n

    g_val, _ = gradient("val", theta)
    carried: list[np.ndarray] | None = None
    log: list[tuple[int, str, float]] = []
    for t in range(steps):
        g_train, n_aug = gradient("aug", theta, gate)
        g_train = half * g_train
        if clean is not None:
            g_train = g_train + half * gradient("clean", theta)[0]
        ahead = theta - eta * g_train
        g_next, _ = gradient("val", ahead)
        sent = spark.sparkContext.broadcast((theta, g_next, gate, -eta * half / max(n_aug, 1)))

        def gate_sums(pdf, sent=sent):
            th, gn, g, factor = sent.value
            ok, inputs, labels, buckets = g.inputs(pdf)
            if not ok.any():
                return {}
            xs = np.stack(pdf["x"].to_numpy()[ok])
            meta = factor * (_residuals(th, xs, labels) * (xs @ gn.T)).sum(axis=1)
            weight, ins = g.forward(inputs)
            return {"g": np.concatenate([a.ravel() for a in g.backward(meta, weight, ins, labels, buckets)])}

        shapes = [a.shape for a in gate.arrays()]
        flat = _added(rows["aug"], gate_sums, {"g": sum(int(np.prod(s)) for s in shapes)})["g"]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        g_gate = [a.reshape(s) for a, s in zip(np.split(flat, cuts), shapes, strict=True)]
        norm = float(np.sum(g_val * g_val))
        gamma = float((1 - eta) * np.sum(g_next * g_val) / norm) if norm > 0 else 0.0
        carried = g_gate if carried is None else [a + gamma * b for a, b in zip(g_gate, carried, strict=True)]
        log += [(t, "gamma", gamma), (t, "norm", float(np.sqrt(sum(np.sum(a * a) for a in carried))))]
        if (t + 1) % gradient_steps == 0:
            moved = carried if clip is None else clip_norm(carried, clip)
            gate = gate.with_arrays([a - gate_rate * g for a, g in zip(gate.arrays(), moved, strict=True)])
            carried = None
        theta, g_val = ahead, g_next  # the look-ahead is the head's own step, so its gradient serves the next one
    done = gate_weight(aug, gate, x, y, "w")
    return GateFit(gate, theta, done, spark.createDataFrame(log, "step int, name string, value double"))
