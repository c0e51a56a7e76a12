"""The trained gate: gradients against finite differences, windows against a plain replay, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noisesift.operators import gate, weights

C, D, ETA = 3, 5, 0.5
SCORES = [("cola", 0.0, 1.0, 4, 2)]


def rows(n, seed, labels=C):
    rng = np.random.default_rng(seed)
    return [(k, [float(v) for v in rng.standard_normal(D)], int(rng.integers(labels)), float(rng.random())) for k in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, x array<double>, y int, cola double").repartition(3)


def plain(data, g, theta_val):
    """One step in NumPy: weights, proxy loss of the look-ahead as a function of the gate."""
    x, y = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    b = [s.bucket(np.array([r[3] for r in data])) for s in g.scores]
    inp = np.concatenate([g.class_emb[y], x, *(s.table[k] for s, k in zip(g.scores, b))], axis=1)
    return g.forward(inp)[0], x, y


def softmax_rows(theta, x, y):
    z = x @ theta.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    return p


def replay(aug, clean, val, g, steps, window, rate, clip):
    """The loop with derivatives of the gate by central differences."""
    theta, dw = np.zeros((C, D)), None
    mean = lambda th, data, w=1.0: (softmax_rows(th, *data) * np.reshape(w, (-1, 1))).T @ data[0] / len(data[1])
    arrays = lambda data: (np.array([r[1] for r in data]), np.array([r[2] for r in data]))
    ca, va = arrays(clean), arrays(val)
    for t in range(steps):
        w, x, y = plain(aug, g, None)
        ahead = theta - ETA * 0.5 * (mean(theta, (x, y), w) + mean(theta, ca))
        gv, gn = mean(theta, va), mean(ahead, va)
        meta = -(ETA * 0.5 / len(y)) * (softmax_rows(theta, x, y) * (x @ gn.T)).sum(axis=1)
        flat = np.concatenate([a.ravel() for a in g.arrays()])
        shapes = [a.shape for a in g.arrays()]

        def at(v):
            parts = np.split(v, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
            return g.with_arrays([p.reshape(s) for p, s in zip(parts, shapes)])

        grad = np.zeros_like(flat)
        for k in range(len(flat)):
            e = np.zeros_like(flat)
            e[k] = 1e-6
            grad[k] = meta @ (plain(aug, at(flat + e), None)[0] - plain(aug, at(flat - e), None)[0]) / 2e-6
        gamma = (1 - ETA) * np.sum(gn * gv) / np.sum(gv * gv)
        dw = grad if dw is None else grad + gamma * dw
        if (t + 1) % window == 0:
            norm = np.linalg.norm(dw)
            g = at(flat - rate * dw * (min(1.0, clip / norm) if clip else 1.0))
            dw = None
        theta = ahead
    return g, theta


@pytest.mark.parametrize("clip", [None, 1e-3])
def test_fit_equals_a_plain_replay(spark, clip):
    aug, clean, val = rows(60, 1), rows(30, 2), rows(25, 3)
    start = gate.formula_gate(C, D, hidden=(4, 3), emb=2, scores=SCORES)
    fit = gate.gate_fit(spark, frame(spark, aug), frame(spark, clean), frame(spark, val), start, C, D, 5, ETA, 50.0, 2, clip)
    want, theta = replay(aug, clean, val, start, 5, 2, 50.0, clip)
    for a, b, s in zip(fit.gate.arrays(), want.arrays(), start.arrays()):
        assert np.allclose(a, b, atol=1e-7)
    assert any(np.abs(a - s).max() > 1e-6 for a, s in zip(fit.gate.arrays(), start.arrays()))
    assert np.allclose(fit.theta, theta, atol=1e-9)
    got = np.array([r["w"] for r in fit.weights.orderBy("vec_id").collect()])
    assert np.allclose(got, plain(aug, want, None)[0], atol=1e-7)
    assert [r["step"] for r in fit.steps.where("name = 'gamma'").orderBy("step").collect()] == list(range(5))


def test_rows_without_label_features_or_score(spark):
    g = gate.formula_gate(C, D, hidden=(4,), emb=2, scores=SCORES)
    good = rows(20, 4)
    x = good[0][1]
    odd = [(90, x, None, 0.5), (91, x, 7, 0.5), (92, None, 1, 0.5), (93, [1.0], 1, 0.5), (94, x, 1, None), (95, x, 1, float("nan")), (96, x, 1, 9.0), (97, x, 1, -9.0)]
    got = {r["vec_id"]: r["weight"] for r in gate.gate_weight(frame(spark, good + odd), g).collect()}
    assert [got[k] for k in (90, 91, 92, 93)] == [None] * 4
    assert got[94] == got[95] and got[94] is not None
    edge = {r["vec_id"]: r["weight"] for r in gate.gate_weight(frame(spark, [(0, x, 1, 0.99), (1, x, 1, 0.0)]), g).collect()}
    assert (got[96], got[97]) == (edge[0], edge[1])
    clean, val = frame(spark, rows(10, 5)), frame(spark, rows(10, 6))
    a = gate.gate_fit(spark, frame(spark, good), clean, val, g, C, D, 2, ETA, 10.0)
    b = gate.gate_fit(spark, frame(spark, good + odd[:4]), clean, val, g, C, D, 2, ETA, 10.0)
    assert all(np.allclose(p, q) for p, q in zip(a.gate.arrays(), b.gate.arrays()))
    none = gate.gate_fit(spark, frame(spark, good), None, val.limit(0), g, C, D, 2, ETA, 10.0)
    assert all(np.array_equal(p, q) for p, q in zip(none.gate.arrays(), g.arrays()))


def test_gate_of_the_plain_parameters(spark):
    p = weights.formula_gate(C, D)
    df = frame(spark, rows(30, 7))
    a = gate.gate_weight(weights.instance_weight(df, p, out="a", method="builtin"), gate.Gate.of(p), out="b")
    assert a.where(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_clip():
    g = [np.array([3.0, 0.0]), np.array([[4.0]])]
    assert [a.tolist() for a in gate.clip_norm(g, 5.0)] == [a.tolist() for a in g]
    assert np.allclose(np.concatenate([a.ravel() for a in gate.clip_norm(g, 1.0)]), [0.6, 0, 0.8])
