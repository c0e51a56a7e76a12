"""Column -> Column numeric and vector helpers.

Vectors are ``array<double>``; all helpers are built-in higher-order
functions, so they run in the JVM next to the scan. Cast ``array<float>`` to
``array<double>`` before arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def score_bucket(x: str | Column, lo: float, hi: float, n: int) -> Column:
    """F8. ``trunc((x - lo) / ((hi - lo) / n))`` (toward zero; not ``width_bucket``)."""
    width = (hi - lo) / n
    return ((_c(x) - F.lit(lo)) / F.lit(width)).cast("long")


def dot(a: str | Column, b: str | Column) -> Column:
    """F10. Inner product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: str | Column, eps: float = EPS) -> Column:
    """F9. ``v / max(||v||, eps)``."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(_c(v), lambda x: x / n)


def logsumexp(v: str | Column) -> Column:
    """F11. ``log(sum(exp(v)))`` in one pass with a running maximum (the input is
    referenced once, so an expensive array expression is evaluated once per row)."""
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("s"))

    return F.aggregate(_c(v), init, step, lambda acc: acc["m"] + F.log(acc["s"]))


def log_softmax(v: str | Column) -> Column:
    """F11. For an expensive ``v`` stage it in a column first (see ``with_softmax``)."""
    lse = logsumexp(v)
    return F.transform(_c(v), lambda x: x - lse)


def softmax(v: str | Column) -> Column:
    """F11. For an expensive ``v`` stage it in a column first (see ``with_softmax``)."""
    lse = logsumexp(v)
    return F.transform(_c(v), lambda x: F.exp(x - lse))


def with_softmax(df, src: str, out: str, log: bool = False):
    """F11 staged: the normaliser is computed once per row in its own column, so the
    element-wise pass does not re-evaluate it per element."""
    x = df.withColumn("__lse", logsumexp(src))
    f = (lambda v: v - F.col("__lse")) if log else (lambda v: F.exp(v - F.col("__lse")))
    return x.withColumn(out, F.transform(src, f)).drop("__lse")


def argmax(v: str | Column) -> Column:
    """F12. 0-based index of the first maximum."""
    return (F.array_position(_c(v), F.array_max(_c(v))) - 1).cast("int")


def sigmoid(x: str | Column) -> Column:
    """F13."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def relu(x: str | Column) -> Column:
    """F13."""
    return F.greatest(_c(x), F.lit(0.0))


def affine(weights: list[list[float]], bias: list[float], x: str | Column) -> Column:
    """F13. ``W x + b`` for a small literal ``W`` (rows = outputs)."""
    outs = [dot(F.array(*[F.lit(float(w)) for w in row]), x) + F.lit(float(b)) for row, b in zip(weights, bias)]
    return F.array(*outs)


def affine_col(w: str | Column, b: str | Column, x: str | Column) -> Column:
    """F13. ``W x + b`` with ``W array<array<double>>`` and ``b array<double>`` columns (broadcast params)."""
    return F.zip_with(F.transform(_c(w), lambda row: dot(row, x)), _c(b), lambda u, v: u + v)
