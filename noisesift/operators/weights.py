"""Instance weights and their meta-gradients.

Neural training is re-aimed as distributed jobs over a feature column
(``array<double>``): a small gate (J1) scores every row with broadcast
parameters, and the look-ahead meta-gradient (J10) of a linear softmax head is
two gradient aggregations (partial per task, ``classes x dim`` values at the
end) plus a row-wise dot. Driver loops only ever hold model-sized arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.functions.metrics import cross_entropy
from noisesift.functions.vectors import dot, logsumexp, relu, sigmoid, with_softmax
from noisesift.session import scratch_dir


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matrix_lit(m: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in np.atleast_2d(m)])


def vector_lit(v: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in np.ravel(v)])


# ----------------------------------------------------------------- J1 gate
@dataclass
class GateParams:
    """``sigmoid(W2 relu(W1 [emb(y); x] + b1) + b2) * scale``; one output, or one per class."""

    class_emb: np.ndarray  # [C, e]
    w1: np.ndarray  # [h, e + dim]
    b1: np.ndarray  # [h]
    w2: np.ndarray  # [out, h]
    b2: np.ndarray  # [out]
    scale: float = 1.0


def formula_gate(n_classes: int, dim: int, hidden: int = 8, emb: int = 4, outputs: int = 1, scale: float = 2.0) -> GateParams:
    """Deterministic parameters from an index rule (shared with the SQL oracle)."""

    def f(n: int, m: int, salt: int) -> np.ndarray:
        k = np.arange(n * m).reshape(n, m)
        return ((k * 37 + salt) % 101 - 50) / 500.0

    return GateParams(f(n_classes, emb, 3), f(hidden, emb + dim, 7), f(1, hidden, 11)[0], f(outputs, hidden, 13), f(1, outputs, 17)[0], scale)


GATE_BUILTIN_CELLS = 20_000  # W1 entries above which the Arrow path is used


def instance_weight(df: DataFrame, p: GateParams, x: str = "x", y: str = "y", out: str = "weight",
                    method: str = "auto") -> DataFrame:
    """J1. Gate forward; dropout off. ``builtin``: parameters as plan literals and
    higher-order functions; ``arrow``: two matrix products per Arrow batch; ``auto``:
    arrow when ``W1`` has more than ``GATE_BUILTIN_CELLS`` entries."""
    if method == "auto":
        method = "arrow" if p.w1.size > GATE_BUILTIN_CELLS else "builtin"
    if method == "arrow":
        return instance_weight_arrow(df, p, x, y, out)
    emb = F.element_at(matrix_lit(p.class_emb), (F.col(y) + 1).cast("int"))
    inp = F.concat(emb, _c(x))
    hidden = F.array(*[relu(dot(vector_lit(p.w1[h]), inp) + F.lit(float(p.b1[h]))) for h in range(p.w1.shape[0])])
    outs = [sigmoid(dot(vector_lit(p.w2[o]), hidden) + F.lit(float(p.b2[o]))) * F.lit(p.scale) for o in range(p.w2.shape[0])]
    return df.withColumn(out, outs[0] if len(outs) == 1 else F.array(*outs))


def instance_weight_arrow(df: DataFrame, p: GateParams, x: str = "x", y: str = "y", out: str = "weight") -> DataFrame:
    """J1 fast path for wide vectors: an Arrow-batched ``pandas_udf`` doing the gate as
    two matrix products per batch (parameters travel once per task in the closure)."""
    single = p.w2.shape[0] == 1

    @F.pandas_udf("double" if single else "array<double>")
    def gate(xs: pd.Series, ys: pd.Series) -> pd.Series:
        xm = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, p.w1.shape[1] - p.class_emb.shape[1]))
        inp = np.concatenate([p.class_emb[ys.to_numpy().astype(int)], xm], axis=1)
        h = np.maximum(inp @ p.w1.T + p.b1, 0.0)
        o = 1.0 / (1.0 + np.exp(-(h @ p.w2.T + p.b2))) * p.scale
        return pd.Series(o[:, 0]) if single else pd.Series(list(o))

    return df.withColumn(out, gate(_c(x), _c(y)))


# ----------------------------------------------------------------- J2, J3, J12
def weighted_loss(aug: DataFrame, clean: DataFrame | None, w: str = "w", loss: str = "loss") -> DataFrame:
    """J2. One row: ``mean(w*l)`` and ``mean(l)`` of the augmented rows (paired by row, X4),
    the clean mean, and the blend ``(weighted_aug + clean) / 2``."""
    none = F.lit(None).cast("double")
    rows = aug.select((F.col(w) * F.col(loss)).cast("double").alias("x"), F.col(loss).cast("double").alias("a"), none.alias("c"))
    if clean is not None:
        rows = rows.unionByName(clean.select(none.alias("x"), none.alias("a"), F.col(loss).cast("double").alias("c")))
    out = rows.agg(F.avg("x").alias("weighted_aug_loss"), F.avg("a").alias("aug_loss"), F.avg("c").alias("clean_loss"))
    if clean is None:
        return out.drop("clean_loss").withColumn("blend", F.col("weighted_aug_loss"))
    return out.withColumn("blend", (F.col("weighted_aug_loss") + F.col("clean_loss")) / 2)


def logit_weighted_loss(logits: str | Column, weights: str | Column, y: str | Column) -> Column:
    """J3. Per-class weights multiply the logits, then cross-entropy."""
    scaled = F.zip_with(_c(logits), _c(weights), lambda z, v: z * v)
    return cross_entropy(scaled, y)


def weight_ranking_loss(df: DataFrame, p: GateParams, x: str = "x", y: str = "y") -> DataFrame:
    """J12. Gate warm-up losses: score with the label and with the flipped label ``1-y``;
    ``rank_loss = -sum(w+ - w-)`` and ``ce_loss`` = mean 2-way cross-entropy on
    ``[w-, w+]`` with target 1."""
    pos = instance_weight(df, p, x, y, "__wp")
    both = instance_weight(pos.withColumn("__yf", F.lit(1) - F.col(y)), p, x, "__yf", "__wn")
    two = F.array(F.col("__wn"), F.col("__wp"))
    return both.agg(
        (-F.sum(F.col("__wp") - F.col("__wn"))).alias("rank_loss"),
        F.avg(logsumexp(two) - F.col("__wp")).alias("ce_loss"),
    )


# ----------------------------------------------------------------- J10 / J11
def with_logits(df: DataFrame, theta: np.ndarray, x: str, out: str = "__z") -> DataFrame:
    """Linear head ``theta x`` staged in its own column (evaluated once per row)."""
    return df.withColumn(out, F.transform(matrix_lit(theta), lambda row: dot(row, x)))


def with_probs(df: DataFrame, theta: np.ndarray, x: str, out: str = "__p") -> DataFrame:
    return with_softmax(with_logits(df, theta, x, "__z"), "__z", out).drop("__z")


def softmax_grad(df: DataFrame, theta: np.ndarray, x: str = "x", y: str = "y", coef: Column | None = None,
                 with_count: bool = False):
    """Sum over rows of ``coef * (softmax(theta x) - onehot(y)) (x) x`` as a [C, D] array.

    Each task turns its Arrow batches into one ``(P - Y)^T X`` partial (NumPy),
    emitting C*D cells per task; a final aggregate sums the partials and only
    C*D values reach the driver. (``softmax_grad_cells`` is the same sum with
    built-ins only, used as a cross-check.) ``with_count`` also returns the row
    count, carried in the same pass.
    """
    c_, d_ = theta.shape
    base = df.select(F.col(x).alias("x"), F.col(y).cast("long").alias("y"),
                     (coef if coef is not None else F.lit(1.0)).cast("double").alias("coef"))

    def partials(batches):
        acc = np.zeros((c_, d_))
        seen, rows = False, 0
        for pdf in batches:
            if pdf.empty:
                continue
            rows += len(pdf)
            xm = np.stack(pdf["x"].to_numpy())
            z = xm @ theta.T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pdf)), pdf["y"].to_numpy()] -= 1.0
            acc += (p * pdf["coef"].to_numpy()[:, None]).T @ xm
            seen = True
        if seen:
            cc, dd = np.meshgrid(np.arange(c_), np.arange(d_), indexing="ij")
            yield pd.DataFrame({"c": np.append(cc.ravel(), -1), "d": np.append(dd.ravel(), -1), "g": np.append(acc.ravel(), float(rows))})

    cells = base.mapInPandas(partials, "c long, d long, g double").groupBy("c", "d").agg(F.sum("g").alias("g")).collect()
    g = np.zeros((c_, d_))
    n = 0
    for row in cells:
        if row["c"] < 0:
            n = int(round(row["g"]))
        else:
            g[row["c"], row["d"]] = row["g"]
    return (g, n) if with_count else g


def softmax_grad_cells(df: DataFrame, theta: np.ndarray, x: str = "x", y: str = "y", coef: Column | None = None) -> np.ndarray:
    """``softmax_grad`` with built-in expressions only: residuals and features are
    exploded into ``(c, d)`` cells and summed by a partial aggregate."""
    c_, d_ = theta.shape
    base = df.select(F.col(x).alias("__x"), F.col(y).alias("__y"), (coef if coef is not None else F.lit(1.0)).alias("__coef"))
    pr = with_probs(base, theta, "__x")
    r = F.transform("__p", lambda pc, c: (pc - F.when(c == F.col("__y"), F.lit(1.0)).otherwise(F.lit(0.0))) * F.col("__coef"))
    e = pr.select(F.posexplode(r).alias("c", "rc"), "__x")
    e = e.select("c", "rc", F.posexplode("__x").alias("d", "xd"))
    cells = e.groupBy("c", "d").agg(F.sum(F.col("rc") * F.col("xd")).alias("g")).collect()  # C*D rows
    g = np.zeros((c_, d_))
    for row in cells:
        g[row["c"], row["d"]] = row["g"]
    return g


def mean_ce(df: DataFrame, theta: np.ndarray, x: str = "x", y: str = "y") -> float:
    z = with_logits(df.select(x, y), theta, x)
    return z.agg(F.avg(cross_entropy("__z", y))).first()[0]


@dataclass
class MetaStep:
    theta_next: np.ndarray
    g_val: np.ndarray
    g_val_next: np.ndarray
    gamma: float
    influence: DataFrame  # aug rows + dot_val, meta_grad


def meta_influence(aug: DataFrame, clean: DataFrame | None, val: DataFrame, theta: np.ndarray, eta: float,
                   w: str = "w", x: str = "x", y: str = "y") -> MetaStep:
    """J10. One look-ahead step of a linear softmax head (SGD, identity Hessian).

    ``theta' = theta - eta * grad[(mean(w l)_aug + mean(l)_clean) / 2]``;
    per augmented row ``dot_val = <grad l_i(theta), grad L_val(theta')>`` and
    ``meta_grad = -(eta / (2 N_aug)) * dot_val`` (without a clean part the blend
    is the weighted loss alone and the factor is ``eta / N_aug``);
    ``gamma = (1 - eta) <g'_val, g_val> / |g_val|^2``.
    """
    g_val, n_val = softmax_grad(val, theta, x, y, with_count=True)
    g_val = g_val / max(n_val, 1)
    half = 0.5 if clean is not None else 1.0
    g_aug, n_aug = softmax_grad(aug, theta, x, y, F.col(w), with_count=True)
    g_train = half * g_aug / max(n_aug, 1)
    if clean is not None:
        g_clean, n_clean = softmax_grad(clean, theta, x, y, with_count=True)
        g_train = g_train + half * g_clean / max(n_clean, 1)
    theta_next = theta - eta * g_train
    g_next = softmax_grad(val, theta_next, x, y) / max(n_val, 1)
    nrm = float(np.sum(g_val * g_val))
    gamma = float((1 - eta) * np.sum(g_next * g_val) / nrm) if nrm > 0 else 0.0
    staged = with_probs(aug, theta, x, "__p").withColumn("__gx", F.transform(matrix_lit(g_next), lambda row: dot(row, x)))
    resid = F.transform("__p", lambda pc, c: pc - F.when(c == F.col(y), F.lit(1.0)).otherwise(F.lit(0.0)))
    dv = F.aggregate(F.zip_with(resid, F.col("__gx"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    infl = staged.withColumn("dot_val", dv).drop("__p", "__gx") \
        .withColumn("meta_grad", -F.lit(eta * half / max(n_aug, 1)) * F.col("dot_val"))
    return MetaStep(theta_next, g_val, g_next, gamma, infl)


def meta_influence_fd(aug: DataFrame, g_val_next: np.ndarray, theta: np.ndarray, eta: float, n_aug: int,
                      eps: float = 1e-6, blended: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """J11. The same derivative by central difference: ``theta +- eps * g'_val``;
    ``meta_grad = -eta * half / N * (l_i(theta+) - l_i(theta-)) / (2 eps)`` (the -eta
    factor kept, X16). Three broadcast parameter sets, one row-wise pass."""
    half = 0.5 if blended else 1.0
    z = with_logits(with_logits(aug, theta + eps * g_val_next, x, "__zp"), theta - eps * g_val_next, x, "__zm")
    fd = (cross_entropy("__zp", y) - cross_entropy("__zm", y)) / F.lit(2 * eps)
    return z.withColumn("dot_val_fd", fd).drop("__zp", "__zm") \
        .withColumn("meta_grad_fd", -F.lit(eta * half / max(n_aug, 1)) * F.col("dot_val_fd"))


# ----------------------------------------------------------------- J14, J15, J16
def baseline_fit(train: DataFrame, x: str = "x", y: str = "y", weight: str | None = None, max_iter: int = 50, reg: float = 0.0, tol: float = 1e-6):
    """J14. Logistic regression (``pyspark.ml``) on clean or clean+augmented rows,
    with instance weights from J1 through ``weightCol``. Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = train.withColumn("__features", array_to_vector(F.col(x))).withColumn("__label", F.col(y).cast("double"))
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=max_iter, regParam=reg, tol=tol,
                            standardization=False, family="multinomial")
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(data)


def fit_gradient(model, train: DataFrame, x: str = "x", y: str = "y", weight: str | None = None, reg: float = 0.0) -> DataFrame:
    """J14 check of a fit: per class, the largest entry of the gradient of the weighted,
    regularised loss at the fitted head. It vanishes only at the optimum. Residuals are
    added up per task; the head is the model's, so model-sized."""
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    n_classes, dim = coef.shape

    def sums(batches):
        for pdf in batches:
            xs, ys, ws = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), pdf["w"].to_numpy(float)
            z = xs @ coef.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ys)), ys] -= 1
            g = (p * ws[:, None]).T @ np.concatenate([xs, np.ones((len(xs), 1))], axis=1)
            yield pd.DataFrame({"class": np.arange(n_classes), "g": list(g), "total": ws.sum()})

    rows = train.select(F.col(x).alias("x"), F.col(y).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    part = rows.mapInPandas(sums, "class int, g array<double>, total double").select("class", "total", F.posexplode("g").alias("dim", "g"))
    cells = part.groupBy("class", "dim").agg((F.sum("g") / F.sum("total")).alias("g"))
    penalty = F.element_at(F.element_at(F.lit(np.concatenate([coef * reg, np.zeros((n_classes, 1))], axis=1).tolist()), F.col("class") + 1), F.col("dim") + 1)
    return cells.groupBy("class").agg(F.max(F.abs(F.col("g") + penalty)).alias("gradient"))


def baseline_predict(model, df: DataFrame, x: str = "x") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    out = model.transform(df.withColumn("__features", array_to_vector(F.col(x))))
    return out.withColumn("pred", F.col("prediction").cast("int")).drop("__features", "rawPrediction", "probability", "prediction")


def reweight_fit(spark: SparkSession, aug: DataFrame, clean: DataFrame | None, val: DataFrame, n_classes: int, dim: int,
                 epochs: int = 3, eta: float = 0.5, id_col: str = "vec_id", x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """J15. Learning-to-reweight loop over epochs: a J10 look-ahead gives every
    augmented row its meta-gradient; weights become ``max(-meta_grad, 0)``
    normalised to mean 1 (uniform when all are 0); the head takes a weighted SGD
    step. Each epoch's weight table is written to the shared checkpoint folder
    (lineage cut; survives executor loss). Returns ``(weights, epoch_losses)``."""
    theta = np.zeros((n_classes, dim))
    cur = aug.select(id_col, x, y).withColumn("w", F.lit(1.0))
    losses = []
    for ep in range(epochs):
        step = meta_influence(cur, clean, val, theta, eta, "w", x, y)
        raw = step.influence.select(id_col, x, y, F.greatest(-F.col("meta_grad"), F.lit(0.0)).alias("__r"))
        tot = raw.agg(F.sum("__r"), F.count(F.lit(1))).first()
        s, n = (tot[0] or 0.0), tot[1]
        neww = F.lit(1.0) if s <= 0 else F.col("__r") * F.lit(n / s)
        path = scratch_dir(spark, f"reweight-epoch{ep}")
        raw.select(id_col, x, y, neww.alias("w")).write.parquet(path)
        cur = spark.read.parquet(path)
        n_aug = n
        g = softmax_grad(cur, theta, x, y, F.col("w") / F.lit(float(max(n_aug, 1))))
        if clean is not None:
            g = 0.5 * g + 0.5 * softmax_grad(clean, theta, x, y) / max(clean.count(), 1)
        theta = theta - eta * g
        losses += [(ep, "val_loss", mean_ce(val, theta, x, y)), (ep, "gamma", step.gamma)]
    loss_df = spark.createDataFrame(losses, "epoch int, name string, value double")
    return cur.select(id_col, "w"), loss_df


def noise_audit(df: DataFrame, weight: str = "w", flipped: str = "is_flipped", id_col: str = "vec_id") -> DataFrame:
    """J16. Do the weights separate flipped rows? Mean weight per side and the AUC of
    the weight for telling clean (not flipped) from flipped rows (average ranks)."""
    from noisesift.functions.metrics import average_rank

    r = average_rank(df.select(id_col, weight, flipped), weight, id_col, "__rk")
    return r.agg(
        F.avg(F.when(F.col(flipped), F.col(weight))).alias("mean_w_flipped"),
        F.avg(F.when(~F.col(flipped), F.col(weight))).alias("mean_w_clean"),
        ((F.sum(F.when(~F.col(flipped), F.col("__rk"))) - F.sum((~F.col(flipped)).cast("double")) * (F.sum((~F.col(flipped)).cast("double")) + 1) / 2)
         / (F.sum((~F.col(flipped)).cast("double")) * F.sum(F.col(flipped).cast("double")))).alias("auc"),
    )


def softmax_fit(train: DataFrame, n_classes: int, dim: int, steps: int = 5, eta: float = 0.5,
                x: str = "x", y: str = "y", weight: str | None = None) -> np.ndarray:
    """J14 (gradient form): a linear softmax head from zero by ``steps`` full-batch
    gradient steps on the (optionally instance-weighted) mean cross-entropy; each step
    is one distributed gradient aggregate. Returns the [classes, dim] head."""
    theta = np.zeros((n_classes, dim))
    coef = F.col(weight) if weight else None
    denom = float(train.agg(F.sum(coef if coef is not None else F.lit(1.0))).first()[0] or 0.0)  # one scalar
    for _ in range(steps):
        g = softmax_grad(train, theta, x, y, coef)
        theta = theta - eta * g / max(denom, 1e-12)
    return theta


def softmax_predict(df: DataFrame, theta: np.ndarray, x: str = "x", out: str = "pred") -> DataFrame:
    """Argmax of ``theta x`` (first maximum)."""
    from noisesift.functions.vectors import argmax

    return with_logits(df, theta, x, "__z").withColumn(out, argmax("__z")).drop("__z")
