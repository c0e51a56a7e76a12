"""Classification / regression metrics and epoch aggregates.

Every metric is one aggregate (partial on the map side, final after a tiny
shuffle). Rank correlation uses the skew-safe position helper, never a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisesift.functions.vectors import logsumexp
from noisesift.operators.ranking import keyed_join, value_starts
from noisesift.session import staged


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def accuracy(df: DataFrame, y: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """G1. mean(pred = y)."""
    return df.groupBy(*by).agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("acc"))


def _prf(tp: Column, fp: Column, fn: Column, prefix: str) -> list[Column]:
    p = _safe_div(tp, tp + fp)
    r = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    return [p.alias(f"{prefix}precision"), r.alias(f"{prefix}recall"), f1.alias(f"{prefix}f1")]


def _binary_counts(y: Column, p: Column, positive: int) -> tuple[Column, Column, Column]:
    pos_y, pos_p = (y == positive), (p == positive)
    tp = F.sum((pos_y & pos_p).cast("long"))
    fp = F.sum((~pos_y & pos_p).cast("long"))
    fn = F.sum((pos_y & ~pos_p).cast("long"))
    return tp, fp, fn


def binary_prf(df: DataFrame, y: str | Column = "label", pred: str | Column = "pred", positive: int = 1, prefix: str = "pos_") -> DataFrame:
    """G2. Precision / recall / F1 of the positive class; 0 when undefined."""
    tp, fp, fn = _binary_counts(_c(y), _c(pred), positive)
    return df.agg(*_prf(tp, fp, fn, prefix))


def negative_prf(df: DataFrame, y: str | Column = "label", pred: str | Column = "pred") -> DataFrame:
    """G3. The same for class 0, by complementing both sides (1 - y, 1 - pred)."""
    return binary_prf(df, F.lit(1) - _c(y), F.lit(1) - _c(pred), 1, "neg_")


def micro_prf(df: DataFrame, y: str = "label", pred: str = "pred") -> DataFrame:
    """G4. Micro-averaged P/R/F1 over classes (single-label: all equal accuracy)."""
    tp = F.sum((F.col(pred) == F.col(y)).cast("long"))
    n = F.count(F.lit(1))
    return df.agg(*_prf(tp, n - tp, n - tp, ""))


def confusion_matrix(df: DataFrame, y: str = "label", pred: str = "pred") -> DataFrame:
    """G5. (true, pred) counts in long form; ``.groupBy(y).pivot(pred)`` gives the matrix view."""
    return df.groupBy(F.col(y).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """G6. Pearson correlation."""
    return df.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"))


def matthews(df: DataFrame, y: str | Column = "label", pred: str | Column = "pred") -> DataFrame:
    """G7 (cola). Matthews correlation of a binary prediction; 0 when undefined."""
    yy, pp = _c(y), _c(pred)
    tp = F.sum(((yy == 1) & (pp == 1)).cast("double"))
    tn = F.sum(((yy == 0) & (pp == 0)).cast("double"))
    fp = F.sum(((yy == 0) & (pp == 1)).cast("double"))
    fn = F.sum(((yy == 1) & (pp == 0)).cast("double"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.agg(F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den).alias("matthews"))


def average_rank(df: DataFrame, col: str, id_col: str, out: str) -> DataFrame:
    """1-based rank of ``col`` with ties given their average rank: ranks of the distinct values, joined once."""
    ranks = value_starts(df, col, "__start", "__count").withColumn(out, F.col("__start") + (F.col("__count") + 1) / F.lit(2.0))
    return keyed_join(df, ranks.drop("__start", "__count"), [col])


def spearman(df: DataFrame, x: str, y: str, id_col: str, with_pearson: bool = False) -> DataFrame:
    """G7 (stsb). Spearman = Pearson of average ranks (optionally Pearson too, same pass). A row's id
    and its two values are written once: both ranks and their joins read them, not ``df``."""
    values = staged(df.select(id_col, x, y), "values")
    r = average_rank(average_rank(values, x, id_col, "__rx"), y, id_col, "__ry")
    cols = [F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson")] if with_pearson else []
    return r.agg(*cols, F.corr("__rx", "__ry").alias("spearman"))


def task_metric(df: DataFrame, task: str, y: str = "label", pred: str = "pred", id_col: str = "id") -> DataFrame:
    """G7. Per-task metric: Matthews (cola), accuracy + F1 (mrpc, qqp),
    Pearson + Spearman (stsb), else accuracy."""
    if task == "cola":
        return matthews(df, y, pred)
    if task in ("mrpc", "qqp"):
        tp, fp, fn = _binary_counts(F.col(y), F.col(pred), 1)
        return df.agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("accuracy"), _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))
    if task == "stsb":
        return spearman(df, pred, y, id_col, with_pearson=True)
    return accuracy(df, y, pred)


def cross_entropy(logits: str | Column, y: str | Column) -> Column:
    """G8. Per-row ``-log softmax(logits)[y] = logsumexp(logits) - logits[y]`` (y 0-based)."""
    return logsumexp(logits) - F.element_at(_c(logits), (_c(y) + 1).cast("int"))


def squared_error(pred: str | Column, y: str | Column) -> Column:
    """G8 (regression, ``class_num == 1``)."""
    d = _c(pred).cast("double") - _c(y).cast("double")
    return d * d


def epoch_means(log: DataFrame, epoch: str = "epoch", name: str = "name", value: str = "value") -> DataFrame:
    """G9. Mean of each loss per epoch."""
    return log.groupBy(epoch, name).agg(F.avg(value).alias("mean_value"))


def batch_mean_loss(df: DataFrame, batch: str = "batch_id", loss: str = "loss", by: Sequence[str] = ()) -> DataFrame:
    """G10. Mean over batches of the batch means (differs from the row mean when batch sizes differ)."""
    per_batch = df.groupBy(*by, batch).agg(F.avg(loss).alias("__bm"))
    return per_batch.groupBy(*by).agg(F.avg("__bm").alias("batch_mean_loss"), F.count(F.lit(1)).alias("batches"))


def weight_norm(df: DataFrame, epoch: str = "epoch", w: str = "w") -> DataFrame:
    """G11. L2 norm of all instance weights of an epoch."""
    return df.groupBy(epoch).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("weight_norm"))


def phase_times(log: DataFrame, epoch: str = "epoch", phase: str = "phase", seconds: str = "seconds") -> DataFrame:
    """G12. Seconds per phase per epoch."""
    return log.groupBy(epoch, phase).agg(F.sum(seconds).alias("seconds"))


def method_census(aug: DataFrame, train: DataFrame) -> DataFrame:
    """G13. Rows per method, number of distinct methods, augmented : raw ratio."""
    per = aug.groupBy("aug_method").agg(F.count(F.lit(1)).alias("rows"))
    tot = aug.agg(F.count(F.lit(1)).alias("__na"), F.countDistinct("aug_method").alias("n_methods"))
    raw = train.agg(F.count(F.lit(1)).alias("__nr"))
    # Two one-row aggregates attached to the per-method table (as literals of one small job).
    t, r = tot.first(), raw.first()
    return per.select(
        "aug_method", "rows", F.lit(t["n_methods"]).cast("bigint").alias("n_methods"),
        (F.lit(float(t["__na"])) / F.lit(float(r["__nr"]) if r["__nr"] else None)).alias("aug_raw_ratio"),
    )


def classification_report(df: DataFrame, y: str = "label", pred: str = "pred") -> DataFrame:
    """The reference's evaluation: accuracy with positive/negative P/R/F1 (binary),
    else accuracy with micro P/R/F1; one row."""
    n_classes = df.select(y).distinct().limit(3).count()
    acc = F.avg((F.col(pred) == F.col(y)).cast("double")).alias("acc")
    if n_classes <= 2:
        tp, fp, fn = _binary_counts(F.col(y), F.col(pred), 1)
        ntp, nfp, nfn = _binary_counts(F.lit(1) - F.col(y), F.lit(1) - F.col(pred), 1)
        return df.agg(acc, *_prf(tp, fp, fn, "pos_"), *_prf(ntp, nfp, nfn, "neg_"))
    tp = F.sum((F.col(pred) == F.col(y)).cast("long"))
    n = F.count(F.lit(1))
    return df.agg(acc, *_prf(tp, n - tp, n - tp, ""))
