"""Contrastive scoring against a per-class bank.

Every query row scores itself against its class's bank inside one task, with no
N x K row explosion; the bank comes in broadcast blocks of bounded size. In-batch
supervised contrast works on pairs of tiles of a batch, never on emitted pair rows
(``tiles``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisesift.functions.vectors import dot, logsumexp
from noisesift.operators.joins import batch_partners, score_against_bank
from noisesift.operators.ranking import keyed_join, ordered_position
from noisesift.operators.tiles import info_nce_blocks, supervised_contrast_tiles

# Score of a bank slot that was never written.
INITIAL_BANK_SCORE = 1.0


def bank_topk(rows: DataFrame, k: int, ttl: int | None = None, age_col: str = "age",
              key: str = "class", score: str = "score", id_col: str = "vec_id") -> DataFrame:
    """J7. Per class keep the ``k`` lowest-score vectors (younger than ``ttl`` when given).

    Literal limit -> ``WindowGroupLimit``: map tasks pre-trim each class to k rows.
    Adds ``slot`` (1..k).
    """
    r = rows.where(F.col(age_col) < F.lit(ttl)) if ttl is not None else rows
    w = Window.partitionBy(key).orderBy(F.col(score).asc(), F.col(id_col).asc())
    return r.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= F.lit(k))


def top_ratio(df: DataFrame, ratio: float, keys: Sequence[str] = ("batch_id", "class"), weight: str = "w", id_col: str = "vec_id") -> DataFrame:
    """H6. Per (batch, class) keep the ``max(int(ratio*n), 1)`` largest weights; no cut when n <= 1.
    Groups are batch-bounded, so a plain window is used."""
    g = Window.partitionBy(*keys)
    w = g.orderBy(F.col(weight).desc(), F.col(id_col).asc())
    x = df.withColumns({"__rn": F.row_number().over(w), "__n": F.count(F.lit(1)).over(g)})
    keep = F.greatest(F.floor(F.lit(ratio) * F.col("__n")), F.lit(1))
    return x.where((F.col("__n") <= 1) | (F.col("__rn") <= keep)).drop("__rn", "__n")


def exclude_by_bank_max(df: DataFrame, bank: DataFrame, key: str = "class", weight: str = "w", score: str = "score") -> DataFrame:
    """H7. Keep weights above the largest non-initial bank score of the class;
    keep all when the class's bank holds only initial scores."""
    mx = bank.where(F.col(score) != F.lit(INITIAL_BANK_SCORE)).groupBy(key).agg(F.max(score).alias("__bmax"))
    j = df.join(mx, key, "left")  # one row per class: AQE broadcasts it by measured size
    return j.where(F.col("__bmax").isNull() | (F.col(weight) > F.col("__bmax"))).drop("__bmax")


def info_nce(queries: DataFrame, bank: DataFrame, temperature: float = 0.07, key: str = "class",
             method: str = "auto") -> DataFrame:
    """J4. Per (batch, class): logits ``[q.k, q.bank_1..K] / T`` with target 0, for the
    clean query ``q`` and the augmented query ``q_aug`` stacked; mean cross-entropy.

    ``queries``: ``(batch_id, class, q, q_aug, k)``; ``bank``: ``(class, slot, vec)``.
    Output: ``batch_id, class, loss, n`` (n = stacked rows). ``method``: ``auto`` (the bank in
    blocks of bounded size, see ``tiles``), ``builtin`` (the bank joined by class) or ``arrow``
    (a small bank as one broadcast). All give the same rows; a null class has no bank.
    """
    if method == "auto":
        return info_nce_blocks(queries, bank, temperature, key)
    if method == "arrow":
        return info_nce_arrow(queries, bank, temperature, key)
    stacked = queries.select("batch_id", key, F.col("q").alias("vec"), "k").unionByName(
        queries.select("batch_id", key, F.col("q_aug").alias("vec"), "k"))
    scored = score_against_bank(stacked, bank, "vec", key, method="builtin")
    pos = dot("vec", "k") / F.lit(temperature)
    logits = F.concat(F.array(pos), F.transform("bank_dots", lambda s: s / F.lit(temperature)))
    per_row = scored.select("batch_id", key, (logsumexp(logits) - pos).alias("__l"))
    return per_row.groupBy("batch_id", key).agg(F.avg("__l").alias("loss"), F.count(F.lit(1)).alias("n"))


def supervised_contrast(df: DataFrame, temperature: float = 0.07, base_temperature: float = 0.07,
                        vec: str = "vec", label: str = "class", id_col: str = "vec_id", max_batch: int = 4096,
                        method: str = "tiles", aug_vecs: Sequence[str] = ()) -> DataFrame:
    """J5. Per anchor: mean over same-class others of ``s_ij - logsumexp_{j != i} s_ij``,
    ``s_ij = x_i.x_j / T``; loss = mean over anchors of ``-(T/baseT) * that``.
    Anchors with no same-class partner are dropped (X8). Output per batch: ``loss, anchors``.
    Rows of a null class are in the sums but have no partners. ``aug_vecs``: columns of
    augmented views, each one more row of the batch. ``method``: ``tiles`` (pairs of tiles, any
    batch size), ``builtin`` (the same with built-ins, ``max_batch`` partners a row, ids
    unique in a batch) or ``arrow`` (a batch in one group)."""
    if method == "tiles" or aug_vecs:
        return supervised_contrast_tiles(df, temperature, base_temperature, vec, label, aug_vecs=aug_vecs)
    if method == "arrow":
        return supervised_contrast_arrow(df, temperature, base_temperature, vec, label)
    p = batch_partners(df, id_col, "batch_id", [vec, label], max_batch)
    sims = F.transform("partners", lambda m: F.struct((dot(vec, m[vec]) / F.lit(temperature)).alias("s"), m[label].alias("y")))
    x = p.select("batch_id", F.col(id_col).alias("__id"), F.col(label).alias("__y"), sims.alias("__s"))
    same = F.filter("__s", lambda e: e["y"] == F.col("__y"))
    part = x.select("batch_id", "__id", logsumexp(F.transform("__s", lambda e: e["s"])).alias("__lse"),
                    F.aggregate(same, F.lit(0.0), lambda a, e: a + e["s"]).alias("__pos"), F.greatest(F.size(same), F.lit(0)).alias("__n"))
    whole = part.where("__lse > double('-inf')").groupBy("batch_id", "__id").agg(logsumexp(F.collect_list("__lse")).alias("__lse"), F.sum("__pos").alias("__pos"), F.sum("__n").alias("__n"))
    anchors = whole.where("__n > 0").select("batch_id", (-(F.lit(temperature / base_temperature)) * (F.col("__pos") / F.col("__n") - F.col("__lse"))).alias("__l"))
    return anchors.groupBy("batch_id").agg(F.avg("__l").alias("loss"), F.count(F.lit(1)).alias("anchors"))


def contrast_total(inner: DataFrame, intra: DataFrame | None, n_classes: int,
                   lambda_inner: float = 1.0, lambda_intra: float = 1.0, key: str = "class") -> DataFrame:
    """J6. Per batch: ``lambda_inner * sum_c (C - c) * L_c + lambda_intra * L_intra``.

    The reference adds the *running* sum of class losses after each class, so
    class c (0-based) counts ``C - c`` times; a class absent from the batch adds 0 (X13).
    """
    w_inner = inner.groupBy("batch_id").agg(
        F.sum((F.lit(n_classes) - F.col(key)) * F.col("loss")).alias("inner_loss_weighted"),
        F.sum("loss").alias("inner_loss"),
    )
    out = w_inner.withColumn("total", F.lit(lambda_inner) * F.col("inner_loss_weighted"))
    if intra is not None:
        out = out.join(intra.select("batch_id", F.col("loss").alias("intra_loss")), "batch_id", "full")
        out = out.withColumn("total", F.coalesce(F.col("total"), F.lit(0.0)) + F.lit(lambda_intra) * F.coalesce(F.col("intra_loss"), F.lit(0.0)))
    return out


def class_batch_means(df: DataFrame, vec: str = "vec", key: str = "class", batch: str = "batch_id") -> DataFrame:
    """Per (class, batch) mean vector, element-wise, as rows ``(class, batch, dim, x)``.

    Vectors are added up per task first (NumPy), so what is exploded and shuffled is one
    vector per task, class and batch, not one per row."""
    import numpy as np
    import pandas as pd

    def sums(batches):
        for pdf in batches:
            out = [(*k, len(g), np.stack(g["__v"].to_numpy()).sum(axis=0)) for k, g in pdf.groupby(["__k", "__b"], dropna=False)]
            if out:
                ks, bs, ns, vs = zip(*out)
                yield pd.DataFrame({"__k": pd.Series([None if pd.isna(x) else x for x in ks], dtype=object), "__b": pd.Series([None if pd.isna(x) else x for x in bs], dtype=object), "__n": ns, "__v": vs})

    kinds = [df.schema[c].dataType.simpleString() for c in (key, batch)]
    part = df.select(F.col(key).alias("__k"), F.col(batch).alias("__b"), F.col(vec).cast("array<double>").alias("__v")).where("__v IS NOT NULL")
    part = part.mapInPandas(sums, f"__k {kinds[0]}, __b {kinds[1]}, __n long, __v array<double>")
    e = part.select(F.col("__k").alias(key), F.col("__b").alias(batch), "__n", F.posexplode("__v").alias("dim", "x"))
    return e.groupBy(key, batch, "dim").agg((F.sum("x") / F.sum("__n")).alias("x"))


def momentum_profile(df: DataFrame, m: float, vec: str = "vec", key: str = "class", batch: str = "batch_id") -> DataFrame:
    """J9. Final ``k <- m k + (1 - m) q`` per class over its batches in order,
    ``k`` initialised to the first batch's mean.

    Closed form: ``k = m^(n-1) q_0 + sum_{i>=1} (1-m) m^(n-1-i) q_i``, so the fold
    is a weighted sum: a plain distributed aggregate, no per-class gather.
    Output rows ``(class, dim, profile)``.
    """
    means = class_batch_means(df, vec, key, batch)
    batches = means.select(key, batch).distinct()
    pos = ordered_position(batches, batch, [key], "__i", "__n")
    coef = F.when(F.col("__i") == 0, F.pow(F.lit(m), F.col("__n") - 1)).otherwise(
        F.lit(1.0 - m) * F.pow(F.lit(m), F.col("__n") - 1 - F.col("__i")))
    c = pos.select(key, batch, coef.alias("__c"))
    return keyed_join(means, c, [key, batch]).groupBy(key, "dim").agg(F.sum(F.col("__c") * F.col("x")).alias("profile"))


def token_bucket(token) -> "Column":
    """Bucket of a token: the first 32 bits of its md5, as a non-negative integer."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def batch_features(df: DataFrame, text: str = "text", dim: int = 64, out: str = "features", head=None,
                   logits: str = "logits", id_col: str | None = None, method: str = "md5", scorer: Callable | None = None,
                   inputs: Sequence[str] = (), shapes: Sequence[Sequence[int] | None] | None = None,
                   outputs: str = "features array<double>, logits array<double>, loss double", batch_size: int = 64) -> DataFrame:
    """J13 default scorer: hashed token counts as ``array<double>`` (``dim`` buckets),
    and, with a linear ``head`` (classes x dim array), the logits ``head . features``.

    ``method='md5'`` (needs ``id_col``): every token of the whole text is bucketed by
    md5 and counted with a partial aggregate per (row, bucket), so at most ``dim``
    cells per row cross the shuffle; returns ``id_col, out``.
    ``method='hashing_tf'``: ``pyspark.ml`` ``HashingTF`` on all columns of ``df``.

    ``scorer``: a user model. It is a function without arguments that loads the model in the worker, once, and
    returns the function to call on a batch: one NumPy array per column of ``inputs`` (texts as objects,
    arrays shaped ``[rows, *shape]`` by ``shapes``), giving a dict of one array per field of ``outputs``.
    Batches of ``batch_size`` rows go through ``predict_batch_udf`` without a shuffle; all columns of ``df`` stay.
    A row with a null input gets nulls.
    """
    if scorer is not None:
        return _scored(df, scorer, list(inputs) or [text], shapes, outputs, batch_size)
    if head is not None:
        from noisesift.operators.weights import with_logits

        return with_logits(batch_features(df, text, dim, out, id_col=id_col, method=method), head, out, logits)
    if method == "md5":
        from noisesift.functions.text import tokens

        ex = df.select(id_col, F.explode_outer(tokens(text)).alias("__t"))
        cells = ex.groupBy(id_col, F.pmod(token_bucket(F.col("__t")), F.lit(dim)).alias("__b")).agg(F.count("__t").alias("__c"))
        item = F.when(F.col("__b").isNotNull(), F.struct("__b", "__c"))
        g = cells.groupBy(id_col).agg(F.map_from_entries(F.collect_list(item)).alias("__m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                            lambda i: F.coalesce(F.element_at(F.col("__m"), i.cast("bigint")), F.lit(0)).cast("double"))
        return g.select(id_col, dense.alias(out))
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text, outputCol="__tok", pattern="\\s+", toLowercase=False)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim)
    x = tf.transform(tok.transform(df))
    return x.withColumn(out, vector_to_array("__tf")).drop("__tok", "__tf")


def _scored(df: DataFrame, scorer: Callable, inputs: list[str], shapes, outputs: str, batch_size: int) -> DataFrame:
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, StringType, _parse_datatype_string

    fields = _parse_datatype_string(outputs)
    shapes = list(shapes) if shapes is not None else [None] * len(inputs)

    def known(c: str, shape) -> Column:
        """A stand-in for null, as the model takes no nulls."""
        kind = df.schema[c].dataType
        cells = 1
        for n in shape or []:
            cells *= n
        blank = F.array_repeat(F.lit(0).cast(kind.elementType), cells) if isinstance(kind, ArrayType) else F.lit("") if isinstance(kind, StringType) else F.lit(0).cast(kind)
        return F.coalesce(F.col(c), blank)

    score = predict_batch_udf(scorer, return_type=fields, batch_size=batch_size, input_tensor_shapes=shapes if any(shapes) else None)
    ok = F.lit(True)
    for c in inputs:
        ok = ok & F.col(c).isNotNull()
    out = df.withColumn("__scored", F.when(ok, score(*[known(c, s) for c, s in zip(inputs, shapes, strict=True)])))
    return out.withColumns({f.name: F.col(f"__scored.{f.name}") for f in fields}).drop("__scored")


# ---------------------------------------------------------------- Arrow fast paths
BANK_COLLECT_LIMIT = 50_000_000  # doubles (K x classes x dim) shipped as one broadcast variable


def _np_logsumexp(a: "np.ndarray") -> "np.ndarray":
    import numpy as np

    m = a.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=1, keepdims=True)))[:, 0]


def info_nce_arrow(queries: DataFrame, bank: DataFrame, temperature: float = 0.07, key: str = "class", vec: str = "vec") -> DataFrame:
    """J4 fast path: same result as ``info_nce``. The bank (bounded: K slots per class,
    size checked) is one broadcast variable; every Arrow batch of queries is scored
    per class by one matrix product ``Q B^T`` and a row-wise logsumexp, so no
    K-wide array is built per row."""
    import numpy as np
    import pandas as pd

    spark = queries.sparkSession
    n_cells = bank.select(F.size(vec).alias("d")).agg(F.sum("d")).first()[0] or 0
    if n_cells > BANK_COLLECT_LIMIT:
        return info_nce_blocks(queries, bank, temperature, key, vec)
    rows = bank.select(key, "slot", vec).collect()  # bounded by the check above
    banks: dict = {}
    for r in sorted(rows, key=lambda r: (r[key], r["slot"])):
        banks.setdefault(r[key], []).append(r[vec])
    bc = spark.sparkContext.broadcast({c: np.asarray(v, dtype=float) for c, v in banks.items()})
    t = float(temperature)

    def score(batches):
        b = bc.value
        for pdf in batches:
            outs = []
            for c, g in pdf.groupby(key, dropna=False):
                k = np.stack(g["k"].to_numpy())
                bk = None if pd.isna(c) else b.get(c)
                for side in ("q", "q_aug"):
                    qm = np.stack(g[side].to_numpy())
                    pos = (qm * k).sum(axis=1) / t
                    logits = pos[:, None] if bk is None else np.concatenate([pos[:, None], qm @ bk.T / t], axis=1)
                    outs.append(pd.DataFrame({"batch_id": g["batch_id"].to_numpy(), key: None if pd.isna(c) else c, "__l": _np_logsumexp(logits) - pos}))
            if outs:
                yield pd.concat(outs, ignore_index=True)

    kt = queries.schema[key].dataType.simpleString()
    per_row = queries.select("batch_id", key, "q", "q_aug", "k").mapInPandas(score, f"batch_id long, {key} {kt}, __l double")
    return per_row.groupBy("batch_id", key).agg(F.avg("__l").alias("loss"), F.count(F.lit(1)).alias("n"))


GRAM_ROWS = 2048  # anchors of a batch scored at a time


def supervised_contrast_arrow(df: DataFrame, temperature: float = 0.07, base_temperature: float = 0.07, vec: str = "vec",
                              label: str = "class") -> DataFrame:
    """J5 fast path: same result as ``supervised_contrast``. One group per batch, scored
    in NumPy ``GRAM_ROWS`` anchors at a time, so a batch of any size needs its vectors and
    one block of the Gram matrix in memory."""
    import numpy as np
    import pandas as pd

    t, scale = float(temperature), float(temperature / base_temperature)

    def one_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vec].to_numpy())
        y, known = pd.factorize(pdf[label])
        n, total, anchors = len(y), 0.0, 0
        for a in range(0, n, GRAM_ROWS):
            rows = np.arange(a, min(n, a + GRAM_ROWS))
            s = x[rows] @ x.T / t
            off = rows[:, None] != np.arange(n)[None, :]
            same = (y[rows][:, None] == y[None, :]) & off & (y[rows] >= 0)[:, None]
            npos = same.sum(axis=1)
            keep = npos > 0
            if not keep.any():
                continue
            lse = _np_logsumexp(np.where(off, s, -np.inf)[keep])
            mean_pos = np.where(same, s, 0.0).sum(axis=1)[keep] / npos[keep]
            total += float((-scale * (mean_pos - lse)).sum())
            anchors += int(keep.sum())
        if not anchors:
            return pd.DataFrame({"batch_id": [], "loss": [], "anchors": []})
        return pd.DataFrame({"batch_id": [int(pdf["batch_id"].iloc[0])], "loss": [total / anchors], "anchors": [anchors]})

    return df.select("batch_id", vec, label).groupBy("batch_id").applyInPandas(one_batch, "batch_id long, loss double, anchors long")
