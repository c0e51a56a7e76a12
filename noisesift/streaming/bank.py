"""Keyed contrastive bank in batch (J8) and Structured Streaming (K1-K3).

State per class: K slots ``(vec, score, life, vec_id)``; initial vectors are
seeded random unit vectors with score 1 and life ``ttu``. One update step
(``bank_step``) per batch of new rows of the class:

* ``time`` policy (K2): every life drops by 1; expired slots (life <= 0, oldest
  first) take the *largest*-weight new rows; the remaining (smaller) rows then
  replace live slots of larger score: live slots sorted by score descending and
  rows ascending are paired in order, for as many pairs as both sides offer
  (slots with a score above the smallest row, rows below the largest score).
* ``weight`` policy (K1): lives drop; the same descending/ascending pairing over
  all slots first; leftover rows (ascending) fill expired slots, oldest first.

A replaced slot gets the row's vector, score = weight, life = ``ttu``.
Only the 2K smallest and K largest weights of a step can enter the bank, so
inputs are reduced to those before a class's rows meet in one task (window
limits in batch; in streaming twice, per partition and per shard of a class, so a
hot class reaches its state as at most ``shards * 3K`` rows a step).

A step may be spread over several micro-batches: its rows are pending (reduced, in the
state) until ``open_batches`` later batch ids of the class have come. What is emitted after each
micro-batch is the bank as if the pending steps ended there, with a rising ``version``; the last
version of a class is its bank. A row that comes after its step was closed counts to the oldest
pending one, so none is lost.
Lives age by one per step of the class (the reference ages every class on
every class's step; documented deviation).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisesift.session import scratch_dir

INITIAL_SCORE = 1.0

BANK_SCHEMA = "class int, slot int, vec_id long, score double, life double, vec array<double>"


NO_CLASS = 99_991  # stands in for a null class where a bank is seeded


def _class_of(key) -> int | None:
    return None if pd.isna(key) else int(key)


def _batch_of(key) -> int:
    return -1 if pd.isna(key) else int(key)  # rows without a batch are one batch before all others


def initial_class_bank(c: int | None, k: int, dim: int, ttu: float, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed * 100_003 + (NO_CLASS if c is None else c))
    v = rng.standard_normal((k, dim))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return {"vecs": v, "scores": np.full(k, INITIAL_SCORE), "lives": np.full(k, float(ttu)), "ids": -1 - np.arange(k, dtype=np.int64)}


def initial_bank(n_classes: int, k: int, dim: int, ttu: float, seed: int = 0) -> dict[int, dict[str, np.ndarray]]:
    return {c: initial_class_bank(c, k, dim, ttu, seed) for c in range(n_classes)}


def initial_bank_df(spark: SparkSession, n_classes: int, k: int, dim: int, ttu: float, seed: int = 0) -> DataFrame:
    """The start state as a table (class x K rows; bounded by configuration)."""
    rows = []
    for c, st in initial_bank(n_classes, k, dim, ttu, seed).items():
        for s in range(k):
            rows.append((c, s, int(st["ids"][s]), float(st["scores"][s]), float(st["lives"][s]), [float(x) for x in st["vecs"][s]]))
    return spark.createDataFrame(rows, BANK_SCHEMA)


def bank_step(state: dict[str, np.ndarray], new_vecs: np.ndarray, new_w: np.ndarray, new_ids: np.ndarray,
              policy: str, ttu: float) -> dict[str, np.ndarray]:
    """One exact update of one class's bank (see module doc). Ties: weights by id, slots by index."""
    vecs, scores, lives, ids = state["vecs"].copy(), state["scores"].copy(), state["lives"].copy(), state["ids"].copy()
    k = len(scores)
    slots = np.arange(k)
    lives -= 1
    n = len(new_w)
    asc = np.lexsort((new_ids, new_w)) if n else np.zeros(0, dtype=int)

    def put(slot: int, row: int) -> None:
        vecs[slot] = new_vecs[row]
        scores[slot] = new_w[row]
        lives[slot] = ttu
        ids[slot] = new_ids[row]

    def pair(slot_set: np.ndarray, rows: np.ndarray) -> int:
        if len(slot_set) == 0 or len(rows) == 0:
            return 0
        desc = slot_set[np.lexsort((slot_set, -scores[slot_set]))]
        a = int(np.sum(scores[desc] > new_w[rows[0]]))
        b = int(np.sum(new_w[rows] < scores[desc[0]]))
        m = min(a, b)
        for i in range(m):
            put(int(desc[i]), int(rows[i]))
        return m

    def expired() -> np.ndarray:
        e = slots[lives <= 0]
        return e[np.lexsort((e, lives[e]))]

    if policy == "time":
        live = slots[lives > 0]
        exp = expired()
        t = min(len(exp), n)
        for i in range(t):
            put(int(exp[i]), int(asc[n - t + i]))
        pair(live, asc[: n - t])
    elif policy == "weight":
        m = pair(slots, asc)
        exp = expired()
        rest = asc[m:]
        for i in range(min(len(exp), len(rest))):
            put(int(exp[i]), int(rest[i]))
    else:
        raise ValueError(policy)
    return {"vecs": vecs, "scores": scores, "lives": lives, "ids": ids}


def reduce_candidates(pdf: pd.DataFrame, k: int, w: str = "w", id_col: str = "vec_id") -> pd.DataFrame:
    """Keep the 2k smallest and k largest weights (the only rows a step can use)."""
    if len(pdf) <= 3 * k:
        return pdf
    s = pdf.sort_values([w, id_col], kind="mergesort")
    return pd.concat([s.iloc[: 2 * k], s.iloc[-k:]]).drop_duplicates(subset=[id_col])


# ---------------------------------------------------------------- J8 (batch)
def bank_apply_batch(bank: DataFrame, rows: DataFrame, policy: str, ttu: float, k: int,
                     key: str = "class", vec: str = "vec", w: str = "w", id_col: str = "vec_id", seed: int = 0) -> DataFrame:
    """J8. One update step per class: rows are cut to the 2K smallest and K largest
    weights per class (``WindowGroupLimit``, map-side), then each class's bank and
    candidates are co-grouped (``cogroup.applyInPandas``)."""
    asc = Window.partitionBy(key).orderBy(F.col(w).asc(), F.col(id_col).asc())
    desc = Window.partitionBy(key).orderBy(F.col(w).desc(), F.col(id_col).desc())
    lo = rows.withColumn("__r", F.row_number().over(asc)).where(F.col("__r") <= F.lit(2 * k)).drop("__r")
    hi = rows.withColumn("__r", F.row_number().over(desc)).where(F.col("__r") <= F.lit(k)).drop("__r")
    cand = lo.unionByName(hi).dropDuplicates([key, id_col]).select(
        F.col(key).cast("int").alias("class"), F.col(id_col).cast("long").alias("vec_id"),
        F.col(w).cast("double").alias("w"), F.col(vec).alias("vec"))

    def step(b: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        c = _class_of((r if b.empty else b)["class"].iloc[0])
        if b.empty:  # a class seen for the first time starts with its initial bank
            st, slots = initial_class_bank(c, k, len(r["vec"].iloc[0]), ttu, seed), np.arange(k)
        else:
            b = b.sort_values("slot")
            st = {"vecs": np.stack(b["vec"].to_numpy()), "scores": b["score"].to_numpy(float),
                  "lives": b["life"].to_numpy(float), "ids": b["vec_id"].to_numpy(np.int64)}
            slots = b["slot"].to_numpy()
        if len(r):
            st = bank_step(st, np.stack(r["vec"].to_numpy()), r["w"].to_numpy(float), r["vec_id"].to_numpy(np.int64), policy, ttu)
        else:
            st = bank_step(st, np.zeros((0, st["vecs"].shape[1])), np.zeros(0), np.zeros(0, np.int64), policy, ttu)
        return pd.DataFrame({"class": pd.array([c] * len(slots), dtype="Int32"), "slot": slots, "vec_id": st["ids"],
                             "score": st["scores"], "life": st["lives"], "vec": list(st["vecs"])})

    return bank.groupBy("class").cogroup(cand.groupBy("class")).applyInPandas(step, BANK_SCHEMA)


# ---------------------------------------------------------------- K1-K3 (streaming)
PENDING = "p_batch array<long>, p_ids array<long>, p_w array<double>, p_vecs array<array<double>>"
STATE_SCHEMA = f"vecs array<array<double>>, scores array<double>, lives array<double>, ids array<long>, version long, closed long, {PENDING}"
STREAM_OUT = "class int, slot int, vec_id long, score double, life double, last_batch long, version long"
NEVER = -(1 << 62)  # no batch is closed yet
SHARDS = 8


def _to_open(batch: int, closed: int, held: dict) -> int:
    """The step a row counts to: its own, or the oldest pending one if its own is closed."""
    if batch > closed:
        return batch
    later = [b for b in held if b > closed]
    return min(later) if later else closed + 1


def _bank_fn(policy: str, ttu: float, k: int, dim: int, seed: int, open_batches: int):
    from pyspark.sql.streaming.state import GroupState

    def apply(st, g: pd.DataFrame):
        return bank_step(st, np.stack(g["vec"].to_numpy()), g["w"].to_numpy(float), g["vec_id"].to_numpy(np.int64), policy, ttu)

    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = _class_of(key[0])
        cand: dict[int, pd.DataFrame] = {}
        version, closed = 0, NEVER
        if state.exists:
            vecs, scores, lives, ids, version, closed, pb, pi, pw, pv = state.get
            st = {"vecs": np.array([np.asarray(v, float) for v in vecs]), "scores": np.asarray(scores, float),
                  "lives": np.asarray(lives, float), "ids": np.asarray(ids, np.int64)}
            held = pd.DataFrame({"b": pb, "vec_id": pi, "w": pw, "vec": [np.asarray(v, float) for v in pv]})
            cand = {int(b): g.drop(columns="b") for b, g in held.groupby("b")}
        else:
            st = initial_class_bank(c, k, dim, ttu, seed)
        # Bounded running merge: per step keep only the rows it can use.
        came: dict[int, pd.DataFrame] = {}
        for pdf in pdfs:
            for b, g in pdf[["batch_id", "vec_id", "w", "vec"]].groupby("batch_id", dropna=False):
                g, b = g.drop(columns="batch_id"), _batch_of(b)
                came[b] = reduce_candidates(pd.concat([came[b], g]) if b in came else g, k)
        for b in sorted(came, reverse=True):  # newest first, so that late rows find the pending steps
            to = _to_open(b, closed, cand)
            cand[to] = reduce_candidates(pd.concat([cand[to], came[b]]) if to in cand else came[b], k)
        for b in sorted(cand)[: max(0, len(cand) - open_batches)]:
            st, closed = apply(st, cand.pop(b)), b
        now, last = st, closed
        for b in sorted(cand):
            now, last = apply(now, cand[b]), b
        pend = [(b, int(i), float(w), list(map(float, v))) for b, g in sorted(cand.items()) for i, w, v in zip(g["vec_id"], g["w"], g["vec"], strict=True)]
        state.update(([list(map(float, v)) for v in st["vecs"]], list(map(float, st["scores"])), list(map(float, st["lives"])), list(map(int, st["ids"])),
                      version + 1, closed, *([r[j] for r in pend] for j in range(4))))
        yield pd.DataFrame({"class": pd.array([c] * k, dtype="Int32"), "slot": np.arange(k), "vec_id": now["ids"], "score": now["scores"],
                            "life": now["lives"], "last_batch": last, "version": version + 1})

    return fn


def _partition_candidates(k: int):
    """Stateless, per partition: keep for every (class, batch) only the rows a bank step
    can use (2k smallest, k largest weights). Exact, and a hot class leaves
    a partition as at most 3k rows a batch."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cand: dict[tuple[int, int], pd.DataFrame] = {}
        for pdf in batches:
            for key, g in pdf.groupby(["class", "batch_id"], dropna=False):
                cur = cand.get(key)
                cand[key] = reduce_candidates(g if cur is None else pd.concat([cur, g]), k)
        for g in cand.values():
            yield g

    return fn


def _partition_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stateless, per partition: per (class, batch) the vector sum and row count."""
    acc: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
    for pdf in batches:
        for key, g in pdf.groupby(["class", "batch_id"], dropna=False):
            s = np.stack(g["vec"].to_numpy()).sum(axis=0)
            prev = acc.get(key)
            acc[key] = (s, len(g)) if prev is None else (prev[0] + s, prev[1] + len(g))
    if acc:
        keys = list(acc)
        yield pd.DataFrame({"class": [c for c, _ in keys], "batch_id": [b for _, b in keys],
                            "n": [acc[x][1] for x in keys], "vec": [acc[x][0] for x in keys]})


def _profile_fn(m: float, open_batches: int):
    from pyspark.sql.streaming.state import GroupState

    def fold(prof, s: np.ndarray, n: int) -> np.ndarray:
        return s / n if prof is None else m * prof + (1 - m) * s / n

    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = _class_of(key[0])
        prof, version, closed = None, 0, NEVER
        sums: dict[int, tuple[np.ndarray, int]] = {}
        if state.exists:
            old, version, closed, pb, pn, pv = state.get
            prof = np.asarray(old, float) if len(old) else None
            sums = {int(b): (np.asarray(v, float), int(n)) for b, n, v in zip(pb, pn, pv, strict=True)}
        came: dict[int, tuple[np.ndarray, int]] = {}
        for pdf in pdfs:  # partial sums per partition: memory bounded by batches x dim
            for b, g in pdf.groupby("batch_id", dropna=False):
                s, n = np.stack(g["vec"].to_numpy()).sum(axis=0), int(g["n"].sum())
                prev = came.get(_batch_of(b))
                came[_batch_of(b)] = (s, n) if prev is None else (prev[0] + s, prev[1] + n)
        for b in sorted(came, reverse=True):
            to = _to_open(b, closed, sums)
            prev = sums.get(to)
            sums[to] = came[b] if prev is None else (prev[0] + came[b][0], prev[1] + came[b][1])
        for b in sorted(sums)[: max(0, len(sums) - open_batches)]:
            prof, closed = fold(prof, *sums.pop(b)), b
        now, last = prof, closed
        for b in sorted(sums):
            now, last = fold(now, *sums[b]), b
        if now is None:
            return
        pend = sorted(sums.items())
        state.update(([] if prof is None else list(map(float, prof)), version + 1, closed,
                      [b for b, _ in pend], [n for _, (_, n) in pend], [list(map(float, s)) for _, (s, _) in pend]))
        yield pd.DataFrame({"class": pd.array([c] * len(now), dtype="Int32"), "dim": np.arange(len(now)), "profile": now, "last_batch": last, "version": version + 1})

    return fn


def bank_updates(stream: DataFrame, policy: str, ttu: float, k: int, dim: int, seed: int = 0, open_batches: int = 1, shards: int = SHARDS) -> DataFrame:
    """K1 / K2 as a streaming DataFrame (not started): ``stream`` carries
    ``(class, batch_id, vec_id, w, vec)`` from any source; the result emits each
    class's K slots after every micro-batch that touched it (append mode), to any sink."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    reduced = stream.mapInPandas(_partition_candidates(k), stream.schema)
    reduced = reduced.repartition(shards, "class", "batch_id", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).mapInPandas(_partition_candidates(k), stream.schema)
    return reduced.groupBy("class").applyInPandasWithState(
        _bank_fn(policy, ttu, k, dim, seed, open_batches), STREAM_OUT, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


PROFILE_OUT = "class int, dim long, profile double, last_batch long, version long"


def profile_updates(stream: DataFrame, m: float, open_batches: int = 1) -> DataFrame:
    """K3 as a streaming DataFrame (not started): running profile rows per class."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    sums = stream.mapInPandas(_partition_sums, "class int, batch_id long, n long, vec array<double>")
    return sums.groupBy("class").applyInPandasWithState(
        _profile_fn(m, open_batches), PROFILE_OUT,
        "profile array<double>, version long, closed long, p_batch array<long>, p_n array<long>, p_vecs array<array<double>>", "append",
        GroupStateTimeout.NoTimeout)


def _run_to_table(spark: SparkSession, updates: DataFrame, out_schema: str, name: str, at: str | None = None) -> DataFrame:
    """Drive a streaming result over everything available into a Parquet table in the
    shared checkpoint folder (stream checkpoint alongside), then read the table. A run
    that is given the folder ``at`` of an earlier one goes on from its state."""
    at = at or scratch_dir(spark, name)
    q = (updates.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out_schema).parquet(f"{at}/out")


def stage_stream_source(spark: SparkSession, rows: DataFrame, name: str = "bank-src") -> str:
    """Write ``(class, batch_id, vec_id, w, vec)`` rows as the stream's file source."""
    path = scratch_dir(spark, name)
    rows.repartitionByRange("batch_id").write.parquet(path)
    return path


def stage_stream_files(spark: SparkSession, rows: DataFrame, files: int, name: str = "bank-src") -> str:
    """Write the rows as ``files`` files, one after another in the order of ``batch_id``; where
    a border falls inside a batch, its even and odd ids come in different files."""
    path, held = scratch_dir(spark, name), scratch_dir(spark, f"{name}-rows")
    rows.write.parquet(held)
    rows = spark.read.schema(rows.schema).parquet(held)
    lo, hi = rows.agg(F.min("batch_id"), F.max("batch_id")).first()
    half = 2 * (F.coalesce("batch_id", F.lit(lo or 0)) - F.lit(lo or 0)) + F.pmod("vec_id", F.lit(2))
    part = F.floor(half * files / (2 * ((hi or 0) - (lo or 0) + 1)))
    for k in range(files):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return path


SOURCE_SCHEMA = "class int, batch_id long, vec_id long, w double, vec array<double>"


def _source(spark: SparkSession, source_dir: str, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(SOURCE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source_dir)


def latest(snaps: DataFrame, *keys: str) -> DataFrame:
    """Of every slot or dimension the row of its last version (an aggregate with map-side combine)."""
    rest = [c for c in snaps.columns if c not in (*keys, "version")]
    top = snaps.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return top.select(*keys, "_r.*").select(*[c for c in snaps.columns if c != "version"])


def stream_bank(spark: SparkSession, source_dir: str, policy: str, ttu: float, k: int, dim: int, seed: int = 0,
                files_per_trigger: int | None = None, open_batches: int = 1, at: str | None = None) -> DataFrame:
    """K1 (``weight``) / K2 (``time``) over a file source: streams the batches through the
    per-class bank, ``files_per_trigger`` files a micro-batch, and returns the final bank."""
    stream = _source(spark, source_dir, files_per_trigger)
    snaps = _run_to_table(spark, bank_updates(stream, policy, ttu, k, dim, seed, open_batches), STREAM_OUT, f"bank-{policy}", at)
    return latest(snaps, "class", "slot")


def stream_profile(spark: SparkSession, source_dir: str, m: float, files_per_trigger: int | None = None, open_batches: int = 1, at: str | None = None) -> DataFrame:
    """K3 over a file source; returns the final profile rows ``(class, dim, profile)``."""
    stream = _source(spark, source_dir, files_per_trigger)
    snaps = _run_to_table(spark, profile_updates(stream, m, open_batches), PROFILE_OUT, "profile", at)
    return latest(snaps, "class", "dim").drop("last_batch")
