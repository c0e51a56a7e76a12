"""The streaming bank over many micro-batches: split steps, late rows, stop and restart."""

import numpy as np
import pandas as pd
import pytest

from noisesift.streaming import bank

K, TTU, DIM = 4, 3.0, 3


def rows(n, batches, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    return [(None if rng.random() < 0.05 else int(rng.integers(classes)), int(b), i, float(rng.integers(40)) / 50, [float(v) for v in rng.standard_normal(DIM)])
            for i, b in enumerate(sorted(rng.integers(batches, size=n)))]


def replay(data, policy):
    out = []
    df = pd.DataFrame(data, columns=["class", "batch_id", "vec_id", "w", "vec"])
    for c, own in df.groupby("class", dropna=False):
        st = bank.initial_class_bank(bank._class_of(c), K, DIM, TTU, 0)
        for _, g in own.groupby("batch_id"):
            st = bank.bank_step(st, np.stack(g["vec"].to_numpy()), g["w"].to_numpy(float), g["vec_id"].to_numpy(np.int64), policy, TTU)
        out += [(bank._class_of(c), s, int(st["ids"][s]), float(st["scores"][s]), float(st["lives"][s])) for s in range(K)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["class"], r["slot"], r["vec_id"], r["score"], r["life"]) for r in df.collect()), key=str)


def put(spark, path, data):
    spark.createDataFrame(data, bank.SOURCE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("policy", ["weight", "time"])
def test_split_steps_and_restart(spark, tmp_path, policy):
    data = rows(400, 30)
    src, at = str(tmp_path / "src"), str(tmp_path / "run")
    cuts = [0, 41, 80, 81, 120, 160, 199, 240, 277, 320, 350, 399, 400]  # most lie inside a batch
    for a, b in zip(cuts[:6], cuts[1:7]):
        put(spark, src, data[a:b])
    half = bank.stream_bank(spark, src, policy, TTU, K, DIM, files_per_trigger=1, at=at)
    assert found(half) == replay(data[: cuts[6]], policy)  # an open step counts as ended
    for a, b in zip(cuts[6:], cuts[7:]):
        put(spark, src, data[a:b])
    done = bank.stream_bank(spark, src, policy, TTU, K, DIM, files_per_trigger=1, at=at)
    assert found(done) == replay(data, policy)
    commits = [p for p in (tmp_path / "run/state/commits").iterdir() if p.name.isdigit()]
    assert len(commits) == 12
    once = bank.stream_bank(spark, src, policy, TTU, K, DIM)
    assert found(once) == found(done)


def test_late_rows_count_to_the_open_step(spark, tmp_path):
    data = [r for r in rows(120, 6) if r[0] == 1]
    late = [r for r in data if r[1] == 2][:2]
    rest = [r for r in data if r not in late]
    src = str(tmp_path / "src")
    put(spark, src, [r for r in rest if r[1] <= 4])
    put(spark, src, late)
    put(spark, src, [r for r in rest if r[1] > 4])
    got = found(bank.stream_bank(spark, src, "weight", TTU, K, DIM, files_per_trigger=1))
    moved = [(r[0], 4, *r[2:]) if r in late else r for r in data]
    assert got == replay(moved, "weight")
    wide = found(bank.stream_bank(spark, src, "weight", TTU, K, DIM, files_per_trigger=1, open_batches=4))
    assert wide == replay(data, "weight")  # four open steps: the rows are not late


def test_profile_over_micro_batches(spark, tmp_path):
    data = [r for r in rows(200, 12) if r[0] is not None]
    src, at = str(tmp_path / "src"), str(tmp_path / "run")
    for a, b in [(0, 33), (33, 90), (90, 91)]:
        put(spark, src, data[a:b])
    bank.stream_profile(spark, src, 0.9, 1, at=at)
    put(spark, src, data[91:])
    got = {(r["class"], r["dim"]): r["profile"] for r in bank.stream_profile(spark, src, 0.9, 1, at=at).collect()}
    df = pd.DataFrame(data, columns=["class", "batch_id", "vec_id", "w", "vec"])
    for c, own in df.groupby("class"):
        prof = None
        for _, g in own.groupby("batch_id"):
            q = np.stack(g["vec"].to_numpy()).mean(axis=0)
            prof = q if prof is None else 0.9 * prof + 0.1 * q
        assert np.allclose([got[int(c), j] for j in range(DIM)], prof)
