"""Finished trials by subset, sweeps by elementary intervals, user scorers, blocks and tiles: against plain replays."""

import math
import random

import numpy as np
import pytest

from noisesift.operators import contrast, joins, runs, tiles


def plain_skip(planned, finished, ignore=joins.UNINTERESTED_KEYS):
    """Largest key set first, then version order; each finished config cancels one trial."""
    free, out = list(finished), []
    keys = lambda c: sorted(k for k in c if not any(s in k for s in ignore))
    for v, c in sorted(planned, key=lambda p: (-len(keys(p[1])), keys(p[1]), p[0])):
        fit = next((f for f in free if all(k in f and f[k] == c[k] for k in keys(c))), None)
        if fit is None:
            out.append(v)
        else:
            free.remove(fit)
    return sorted(out)


def test_trials_that_lack_keys(spark):
    finished = [{"lr": "1", "bs": "2", "path": "x"}, {"lr": "1", "bs": "3"}, {"lr": "2"}, {"lr": "1", "bs": None}]
    planned = [(0, {"lr": "1"}), (1, {"lr": "1", "bs": "2", "version_no": "9"}), (2, {"lr": "2", "bs": "2"}), (3, {"lr": "1", "bs": None}), (4, {"lr": "1"}), (5, {"lr": "1"}), (6, {"lr": "2"})]
    p = spark.createDataFrame(planned, "version_no long, config map<string,string>")
    f = spark.createDataFrame([(c,) for c in finished], "config map<string,string>")
    got = sorted(r["version_no"] - 100 for r in joins.skip_finished(p, f, existing_runs=100).collect())
    assert got == plain_skip(planned, finished) == [2, 4, 5]
    assert joins.skip_finished(p, f.limit(0)).count() == 7 and joins.skip_finished(p.limit(0), f).count() == 0


def test_matching_many_trials(spark):
    rng = random.Random(5)
    config = lambda: {k: rng.choice("123") for k in ("lr", "bs", "wd")}
    finished = [config() for _ in range(40)]
    full = [(v, config()) for v in range(60)]
    nested = [(v, {k: c[k] for k in (("lr", "bs", "wd"), ("lr", "bs"), ("lr",))[v % 3]}) for v, c in full]
    f = spark.createDataFrame([(c,) for c in finished], "config map<string,string>")
    for planned in (full, nested):
        p = spark.createDataFrame(planned, "version_no long, config map<string,string>")
        got = sorted(r["version_no"] for r in joins.skip_finished(p, f).collect())
        assert len(got) == len(plain_skip(planned, finished))
    assert got == plain_skip(planned, finished)  # counts per signature are the same whichever run is used


def test_sweep_against_every_trial(spark, monkeypatch):
    rng = random.Random(2)
    scores = [None, math.nan, math.inf, -math.inf, -0.0, 0.0, 1.0, 1.0] + [rng.uniform(-2, 2) for _ in range(300)]
    rows = [(rng.choice(["a", "b", None]), s, rng.choice([0, 1, 2, None])) for s in scores]
    ends = [-math.inf, -1.0, -0.0, 0.0, 0.5, 1.0, math.inf, math.nan, None]
    trials = [(i, rng.choice([None, ["a"], ["a", "b"], [], [None]]), rng.choice(ends), rng.choice(ends)) for i in range(120)]
    aug = spark.createDataFrame(rows, "aug_method string, readability double, label int")
    t = spark.createDataFrame(trials, "trial_id long, methods array<string>, lo double, hi double")
    more = lambda a, b: a > b or (math.isnan(a) and not math.isnan(b))  # noqa: E731  NaN is the largest value
    want, by_class = {}, {}
    for i, methods, lo, hi in trials:
        kept = [r for r in rows if lo is not None and hi is not None and r[1] is not None and (methods is None or r[0] in [m for m in methods if m]) and more(r[1], lo) and more(hi, r[1])]
        kept = [r for r in kept if math.isfinite(r[1])]
        if kept:
            want[i] = (len(kept), sum(r[2] == 0 for r in kept), sum(r[2] == 1 for r in kept), round(sum(r[1] for r in kept) / len(kept), 9))
        for r in kept:
            by_class[i, r[2]] = by_class.get((i, r[2]), 0) + 1
    for most in (100_000, 30):
        monkeypatch.setattr(runs, "TRIALS_PER_PASS", most)
        got = {r["trial_id"]: (r["rows_kept"], r["n_class0"], r["n_class1"], round(r["mean_score"], 9)) for r in runs.sweep(t, aug).collect()}
        assert got == want
        assert {(r["trial_id"], r["label"]): r["rows_kept"] for r in runs.sweep_by_class(t, aug).collect()} == by_class


def test_a_scorer_of_texts_and_nulls(spark):
    def scorer():
        def predict(texts, xs):
            return {"features": np.array([[len(t), x.sum()] for t, x in zip(texts, xs)], dtype=float), "loss": np.array([float(len(t)) for t in texts])}

        return predict

    df = spark.createDataFrame([(0, "abc", [1.0, 2.0]), (1, None, [1.0, 1.0]), (2, "", None), (3, "", [0.5, 0.5])], "id long, text string, x array<double>")
    got = {r["id"]: r for r in contrast.batch_features(df, scorer=scorer, inputs=["text", "x"], shapes=[None, [2]], outputs="features array<double>, loss double", batch_size=2).collect()}
    assert got[0]["features"] == [3.0, 3.0] and got[0]["loss"] == 3.0 and got[0]["x"] == [1.0, 2.0]
    assert got[1]["features"] is None and got[2]["loss"] is None and got[3]["features"] == [0.0, 1.0]


@pytest.mark.parametrize("cells", [4, 1000])
def test_blocks_of_a_bank(spark, cells):
    rng = np.random.default_rng(3)
    vec = lambda: [float(v) for v in rng.standard_normal(2)]
    b = spark.createDataFrame([(c, s, vec()) for c in (0, 1, None) for s in range(6)], "class int, slot int, vec array<double>")
    q = spark.createDataFrame([(k % 2, c, vec(), vec(), vec()) for k, c in enumerate([0, 0, 1, 1, None, 7, 0])], "batch_id long, class int, q array<double>, q_aug array<double>, k array<double>")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(map(tuple, contrast.info_nce(q, b, 0.3, method="builtin").collect()), key=key)
    got = sorted(map(tuple, tiles.info_nce_blocks(q, b, 0.3, cells=cells).collect()), key=key)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    dots = {tuple(r["vec"]): r["bank_dots"] for r in tiles.score_blocks(q.withColumnRenamed("q", "vec"), b, cells=cells).collect()}
    banks = {c: np.array([r["vec"] for r in b.orderBy("slot").collect() if r["class"] == c]) for c in (0, 1)}
    for r in q.collect():
        assert np.allclose(dots[tuple(r["q"])], banks[r["class"]] @ np.array(r["q"]) if r["class"] in banks else [])


def test_tiles_of_a_batch_with_views_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(k // 4, b, rng.choice([0, 1, None]), [float(v) for v in rng.standard_normal(3)], [float(v) for v in rng.standard_normal(3)]) for k, b in enumerate([0] * 30 + [1] * 9 + [2] + [None] * 5)]
    rows = [(i, b, None if c is None else int(c), v, a) for i, b, c, v, a in rows]
    df = spark.createDataFrame(rows, "vec_id long, batch_id long, class int, vec array<double>, aug array<double>")
    for views in ((), ("aug",)):
        got = {r["batch_id"]: (r["loss"], r["anchors"]) for r in tiles.supervised_contrast_tiles(df, 0.5, 0.1, aug_vecs=views, tile=4).collect()}
        for b in (0, 1, 2, None):
            own = [(r[2], v) for r in rows if r[1] == b for v in (r[3:5] if views else r[3:4])]
            x, y = np.array([v for _, v in own]), [c for c, _ in own]
            s, losses = x @ x.T / 0.5, []
            for i in range(len(y)):
                other = [j for j in range(len(y)) if j != i]
                pos = [j for j in other if y[j] == y[i] and y[i] is not None]
                if pos:
                    losses.append(-5.0 * (s[i][pos].mean() - np.log(np.exp(s[i][other]).sum())))
            if losses:
                assert got[b][1] == len(losses) and math.isclose(got[b][0], np.mean(losses), rel_tol=1e-9)
            else:
                assert b not in got
