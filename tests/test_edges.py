"""Edge inputs: null classes, new classes, null and NaN orders, bursts, NaN metrics, cycling, list order."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noisesift.functions import text as T
from noisesift.operators import contrast, joins, runs, sampling
from noisesift.operators.ranking import ordered_position
from noisesift.streaming import bank


@pytest.mark.parametrize("keyed", [False, True])
def test_positions_equal_the_plain_window(spark, keyed):
    rng = random.Random(1)
    values = [None, math.nan, math.inf, -math.inf, 0.0, -1.5] + [rng.random() for _ in range(50)] + [1e9 + i * 1e-3 for i in range(300)]
    rows = [(i, rng.choice(["hot", "hot", "hot", "x", None]), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    keys = ["k"] if keyed else []
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy(*keys).orderBy("v", "id")) - 1)
    got = {r["id"]: r["pos"] for r in ordered_position(df, "v", keys, tiebreak=["id"]).collect()}
    assert got == {r["id"]: r["want"] for r in plain.collect()}


def test_average_rank_with_ties_null_and_nan(spark):
    from noisesift.functions.metrics import average_rank

    rng = random.Random(3)
    values = [None, None, math.nan, math.inf] + [float(rng.randrange(20)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] is not None and values[i] != values[i], values[i] if values[i] == values[i] and values[i] is not None else 0))
    want, k = {}, 0
    while k < len(order):
        same = [i for i in order[k:] if values[i] == values[order[k]] or (values[i] is not None and values[i] != values[i] and values[order[k]] != values[order[k]])]
        for i in same:
            want[i] = k + (len(same) + 1) / 2
        k += len(same)
    assert {r["id"]: r["r"] for r in average_rank(df, "v", "id", "r").collect()} == want


def test_null_class_on_both_paths(spark, monkeypatch):
    q = spark.createDataFrame([(0, 1, [1.0, 0.0], [0.5, 0.5], [1.0, 1.0]), (0, None, [0.0, 1.0], [0.1, 0.2], [1.0, 0.0])], "batch_id long, class int, q array<double>, q_aug array<double>, k array<double>")
    b = spark.createDataFrame([(1, 0, [0.3, 0.4]), (1, 1, [0.0, 1.0])], "class int, slot int, vec array<double>")

    def rows(df):
        return sorted((r["batch_id"], -1 if r["class"] is None else r["class"], round(r["loss"], 9), r["n"]) for r in df.collect())

    want = rows(contrast.info_nce(q, b, method="builtin"))
    assert len(want) == 2 and rows(contrast.info_nce_arrow(q, b)) == want
    monkeypatch.setattr(contrast, "BANK_COLLECT_LIMIT", 1)  # a bank too large to broadcast
    assert rows(contrast.info_nce(q, b)) == want and rows(contrast.info_nce_arrow(q, b)) == want


def test_bank_too_large_to_broadcast(spark, monkeypatch):
    q = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, None, [1.0, 0.0]), (2, 9, [1.0, 0.0])], "vec_id long, class int, vec array<double>")
    b = spark.createDataFrame([(1, 0, [0.5, 0.5], 0.0), (1, 1, [1.0, 0.0], 0.0)], "class int, slot int, vec array<double>, score double")

    def rows(df):
        return {r["vec_id"]: list(r["bank_dots"]) for r in df.collect()}

    want = rows(joins.score_against_bank(q, b, method="arrow"))
    assert want == {0: [1.5, 1.0], 1: [], 2: []}
    monkeypatch.setattr(joins, "BANK_COLLECT_CELLS", 1)
    assert rows(joins.score_against_bank(q, b)) == want


def test_bank_step_starts_a_new_class(spark):
    rows = spark.createDataFrame([(7, 1, 0.1, [1.0, 0.0]), (None, 2, 0.2, [0.0, 1.0])], "class int, vec_id long, w double, vec array<double>")
    start = bank.initial_bank_df(spark, 1, 2, 2, 5.0)
    got = bank.bank_apply_batch(start, rows, "weight", 5.0, 2).collect()
    assert {r["class"] for r in got} == {0, 7, None}
    assert any(r["vec_id"] == 1 for r in got if r["class"] == 7) and any(r["vec_id"] == 2 for r in got if r["class"] is None)


def test_supervised_contrast_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, 0, rng.choice([0, 1, None]), [rng.random() for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, batch_id long, class int, vec array<double>")
    whole = contrast.supervised_contrast(df, method="builtin").first()
    monkeypatch.setattr(contrast, "GRAM_ROWS", 7)
    got = contrast.supervised_contrast(df).first()
    assert got["anchors"] == whole["anchors"] and math.isclose(got["loss"], whole["loss"], rel_tol=1e-9)


def test_nan_metrics_never_win(spark):
    h = spark.createDataFrame([("a", 5, math.nan), ("a", 6, 0.3), ("b", 5, 0.8), ("b", 6, 0.1), ("c", 5, 0.5)], "trial string, iteration long, value double")
    best = runs.best_trial(h).first()
    assert (best["trial"], best["best_value"], best["best_iteration"]) == ("b", 0.8, 5)
    kept = {r["trial"]: r["rank"] for r in runs.halving_survivors(h, grace=5, eta=2, max_t=6).collect()}
    assert kept == {"b": 1, "c": 2}
    log = spark.createDataFrame([("e", "v", "Test/acc", 0, math.nan), ("e", "v", "Test/acc", 1, 0.7)], "experiment string, version string, metric string, step long, value double")
    assert {r["step"] for r in runs.rows_at_best_step(log).collect()} == {1}


def test_loaders_cycle_the_shorter_side(spark):
    def batches(n):
        return spark.createDataFrame([(i,) for i in range(n)], "batch_id long")

    def pairs(a, b):
        return sorted((r["step"], r["base_batch_id"], r["meta_batch_id"]) for r in sampling.pair_loaders(batches(a), batches(b)).collect())

    assert pairs(2, 5) == [(0, 0, 0), (1, 1, 1), (2, 0, 2), (3, 1, 3), (4, 0, 4)]
    assert pairs(3, 2) == [(0, 0, 0), (1, 1, 1), (2, 2, 0)]
    assert pairs(0, 2) == []


def test_grid_keeps_list_order(spark):
    lists = spark.createDataFrame([("lr", "4", 0), ("lr", "16", 1), ("lr", "8", 2), ("seed", "1", 0), ("seed", "1", 1)], "param string, value string, pos int")
    got = [r["config"] for r in joins.expand_grid(spark, lists, ["lr", "seed"], {"lr": "0", "x": "y"}).orderBy("version_no").collect()]
    assert [(g["lr"], g["seed"]) for g in got] == [(x, "1") for x in ("4", "4", "16", "16", "8", "8")]
    assert all(g["x"] == "y" for g in got)


def test_signature_of_a_config_without_a_key(spark):
    df = spark.createDataFrame([({"lr": "1", "bs": "2"},), ({"lr": "1"},)], "config map<string,string>")
    got = [r[0] for r in df.select(joins.config_signature(F.col("config"), ["lr", "bs"])).collect()]
    assert got[0] is not None and got[1] is None


def test_sweep_with_null_methods_and_classes(spark):
    aug = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 2), (None, 1.5, 1), ("b", 9.0, 0)], "aug_method string, readability double, label int")
    trials = spark.createDataFrame([(0, None, 0.0, 5.0), (1, ["a"], 0.0, 5.0), (2, ["zzz"], 0.0, 5.0)], "trial_id long, methods array<string>, lo double, hi double")
    got = {r["trial_id"]: (r["rows_kept"], r["n_class0"], r["n_class1"], r["mean_score"]) for r in runs.sweep(trials, aug).collect()}
    assert got == {0: (3, 1, 1, 1.5), 1: (2, 1, 0, 1.5)}
    by_class = {(r["trial_id"], r["label"]): r["rows_kept"] for r in runs.sweep_by_class(trials, aug).collect()}
    assert by_class == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (1, 0): 1, (1, 2): 1}


def test_user_tokenizer_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, "d"), (2, None)], "index long, text string")
    got = sorted((r["index"], list(r["encode"])) for r in T.encode_text(df, lambda texts: [[10 + len(w) for w in t.split()] for t in texts], max_len=5).collect())
    assert got == [(1, [0, 11, 2, 1, 1]), (1, [0, 12, 11, 2, 1]), (2, [0, 2, 1, 1, 1])]


def test_best_run_ties_nan_and_missing_scores(spark):
    from noisesift.operators.runs import best_run

    nan = float("nan")
    rows = [("a", "v2", 0.5, 1), ("a", "v1", 0.5, 2), ("a", "v3", nan, 3), ("b", "v1", nan, 4), ("b", "v0", None, 5), ("b", "v0", None, 6), (None, "v1", 1.0, 7), ("c", "v1", -1.0, 8), ("c", "v2", -0.5, 9)]
    df = spark.createDataFrame(rows, "experiment string, version string, interested double, id int")
    # ties go to the first version; a missing score counts as 0; a group without a name is no group
    assert {r["id"] for r in best_run(df).collect()} == {2, 5, 6, 9}
    assert best_run(df.limit(0)).collect() == []


def test_best_trial_missing_values_and_names(spark):
    from noisesift.operators.runs import best_trial

    rows = [("g", "t1", 1, None), ("g", "t2", 1, 0.5), ("g", "t2", 2, 0.5), ("g", None, 1, 0.5), ("h", "t1", 1, None), (None, "t9", 3, 2.0), ("k", None, 4, 1.0)]
    df = spark.createDataFrame(rows, "g string, trial string, iteration int, value double")
    got = {(r["g"], r["trial"], r["best_value"], r["best_iteration"]) for r in best_trial(df, group=["g"]).collect()}
    assert got == {("g", "t2", 0.5, 1), (None, "t9", 2.0, 3), ("k", None, 1.0, 4)}
    one = best_trial(df.where("g = 'g'")).collect()
    assert [(r["trial"], r["best_value"]) for r in one] == [("t2", 0.5)]
    assert best_trial(df.limit(0)).collect() == []


def test_spearman_reads_its_input_once(spark):
    from noisesift.functions.metrics import spearman

    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(i, float(i % 7), float((i * i) % 5)) for i in range(50)], "id int, x double, y double")
    got = spearman(df.mapInPandas(tick, df.schema), "x", "y", "id", with_pearson=True).first()
    ranks = df.toPandas()[["x", "y"]].rank()
    assert abs(got["spearman"] - ranks["x"].corr(ranks["y"])) < 1e-9
    assert seen.value == 50
