"""Property tests and hand-made cases (FIXTURES.md section 5) on local Spark."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from noisesift import fixtures
from noisesift.functions import metrics as M
from noisesift.functions import text as T
from noisesift.operators import contrast, joins, ranking, runs, sampling, shape, weights
from noisesift.session import scratch_dir
from noisesift.sources import io
from noisesift.streaming import bank


def _train(spark, d=SF_MID):
    return shape.alias_target(fixtures.train(spark, d))


# ------------------------------------------------------------------ ranks and splits
def test_rank_helper_equals_plain_window_on_skewed_keys(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag")
    li = li.dropDuplicates(["id"])
    got = ranking.hashed_rank(li, ["l_returnflag"], "id", 7, "rk", digits=2)
    w = Window.partitionBy("l_returnflag").orderBy(ranking.hash_order("id", 7), F.col("id"))
    want = li.withColumn("rk", F.row_number().over(w))
    assert got.select("id", "rk").exceptAll(want.select("id", "rk")).count() == 0
    assert got.count() == want.count()


def test_ordered_position_global(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    pos = ranking.ordered_position(df, "k").collect()
    assert sorted((r["k"], r["pos"]) for r in pos) == [(k, i) for i, k in enumerate(range(0, 1000, 3))]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_split_same_under_any_partitioning(spark, parts):
    tr = _train(spark).repartition(parts)
    clean, meta = sampling.stratified_split(tr, 0.9)
    base_clean, _ = sampling.stratified_split(_train(spark), 0.9)
    assert sorted(r[0] for r in clean.select("index").collect()) == sorted(r[0] for r in base_clean.select("index").collect())


def test_split_disjoint_covering_and_stratified(spark):
    tr = _train(spark)
    clean, meta = sampling.stratified_split(tr, 0.9)
    ci = {r[0] for r in clean.select("index").collect()}
    mi = {r[0] for r in meta.select("index").collect()}
    ai = {r[0] for r in tr.select("index").collect()}
    assert not (ci & mi) and (ci | mi) == ai
    counts = {r["class"]: r["count"] for r in tr.groupBy("class").count().collect()}
    for r in clean.groupBy("class").count().collect():
        assert abs(r["count"] - 0.9 * counts[r["class"]]) <= 1


def test_split_minus_one_is_whole_table(spark):
    tr = _train(spark, SF_SMALL)
    a, b = sampling.stratified_split(tr, -1)
    assert a.count() == b.count() == tr.count()


# ------------------------------------------------------------------ E6, E7, E9, E10
def test_oversample_balances_and_keeps_originals(spark):
    tr = _train(spark)
    bal = sampling.oversample_to_max(spark, tr)
    counts = [r["count"] for r in bal.groupBy("class").count().collect()]
    assert len(set(counts)) == 1
    assert bal.where(~F.col("is_copy")).count() == tr.count()
    assert bal.select("sample_id").distinct().count() == bal.count()


def test_round_robin_batches_are_full_and_balanced(spark):
    bal = sampling.oversample_to_max(spark, _train(spark))
    b = sampling.round_robin_batches(bal, 4, "class", "sample_id", first_seen="index")
    sizes = {r["count"] for r in b.groupBy("batch_id").count().collect()}
    assert sizes == {4}
    per = b.groupBy("batch_id", "class").count().collect()
    assert {r["count"] for r in per} == {2}


def test_length_align_cycles_and_cuts(spark):
    df = spark.createDataFrame([(i * 10,) for i in range(3)], "index long")
    out = sampling.length_align(df, 8).orderBy("pos").collect()
    assert [r["index"] for r in out] == [0, 10, 20, 0, 10, 20, 0, 10]
    cut = sampling.length_align(spark.createDataFrame([(i,) for i in range(8)], "index long"), 3).orderBy("pos").collect()
    assert [r["index"] for r in cut] == [0, 1, 2]
    with pytest.raises(ValueError):
        sampling.length_align(spark.createDataFrame([], "index long"), 3)


def test_batches_drop_last_only_when_asked(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "index long")
    train = sampling.shuffle_batches(df, 3, drop_last=True)
    assert train.select("batch_id").distinct().count() == 2 and train.count() == 6
    ev = sampling.shuffle_batches(df, 3, shuffle=False, drop_last=False)  # X10: evaluation keeps every row
    assert ev.count() == 7 and ev.select("batch_id").distinct().count() == 3


def test_multiclass_flip_never_keeps_label(spark):
    w = fixtures.weighted(spark, SF_SMALL)
    f = sampling.flip_labels(w, 0.5, 10, "label", "vec_id").where("is_flipped")
    assert f.where(F.col("label") == F.col("orig_label")).count() == 0
    assert f.where((F.col("label") < 0) | (F.col("label") > 9)).count() == 0


# ------------------------------------------------------------------ B, C hand cases
def test_pad_scores_branches(spark):
    tr = spark.createDataFrame([(1, 0, "a")], "index long, label int, text string")
    none = spark.createDataFrame([(1, "m", "x")], "origin long, aug_method string, text string")
    _, a, pair = shape.pad_scores(tr, none)
    assert not pair and a.first()["readability"] == 10.0 and a.first()["cola"] == 0.5
    one = none.withColumn("ReadScore", F.lit(33.0))
    _, a, pair = shape.pad_scores(tr, one)
    assert not pair and a.first()["readability"] == 33.0
    two = one.withColumn("ColaScore", F.lit(0.7))
    t, a, pair = shape.pad_scores(tr, two)
    r = a.first()
    assert pair and (r["readability"], r["readability1"], r["readability2"]) == (10.0, 33.0, 0.7)
    assert t.first()["readability"] == 10.0


def test_open_interval_excludes_bounds(spark):
    df = spark.createDataFrame([(20.0,), (200.0,), (20.5,)], "readability double")
    assert [r[0] for r in shape.filter_interval(df, 20, 200).collect()] == [20.5]
    with pytest.raises(ValueError):
        shape.require_nonempty(shape.filter_interval(df, 300, 400))


# ------------------------------------------------------------------ D5, D6
def test_skip_finished_cancels_one_trial_per_finished_run(spark):
    planned = spark.createDataFrame(
        [(0, {"lr": "1", "bs": "4", "version_no": "0"}), (1, {"lr": "1", "bs": "4", "version_no": "1"}),
         (2, {"lr": "2", "bs": "4", "version_no": "2"})], "version_no long, config map<string,string>")
    finished = spark.createDataFrame([({"lr": "1", "bs": "4", "version_no": "9", "path": "x"},)], "config map<string,string>")
    out = joins.skip_finished(planned, finished, ["lr", "bs", "version_no"], existing_runs=5).collect()
    assert sorted(r["version_no"] for r in out) == [6, 7]


def test_expand_grid_product_order(spark):
    lists = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "x"), ("b", "y"), ("b", "z")], "param string, value string")
    g = joins.expand_grid(spark, lists, ["a", "b"]).orderBy("version_no").collect()
    assert [(r["a"], r["b"]) for r in g] == [(a, b) for a in "12" for b in "xyz"]
    assert [r["version_no"] for r in g] == list(range(6))


# ------------------------------------------------------------------ text
def test_encode_text_truncates_pads_and_handles_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "")], "index long, text string")
    vocab = T.build_vocab(df, "text", 100)
    out = {r["index"]: r["encode"] for r in T.encode_text(df, vocab, "text", "index", 5).collect()}
    assert len(out[1]) == 5 and out[1][0] == 0 and out[1][-1] == 2
    assert out[2] == [0, 2, 1, 1, 1]
    mask = T.encode_text(df, vocab, "text", "index", 5).select(T.attention_mask("encode").alias("m")).collect()
    assert sorted(tuple(r["m"]) for r in mask) == [(1, 1, 0, 0, 0), (1, 1, 1, 1, 1)]


def test_encode_pair_uses_second_sentence_and_pad_id(spark):
    df = spark.createDataFrame([(1, "x y", "p q r")], "index long, sentence1 string, sentence2 string")
    vocab = T.build_vocab(df.select(F.col("sentence1").alias("text")).unionByName(df.select(F.col("sentence2").alias("text"))), "text", 100)
    v = {r["token"]: r["id"] for r in vocab.collect()}
    enc = T.encode_pair(df, vocab, "sentence1", "sentence2", "index", 16).first()["encode"]
    assert enc[:9] == [0, v["x"], v["y"], 2, 2, v["p"], v["q"], v["r"], 2]  # X2: side 2 is sentence2
    assert enc[9:] == [1] * 7  # X3: always the pad id


def test_splice_separator(spark):
    df = spark.createDataFrame([([0, 5, 6, 2, 0, 7, 2],), ([0, 5, 2],)], "ids array<int>")
    out = [r[0] for r in df.select(T.splice_separator("ids")).collect()]
    assert out == [[0, 5, 6, 2, 2, 2, 7, 2], [0, 5, 2]]


def test_columnar_json_hand_case(spark):
    path = scratch_dir(spark, "t-a2")
    os.makedirs(path.replace("file:", ""), exist_ok=True)
    with open(os.path.join(path.replace("file:", ""), "x.json"), "w") as f:
        f.write('{"sentence":{"0":"a","10":"b"},"label":{"0":1,"10":0},"idx":{"0":0,"10":1}}')
    out = io.read_columnar_json(spark, path).orderBy("index").collect()
    assert [(r["index"], r["label"], r["sentence"]) for r in out] == [(0, "1", "a"), (10, "0", "b")]
    assert "idx" not in out[0].asDict()


# ------------------------------------------------------------------ metrics, runs
def test_prf_zero_when_no_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    r = M.binary_prf(df, "y", "p").first()
    assert (r["pos_precision"], r["pos_recall"], r["pos_f1"]) == (0.0, 0.0, 0.0)


def test_best_run_ties_first_version_and_nan_is_zero(spark):
    rows = spark.createDataFrame(
        [("e", "version_1", "Test/acc", 0.5, 0.9), ("e", "version_2", "Test/acc", 0.4, 0.9),
         ("f", "version_3", "Test/acc", 0.1, float("nan")), ("f", "version_4", "Test/acc", 0.2, -1.0)],
        "experiment string, version string, metric string, value double, interested double")
    best = {r["experiment"]: r["version"] for r in runs.best_run(rows).collect()}
    assert best == {"e": "version_1", "f": "version_3"}


def test_step_is_a_rank_of_wall_time(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [("e", "v", "m", t0 + dt.timedelta(seconds=s), i, 0.0) for i, s in enumerate([30, 10, 20])],
        "experiment string, version string, metric string, wall_time timestamp, event_id long, value double")
    got = {r["event_id"]: r["step"] for r in runs.step_by_time(log).collect()}
    assert got == {0: 2, 1: 0, 2: 1}  # X9: a rank, not an argsort


def _plateau_replay(values, init, factor, patience, min_hyper, cooldown):
    best, bad, cool, hyper, out = math.inf, 0, 0, init, []
    for v in values:
        if v < best * (1 - 1e-4):
            best, bad = v, 0
        else:
            bad += 1
        if cool > 0:
            cool, bad = cool - 1, 0
        if bad > patience:
            new = max(hyper * factor, min_hyper)
            if hyper - new > 1e-8:
                hyper = new
            cool, bad = cooldown, 0
        out.append(hyper)
    return out


def test_plateau_reduces_value_with_floor(spark):
    vals = [1.0, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9]
    hist = spark.createDataFrame([("t", i, v) for i, v in enumerate(vals)], "trial string, epoch long, metric double")
    out = [r["hyper"] for r in runs.plateau_events(hist, 1.0, factor=0.1, patience=1, min_hyper=0.005, cooldown=1).orderBy("epoch").collect()]
    assert out == pytest.approx(_plateau_replay(vals, 1.0, 0.1, 1, 0.005, 1))
    assert min(out) == pytest.approx(0.005)  # X7: the floor is honoured and the value (not the epoch) is reduced


# ------------------------------------------------------------------ contrast, weights
def test_supervised_contrast_drops_anchor_without_partner(spark):
    df = spark.createDataFrame([(0, 1, 0, [1.0, 0.0]), (0, 2, 0, [0.0, 1.0]), (0, 3, 1, [1.0, 1.0])],
                               "batch_id long, vec_id long, class int, vec array<double>")
    r = contrast.supervised_contrast(df, 0.5, 0.5).first()
    assert r["anchors"] == 2  # X8: the class-1 anchor has no positive and is dropped


def test_contrast_total_absent_class_adds_zero(spark):
    inner = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0)], "batch_id long, class int, loss double")
    out = contrast.contrast_total(inner, None, 3, 1.0).first()
    assert out["total"] == pytest.approx(3 * 1.0 + 1 * 2.0)  # class 1 absent: 0 (X13)


def test_weighted_loss_pairs_weight_and_loss_by_row(spark):
    aug = spark.createDataFrame([(1.0, 2.0), (0.0, 10.0)], "w double, loss double")
    r = weights.weighted_loss(aug, None).first()
    assert r["weighted_aug_loss"] == pytest.approx(1.0)  # X4: mean(w*l), not mean(w)*mean(l)=3


def test_meta_gradient_matches_finite_difference(spark):
    from noisesift.plans.contrast_plans import ETA, _meta_parts, theta0

    aug, clean, val = _meta_parts(spark, SF_SMALL)
    th = theta0()
    step = weights.meta_influence(aug, clean, val, th, ETA)
    fd = weights.meta_influence_fd(step.influence, step.g_val_next, th, ETA, aug.count(), eps=1e-4).collect()
    for r in fd:
        assert r["dot_val_fd"] == pytest.approx(r["dot_val"], rel=1e-3, abs=1e-7)


def test_gate_arrow_path_equals_builtin(spark):
    from noisesift.plans.contrast_plans import GATE

    w = fixtures.weighted(spark, SF_SMALL)
    a = {r["vec_id"]: r["weight"] for r in weights.instance_weight(w, GATE, "embedding", "label").collect()}
    b = {r["vec_id"]: r["weight"] for r in weights.instance_weight_arrow(w, GATE, "embedding", "label").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


# ------------------------------------------------------------------ bank
def _state(scores, lives, k=2, dim=1):
    return {"vecs": np.zeros((k, dim)), "scores": np.array(scores, float), "lives": np.array(lives, float), "ids": -1 - np.arange(k)}


def test_bank_policies_differ_on_expired_slot_and_low_newcomer():
    st = _state([0.9, 0.2], [1, 5])  # slot 0 expires this step; slot 1 live with a low score
    new_v, new_w, new_id = np.ones((2, 1)), np.array([0.1, 0.8]), np.array([10, 11])
    w = bank.bank_step(st, new_v, new_w, new_id, "weight", 3)
    t = bank.bank_step(st, new_v, new_w, new_id, "time", 3)
    assert list(w["ids"]) == [10, 11]  # weight: both live pairs first (0.9 <- 0.1, 0.2 <- 0.8)
    assert list(t["ids"]) == [11, 10]  # time: the expired slot takes the largest newcomer first
    assert list(w["ids"]) != list(t["ids"])


def _replay(rows: pd.DataFrame, policy, ttu, k, dim):
    out = {}
    for c, g in rows.groupby("class"):
        st = bank.initial_bank(int(c) + 1, k, dim, ttu)[int(c)]
        for _, b in sorted(g.groupby("batch_id"), key=lambda x: x[0]):
            st = bank.bank_step(st, np.stack(b["vec"].to_numpy()), b["w"].to_numpy(float), b["vec_id"].to_numpy(np.int64), policy, ttu)
        out[int(c)] = st
    return out


@pytest.mark.parametrize("policy", ["weight", "time"])
def test_stream_bank_equals_plain_replay(spark, policy):
    w = fixtures.weighted(spark, SF_MID)
    rows = w.select(F.col("label").cast("int").alias("class"), "batch_id", "vec_id", "w", F.col("embedding").alias("vec"))
    k, ttu, dim = 4, 2.0, 64
    src = bank.stage_stream_source(spark, rows)
    got = bank.stream_bank(spark, src, policy, ttu, k, dim).collect()
    want = _replay(rows.toPandas(), policy, ttu, k, dim)
    assert len(got) == 10 * k
    for r in got:
        st = want[r["class"]]
        assert r["vec_id"] == st["ids"][r["slot"]]
        assert r["score"] == pytest.approx(st["scores"][r["slot"]])
        assert r["life"] == pytest.approx(st["lives"][r["slot"]])
        assert r["vec_id"] == r["vec_id"]


def test_batch_bank_step_equals_plain_step(spark):
    w = fixtures.weighted(spark, SF_SMALL)
    rows = w.select(F.col("label").cast("int").alias("class"), F.lit(0).alias("batch_id"), "vec_id", "w", F.col("embedding").alias("vec"))
    k, ttu, dim = 3, 2.0, 64
    got = bank.bank_apply_batch(bank.initial_bank_df(spark, 10, k, dim, ttu), rows, "time", ttu, k).collect()
    want = _replay(rows.toPandas(), "time", ttu, k, dim)
    for r in got:
        assert r["vec_id"] == want[r["class"]]["ids"][r["slot"]]


def test_arrow_gradient_equals_builtin_cells(spark):
    from noisesift.plans.contrast_plans import _meta_parts, theta0

    aug, _, _ = _meta_parts(spark, SF_SMALL)
    a = weights.softmax_grad(aug, theta0(), "x", "y", F.col("w"))
    b = weights.softmax_grad_cells(aug, theta0(), "x", "y", F.col("w"))
    assert np.allclose(a, b, rtol=1e-9, atol=1e-12)


def test_align_keeps_both_sides_whole(spark):
    clean = spark.createDataFrame([(1, "a", 0)], "index long, text string, class int")
    aug = spark.createDataFrame([(1, "CharswapAug", "b", 0), (1, "WordnetAug", "c", 0)], "origin long, aug_method string, text string, class int")
    out = joins.flatten_sides(joins.align(clean, aug))
    assert {"origin_aug", "aug_method_aug", "index_raw", "text_raw", "text_aug"} <= set(out.columns)  # X5
    assert out.count() == 2


def test_rank_helper_spreads_a_hot_key(spark):
    """A key with about half the rows must not land in one partition (plain window does)."""
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linestatus").dropDuplicates(["id"])
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        def max_share(df):
            # rk is used by the aggregate, so the ranking stage is not pruned away.
            per = df.select(F.spark_partition_id().alias("p"), "rk").groupBy("p").agg(
                F.count(F.lit(1)).alias("count"), F.max("rk").alias("m")).collect()
            return max(r["count"] for r in per) / sum(r["count"] for r in per)

        hot = li.groupBy("l_linestatus").count().agg(F.max("count")).first()[0] / li.count()
        plain = li.withColumn("rk", F.row_number().over(Window.partitionBy("l_linestatus").orderBy("id")))
        ours = ranking.hashed_rank(li, ["l_linestatus"], "id", 7, "rk")
        assert hot > 0.3 and max_share(plain.select("id", "rk")) >= hot - 0.01
        assert max_share(ours.select("id", "rk")) < hot / 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)


def test_pair_sides_sampled_draws_distinct_pairs_without_all_pairs(spark):
    s1 = spark.createDataFrame([("m", 1, f"a{i}") for i in range(50)] + [("m", 2, "b0")], "aug_method string, origin long, id1 string")
    s2 = spark.createDataFrame([("m", 1, f"c{j}") for j in range(40)] + [("m", 2, "d0"), ("m", 2, "d1")], "aug_method string, origin long, id2 string")
    out = joins.pair_sides_sampled(s1, s2, 5, "id1", "id2").collect()
    hot = [(r["id1"], r["id2"]) for r in out if r["origin"] == 1]
    small = [(r["id1"], r["id2"]) for r in out if r["origin"] == 2]
    assert len(hot) == 5 and len(set(hot)) == 5
    assert sorted(small) == [("b0", "d0"), ("b0", "d1")]  # fewer pairs than n: all of them


def test_batch_features_both_methods(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "index long, text string")
    md5 = {r["index"]: r["features"] for r in contrast.batch_features(df, "text", 8, id_col="index").collect()}
    assert sum(md5[1]) == 3.0 and sum(md5[2]) == 0.0 and len(md5[1]) == 8
    tf = {r["index"]: r["features"] for r in contrast.batch_features(df, "text", 8, method="hashing_tf").collect()}
    assert sum(tf[1]) == 3.0 and len(tf[1]) == 8


def test_null_class_rows_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "index long, class int")
    clean, meta = sampling.stratified_split(df, 0.5)
    assert clean.count() + meta.count() == 60
    assert clean.where(F.col("class").isNull()).count() == 10  # 20 null-class rows split 10 / 10
    r = ranking.hashed_rank(df, ["class"], "index", 1, "rk")
    assert r.count() == 60 and r.where(F.col("class").isNull()).agg(F.max("rk")).first()[0] == 20


def test_ordered_position_bursty_order_and_nulls(spark):
    vals = [1e9 + i * 1e-3 for i in range(900)] + [float(i) for i in range(100)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)] + [(5000, None)], "id long, t double")
    got = {r["id"]: r["pos"] for r in ranking.ordered_position(df, "t", tiebreak=["id"]).collect()}
    order = [5000] + [i for i, _ in sorted(enumerate(vals), key=lambda p: (p[1], p[0]))]  # nulls first
    assert [got[i] for i in order] == list(range(len(order)))
