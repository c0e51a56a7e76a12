"""A1 over every document, F1/F7 encoding in slices and one pass, D2 by digests, H9 from one pass over the history."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from noisesift.functions import text as T
from noisesift.operators import joins, runs
from noisesift.plans import io_plans, shaping


def _tables(spark, tmp_path, texts):
    docs = [(i, t, "en" if i % 2 else None, "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_a1_keeps_unlabelled_documents_and_the_labels(spark, tmp_path):
    d = _tables(spark, tmp_path, ["a b", 'quote " and\nbreak', None, "", "é\t中"])
    got = {r["index"]: r.asDict() for r in io_plans.a1_read_jsonl(spark, d).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert got[0] == {"index": 0, "text": "a b", "label": 1, "toxic": 0, "readability": 3.0, "cola": 0.5, "lang": None, "source": "src", "n_chars": 3}
    assert (got[1]["text"], got[1]["label"], got[1]["lang"]) == ('quote " and\nbreak', None, "en")
    assert (got[2]["text"], got[2]["label"], got[2]["readability"]) == (None, 0, None)
    assert (got[3]["text"], got[4]["text"]) == ("", "é\t中")


def test_ids_of_whole_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(T, "SLICE_BYTES", 50)
    rng = random.Random(5)
    white = [" ", "\t", "\n", "\r", "\x0b", "\x0c", " ", " ", "\x1c", "\x85"]
    texts = [None, "", "  ", *["".join(rng.choice([*white, "w%d" % rng.randrange(9), "中"]) for _ in range(rng.randrange(200))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "index long, text string").repartition(3)
    vocab = T.build_vocab(df, "text", 7)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    words = [[t for t in re.split(r"\s+", x or "", flags=re.ASCII) if t] for x in texts]
    want = {i: [ids.get(t, T.UNK_ID) for t in w[:10]] for i, w in enumerate(words)}
    for tokenizer in (vocab, lambda part: [[ids.get(t, 3) for t in re.split(r"\s+", x, flags=re.ASCII) if t] for x in part]):
        got = {r["index"]: list(r["ids"]) for r in T.token_ids(df, tokenizer, "text", "index", 10).collect()}
        assert got == want


def test_length_stats_encode_each_table_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def tokenizer(texts):
        calls.add(len(texts))
        return [[5] for _ in texts]

    df = spark.createDataFrame([(i, "x y") for i in range(30)], "index long, text string")
    frames = [T.encode_text(x, tokenizer, max_len=8) for x in (df, df.withColumn("text", F.lit("z")))]
    stats = T.length_stats({"train": frames[0], "aug": frames[1]})
    assert T.check_uniform_length(*frames, stats=stats) == 8
    assert sorted((r["tbl"], r["min_len"], r["max_len"], r["n"]) for r in stats.collect()) == [("aug", 8, 8, 30), ("train", 8, 8, 30)]
    assert calls.value <= 60  # twice that before
    assert T.check_uniform_length(df.select(F.array().alias("encode")).where("false")) == 0
    with pytest.raises(ValueError, match="differ"):
        T.check_uniform_length(frames[0], T.encode_text(df, tokenizer, max_len=9))


def test_d2_joins_digests_of_whole_texts(spark, tmp_path):
    d = _tables(spark, tmp_path, ["a e " * 2000, None, "", "same", "same"])
    out = shaping.d2_pair_sides(spark, d)
    sides = shaping._d2_sides(spark, d)
    want = joins.pair_sides(*sides).select("aug_method", "origin", F.md5("sentence1").alias("sentence1_md5"), F.md5("sentence2").alias("sentence2_md5"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join" in x)
    assert "md5(" not in plan.split(join)[0] and "md5(" in plan, "hashed below the join"


def test_halving_computes_the_history_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        seen.add(1)
        return x

    rng = random.Random(2)
    rows = [(None if t == 0 else f"t{t}", i, float("nan") if (t + i) % 7 == 0 else rng.random()) for t in range(40) for i in range(1, 1 + rng.randrange(30))]
    hist = spark.createDataFrame(rows, "trial string, iteration int, v double").select("trial", "iteration", value("v").alias("value"))
    got = sorted((r["rung"], r["rank"], r["trial"], r["value"]) for r in runs.halving_survivors(hist, 5, 2, 100).collect())
    alive, want = None, []
    for rung in (5, 10, 20, 40, 80):
        at = sorted((-(0.0 if v != v else v), t) for t, i, v in rows if i == rung and t is not None and (alive is None or t in alive))
        kept = at[: -(-len(at) // 2)]
        want += [(rung, k + 1, t, -v) for k, (v, t) in enumerate(kept)]
        alive = {t for _, t in kept}
    assert got == want
    assert seen.value <= len(rows)
