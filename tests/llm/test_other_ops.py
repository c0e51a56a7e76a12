"""Embeddings, quality, language, pages, mixing and the pipeline: against brute force, held-out labels and edge inputs."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from noisesift.llm import embeddings, html, language, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def brute_links(rows, threshold=0.98):
    """n_links and component of every row (id, vector, label)."""
    units = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, dtype=float) / np.linalg.norm(v) if ok else None)
    n, group = [0] * len(rows), {r[0]: r[0] for r in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = units[i], units[j]
        if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
            n[i] += 1
            n[j] += 1
            x, y = sorted((root(rows[i][0]), root(rows[j][0])))
            group[y] = x
    return sorted((r[0], n[k], root(r[0])) for k, r in enumerate(rows))


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # a bucket of a group of copies is split
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for size in (1, 1, 2, 3, 60, 5, 20):
        base = rng.standard_normal(24)
        for _ in range(size):
            v = base + rng.standard_normal(24) * rng.choice([0, 0.1, 0.2]) * np.linalg.norm(base) / 5
            rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(rng.integers(0, 2)) if size < 60 else 0))
            k += 1
    rows += [(k + 1, None, 0), (k + 2, [0.0] * 24, 0), (k + 3, [float("nan")] * 24, 0), (k + 4, [None] * 24, 0), (k + 5, rows[9][1], None), (k + 6, [], 0), (k + 7, [1.0, 2.0], 0), (k + 8, [2.0, 4.0], 0), (k + 9, [float("inf")] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS rep", "1 AS n")
    got = embeddings.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_cap_filters_meet_at_the_threshold():
    """Random pairs at cosine exactly 0.98 share a filter."""
    rng = np.random.default_rng(2)
    n, d = 2000, 64
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, d))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    keys = [np.unique(r * 10**9 + f) for r, f in (embeddings.list_decode(x) for x in (a, near))]
    shared = np.bincount(np.intersect1d(*keys) // 10**9, minlength=n)
    assert shared.min() >= 1


def test_list_decode_is_exact():
    """The pruned decoding returns just the combinations above the cap's height."""
    rng = np.random.default_rng(3)
    unit = embeddings._unit(rng.standard_normal((3, 12)))
    row, code = embeddings.list_decode(unit, 1.0)
    got = set(zip(row.tolist(), code.tolist(), strict=True))
    for c, (rotation, books) in enumerate(embeddings.codes(12)):
        s = [(unit @ rotation)[:, cols] @ book.T for cols, book in books]
        total = s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]
        bound = total.max(axis=(1, 2, 3)) - 1.0 / 2.0  # blocks of four coordinates
        want = {(int(i), int(((a * embeddings.BOOK + b) * embeddings.BOOK + e) * embeddings.CODES + c)) for i, a, b, e in zip(*np.nonzero(total >= bound[:, None, None, None] + 1e-12), strict=True)}
        assert want <= got


def test_quality_estimate_recovers_accuracies():
    rng = np.random.default_rng(4)
    n, good = 20_000, 0.8
    truth = rng.random(n) < good
    right = np.linspace(0.75, 0.97, len(quality.LABELLERS))
    votes = np.where(rng.random((n, len(right))) < right, truth[:, None], ~truth[:, None])
    v = np.where(votes, quality.GOOD, quality.BAD)
    v[rng.random(v.shape) < 0.2] = quality.NOTHING
    post, shares, prior = quality.estimate(Counter((v @ quality._PLACES).tolist()))
    assert abs(prior - good) < 0.03
    assert np.abs(shares[1][:, quality.GOOD] - right).max() < 0.05
    assert np.mean([(post[int(p)] > 0.5) == t for p, t in zip(v @ quality._PLACES, truth, strict=True)]) > 0.97


def test_quality_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r["_kept"] for r in quality.classify(docs, carry=("doc_id",)).collect()}
    assert np.mean([got[i] == bool(q) for i, q in labels.items()]) > 0.97
    assert np.mean([got[i] for i, q in labels.items() if q]) > 0.98


def test_quality_edges(spark):
    texts = [None, "", " \n", "Hello there.", "x" * 50_000, "!!! ### $$$ " * 300, "The cat sat on the mat. " * 3, "é ü 日本"] * 2
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).selectExpr("*", "'x' AS score")
    got = {r["doc_id"]: r["_kept"] for r in quality.classify(df, carry=("doc_id",)).collect()}
    assert len(got) == 16 and not got[0] and not got[1] and got[6] and not got[5]
    assert quality.drop_rejected(df).columns == df.columns
    assert quality.drop_rejected(df.limit(0)).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = {r["doc_id"]: r for r in language.predict(docs, language.train(docs)).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.98
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 ² $", "en", "s", 0), (4, "A", None, "s", 0), (4, "A", None, "s", 0)], DOCS)
    odd = odd.selectExpr("*", "'x' AS score")
    model = language.fit(["the cat and the dog"] * 9 + ["le chat et le chien"] * 9, ["en"] * 9 + ["fr"] * 9)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] in ("en", "fr")
    assert language.predict(odd.limit(0), language.train(odd.limit(0))).count() == 0


def test_language_is_blind_to_lang_of_held_out(spark):
    docs = spark.createDataFrame([(i, f"text number {i} here", "held" if zlib.crc32(str(i).encode()) % 3 == 1 else "en", "s", 0) for i in range(60)], DOCS)
    assert language.train(docs)[0] == ["en"]


PAGES = [
    ("http://a.com/1", "<body><nav>Menu</nav><div class='post-body'><h1>Title &amp; more</h1><p>One  two<b>three</b>.<p>Next<br>line</div><div class='sidebar'>x</div></body>", "Title & more One twothree. Next line"),
    ("http://a.com/2", "<div class='post-body'><p>Short.</p></div><div class='comments'><p>A long reader comment that goes on and on.</p></div>", "Short."),
    ("http://b.com/", "<html><header>H</header><article><p>A &lt;b&gt; &copy; &#233;</p><ul><li>x<li>y</ul><aside>no</aside></article><footer>F</footer><script>var a='<p>no</p>';</script>", "A <b> © é x y"),
    (None, None, ""),
    ("not a url", "just text, 1 < 2 and <3", "just text, 1 < 2 and <3"),
    ("http://c.com", "<p>unclosed <!-- comment", "unclosed"),
    ("http://c.com/x", "<style>p{}</style><p hidden>no</p><p>yes&nbsp;\n sir</p><form><p>no</p></form>", "yes sir"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(PAGES)] + [(0, *PAGES[0][:2])], "page_id long, url string, html string")
    df = df.selectExpr("*", "'x' AS path", "'y' AS host")
    got = html.extract(df).collect()
    assert len(got) == len(PAGES) + 1
    assert {r["page_id"]: r["text"] for r in got} == {i: t for i, (_, _, t) in enumerate(PAGES)}
    assert html.extract(df.limit(0)).count() == 0


def test_pages_consensus(spark):
    """The host's pages outvote a page on which something else is longer."""
    rows = [(i, f"http://h.org/{i}", f"<div class='c{i}'><p>{'body words ' * 30}</p></div><div class='x'><p>{'other ' * (200 if i == 7 else 3)}</p></div>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert all(t == ("body words " * 30).strip() for t in got.values())


def targets(sizes, weights=mixing.WEIGHTS, cap=mixing.CAP):
    """Iterative resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(9)
    rows, sizes = [], defaultdict(int)
    for i in range(600):
        source = rng.choice(["é", "a", "b", "Z", None, "tiny"]) if i % 3 else "hot"
        if source == "tiny" and rng.random() < 0.9:
            source = "hot"
        n = rng.choice([0, 1, 5, 30, 400])
        rows.append((i, " ".join(["w"] * n) if n else rng.choice([None, "", " "]), None, source, 0))
        sizes[source] += n
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS target")
    got = mixing.plan_mix(df).collect()
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] == len(r["positions"]) * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 200 for s in sizes)  # half of the largest document at most
    again = mixing.plan_mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    twice = mixing.mix(df.unionByName(df.where("doc_id < 5")))
    assert twice.count() == sum(r["copies"] for r in mixing.plan_mix(df.unionByName(df.where("doc_id < 5"))).collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.plan_mix(df.limit(0)).count() == 0


def test_mixing_of_rows_that_share_an_id(spark):
    """Differing rows of one id, source and size get the copies of one row each."""
    rows = [(None, f"w{k} b", "en", "s0", k) for k in range(40)] + [(7, f"v{k} c", "en", "s1", k) for k in range(30)]
    rows += [(7, "same text", "en", "s1", 0)] * 5 + [(100 + k, f"x{k} y z", "en", "s2", k) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.plan_mix(docs).collect()
    out = mixing.mix(docs).collect()
    for source in ("s0", "s1", "s2"):
        assert sum(r["source"] == source for r in out) == sum(r["copies"] for r in plan if r["source"] == source)
        want = Counter(r["copies"] for r in plan if r["source"] == source and r["copies"])
        got = Counter(Counter(r["text"] for r in out if r["source"] == source and r["text"] != "same text").values())
        assert max(got) <= mixing.CAP and all(got[n] <= want[n] for n in got)
        assert source == "s1" or got == want


def test_curriculum_follows_the_schedule(spark):
    """With slope s, the first half of training sees half minus s/4 of a source's words."""
    rows = [(i, "w " * 10, None, f"s{i % 3}", 0) for i in range(3000)]
    got = mixing.plan_mix(spark.createDataFrame(rows, DOCS), weights=(1.0, 1.0, 1.0)).collect()
    for k, slope in enumerate(mixing.SLOPES):
        early = np.mean([r["position"] < 0.5 for r in got if r["source"] == f"s{k}" and r["copies"]])
        assert abs(early - (0.5 - slope / 4)) < 0.01


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, pipeline):
    """Every stage on a small table, each against its own brute-force statement."""
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    stages = dict(pipeline.STAGES)
    cleaned = pipeline.staged(stages["quality"](spark, at, SF), "t")
    kept = {r["doc_id"] for r in quality.classify(docs, carry=("doc_id",)).where("_kept").collect()}
    assert cleaned.columns == docs.columns and {r["doc_id"] for r in cleaned.collect()} == kept

    repeated = cleaned.unionByName(cleaned.limit(5))
    deduped = pipeline.staged(stages["near_dedup"](spark, repeated, SF), "t")
    from test_text_ops import brute_groups

    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    want = sorted(i for i, (_, low) in brute_groups(texts, 5).items() if i == low)
    assert deduped.columns == docs.columns and sorted(r["doc_id"] for r in deduped.collect()) == want

    masked = pipeline.staged(stages["secrets"](spark, deduped, SF), "t")
    from noisesift.llm import secrets

    assert masked.columns == docs.columns and masked.count() == len(want)
    assert not any(secrets.base_spans(r["text"] or "", (r["text"] or "").encode()) for r in masked.collect())
    mixed = pipeline.staged(stages["mixing"](spark, masked, SF), "t")
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 3
    packed = stages["packing"](spark, mixed, SF)
    assert packed.where("piece = 0").count() == sum(copies.values())


def test_near_dedup_decides_by_row(spark, pipeline):
    """Rows of one id or of none are told apart by their text; clashing names and nulls are fine."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (3, a), (8, b), (None, c), (None, c), (None, c), (None, b + " end"), (9, None), (9, None), (10, ""), (None, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 5, 6) for i, t in rows], DOCS + ", _row long, kept long")
    got = pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    texts = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert texts == sorted([(3, a), (7, b), (None, c), (9, None), (10, ""), (None, None), (12, "")], key=str)
    assert pipeline.near_dedup(spark, docs.where("doc_id IN (3, 8)"), SF).count() == 2


def test_pipeline_stages_take_empty_tables(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
