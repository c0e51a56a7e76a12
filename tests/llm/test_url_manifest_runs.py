"""URL filter, Merkle manifest and periodic runs: against brute force and edge inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from noisesift.llm import manifest, runs, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------ URL filter
def plain_judge(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
    best = None
    for action, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (len(rule), len(h), action)
            best = max(best or key + (rule,), key + (rule,))
    return host, path, best[3] if best else None, best[2] if best else default


def random_rules(rng, n):
    name = lambda k: ".".join(rng.choice(["a", "b", "com", "net", ""]) for _ in range(rng.randint(1, k)))
    tail = lambda: "".join("/" + rng.choice(["", "x", "xy", "z"]) for _ in range(rng.randint(0, 3)))
    return [(rng.choice(["allow", "block"]), r) for r in (name(3) + tail() for _ in range(n)) if r]


@pytest.mark.parametrize("per_trie", [1000, 7])
def test_urls_against_every_rule(spark, monkeypatch, per_trie):
    monkeypatch.setattr(urls, "RULES_PER_TRIE", per_trie)
    rng = random.Random(3)
    rules = random_rules(rng, 40)
    host = lambda: ".".join(rng.choice(["a", "B", "b", "com", "net", ""]) for _ in range(rng.randint(1, 4)))
    pages = [None, "", "no scheme", "http://", "HTTP://COM", "http://a.com?x/y", "x://b.com#/x", "http://a://b", "http://com\n/x", "http://" + "a." * 5000 + "com/" + "x/" * 5000]
    pages += ["https://" + host() + "".join("/" + rng.choice(["", "x", "xyz", "z"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", "?q=/x", "#x"]) for _ in range(300)]
    rows = [(k % 200, u, "r", "h") for k, u in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    table = spark.createDataFrame(rules + rules[:3], "action string, rule string")
    want = sorted((r[0], *plain_judge(r[1], rules)) for r in rows)
    key = lambda r: tuple(str(x) for x in r)
    for given in [rules, table] if per_trie > 100 else [table]:
        assert sorted(map(tuple, urls.judge(df, given).collect()), key=key) == sorted(want, key=key)
    assert urls.judge(df.limit(0), table).count() == 0


def test_url_defaults_and_bad_rules(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge(df, [], default="block").first()["verdict"] == "block"
    assert urls.judge(df, [("allow", "A.org"), ("block", "a.ORG")]).first()["verdict"] == "block"
    with pytest.raises(ValueError):
        urls.judge(df, [("deny", "a.org/")])


# ------------------------------------------------------------------ Merkle manifest
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(digests):
    """Last node, and for each place its (before, after) digests level by level."""
    paths = [[] for _ in digests]
    under = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        cut = [range(k, min(k + 3, len(digests))) for k in range(0, len(digests), 3)]
        for run in cut:
            for k in run:
                for leaf in under[k]:
                    paths[leaf].append(("".join(digests[j] for j in run if j < k), "".join(digests[j] for j in run if j > k)))
        under = [sum((under[k] for k in run), []) for run in cut]
        digests = [h(*(digests[k] for k in run)) for run in cut]
    return (digests or [None])[0], paths


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded_root, verified); rows: dicts of the fields."""
    full = lambda r: h(*(field(r[c]) for c in manifest.FIELDS))
    first = lambda x: (x is not None, x)
    groups = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for g in groups:
        own = sorted((r for r in rows if r["source"] == g), key=lambda r: (first(r["doc_id"]), full(r)))
        trees.append((own, *plain_tree([full(r) for r in own])))
    root, over = plain_tree([t[1] for t in trees])
    out = []
    for (own, sub, paths), up in zip(trees, over, strict=True):
        for r, path in zip(own, paths, strict=True):
            cut = r["text"]
            if r["doc_id"] is not None and cut is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                cut = cut.replace("\n", "")
            folded = full(r | {"text": cut})
            for before, after in path + up:
                folded = h(before, folded, after)
            out.append((r["doc_id"], full(r), sub, root, "".join(b + a for b, a in path + up), folded, folded == root))
    return out


def shown(docs):
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest.verify(manifest.build(docs, {"text": cut}))


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    cols = ["id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=key) == sorted(want, key=key)


def test_manifest_against_a_plain_tree(spark):
    rng = random.Random(1)
    rows = []
    for source, n in [("hot", 95), (None, 10), ("é", 1), ("z", 3), ("", 4), ("Z", 28)]:
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "line\n", "é\n" * 3, "plain"])
            rows.append({"doc_id": rng.choice([None, rng.randrange(60)]) if n == 28 else rng.randrange(10**6), "text": text, "lang": rng.choice([None, "en"]), "source": source, "n_chars": rng.choice([None, 3])})
    rows += [dict(rows[5]) for _ in range(30)] + [{"doc_id": 7, "text": "x\n" * 200_000, "lang": "en", "source": "hot", "n_chars": 1}]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    clash = df.selectExpr("*", "1 AS place", "'x' AS leaf", "2 AS node", "3 AS start", "'y' AS grp").repartition(5)
    got = shown(clash).collect()
    same(got, plain_manifest(rows))
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_manifest_of_few_rows(spark, n):
    rows = [{"doc_id": k, "text": "a\nb", "lang": "en", "source": "s" if n < 9 else f"s{k}", "n_chars": 3} for k in range(n)]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], DOCS)
    same(shown(df).collect(), plain_manifest(rows))


# ------------------------------------------------------------------ periodic runs
def plain_runs(words):
    """Runs (start, length, period) by trying every period at every place; the collapsed text."""
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                least.setdefault((s, i + q), q)
            i += 1
    found = sorted(((s, e - s, q) for (s, e), q in least.items()), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return found, " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    n = rng.choice([0, 1, 5, 6, 30, 150])
    words = [f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(n)]
    if n and rng.random() < 0.6:
        i = rng.randrange(n)
        p = 1 + (n - i) // (3 + rng.randrange(8))
        words = [words[k] if k < i else words[i + (k - i) % p] for k in range(n)]
    return words[:7] * 5 + words if rng.random() < 0.3 else words


@pytest.mark.parametrize("batch", [200_000, 50])
def test_runs_against_every_period(spark, monkeypatch, batch):
    monkeypatch.setattr(runs, "BATCH_WORDS", batch)
    monkeypatch.setattr(runs, "ASKED", 64)
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a a a a a a", "a a a a a", "x\u00a0y " * 8, "a b " * 4, "a b\x1fa b\x0ba b a b"] + [" ".join(random_words(rng)) for _ in range(200)]
    rows = [(k % 150 if k % 7 else None, t, 1, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, words string")
    want = [(i, *plain_runs(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows]
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df).collect()]
    key = lambda r: (r[0] is not None, r[0], r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_runs_of_long_texts(spark):
    rng = random.Random(8)
    plain = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    period = [f"p{k}" for k in range(7_001)]
    df = spark.createDataFrame([(0, " ".join(plain[:20_000] + period * 5 + plain[20_000:])), (1, "a " * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.periodic_runs(df).collect()}
    assert got[0] == [(20_000, 35_005, 7_001)]
    assert got[1] == [(0, 100_000, 1)]


def test_runs_query_against_the_statement(spark):
    got = {r["doc_id"]: r for r in runs.op13(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    hits = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, c = len(words), zlib.crc32(str(d["doc_id"]).encode())
        if c % 10 == 0 and n:
            g = c // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found, text = plain_runs(words)
        hits += bool(found)
        s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], len(found), s, length, q, 1000 * length // q if found else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(text))
    assert hits
