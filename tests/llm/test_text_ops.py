"""Packing, near duplicates, licenses, secrets, fingerprints: against brute force and on edge inputs."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from noisesift.llm import licenses, minhash, packing, secrets, signatures, spotsigs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and an extra clashing column."""
    long = " ".join(words(random.Random(1), 30_000, 5000))
    df = table(spark, [None, "", " \n\t ", "one", "one", "a  b", long, "a <|endoftext|>. b", "x y é 日本"], [0, 1, 2, 3, 4, 5, 6, 7, 8])
    return df.unionByName(df.where("doc_id = 3")).selectExpr("*", "'x' AS length", "'y' AS label")


def public_path():
    return __import__("public_tokenizers").path("byte_bpe_50k.json")


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.choice([3, 40, 300, 2500]))) + rng.choice([".", "!", " \n", ""]) for _ in range(150)]
    docs = odd.select(*odd.columns).unionByName(table(spark, texts, list(range(100, 250))).selectExpr("*", "'x' AS length", "'y' AS label"))
    got = packing.pack_documents(docs, public_path()).collect()
    tok = Tokenizer.from_file(public_path())
    want = []
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 1024)] if len(ids) > first else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    hist = defaultdict(int)
    for r in got:
        hist[r["length"]] += 1
    assert len(by_sequence) <= 1.01 * sum(n for _, n in packing.round_and_fill(hist, [])) + 1


def test_packing_empty_and_plan(spark):
    assert packing.pack_documents(table(spark, []).limit(0), public_path()).count() == 0
    rng = random.Random(3)
    for hist in ({600: 50, 500: 3, 424: 50}, {1024: 7}, {1: 5000}, {rng.randrange(1, 1025): rng.randrange(1, 90) for _ in range(300)}):
        plan = packing.plan_sequences(hist)
        packed = defaultdict(int)
        for config, n in plan:
            assert sum(length * k for length, k in config.items()) <= 1024
            for length, k in config.items():
                packed[length] += n * k
        assert dict(packed) == hist
    assert sum(n for _, n in packing.plan_sequences({600: 50, 424: 50})) == 50


def test_packing_program():
    """The fractional solution covers everything near its bound, and beats best fit where that goes wrong."""
    count = lambda plan: sum(n for _, n in plan)
    misled = {516: 6000, 264: 6000, 260: 6000, 248: 12000}
    assert count(packing.round_and_fill(misled, [])) == 11000 and count(packing.plan_sequences(misled)) == 9000
    rng = random.Random(3)
    thirds = {n: rng.randrange(1, 50) for n in range(200, 700)}
    assert count(packing.plan_sequences(thirds)) < 0.99 * count(packing.round_and_fill(thirds, []))
    mixed = {rng.randrange(1, 1025): rng.randrange(1, 90) for _ in range(300)}
    for hist, gap in ((misled, 1e-4), (thirds, 0.01), (mixed, 0.02), ({1024: 7, 1: 3}, 0.5)):
        solution, bound = packing.solve_configurations(hist)
        covered = defaultdict(float)
        for config, x in solution:
            assert sum(n * k for n, k in config.items()) <= 1024
            for n, k in config.items():
                covered[n] += k * x
        assert all(covered[n] >= d * (1 - 1e-5) for n, d in hist.items())
        assert bound - 1e-6 <= sum(x for _, x in solution) <= (1 + gap) * bound + 1
        assert bound - 1e-6 <= count(packing.plan_sequences(hist)) <= (1 + gap) * bound + 1


def test_packing_equals_an_exact_optimum():
    """Few pieces: the fewest bins over all ways to pack them."""

    def fewest(pieces, room):
        best = {0: (1, 0)}  # set of pieces -> (bins, fill of the last)
        for mask in range(1, 1 << len(pieces)):
            best[mask] = min((b + (f + p > room), p if f + p > room else f + p) for i, p in enumerate(pieces) if mask >> i & 1 for b, f in [best[mask ^ 1 << i]])
        return best[(1 << len(pieces)) - 1][0]

    rng = random.Random(9)
    for _ in range(60):
        pieces = [rng.choice([1, 2, 3, 5, 7, 8, 9, 11, 13, 20]) for _ in range(rng.randrange(1, 11))]
        plan = packing.plan_sequences(dict(Counter(pieces)), 20)
        assert sum(n for _, n in plan) == fewest(pieces, 20)


def brute_groups(texts: dict[int, str | None], n: int):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            group[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n):
    rng = random.Random(n)
    texts, k = {}, 0
    for _ in range(25):  # groups of edited copies around the threshold, chains of edits among them
        base = words(rng, rng.choice([6, 40, 150]))
        for _ in range(rng.choice([1, 2, 12])):
            edit = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12))):
                edit[rng.randrange(len(edit))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = edit
            if rng.random() < 0.2:
                edit = edit[: int(len(edit) * 0.85)]
            texts[k] = " ".join(edit)
            k += 1
    texts |= {k: None, k + 1: "", k + 2: "Solo", k + 3: "solo", k + 4: " \t", k + 5: "İ K x", k + 6: "İ k x"}
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, list(texts.values()), list(texts)), n=n).collect()}
    want = brute_groups(texts, n)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_edges(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 10
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4)} == {3}
    assert minhash.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_signature_pigeonhole():
    """Two signatures within the guaranteed distance always share a key."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS)
        b = a.copy()
        b[rng.permutation(minhash.SYMBOLS)[: minhash.CHUNKS * (minhash.ERRORS + 1) - 1]] += 1
        differ = (a != b).reshape(minhash.CHUNKS, minhash.WIDTH).sum(axis=1)
        assert differ.min() <= minhash.ERRORS


def test_licenses(spark, odd):
    texts = [
        "Licensed under the Apache License, Version 2.0. All rights reserved.", "CC BY cc-by and CC BY-NC 4.0!",
        "the GNU General Public License, version 3, and the general public license", "SPDX-License-Identifier: MIT", "submit a license", None, "",
        "all rights, reserved. Alle Rechte all rights reservedé", "ccby cc  by", "x " * 9000 + "MIT License",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [k for phrase, _ in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
    labels = {i: [(d["label"], d["start"], d["end"]) for d in r["detections"]] for i, r in got.items()}
    assert labels[0] == [("apache-2.0", 0, 8), ("reserved", 8, 11)]
    assert [x[0] for x in labels[1]] == ["cc-by", "cc-by", "cc-by-nc-4.0"]
    assert [x[0] for x in labels[2]] == ["gpl-3.0", "gpl"]
    assert [x[0] for x in labels[3]] == ["mit"]
    assert labels[4] == labels[5] == labels[6] == []
    assert labels[9] == [("mit", 9000, 9002)]
    assert licenses.scan(odd).count() == 10 and licenses.scan(odd.limit(0)).count() == 0
    assert len(licenses.rules()) > 200


def test_license_gates(spark):
    """Every alternative of a name holds the keyword of its rule, so no match is lost before it is tried."""
    import re._parser as parser

    def strings(tree):
        out = [""]
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "SUBPATTERN":
                more = strings(arg[3])
            elif op == "BRANCH":
                more = [x for part in arg[1] for x in strings(part)]
            elif op == "MAX_REPEAT":
                more = [x for n in range(arg[0], arg[1] + 1) for x in (strings(arg[2]) if n else [""])]
            elif op == "IN":
                more = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
            else:
                assert op == "ASSERT"
                more = [""]
            out = [a + b for a in out for b in more]
        return out

    for label, names, keyword, _ in licenses.FAMILIES:
        parts = licenses.gated(names, keyword)
        assert sorted(a for p in parts.values() for a in licenses.alternatives(p)) == sorted(licenses.alternatives(names))
        for gate, name in parts.items():
            assert all(gate in x.split() for x in strings(parser.parse(name))), (label, gate)
    texts = ["Licensed under MPL 2.0", "EPL-2.0", "0BSD", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "European Union Public License", "Creative Commons Zero", "PSF license", "BSL 1.0", "under the ODbL"]
    want = ["mpl-2.0", "epl-2.0", "0bsd", "cc-by-nc-sa-4.0", "eupl", "cc0", "python", "boost-1.0", "odbl"]
    got = {r["doc_id"]: [d["label"] for d in r["detections"]] for r in licenses.scan(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [[w] for w in want]


LICENSE_TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all\n# copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:"),
    ("bsd-2-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "The name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("apache-2.0", "you may not use this file except in compliance with the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("apache-2.0", "see http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    ("lgpl-2.1", "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("agpl-3.0", "the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "the terms of version 2 of the GNU General Public License"),
    ("gpl-3.0", "GPLv3"), ("gpl-3.0", "it is GPLv3+."), ("lgpl-2.1", "LGPLv2.1+"), ("lgpl-2.0", "LGPLv2"), ("agpl-3.0", "AGPL3"), ("mpl-2.0", "MPLv2.0"), ("apache-2.0", "Apache2"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("mit", "License: MIT"), ("mit", "MIT Licence"), ("mit", "licensed under the MIT"), ("mit", "MIT OR Apache-2.0"), ("bsd", "License: BSD"),
    ("cc-by-sa-4.0", "https://creativecommons.org/licenses/by-sa/4.0/"), ("cc0-1.0", "creativecommons.org/publicdomain/zero/1.0"), ("gpl-3.0", "https://www.gnu.org/licenses/gpl-3.0.html"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("boost-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ofl-1.1", "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software"),
    ("x11", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed"),
    ("gpl-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom"),
    ("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited"),
)


def test_license_signatures(spark):
    """A text of every family gets its label, alone and amid other words, and talk of licenses gets none."""
    plain = ["MIT researchers met at the MIT campus", "er kam mit dem Zug", "the apache helicopter landed", "permission was granted to the school", "a version 3 of the plan", "redistribution of income", None, ""]
    amid = [f"word {t} word" for _, t in LICENSE_TEXTS]
    got = {r["doc_id"]: {d["label"] for d in r["detections"]} for r in licenses.scan(table(spark, [t for _, t in LICENSE_TEXTS] + amid + plain)).collect()}
    for k, (label, text) in enumerate(LICENSE_TEXTS):
        assert label in got[k] and label in got[k + len(LICENSE_TEXTS)], (label, text, got[k])
    assert all(got[2 * len(LICENSE_TEXTS) + k] == set() for k in range(len(plain)))
    for r in licenses.rules():  # each rule's gate stands in it as a word, outside of what may be left out
        assert re.fullmatch("[0-9a-z]+", r["keyword"])
    for label, gate, regex, _ in signatures.signatures():
        must = re.sub(r"\(\?![^()]*\)", "", regex)
        while (less := re.sub(r"\((?:\?:)?[^()]*\)(\?|\*|\{[^}]*\})?", " ", must)) != must:
            must = less
        assert gate in re.sub(r"[a-z]\?", " ", must).split() or gate in must.split(), (label, gate, regex)


@functools.cache
def field():
    """The field fitted on the made-up lines alone."""
    return secrets.fit(*secrets.training_set([]))


def test_secrets(spark, odd):
    key = "AKIA" + "Q7" * 8
    texts = [
        f'é😀 password = "{"ab1" * 5}" and {key}', "token: short1", f"{'0123456789abcdef' * 3} API_KEY='zzzzzzzz'", None, "", "no secrets 12 34.5 here",
        "auth ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8 ok", "call (499) 555-6503 or 152.143.123.131 on 2024-05-06",
    ]
    model = field()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["_spans"]] for r in secrets.scan_secrets(table(spark, texts), model, carry=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        want = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(t or "") if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in secrets.ACCESS.finditer(t or "") if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        assert [s for s in got[i] if s[0] != "crf"] == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    assert [texts[6][a:b] for k, a, b in got[6] if k == "crf"] == ["ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"]
    assert got[5] == got[7] == []
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(table(spark, texts)).collect()}
    assert masked[0] == "é😀 [SECRET]\" and [SECRET]" and masked[5] == texts[5] and masked[3] is None
    assert secrets.mask_secrets(odd).columns == odd.columns and secrets.mask_secrets(odd.limit(0)).count() == 0


def test_secrets_without_digits():
    """Words without a digit are tagged as all others, also as a part of a secret of several words."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    model = secrets.ready(field())
    found = lambda t: [t[b:e] for _, b, e in secrets.all_spans(t, t.encode(), model)]
    assert found("then pwd = correcthorsebatterystaple and go") == ["correcthorsebatterystaple"]
    keys = ["".join(rng.choices(letters, k=24)) for _ in range(40)]
    for lead in ("Authorization: Bearer ", "the auth "):
        assert sum(found(f"see {lead}{k} again") == [k] for k in keys) >= 38
    wrapped = [f"{k[:14]}7 {k[14:]}" for k in keys]
    assert sum(found(f"my key {w} for that") == [w] for w in wrapped) >= 36
    for plain in ("the key points are clear", "Author: Washington and the keyboard", "JavaScript, see https://www.example.com/path/to/page.html", "Donaudampfschifffahrt " * 9):
        assert found(plain) == []


def test_secret_precision_and_recall():
    """Made-up lines of kinds that only look random (at most 5 % found) and of secrets (at least 90 %, all but spoken phrases exactly)."""
    rng, lower = random.Random(4), "abcdefghijklmnopqrstuvwxyz"
    some = lower + lower.upper() + "0123456789"
    take = lambda a, n: "".join(rng.choices(a, k=n))
    hexes = lambda n: take("0123456789abcdef", n)
    weights = field()
    model = secrets.ready(weights)
    sums = [w[secrets.features(t, secrets.Facts(), c)].sum(axis=1) for w, c in ((weights[0], secrets.ALL), (model[0], secrets.FOLDED)) for t in ("my key: a1b2c3d4e5f6 and a plain https://x.com/a word",)]
    assert np.allclose(*sums)
    found = lambda t: [t[b:e] for _, b, e in secrets.all_spans(t, t.encode(), model)]
    plain = {
        "uuid": lambda: f"{rng.choice(['order', 'the id', 'request'])} {'-'.join(map(hexes, (8, 4, 4, 4, 12)))} done",
        "commit": lambda: f"{rng.choice(['commit', 'see', 'in'])} {hexes(20)} fixed it",
        "account": lambda: f"{rng.choice(['pay to', 'IBAN', 'account'])} {rng.choice(['DE', 'FR', 'GB'])}{take('0123456789', 20)} today",
        "video": lambda: f"watch https://{rng.choice(['youtu.be/', 'www.youtube.com/watch?v=', 'video.org/x/'])}{take(some + '-_', 11)} now",
        "content hash": lambda: f"integrity sha256-{take(some + '+/', 43)}= ok",
        "isbn": lambda: f"ISBN 978-{rng.randrange(10)}-{rng.randrange(1000, 10000)}-{rng.randrange(1000, 10000)}-1 book",
    }
    for kind, line in plain.items():
        assert sum(bool(found(line())) for _ in range(100)) <= 5, kind
    secret = {
        "signed": lambda x: f"passphrase: {x} for now", "address": lambda x: f"connect to postgres://admin:{x}@db.host:5432/x please",
        "address without a port": lambda x: f"DATABASE_URL=postgres://bob:{x}@host/db", "hint": lambda x: f"the auth {x} here",
    }
    for kind, line in secret.items():
        keys = [take(lower if kind == "signed" else some, 14 if kind != "hint" else 24) for _ in range(100)]
        assert sum(found(line(k)) == [k] for k in keys) >= 90, kind
    assert sum(bool(found(f"so the passphrase is {take(lower, 14)} for now")) for _ in range(100)) >= 60


def test_secret_runs_are_those_of_the_whole_text():
    rng = np.random.default_rng(9)
    for _ in range(200):
        emit, trans = rng.standard_normal((60, 3)) * 2, rng.standard_normal((3, 3)) + secrets.FORBIDDEN
        emit[:, secrets.O] += 4
        want, at = secrets.viterbi(emit, trans), np.flatnonzero(secrets.open_words(emit, trans))
        got = np.full(60, secrets.O)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
            got[run] = secrets.viterbi(emit[run], trans)
        assert got.tolist() == want


def test_secret_field_is_exact():
    """Viterbi and the partition function against all taggings of short runs."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(1, 5))
        emit, trans = rng.standard_normal((n, 3)), rng.standard_normal((3, 3)) + secrets.FORBIDDEN

        def score(tags, emit=emit, trans=trans):
            path = [secrets.O, *tags, secrets.O]
            return sum(emit[k, t] for k, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(path[:-1], path[1:], strict=True))

        every = list(itertools.product(range(3), repeat=n))
        assert tuple(secrets.viterbi(emit, trans)) == max(every, key=score)
        z, unary, pair = secrets._forward_backward(emit[None], np.ones((1, n), dtype=bool), trans)
        assert np.isclose(z[0], np.log(sum(np.exp(score(t)) for t in every)))
        assert np.allclose(unary.sum(axis=2), 1) and np.isclose(pair.sum(), n + 1)


def chains_of(marked):
    """Chains at anchors, at words with CHAIN content words in a row before them, and of the last words."""
    found = set()
    for k, x in enumerate(marked):
        after = [y for y in marked[k:] if y != "~"][: spotsigs.CHAIN]
        row = marked[max(0, k - spotsigs.CHAIN) : k]
        if len(after) == spotsigs.CHAIN and (x == "~" or len(row) == spotsigs.CHAIN and "~" not in row):
            found.add(tuple(after))
    content = [x for x in marked if x != "~"]
    return found | ({tuple(content[-spotsigs.CHAIN :])} if content else set())


def test_spotsigs(spark, odd):
    rng = random.Random(6)
    anchors = ["the", "of", "und", "le"]
    texts = [" ".join(rng.choice(anchors) if rng.random() < 0.3 else w for w in words(rng, 120)) for _ in range(30)]
    texts += [texts[0], texts[1] + " the tail goes here", texts[2].upper(), None, "", "...", "the", "two words"]
    df = table(spark, texts)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", spotsigs.signatures(df["text"]).alias("s")).collect()}
    chains = {}
    for i, t in enumerate(texts):
        w = ["~", *re.findall(r"[^\W_]+", (t or "").lower())]
        marked = ["~" if x in spotsigs.ANCHORS else x for x in w]
        chains[i] = chains_of(marked)
        assert len(got[i]) == len(chains[i])
    assert got[0] == got[30] and got[2] == got[32]
    members, pairs = spotsigs.near_pairs(df, 0.8)
    linked = {(r["a"], r["b"]) for r in pairs.collect()}
    classes = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert classes[30] == 0
    reps = sorted({c for i, c in classes.items() if chains[i]})
    want = {(a, b) for a, b in itertools.combinations(reps, 2) if len(chains[a] & chains[b]) >= 0.8 * len(chains[a] | chains[b])}
    assert linked == want and (1, 31) in linked
    assert spotsigs.near_pairs(odd)[0].count() == 10 and spotsigs.near_pairs(odd.limit(0))[1].count() == 0


def test_spotsigs_where_anchors_are_far_apart(spark):
    """Every content word counts, with one anchor, none or many."""
    content = [f"w{k}" for k in range(400)]
    free, half = " ".join(content), " ".join(content[:200] + [f"z{k}" for k in range(200)])
    shifted = " ".join(["new", *content])
    texts = [free, half, shifted, "the " + free, free + " the", "the w0 of w1 w2", "w0 w1 w2", "w0 w1"]
    texts += ["the w0 of " + free, "w0 the w1 w2 of w3 " + free]  # two and more chains from anchors, then a gap
    texts += ["the w0 of " + half, "w0 the w1 w2 of w3 " + half]
    got = {r["doc_id"]: set(r["s"]) for r in table(spark, texts).select("doc_id", spotsigs.signatures(spotsigs.F.col("text")).alias("s")).collect()}
    like = lambda a, b: len(got[a] & got[b]) / len(got[a] | got[b])
    assert len(got[0]) == 396 and got[0] != got[1] and 0.3 < like(0, 1) < 0.4
    assert like(0, 2) > 0.98 and got[0] == got[3] == got[4]
    assert got[5] == got[6] and len(got[6]) == len(got[7]) == 1 and got[6] != got[7]
    assert 0.3 < like(8, 10) < 0.4 and 0.3 < like(9, 11) < 0.4 and like(0, 8) > 0.98
    rng = random.Random(7)
    for marked in ([rng.choice(["~", "~", "a", "b", "c", "d", "e", "f", "g"]) for _ in range(rng.randrange(3, 60))] for _ in range(200)):
        held = set().union(*map(set, chains_of(["~", *marked])))
        assert held == {x for x in marked if x != "~"}


def test_next_document(spark, odd):
    texts = ["aé😀b", None, "", "xyz", "longer text here", "q"]
    docs = table(spark, texts, [5, 40, 7, 12, 90, 3]).selectExpr("doc_id", "coalesce(text, '') AS text")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(docs, "doc_id", ["text"]).collect()}
    order = sorted(got, reverse=True)
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {i: by_id[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    prints = {"f": (spotsigs.signatures, "text")}
    rows = {r["doc_id"]: r for r in spotsigs.with_next(docs, "doc_id", ["text"], prints).collect()}
    own = {r["doc_id"]: r["s"] for r in docs.select("doc_id", spotsigs.signatures(spotsigs.F.col("text")).alias("s")).collect()}
    assert {i: (r["text"], r["f"], r["next_text"], r["next_f"]) for i, r in rows.items()} == {
        i: (by_id[i], own[i], got[i], own[order[(k + 1) % len(order)]]) for k, i in enumerate(order)}
    assert spotsigs.with_next(odd.limit(0), "doc_id", ["text"], prints).count() == 0
    assert spotsigs.with_next(odd, "doc_id", ["text"]).count() == 10
    assert spotsigs.with_next(odd.limit(0), "doc_id", ["text"]).count() == 0


def test_fingerprint_query(spark):
    from noisesift.llm.common import QUERIES, table as read

    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op8_spotsigs_fingerprints"](spark, d).collect()}
    docs = sorted(((r["doc_id"], r["text"] or "") for r in read(spark, d, "documents").collect()), reverse=True)
    for k, (i, t) in enumerate(docs):
        nxt, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
    # likeness against chains of the texts, and no text of 20 content words keeps its fingerprint with half of it replaced
    def chains(t):
        w = ["~", *re.findall(r"[^\W_]+", t.lower())]
        return chains_of(["~" if x in spotsigs.ANCHORS else x for x in w])

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(docs):
        nxt, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        own, edited, other = chains(t), chains(t[: len(t) - half] + nxt[:half]), chains(nxt)
        assert abs(got[i]["near_edited"] - like(own, edited)) < 1e-9 and abs(got[i]["near_next"] - like(own, other)) < 1e-9
        assert len(set().union(*own, set())) < 20 or own == edited or got[i]["fingerprint"] != got[i]["edited_fingerprint"]
        assert len(set().union(*own, set())) < 20 or t[len(t) - half :] == nxt[:half] or got[i]["fingerprint"] != got[i]["edited_fingerprint"]
