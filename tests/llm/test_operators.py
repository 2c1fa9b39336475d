"""The corpus operators against brute force on small tables that hold the awkward cases."""

import hashlib
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import decontaminate, exact_dedup, html_extract, license_scan, ngram_join, pii, sp_codec, suffix_dedup, toxicity, url_filter
from attesta.llm import queries as Q
from tests.conftest import SF, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, `key` string"


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, f"s{i % 2}", None, 0.5, "x", "y") for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, nulls, empty and very long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(30)]
    passage = prose(rng, 60)
    near = []
    for t in base[:12]:
        for _ in range(3):
            w = t.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            near.append(" ".join(w))
    return [*base, *near, *[prose(rng, 30) + " " + passage + " " + prose(rng, 40) for _ in range(8)], base[3], base[3], base[3].replace(" ", "\n"), base[3].upper(), None, None, "", "   ", "one two", "one two", "ein Wort", "wörter äöü 漢字 " * 30, "For " * 4000, prose(rng, 9000)]


# --- every operator over an empty table -------------------------------------------------------------------


def test_empty_tables(spark):
    docs, pages = table(spark, []), spark.createDataFrame([], "page_id long, url string, html string")
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        license_scan.scan(license_scan.paths_of(docs), license_scan.templates(spark)), pii.report(docs), pii.detect(docs), toxicity.score(docs, toxicity.train(docs, labels)), ngram_join.components(docs), suffix_dedup.report(docs),
        exact_dedup.deduplicate(docs), url_filter.judge(pages, url_filter.listed(spark)), html_extract.extract_pages(pages), decontaminate.find(docs, bench), decontaminate.clean(docs, bench), sp_codec.encode(docs),
    ):
        assert out.count() == 0


# --- 1 ------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/d.py", "code"),
        (3, "a/b/x.py", "# Licensed under the Apache License, Version 2.0.\ncode " + "word " * 5000),
        (4, "a/z.py", None),
        (5, "z.py", ""),
        (6, None, "Released under the MIT License."),
        (7, "a/b/c/e.py", "A licence to kill is no licence notice about this code at all, my friend of old"),
        (2, "a/b/c/d.py", "code"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, path string, text string, template string, w int")
    out = sorted((r.doc_id, r.own_license or "", r.license or "", r.inherited_from or "") for r in license_scan.scan(df, license_scan.templates(spark)).collect())
    assert out == [(1, "MIT", "MIT", ""), (2, "", "MIT", "a/b/LICENSE"), (2, "", "MIT", "a/b/LICENSE"), (3, "Apache-2.0", "Apache-2.0", ""), (4, "", "", ""), (5, "", "", ""), (6, "", "", ""), (7, "", "MIT", "a/b/LICENSE")]


def test_license_scan_reads_real_headers_and_texts(spark):
    mit = """MIT License

Copyright (c) 2021 Jane Q. Public and the Acme contributors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
    apache = """# Copyright 2019 The Acme Authors. All rights reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os"""
    gnu = lambda which: f"""/* Copyright (C) 2020 Jane Public
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {which}General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */ int main() {{ return 0; }}"""  # noqa: E731
    bsd = next(x for n, x in license_scan.PASSAGES if n == "BSD-3-Clause")
    want = {
        "MIT": [mit, "code\n// SPDX-License-Identifier: MIT\n", mit.replace("\n", "\r\n * ")], "Apache-2.0": [apache, "Copyright 2021 Acme\nLicensed under the Apache License, Version 2.0.", "/* SPDX-License-Identifier: Apache-2.0 */"],
        "GPL-3.0": [gnu(""), "# SPDX-License-Identifier: GPL-3.0-or-later"], "LGPL-3.0": [gnu("Lesser "), gnu("Lesser ").replace("program", "library")], "GPL-2.0": [gnu("").replace("version 3", "version 2")], "LGPL-2.1": [gnu("Lesser ").replace("program", "library").replace("version 3", "version 2.1")], "AGPL-3.0": [gnu("Affero ")], "BSD-3-Clause": ["Copyright (c) 2001 X. All rights reserved.\n" + bsd], "BSD-2-Clause": [bsd[: bsd.index("3. ")] + bsd[bsd.index("THIS S") :]],
        "MIT OR Apache-2.0": ["# SPDX-License-Identifier: MIT OR Apache-2.0"], "Proprietary": ["Copyright 2021 Acme Widgets Incorporated. All rights reserved."],
        "": ["A licence to kill is no licence notice about this code", "The driver showed a license and the copyright of the song is held by the band. " * 50, "license " * 5000],
    }
    rows = [(k, f"{k}/x", t) for k, t in enumerate(t for ts in want.values() for t in ts)]
    names = [n for n, ts in want.items() for _ in ts]
    files = spark.createDataFrame(rows + [(100, "0/sub/code.c", "int x;")], "doc_id long, path string, text string")
    out = {r.doc_id: r for r in license_scan.scan(files, license_scan.templates(spark)).collect()}
    assert [out[k].own_license or "" for k in range(len(names))] == names
    assert out[100].license == "MIT" and out[100].inherited_from == "0/x"


# --- 2 ------------------------------------------------------------------------------------------------------


def pii_by_regex(text):
    out = []
    for kind, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(d := re.sub("[ -]", "", x)) <= 19 and pii.luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= sum(c in "0123456789" for c in x) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])]
    return out


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a@b.c", "x@y", "a@b@c.de", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+12", "..", " ", "é", "@", "-", "%", "9", "+", "token = 1a2b3c4d5e6f7a8b9c0d1e2f", "DE89370400440532013000", "0001.02.3.4"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert [s[:3] for s in pii.find(t) if s[0] in pii.KINDS[:4]] == pii_by_regex(t), t


def test_pii_rows(spark):
    texts = ["mail a@b.co or iban DE89 3704 0044 0532 0130 00", None, "", "a." * 60_000 + "@", "1" * 100_000, "a@b.co", "a@b.co"]
    rows = {r.doc_id: r for r in pii.report(table(spark, texts)).collect()}
    assert rows[0].spans.startswith("email:5:11,iban:20:") and rows[0].n_email == 1
    assert rows[0].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    assert rows[1].base_sha256 == rows[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.redact(table(spark, texts)).where("doc_id = 5").first().text == "[EMAIL]"


def test_iban_ends_before_what_follows(spark):
    spaced, compact, polish = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "PL61109010140000071219812874"
    for iban in (spaced, compact, spaced.replace(" ", ""), "NO93 8601 1117 947", polish):
        for before in ("", "IBAN ", "ref AB12 ", "(", "BIC NWBKGB2L "):
            for after in ("", " Please pay", " The", " BIC NWBKGB2L", " 2 weeks", " 2026 11 26", ". X", ", " + compact, " " + compact, ")", " é", "\n12 EUR", " A" * 40):
                t = before + iban + after
                spans = [s[1:3] for s in pii.find(t) if s[0] == "iban"]
                assert spans[:1] == [(len(before), len(before) + len(iban))], t
                assert len(spans) == 1 + after.count(compact), t
    for t in (compact + "X", "x" + compact, "DE88370400440532013000 The", compact + "ab", "AB12 " * 30_000):
        assert not [s for s in pii.find(t) if s[0] == "iban"], t[:40]
    assert pii.redact(table(spark, [f"IBAN {spaced} Please pay"])).first().text == "IBAN [IBAN] Please pay"


# --- 3 ------------------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    u, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    starts = np.array([0, 4])
    want = []
    for lo, hi in ((0, 4), (4, 9)):
        weight = np.zeros(hi - lo)
        total = 0.0
        for code in range(2 ** (hi - lo)):
            y = [(code >> i) & 1 for i in range(hi - lo)]
            w = np.exp(sum(u[lo + i] * y[i] for i in range(hi - lo)) + sum(trans[y[i], y[i + 1]] for i in range(hi - lo - 1)))
            total += w
            weight += w * np.array(y)
        want += list(weight / total)
    for length in (3, 4, 128):
        assert np.allclose(toxicity.marginals(u, starts, trans, length), want)


def test_sparse_marginals_equal_full_ones():
    rng = np.random.default_rng(1)
    m = toxicity.Model({"x": 3.0}, -1.9, ((1.5, -1.1), (-1.1, -2.2)))
    u = np.where(rng.random(4000) < 0.01, 3.0, m.bias)
    starts = np.array([0, 1, 700, 705, 3999])
    assert np.allclose(toxicity.sparse_marginals(u, starts, m), toxicity.marginals(u, starts, np.array(m.trans)), atol=1e-8)


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(4)
    bad = ["dolt", "doltish", "cretin", "oaf"]
    texts, labels = [], []
    for i in range(400):
        w = prose(rng, rng.randrange(20, 80)).split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    docs = table(spark, [*texts, None, "", "oaf " * 9000])
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()}
    held = [i for i, _ in labels if out[i].held]
    assert len(held) > 80 and all((out[i].score >= toxicity.THRESHOLD) == bool(labels[i][1]) for i in held)
    assert 0 <= out[400].score == out[401].score < 0.7 <= out[402].score
    spans = out[0].toxic_spans
    assert {texts[0][s.start : s.end] for s in spans} <= set(bad) and spans
    assert toxicity.reject(docs, model).count() == 400 - 100 + 2


# --- 4 ------------------------------------------------------------------------------------------------------


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_pairs(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("tile", [2048, 3])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "CANOPY_TILE", min(tile, 512))
    rng = random.Random(9)
    chain = [prose(rng, 120)]
    for _ in range(12):  # a chain of near copies whose ends are far apart
        w = chain[-1].split()
        for _ in range(2):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(999))
        chain.append(" ".join(w))
    short = ["a b c d e f g h", "a b c d e f g i", "x a b c d e f g h", "a b c d e", "a b c d e", "A B C D E", *[f"a b c d e f g {i} {i}" for i in range(8)]]
    texts = [*corpus(), *chain, *short]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, texts).repartition(5)).collect()}
    assert got == components_by_pairs(texts)


def test_blocking_keys_meet_at_the_threshold():
    """Sets at exactly the threshold share a key, whatever the sizes and wherever they differ."""
    rng = np.random.default_rng(0)
    for n in (4, 5, 9, 31, 33, 63, 64, 79, 80, 100, 127, 128, 200, 500, 1023, 1300):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rng.integers(0, n // 5 + 1))
            add = max(0, int((len(a) - drop) / 0.8) - len(a))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            inter = len(a) - drop
            assert 100 * inter >= 80 * (len(a) + len(b) - inter)
            (keys, few), (others, _) = ngram_join.blocking_keys(np.sort(a)), ngram_join.blocking_keys(b)
            assert few or set(keys) & set(others), n


def test_sets_that_fill_few_groups_meet_all_of_their_size(spark):
    alike = np.arange(4000, dtype=np.uint64)
    k = 6
    tag = np.uint64((k * 0x2545F4914F6CDD1D + 0x1234567) & (2**64 - 1))
    bad = alike[(ngram_join.mix(alike ^ tag) % np.uint64(1 << k)) < 8][:100]  # all in 8 of 64 groups
    assert len(bad) == 100 and ngram_join.blocking_keys(bad)[1] and not ngram_join.blocking_keys(alike[:100])[1]
    base = spark.createDataFrame([(1, 100, [1], True), (2, 120, [2], False), (3, 81, [3], False), (4, 79, [4], False), (5, 126, [5], False), (6, 100, None, None)], "doc_id long, n long, keys array<long>, few boolean")
    assert sorted(map(tuple, ngram_join._unblocked(base).collect())) == [(2, 1), (3, 1)]
    assert ngram_join._unblocked(base.where("not few")) is None


def test_rtree_prunes_nothing_that_links():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 4000, rng.integers(5, 120)).astype(np.uint64)) for _ in range(200)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 4000, 2).astype(np.uint64)])) for s in sets[:60]]
    points, sizes = np.stack([ngram_join.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree = ngram_join.RTree(points, sizes)
    for i, a in enumerate(sets):
        found = set(tree.search(points[i], len(a)).tolist())
        linked = {j for j, b in enumerate(sets) if 100 * (n := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - n)}
        assert linked <= found


# --- 5 ------------------------------------------------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(80):
        n, a = rng.randrange(1, 200), rng.choice([1, 2, 3, 10, 256])
        t = np.array([*[rng.randrange(1, a + 1) for _ in range(n)], 0], np.uint16)
        assert suffix_dedup.suffix_array(t, 10**6).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def removed_by_counting(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raws for i in range(len(b) - 199))
    out = {}
    for k, b in enumerate(raws):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_permuted_prefixes():
    rng = random.Random(2)
    for _ in range(40):
        t = np.array([*[rng.randrange(1, 3) for _ in range(rng.randrange(2, 120))], 0], np.uint16)
        sa = suffix_dedup.suffix_array(t, 10**6)
        at = np.arange(len(t) - 1)
        rank = np.argsort(sa)
        same = lambda a, b: next((k for k in range(len(t)) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 0)
        assert suffix_dedup.permuted_prefixes(t, sa, at, 9).tolist() == [min(9, same(i, sa[rank[i] - 1])) for i in at]


def test_segments_name_equal_strings_alike():
    rng = random.Random(3)
    word = bytes(rng.randrange(97, 100) for _ in range(300))
    raw = word + b"ab" * 200 + word[50:280] + b"x" * 300 + bytes(rng.randrange(97, 123) for _ in range(500)) + word
    name, content, start, n, tied = suffix_dedup.segments(np.frombuffer(raw, np.uint8))
    assert start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and start[-1] + n[-1] == len(raw) - 199
    owner = np.repeat(np.arange(len(name)), n)
    seen = {}
    for i in range(len(raw) - 199):
        j = seen.setdefault(raw[i : i + 200], i)
        assert name[owner[i]] == name[owner[j]] and (owner[i] != owner[j] or i == j or tied[owner[i]])
    bodies = {(int(c), raw[s : s + k + 199]) for c, s, k in zip(content, start, n, strict=True)}
    assert len({c for c, _ in bodies}) == len({r for _, r in bodies})


@pytest.mark.parametrize(("shard", "tile"), [(2_000_000, 8_000_000), (2_000, 8_000_000), (2_000, 500)])
def test_suffix_dedup_equals_counting(spark, monkeypatch, shard, tile):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "TILE_BYTES", tile)
    texts = corpus(7)
    hot = " ".join(f"passage{i % 7}{i}" for i in range(40))
    texts += [f"{k} begins so {hot} and ends {k * k} thus" for k in range(30)] + ["ab" * 400 + texts[0]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(table(spark, texts).repartition(4)).collect()}
    assert got == removed_by_counting(texts)


# --- 6 ------------------------------------------------------------------------------------------------------


def groups_by_text(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    out = {}
    for i, n in enumerate(norm):
        own = [j for j, m in enumerate(norm) if m == n]
        keep = min(own, key=lambda j: (-len(texts[j] or ""), j))
        out[i] = (keep, len(own), i == keep)
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.length(n).cast("string")])
def test_exact_dedup_equals_grouping(spark, digest):
    """The second digest collides all the time: full bytes then decide."""
    texts = corpus(5)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(table(spark, texts), digest).collect()}
    assert got == groups_by_text(texts)


def test_exact_dedup_state_outlives_the_stream(spark, tmp_path):
    """What a first run has seen is looked up by a second one, which reads only what is new."""
    def put(rows):
        spark.createDataFrame(rows, "doc_id long, size int, digest string, locator string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/keys")
        return {r.digest: (r.group_size, r.keep_id, r.keep_size, r.locator) for r in exact_dedup.stream_state(spark, f"{tmp_path}/keys", f"{tmp_path}/state").collect()}

    assert put([(5, 3, "a", "f#0"), (6, 3, "a", "f#1"), (7, 1, "b", "f#2")]) == {"a": (2, 5, 3, "f#0"), "b": (1, 7, 1, "f#2")}
    assert put([(4, 3, "a", "g#0"), (8, 1, "c", "g#1")]) == {"a": (3, 4, 3, "g#0"), "b": (1, 7, 1, "f#2"), "c": (1, 8, 1, "g#1")}
    assert put([(9, 9, "b", "h#0"), (1, 2, "a", "h#1")]) == {"a": (4, 4, 3, "g#0"), "b": (2, 9, 9, "h#0"), "c": (1, 8, 1, "g#1")}
    assert len(list((tmp_path / "state" / "layers").glob("batch=*"))) == 3


def test_without_equals_anti_join(spark):
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, f"t{i % 3}", "k", i) for i in range(60)], "doc_id long, text string, `key` string, block int")
    gone = spark.createDataFrame([(2, "t1"), (None, "t0"), (3, "t9")], "doc_id long, own string")
    got = url_filter.without(docs, gone, {"doc_id": docs["doc_id"], "own": docs["text"]})
    assert got.columns == docs.columns
    assert sorted(r.block for r in got.collect()) == [r.block for r in docs.orderBy("block").collect() if (r.doc_id, r.text) not in {(2, "t1"), (None, "t0"), (3, "t9")}]


def test_exact_dedup_keeps_rows_without_identifier(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (4, "b ")], "doc_id long, text string")
    assert sorted(map(str, exact_dedup.unique(df).collect())) == sorted(map(str, df.where("doc_id is not null").collect()))


# --- 7 ------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = ["https://m.spam-farm.example.com/en/1", "http://x.example.org/es/5", "http://EXAMPLE.org/en/12?x", "https://a.com/de/9", "https://free-bets.example.com/fr/1", "noscheme.com/de/", None, "http://adult-x.example.net", "http://adult-x.example.net", "http://ok.net/a/../b#f", "ftp://h.org"]
    df = spark.createDataFrame([(i, u, "k", "v") for i, u in enumerate(urls)], "page_id long, url string, `key` string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.listed(spark)).collect()}
    assert got == {
        0: ("m.spam-farm.example.com", "/en/1", None, "block"), 1: ("x.example.org", "/es/5", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("a.com", "/de/9", "com/de/", "block"),
        4: ("free-bets.example.com", "/fr/1", "com/fr/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("adult-x.example.net", "", None, "block"), 8: ("adult-x.example.net", "", None, "block"),
        9: ("ok.net", "/a/../b", None, "allow"), 10: ("h.org", "", None, "allow"),
    }


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks, n = url_filter.bloom(keys)
    hit = keys.withColumns({"block": url_filter.block_of(F.col("key"), n), "own": url_filter.mask_of(F.col("key"))}).join(blocks, "block").where(F.col("bits").bitwiseAND(F.col("own")) == F.col("own"))
    assert hit.count() == 5000
    other = spark.range(5000).select(F.concat(F.lit("o"), "id").alias("key"))
    false = other.withColumns({"block": url_filter.block_of(F.col("key"), n), "own": url_filter.mask_of(F.col("key"))}).join(blocks, "block").where(F.col("bits").bitwiseAND(F.col("own")) == F.col("own"))
    assert false.count() < 500


# --- 8 ------------------------------------------------------------------------------------------------------


def test_html_extract(spark):
    good = "The quick brown fox was in the house and it is not what they were all about, said the man who had been there for years and years."
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><header><p>Site {good}</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice"><p>{good}</p></div><article><h1>A &amp; B</h1><p>{good}<br>x&nbsp;y</p><div class="ad">Buy</div><p>Short.</p><p><b>{good}</b></p></article><section id="comments"><p>{good}</p></section><aside>{good}</aside><form><p>{good}</p></form><footer>&copy; me</footer></body></html>"""
    assert html_extract.extract(page) == f"A & B\n{good} x y\nShort.\n{good}"
    plain = f"<div><p>{good * 2}</p><p>Short one.</p><p>{good * 2}</p><p><a href=x>link link link link</a></p></div>"
    assert html_extract.extract(plain) == f"{good * 2}\nShort one.\n{good * 2}"
    df = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 0), (3, "u", "<p>" + "a b " * 100_000, 0), (3, "u", page, 0), (None, "u", "< not & a tag", 0)], "page_id long, url string, html string, n_chars int")
    assert [r.n_chars == len(r.text) for r in html_extract.extract_pages(df).collect()] == [True] * 5


def test_html_extract_raw_elements():
    good = "The quick brown fox was in the house and it is not what they were all about, said the man who had been there for years and years."
    raw = ["<script>for(i=0;i<n;i++){f(i)}</script>", "<script><!-- if (a<b) </SCRIPT >", "<style><!-- p<a {} </style>", "<script>s='</scripted><article>no';</script>", "<noscript><p>i<n</noscript>", "<textarea><!-- a<b</textarea>", "<template><script>i<n</script>no<template>no</template>no</template>"]
    for r in raw:
        for page in (f"<body>{r}<article><p>{good}</p></article>", f"<head><title>a<b</title>{r}</head><article><p>{good}</p></article>", f"<article><p>{good}</p>{r}</article><nav>{r}</nav>"):
            assert html_extract.extract(page) == good, page
    assert html_extract.extract(f"<article><p>{good}</p><script>i<n<p>{good}</p></article>") == good


def test_html_extract_keeps_what_only_sounds_like_layout():
    good = "The quick brown fox was in the house and it is not what they were all about, said the man who had been there for years and years."
    keep = [
        f'<h2 id="side-effects">Side effects</h2><section id="related-work"><p>{good}</p></section>', f'<div id="search-algorithms"><p>{good}</p></div>', f'<div class="entry-header"><h1>Title</h1></div><p>{good}</p>',
        f'<section id="comments"><h2 id="search" class="header">Search</h2><p class="notice">{good}</p></section>', f'<div class="section" id="navigation"><p>{good}</p></div>',
    ]
    text = lambda h: "\n".join(html_extract._SPACE.sub(" ", x).strip() for x in html_extract.re.split(r"<[^>]*>", h) if x.strip())
    for h in keep:
        assert html_extract.extract(f"<article><p>{good}</p>{h}<p>{good}</p></article>") == f"{good}\n{text(h)}\n{good}", h
    for h in keep[:3]:
        assert html_extract.extract(f"<body><p>{good * 2}</p>{h.replace(good, good * 2)}<p>{good * 2}</p></body>") == f"{good * 2}\n{text(h.replace(good, good * 2))}\n{good * 2}", h
    figure = f"<article><p>{good}</p><figure><img src=x><figcaption>{good}</figcaption></figure><p>{good} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <object>o<param name=a></object> <canvas>c</canvas></p></article>"
    assert html_extract.extract(figure) == f"{good}\n{good}\n{good} x=1 o c"
    for h in (f"<p class=ad>Buy<p>{good}", f"<ul><li class=ad>Buy<ul><li>now<li>or never</ul><li>{good}</ul>", f"<ul><li class=ad>Buy</ul><p>{good}", f"<dl><dt class=ad>Buy<dd>{good}</dl>", f"<table><tr><td class=ad>Buy<td>{good}<tr></table>", f"<div><p class=ad>Buy</div>{good}", f"<datalist><option>Buy<option>it</datalist>{good}"):
        for end in ("", "</article>"):
            assert html_extract.extract(f"<article><p>{good}</p>{h}<p>{good}</p>{end}") == f"{good}\n{good}\n{good}", h
    for h in ('<div class="ad">Buy</div>', '<div class="box share-buttons">Buy</div>', '<div id="comments">Buy</div>', "<aside>Buy</aside>", '<div class="promo">Buy'):
        assert html_extract.extract(f"<article><p>{good}</p>{h}</article>") == good, h


def test_html_extract_of_missing_ends_and_wrapping_forms():
    good = "The quick brown fox was in the house and it is not what they were all about, said the man who had been there for years and years."
    for page in (
        f"<body><nav><a href=/>Home</a><article><p>{good}</p></article>", f"<body><div><nav><a href=/>Home</a></div><div><p>{good * 2}</p></div>", f"<div><aside>Ad</div><article><p>{good}</p></article>",
        f"<head><title>t</title><body><article><p>{good}</p></article>", f"<form id=aspnetForm><input><article><p>{good}</p></article></form>", f"<body><form><p>{good * 2}</p></form></body>",
    ):
        assert html_extract.extract(page) in {good, good * 2}, page
    links = f"<article><p>{good}</p><p><a href=1>One link</a> and <a href=2>another link</a></p><p>{good}</p></article>"
    assert html_extract.extract(links) == f"{good}\nOne link and another link\n{good}"
    assert html_extract.extract(f"<article><p>{good}</p><p title='a>b' lang=\"x\">1 < 2 <b>and</b> 3 > 2</p><p>it's <a title=\"o>open</p></article>") == f"{good}\n1 < 2 and 3 > 2\nit's open"


def test_scans_take_linear_time():
    began = time.process_time()
    for page in ("<a " * 100_000, '<a "' * 50_001, "<a '\"" * 50_001, "<!" * 100_000, "<p>" + "<" * 100_000, "<nav>" * 50_000, "<!-- " * 50_000 + ">", "<a \"'>" * 30_001):
        html_extract.extract(page)
    for text in ("0" * 5000 + "1.2.3.4", "1" * 200_000, "a@" * 50_000, "+" + "1 " * 100_000, "4" * 100_000 + "." * 100_000, "GB82" * 20_000):
        pii.find(text)
    assert pii.listing(pii.find("0" * 5000 + "1.2.3.4")) == "ip:0:5007"
    assert time.process_time() - began < 20


class Walk(HTMLParser):
    """The article's blocks by walking the tree: a plain reading of pages whose regions are marked by their elements."""

    def __init__(self):
        super().__init__()
        self.path, self.out, self.cur = [], [], ""

    def flush(self):
        if t := " ".join(self.cur.split()):
            self.out.append(t)
        self.cur = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.cur += " "
        if tag in html_extract._VOID:
            return
        if tag not in html_extract._INLINE:
            self.flush()
            if tag == "p" and "p" in self.path:
                self.handle_endtag("p")
        own = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        self.path.append(tag if not re.search(r"^(ad|ads|promo|cookie-notice|share|comments|newsletter|related)$", own) else "aside")

    def handle_endtag(self, tag):
        if tag not in html_extract._INLINE:
            self.flush()
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i] in (tag, "aside"):
                del self.path[i:]
                return

    def handle_data(self, data):
        if "article" in self.path and not {"aside", "nav", "script", "style", "form", "footer", "header"} & set(self.path[self.path.index("article") :]):
            self.cur += data


def test_html_extract_equals_a_walk_of_the_tree(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in Q.QUERIES["op8_html_extract"](spark, SF).collect()}
    differ = []
    for i, h in pages.items():
        w = Walk()
        w.feed(h or "")
        w.close()
        if got[i] != "\n".join(w.out):
            differ.append(i)
    assert len(pages) == len(got) and not differ


def test_toxic_spans_are_places_in_the_text(spark):
    model = toxicity.Model(weights={"scum": 9.0}, bias=-3.0, curve=(0.0, 1.0, 0.0, 0.0))
    for text in ("you scum here", "xİx you scum here", "İİİ scum ﬁ SCUM"):
        row = toxicity.score(table(spark, [text]), model).collect()[0]
        assert [text[s.start : s.end].lower() for s in row.toxic_spans] == ["scum"] * text.lower().count("scum")


def test_html_extract_of_languages_without_stop_words():
    russian = "Быстрая коричневая лиса перепрыгнула через ленивую собаку, и никто в деревне не удивился этому, потому что так бывало каждое утро."
    chinese = "敏捷的棕色狐狸跳过了懒狗，村里没有人对此感到惊讶，因为每天早晨都会发生这样的事情，人们早已习惯了这一切，只是笑着继续他们的工作。"
    japanese = "素早い茶色の狐が怠け者の犬を飛び越えたが、毎朝のことだったので村の誰も驚かなかった。"
    polish = "Szybki brązowy lis przeskoczył nad leniwym psem, lecz nikt we wsi nawet nie spojrzał, ponieważ zdarzało się tak każdego ranka."
    links, end = "<div><a href=a>Menü</a> <a href=b>Kontakt</a></div>", "<div>© 2026</div>"
    for t in (russian, chinese, japanese, polish):
        assert html_extract.extract(f"<body>{links}<div>{t}</div><p>{t}</p>{end}</body>") == f"{t}\n{t}", t
        assert html_extract.extract(f"<body>{links}<div>{t * 3}</div><p>{t}</p><p>{t[:20]}</p><p>{t * 3}</p>{end}</body>") == f"{t * 3}\n{t}\n{t[:20]}\n{t * 3}", t
    good = "The quick brown fox was in the house and it is not what they were all about, said the man who had been there for years and years. " * 2
    names = "Anna Berg, Carl Dahl, Eva Falk, Gustav Holm, Ida Jung, " * 6
    assert html_extract.extract(f"<body>{links}<p>{good}</p><p>{names}</p><p>{russian}</p><p>{good}</p>{end}</body>").split("\n") == [good.strip(), names.strip(), russian, good.strip()]
    assert html_extract.extract(f"<body><p>{names}</p></body>") == names.strip()
    assert html_extract.extract(f"<body>{links}<p>{good}</p><div>{names[:100]}</div><div>Menu Kontakt Shop Login Preise</div></body>") == good.strip()


# --- 9 ------------------------------------------------------------------------------------------------------


def hits_by_search(texts, items):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = tok(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in enumerate(texts):
        w, hit, own = tok(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    own |= ids
        names = ",".join(sorted(map(str, own)))
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("shard", [1_000_000, 40])
def test_decontamination_equals_search(spark, shard):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(14, 40))) for i in range(12)] + [(100, "Tiny item here"), (101, None), (102, ""), (103, "..."), (104, "solo"), (11, prose(rng, 20))]
    texts = [t for t in corpus(3) if not t or len(t) < 9000]
    for i, t in items[:12]:
        w = t.split()
        texts += [prose(rng, 30) + " " + t.upper() + " " + prose(rng, 300), " ".join(w[:12]), " ".join(w[-13:]) + " tail", prose(rng, 5) + ", TINY: item-here solo! " + prose(rng, 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(decontaminate.find(table(spark, texts), bench, shard_words=shard)).collect()}
    assert got == hits_by_search(texts, items)


def test_clean_cuts_passages_and_drops_contaminated(spark):
    rng = random.Random(6)
    item, other = prose(rng, 15), prose(rng, 900)
    docs = spark.createDataFrame([(1, other + ". " + item + "! end", 5, "a"), (2, item, 5, "b"), (3, None, None, None), (4, other, 7, "c")], "doc_id long, text string, n_chars long, lang string")
    out = {r.doc_id: r for r in decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and out[1].text == other + ". ! end" and out[1].n_chars == len(out[1].text) and out[4].n_chars == 7


def test_clean_judges_the_marks_of_all_automata_together(spark):
    rng = random.Random(9)
    name = iter(range(10_000))
    fresh = lambda n: [f"w{next(name)}" for _ in range(n)]
    a, b, c = fresh(40), fresh(40), fresh(20)
    items = [" ".join(a), " ".join(b), " ".join(c), " ".join(c[12:] + fresh(1) + fresh(12)), " ".join([*c[8:], *fresh(8)])]
    texts = [" ".join(x) for x in (
        [*a, *fresh(460), *b, *fresh(460 + 600)], [*a, *fresh(400), *b, *fresh(420 + 100)], [*a[:30], *fresh(600)], [*fresh(500), *c, *items[4].split()[12:], *fresh(300)], fresh(200), [*b, *b],
    )] + [None, ""]
    rows = [(i, t, 5, "de") for i, t in enumerate(texts)] + [(None, texts[1], 5, "x"), (None, texts[2], 5, "x"), (2, texts[4], 5, "y"), (2, texts[2], 5, "y"), (None, None, None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = hits_by_search([r[1] for r in rows], list(enumerate(items)))
    for shard in (1_000_000, 60, 1):
        found = decontaminate.report(decontaminate.find(docs, bench, shard_words=shard)).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(repr((r[0], *want[i])) for i, r in enumerate(rows)), shard
        left = sorted(map(repr, map(tuple, decontaminate.clean(docs, bench, shard_words=shard).collect())))
        assert len(left) == sum(not w[4] for w in want.values()), shard
        if shard == 1_000_000:
            whole = left
        assert left == whole, shard


# --- 10 -----------------------------------------------------------------------------------------------------


def best_by_dp(codec, text):
    v = codec.vocab
    piece = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True) if k in (1, 4)}
    best = [0.0] + [None] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 16), e):
            if best[s] is not None and text[s:e] in piece and (best[e] is None or best[s] + piece[text[s:e]] > best[e]):
                best[e] = best[s] + piece[text[s:e]]
        if best[e] is None:
            best[e] = best[e - 1] + codec.unknown
    return best[-1]


def test_viterbi_is_best_and_round_trips(spark):
    codec = sp_codec.codec(sp_codec.load())
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "Hello world", "naïve ☃ 𓀀 漢字", "tab\tnew\nline", *("".join(rng.choice("abcé ñ漢 \n1The") for _ in range(rng.randrange(40))) for _ in range(200))]
    for t in texts:
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        if t:
            marked = "▁" + t.replace(" ", "▁")
            total, i = 0.0, 0
            while i < len(ids):
                if codec.vocab.kinds[ids[i]] == 6:
                    first = int(codec.vocab.pieces[ids[i]][3:5], 16)
                    i += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                    total += codec.unknown
                else:
                    total += codec.vocab.scores[ids[i]]
                    i += 1
            assert total == pytest.approx(best_by_dp(codec, marked))
    df = table(spark, [None, "", "x ▁ y", "Hi " * 20000])
    rows = {r.doc_id: r for r in sp_codec.encode(df, digest=True).collect()}
    assert rows[0].token_ids == [] and rows[1].n_tokens == 0 and all(r.round_trip for r in rows.values())
    assert sp_codec.decode(sp_codec.encode(df)).where("doc_id = 3").first().text == "Hi " * 20000


# --- queries and pipeline -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_twin(spark, duck, name):
    assert rows_of(Q.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(Q.SQL[name]).df())


def test_contract_columns(spark):
    rows = {n: Q.QUERIES[n](spark, SF) for n in ("op2_pii", "op3_toxicity", "op8_html_extract", "op9_decontaminate", "op10_sentencepiece")}
    assert rows["op3_toxicity"].columns == ["doc_id", "held_out", "score", "predicted"]
    for df in rows.values():
        assert df.count() == spark.read.parquet(f"{SF}/{'pages' if 'page_id' in df.columns else 'documents'}.parquet").count()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = hits_by_search([t for _, t in docs], items)
    assert {r.doc_id: tuple(r)[1:] for r in rows["op9_decontaminate"].collect()} == {d: want[i] for i, (d, _) in enumerate(docs)}


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, SF).persist()
        assert docs.columns == columns, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        texts = {r.doc_id: r.text for r in before.collect()}
        left = {r.doc_id: r.text for r in docs.collect()}
        ids = sorted(texts)
        if name == "exact_dedup":
            want = groups_by_text([texts[i] for i in ids])
            assert set(left) == {ids[i] for i, v in want.items() if v[2]}
        elif name == "ngram_join":
            want = components_by_pairs([texts[i] for i in ids])
            assert set(left) == {ids[i] for i, v in want.items() if v[1] == i}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = hits_by_search([texts[i] for i in ids], items)
            assert set(left) == {ids[i] for i, v in want.items() if not v[4]}
            assert all(left[i] == texts[i] for k, i in enumerate(ids) if i in left and want[k][1] == 0)
    out = P.STAGES[-1][1](spark, docs, SF)
    assert sp_codec.decode(out).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").where("text <> was").isEmpty()
    assert P.ORACLE_SQL is None
