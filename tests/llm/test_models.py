"""Quality, language model, toxicity and licences: held-out accuracy, brute force, gradients and odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import gru, licenses, lm, quality, toxicity, words
from quire.runtime import FREE_SHUFFLES, staged

from .conftest import odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def block(*texts):
    return next(words.blocks(iter([pa.RecordBatch.from_pydict({"text": pa.array(list(texts), pa.string())})]), most=1 << 30))


def test_words_and_hashes():
    texts = ["", None, "  a bb\tc\x0b\x0cd ", "é　x y", "abc", "abc abc", *(r[1] for r in odd_rows())]
    b = block(*texts)
    starts, ends, first = words.spans(b.data, b.offsets)
    h = words.hashes(b.data, starts, ends)
    seen = {}
    for i, t in enumerate(texts):
        own = [bytes(b.data[s:e]).decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert own == WORD.findall(t or "")
        for w, x in zip(own, h[first[i] : first[i + 1]], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_word_hash(monkeypatch):
    monkeypatch.setattr(words, "SPAN", 8)
    b = block("abcdefghijklmnopqrstuvwxyz abc", "abc abcdefghijklmnopqrstuvwxyz")
    h = words.hashes(b.data, *words.spans(b.data, b.offsets)[:2])
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


def test_blocks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"], "k": list(range(5))})
    for most in (1, 10, 1000):
        got = [(k, bytes(b.data[b.offsets[i] : b.offsets[i + 1]]).decode()) for b in words.blocks(iter([batch.slice(1), batch.slice(0, 1)]), most=most) for i, k in enumerate(b.rows.column("k").to_pylist())]
        assert got == [(1, ""), (2, "b" * 50), (3, ""), (4, "c"), (0, "a" * 10)]


# quality


def test_quality_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet".replace("sf0.001", "sf0.01")) for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_quality_against_density():
    rng = np.random.default_rng(0)
    data = {0: rng.normal(0, 1, (400, 3)), 1: rng.normal(1, 2, (900, 3))}
    sums = {k: (x := np.column_stack([np.ones(len(v)), v])).T @ x for k, v in data.items()}
    model = quality.Discriminant(sums, 0.0, 0.0, 1.0)
    point = rng.normal(size=(5, 3))
    log = {}
    for k, v in data.items():
        c, d = np.cov(v.T, bias=True), point - v.mean(0)
        log[k] = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
    want = 1 / (1 + np.exp(-(log[1] - log[0] + np.log(900 / 400))))
    assert np.allclose(model.score(point), want, atol=1e-4)


def plain_statistics(text):
    """The statistics of a text, straight from their definitions."""
    def odds(k, m):
        return math.log((k + 0.5) / (max(m - k, 0) + 0.5))

    raw = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0d]+", raw.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    n = len(w)
    rate = lambda k: math.log((k + 0.5) / (n + 1))
    grams = [tuple(w[i : i + 5]) for i in range(n - 4)] or ([tuple(w)] if w else [])
    lines = raw.split(b"\n")
    lines = (lines if raw and not raw.endswith(b"\n") else lines[:-1]) if raw else []
    count = lambda s: sum(raw.count(bytes([c])) for c in s)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    return [
        math.log1p(n), math.log((sum(map(len, w)) + 5) / (n + 1)), rate(count(b"#*$%&<>@^~=+\\{}[]_")), odds(upper, upper + lower), rate(count(b"!?")), rate(count(b".,;:")), rate(count(b"0123456789")),
        odds(len(grams) - len(set(grams)), len(grams)), odds(len(set(w)), n), rate(len(lines)), odds(len(lines) - len(set(lines)), len(lines)), odds(count(range(192, 256)), len(raw)), rate(count(b"|")),
        rate(sum(a == b for a, b in zip(w, w[1:]))),
    ]


def test_statistics(docs):
    texts = [r.text for r in docs.select("text").limit(80).collect()] + [r[1] or "" for r in odd_rows()] + ["Same SAME same|x", "\n\n", "a\na\n", "a\na", "x " * 9]
    got = quality.statistics(block(*texts))
    assert np.allclose(got, [plain_statistics(t) for t in texts])


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_pipeline_scores_equal_the_query(spark, docs, labels, most):
    scores = {(r.doc_id, round(r.score, 9)) for r in quality.quality_scores(docs, labels).collect()}
    assert {(r.doc_id, round(r.score, 9)) for r in quality.with_quality(docs, labels, most_broadcast=most).collect()} == scores


def test_quality_odd_rows(spark, odd, empty, labels):
    none = labels.limit(0)
    made = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (none, made, labels):
        for f in (quality.quality_scores, quality.with_quality):
            got = f(odd, known).collect()
            assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
            assert f(empty, known).count() == 0
    assert {r.score for r in quality.quality_scores(odd, none).collect()} == {0.5}
    assert set(odd.columns) | {"predicted"} == set(quality.with_quality(odd, labels).columns)


# language model



def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def brute_lm(rows, weights_of):
    docs = [(i, WORD.findall((t or "").translate(LOWER)) + [None]) for i, t in rows]
    train = [d for i, d in docs if not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)]
    uni = Counter(w for d in train for w in d)
    two = Counter((a, b) for d in train for a, b in zip([None, *d], d))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, d in docs:
        score = 0.0
        for a, b in zip([None, *d], d):
            l2, l1, l0 = weights_of[int(lm.bucket(np.array([uni[a]]))[0])]
            score += math.log10(l2 * two[a, b] / max(uni[a], 1) + l1 * uni[b] / max(n, 1) + l0 / (v + 1))
        out.append((i, len(d), sum(uni[w] > 0 for w in d), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in d), score))
    return out


def test_lm(docs, odd, empty, monkeypatch):
    kept = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a, **b: kept.append(learn(*a, **b)) or kept[-1])
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        for options in ({}, {"part_rows": 200}, {"max_vocab": 1}):
            got = lm.lm_scores(df, held(), **options).collect()
            want = brute_lm(rows, kept[-1])
            key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
            got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
            for a, b in zip(got, sorted(want, key=key), strict=True):
                assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=2e-6, atol=1e-4)
    assert lm.lm_scores(empty, held()).count() == 0
    assert lm.lm_scores(odd, F.lit(True)).where("train_tokens = 0 and n_known = 0").count() == odd.count()


def test_lm_learns_from_all_bigrams_on_both_paths(docs, odd, monkeypatch):
    kept = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda cells, *a: kept.append((cells["w"].sum(), learn(cells, *a))) or kept[-1][1])
    for df in (docs, odd):
        kept.clear()
        for options in ({}, {"part_rows": 200}, {"max_vocab": 1}):
            total = lm.lm_scores(df, held(), **options).first().train_tokens
        assert all(events == total and np.allclose(weights, kept[0][1], atol=1e-9) for events, weights in kept)


def on_disk(spark):
    """Bytes of the session's shuffle files, and of its staged tables."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return sum(f.length() for f in files), sum(f.stat().st_size for f in shared.rglob("*.parquet"))


def test_lm_beyond_the_vocabulary_needs_little_disk(spark, docs, sf, monkeypatch):
    found, write, stored = [], lm.staged, on_disk(spark)[1]

    def spy(df, label, *_, **options):
        before = on_disk(spark)[0]
        table = write(df, label, **{k: v for k, v in options.items() if k != "free"})
        shuffled, tables = on_disk(spark)
        found.append(shuffled - before + tables - stored)
        return table

    monkeypatch.setattr(lm, "staged", spy)
    scores = lm.lm_scores(docs, held(), max_vocab=1)
    before = on_disk(spark)[0]
    scores.write.format("noop").mode("overwrite").save()
    found.append(on_disk(spark)[0] - before + on_disk(spark)[1] - stored)
    assert max(found) < 4 * Path(f"{sf}/documents.parquet").stat().st_size


def test_staged_frees_its_shuffle_files(spark):
    rows = spark.range(100_000).repartition(3, "id")
    before = on_disk(spark)[0]
    table = staged(rows, "freed", free=True)
    assert on_disk(spark)[0] < before + 100_000 and table.count() == 100_000
    assert spark.conf.get(FREE_SHUFFLES) == "false"


def test_lm_by_many_parts(docs, odd, monkeypatch):
    kept = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a, **b: kept.append(learn(*a, **b)) or kept[-1])
    for df in (docs, odd):
        got = lm.lm_scores(df, held(), max_vocab=1, part_rows=200).collect()
        want = brute_lm([tuple(r) for r in df.select("doc_id", "text").collect()], kept[-1])
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
        for a, b in zip(got, sorted(want, key=key), strict=True):
            assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)


def test_cut_runs_come_back():
    rng = np.random.default_rng(2)
    keys = np.unique(np.r_[rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.uint64(0), np.uint64((1 << 64) - 1)])
    counts = rng.integers(0, 1 << 40, len(keys)).astype(np.uint64)
    for parts in (1, 3, 700):
        runs = list(lm.cut(keys, counts, parts))
        assert [p for p, *_ in runs] == sorted({int(k) * parts >> 64 for k in keys})
        assert np.array_equal(np.concatenate([np.cumsum(lm.opened(a, n), dtype=np.uint64) + lm._low(p, parts) for p, a, _, n in runs]), keys)
        assert np.array_equal(np.concatenate([lm.opened(b, n) for _, _, b, n in runs]), counts)


def test_lm_beats_the_base(docs):
    row = lm.lm_scores(docs, held()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_weights_are_mixtures():
    import pandas as pd

    cells = pd.DataFrame({"cell": [128 * 128 * 3 + 5, 128 * 128 * 3 + 9, 128 * 128 * 8], "w": [10.0, 4.0, 2.0], "p2": [5.0, 0.0, 0.0], "p1": [0.1, 0.04, 1e-5]})
    weights = lm.learn(cells, 1e-4)
    assert np.allclose(weights.sum(1), 1) and weights[0, 0] == 0 and weights[3, 0] > weights[8, 0]


# toxicity


def test_gradients():
    net = gru.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    b = block("abc defg hi stupid xyz")
    own, _ = gru.distinct_words(b.data, *words.spans(b.data, b.offsets)[:2])
    index, mask = np.array([[0, 1, 2, 3] + [5] * 28, [4, 3, 2, 1] + [0] * 28]), np.ones((2, 32))
    mask[0, 4:] = 0
    target, importance = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.project(net.vectors(own)), index, mask)))
        return -(importance * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / importance.sum()

    _, grads, _ = net.gradients(own, index, mask, target, importance)
    rng = np.random.default_rng(1)
    for name, g in grads.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape)
            old, e = net.p[name][at], 1e-4
            net.p[name][at] = old + e
            up = loss()
            net.p[name][at] = old - e
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2 / e - g[at]) < 1e-5 + 1e-3 * abs(g[at])


def test_windows_cover_all_words():
    first = np.array([0, 0, 5, 37, 70, 200])
    table, doc = gru.window_table(first)
    for d in range(5):
        own = table[doc == d]
        seen = {w for a, b in own for w in range(a, b)}
        assert seen == set(range(first[d], first[d + 1])) and all(b - a <= gru.WINDOW for a, b in own)
    assert len(table[doc == 4]) > 130 // gru.WINDOW


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(0)
    stems, common = ["grumf", "blarg"], [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "pi", "du", "ve")]
    rows, known = [], []
    for i in range(600):
        text = list(rng.choice(common, rng.integers(5, 150)))
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(1 + len(text) // 40):
                text[rng.integers(0, len(text))] = rng.choice(stems) + rng.choice(common)
        rows.append((i, " ".join(text)))
        known.append((i, 0, toxic))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(df, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.93


def test_toxicity_of_stems():
    """Toxic words that share a stem of common syllables with new endings, so that neither whole words nor short n-grams tell."""
    rng = np.random.default_rng(1)
    syllables = [f"{a}{b}" for a in "klmnprst" for b in "aeiou"]
    made = lambda n: "".join(rng.choice(syllables, n))
    texts, toxic = [], np.arange(1100) % 4 == 0
    for k in toxic:
        text = [made(rng.integers(2, 6)) for _ in range(rng.integers(20, 90))]
        for i in rng.integers(0, len(text), 1 + len(text) // 30) if k else ():
            text[i] = "naretipo" + made(rng.integers(1, 4))
        texts.append(" ".join(text))
    model = toxicity.fit(np.arange(1000), toxic[:1000].astype(int), [t.encode() for t in texts[:1000]], 0.25)
    z = toxicity.logits(model.net, block(*texts[1000:]))
    assert np.mean((model.slope * z + model.offset >= 0) == toxic[1000:]) >= 0.95


def test_long_words_are_read_whole():
    texts = ["abc " + "x" * 39 + " y", "ö" * 500 + "z" * 7 + " a", "", "-".join(f"w{i}" for i in range(100)), "q" * 41, "q" * 40]
    b = block(*texts)
    starts, ends, first = gru.split_long(*words.spans(b.data, b.offsets))
    for i, t in enumerate(texts):
        own = list(zip(starts[first[i] : first[i + 1]] - b.offsets[i], ends[first[i] : first[i + 1]] - b.offsets[i], strict=True))
        assert all(0 < e - s <= gru.LONGEST for s, e in own)
        raw = t.encode()
        for s in range(len(raw) - gru.PIECE_STEP + 1):
            if b" " not in raw[s : s + gru.PIECE_STEP]:
                assert any(x <= s and s + gru.PIECE_STEP <= y for x, y in own)
    net = gru.Network()
    same = toxicity.logits(net, block("q" * 300 + "grumf" + "q" * 300, "q" * 300 + "blarg" + "q" * 300))
    assert same[0] != same[1]


def test_toxicity_without_blanks(spark):
    rng = np.random.default_rng(0)
    stems, common = ["猫犬鳥", "山川海"], [f"{a}{b}" for a in "春夏秋冬朝昼夕夜" for b in "日月火水木金土"]
    rows, known = [], []
    for i in range(600):
        text = list(rng.choice(common, rng.integers(30, 150)))
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(1 + len(text) // 40):
                text[rng.integers(12, len(text))] = rng.choice(stems)
        rows.append((i, "".join(text)))
        known.append((i, 0, toxic))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(df, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.93


def test_toxicity_sample_is_whole(spark):
    """Texts are taken whole; a repeated doc_id counts once; the bounds are on rows and bytes of each label."""
    long = " ".join(f"w{i}" for i in range(5000))
    rows = spark.createDataFrame([(i, f"{long} {i}") for i in range(40)] + [(0, f"copy {i}") for i in range(50)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts = {(r.doc_id, r.text) for r in rows.collect()}
    every = toxicity.sample(rows, known, 800, 1 << 30).to_pylist()
    assert len(every) == 40 and all((r["doc_id"], r["text"]) in texts for r in every)
    assert sorted(r["toxic"] for r in toxicity.sample(rows, known, 5, 1 << 30).to_pylist()) == [0] * 5 + [1] * 5
    few = toxicity.sample(rows, known, 800, 3 * len(long)).to_pylist()
    assert {r["toxic"] for r in few} == {0, 1} and len(few) < 10
    assert sorted(r["toxic"] for r in toxicity.sample(rows, known, 800, 1).to_pylist()) == [0, 1]


def test_toxicity_odd_rows(spark, odd, empty, labels):
    made = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (9, 0, 1), (2, 1, 0), (12, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels.limit(0), made):
        got = toxicity.toxicity_scores(odd, known).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert toxicity.toxicity_scores(empty, known).count() == 0


# licences


def test_licences(spark, odd, empty):
    assert licenses.classifier().accuracy > 0.97
    filler = "La paoiré ou ierere thnt eringing of the house. " * 30
    texts = {
        1: "Thnt.\nLicensed under CC BY-NC 4.0.", 2: "Released under the MIT License.\nthe end", 3: filler + "Licensed under the Apache License, Version 2.0. " + filler,
        4: filler, 5: "she has a driving license and the rights of the people", 6: "This work is licensed under the GNU General Public License, version 3.", 7: "Licensed under the Zorblat License.", 8: "All rights reserved.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = licenses.license_scan(df).collect()
    found = {(r.doc_id, r.family) for r in got if r.confirmed}
    assert found == {(1, "cc-by-nc"), (2, "mit"), (3, "apache-2.0"), (6, "gpl"), (8, "proprietary")}
    assert not [r for r in got if r.doc_id in (4, 5)] and all(not r.confirmed for r in got if r.doc_id == 7)
    for r in got:
        assert texts[r.doc_id].encode()[r.start : r.end].decode() == r.excerpt and 0.5 <= r.probability <= 1
    assert licenses.license_scan(odd).where("confirmed").count() == 0 and licenses.license_scan(empty).count() == 0


def test_licence_lines_like_brute_force(docs):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    want = Counter((r.doc_id, k, lines[x]) for r in docs.collect() for k, x in enumerate((r.text or "").split("\n")) if x in lines)
    assert Counter((r.doc_id, r.paragraph, r.family) for r in licenses.license_scan(docs).where("confirmed").collect()) == want


WRAPPED = {
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
}


def test_wrapped_licences(spark):
    filler = "La paoiré ou ierere thnt\neringing of the house.\n" * 30
    texts, want = {}, {}
    for k, (family, text) in enumerate(WRAPPED.items()):
        alone = {10 * k: text, 10 * k + 1: f"Copyright 2020 A. Person\n\n{text}\n\nint main()", 10 * k + 2: text.replace("\n", "\r\n"), 10 * k + 3: f"{filler}\n{text}\n \n{filler}", 10 * k + 4: f"{filler}{text}\n{filler}"}
        alone[10 * k + 5] = "\n".join(f" * {x}" for x in text.split("\n"))
        texts |= alone
        want |= {i: family for i in alone}
    df = spark.createDataFrame([*texts.items(), (90, "Released under the\n\nMIT License."), (91, WRAPPED["gpl"].replace("\n", "\n\n"))], "doc_id long, text string")
    rows = licenses.license_scan(df).collect()
    assert {(r.doc_id, r.family) for r in rows if r.confirmed} == set(want.items())
    for r in rows:
        if r.doc_id in texts:
            assert texts[r.doc_id].encode()[r.start : r.end].decode() == r.excerpt
            assert r.paragraph == texts[r.doc_id].encode()[: r.start].count(b"\n")


def test_licences_of_two_families_in_one_paragraph(spark):
    texts = ["Released under the MIT License.\n" + WRAPPED["gpl"], "Copyright 2020 the authors. All rights reserved.\n" + WRAPPED["bsd"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in licenses.license_scan(df).where("confirmed").collect()}
    assert got == {(0, "mit"), (0, "gpl"), (1, "proprietary"), (1, "bsd")}


def test_licence_catch_rate(spark):
    """Notices in comments of all styles, wrapped anywhere and with a word changed here and there: nearly all are confirmed
    as their family; none of an invented family is confirmed as anything."""
    rng = np.random.default_rng(11)
    styles = ["// {}", "# {}", " * {}", "; {}", "-- {}", "%% {}", "{}", "<!-- {} -->", "dnl {}"]
    texts, want = [], {}
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for invented in (False, True):
                for _ in range(4):
                    own = licenses.own_words(family)
                    bare = [w.strip(".,;:()").lower() for w in notice.split()]
                    w = ["Quomble" if invented and b in own else "altered" if b not in own and rng.random() < 0.04 else w for w, b in zip(notice.split(), bare, strict=True)]
                    if invented and (w == notice.split() or family == "proprietary" or "SPDX" in notice):
                        continue
                    style, width = styles[rng.integers(len(styles))], int(rng.integers(4, 12))
                    texts.append("int x;\n\n" + "\n".join(style.format(" ".join(w[i : i + width])) for i in range(0, len(w), width)) + "\n\nint y;")
                    want[len(texts) - 1] = None if invented else family
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.license_scan(df).where("confirmed").collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    known = [i for i, f in want.items() if f]
    caught = np.mean([want[i] in got.get(i, ()) for i in known])
    wrong = np.mean([any(f != want[i] for f in got.get(i, ())) for i in want])
    print("caught", caught, "wrong", wrong)
    assert caught >= 0.9 and wrong <= 0.03


def test_licences_of_other_families(spark):
    texts = {
        1: "Licensed under the Eclipse Public License, version 2.0.", 2: "Licensed under the Sleepycat Public License, version 2.0.", 3: "# SPDX-License-Identifier: MIT", 4: "SPDX-License-Identifier: LGPL-2.1-or-later",
        5: "//\n// Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby granted, provided that the above\n// copyright notice and this permission notice appear in all copies.\n//",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in licenses.license_scan(df).where("confirmed").collect()}
    assert got == {(1, "epl"), (3, "mit"), (4, "lgpl"), (5, "isc")}
