"""The Jaccard join and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quire.llm import jaccard, quality
from quire.llm.components import components
from quire.runtime import staged

from .conftest import odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, n, num, den):
    """(doc_id, set size, smallest doc_id of the component) of each row."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for own in where.values() for a in own for b in own if a < b}:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def same(df, n, num, den):
    got = jaccard.jaccard_components(df, n, num, den).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute([tuple(r) for r in df.select("doc_id", "text").collect()], n, num, den)


def test_documents(docs):
    same(docs, 4, 85, 100)


@pytest.mark.parametrize("n, num, run, salted", [(4, 85, 4000, 100_000), (5, 80, 4000, 100_000), (2, 50, 4, 3), (2, 50, 4, 100_000), (4, 85, 4, 2)])
def test_near_copies(spark, monkeypatch, n, num, run, salted):
    """Chains and clusters of near copies round the threshold; small bins and parts; shingles with many groups in cells."""
    monkeypatch.setattr(jaccard, "RUN", run)
    monkeypatch.setattr(jaccard, "SALTED", salted)
    monkeypatch.setattr(jaccard, "BIN", 3)
    monkeypatch.setattr(jaccard, "QUERIES", 2)
    monkeypatch.setattr(jaccard, "PART_ROWS", 50)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 5)
    rng = random.Random(n)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(20):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own += [rng.choice(words)] * rng.randrange(8)
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, num, 100)


def test_odd_rows(odd, empty):
    same(odd, 4, 85, 100)
    assert jaccard.jaccard_components(empty).count() == 0


def test_near_copies_without_ids(spark):
    """Near copies link by their texts even where doc_id is null."""
    base = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(base)), (None, " ".join([*base[:-1], "x"])), (None, "quite another text of some words"), (9, " ".join(["y", *base[1:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 4, 85, 100).collect()}
    assert got == {(None, 37, 9), (9, 37, 9), (None, 3, None)}


def test_groups_are_not_connected_again(spark, monkeypatch):
    """The last components get a link for each pair of groups at most in each bin, not all links of documents once more."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(40):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{k}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []

    def counting(links):
        links = staged(links, "counted")
        seen.append(links.count())
        return components(links)

    monkeypatch.setattr(jaccard, "components", counting)
    same(df, 4, 85, 100)
    assert len(seen) == 2 and seen[0] > 20 and seen[1] < 20


def test_pairs_are_shipped_in_pieces():
    """Counted pairs leave a worker in small batches, and none gets lost."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 600, (2, 300_000))
    got = list(jaccard.counted(iter([(a[:200_000], b[:200_000]), (a[200_000:], b[200_000:])])))
    assert max(x.num_rows for x in got) <= jaccard.SHIPPED
    rows = Counter()
    for x in got:
        for *pair, n in zip(*(c.to_pylist() for c in x.columns), strict=True):
            rows[tuple(pair)] += n
    assert rows == Counter(zip(a.tolist(), b.tolist(), strict=True))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    root = {v: v for e in links for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for e in links if e[0] != e[1] for v in e}


# the pipeline


def test_pipeline_stages(spark, docs, sf):
    at = docs
    for k, (name, stage) in enumerate(P.STAGES):
        before = Counter(map(tuple, at.collect()))
        out = staged(stage(spark, at, sf), name)
        after = Counter(map(tuple, out.collect()))
        if k < 4:
            assert out.columns == docs.columns and set(after) <= set(before)
        if name == "exact_dedup":
            assert sorted(r[0] for r in after) == sorted(max(r[0] for r in before if (r[1] or "") == t) for t in {r[1] or "" for r in before})
        if name == "ngram_jaccard":
            assert sorted(r[0] for r in after) == sorted({c if n else i for i, n, c in brute([r[:2] for r in before], 5, 80, 100)})
        if name == "packing":
            assert out.agg(F.sum("length")).first()[0] > 0
        at = out


def test_pipeline_odd_rows(spark, odd, empty, sf):
    for name, stage in P.STAGES:
        made = stage(spark, empty, sf)
        assert made.count() == 0
        made = staged(stage(spark, odd, sf), name)
        assert name == "packing" or made.columns == odd.columns
    exact = P.exact(spark, odd, sf)
    assert exact.count() == len({r[1] or "" for r in odd_rows()})
    near = P.near(spark, odd, sf)
    blank = sum(not WORD.search(r[1] or "") for r in odd_rows())
    groups = {i for i, n, c in brute([r[:2] for r in odd_rows()], 5, 80, 100) if n}
    assert blank <= near.count() <= blank + len(groups)


def test_pipeline_keeps_clashing_columns(spark, docs, sf):
    """Columns named like the operators' own come back as they were, from every stage that returns documents."""
    names = ["row", "key", "mark", "_key", "_mark", "rate", "copies", "copy", "shuffle_key", "name", "doc", "place", "parts", "cdf", "packed", "_source", "_cdf", "_parts", "score", "predicted", "held_out", "kept", "repeats", "first", "group_id", "a.b"]
    wide = docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in P.STAGES[:-1]:
        made = staged(stage(spark, wide, sf), name)
        assert made.columns == wide.columns and made.count() > 0
        assert made.where(F.exists(F.array(*(F.col(f"`{n}`") != F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names)), lambda x: x)).isEmpty()
    assert staged(P.packing(spark, wide, sf), "packed").count() > 0


def test_run(spark, sf, docs):
    """The whole pipeline against a plain version of its stages; the scores of quality are those of the operator, tested apart."""
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard", "source_mixing", "packing"]
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect() if scores[r.doc_id] >= 0.3]
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], r), r)
    rows = sorted(last.values())
    stay = {c if n else i for i, n, c in brute([r[:2] for r in rows], 5, 80, 100)}
    rows = [r for r in rows if r[0] in stay]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.encode()) + 1
    roots = sum(math.sqrt(b) for b in sizes.values())
    exact = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {}
    for i, text, source in rows:
        rate = math.sqrt(sizes[source]) / roots * sum(sizes.values()) / sizes[source]
        u = int(hashlib.md5(f"17:{i}:0".encode()).hexdigest()[:13], 16) / (1 << 52)
        n, p = 0, math.exp(-rate)
        cdf = p
        while cdf <= u:
            n += 1
            p *= rate / n
            cdf += p
        if n:
            want[i] = (n, np.array([*exact.encode(text, add_special_tokens=False).ids, 1], "<u4"))
    pieces = P.run(spark, sf).collect()
    sequences, tokens = defaultdict(list), Counter()
    for r in pieces:
        n, ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    assert tokens == {i: n * len(ids) for i, (n, ids) in want.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
