"""Packing, exact dedup, sharding, mixing and host rules: against brute force, round trips and odd rows."""

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
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import dedup, host_rules, mixing, packing, sharding
from quire.llm.queries import QUERIES, SQL

from ..oracle import compare, connect
from .conftest import odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    assert compare(spark, connect(sf), QUERIES[name](spark, sf), SQL[name]) is None


# packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_tokenizer(text):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))) if not hasattr(test_ids_equal_the_tokenizer, "t") else test_ids_equal_the_tokenizer.t
    test_ids_equal_the_tokenizer.t = t
    own = packing.token_ids(text, str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert own.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_special_token_string(tokenizer):
    text = "a<|endoftext|>b"
    own = packing.token_ids(text, str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert own.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def check_packing(pieces, texts, tokenizer, size):
    whole = Counter(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts)
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length * 4 == len(p.ids) and 0 < p.length <= size
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) <= size
    back = Counter()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
    for (_, total), own in by_doc.items():
        own.sort(key=lambda p: p.start)
        starts = Counter(p.start for p in own)
        for _ in range(starts[0]):
            ids, at = [], 0
            while at < total:
                p = next(p for p in own if p.start == at)
                own.remove(p)
                ids += np.frombuffer(p.ids, "<u4").tolist()
                at += p.length
            back[tuple(ids)] += 1
        assert not own
    assert back == whole


def test_packing_round_trip(docs, tokenizer):
    rows = docs.select("text").collect()
    pieces = packing.pack_documents(docs).collect()
    check_packing(pieces, [r.text for r in rows], tokenizer, 2048)
    used = Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    assert sum(used.values()) / (2048 * len(used)) > 0.97


def test_packing_odd_rows(odd, empty, tokenizer, monkeypatch):
    for size in (16, 2048):
        check_packing(packing.pack_documents(odd.where("doc_id <> 1"), size).collect(), [r[1] for r in odd_rows() if r[0] not in (1, None)], tokenizer, size)
    assert packing.pack_documents(odd).agg(F.sum("length")).first()[0] == sum(len(tokenizer.encode(r[1] or "").ids) + 1 for r in odd_rows())
    assert packing.pack_documents(empty).count() == 0


def plain_pack(lengths, size):
    """Longest first (ties in order), each to the cheapest sequence with room; else cut over the one with most room."""
    bins = [[0, 0.0] for _ in range(math.ceil(sum(lengths) / size))]
    out = []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        start, left = 0, lengths[piece]
        while left:
            roomy = [b for b in range(len(bins)) if size - bins[b][0] >= left]
            at = min(roomy, key=lambda b: bins[b][1]) if roomy else max(range(len(bins)), key=lambda b: size - bins[b][0])
            take = min(left, size - bins[at][0])
            out.append((piece, start, take, at, bins[at][0]))
            bins[at][0] += take
            bins[at][1] += packing.LINEAR * take + packing.QUADRATIC * take * take
            start, left = start + take, left - take
    return out


def test_pack_follows_the_cost_rule():
    rng = random.Random(6)
    for size in (7, 64, 2048):
        for n in (0, 1, 5, 80):
            lengths = [rng.randrange(1, size) for _ in range(n)]
            assert packing.pack(np.array(lengths, np.int64), size) == plain_pack(lengths, size)


def test_pack_balances_costs():
    lengths = np.array([900, 800, 700, 600, 500, 400, 100, 50, 40, 6])
    placed = packing.pack(lengths, 2048)
    got = Counter()
    for _, _, length, at, _ in placed:
        got[at] += length
    assert len(got) == 2 and sum(got.values()) == lengths.sum() and max(got.values()) <= 2048 and len(placed) <= len(lengths) + 1


# exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        spare = True
        for i in ids:
            kept = i == keep and spare
            spare = spare and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("options", [{}, {"chunk_chars": 1000}, {"chunk_chars": 500, "primes": (3, 5), "broadcast_rows": 2}])
def test_dedup(docs, odd, empty, options):
    for df in (docs.limit(100), odd):
        rows = df.select("doc_id", "text").collect()
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.dedup_exact(df, **options).collect()]
        assert sorted(map(repr, got)) == brute_dedup(rows)
    assert dedup.dedup_exact(empty, **options).count() == 0


def test_fingerprint_is_the_polynomial(spark):
    texts = ["", "a", "b" * 4096, "é" * 5000, "xyz" * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"text_sha256": F.lit(""), "n_bytes": F.octet_length("text").cast("long")})
    for chunk in (1 << 20, 700):
        got = {r.doc_id: (r.h1, r.h2) for r in dedup.fingerprint_table(rows, chunk, dedup.PRIMES).collect()}
        for i, t in enumerate(texts):
            want = []
            for base, prime in zip(dedup.BASES, dedup.PRIMES, strict=True):
                h = 0
                for b in t.encode():
                    h = (h * base + b + 1) % prime
                want.append(h)
            assert got[i] == tuple(want)


# sharding


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 2, -1, -(1 << 63), (1 << 63) - 1, 123456789, *range(10**12, 10**12 + 500)]
    rows = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    for n in (1, 2, 40):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in rows.select("doc_id", sharding.jump_pair(F.col("doc_id"), n).alias("j")).select("doc_id", "j.*").collect()}
        assert got == {k: (jump(k, n), jump(k, n + 1)) for k in keys}
        assert all(a == b or b == n for a, b in got.values())
    with pytest.raises(ValueError):
        sharding.jump_pair(F.lit(1), 0)


def test_sharding(docs, odd, empty):
    for df in (docs, odd):
        got = sharding.shard(df, 7, rows_per_block=3).collect()
        assert len(got) == df.count() and {r.law for r in got} == {"key"}
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.shard == jump(r.doc_id or 0, 7)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard(empty, 7).count() == 0


def test_one_repeated_row_is_spread(spark):
    """A null doc_id with one text, in a third of all rows, meets in no one block and in no one task."""
    rows = spark.createDataFrame([(None if i % 3 == 0 else i, "hot" if i % 3 == 0 else f"t{i}", "s") for i in range(6000)], "doc_id long, text string, source string").repartition(4)
    got = sharding.shard(rows, 2, rows_per_block=100).collect()
    for k in (0, 1):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    hot = sorted(r.slot for r in got if r.doc_id is None)
    assert len(hot) == 2000 and hot[-1] - hot[0] > 2500
    copied = mixing.replicate(rows, total=2.0).where("doc_id is null")
    assert copied.select("shuffle_key").distinct().count() == copied.count() > 1000


# mixing


def test_mixing(docs, odd, empty):
    for df, options in ((docs, {}), (odd, {}), (docs, {"weights": {"src0": 3, "src1": 1.5}, "total": 40.0})):
        sizes = Counter()
        rows = df.select("doc_id", "source", "text").collect()
        for r in rows:
            sizes[r.source or ""] += len((r.text or "").encode()) + 1
        weights = options.get("weights") or {s: math.sqrt(b) for s, b in sizes.items()}
        total = sum(weights.get(s, 0) for s in sizes)
        rate = {s: weights.get(s, 0) / total * sum(sizes.values()) * options.get("total", 1) / b for s, b in sizes.items()}
        want = Counter()
        for r in rows:
            mean, parts = rate[r.source or ""], max(1, math.ceil(rate[r.source or ""] / mixing.PART))
            for k in range(parts):
                u = int(hashlib.md5(f"17:{'null' if r.doc_id is None else r.doc_id}:{k}".encode()).hexdigest()[:13], 16) / (1 << 52)
                p = cdf = math.exp(-mean / parts)
                n = 0
                while cdf <= u:
                    n += 1
                    p *= mean / parts / n
                    cdf += p
                want[(r.doc_id, r.source, r.text)] += n
        got = mixing.shuffled(mixing.replicate(df, **options)).collect()
        assert Counter((r.doc_id, r.source, r.text) for r in got) == +want
    assert mixing.replicate(empty).count() == 0 and mixing.replicate(docs, weights={}).count() == 0
    assert "h1" in mixing.replicate(odd).columns
    clashing = docs.selectExpr("*", "doc_id as name", "'x' as cdf", "source as doc", "1 as place", "2 as parts", "3 as row", "4 as _source", "5 as Copies")
    made = mixing.replicate(clashing)
    assert made.columns == [*clashing.columns[:-1], "rate", "copies", "copy", "shuffle_key"] and made.where("name is distinct from doc_id or doc is distinct from source").isEmpty()


# host rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_host_counts(docs, odd, empty):
    for df in (docs, odd):
        got = host_rules.host_rules(df).collect()
        want = Counter((r.doc_id, r.source or "", *brute_counts(r.text)) for r in df.select("doc_id", "source", "text").collect())
        assert Counter((r.doc_id, r.host, *(r[c] for c in host_rules.COUNTS)) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert host_rules.host_rules(empty).count() == 0


def test_bad_hosts_go(spark):
    good, bad = " ".join(f"word{i}" for i in range(30)), "few words"
    rows = [(i, good, f"h{i % 8}") for i in range(400)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(200)] + [(5000, bad, "tiny"), (5001, good, "tiny")]
    got = host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.kept for r in got if r.host.startswith("h")) and not any(r.kept for r in got if r.host == "spam")
    tiny = {r.doc_id: r for r in got if r.host == "tiny"}
    assert tiny[5001].kept and tiny[5001].host_rate < 0.5


def test_prior_of_small_hosts(spark):
    """What sampling explains is no variance of the hosts: hosts of one document each get the mean."""
    good, bad = " ".join(f"word{i}" for i in range(30)), "few words"
    rows = [(i, bad if i % 5 == 0 else good, f"h{i}") for i in range(300)]
    got = host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.host_rate for r in got} == {0.2}
    assert host_rules.beta_prior(0, 0, 0, 0, 0) == (0, host_rules.NO_VARIANCE)
    # hosts of 50 documents whose rates differ by more: a strength near the one that they were drawn with
    rng = np.random.default_rng(0)
    p = rng.beta(0.3 * 8, 0.7 * 8, 4000)
    x, n = rng.binomial(50, p).astype(float), 50.0
    m, strength = host_rules.beta_prior(n * len(x), x.sum(), len(x), n * n * len(x), (x * x / n).sum())
    assert abs(m - 0.3) < 0.02 and abs(strength - 8) < 0.8
