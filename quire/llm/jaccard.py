"""N-gram Jaccard self-join with a token-group matrix: exact links, one component id per document.

1. Documents with equal shingle sets become one vertex.
2. Vertices that share a min-hash band are compared with few others of their band; the verified
   links partition the vertices into groups of similar documents.
3. Every set is put in one order, rare shingles first (by a frequency sketch of fixed size, then by
   hash; any fixed order is right). If x and y link and |x| <= |y|, the first
   |x| - ceil(2t / (1 + t) |x|) + l shingles of x and the first |y| - ceil(t |y|) + l of y have l in
   common, where l is 1 + |x| div EXTRA. The token-group matrix holds, for each of these shingles, the
   groups in whose union it is; the number of shingles that two groups share there bounds the overlap
   of any of their members, and only pairs of groups that reach it are opened. Groups in one shingle's
   row are in order of size, and only those of fitting sizes meet; a row of over RUN groups is cut into
   square cells that are dealt out to tasks.
4. A group is opened in bins of its members. A bin has the union of its members' whole sets; a query
   that overlaps it too little is passed over, others are counted against all members at once. As a
   group is connected, one link of a query with it is enough, and one between two groups. What was found joins
   groups, so the last components are those of groups, not of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.runtime import bound_batches, staged, unstage

from .components import components
from .shingles import BAND, MINHASHES, SIGNED, SLICE_BITS, digests, linker, sets_of, setter, signer, summed_cells
from .words import blocks, mix, tidy

#: One in so many shingles is added to the prefix, and asked for in common.
EXTRA = 100
#: Rows of a table of keys that may be broadcast (about 20 MB).
BROADCAST_ROWS = 500_000
#: Most cells of the frequency sketch (a byte each, sent to every worker; a task holds and ships four bytes each). It
#: only has to tell very common shingles from the rest, so it does not grow further with the corpus.
MOST_BITS = 22
#: Groups of one shingle that are paired in one task; shingles of at least SALTED documents are not even gathered in one.
RUN, SALTED = 4_000, 100_000
PART_ROWS = 400_000
#: Rows of pairs that a worker hands over at once: the JVM holds a batch outside of its heap.
SHIPPED = 50_000
#: Members in a bin of an opened group, and queries that meet one copy of the bin.
BIN, QUERIES = 128, 256
NO_ID = -(1 << 63)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fetch(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (at: doc_id or NO_ID, and text_hash; ...) with the texts of docs; a small table of keys goes to the
    texts, a large one is shuffled."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.select(place("doc_id", "text_hash"), "text").join(F.broadcast(keys) if small else keys, "at")


def place(doc_id: str, hashed: str) -> Column:
    return F.struct(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.col(hashed).alias("hash")).alias("at")


def matrix_rows(n: int, num: int, den: int, bits: int, codes: bytes, parts: int):
    """The matrix of rows (vid, gid, text) in sorted runs: part, tokens, gids, sizes (below 0 for shingles
    that count only where the document is the larger one). Parts from `parts` on hold very common shingles,
    dealt out by the group too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(codes, np.uint8)
        for block in blocks(batches):
            grams, begins = sets_of(block, n)
            if not len(grams):
                continue
            sizes = np.diff(begins)
            doc = np.repeat(np.arange(block.n), sizes)
            ok = (digests(grams, begins)[0] == block.rows.column("vid").to_numpy(zero_copy_only=False))[doc]
            order = np.lexsort((grams, level[(grams >> np.uint64(64 - bits)).astype(np.int64)], doc))
            rank = np.arange(len(doc)) - begins[:-1][doc]
            keep = (rank < prefix_size(sizes, num, den)[doc]) & ok
            first = (rank < prefix_size(sizes, 2 * num, num + den)[doc])[keep]
            tokens, owner = grams[order][keep], doc[keep]
            gids = block.rows.column("gid").to_numpy(zero_copy_only=False)[owner]
            salts = np.exp2(level[(tokens >> np.uint64(64 - bits)).astype(np.int64)] / 8.0) // SALTED
            salted = tokens + mix(gids.view(np.uint64)) % np.maximum(salts, 1).astype(np.uint64)
            part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            part = np.where(salts >= 1, parts + (mix(salted) % np.uint64(parts)).astype(np.int64), part)
            order = np.lexsort((tokens, part))
            tokens, gids, owner, part = tokens[order], gids[order], owner[order], part[order]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(part)]
            small = np.where(first[order], sizes[owner], -sizes[owner]).astype(np.int32)
            columns = [[a[i:j].tobytes() for i, j in zip(cut, ends, strict=True)] for a in (tokens, gids, small)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["part", "tokens", "gids", "sizes"])

    return run


def extra(sizes: np.ndarray) -> np.ndarray:
    return 1 + sizes // EXTRA


def prefix_size(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.minimum(sizes, sizes - -(-num * sizes // den) + extra(sizes))


FOUND = "a long, b long, shared long, token long, low int, high int, least int"
_NONE = np.iinfo(np.int32).max


def merged(tokens: np.ndarray, gids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """token, gid, least and greatest size of its members with the token, and the least of those for which it counts
    as the smaller document's: one row a token and group, in order of token and size."""
    order = np.lexsort((gids, tokens))
    tokens, gids, sizes = tokens[order], gids[order], sizes[order]
    head = np.flatnonzero(np.r_[True, (tokens[1:] != tokens[:-1]) | (gids[1:] != gids[:-1])])
    n = np.abs(sizes)
    low, high = np.minimum.reduceat(n, head), np.maximum.reduceat(n, head)
    least = np.minimum.reduceat(np.where(sizes > 0, n, _NONE), head)
    tokens, gids = tokens[head], gids[head]
    order = np.lexsort((low, tokens))
    return tuple(x[order] for x in (tokens, gids, low, high, least))


def fitting(tokens, gids, low, high, least, num: int, den: int, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of groups in a token's run whose sizes let them link (of different sides only, where sides has some).
    Rows are as merged orders them, so a row leaves once the sizes after it are too large."""
    run = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    length = np.diff(np.r_[run, len(tokens)])
    end = np.repeat(run + length, length)
    low, high = low.astype(np.int64), high.astype(np.int64)
    at, d = np.arange(len(tokens)), 0
    while len(at):
        d += 1
        at = at[end[at] > at + d]
        at = at[den * high[at] >= num * low[at + d]]
        to = at + d
        # of two of one size, both count as the smaller
        equal = ((least[at] == high[to]) & (least[to] <= high[at])) | ((least[to] == high[at]) & (least[at] <= high[to]))
        fit = (least[at] < high[to]) | (least[to] < high[at]) | equal
        if sides is not None:
            fit &= (sides[at] == 0) | (sides[at] != sides[to])
        x, y = gids[at[fit]], gids[to[fit]]
        yield np.minimum(x, y), np.maximum(x, y)


def counted(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """a, b, shared of pairs, added up in batches, in pieces of SHIPPED rows."""

    def made() -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        yield from pieces(pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(np.diff(np.r_[head, len(a)]))], ["a", "b", "shared"]))

    found, size = [], 0
    for x, y in pairs:
        found.append((x, y))
        size += len(x)
        if size > most:
            yield from made()
            found, size = [], 0
    if found:
        yield from made()


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SHIPPED):
        yield batch.slice(at, SHIPPED)


def matrix_pairs(num: int, den: int, parts: int):
    """FOUND: for two groups (a, b), how many shingles are in the unions of both (of this part of the shingles); or, of
    shingles with over RUN groups or in a part from `parts` on, the matrix's row: a is the group, b is null."""

    def widened(batch: pa.RecordBatch) -> pa.RecordBatch:
        nulls = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([*batch.columns, *nulls], [x.split()[0] for x in FOUND.split(", ")])

    def solved(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = merged(*(np.concatenate([np.frombuffer(h[k], t) for h in held]) for k, t in enumerate((np.uint64, np.int64, np.int32))))
        run = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        length = np.diff(np.r_[run, len(rows[0])])
        large = np.repeat((length > RUN) | (part >= parts), length)
        yield from map(widened, counted(fitting(*(x[~large] for x in rows), num, den)))
        if large.any():
            tokens, gids, *rest = (x[large] for x in rows)
            yield from pieces(
                pa.RecordBatch.from_arrays(
                    [pa.array(gids), pa.nulls(len(gids), pa.int64()), pa.nulls(len(gids), pa.int64()), pa.array(tokens.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in rest)], [x.split()[0] for x in FOUND.split(", ")]
                )
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, *payload in zip(*(batch.column(c).to_pylist() for c in ("part", "tokens", "gids", "sizes")), strict=True):
                if part != now and held:
                    yield from solved(now, held)
                    held = []
                now = part
                held.append(payload)
        if held:
            yield from solved(now, held)

    return run


CELL = "token long, i long, j long, side int, gid long, low int, high int, least int"


def long_runs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, shared of the matrix's rows (token, gid, low, high, least) of common shingles: the groups of a shingle fall
    into blocks of about RUN / 2, and each pair of blocks is a cell that one task pairs."""
    sizes = staged(rows.groupBy("token").agg(F.count("*").alias("n")).select("token", F.ceil(F.col("n") / (RUN // 2)).alias("blocks")), "run-sizes")
    few = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    block = F.pmod(F.xxhash64("gid"), F.col("blocks"))
    dealt = rows.join(F.broadcast(sizes) if few else sizes, "token").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cells = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "gid", "low", "high", "least")
    return cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(tidy(cell_pairs(num, den)), "a long, b long, shared long")


def cell_pairs(num: int, den: int):
    def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        side, gid, low, high, least = (table.column(c).to_numpy() for c in ("side", "gid", "low", "high", "least"))
        # a group of a salted shingle may come in several rows
        order = np.lexsort((low, gid))
        side, gid, low, high, least = (x[order] for x in (side, gid, low, high, least))
        head = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
        low, high, least, side, gid = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head), np.minimum.reduceat(least, head), side[head], gid[head]
        order = np.argsort(low, kind="stable")
        side, gid, low, high, least = (x[order] for x in (side, gid, low, high, least))
        yield from counted(fitting(np.zeros(len(gid), np.int64), gid, low, high, least, num, den, side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("token", "i", "j")], 1)
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, np.int64)
            for i, j in zip(cut, np.r_[cut[1:], len(keys)], strict=True):
                key = tuple(keys[i])
                if key != now and held:
                    yield from solved(held)
                    held = []
                now = key
                held.append(batch.slice(i, j - i))
        if held:
            yield from solved(held)

    return run


def verified(docs: DataFrame, vertices: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of vertices whose whole sets link."""
    pairs = staged(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("vid")).union(pairs.select(F.col("b").alias("vid"))).distinct()
    sets = staged(_sets(docs, vertices, needed, n), "sets")
    full = pairs.join(sets.select(F.col("vid").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("vid").alias("b"), F.col("set").alias("set_b")), "b")
    links = staged(full.mapInArrow(tidy(linker(num, den)), "a long, b long, linked boolean").where("linked").select("a", "b"), "verified")
    unstage(sets)
    return links


def opened_links(docs: DataFrame, labelled: DataFrame, opened: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the opened pairs of groups (a, b) of which members link: each member of the smaller group
    is a query to the bins of the larger one."""
    opened = staged(opened, "opened")
    members = labelled.select("gid", "vid")
    count = labelled.groupBy("gid").agg(F.count("*").alias("members"))
    sized = opened.join(count.select(F.col("gid").alias("a"), F.col("members").alias("na")), "a").join(count.select(F.col("gid").alias("b"), F.col("members").alias("nb")), "b")
    turned = F.col("na") > F.col("nb")
    asked = sized.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("target"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("gid"), F.greatest("na", "nb").alias("members"))
    queries = asked.join(members, "gid").select("target", "gid", "vid", F.ceil(F.col("members") / BIN).alias("bins"))
    queries = staged(queries, "queries")
    targets = queries.groupBy("target").agg(F.max("bins").alias("bins"), F.ceil(F.count("*") / QUERIES).alias("copies"))
    held = targets.join(members.withColumnRenamed("gid", "target"), "target")
    bin_ = lambda column, of: F.pmod(F.xxhash64("vid", F.lit(column)), F.col(of)).cast("int").alias(column)
    every = lambda column, of: F.explode(F.sequence(F.lit(0), F.col(of).cast("int") - 1)).alias(column)
    held = held.select("target", bin_("bin", "bins"), every("copy", "copies"), F.lit(False).alias("query"), F.col("target").alias("gid"), "vid")
    queries = queries.join(targets.select("target", "copies"), "target").select("target", bin_("copy", "copies"), every("bin", "bins"), F.lit(True).alias("query"), "gid", "vid")
    rows = held.unionByName(queries)
    sets = staged(_sets(docs, labelled, rows.select("vid").distinct(), n), "opened-sets")
    full = rows.join(sets, "vid").repartition("target", "bin", "copy").sortWithinPartitions("target", "bin", "copy", "query")
    links = staged(full.select("target", "bin", "copy", "query", "gid", "set").mapInArrow(tidy(opener(num, den)), "a long, b long"), "opened-links")
    unstage(sets)
    return links


def opener(num: int, den: int):
    """Groups (a) of queries that link with a member of a bin of a target (b), once for each bin: rows come by target,
    bin and copy, members before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, joined, sets, union, owners, begins, sizes = None, set(), [], None, None, None, None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            columns = [batch.column(c).to_pylist() for c in ("target", "bin", "copy", "query", "gid")]
            for k, (*key, query, gid) in enumerate(zip(*columns, strict=True)):
                if key != now:
                    now, joined, sets, union = key, set(), [], None
                if query and gid in joined:
                    continue
                own = np.frombuffer(batch.column("set")[k].as_buffer(), np.uint64)
                if not query:
                    sets.append(own.copy())
                    continue
                if union is None:
                    if not sets:
                        continue
                    sizes = np.array([len(x) for x in sets])
                    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(tokens, kind="stable")
                    tokens, owners = tokens[order], owner[order]
                    begins = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
                    union, begins = tokens[begins], np.r_[begins, len(tokens)]
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                at = at[union[at] == own]
                if den * len(at) < num * len(own):
                    continue
                length = begins[at + 1] - begins[at]
                flat = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begins[at], length)
                common = np.bincount(owners[flat], minlength=len(sets))
                if (den * common >= num * (len(own) + sizes - common)).any():
                    joined.add(gid)
                    found[0].append(gid)
                    found[1].append(key[0])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return run


def _sets(docs: DataFrame, vertices: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """vid, set of the vertices in needed."""
    keys = vertices.join(needed, "vid").select("at", "vid")
    return fetch(docs, keys).select("vid", "text").mapInArrow(setter(n), "vid long, set binary").dropDuplicates(["vid"])


def band_pairs(vertices: DataFrame, most: int = 500) -> DataFrame:
    """Candidates (a, b): each vertex with the first of its bands' buckets, and with the one before it by
    size, in parts of about `most` vertices of a bucket. Only similar signatures pass."""
    bands = [F.struct(F.lit(k).alias("band"), F.xxhash64(*(F.get("sig", F.lit(k * BAND + i)) for i in range(BAND))).alias("key")) for k in range(MINHASHES // BAND)]
    rows = vertices.select("vid", "n_shingles", F.explode(F.array(*bands)).alias("x")).select("vid", "n_shingles", "x.band", "x.key")
    buckets = staged(rows.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("vid").alias("first")).where("members > 1"), "buckets")
    # always by plain shuffles, which can split a hot bucket; signatures are joined to the pairs only
    shared = rows.join(buckets.hint("merge"), ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("vid"), F.ceil(F.col("members") / most)))
    before = F.lag("vid").over(W.partitionBy("band", "key", "part").orderBy("n_shingles", "vid"))
    both = shared.withColumn("before", before).select(F.col("vid").alias("a"), F.explode(F.array("before", "first")).alias("b"))
    both = both.where("b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sigs = vertices.select("vid", "sig")
    both = both.join(sigs.select(F.col("vid").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("vid").alias("b"), F.col("sig").alias("y")), "b")
    alike = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda s: s)) * 2 >= MINHASHES
    return both.where(alike).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links),
    group_id (a number of the component; null for a text without words), text_hash (of the text).

    Words are runs of characters other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a document's set
    is its distinct n-word shingles, or its whole sequence if it has fewer words. Two documents link if
    den * |intersection| >= num * |union|. A null, empty or blank text has 0 shingles and is alone.
    Rows that repeat are linked by their equal sets; a null doc_id is not the smallest of others, and
    rows with one link like others (component_id is null if all of a component have none).
    Empty input: no rows. Only doc_id and text are read. Shingles and sets are told apart by 64-bit
    and 128-bit hashes.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"))
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(16 * max(1, docs.count())))))
    signed = staged(docs.mapInArrow(signer(n, bits), SIGNED), "signed")
    told = signed.where("cells is null").select("doc_id", "text_hash", "n_shingles", "s1", "s2", "sig")
    some = told.where("n_shingles > 0")
    vertices = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min(place("doc_id", "text_hash")).alias("at"), F.max("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    vertices = staged(vertices.withColumnRenamed("s1", "vid"), "vertices")

    first_links = verified(docs, vertices, band_pairs(vertices), n, num, den)
    groups = components(first_links)
    labelled = vertices.drop("sig").join(groups.withColumnRenamed("v", "vid"), "vid", "left").withColumn("gid", F.coalesce("root", "vid")).drop("root")
    labelled = staged(labelled, "groups")

    cells = signed.where("cells is not null").select("s1", "cells").repartition("s1").mapInArrow(summed_cells(bits), "s1 long, cells binary").collect()
    slices = {r["s1"]: bytes(r["cells"]) for r in cells}
    width = min(1 << bits, 1 << SLICE_BITS)
    codes = b"".join(slices.get(k, bytes(width)) for k in range((1 << bits) // width))
    total = some.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(1, math.ceil(total * (1 - num / den + 1 / EXTRA) / PART_ROWS))
    shared_codes = docs.sparkSession.sparkContext.broadcast(codes)
    rows = fetch(docs, labelled.select("at", "vid", "gid")).select("vid", "gid", "text")
    rows = rows.mapInArrow(_with_broadcast(n, num, den, bits, shared_codes, parts), "part long, tokens binary, gids binary, sizes binary")
    found = staged(rows.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(matrix_pairs(num, den, parts)), FOUND), "matrix")
    common = found.where("token is not null").select("token", F.col("a").alias("gid"), "low", "high", "least")
    found = found.where("token is null").select("a", "b", "shared")
    if not common.isEmpty():
        found = found.unionByName(long_runs(common, num, den))
    bound = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    least = labelled.groupBy("gid").agg(F.min(1 + F.floor(F.col("n_shingles") / EXTRA)).alias("l"))
    opened = bound.join(least.select(F.col("gid").alias("a"), F.col("l").alias("la")), "a").join(least.select(F.col("gid").alias("b"), F.col("l").alias("lb")), "b").where("shared >= least(la, lb)").select("a", "b")
    # a group's number is its smallest vertex, so the smallest group that a group reaches is its smallest vertex too
    final = components(opened_links(docs, labelled, opened, n, num, den))
    rooted = labelled.select("vid", "gid", "s2", F.col("doc_id").alias("least_doc")).join(final.withColumnRenamed("v", "gid"), "gid", "left").withColumn("root", F.coalesce("root", "gid")).drop("gid")
    # tables that are joined on keys of large components are written first, so that the joins can split these
    rooted = staged(rooted, "rooted")
    least_docs = staged(rooted.groupBy("root").agg(F.min("least_doc").alias("component_id")), "least-docs")
    named = staged(rooted.join(least_docs, "root").select(F.col("vid").alias("s1"), "s2", "component_id", "root"), "named")
    joined = told.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    alone = F.col("n_shingles") == 0
    return joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(~alone, F.col("root")).alias("group_id"), "text_hash")


def _with_broadcast(n, num, den, bits, shared_codes, parts):
    def run(batches):
        return matrix_rows(n, num, den, bits, shared_codes.value, parts)(batches)

    return run


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN c AS p ON p.doc_id = x JOIN c AS q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM c UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
