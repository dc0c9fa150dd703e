"""MinHash near-duplicate groups by an LSH forest, confirmed on full shingle sets.

Signatures. A document's distinct k-word shingles (hashed to 64 bits) give ``HASHES`` minimum hashes, of which 16
mixed bits each are kept: a minimum's high bits run to zero as sets grow, mixed ones don't. Documents with equal
shingle sets are one class from here on, told by 128 bits of a hash of the set; an aggregation finds the classes,
so thousands of exact copies weigh as one.

Forest. Each of ``TREES`` trees has an order of minimum hashes of its own and sorts the classes by it. Classes that
share a tree's first ``MIN_PREFIX`` hashes are a region. Neighbours in the sorted order are read from the longest
common prefix up: runs that share ``DEPTH`` hashes first, then shorter prefixes, and at each depth a class is
compared with those of its run that it isn't connected with yet. So depth adapts to the region: a dense one is
connected at its deep prefixes and has nothing left to compare further up, a sparse one goes up to ``MIN_PREFIX``. Every
pair of a region is either compared or already connected. A pair at similarity 0.8 shares 3 hashes in one tree with
probability 0.51, and in none of 24 trees with 3e-8.

A region of more than ``BLOCK`` classes is dealt into blocks by a hash of the class, and each pair of blocks is a
group of rows of its own: every pair of the region still meets, and no task gets more than two blocks at once.

Candidates. Compared are 4 bits of all minimum hashes; a pair passes if the estimated similarity is at least
``PASS`` (some five standard errors below 0.8). Only pairs that connect something are emitted: of n classes in a
region n - 1 at most, however dense it is. What hangs together by passing pairs is a candidate group; two classes
of different candidate groups are in no case linked.

Confirmation. The texts of a candidate group's classes, each read once, meet in one task, which finds the groups
of links ``100 * common >= 80 * union`` on full sets by search from class to class: a class is counted
against those that no group has yet. No pairs are written. A candidate group of more than ``BLOCK_SHINGLES`` shingles
is dealt into blocks like a region, and what the pairs of blocks link is merged by alternating large and
small stars (connected components in a logarithmic number of rounds), each round a written table. Neither candidates
nor links nor groups visit the driver, and nothing is broadcast but what Spark itself measures as small.

Cost. Work is linear but for large groups that don't hang together by links: n classes of one template, all of
them similar to 0.6 or more but not linked, are n * n / 2 counts of common shingles, in memory; rows and
shuffles grow with n times the number of blocks.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with nothing;
a text of fewer than k words has its word sequence as its one shingle; a null doc_id is a row like others but
never names a group that has an id; rows that repeat a doc_id are told apart by their texts; an empty table
gives an empty result. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm.common import documents, map_batches, mix, parts_by_size, parts_for, shingle_sets, to_binary, written

TREES = 24
MIN_PREFIX = 3
DEPTH = 7
HASHES = 128
#: Classes of a region that are compared as one group; larger regions are compared block by block.
BLOCK = 2048
#: Shingles of a candidate group that are compared at a time; larger groups are compared block by block.
BLOCK_SHINGLES = 1 << 20
#: Forest rows that a worker compares at a time, besides those of a region that goes on.
HELD_ROWS = 1 << 14
PASS = 0.61
SEED = 3


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix(np.arange(2 * HASHES, dtype=np.uint64) + np.uint64(SEED << 32))
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 mixed bits of each minimum hash (64 bits) of a set of 64-bit hashes."""
    a, b = _coefficients()
    least = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), 2048):
        h = hashes[i : i + 2048, None] * a[None, :] + b[None, :]
        np.minimum(least, h.min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, hash, sig) of (doc_id, text); hash and signature are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hashes, sigs = [], [], []
            for h in shingle_sets(b.column(2), k):
                n.append(len(h))
                hashes.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                sigs.append(signature(h).astype(">u2").tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "n_shingles", "hash", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), to_binary("text").alias("text"))
    return map_batches(rows, run, "doc_id long, text_key long, n_shingles long, hash binary, sig binary")


def tree_hashes() -> np.ndarray:
    """Each tree's order of minimum hashes: ``MIN_PREFIX`` that no other tree begins with, then others."""
    rng = np.random.default_rng(SEED)
    first = rng.permutation(HASHES)[: TREES * MIN_PREFIX].reshape(TREES, MIN_PREFIX)
    rest = [rng.permutation(np.setdiff1d(np.arange(HASHES), f))[: DEPTH - MIN_PREFIX] for f in first]
    return np.concatenate([first, np.array(rest).reshape(TREES, -1)], axis=1)


#: A forest row: the hashes that order its region, class, set size, 4 bits of all hashes.
_ROW = np.dtype([("deep", ">u2", (DEPTH - MIN_PREFIX,)), ("cls", ">i8"), ("n", ">u4"), ("low", "u1", (HASHES // 2,))])


def _regions_of(sig: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The region in each tree (signatures x trees) as one number: tree and hashes."""
    h = sig.view(">u2")[:, :, 0].astype(np.uint64)[:, used]
    out = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(sig), TREES)).copy()
    for i in range(MIN_PREFIX):
        out = (out << np.uint64(16)) | h[:, :, i]
    return out.astype(np.int64)


def _signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES, 2)


def _count_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    used = tree_hashes()
    for b in batches:
        region, n = np.unique(_regions_of(_signatures_of(b.column(0)), used), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(n.astype(np.int64))], ["region", "n"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest rows of classes (cls, n, sig), one for each tree."""
    used = tree_hashes()
    for b in batches:
        if not b.num_rows:
            continue
        sig = _signatures_of(b.column(2))
        nibble = sig[:, :, 1] & 15
        rows = np.zeros(len(sig), _ROW)
        rows["cls"], rows["n"] = b.column(0).to_numpy(), b.column(1).to_numpy()
        rows["low"] = nibble[:, 0::2] | (nibble[:, 1::2] << 4)
        regions, h = _regions_of(sig, used), sig.view(">u2")[:, :, 0]
        for t in range(TREES):
            rows["deep"] = h[:, used[t, MIN_PREFIX:]]
            at = np.arange(len(rows) + 1, dtype=np.int32) * _ROW.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(regions[:, t]), b.column(0), packed], ["region", "cls", "row"])


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The estimated similarity of rows of packed 4-bit hashes, 16 in a number."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    same = HASHES - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    return (same / HASHES - 1 / 16) / (1 - 1 / 16)


def _runs(first: np.ndarray) -> np.ndarray:
    """For each row the number of rows before it in its run; ``first`` marks where runs begin."""
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def connecting(keys: np.ndarray, sides: np.ndarray, within: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that pass and connect something, from sorted forest rows; equal keys are a group of rows.

    The longest common prefixes come first. Of two blocks (``within`` false) only pairs across count."""
    n, lows, sizes = len(rows), np.ascontiguousarray(rows["low"]).view(np.uint64), rows["n"].astype(np.int64)
    up = np.arange(n)
    left, right = [], []
    changed = np.concatenate([[True], keys[1:] != keys[:-1]])
    # Where the common prefix with the row before ends: MIN_PREFIX for the same region, less for another one.
    differ = np.concatenate([np.ones((1, DEPTH - MIN_PREFIX), bool), rows["deep"][1:] != rows["deep"][:-1]])
    depth = np.where(changed, 0, MIN_PREFIX + np.where(differ.any(axis=1), differ.argmax(axis=1), DEPTH - MIN_PREFIX))
    deeper = np.zeros(n, np.int64)  # rows before this one in its run at the last depth, which are done
    for d in range(DEPTH, MIN_PREFIX - 1, -1):
        since = _runs(depth < d)
        for back in range(1, int(since.max(initial=0)) + 1):
            at = np.flatnonzero((since >= back) & (deeper < back))
            to = at - back
            some = (100 * np.minimum(sizes[at], sizes[to]) >= 80 * np.maximum(sizes[at], sizes[to])) & (up[at] != up[to]) & (within[at] | (sides[at] != sides[to]))
            at, to = at[some], to[some]
            if not len(at):
                continue
            some = _equal(lows[at], lows[to]) >= threshold
            joined = False
            for x, y in zip(at[some].tolist(), to[some].tolist(), strict=True):
                a, b = x, y
                while up[a] != a:
                    a = int(up[a])
                while up[b] != b:
                    b = int(up[b])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    left.append(x)
                    right.append(y)
                    joined = True
            while joined and (up[up] != up).any():
                up = up[up]
        deeper = since
    return np.array(left, np.int64), np.array(right, np.int64)


def _neighbours(threshold: float):
    """Streams forest rows in order (region, lo, hi, side, row) and gives the connecting pairs of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def pairs(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            region, lo, hi, side, rows = (np.concatenate(c) for c in zip(*held, strict=True))
            first = np.concatenate([[True], (region[1:] != region[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            end = len(rows) if last else int(np.flatnonzero(first)[-1])  # the last group may go on
            held, n = ([] if last else [tuple(x[end:].copy() for x in (region, lo, hi, side, rows))]), len(rows) - end
            key = np.cumsum(first[:end])
            # Rows alone in their group have no partner.
            some = np.bincount(key, minlength=2)[key] > 1 if end else np.zeros(0, bool)
            if some.any():
                rows = rows[:end][some]
                x, y = connecting(key[some], side[:end][some], (lo == hi)[:end][some], rows, threshold)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(rows["cls"][x].astype(np.int64)), pa.array(rows["cls"][y].astype(np.int64))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(4).to_pylist()), _ROW)))
            n += b.num_rows
            if n >= HELD_ROWS:
                yield from pairs(False)
        if held:
            yield from pairs(True)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Adds lo, hi and side to rows with (cls, blocks): a row for each block that the class's own block meets."""
    own, other = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    met = rows.withColumn("own", own).withColumn("other", other)
    return met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("side", F.col("own") > F.col("other"))


def candidates(classes: DataFrame, threshold: float = PASS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of classes (cls, n, sig) that connect all pairs that pass, of any region."""
    total = classes.count()
    forest = map_batches(classes.select("cls", "n", "sig"), _trees, "region long, cls long, row binary").withColumn("blocks", F.lit(1).cast("long"))
    if total > block:
        counted = map_batches(classes.select("sig"), _count_regions, "region long, n long").groupBy("region").agg(F.sum("n").alias("n"))
        large = written(counted.where(F.col("n") > block).select(F.col("region").alias("of"), F.ceil(F.col("n") / block).alias("many")), "large-regions")
        if not large.isEmpty():
            # Spark broadcasts the large regions if they are few, and shuffles else.
            forest = forest.join(large, forest["region"] == large["of"], "left").withColumn("blocks", F.coalesce("many", "blocks"))
    n = parts_for(classes, TREES * total)
    ordered = _dealt(forest).select("region", "lo", "hi", "side", "row").repartition(n, "region", "lo", "hi").sortWithinPartitions("region", "lo", "hi", "row")
    return map_batches(ordered, _neighbours(threshold), "a long, b long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) of all nodes of the links (a, b); the label is the component's smallest node."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large-star")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = written(large, "large")
        low = written(large.groupBy("b").agg(F.min("a").alias("m")), "small-star")
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = written(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "small")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


# ---- confirmation on full sets --------------------------------------------------------------------


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first one of its group of links; with sides, only links across count."""
    m, n = len(sets), np.array([len(x) for x in sets], np.int64)
    out = np.arange(m)
    if m < 2:
        return out
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    starts = np.cumsum(n) - n
    mark = np.zeros(int(ids.max()) + 1, bool)
    free, flat, at = np.arange(m), ids, starts  # the sets that no group has yet, and their shingles

    def less(gone: np.ndarray) -> None:
        nonlocal free, flat, at
        flat = flat[np.repeat(~gone, n[free])]
        free = free[~gone]
        at = np.cumsum(n[free]) - n[free]

    while len(free) > 1:
        root = int(free[0])
        queue = [root]
        less(free == root)
        while queue and len(free):
            x = queue.pop()
            own = ids[starts[x] : starts[x] + n[x]]
            mark[own] = True
            common = np.add.reduceat(mark[flat], at, dtype=np.int64)
            mark[own] = False
            hit = 100 * common >= percent * (n[x] + n[free] - common)
            if side is not None:
                hit &= side[free] != side[x]
            if hit.any():
                new = free[hit]
                out[new] = root
                queue += new.tolist()
                less(hit)
    return out


def _link(k: int, percent: int):
    """Streams rows (grp, lo, hi, whole, side, cls, text) in order; for each linked class a row (a, b, whole): b is linked with a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, classes, sides = None, [], [], []
        out: list[tuple[int, int, bool]] = []

        def close() -> None:
            root = linked(sets, percent, None if key[1] == key[2] else np.array(sides))
            out.extend((classes[r], classes[i], key[3]) for i, r in enumerate(root.tolist()) if r != i)

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "whole"])
            out.clear()
            return done

        for b in batches:
            for now, h in zip(zip(*(c.to_pylist() for c in b.columns[:6]), strict=True), shingle_sets(b.column(6), k), strict=True):
                if now[:4] != key:
                    if key is not None:
                        close()
                    key, sets, classes, sides = now[:4], [], [], []
                if len(h) and (not classes or classes[-1] != now[5]):  # rows that repeat a document stand together
                    sets.append(h)
                    classes.append(now[5])
                    sides.append(now[4])
            if len(out) >= 1024:
                yield batch()
        if key is not None:
            close()
        if out:
            yield batch()

    return run


def _keys(doc_id: Column, text_key: Column) -> list[Column]:
    """Join keys that tell documents apart, null ids too."""
    return [F.coalesce(doc_id, F.lit(0)).cast("long").alias("k_id"), doc_id.isNull().alias("k_null"), text_key.alias("k_text")]


_KEYS = ["k_id", "k_null", "k_text"]


def links(docs: DataFrame, classes: DataFrame, grouped: DataFrame, k: int, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (node, label) of the classes that links join, from candidate groups (node, label) of classes (cls, n, first)."""
    members = classes.join(grouped, classes["cls"] == grouped["node"]).select("cls", "n", "first", F.col("label").alias("grp"))
    members = written(members, "candidate-groups")
    large = members.groupBy("grp").agg(F.sum("n").alias("total")).where(F.col("total") > block).select(F.col("grp").alias("of"), F.ceil(F.col("total") / block).alias("many"))
    sized = members.join(large, members["grp"] == large["of"], "left").select(*_keys(F.col("first.doc_id"), F.col("first.text_key")), "grp", "cls", F.coalesce("many", F.lit(1)).cast("long").alias("blocks"))
    # The list of classes grows with the corpus, so it is never broadcast.
    texts = docs.select(*_keys(F.col("doc_id"), _text_key()), to_binary("text").alias("text"))
    rows = _dealt(texts.join(sized.hint("merge"), _KEYS))
    rows = rows.select("grp", "lo", "hi", (F.col("blocks") == 1).alias("whole"), "side", "cls", "text")
    ordered = rows.repartition(parts_by_size(docs), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "cls")
    found = written(map_batches(ordered, _link(k, percent), "a long, b long, whole boolean"), "links")
    labels = found.where("whole").select(F.col("b").alias("node"), F.col("a").alias("label"))
    parts = found.where("not whole").select("a", "b")
    return labels if parts.isEmpty() else labels.unionByName(components(parts))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, component_id, kept, first), one for each row of (doc_id, text).

    ``first``: whether this is the group's smallest doc_id and, of several texts with that id, the one with the
    smallest hash; rows that repeat it are all first, as are all rows without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = written(signatures(docs, k), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = sigs.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min(place).alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    # The written table fixes the numbers of classes.
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    grouped = written(components(candidates(classes)), "candidates")
    labels = written(links(docs, classes, grouped, k, percent), "labels")

    named = classes.select("hash", "first", "cls").join(labels, classes["cls"] == labels["node"], "left").select("hash", "first", F.coalesce("label", "cls").alias("label"))
    named = written(named, "named")
    winners = named.groupBy("label").agg(F.min("first").alias("winner"))
    own = written(named.join(winners, "label").select(F.col("hash").alias("of"), "winner"), "class-groups")
    out = sigs.join(own, sigs["hash"] == own["of"], "left")
    alone = F.col("of").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("winner.doc_id"))
    first = alone | (F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("text_key") == F.col("winner.text_key")))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, less near copies: one row of each group stays, the first one.

    Rows are told apart by doc_id and text; of equal rows one stays. Rows without shingles all stay."""
    groups = near_groups(docs, k, percent)
    decided = groups.select(*_keys(F.col("doc_id"), F.col("text_key")), "first", (F.col("n_shingles") == 0).alias("empty")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(F.col("doc_id").cast("long"), _text_key()))
    again = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(*_KEYS))
    kept = rows.join(decided.hint("merge"), _KEYS).where("first").withColumn("again", again).where("empty or again = 1")
    return kept.select("row.*")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), k=2).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = """
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM lowered
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
