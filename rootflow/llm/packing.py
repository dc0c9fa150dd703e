"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

A document's ids (with its end id) are cut into pieces only where it is longer than a sequence. Full pieces
are sequences by themselves; all others are items of a bin packing problem.

Items are dealt by a hash of (doc_id, piece, length, ids) into blocks of bounded size, each a packing problem. A block
that best fit packs into as few bins as the sum of lengths needs at least is done; several islands work on the others.
A chromosome is a list of bins. Crossover injects some of the best-filled whole bins of one parent into the
other, removes the bins there that hold an injected item twice, and puts the displaced items back by best
fit, largest first; mutation dissolves some badly filled bins and puts their items back likewise. Fitness is
the mean squared fill, which favours full bins. An island is a task; after each epoch every island's elite
moves on to the next island of its block. An island stops as soon as its elite has as many bins as the sum
of lengths needs at least.

Blocks leave some poorly filled bins. Those are dissolved and their items dealt again into fewer blocks, level
by level, until one block is left, so that only the last bin of all has to be poorly filled. Where a level leaves
nearly all its items in poor bins (lengths that nothing fits), dealing them again is no use and the bins stay.

No task sees more than a block, and of that only lengths. Random choices derive from the seed, block, island and
epoch, blocks and the order in them from hashes of ids, so reruns, retried tasks and other clusters agree.

Defined results: null and empty texts are one piece, the end id; a null doc_id is a document; rows that
repeat a doc_id are separate documents with pieces of their own (also where texts are equal); an empty table gives
no pieces. Other columns are passed over.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm import tokens
from rootflow.llm.common import documents, map_batches, parts_for, prepare, release, to_binary, written
from rootflow.llm.token_file import encoded

CAPACITY = 4096
BLOCK_ITEMS = 2000
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 6
#: A bin below this fill is dissolved and its items are packed again at the next level.
POOR = 0.985
#: A level that leaves more than this part of its items in poor bins is the last.
STUCK = 0.9
SEED = 10

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Bins = list[list[int]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """Every document's pieces of at most ``capacity`` ids, from (doc_id, text)."""
    file = tokenizer or tokens.path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in encoded(batches, 1, file, end_id):
            out: list[tuple] = []
            for d, ids in zip([d for x in held for d in x.column(0).to_pylist()], texts, strict=True):
                out += [(d, k, i, min(capacity, len(ids) - i), zlib.crc32(ids[i : i + capacity].tobytes())) for k, i in enumerate(range(0, len(ids), capacity))]
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), to_binary("text").alias("text")), cut, _PIECES)


# ---- the genetic algorithm of one block -----------------------------------------------------------


def best_fit(items: list[int], size: list[int], capacity: int, bins: Bins, room: list[int]) -> None:
    """Puts items, largest first, into the open bin that they fill best, or into a new one."""
    order = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for i in sorted(items, key=lambda i: (-size[i], i)):
        s = size[i]
        at = bisect.bisect_left(order, (s, -1))
        if at < len(order):
            r, k = order.pop(at)
        else:
            r, k = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[k].append(i)
        room[k] = r - s
        if r > s:
            bisect.insort(order, (r - s, k))


def fitness(room: list[int], capacity: int) -> float:
    return sum(((capacity - r) / capacity) ** 2 for r in room) / max(1, len(room))


def _rest(bins: Bins, size: list[int], capacity: int) -> list[int]:
    return [capacity - sum(size[i] for i in b) for b in bins]


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of b go into a; a's bins that share an item with them go, and what that displaces is best-fitted."""
    room = _rest(b, size, capacity)
    best = sorted(range(len(b)), key=lambda k: (room[k], k))[: max(1, len(b) // 2)]
    chosen = rng.sample(best, max(1, len(best) // 2))
    taken = {i for k in chosen for i in b[k]}
    child, displaced = [list(b[k]) for k in chosen], []
    for x in a:
        if taken.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    best_fit(displaced, size, capacity, child, _rest(child, size, capacity))
    return child


def mutate(a: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Some bins, poorly filled ones first of all, are dissolved and their items best-fitted after a shuffle of equals."""
    room = _rest(a, size, capacity)
    worst = sorted(range(len(a)), key=lambda k: (-room[k], k))
    gone = set(worst[: max(1, len(a) // 20)]) | set(rng.sample(range(len(a)), max(1, len(a) // 20)))
    child = [list(x) for k, x in enumerate(a) if k not in gone]
    items = [i for k in gone for i in a[k]]
    best_fit(items, size, capacity, child, _rest(child, size, capacity))
    return child


def first_fill(size: list[int], capacity: int, rng: random.Random, noise: float) -> Bins:
    """Best fit, by sizes that are disturbed a little so that chromosomes differ."""
    bins: Bins = []
    room: list[int] = []
    if noise == 0:
        best_fit(list(range(len(size))), size, capacity, bins, room)
        return bins
    items = sorted(range(len(size)), key=lambda i: -size[i] * (1 + noise * rng.random()))
    order: list[tuple[int, int]] = []
    for i in items:
        at = bisect.bisect_left(order, (size[i], -1))
        r, k = order.pop(at) if at < len(order) else (capacity, len(bins))
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
        if r > size[i]:
            bisect.insort(order, (r - size[i], k))
    return bins


def evolve(size: list[int], capacity: int, population: list[Bins], generations: int, rng: random.Random) -> list[Bins]:
    """The population after some generations, best first. Stops early at the lower bound of bins."""
    least = -(-sum(size) // capacity)
    rank = lambda c: (len(c), -fitness(_rest(c, size, capacity), capacity))
    population = sorted(population, key=rank)
    for _ in range(generations):
        if len(population[0]) <= least:
            break
        keep = population[: max(2, len(population) // 2)]
        children = []
        while len(keep) + len(children) < max(4, len(population)):
            a, b = (rng.sample(keep, 2) + keep)[:2] if len(keep) > 1 else (keep[0], keep[0])
            child = crossover(a, b, size, capacity, rng)
            children.append(mutate(child, size, capacity, rng) if rng.random() < 0.5 else child)
        population = sorted(keep + children, key=rank)
    return population


def _flat(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(flat: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        out[k].append(i)
    return out


_ISLAND = "block long, island int, items array<long>, sizes array<int>, elite array<int>, done boolean"
_TYPES = {"block": pa.int64(), "island": pa.int32(), "items": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "elite": pa.list_(pa.int32()), "done": pa.bool_()}


def _state(block: int, island: int, items: list[int], size: list[int], elite: Bins, least: int) -> pa.Table:
    row = (block, island, items, size, _flat(elite, len(size)), len(elite) <= least)
    release()
    return pa.table({name: pa.array([x], t) for x, (name, t) in zip(row, _TYPES.items(), strict=True)})


def _first(capacity: int):
    """A block's items (block, item, length, order, copy): best fit alone."""

    def run(rows: pa.Table) -> pa.Table:
        length, order, copy = (rows[c].to_numpy() for c in ("length", "order", "copy"))
        at = np.lexsort((copy, order, -length))
        size = length[at].tolist()
        return _state(rows["block"][0].as_py(), 0, rows["item"].to_numpy()[at].tolist(), size, first_fill(size, capacity, random.Random(0), 0.0), -(-sum(size) // capacity))

    return run


def _epoch(capacity: int, seed: int, population: int, generations: int, epoch: int):
    """An island with its own elite and, from the second epoch on, its neighbour's."""

    def run(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: -r["native"])
        row = found[0]
        block, island, size = row["block"], row["island"], row["sizes"]
        rng, least = random.Random(f"{seed} {block} {island} {epoch}"), -(-sum(size) // capacity)
        elites = [_bins(r["elite"]) for r in found]
        best = min(elites, key=len)
        if len(best) > least:
            if epoch:
                some = elites + [mutate(elites[k % len(elites)], size, capacity, rng) for k in range(population - len(elites))]
            else:
                some = [best, *(first_fill(size, capacity, rng, 0.1 * (1 + island) * (k + 1) / population) for k in range(population - 1))]
            best = evolve(size, capacity, some, generations, rng)[0]
        return _state(block, island, row["items"], size, best, least)

    return run


def _pack_level(items: DataFrame, level: int, rows: int, blocks: int, capacity: int, seed: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """Rows (item, block, bin, length) of all items; bin numbers count within a block."""
    n = parts_for(items, rows)
    prepare(items.sparkSession)
    dealt = items.select("item", "length", "order", "copy", F.pmod(F.xxhash64(F.lit(seed + level), "order", "copy"), F.lit(blocks)).alias("block"))
    state = written(dealt.repartition(n, "block").groupBy("block").applyInArrow(_first(capacity), _ISLAND), f"pack-{level}-first")
    parts = [state.where("done")]
    going = state.where("not done").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("native", F.lit(1))
    for epoch in range(epochs):
        if going.isEmpty():
            break
        moved = going.repartition(n, "block", "island").groupBy("block", "island").applyInArrow(_epoch(capacity, seed, population, generations, epoch), _ISLAND)
        state = written(moved, f"pack-{level}-{epoch}")
        # Blocks whose elite meets the bound are done; in the others each elite also visits the next island.
        settled = state.groupBy("block").agg(F.max("done").alias("settled"))
        told = state.join(settled, "block")
        parts.append((told.where("settled") if epoch < epochs - 1 else told).drop("settled"))
        open_ = told.where("not settled").drop("settled").withColumn("native", F.lit(1))
        going = open_.unionByName(open_.withColumn("island", ((F.col("island") + 1) % islands).cast("int")).withColumn("native", F.lit(0)))
    state = parts[0]
    for x in parts[1:]:
        state = state.unionByName(x)
    ranked = state.select("block", F.struct(F.array_max("elite").alias("bins"), "island").alias("rank"), "items", "sizes", "elite")
    best = ranked.groupBy("block").agg(F.min("rank").alias("rank"))
    won = ranked.join(best, ["block", "rank"])
    return won.select("block", F.explode(F.arrays_zip("items", "sizes", "elite")).alias("x")).select(F.col("x.items").alias("item"), "block", F.col("x.elite").alias("bin"), F.col("x.sizes").cast("long").alias("length"))


def pack(found: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, poor: float = POOR, seed: int = SEED) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    # Pieces are dealt and ordered by a hash of what they are; only equal ones are told apart by number. The written
    # table fixes ``item``, which names a piece within this run and decides nothing.
    order = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    copy = F.row_number().over(Window.partitionBy("order").orderBy("doc_id", "piece", "length", "ids_crc32"))
    found = written(found.withColumn("order", order).withColumn("copy", copy).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    if found.where(F.col("length") > capacity).limit(1).count():
        raise ValueError("a piece is longer than a sequence")
    items, level, done = found.where(F.col("length") < capacity).select("item", "length", "order", "copy"), 0, []
    left, before = items.count(), 0  # blocks of the levels before
    width = 1 << (4 * block_items).bit_length()  # more than a block has bins
    while left:
        blocks = max(1, -(-left // block_items))
        packed = written(_pack_level(items, level, left, blocks, capacity, seed, islands, epochs, generations, population), f"pack-level-{level}")
        if blocks == 1:
            done.append((before, packed.select("item", "block", "bin")))
            break
        fill = packed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        marked = written(packed.join(fill, ["block", "bin"]).withColumn("stays", F.col("fill") >= F.lit(poor * capacity)), f"pack-marked-{level}")
        poor_items = marked.where(~F.col("stays")).count()
        if poor_items > STUCK * left:
            done.append((before, marked.select("item", "block", "bin")))
            break
        done.append((before, marked.where("stays").select("item", "block", "bin")))
        again = marked.where(~F.col("stays")).select("item", "length")
        items = again.join(found.select("item", "order", "copy"), "item") if poor_items else items
        level, left, before = level + 1, poor_items, before + blocks
    placed = None
    for k, d in done:
        # A sequence's number holds its block, counted over all levels, and bin.
        number = (F.lit(k) + F.col("block")) * F.lit(width) + F.col("bin")
        d = d.select(F.col("item").alias("of"), number.alias("sequence_id"))
        placed = d if placed is None else placed.unionByName(d)
    if placed is None:
        placed = found.sparkSession.createDataFrame([], "of long, sequence_id long")
    joined = found.join(placed, found["item"] == placed["of"], "left").withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("item")))
    earlier = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "order", "copy").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("of", "item", "order", "copy")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
