"""Approximate nearest neighbours by randomly rotated one-bit codes.

Copies. Vectors that are equal in all components are one class: of a class only the ``k + 1`` smallest vec_ids can be
in anyone's result, so no more go on, and queries with equal vectors are searched once. A vector that a third of all
rows repeat weighs as one.

Index. Classes are assigned to the nearest of about as many centroids as the root of their number (k-means on a
bounded sample). What is left after subtracting the centroid is rotated by a fixed random rotation, and only the sign
of each coordinate is kept, packed to bits, with two correction scalars: the residual's length, and the inner product
of the normalised residual with its own code, which tells how well the code stands for it. Every class is indexed; the
index is a written table.

Search. In a cell the inner product of query and residual is estimated from the packed bits and divided by the code's
own inner product, which makes it unbiased; its error is within ``EPSILON * sqrt((1 - s^2) / s^2) / sqrt(d - 1)`` with
high probability. The ``k + 1`` likeliest get exact distances, the last of them is the limit, and reranked is what has a
lower bound within it (``scan``). A query visits its nearest cell first; the distance that it has found there goes along as
the limit to all other cells, so these mostly scan codes and read few vectors. Cells whose every vector is further
away than the limit (by the triangle inequality) are not visited. The number of cells to visit comes from the
sample: as many as hold ``CELL_RECALL`` of the sample's own nearest neighbours, so clustered vectors need few and vectors without
clusters need many.

Distribution. Cells are dealt to tasks in parts of ``CELL_ROWS`` classes by ``ASK_ROWS`` queries, by hashes of their
ids. Each returns at most k + 1 rows per query. Only centroids, radii and numbers of parts (``MAX_CELLS`` rows) go to all.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, neither as queries nor as candidates; equal distances rank by smaller vec_id; a null vec_id takes
no part; rows that repeat a vec_id are candidates each (never of their own id), and the query of that id is the least
of its vectors; with no vectors the result is empty. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm.common import map_batches, parts_for, prepare, release, written

K = 10
MAX_CELLS = 4096
SAMPLE = 16384
CELL_ROWS = 16384
ASK_ROWS = 4096
#: Queries whose bounds are computed at a time.
ASKS = 64
EPSILON = 1.9
#: Part of the sample's nearest neighbours that the visited cells hold, and queries of the sample it is measured with.
CELL_RECALL = 0.98
MEASURED = 400
MIN_PROBES = 8
SEED = 5


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v array<double>) that take part."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0.0))


def centroids_of(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """k-means; an empty cell takes a random vector again."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, c, 1)[:, 0]
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        total = np.zeros_like(c)
        total[n > 0] = np.add.reduceat(sample[order], (np.cumsum(n) - n)[n > 0], axis=0)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], sample[rng.integers(len(sample), size=len(c))])
    return c


def nearest_cells(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    d = (c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T)
    if n == 1:
        return d.argmin(axis=1)[:, None]
    n = min(n, len(c))
    at = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1), axis=1)


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float = CELL_RECALL, seed: int = SEED) -> int:
    """Nearest cells that hold the given part of the k nearest neighbours within the sample."""
    if len(sample) < 2:
        return len(centres)
    some = np.random.default_rng(seed).permutation(len(sample))[:MEASURED]
    rank = np.argsort(nearest_cells(sample[some], centres, len(centres)), axis=1)  # of each cell, for each query
    own = nearest_cells(sample, centres, 1)[:, 0]
    norms, k = (sample * sample).sum(axis=1), min(k, len(sample) - 1)
    ranks = []
    for i, at in enumerate(some.tolist()):
        d = norms - 2.0 * (sample @ sample[at])
        d[at] = np.inf
        ranks.append(rank[i, own[np.argpartition(d, k - 1)[:k]]])
    return min(len(centres), max(MIN_PROBES, int(np.quantile(np.concatenate(ranks), recall)) + 1))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, the residuals' lengths, and each unit residual's inner product with its code."""
    r = x - centre
    length = np.linalg.norm(r, axis=1)
    o = (r / np.where(length > 0, length, 1.0)[:, None]) @ turn
    return np.packbits(o > 0, axis=1, bitorder="little"), length, np.abs(o).sum(axis=1) / np.sqrt(x.shape[1])


def bounds(q: np.ndarray, centre: np.ndarray, turn: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries x vectors) of squared distances, from codes and correction scalars."""
    d = q.shape[1]
    r = q - centre
    n = np.linalg.norm(r, axis=1)
    u = (r / np.where(n > 0, n, 1.0)[:, None]) @ turn
    bits = np.unpackbits(codes, axis=1, count=d, bitorder="little").astype(np.float32)
    # <u, code> with code = (2 bits - 1) / sqrt(d)
    inner = (2.0 * (u.astype(np.float32) @ bits.T) - u.sum(axis=1)[:, None]) / np.sqrt(d)
    s = np.maximum(own, 1e-9)[None, :]
    estimate = inner / s
    error = epsilon * np.sqrt(np.maximum(0.0, 1.0 - s * s)) / s / np.sqrt(max(1, d - 1))
    base, scale = n[:, None] ** 2 + length[None, :] ** 2, 2.0 * n[:, None] * length[None, :]
    return base - scale * (estimate + error), base - scale * (estimate - error)


def scan(q: np.ndarray, limit: float, low: np.ndarray, high: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and exact distances of vectors within the limit, the k nearest among them, and how many were read.

    ``limit`` is a distance that the result has to be within, as told by other cells."""
    k = min(k, len(x))
    likely = np.argpartition(low + high, k - 1)[:k]
    exact = np.sqrt(((x[likely] - q) ** 2).sum(axis=1))
    limit = min(limit, float(exact.max()))
    rest = np.flatnonzero(low <= limit * limit * (1 + 1e-9) + 1e-12)
    rest = np.setdiff1d(rest, likely, assume_unique=True)
    at = np.concatenate([likely, rest])
    dist = np.concatenate([exact, np.sqrt(((x[rest] - q) ** 2).sum(axis=1))])
    near = dist <= limit
    return at[near], dist[near], len(at)


_FOUND = "ask long, vec_id long, score double"


def _search(centres: np.ndarray, turn: np.ndarray, k: int, epsilon: float):
    """One part of a cell with one part of its queries: rows of kind 0 are classes with codes, of kind 1 queries."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        order = np.lexsort((rows["uid"].to_numpy(), kind))
        n, d = int((kind == 0).sum()), centres.shape[1]
        rows = rows.take(pa.array(order)).combine_chunks()
        data, asks = rows.slice(0, n), rows.slice(n)
        out: list[tuple[int, int, float]] = []
        if len(data) and len(asks):
            vectors = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), d)
            x, q, centre = vectors(data), vectors(asks), centres[rows["cell"][0].as_py()]
            ids, codes = data["ids"].to_pylist(), np.frombuffer(b"".join(data["code"].to_pylist()), np.uint8).reshape(n, -1)
            length, own = data["length"].to_numpy(), data["own"].to_numpy()
            limits, names = asks["bound"].to_numpy(), asks["uid"].to_pylist()
            for a in range(0, len(asks), ASKS):
                low, high = bounds(q[a : a + ASKS], centre, turn, codes, length, own, epsilon)
                for i in range(len(low)):
                    at, dist, _ = scan(q[a + i], float(limits[a + i]), low[i], high[i], x, k)
                    found = sorted((s, v) for j, s in zip(at.tolist(), dist.tolist(), strict=True) for v in ids[j])[:k]
                    out += [(names[a + i], v, s) for s, v in found]
        release()
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["ask", "vec_id", "score"])

    return run


def _probe(centres: np.ndarray, radii: np.ndarray, first: int, probes: int):
    """A query's cells from the first on that can hold something within its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cells = nearest_cells(x, centres, probes)[:, first:]
            away = np.linalg.norm(x[:, None] - centres[cells], axis=2) if cells.size else np.zeros(cells.shape)
            near = away - radii[cells] <= b.column(2).to_numpy()[:, None] * (1 + 1e-9) + 1e-9
            out = [c[k].tolist() for c, k in zip(cells.astype(np.int32), near, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], ["uid", "v", "bound", "cells"])

    return run


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """Rows (uid, h1, h2, v, ids): each distinct vector with its k + 1 smallest vec_ids."""
    hashed = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = hashed.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    one = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    return written(one.withColumn("uid", F.monotonically_increasing_id()), "ann-classes")


def search(vectors: DataFrame, is_query, k: int = K, epsilon: float = EPSILON, probes: int | None = None, seed: int = SEED) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the vectors that the condition picks as queries."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(usable(vectors), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = lengths[0]["d"]
    rows = rows.where(F.size("v") == d)
    classes = classes_of(rows, k)
    total = classes.count()
    share = min(1.0, 1.2 * SAMPLE / total)
    place = F.xxhash64(F.lit(seed), "h1", "h2")
    sample = classes.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(place, "h1").limit(SAMPLE).select("v").collect()
    sample = np.array([r["v"] for r in (sample or classes.orderBy("h1", "h2").limit(SAMPLE).select("v").collect())])
    centres = centroids_of(sample, int(np.clip(np.sqrt(total), 1, MAX_CELLS)), seed=seed)
    probes = min(len(centres), probes or probes_for(sample, centres, k, seed=seed))
    turn = rotation(d, seed)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            own = nearest_cells(x, centres, 1)[:, 0]
            codes, length, inner = encode(x, centres[own], turn)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(inner)], ["uid", "v", "ids", "cell", "code", "length", "own"])

    indexed = written(map_batches(classes.select("uid", "v", "ids"), index, "uid long, v array<double>, ids array<long>, cell int, code binary, length double, own double"), "ann-index")
    cells = written(indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts"), F.max("length").alias("radius")), "ann-cells")  # MAX_CELLS rows at most
    radii = np.full(len(centres), -np.inf)  # an empty cell is further away than anything
    for r in cells.collect():
        radii[r["cell"]] = r["radius"]

    named = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    named = written(named.join(classes.select("h1", "h2", "uid"), ["h1", "h2"]).select("query_id", "uid"), "ann-queries")
    asked = classes.join(named.select("uid").distinct(), "uid", "left_semi").select("uid", "v", F.lit(float("inf")).alias("bound"))

    def visit(asks: DataFrame, first: int, most: int) -> DataFrame:
        told = map_batches(asks, _probe(centres, radii, first, most), "uid long, v array<double>, bound double, cells array<int>").withColumn("cell", F.explode("cells"))
        told = written(told.select("uid", "v", "bound", "cell"), "ann-asks")
        chunks = told.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("int").alias("chunks")).join(cells.select("cell", "parts"), "cell")  # MAX_CELLS rows at most
        part, chunk = F.col("parts"), F.col("chunks")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        dealt = indexed.join(F.broadcast(chunks), "cell").withColumn("part", F.pmod(F.xxhash64("uid"), part)).withColumn("chunk", every(chunk))
        data = dealt.select("cell", F.col("part").cast("int").alias("part"), "chunk", F.lit(0).alias("kind"), "uid", "v", "ids", "code", "length", "own", F.lit(0.0).alias("bound"))
        dealt = told.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("uid"), chunk)).withColumn("part", every(part))
        none = {"ids": "array<long>", "code": "binary", "length": "double", "own": "double"}
        dealt = dealt.select("cell", F.col("part").cast("int").alias("part"), F.col("chunk").cast("int").alias("chunk"), F.lit(1).alias("kind"), "uid", "v", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "bound")
        n = parts_for(rows, total // 4)
        groups = data.unionByName(dealt).repartition(n, "cell", "part", "chunk").groupBy("cell", "part", "chunk")
        return written(groups.applyInArrow(_search(centres, turn, k + 1, epsilon), _FOUND), "ann-found")

    near = visit(asked, 0, 1)
    found = near
    if probes > 1:
        limit = near.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score")).alias("scores"))  # parts of a cell give k + 1 rows each
        limit = limit.select(F.col("ask").alias("uid"), F.when(F.col("n") > k, F.element_at("scores", k + 1)).otherwise(float("inf")).alias("bound"))
        found = near.unionByName(visit(asked.drop("bound").join(limit, "uid", "left").select("uid", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), 1, probes))
    rank = lambda of: F.row_number().over(Window.partitionBy(of).orderBy("score", "vec_id"))
    best = found.withColumn("rank", rank("ask")).where(F.col("rank") <= k + 1).drop("rank")
    mine = named.join(best, named["uid"] == best["ask"]).where("vec_id <> query_id")
    return mine.withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(100)) == 0)
