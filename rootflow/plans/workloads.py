"""Workload queries: text index, logs, graphs, matrices, search, particles, batched streams, comparisons."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootflow.operators import external as x
from rootflow.operators.graphs import bfs_levels
from rootflow.plans.relational import MONEY, rows
from rootflow.registry import register
from rootflow.sources.tables import table


@register("inverted_index", r"SELECT word, doc_id // 4096 AS block, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2")
def q_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    # Words are made distinct inside each document before they are dealt.
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[ \\t\\n\\r\\f\\x0B]+"))).alias("word")).where("word <> ''")
    return x.postings(words, "word", "doc_id").select("word", "block", F.array_join(F.col("documents").cast("array<string>"), ",").alias("doc_ids"))


@register("word_counts", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def q_word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[ \\t\\n\\r\\f\\x0B]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(rows().alias("n"))


@register("log_error_classes", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains(line, 'error') THEN 'error' WHEN contains(line, 'purchase') THEN 'purchase' ELSE 'other' END AS class FROM (SELECT event_type || ' ' || props AS line FROM events)) GROUP BY 1")
def q_log_error_classes(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat("event_type", F.lit(" "), "props")
    kind = F.when(F.contains(line, F.lit("error")), "error").when(F.contains(line, F.lit("purchase")), "purchase").otherwise("other")
    return table(spark, d, "events").groupBy(kind.alias("class")).agg(rows().alias("n"))


@register("process_large_dataset", "WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS v FROM orders WHERE o_totalprice > 100000), m AS (SELECT round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS mean FROM s) SELECT 'group_' || CAST(floor(CAST(v AS DOUBLE) / 100) AS BIGINT) AS bucket, count(*) AS n, round(min(CAST(v AS DOUBLE) - mean), 2) AS least, round(max(CAST(v AS DOUBLE) - mean), 2) AS most FROM s, m GROUP BY 1")
def q_process_large_dataset(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").where("o_totalprice > 100000").select((F.col("o_totalprice").cast(MONEY) * 2).alias("v"))
    mean = s.agg(F.round(F.sum("v").cast("double") / F.count(F.lit(1)), 4).alias("mean"))
    away = F.col("v").cast("double") - F.col("mean")
    bucket = F.concat(F.lit("group_"), F.floor(F.col("v").cast("double") / 100).cast("string"))
    return s.join(F.broadcast(mean)).groupBy(bucket.alias("bucket")).agg(rows().alias("n"), F.round(F.min(away), 2).alias("least"), F.round(F.max(away), 2).alias("most"))


# ---- matrices -------------------------------------------------------------------------------------

_CELLS = "SELECT CAST(range // 64 AS BIGINT) AS i, CAST(range % 64 AS BIGINT) AS j, CAST((range * 7919 + 13) % 101 - 50 AS BIGINT) AS v FROM range(4096)"


def cells(spark: SparkSession, n: int = 64) -> DataFrame:
    k = F.col("id")
    return spark.range(n * n).select(F.floor(k / n).alias("i"), (k % n).alias("j"), ((k * 7919 + 13) % 101 - 50).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A product of sparse matrices (i, j, v): a join on the inner index; partial sums combine before the shuffle."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("a")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def to_blocks(m: DataFrame, n: int, block: int, kind: str) -> DataFrame:
    """Rows (bi, bj, data) of a matrix (i, j, v): its blocks as bytes, row by row."""

    def run(cells: pa.Table) -> pa.Table:
        bi, bj = cells["bi"][0].as_py(), cells["bj"][0].as_py()
        out = np.zeros((min(block, n - bi * block), min(block, n - bj * block)), kind)
        out[cells["i"].to_numpy() - bi * block, cells["j"].to_numpy() - bj * block] = cells["v"].to_numpy()
        return pa.table({"bi": pa.array([bi], pa.int32()), "bj": pa.array([bj], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    of = lambda c: F.floor(F.col(c) / block).cast("int")
    most = min((-(-n // block)) ** 2, 10_000)
    return m.select(of("i").alias("bi"), of("j").alias("bj"), "i", "j", "v").repartition(most, "bi", "bj").groupBy("bi", "bj").applyInArrow(run, "bi int, bj int, data binary")


def multiply_blocked(a: DataFrame, b: DataFrame, n: int, block: int) -> DataFrame:
    """A product of n x n matrices (i, j, v), block by block: a task has one block row of a and one block column of b.

    A result block needs ``2 * n * block`` cells, whatever the matrix; each block is sent to ``n / block`` tasks."""
    most, kind = -(-n // block), dict(a.dtypes)["v"]
    number = {"bigint": "int64", "int": "int32", "double": "float64", "float": "float32"}[kind]
    every = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    left = to_blocks(a, n, block, number).select("bi", every.alias("bj"), F.lit(0).alias("side"), F.col("bj").alias("k"), "data")
    right = to_blocks(b, n, block, number).select(every.alias("bi"), "bj", F.lit(1).alias("side"), F.col("bi").alias("k"), "data")

    def run(blocks: pa.Table) -> pa.Table:
        bi, bj = blocks["bi"][0].as_py(), blocks["bj"][0].as_py()
        rows, columns = min(block, n - bi * block), min(block, n - bj * block)
        found = {(s, k): np.frombuffer(x, number) for s, k, x in zip(blocks["side"].to_pylist(), blocks["k"].to_pylist(), blocks["data"].to_pylist(), strict=True)}
        out = np.zeros((rows, columns))
        for k in range(most):
            x, y = found.get((0, k)), found.get((1, k))
            if x is not None and y is not None:
                # Whole numbers below 2^53 are exact as doubles, which have fast products.
                out += x.reshape(rows, -1).astype(float) @ y.reshape(-1, columns).astype(float)
        at = np.indices(out.shape)
        return pa.table({"i": (at[0] + bi * block).ravel().astype(np.int64), "j": (at[1] + bj * block).ravel().astype(np.int64), "v": out.astype(number).ravel()})

    return left.unionByName(right).repartition(min(most * most, 10_000), "bi", "bj").groupBy("bi", "bj").applyInArrow(run, f"i long, j long, v {kind}")


@register("matmul_blocked", f"WITH m AS ({_CELLS}) SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY 1, 2")
def q_matmul_blocked(spark: SparkSession, d: str) -> DataFrame:
    return multiply_blocked(cells(spark), cells(spark), 64, 24)


@register("matmul_joined", f"WITH m AS ({_CELLS}) SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY 1, 2")
def q_matmul_joined(spark: SparkSession, d: str) -> DataFrame:
    return multiply(cells(spark), cells(spark))


@register("matrix_computation", f"WITH m AS ({_CELLS}), p AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY 1, 2) SELECT i, round(sum(CASE WHEN v > 0 THEN sqrt(v) ELSE 0 END), 4) AS total FROM p GROUP BY 1")
def q_matrix_computation(spark: SparkSession, d: str) -> DataFrame:
    p = multiply(cells(spark), cells(spark))
    v = F.col("v").cast("double")
    return p.groupBy("i").agg(F.round(F.sum(F.when(v > 0, F.sqrt(v)).otherwise(0.0)), 4).alias("total"))


@register("forward_pass", "WITH x AS (SELECT doc_id, [doc_id % 7 - 3, n_chars % 11 - 5, doc_id % 13 - 6] AS v FROM documents), h AS (SELECT doc_id, list_transform([[1, -2, 3], [-1, 1, 2], [2, 0, -1]], lambda w: greatest(0, w[1] * v[1] + w[2] * v[2] + w[3] * v[3])) AS h FROM x) SELECT doc_id, CAST(3 * h[1] - h[2] + 2 * h[3] AS BIGINT) AS output FROM h")
def q_forward_pass(spark: SparkSession, d: str) -> DataFrame:
    v = F.array(F.col("doc_id") % 7 - 3, F.col("n_chars") % 11 - 5, F.col("doc_id") % 13 - 6)
    w1 = F.array(*[F.array(*[F.lit(c).cast("long") for c in row]) for row in ((1, -2, 3), (-1, 1, 2), (2, 0, -1))])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, t: s + t)
    hidden = F.transform(w1, lambda w: F.greatest(F.lit(0).cast("long"), dot(w, F.col("v"))))
    w2 = F.array(*[F.lit(c).cast("long") for c in (3, -1, 2)])
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", dot(hidden, w2).alias("output"))


@register("simulate_particles", "WITH RECURSIVE p AS (SELECT 0 AS step, range AS id, CAST(range % 97 AS DOUBLE) / 97 AS x, CAST(range % 89 AS DOUBLE) / 890 AS v FROM range(1000) UNION ALL SELECT step + 1, id, least(greatest(x + v * 0.25::DOUBLE, 0), 1), v * 0.5::DOUBLE FROM p WHERE step < 8) SELECT id, round(x, 9) AS x, round(v, 9) AS v FROM p WHERE step = 8")
def q_simulate_particles(spark: SparkSession, d: str) -> DataFrame:
    start = spark.range(1000).select("id", (F.col("id") % 97 / 97).alias("x"), (F.col("id") % 89 / 890).alias("v"))
    state = F.struct(F.col("x").alias("x"), F.col("v").alias("v"))
    step = lambda s, _: F.struct(F.least(F.greatest(s["x"] + s["v"] * 0.25, F.lit(0.0)), F.lit(1.0)).alias("x"), (s["v"] * 0.5).alias("v"))
    end = start.select("id", F.aggregate(F.sequence(F.lit(1), F.lit(8)), state, step).alias("s"))
    return end.select("id", F.round("s.x", 9).alias("x"), F.round("s.v", 9).alias("v"))


# ---- graphs and search ----------------------------------------------------------------------------

_EDGES = "SELECT range AS u, (range * 7 + 3) % 600 AS v FROM range(400) UNION ALL SELECT range AS u, (range * range + 1) % 400 AS v FROM range(400)"


def edges(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(400).select(k.alias("u"), ((k * 7 + 3) % 600).alias("v")).unionByName(spark.range(400).select(k.alias("u"), ((k * k + 1) % 400).alias("v")))


_BFS = f"WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), r AS (SELECT 0::BIGINT AS node, 0 AS level UNION SELECT b.v, r.level + 1 FROM r JOIN b ON b.u = r.node WHERE r.level < 40)"


@register("graph_bfs_levels", f"{_BFS} SELECT node, min(level) AS level FROM r GROUP BY 1")
def q_graph_bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return bfs_levels(edges(spark), 0)


@register("graph_reachable", f"{_BFS} SELECT count(DISTINCT node) AS n FROM r")
def q_graph_reachable(spark: SparkSession, d: str) -> DataFrame:
    return bfs_levels(edges(spark), 0).agg(rows().alias("n"))


@register("search_cache_hits", "SELECT c_custkey, rank <= floor(sqrt(n)) AS cached FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rank, count(*) OVER () AS n FROM customer)")
def q_search_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    keys = x.global_row_number(table(spark, d, "customer").select("c_custkey"), "c_custkey", name="rank")
    asked = table(spark, d, "customer").select("c_custkey")
    held = math.isqrt(asked.count())  # the cache holds the root of the keys
    return asked.join(keys, "c_custkey").select("c_custkey", (F.col("rank") <= held).alias("cached"))


# ---- batched streams, comparisons -----------------------------------------------------------------


@register("stream_running_revenue", "WITH b AS (SELECT *, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS BIGINT) AS batch_id FROM events WHERE event_type = 'purchase'), s AS (SELECT batch_id, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS v FROM b GROUP BY 1) SELECT batch_id, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS processed, CAST(sum(v) OVER (ORDER BY batch_id) AS DOUBLE) AS revenue FROM s")
def q_stream_running_revenue(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    batches = x.buffer_batches(e, "at", "event_id").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast(MONEY)).alias("v"))
    run = x.running_sum(batches, "batch_id", {"processed": "n", "revenue": "v"})
    return run.select("batch_id", F.col("processed").cast("long").alias("processed"), F.col("revenue").cast("double").alias("revenue"))


_BY_FLAG = "SELECT l_returnflag AS strategy, l_linenumber AS size, count(*) AS seconds, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS memory FROM lineitem GROUP BY 1, 2"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Stand-ins for benchmark results: a strategy, a size, its time and memory."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("strategy"), F.col("l_linenumber").alias("size")).agg(rows().alias("seconds"), F.sum(F.col("l_quantity").cast("long")).alias("memory"))


@register("best_strategy_argmin", f"SELECT size, arg_min(strategy, (seconds, strategy)) AS fastest, arg_min(strategy, (memory, strategy)) AS leanest, arg_min(strategy, (seconds * memory, strategy)) AS best FROM ({_BY_FLAG}) GROUP BY 1")
def q_best_strategy_argmin(spark: SparkSession, d: str) -> DataFrame:
    least = lambda k: F.min_by("strategy", F.struct(k, "strategy"))
    r = runs(spark, d).withColumn("product", F.col("seconds") * F.col("memory"))
    return r.groupBy("size").agg(least("seconds").alias("fastest"), least("memory").alias("leanest"), least("product").alias("best"))


@register("relative_change", f"WITH r AS ({_BY_FLAG}) SELECT r.strategy, r.size, round(100 * (1 - r.memory / b.memory), 4) AS memory_saved, round(100 * (r.seconds / b.seconds - 1), 4) AS time_added FROM r JOIN r b ON b.size = r.size AND b.strategy = 'N' WHERE r.strategy <> 'N'")
def q_relative_change(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    base = r.where("strategy = 'N'").select("size", F.col("memory").alias("m"), F.col("seconds").alias("s"))
    saved, added = F.round(100 * (1 - F.try_divide("memory", "m")), 4), F.round(100 * (F.try_divide("seconds", "s") - 1), 4)
    return r.where("strategy <> 'N'").join(base, "size").select("strategy", "size", saved.alias("memory_saved"), added.alias("time_added"))
