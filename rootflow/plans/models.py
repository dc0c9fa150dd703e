"""Model queries: the formulas of intervals, strategies, levels, placement and topology as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootflow.functions import curves
from rootflow.functions.intervals import Hierarchy, checkpoints, interval_column, intervals, strategy_memory_column, strategy_time_column
from rootflow.operators.keyed import structure_column
from rootflow.registry import register
from rootflow.shuffle import plan as shuffle

_ROOT = "CAST(floor(sqrt({n})) AS BIGINT)"


def _interval_sql(n: str) -> str:
    r = _ROOT.format(n=n)
    return f"greatest(1, CASE WHEN {r} > 8 THEN {r} - {r} % 8 ELSE {r} END)"


@register("sqrt_interval", f"SELECT range AS n, {_interval_sql('range')} AS step FROM range(5000)")
def q_sqrt_interval(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(5000).select(F.col("id").alias("n"), interval_column(F.col("id")).alias("step"))


_STRATEGIES = ("constant", "logarithmic", "sqrt_n", "linear", "adaptive")
_SIZES = (100, 10_000, 1_000_000, 100_000_000, 10_000_000_000)
_GRID = f"(SELECT n::BIGINT AS n, s FROM (SELECT unnest([{', '.join(map(str, _SIZES))}]) AS n), (SELECT unnest([{', '.join(repr(s) for s in _STRATEGIES)}]) AS s))"
_MEMORY = f"CASE s WHEN 'constant' THEN 80 WHEN 'logarithmic' THEN 8 * CAST(floor(log2(n) + 1) AS BIGINT) WHEN 'sqrt_n' THEN 8 * {_interval_sql('n')} WHEN 'linear' THEN 8 * n ELSE CASE WHEN 8 * n <= 8388608 THEN 8 * n ELSE 8 * {_interval_sql('n')} END END"
_LEVEL = "CASE WHEN {m} <= 65536 THEN 'L1' WHEN {m} <= 262144 THEN 'L2' WHEN {m} <= 8388608 THEN 'L3' WHEN {m} <= 17179869184 THEN 'RAM' ELSE 'Disk' END"
_LATENCY = "CASE {l} WHEN 'L1' THEN 1.0 WHEN 'L2' THEN 4.0 WHEN 'L3' THEN 12.0 WHEN 'RAM' THEN 100.0 ELSE 1e7 END"


def grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s) for n in _SIZES for s in _STRATEGIES], "n long, s string")


@register("strategy_memory", f"SELECT n, s AS strategy, CAST({_MEMORY} AS BIGINT) AS memory FROM {_GRID}")
def q_strategy_memory(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark).select("n", F.col("s").alias("strategy"), strategy_memory_column(F.col("n"), F.col("s")).alias("memory"))


@register("memory_level", f"SELECT size, {_LEVEL.format(m='size')} AS level FROM (SELECT CAST(2 ** range AS BIGINT) + 1 AS size FROM range(40))")
def q_memory_level(spark: SparkSession, d: str) -> DataFrame:
    size = F.expr("shiftleft(1L, cast(id as int))") + 1
    return spark.range(40).select(size.alias("size")).select("size", Hierarchy().level_column(F.col("size")).alias("level"))


@register("simulate_strategies", f"WITH m AS (SELECT n, s, CAST({_MEMORY} AS BIGINT) AS memory FROM {_GRID}), l AS (SELECT *, {_LEVEL.format(m='memory')} AS level FROM m) SELECT n, s AS strategy, memory, level, round(log2(n * ({_LATENCY.format(l='level')})::DOUBLE * CASE s WHEN 'constant' THEN n WHEN 'logarithmic' THEN log2(n) WHEN 'sqrt_n' THEN sqrt(n) ELSE 1 END), 6) AS log_time_ns FROM l")
def q_simulate_strategies(spark: SparkSession, d: str) -> DataFrame:
    h, n, s = Hierarchy(), F.col("n"), F.col("s")
    m = grid(spark).withColumn("memory", strategy_memory_column(n, s))
    time = F.round(F.log2(strategy_time_column(n, s, h.latency_column(F.col("memory")))), 6)
    return m.select("n", s.alias("strategy"), "memory", h.level_column(F.col("memory")).alias("level"), time.alias("log_time_ns"))


@register("checkpoint_schedule", "SELECT CAST(unnest(range(240, 60000, 240)) AS BIGINT) AS place")
def q_checkpoint_schedule(spark: SparkSession, d: str) -> DataFrame:
    r = checkpoints(60_000 * 8)
    return spark.range(r.start, r.stop, r.step).withColumnRenamed("id", "place")


@register("interval_policies", "SELECT policy, CAST(count(*) AS BIGINT) AS intervals, CAST(sum(len) AS BIGINT) AS covered FROM (SELECT 'sqrt_n' AS policy, 100 AS len FROM range(100) UNION ALL SELECT 'fixed', 1000 FROM range(10) UNION ALL SELECT 'exponential', CAST(least(2 ** (range + 1), 10000 - (2 ** (range + 1) - 2)) AS BIGINT) FROM range(13) UNION ALL SELECT 'none', 10000) GROUP BY 1")
def q_interval_policies(spark: SparkSession, d: str) -> DataFrame:
    made = [(p, k) for p in ("sqrt_n", "fixed", "exponential", "none") for k in intervals(10_000, p)]
    return spark.createDataFrame(made, "policy string, len long").groupBy("policy").agg(F.count(F.lit(1)).alias("intervals"), F.sum("len").alias("covered"))


_LEVELS = "(SELECT unnest(['L1', 'L2', 'L3', 'RAM']) AS level, unnest([65536, 262144, 8388608, 17179869184]) AS size, unnest([0, 65536, 327680, 8716288]) AS before)"


@register("hierarchy_waterfall", f"SELECT n * 8 AS bytes, level, CAST(greatest(0, least(size, n * 8 - before)) AS BIGINT) AS placed FROM (SELECT unnest([1000, 50000, 2000000, 500000000])::BIGINT AS n), {_LEVELS}")
def q_hierarchy_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return curves.waterfall(spark, [8000, 400_000, 16_000_000, 4_000_000_000])


@register("strategy_curves", "SELECT n, s AS strategy, round(space, 4) AS space, round(time, 4) AS time, round(space * 0.1::DOUBLE + time * 0.01::DOUBLE, 4) AS cost FROM (SELECT n, s, CASE s WHEN 'sqrt_n' THEN sqrt(n * ln(n)) WHEN 'linear' THEN n WHEN 'log_n' THEN ln(n) ELSE 1 END AS space, CASE s WHEN 'sqrt_n' THEN n * 1.5::DOUBLE WHEN 'linear' THEN n WHEN 'log_n' THEN n * n / 100 ELSE n * n END AS time FROM (SELECT unnest([10, 1000, 100000])::DOUBLE AS n), (SELECT unnest(['sqrt_n', 'linear', 'log_n', 'constant']) AS s))")
def q_strategy_curves(spark: SparkSession, d: str) -> DataFrame:
    g = spark.createDataFrame([(float(n), s) for n in (10, 1000, 100_000) for s in ("sqrt_n", "linear", "log_n", "constant")], "n double, strategy string")
    space, time = curves.space_column(F.col("n"), F.col("strategy")), curves.time_column(F.col("n"), F.col("strategy"))
    return g.select("n", "strategy", F.round(space, 4).alias("space"), F.round(time, 4).alias("time"), F.round(space * 0.1 + time * 0.01, 4).alias("cost"))


@register("cache_line_use", "SELECT range + 1 AS bytes, (64 // (range + 1)) * (range + 1) / 64 AS used FROM range(64)")
def q_cache_line_use(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("id") + 1
    return spark.range(64).select(b.alias("bytes"), (F.floor(F.lit(64) / b) * b / 64).alias("used"))


@register("adaptive_impl_ladder", "SELECT n, CASE WHEN n <= 4 THEN 'array' WHEN n <= 83886 THEN 'btree' WHEN n <= 1717986918 THEN 'hash' ELSE 'external' END AS structure FROM (SELECT unnest([1, 4, 5, 83886, 83887, 1717986918, 1717986919])::BIGINT AS n)")
def q_adaptive_impl_ladder(spark: SparkSession, d: str) -> DataFrame:
    sizes = spark.createDataFrame([(n,) for n in (1, 4, 5, 83_886, 83_887, 1_717_986_918, 1_717_986_919)], "n long")
    return sizes.select("n", structure_column(F.col("n")).alias("structure"))




@register("partition_assignment", "SELECT s AS strategy, range AS partition, 'node' || CASE s WHEN 'range_partition' THEN CAST(least(range // 25, 3) AS BIGINT) ELSE range % 4 END AS node FROM range(103), (SELECT unnest(['range_partition', 'hash_partition']) AS s)")
def q_partition_assignment(spark: SparkSession, d: str) -> DataFrame:
    nodes = [f"node{i}" for i in range(4)]
    made = [(s, p, n) for s in ("range_partition", "hash_partition") for p, n in enumerate(shuffle.assign(103, nodes, s))]
    return spark.createDataFrame(made, "strategy string, partition long, node string")


@register("bandwidth_matrix", "SELECT 'node' || a.range AS source, 'node' || b.range AS target, CASE WHEN a.range // 2 = b.range // 2 THEN 10.0 ELSE 5.0 END::DOUBLE AS gbps FROM range(8) a, range(8) b WHERE a.range <> b.range")
def q_bandwidth_matrix(spark: SparkSession, d: str) -> DataFrame:
    nodes = shuffle.cluster(8)
    return spark.createDataFrame([(a.name, b.name, shuffle.bandwidth(a, b)) for a in nodes for b in nodes if a is not b], "source string, target string, gbps double")


@register("shuffle_tree", "WITH RECURSIVE t AS (SELECT 0 AS level, 16 AS nodes UNION ALL SELECT level + 1, (nodes + 1) // 2 FROM t WHERE nodes > 1) SELECT CAST(level + 1 AS BIGINT) AS level, CAST(nodes - (nodes + 1) // 2 AS BIGINT) AS edges FROM t WHERE nodes > 1")
def q_shuffle_tree(spark: SparkSession, d: str) -> DataFrame:
    made = shuffle.tree([f"node{i}" for i in range(16)])
    return spark.createDataFrame(made, "level long, parent string, child string").groupBy("level").agg(F.count(F.lit(1)).alias("edges"))
