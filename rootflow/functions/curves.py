"""Space and time curves of strategies, placement over memory levels, scores, and what memory costs."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootflow.functions.intervals import Hierarchy

# Scores of a strategy for memory, speed, fault tolerance, scalability and cost.
SCORES = {
    "sqrt_n": (90, 70, 85, 95, 80),
    "linear": (20, 100, 50, 40, 60),
    "log_n": (95, 30, 70, 80, 70),
    "constant": (100, 10, 60, 90, 50),
}


def space_column(n: Column, strategy: Column) -> Column:
    return F.when(strategy == "sqrt_n", F.sqrt(n * F.ln(n))).when(strategy == "linear", n).when(strategy == "log_n", F.ln(n)).otherwise(1.0)


def time_column(n: Column, strategy: Column) -> Column:
    return F.when(strategy == "sqrt_n", n * 1.5).when(strategy == "linear", n).when(strategy == "log_n", n * n / 100).otherwise(n * n)


def waterfall(spark: SparkSession, sizes: list[int], hierarchy: Hierarchy = Hierarchy()) -> DataFrame:
    """How many of the bytes each level takes when the fastest fill first."""
    before, levels = 0, []
    for name, size in hierarchy.levels():
        levels.append((name, size, before))
        before += size
    table = spark.createDataFrame(levels, "level string, size long, before long")
    placed = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("bytes") - F.col("before")))
    return spark.createDataFrame([(s,) for s in sizes], "bytes long").join(F.broadcast(table)).select("bytes", "level", placed.alias("placed"))


# Dollars an hour for a gigabyte and for a CPU, the slowdown that square-root memory costs, and what using it costs at all.
GB_HOUR, CPU_HOUR, SLOWDOWN, OVERHEAD = 0.1, 0.05, 1.2, 0.1
# Structures by memory constraint and data size.
SIZES = ("< 1KB", "1KB-1MB", "1MB-1GB", "> 1GB")
DECISIONS = {
    "Unlimited": ("Array", "Array", "Hash", "B-tree"),
    "Limited": ("Array", "B-tree", "B-tree", "External"),
    "Severe": ("Compressed", "Compressed", "√n Cache", "√n External"),
    "Embedded": ("Minimal", "Minimal", "Streaming", "Streaming"),
}
# Memory and time cost of each class of space.
COST_BARS = {"O(n)": (100.0, 1.0), "O(√n)": (10.0, 10.0), "O(log n)": (1.0, 100.0), "O(1)": (0.1, 1000.0)}


def algorithm_curves(sizes: DataFrame) -> DataFrame:
    """Rows (n, family, algorithm, space, time) of sort, search, matrix and graph algorithms for each double n."""
    n, root = F.col("n"), F.sqrt("n")
    log, one = F.log2("n"), F.lit(1.0)
    made = [
        ("sort", "in_place", one, n * log),
        ("sort", "merge", n, n * log),
        ("sort", "external_sqrt_n", root, n * log * 2),
        ("search", "array", n, n),
        ("search", "tree", n, log),
        ("search", "hash", n, one),
        ("search", "btree_sqrt_n", n, F.ln("n") / F.ln(root)),
        ("matrix", "standard", F.pow(root, F.lit(2.0)), F.pow(root, F.lit(3.0))),
        ("matrix", "strassen", F.pow(root, F.lit(2.0)), F.pow(root, F.lit(2.807))),
        ("matrix", "blocked", F.pow(root, F.lit(1.5)), F.pow(root, F.lit(3.0)) * 1.2),
        ("graph", "breadth_or_depth_first", n, n + n),
        ("graph", "dijkstra", n * F.ln("n"), n * F.ln("n")),
        ("graph", "bounded", root, n * root),
    ]
    points = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(a).alias("algorithm"), s.cast("double").alias("space"), t.cast("double").alias("time")) for f, a, s, t in made])
    return sizes.select("n", F.explode(points).alias("x")).select("n", "x.*")


def cache_curves(points: DataFrame) -> DataFrame:
    """Rows (data, ram, full, sqrt_n): the share of the data that fits a full cache, and a cache of its root."""
    data, ram = F.col("data"), F.col("ram")
    return points.select("data", "ram", F.least(data / ram, F.lit(1.0)).alias("full"), (F.least(F.sqrt(data) / ram, F.lit(1.0)) * 0.9).alias("sqrt_n"))


def shuffle_curves(points: DataFrame, nodes: int = 100) -> DataFrame:
    """Rows (per_node, strategy, memory, seconds) of ways to shuffle that many bytes a node at a gigabyte a second."""
    factors = {"all_to_all": float(nodes), "tree_sqrt_n": float(math.isqrt(nodes)), "combiner": math.log2(nodes)}
    ways = F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(v).alias("factor")) for k, v in factors.items()])
    memory = F.col("per_node") * F.col("x.factor")
    return points.select("per_node", F.explode(ways).alias("x")).select("per_node", "x.strategy", memory.alias("memory"), (memory / 1e9).alias("seconds"))


def cloud_costs(sizes: DataFrame) -> DataFrame:
    """Rows (bytes, standard, sqrt_n, saves): dollars an hour with all bytes in memory and with their square root."""
    b = F.col("bytes")
    standard, root = b / 1e9 * GB_HOUR + CPU_HOUR, F.sqrt(b) / 1e9 * GB_HOUR + CPU_HOUR * SLOWDOWN
    return sizes.select("bytes", standard.alias("standard"), root.alias("sqrt_n"), (standard > root).alias("saves"))


def worthwhile(points: DataFrame) -> DataFrame:
    """Rows (bytes, per_gb, worth): whether the memory that a square root saves is worth more than using it costs."""
    saved = (F.col("bytes") - F.sqrt("bytes")) / 1e9
    return points.select("bytes", "per_gb", (saved * F.col("per_gb") - OVERHEAD > 0).alias("worth"))


def exported(n: int, strategy: str, view: str, hierarchy: Hierarchy = Hierarchy()) -> str:
    """A point of the curves with its parameters and the memory levels, as JSON."""
    space = {"sqrt_n": math.sqrt(n * math.log(n)), "linear": float(n), "log_n": math.log(n)}.get(strategy, 1.0)
    spent = {"sqrt_n": n * 1.5, "linear": float(n), "log_n": n * n / 100}.get(strategy, float(n) * n)
    scores = dict(zip(("memory", "speed", "fault_tolerance", "scalability", "cost"), SCORES[strategy], strict=True))
    levels = {f"{name.lower()}_bytes": size for name, size in hierarchy.levels()}
    return json.dumps({"parameters": {"data_size": n, "strategy": strategy, "view": view}, "metrics": scores, "space_time_point": [space, spent], "system_info": levels})


def monthly_cost(memory_gb: float, hours: float, per_gb_hour: float, per_cpu_hour: float, cpus: float = 1.0) -> float:
    return memory_gb * hours * per_gb_hour + cpus * hours * per_cpu_hour


def break_even_hours(saved_gb: float, per_gb_hour: float, slowdown: float, per_cpu_hour: float, setup: float, cpus: float = 1.0) -> float:
    """Hours of use after which what is saved an hour has paid for the setup; infinite where an hour saves nothing."""
    saving = saved_gb * per_gb_hour - (slowdown - 1) * per_cpu_hour * cpus
    return setup / saving if saving > 0 else math.inf
