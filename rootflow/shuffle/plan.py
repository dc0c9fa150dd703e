"""From a shuffle's description to a plan, and from the plan to Spark settings and a real repartition."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootflow.functions.intervals import interval

GB = 1e9
#: Share of bytes left by a codec, and MB/s of one core for it.
RATIO = {"none": 1.0, "zlib": 0.3, "snappy": 0.5, "lz4": 0.7}
CODEC_RATE = {"zlib": 100e6, "snappy": 500e6, "lz4": 1e9}
DISK_RATE = {"ssd": 500e6, "hdd": 200e6}
#: Spark has no zlib codec for shuffles.
SPARK_CODEC = {"zlib": "zstd", "snappy": "snappy", "lz4": "lz4"}


@dataclass(frozen=True)
class Node:
    name: str
    cpus: int = 16
    memory_gb: float = 64.0
    gbps: float = 10.0
    storage: str = "ssd"
    rack: str = "default"


@dataclass(frozen=True)
class Task:
    inputs: int
    outputs: int
    data_gb: float
    keys: str = "uniform"  # uniform, skewed or heavy_hitters
    value_bytes: int = 100
    combiner: str | None = None


@dataclass
class Plan:
    strategy: str
    buffers: dict[str, int]
    spill_at: dict[str, float]
    tree: list[tuple[int, str, str]]
    codec: str
    placement: list[str]
    seconds: float = 0.0
    network_bytes: float = 0.0
    memory: dict[str, float] = field(default_factory=dict)

    def spark_conf(self) -> dict[str, str]:
        """The settings that realise the plan in a Spark session."""
        conf = {"spark.sql.shuffle.partitions": str(len(self.placement)), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
        conf["spark.shuffle.compress"] = str(self.codec != "none").lower()
        if self.codec != "none":
            conf["spark.io.compression.codec"] = SPARK_CODEC[self.codec]
        least = min(self.buffers.values(), default=0)
        conf["spark.reducer.maxSizeInFlight"] = f"{max(1, min(96, least >> 20))}m"
        return conf

    def explain(self) -> str:
        most = max(self.buffers.values(), default=0)
        codec = "no codec" if self.codec == "none" else f"codec {self.codec}"
        return f"{self.strategy} over {len(self.placement)} partitions, buffers up to {most / 1e6:.1f} MB, {codec}; about {self.network_bytes / GB:.1f} GB over the network in {self.seconds:.1f} s"


def cluster(n: int, per_rack: int = 2, **properties) -> list[Node]:
    return [Node(f"node{i}", rack=f"rack{i // per_rack}", **properties) for i in range(n)]


def bandwidth(a: Node, b: Node) -> float:
    """Gb/s between two nodes; half of it between racks."""
    least = min(a.gbps, b.gbps)
    return math.inf if a.name == b.name else least if a.rack == b.rack else least / 2


def strategy(task: Task, nodes: list[Node]) -> str:
    if task.data_gb < 1:
        return "all_to_all"
    if task.combiner:
        return "combiner_based"
    if len(nodes) > 10:
        return "tree_aggregate"
    return "range_partition" if task.keys == "skewed" else "hash_partition"


def buffers(task: Task, nodes: list[Node], fraction: float) -> dict[str, int]:
    """Bytes per node: all of its share where that fits, a square-root interval of values else."""
    share, out = task.data_gb * GB / len(nodes), {}
    for n in nodes:
        free = n.memory_gb * GB * fraction
        small = min(interval(int(share / task.value_bytes)) * task.value_bytes, free)
        out[n.name] = int(share if share <= free else small)
    return out


def tree(names: list[str]) -> list[tuple[int, str, str]]:
    """Edges (level, parent, child): groups of the fan-out that a height of sqrt(n) needs."""
    if len(names) < 2:
        return []
    fan = max(2, math.ceil(len(names) ** (1 / math.isqrt(len(names)))))
    out, level = [], 1
    while len(names) > 1:
        groups = [names[i : i + fan] for i in range(0, len(names), fan)]
        out += [(level, g[0], c) for g in groups for c in g[1:]]
        names, level = [g[0] for g in groups], level + 1
    return out


def codec(task: Task, nodes: list[Node]) -> str:
    mean = sum(n.gbps for n in nodes) / len(nodes)
    if mean > 10:
        return "none"
    return "zlib" if task.value_bytes > 1000 else "snappy" if mean > 1 else "lz4"


def assign(partitions: int, names: list[str], kind: str) -> list[str]:
    """The node of each partition: contiguous runs for ranges, in turn else."""
    if kind == "range_partition":
        run = max(1, partitions // len(names))
        return [names[min(p // run, len(names) - 1)] for p in range(partitions)]
    return [names[p % len(names)] for p in range(partitions)]


def plan(task: Task, nodes: list[Node], fraction: float = 0.5) -> Plan:
    if not nodes:
        raise ValueError("a cluster has one node at least")
    kind, c = strategy(task, nodes), codec(task, nodes)
    b = buffers(task, nodes, fraction)
    out = Plan(kind, b, {k: 0.8 * v for k, v in b.items()}, tree([n.name for n in nodes]) if kind == "tree_aggregate" else [], c, assign(task.outputs, [n.name for n in nodes], kind))
    out.network_bytes = task.data_gb * GB * RATIO[c] * {"all_to_all": (len(nodes) - 1) / len(nodes), "tree_aggregate": math.log2(len(nodes))}.get(kind, 1.0)
    out.memory = {k: v * 1.1 + (0 if c == "none" else min(v * 0.1, 100 << 20)) for k, v in b.items()}
    out.seconds = _seconds(task, nodes, out)
    return out


def _seconds(task: Task, nodes: list[Node], p: Plan) -> float:
    """The slower of network and spill I/O, with a tenth of the CPU's time on top."""
    links = [bandwidth(a, b) for a in nodes for b in nodes if a is not b]
    network = p.network_bytes / (sum(links) / len(links) * 1e9 / 8 * len(nodes)) if links else 0.0
    data = task.data_gb * GB
    over = max(0.0, data - sum(p.buffers.values()))
    disk = 2 * over / sum(DISK_RATE.get(n.storage, DISK_RATE["hdd"]) for n in nodes)
    cores = sum(n.cpus for n in nodes)
    cpu = data / 1e9 / cores + (data / CODEC_RATE[p.codec] / cores if p.codec != "none" else 0.0)
    return max(network, disk) + 0.1 * cpu


def execute(df: DataFrame, p: Plan, *keys: str) -> DataFrame:
    """A real repartition as planned: by ranges or hashes, or in two steps down a tree of square-root fan-out."""
    n = len(p.placement)
    if p.strategy == "range_partition":
        return df.repartitionByRange(n, *keys)
    if p.strategy == "tree_aggregate" and n > 3:
        df = df.repartition(math.isqrt(n), *keys)
    return df.repartition(n, *keys)


def combined(df: DataFrame, p: Plan, keys: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Sums and counts per key: combined before the planned shuffle, and by a salt in between where the plan is a tree.

    ``values`` names each result's kind (sum or count) and column."""
    first = {k: (F.sum if kind == "sum" else F.count)(c).alias(k) for k, (kind, c) in values.items()}
    again = [F.sum(k).alias(k) for k in values]
    if p.strategy != "tree_aggregate":
        return df.groupBy(*keys).agg(*first.values())
    # The fan-out spreads a key over so many tasks before its partial results meet.
    fan = max(2, math.isqrt(len(p.placement)))
    return df.withColumn("__fan", F.pmod(F.monotonically_increasing_id(), F.lit(fan))).groupBy(*keys, "__fan").agg(*first.values()).groupBy(*keys).agg(*again)


def measured(df: DataFrame, p: Plan, *keys: str) -> dict:
    """Rows, partitions, the largest partition and seconds of one run of the planned shuffle."""
    began = time.time()
    parts = execute(df, p, *keys).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    found = parts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("partitions"), F.max("n").alias("largest")).first()
    return {**found.asDict(), "seconds": time.time() - began}
