"""Breadth-first levels over an edge table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootflow.operators.external import _fixed

#: Edges of a graph that is walked on the driver.
WALK_EDGES = 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (u, v), each once, without self-loops."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("u <> v").distinct()


def bfs_levels(edges: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """Rows (node, level) of all nodes that the start reaches.

    Each round joins the frontier with the edges. In an undirected graph a node's neighbours lie one level before it,
    beside it or after it, so new nodes are those that neither of the last two levels has: a round reads the
    frontier and its edges and writes the next frontier, never all that was seen. Every level ends its lineage."""
    spark = edges.sparkSession
    links = _fixed(undirected(edges))
    frontier = spark.createDataFrame([(start, 0)], "node long, level int")
    before, levels, level = frontier.limit(0), [frontier], 0
    while most is None or level < most:
        level += 1
        reached = frontier.select(F.col("node").alias("u")).join(links, "u").select(F.col("v").alias("node")).distinct()
        known = frontier.select("node").unionByName(before.select("node"))
        after = _fixed(reached.join(known, "node", "left_anti").withColumn("level", F.lit(level)))
        if after.isEmpty():
            break
        levels.append(after)
        before, frontier = frontier, after
    return functools.reduce(DataFrame.unionByName, levels)


def depth_first(edges: DataFrame, start: int) -> list[int]:
    """The order in which a depth-first walk with smallest neighbours first meets nodes.

    A walk in one order can't be split, so this is for graphs that fit the driver; it raises beyond ``WALK_EDGES`` edges."""
    rows = undirected(edges).limit(WALK_EDGES + 1).collect()
    if len(rows) > WALK_EDGES:
        raise ValueError("the graph has too many edges for a walk in one task")
    near: dict[int, list[int]] = {}
    for u, v in sorted(rows, reverse=True):
        near.setdefault(u, []).append(v)
    seen, order, stack = set(), [], [start]
    while stack:
        node = stack.pop()
        if node not in seen:
            seen.add(node)
            order.append(node)
            stack += [x for x in near.get(node, []) if x not in seen]
    return order
