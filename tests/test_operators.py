"""Edge cases of the operators and goldens of the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from rootflow.functions import intervals as iv
from rootflow.functions.curves import break_even_hours
from rootflow.operators import external as x
from rootflow.operators import graphs, keyed
from rootflow.shuffle import plan as sh


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,want", [(0, 1), (1, 1), (64, 8), (81, 8), (100, 8), (1000, 24), (10_000, 96), (60_000, 240), (10**6, 1000), (10**9, 31_616)])
def test_interval(n, want):
    assert iv.interval(n) == want


def test_interval_of_large_elements():
    assert iv.interval(10**6, 16) == iv.interval(10**6, 64) == iv.interval(10**6, 128) == 1000
    with pytest.raises(ValueError):
        iv.interval(5, 0)


def test_checkpoints():
    assert list(iv.checkpoints(8000))[:4] == [24, 48, 72, 96] and len(iv.checkpoints(8000)) == 41
    assert iv.checkpoints(8000, memory_limit=4).step == 1


def test_strategy_memory_and_recommendation():
    got = [iv.strategy_memory(10**6, s) for s in ("constant", "logarithmic", "sqrt_n", "linear")]
    assert got == [80, 160, 8000, 8_000_000]
    assert "99.9 %" in iv.recommendation(10**6) and "8233.3 %" in iv.recommendation(10**6)


def test_intervals_policies():
    assert iv.intervals(10, "exponential") == [2, 4, 4] and iv.intervals(5, "none") == [5] and iv.intervals(2500, "fixed") == [1000, 1000, 500]


def test_group_has_one_row_per_key_and_null_is_a_key(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), ("a", 5)], "k string, v int")
    got = {r.k: r.s for r in x.group_by_external(df, ["k"], F.sum("v").alias("s"), buffer_size=1).collect()}
    assert got == {"a": 9, "b": 2, None: 4}
    with pytest.raises(ValueError):
        x.group_by_external(df, ["k"], F.sum("v"), buffer_size=0)


def test_joins_with_nulls_and_empty_sides(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "p int")
    b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "q int")
    assert x.join_external(a, b, "p", "q").count() == 2
    assert x.join_external(a, b, "p", "q", null_safe=True).count() == 3
    assert x.join_external(a, b.limit(0), "p", "q").count() == 0
    assert "SortMergeJoin" in plan_of(x.join_external(a, b, "p", "q", hint="merge"))
    assert "ShuffledHashJoin" in plan_of(x.join_external(a, b, "p", "q", hint="shuffle_hash"))


def test_union_drops_duplicates_of_both_sides(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(2,), (2,), (1,)], "k int")
    assert sorted(r.k for r in x.union_external(a, b).collect()) == [1, 2]
    assert [r.k for r in x.intersect_external(a, b).collect()] == [1]
    assert x.except_external(a, b).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_global_row_number(spark, n):
    df = spark.createDataFrame([(i * 7 % 10, i) for i in range(n)], "k int, i int")
    got = x.global_row_number(df, "k", "i").collect()
    want = {i: r + 1 for r, (_, i) in enumerate(sorted((i * 7 % 10, i) for i in range(n)))}
    assert {r.i: r.row_number for r in got} == want


def test_global_row_number_puts_nulls_first_and_uses_many_tasks(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "k int")
    out = x.global_row_number(df, "k")
    assert {r.k: r.row_number for r in out.collect()} == {None: 1, 1: 2, 2: 3, 3: 4}
    assert "row_number" in plan_of(out) and "__range" in plan_of(out)


def test_batches(spark):
    df = spark.range(1500)
    sizes = x.batch_by_sqrt_n(df, "id").groupBy("batch_id").count().collect()
    assert len(sizes) == 40 and {r["count"] for r in sizes} == {38, 18}
    assert x.UNKNOWN_BATCH == 31 and x.UNKNOWN_STREAM_BATCH == 1000


def test_groups_in_blocks(spark):
    """A hot key becomes several rows, none longer than the width, that hold its rows in order."""
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, id % 3 * 0) AS k")
    got = x.group_rows_external(df, ["k"], [], ["id"], width=64).collect()
    assert len(got) == 2 * 16 and all(len(r["rows"]) <= 64 for r in got)
    for key in (None, 0):
        ids = [e["id"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["block"]) for e in r["rows"]]
        assert ids == [i for i in range(1000) if (i % 10 == 0) == (key is None)]
    assert x.group_rows_external(df.limit(0), ["k"], [], ["id"], width=64).count() == 0


def test_snapshots(spark):
    got = x.running_snapshots(spark.range(1, 11), F.col("id"), "id", every=4).orderBy("n").collect()
    assert [(r.n, r.total) for r in got] == [(4, 10), (8, 36)]


def test_top_k_keeps_a_heap(spark):
    assert "TakeOrderedAndProject" in plan_of(x.top_k(spark.range(100), 3, F.desc("id")))


def test_last_write_wins_and_tombstones(spark):
    w = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, None, 2)], "k int, v string, t int")
    got = keyed.last_write_wins(w, "k", "v", "t", tombstone=F.col("v").isNull()).collect()
    assert [(r.k, r.v) for r in got] == [(1, "b")]


def test_structure_ladder():
    assert [keyed.structure_for(n) for n in (4, 5, 83_886, 83_887, 2 * 10**9)] == ["array", "btree", "btree", "hash", "external"]
    assert keyed.hash_slots(100) == 136 and keyed.hash_slots(0) == 0


def test_bfs_on_cycles_and_parts(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (4, 4)], "u long, v long")
    assert {(r.node, r.level) for r in graphs.bfs_levels(e, 1).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {(r.node, r.level) for r in graphs.bfs_levels(e, 4).collect()} == {(4, 0)}


def test_shuffle_rules():
    four, sixteen = sh.cluster(4), sh.cluster(16)
    t = lambda gb, **k: sh.Task(100, 100, gb, **k)
    assert sh.strategy(t(0.5), four) == "all_to_all" and sh.strategy(t(100, combiner="sum"), four) == "combiner_based"
    assert sh.strategy(t(100), sixteen) == "tree_aggregate" and sh.strategy(t(100, keys="skewed"), four) == "range_partition"
    assert sh.strategy(t(100, keys="heavy_hitters"), four) == "hash_partition"
    assert [sh.codec(t(1, value_bytes=v), sh.cluster(4, gbps=g)) for g, v in ((10, 1000), (10, 1001), (25, 1000), (1, 1000), (1, 1001))] == ["snappy", "zlib", "none", "lz4", "zlib"]
    small = sh.cluster(4, memory_gb=8)
    p = sh.plan(t(100, value_bytes=1000), small, 0.3)
    assert set(p.buffers.values()) == {5_000_000} and set(p.spill_at.values()) == {4_000_000} and set(p.memory.values()) == {6_000_000}
    assert p.spark_conf()["spark.io.compression.codec"] == "snappy" and "hash_partition" in p.explain()
    assert [len(sh.tree([str(i) for i in range(n)])) for n in (1, 2, 11, 16, 32)] == [0, 1, 10, 15, 31]


def test_shuffle_runs(spark):
    p = sh.plan(sh.Task(4, 6, 2.0, keys="skewed"), sh.cluster(4))
    stats = sh.measured(spark.range(1000), p, "id")
    assert stats["rows"] == 1000 and stats["partitions"] <= 6


def test_combined_in_two_steps(spark):
    p = sh.plan(sh.Task(100, 16, 2.0), sh.cluster(12))
    got = sh.combined(spark.range(100).selectExpr("id % 3 AS k", "id AS v"), p, ["k"], {"n": ("count", "v"), "t": ("sum", "v")}).collect()
    assert p.strategy == "tree_aggregate" and {r.k: (r.n, r.t) for r in got} == {k: (len(range(k, 100, 3)), sum(range(k, 100, 3))) for k in range(3)}


def test_numbers_of_a_hot_key(spark):
    """A key that most rows have is cut by its ties; strings and nulls are numbered too."""
    rows = [(None if i % 50 == 0 else 7.0 if i % 4 else float(i), i, f"k{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "k double, id long, s string")
    want = {i: n + 1 for n, (_, i, _) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.id: r.row_number for r in x.global_row_number(df, "k", "id", buckets=7).collect()} == want
    want = {i: n + 1 for n, (_, i, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}
    assert {r.id: r.row_number for r in x.global_row_number(df, "s", "id", buckets=7).collect()} == want
    ranges = x.ranged(df.where("k = 7"), ["k", "id"], 7).groupBy("__range").count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 120
    assert x.global_row_number(df.limit(0), "k", "id").count() == 0


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    got = {r.k: r.total for r in x.running_sum(df, "k", {"total": "v"}, buckets=5).collect()}
    assert got == {k: k * (k + 1) for k in range(1000)}


def test_break_even():
    assert abs(break_even_hours(100, 0.01, 1.5, 0.05, 9.75) - 10) < 1e-9 and math.isinf(break_even_hours(1, 0.001, 3, 0.05, 1))


def test_depth_first_order(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (7, 8), (4, 4)], "u long, v long")
    assert graphs.depth_first(edges, 0) == [0, 1, 3, 2, 4]


def test_external_map(spark, tmp_path):
    m = keyed.ExternalMap(spark, f"file://{tmp_path}/m", "k long, v string", "k")
    assert m.size() == 0 and m.items().columns == ["k", "v"]
    m.put(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string"), "v")
    m.put(spark.createDataFrame([(1, "d"), (3, "e")], "k long, v string"))
    m.delete(spark.createDataFrame([(3,)], "k long"))
    for _ in range(2):
        assert {r.k: r.v for r in m.items().collect()} == {1: "d", 2: "c"} and m.size() == 2
        assert [tuple(r) for r in m.get(spark.createDataFrame([(2,), (9,)], "k long")).collect()] == [(2, "c")]
        m.compact()
    assert len(m.runs) == 1


def test_snapshots_restore_whole_ones(spark, tmp_path):
    every = x.save_snapshots(spark.range(107), f"file://{tmp_path}/s", "id")
    assert every == 10 and x.restored(spark, f"file://{tmp_path}/s").count() == 100
    assert sorted(r.id for r in x.restored(spark, f"file://{tmp_path}/s", 3).collect()) == list(range(30))


def test_small_frames_are_checked(spark):
    assert x.small(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        x.small(spark.range(6), 5)
