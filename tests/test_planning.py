"""Planner, advisor, lint, profiles and streams."""

import pytest
from pyspark.sql import functions as F

from rootflow import advisor, lint, planner
from rootflow.functions.profile import compared, profiled
from rootflow.planner import plan as p
from rootflow.sources import tables
from rootflow.streaming import batches

GB = 2**30


@pytest.mark.parametrize("text,want", [("512KB", 512 << 10), ("1GB", GB), ("10", 10 << 20), ("1.5 mb", 3 << 19), (7, 7)])
def test_sizes(text, want):
    assert planner.parse_size(text) == want


def test_bad_size():
    with pytest.raises(ValueError):
        planner.parse_size("many")


def test_costs():
    assert p.scan_cost(100_000) == 200_000
    assert p.join_cost(1000, 1000, "hash_join", 1 << 20)[0] == 2000 and p.join_cost(1000, 1000, "nested_loop", 1 << 20)[0] == 12_000_000
    assert p.sort_cost(0, 10) == 0 and p.sort_cost(2e7, 4472) > p.sort_cost(2e7, 1e9)


def test_join_choice():
    assert planner.choose_join(100_000, 100_000, 150_000) == "hash_join"
    assert planner.choose_join(100_000, 100_000, 149_999) == "sort_merge"
    assert planner.choose_join(100_000, 100_000, 300, equi=False) == "nested_loop"
    assert planner.choose_join(100_000, 100_000, 316, equi=False) == "block_nested"


def test_hints_reach_the_plan(spark, sf_dir):
    tables.register_tables(spark, sf_dir, ["customer", "orders"])
    sql = "SELECT c.c_name, sum(o.o_totalprice) AS s FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY c.c_name ORDER BY s"
    plan = lambda q: spark.sql(q)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(planner.hinted(sql, "c", 1e4, 1e6, "1GB"))
    assert "SortMergeJoin" in plan(planner.hinted(sql, "c", 1e9, 1e9, "1MB"))
    assert "SortMergeJoin" in plan(planner.hinted(sql, "c", 1e4, 1e6, "1GB", target="memory"))
    r = planner.plan_query(spark, sql, "1KB")
    kinds = [n.operation for _, n in r.plan.walk()]
    assert kinds.index("sort") < kinds.index("aggregate") < kinds.index("join") < kinds.index("scan")
    assert r.speedup > 1 and "join" in r.explain() and r.rows(spark).where("operation = 'scan'").count() == 2
    assert planner.plan_query(spark, sql, 300).spills


def test_theta_join_keeps_its_join(spark, sf_dir):
    tables.register_tables(spark, sf_dir, ["supplier"])
    r = planner.plan_query(spark, "SELECT 1 AS x FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal", "1GB")
    assert [n.algorithm for _, n in r.plan.walk() if n.operation == "join"] == ["block_nested"]


@pytest.mark.parametrize(
    "memory,metrics,want",
    [(16, {"total_data_gb": 500, "connections": 200}, ("4096MB", "5MB", 400)), (64, {"total_data_gb": 500, "connections": 200}, ("16384MB", "20MB", 400)), (64, {"total_data_gb": 10, "working_set_gb": 5, "connections": 100}, ("5120MB", "40MB", 200))],
)
def test_database_advice(memory, metrics, want):
    s = advisor.advise("database", metrics, advisor.System(memory_gb=memory)).settings
    assert (s["shared_buffers"], s["work_mem"], s["max_connections"]) == want


def test_other_advice(spark):
    j = advisor.advise("jvm", {"latency_sla_ms": 50}, advisor.System(memory_gb=64))
    assert j.settings["-Xmx"] == "32g" and j.settings["-Xmn"] == "181m" and "-XX:MaxGCPauseMillis=50" in j.commands
    a = advisor.advise("application", {"working_set_gb": 50}, advisor.System(memory_gb=64)).settings
    assert a["cache_size"] == 7240 and a["batch_size"] == 655
    assert advisor.advise("kernel", {"request_rate": 20_000}).settings["net.core.somaxconn"] == 65535
    assert advisor.advise("container", {"analytics": True}).settings["shm_size"] == "3g"
    assert int(advisor.advise("spark", {"total_data_gb": 102_400}).settings["spark.sql.shuffle.partitions"]) == 819_200
    with pytest.raises(ValueError):
        advisor.advise("toaster")
    logs = spark.createDataFrame([("SELECT 1",), ("GET /x",), ("UPDATE t",), (None,)], "line string")
    w = advisor.workload_from_logs(logs)
    assert w.kind == "oltp" and round(w.read_ratio, 3) == 0.667 and w.requests == 4
    assert advisor.compare([advisor.advise("database"), advisor.advise("jvm")])[0] == 0
    assert advisor.System.detect().cpus >= 1


SOURCE = '''
def f(n, a, b):
    out = []
    for i in range(n):
        out.append(a[i])
    x = [i * i for i in range(5000)]
    y = [i for i in range(10)]
    z = [i for i in range(0, 5000)]
    return sorted(out), a @ b

def g(df):
    for r in df.collect():
        print(r)

@udf("int")
def h(v):
    return v + 1
'''


def test_lint():
    found = lint.review(SOURCE)
    assert [(f.kind, f.line) for f in found] == [("buffer_size", 4), ("checkpoint", 4), ("streaming", 6), ("streaming", 8), ("cache_blocking", 9), ("external_memory", 9), ("driver_collect", 12), ("driver_loop", 12), ("python_udf", 15)]
    assert {f.kind for f in lint.selected(found)} == {"checkpoint", "streaming", "cache_blocking", "driver_collect", "driver_loop", "python_udf"}
    assert "line 4 in f" in lint.report(found) and lint.report([]) == "nothing found"

    @lint.advised
    def total(n):
        s = 0
        for i in range(n):
            s += i
        return s

    assert total(4) == 6 and [f.kind for f in total.advice] == ["checkpoint"]


def test_profiles(spark):
    pr = profiled(lambda: spark.range(1000))
    assert pr.seconds > 0 and pr.level == "L1"
    rows = compared(spark, {"a": lambda: spark.range(10), "b": lambda: spark.range(20)}, "a").collect()
    assert [r.strategy for r in rows] == ["a", "b"] and rows[0].time_added == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("GET /\nPOST /\n")
    assert tables.read_logs(spark, str(tmp_path / "a.log")).count() == 2
    tables.write_json(spark.range(3), str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j"), "id long").count() == 3
    for style, want in (("json", '"a": 1'), ("conf", "a = 1"), ("spark", "a 1"), ("shell", "sysctl -w a=1")):
        tables.write_settings({"a": 1}, str(tmp_path / "s"), style)
        assert want in (tmp_path / "s").read_text()
    with pytest.raises(ValueError):
        tables.write_settings({}, str(tmp_path / "s"), "xml")


def test_streams(spark, sf_dir, tmp_path):
    schema = tables.table(spark, sf_dir, "events").schema
    stream = batches.read_stream(spark, sf_dir, schema, "events.parquet")
    seen = []
    q = batches.for_each_buffer(stream, lambda df, i: seen.append((i, df.count())), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sum(n for _, n in seen) == 1000
    # Nothing is new after a restart from the checkpoint.
    again = batches.for_each_buffer(stream, lambda df, i: seen.append((i, df.count())), str(tmp_path / "c"))
    again.awaitTermination(60)
    assert sum(n for _, n in seen) == 1000
    out = batches.running_totals(stream.where("event_type = 'purchase'"), "value").writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    out.awaitTermination(60)
    want = tables.table(spark, sf_dir, "events").where("event_type = 'purchase'").agg(F.count(F.lit(1)), F.sum(F.col("value").cast("decimal(18,2)"))).first()
    assert tuple(spark.table("totals").first()) == tuple(want)
    late = batches.windowed_counts(stream, "ts", "1 day", "1 hour", "event_type")
    assert late.isStreaming and "window" in late.columns
