"""Relational queries: scans, filters, joins, aggregates, sorts, sets, batches and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootflow.operators import external as x
from rootflow.operators import keyed
from rootflow.registry import register
from rootflow.sources.tables import table, table_stats

#: Money is summed as decimals, so sums don't depend on their order.
MONEY = "decimal(18,2)"
TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


def money_sum(c: str) -> Column:
    return F.sum(F.col(c).cast(MONEY)).cast("double")


def rows(df: Column | None = None) -> Column:
    return F.count(F.lit(1)).cast("long")


_STATS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({n} AS BIGINT) AS n_columns, CAST({20 * n} AS BIGINT) AS row_size, CAST(count(*) * {20 * n} AS BIGINT) AS total_size FROM {t}" for t, n in zip(TABLES, (5, 11, 3, 6, 6, 2, 4), strict=True))


@register("table_stats", _STATS)
def q_table_stats(spark: SparkSession, d: str) -> DataFrame:
    return table_stats(spark, d, TABLES)


# ---- scans, filters, projections ------------------------------------------------------------------


@register("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4711 OR o_orderkey = 77")
def q_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderkey").isin(4711, 77)).select("o_orderkey", "o_custkey", "o_totalprice")


@register("filter_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q_filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@register("filter_like_and", "SELECT page_id, url FROM pages WHERE url LIKE '%example.org%' AND page_id > 10")
def q_filter_like_and(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("url").like("%example.org%") & (F.col("page_id") > 10)).select("page_id", "url")


@register("filter_scale", "SELECT o_orderkey, o_totalprice * 2.0::DOUBLE AS scaled FROM orders WHERE o_totalprice > 1000")
def q_filter_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_totalprice > 1000").select("o_orderkey", (F.col("o_totalprice") * 2.0).alias("scaled"))


@register("filter_contains", "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'license')")
def q_filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").contains("license")).select("doc_id", "n_chars")


@register("classify_case", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'problem' WHEN event_type = 'purchase' THEN 'sale' WHEN event_type IN ('view', 'click') THEN 'visit' ELSE 'unknown' END AS class FROM events")
def q_classify_case(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "error", "problem").when(e == "purchase", "sale").when(e.isin("view", "click"), "visit").otherwise("unknown")
    return table(spark, d, "events").select("event_id", kind.alias("class"))


@register("project_compute", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS net FROM lineitem")
def q_project_compute(spark: SparkSession, d: str) -> DataFrame:
    net = F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast(MONEY))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", net.cast("double").alias("net"))


@register("update_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Processed' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) + 1 END AS processed_at FROM orders")
def q_update_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "O", "Processed").otherwise(s).alias("status"), F.when(s == "O", F.date_add(F.col("o_orderdate").cast("date"), 1)).alias("processed_at"))


@register("expensive_compute", "SELECT o_orderkey, round(sqrt(sin(o_orderkey * 2.5::DOUBLE) * cos(o_orderkey * 2.5::DOUBLE) + 1), 6) AS output FROM orders")
def q_expensive_compute(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_orderkey") * F.lit(2.5)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sqrt(F.sin(v) * F.cos(v) + 1), 6).alias("output"))


@register("root_or_zero", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN sqrt(c_acctbal) ELSE 0 END, 6) AS root FROM customer")
def q_root_or_zero(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(F.when(v > 0, F.sqrt(v)).otherwise(0.0), 6).alias("root"))


@register("skip_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 1000")
def q_skip_rows(spark: SparkSession, d: str) -> DataFrame:
    # An offset alone would bring all rows to one task: rows are numbered instead.
    return x.global_row_number(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").where("row_number > 1000").select("o_orderkey")


# ---- joins ----------------------------------------------------------------------------------------


@register("join_external", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def q_join_external(spark: SparkSession, d: str) -> DataFrame:
    return x.join_external(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey").select("c_custkey", "o_orderkey", "o_totalprice")


_NULLED = "(SELECT o_orderkey, nullif(o_custkey, 7) AS k FROM orders)"


@register("join_null_safe", f"SELECT a.c_custkey, count(*) AS n FROM (SELECT c_custkey, nullif(c_custkey, 7) AS k FROM customer) a JOIN {_NULLED} b ON a.k IS NOT DISTINCT FROM b.k GROUP BY 1")
def q_join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select("c_custkey", F.nullif("c_custkey", F.lit(7)).alias("k"))
    b = table(spark, d, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("j"))
    return x.join_external(b, a, "j", "k", null_safe=True).groupBy("c_custkey").agg(rows().alias("n"))


@register("join_inner_count", "SELECT count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey")
def q_join_inner_count(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").select("c_custkey")
    return x.join_external(o, c, "o_custkey", "c_custkey").agg(rows().alias("n"))


@register("join_group_sum_order", "SELECT *, row_number() OVER (ORDER BY total DESC, c_name) AS place FROM (SELECT c_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_name)")
def q_join_group_sum_order(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    sums = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_name").agg(money_sum("o_totalprice").alias("total"))
    ranked = x.global_row_number(sums.withColumn("neg", -F.col("total")), "neg", "c_name", name="place")
    return ranked.select("c_name", "total", F.col("place").cast("long").alias("place"))


_LEFT = "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


@register("left_join_group_topk", f"SELECT * FROM ({_LEFT}) ORDER BY n DESC, o_orderkey LIMIT 10")
def q_left_join_group_topk(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows().alias("m"))
    o = table(spark, d, "orders").select("o_orderkey").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return x.top_k(o.select("o_orderkey", F.coalesce("m", F.lit(0)).alias("n")), 10, F.desc("n"), F.asc("o_orderkey"))


@register("left_join_counts", _LEFT)
def q_left_join_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows().alias("m"))
    o = table(spark, d, "orders").select("o_orderkey").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("m", F.lit(0)).alias("n"))


@register("join_multiway", "SELECT r_name, n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def q_join_multiway(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    # Lines are summed by order first: a row per order and not per line meets the customers.
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("l_extendedprice").cast(MONEY)).alias("s"))
    o = per_order.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = o.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("m").alias("n"), F.sum("s").alias("s"))
    n = c.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name", "n_name").agg(F.sum("n").cast("long").alias("n"), F.sum("s").cast("double").alias("total"))


@register("multijoin_group_count", "SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey")
def q_multijoin_group_count(spark: SparkSession, d: str) -> DataFrame:
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("m"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    c = table(spark, d, "customer").select("c_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("m").cast("long").alias("lines"))


@register("self_join_equi", "SELECT a.o_custkey, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey < b.o_orderkey GROUP BY 1")
def q_self_join_equi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    a, b = o.alias("a"), o.alias("b")
    pairs = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")))
    return pairs.groupBy(F.col("a.o_custkey").alias("o_custkey")).agg(rows().alias("n"))


@register("theta_self_join", "SELECT a.s_suppkey AS first, b.s_suppkey AS second FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def q_theta_self_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_acctbal") < F.col("b.s_acctbal"))
    return a.join(b, on).select(F.col("a.s_suppkey").alias("first"), F.col("b.s_suppkey").alias("second"))


# ---- aggregates -----------------------------------------------------------------------------------


@register("group_external_count_sum", "SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer GROUP BY 1")
def q_group_external_count_sum(spark: SparkSession, d: str) -> DataFrame:
    return x.group_by_external(table(spark, d, "customer"), ["c_nationkey"], rows().alias("n"), money_sum("c_acctbal").alias("total"))


#: Values of an order key for one row of a collected group.
WIDTH = 1 << 20


@register("group_external_collect", f"SELECT o_custkey, o_orderkey // {WIDTH} AS block, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY 1, 2")
def q_group_external_collect(spark: SparkSession, d: str) -> DataFrame:
    g = x.group_rows_external(table(spark, d, "orders"), ["o_custkey"], [], ["o_orderkey"], WIDTH)
    return g.select("o_custkey", "block", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("order_keys"))


@register("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean FROM lineitem GROUP BY 1, 2")
def q_agg_basic(spark: SparkSession, d: str) -> DataFrame:
    mean = F.round(money_sum("l_extendedprice") / F.count(F.lit(1)), 4)
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(rows().alias("n"), money_sum("l_quantity").alias("qty"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), mean.alias("mean"))


@register("category_count_avg", "SELECT o_orderpriority, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' GROUP BY 1")
def q_category_count_avg(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderdate > timestamp_ntz'1995-01-01'")
    return o.groupBy("o_orderpriority").agg(rows().alias("n"), F.round(money_sum("o_totalprice") / F.count(F.lit(1)), 4).alias("mean"))


@register("top_error_codes", "SELECT json_extract_string(props, '$.k') AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, code LIMIT 10")
def q_top_error_codes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'").select(F.get_json_object("props", "$.k").alias("code"))
    return x.top_k(e.groupBy("code").agg(rows().alias("n")), 10, F.desc("n"), F.asc("code"))


@register("distinct_count", "SELECT count(DISTINCT user_id) AS users, count(*) AS n FROM events")
def q_distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), rows().alias("n"))


@register("event_visitor_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def q_event_visitor_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(rows().alias("n"))


@register("stream_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY 1")
def q_stream_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(rows().alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 4).alias("variance"))


@register("bucket_group", f"SELECT 'group_' || CAST(floor(o_totalprice / 100) AS BIGINT) AS bucket, o_orderkey // {WIDTH} AS block, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY 1, 2")
def q_bucket_group(spark: SparkSession, d: str) -> DataFrame:
    b = F.concat(F.lit("group_"), F.floor(F.col("o_totalprice") / 100).cast("string"))
    g = x.group_rows_external(table(spark, d, "orders"), [b.alias("bucket")], [], ["o_orderkey"], WIDTH)
    keys = F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",")
    return g.select("bucket", "block", F.size("rows").cast("long").alias("n"), keys.alias("order_keys"))


@register("log_read_ratio", "SELECT count(*) FILTER (event_type IN ('view', 'click')) AS reads, count(*) FILTER (event_type IN ('purchase', 'signup')) AS writes, round(count(*) FILTER (event_type IN ('view', 'click')) / count(*) FILTER (event_type IN ('view', 'click', 'purchase', 'signup')), 6) AS ratio FROM events")
def q_log_read_ratio(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    a = table(spark, d, "events").agg(F.count_if(e.isin("view", "click")).alias("reads"), F.count_if(e.isin("purchase", "signup")).alias("writes"))
    return a.select("reads", "writes", F.round(F.try_divide(F.col("reads"), F.col("reads") + F.col("writes")), 6).alias("ratio"))


# ---- sort, top-k, sets, batches, folds ------------------------------------------------------------


@register("sort_external", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def q_sort_external(spark: SparkSession, d: str) -> DataFrame:
    o = x.global_row_number(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", name="place")
    return o.select("o_orderkey", F.col("place").cast("long").alias("place"))


@register("order_only", "SELECT o_orderkey, o_orderdate FROM orders")
def q_order_only(spark: SparkSession, d: str) -> DataFrame:
    return x.order_by_external(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", tiebreak=["o_orderkey"])


@register("topk_smallest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def q_topk_smallest(spark: SparkSession, d: str) -> DataFrame:
    return x.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, F.asc("o_totalprice"), F.asc("o_orderkey"))


@register("topk_desc", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5")
def q_topk_desc(spark: SparkSession, d: str) -> DataFrame:
    return x.top_k(table(spark, d, "orders").groupBy("o_custkey").agg(rows().alias("n")), 5, F.desc("n"), F.asc("o_custkey"))


@register("distinct_external", "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def q_distinct_external(spark: SparkSession, d: str) -> DataFrame:
    return x.distinct_external(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_shipdate")


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))


_A, _B = "SELECT c_custkey AS k FROM customer", "SELECT o_custkey AS k FROM orders"


@register("union_external", f"{_A} UNION {_B}")
def q_union_external(spark: SparkSession, d: str) -> DataFrame:
    return x.union_external(*_keys(spark, d))


@register("intersect_ext", f"{_A} INTERSECT {_B}")
def q_intersect_ext(spark: SparkSession, d: str) -> DataFrame:
    return x.intersect_external(*_keys(spark, d))


@register("except_ext", f"{_A} EXCEPT {_B}")
def q_except_ext(spark: SparkSession, d: str) -> DataFrame:
    return x.except_external(*_keys(spark, d))


@register("batch_sqrt_n", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // CAST(floor(sqrt((SELECT count(*) FROM orders))) AS BIGINT) AS BIGINT) AS batch_id FROM orders")
def q_batch_sqrt_n(spark: SparkSession, d: str) -> DataFrame:
    return x.batch_by_sqrt_n(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@register("buffer_async_batches", "SELECT batch_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 1000 AS BIGINT) AS batch_id FROM events) GROUP BY 1")
def q_buffer_async_batches(spark: SparkSession, d: str) -> DataFrame:
    b = x.buffer_batches(table(spark, d, "events").select("event_id"), "event_id")
    return b.groupBy("batch_id").agg(rows().alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@register("fold_checkpoint_total", "SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def q_fold_checkpoint_total(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(rows().alias("n"), money_sum("o_totalprice").alias("total"))


@register("fold_checkpoint_snapshots", "SELECT n, CAST(total AS DOUBLE) AS total FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderkey) AS total FROM orders) WHERE n % CAST(floor(sqrt((SELECT count(*) FROM orders))) AS BIGINT) = 0")
def q_fold_checkpoint_snapshots(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = x.running_snapshots(o, F.col("o_totalprice").cast(MONEY), "o_orderkey", every=max(1, math.isqrt(o.count())))
    return s.select(F.col("n").cast("long").alias("n"), F.col("total").cast("double").alias("total"))


@register("fold_ordered", "WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey % 1000 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), f AS (SELECT o_custkey, i, v % 9973 AS r FROM n WHERE i = 1 UNION ALL SELECT n.o_custkey, n.i, (f.r * 31 + n.v) % 9973 FROM f JOIN n ON n.o_custkey = f.o_custkey AND n.i = f.i + 1) SELECT o_custkey, CAST(arg_max(r, i) AS BIGINT) AS result FROM f GROUP BY 1")
def q_fold_ordered(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return x.fold(o, F.lit(0).cast("long"), lambda a, v: (a * 31 + v) % 9973, F.col("o_orderkey") % 1000, ["o_orderkey"], ["o_custkey"]).select("o_custkey", "result")


@register("checkpointed_list", "SELECT o_orderkey, o_custkey FROM orders")
def q_checkpointed_list(spark: SparkSession, d: str) -> DataFrame:
    return x.to_checkpointed(table(spark, d, "orders").select("o_orderkey", "o_custkey"))


@register("salted_group_sum", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1")
def q_salted_group_sum(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_quantity").cast("long").alias("qty"))
    return x.salted_sum(lines, ["l_returnflag"], "qty")


# ---- keyed tables ---------------------------------------------------------------------------------


@register("kv_last_write_wins", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def q_kv_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return keyed.last_write_wins(table(spark, d, "events"), "user_id", "value", "ts", "event_id")


@register("kv_lookup", "SELECT k.user_id, coalesce(t.n, 0) AS n FROM (SELECT range AS user_id FROM range(0, 2000, 7)) k LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) t USING (user_id)")
def q_kv_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy("user_id").agg(rows().alias("n"))
    keys = spark.range(0, 2000, 7).withColumnRenamed("id", "user_id")
    return keyed.lookup(t, keys, "user_id", F.lit(0).cast("long"), "n").select("user_id", "n")


@register("kv_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def q_kv_range(spark: SparkSession, d: str) -> DataFrame:
    return keyed.range_lookup(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 900)


@register("prefix_lookup", "SELECT page_id, url FROM pages WHERE starts_with(url, 'http://blog.')")
def q_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    return keyed.prefix_lookup(table(spark, d, "pages").select("page_id", "url"), "url", "http://blog.")
