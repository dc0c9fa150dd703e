"""Further queries: theta joins, log files, value lists, key-value stores, restored snapshots, and function families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootflow.operators import external as x
from rootflow.operators import keyed
from rootflow.plans.relational import MONEY, rows
from rootflow.registry import register
from rootflow.sources.tables import read_json, read_logs, shared_path, table, write_json


@register("theta_like_limit", "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE a.n_name LIKE '%A%' AND b.n_name LIKE '%I%' ORDER BY 1, 2 LIMIT 20")
def q_theta_like_limit(spark: SparkSession, d: str) -> DataFrame:
    """A join by order alone, of a table of nations; its size is checked, as such a join compares all pairs."""
    n = x.small(table(spark, d, "nation").select("n_nationkey", "n_name"), 10_000)
    a, b = n.where("n_name LIKE '%A%'").alias("a"), n.where("n_name LIKE '%I%'").alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return x.top_k(pairs.select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second")), 20, F.col("first"), F.col("second"))


_LINES = "SELECT event_id, '2024-01-01 [' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END || '] user ' || user_id % 10 || ' ' || event_type AS line FROM events"


@register("log_file_messages", f"SELECT regexp_extract(line, '\\[([A-Z]+)\\]', 1) AS level, regexp_extract(line, '\\] (.*)$', 1) AS message, count(*) AS n FROM ({_LINES}) WHERE line LIKE '%ERROR%' OR line LIKE '%WARN%' GROUP BY 1, 2")
def q_log_file_messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as text files, read back and counted by level and message."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    path = shared_path(spark, "logs")
    table(spark, d, "events").select(F.concat(F.lit("2024-01-01 ["), level, F.lit("] user "), F.col("user_id") % 10, F.lit(" "), "event_type")).write.text(path)
    lines = read_logs(spark, path).where(F.contains("line", F.lit("ERROR")) | F.contains("line", F.lit("WARN")))
    return lines.groupBy(F.regexp_extract("line", r"\[([A-Z]+)\]", 1).alias("level"), F.regexp_extract("line", r"\] (.*)$", 1).alias("message")).agg(rows().alias("n"))


@register("json_round_trip", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "results")
    write_json(table(spark, d, "events").groupBy("user_id", "event_type").agg(rows().alias("n")), path)
    return read_json(spark, path, "user_id long, event_type string, n long")


@register("large_dataset_values", "WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS v FROM orders WHERE o_totalprice > 100000), m AS (SELECT round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS mean FROM s) SELECT o_orderkey, CAST(v AS DOUBLE) AS value, 'group_' || CAST(floor(CAST(v AS DOUBLE) / 100) AS BIGINT) AS bucket, row_number() OVER (PARTITION BY floor(CAST(v AS DOUBLE) / 100) ORDER BY v, o_orderkey) AS place, round(CAST(v AS DOUBLE) - mean, 2) AS deviation FROM s, m")
def q_large_dataset_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value with its group, its place in the group's order and its deviation from the mean, as rows, not lists."""
    from pyspark.sql import Window

    s = table(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey", (F.col("o_totalprice").cast(MONEY) * 2).alias("v"))
    mean = s.agg(F.round(F.sum("v").cast("double") / F.count(F.lit(1)), 4).alias("mean"))
    value, bucket = F.col("v").cast("double"), F.floor(F.col("v").cast("double") / 100)
    place = F.row_number().over(Window.partitionBy(bucket).orderBy("v", "o_orderkey")).cast("long")
    return s.join(F.broadcast(mean)).select("o_orderkey", value.alias("value"), F.concat(F.lit("group_"), bucket.cast("string")).alias("bucket"), place.alias("place"), F.round(value - F.col("mean"), 2).alias("deviation"))


@register("external_map", "WITH e AS (SELECT user_id, event_id FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, event_id % 3 AS run, max(event_id) AS last_event FROM e GROUP BY 1, 2) SELECT user_id, arg_max(last_event, run) AS last_event FROM r WHERE user_id % 5 <> 0 GROUP BY 1")
def q_external_map(spark: SparkSession, d: str) -> DataFrame:
    """Writes in runs, with deletions, read back: of each user the last event, no errors, of its last run; every fifth user is deleted."""
    store = keyed.ExternalMap(spark, shared_path(spark, "map"), "user_id long, last_event long", "user_id")
    e = table(spark, d, "events").where("event_type <> 'error'").select("user_id", F.col("event_id").alias("last_event"))
    for k in range(3):
        store.put(e.where(F.col("last_event") % 3 == k), "last_event")
    store.delete(e.where("user_id % 5 = 0").select("user_id").distinct())
    best = store.items()
    return best.select("user_id", "last_event")


@register("map_stats", "SELECT count(DISTINCT user_id) AS size, CAST(count(*) AS BIGINT) AS writes, CASE WHEN count(DISTINCT user_id) <= 4 THEN 'array' WHEN count(DISTINCT user_id) <= 83886 THEN 'btree' ELSE 'hash' END AS structure FROM events")
def q_map_stats(spark: SparkSession, d: str) -> DataFrame:
    return keyed.stats(table(spark, d, "events").select("user_id", "event_id"), "user_id")


_MADE = [(n, s) for n, s in ((3, "array"), (100, "btree"), (83_887, "hash"), (2_000_000_000, "external"))]


@register("structure_factory", f"SELECT n::BIGINT AS n, structure, CAST(CASE WHEN structure = 'hash' THEN ceil(ceil(1.33 * n) / 4) * 4 END AS BIGINT) AS slots FROM (VALUES {', '.join(map(str, _MADE))}) AS t(n, structure)")
def q_structure_factory(spark: SparkSession, d: str) -> DataFrame:
    made = [(n, s := keyed.structure_for(n), keyed.hash_slots(n) if s == "hash" else None) for n, _ in _MADE]
    return spark.createDataFrame(made, "n long, structure string, slots long")


@register("access_patterns", "WITH a AS (SELECT user_id, list(CASE WHEN event_id - p BETWEEN 1 AND 50 THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY event_id) AS s FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1) SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, s), lambda m, v: 0.9::DOUBLE * m + 0.1::DOUBLE * v), 9) AS sequential FROM a")
def q_access_patterns(spark: SparkSession, d: str) -> DataFrame:
    """A moving average, for each user, of whether an access is near the one before it."""
    return keyed.sequential_share(table(spark, d, "events"), "user_id", "event_id", 50).withColumn("sequential", F.round("sequential", 9))


@register("restored_snapshot", "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM n WHERE k <= n // CAST(floor(sqrt(n)) AS BIGINT) * CAST(floor(sqrt(n)) AS BIGINT)")
def q_restored_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rows saved in snapshots of the root of their number; what whole snapshots hold comes back."""
    path = shared_path(spark, "snapshots")
    x.save_snapshots(table(spark, d, "orders").select("o_orderkey"), path, "o_orderkey")
    return x.restored(spark, path)


# ---- function families ----------------------------------------------------------------------------


@register("date_functions", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS due, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def q_date_functions(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, 30).alias("due"), F.year(day).cast("long").alias("y"), F.quarter(day).cast("long").alias("q"), F.date_format(day, "yyyy-MM").alias("month"), F.datediff(day, F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@register("map_functions", "SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN 1 END), 0) AS BIGINT) AS views FROM events GROUP BY 1")
def q_map_functions(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type as a map column: its size and one entry."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(rows().alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # at most as many entries as types
    return maps.select("user_id", F.size("m").cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(0)).alias("views"))


@register("dirty_casts", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, TRY_CAST(o_orderpriority AS INTEGER) AS broken, TRY_CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE) AS number FROM orders")
def q_dirty_casts(spark: SparkSession, d: str) -> DataFrame:
    """Text that isn't a number is null, whatever the session's ANSI mode."""
    c = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.substring(c, 1, 1).try_cast("int").alias("rank"), c.try_cast("int").alias("broken"), F.col("o_orderkey").cast("string").try_cast("double").alias("number"))


@register("json_functions", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS packed FROM events")
def q_json_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("packed"))


@register("lookup_batch", "SELECT c.o_orderkey, o.o_orderkey IS NOT NULL AS found, o.o_totalprice FROM (SELECT o_orderkey + 1 AS o_orderkey FROM orders) c LEFT JOIN orders o USING (o_orderkey)")
def q_lookup_batch(spark: SparkSession, d: str) -> DataFrame:
    """A look-up of as many keys as there are rows, some of them missing."""
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(True).alias("found"))
    keys = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("o_orderkey"))
    return keyed.lookup(t, keys, "o_orderkey", F.lit(False), "found").select("o_orderkey", "found", "o_totalprice")
