"""Memory-bounded sequence operators as DataFrame plans.

Spark spills by itself, so a buffer size never changes a result here: it is checked, and where it means
anything it sets batch numbers, checkpoints or hints.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.functions.intervals import interval

Key = str | Column
#: Batch lengths where the number of rows isn't known.
UNKNOWN_BATCH, UNKNOWN_STREAM_BATCH = math.isqrt(1000), math.isqrt(1_000_000)


def _checked(buffer_size: int | None) -> None:
    if buffer_size is not None and buffer_size < 1:
        raise ValueError("a buffer holds one row at least")


def order_by_external(df: DataFrame, *keys: Key, tiebreak: Sequence[Key] = (), buffer_size: int | None = None) -> DataFrame:
    """Global order: range partitioning and an external sort in each partition. Ties need a tiebreak to be stable."""
    _checked(buffer_size)
    return df.orderBy(*keys, *tiebreak)


def group_by_external(df: DataFrame, keys: Sequence[Key], *aggregates: Column, buffer_size: int | None = None) -> DataFrame:
    """One row per key (null is a key), however often a key comes again. Sums and counts combine before the shuffle."""
    _checked(buffer_size)
    return df.groupBy(*keys).agg(*aggregates)


def group_rows_external(df: DataFrame, keys: Sequence[Key], columns: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """One row per key with its rows as an ordered array, for groups that fit into a row.

    With a width, one row per key and ``block``: the first order column, a whole number, is cut every ``width``
    values. Of distinct numbers no row then holds more than ``width``, and a key that a third of all rows have is
    dealt to as many tasks as it needs. A key's blocks in order are its group."""
    fields = [*order, *[c for c in columns if c not in order]]
    block = [] if width is None else [F.floor(F.col(order[0]) / F.lit(width)).cast("long").alias("block")]
    return df.groupBy(*keys, *block).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))


def join_external(left: DataFrame, right: DataFrame, left_key: str, right_key: str, null_safe: bool = False, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Equi-join. ``null_safe`` lets null match null, as lookups by key do."""
    r = right.hint(hint) if hint else right
    on = left[left_key].eqNullSafe(r[right_key]) if null_safe else left[left_key] == r[right_key]
    return left.join(r, on, how)


def distinct_external(df: DataFrame, *columns: str, max_memory_items: int | None = None) -> DataFrame:
    _checked(max_memory_items)
    return (df.select(*columns) if columns else df).distinct()


def union_external(first: DataFrame, second: DataFrame) -> DataFrame:
    """Set union: every row once."""
    return first.union(second).distinct()


def intersect_external(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.intersect(second)


def except_external(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.subtract(second)


def ranged(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Adds ``__range``: numbers of ranges of rows in order of the columns, ascending, nulls first.

    Spark's own sampled range partitioning makes the ranges, over all columns, so a key that many rows have is cut
    by the columns after it. The checkpoint fixes them: a retried task can't deal rows in another way."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).transform(_fixed)


def _fixed(df: DataFrame) -> DataFrame:
    """Behind a reliable checkpoint where the session has a folder for it; in memory and on disk else."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if found:
            spark.sparkContext.setCheckpointDir(found)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK)


def global_row_number(df: DataFrame, key: str, *ties: str, name: str = "row_number", buckets: int | None = None) -> DataFrame:
    """Numbers rows from 1 in order of a key and its ties, without sending all rows, or all rows of one key, to one task.

    Rows are numbered inside each range, and the ranges' sizes (one row per range) give what to add."""
    parts = ranged(df, [key, *ties], buckets)
    sizes = parts.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties))
    return parts.withColumn("__within", within).join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


def running_sum(df: DataFrame, key: str, sums: dict[str, str], *ties: str, buckets: int | None = None) -> DataFrame:
    """Adds running sums (result name: column) in order of a key: inside each range, and what the ranges before add up to."""
    parts = ranged(df, [key, *ties], buckets)
    all_before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    starts = totals.select("__range", *[F.sum(f"__t_{k}").over(all_before).alias(f"__b_{k}") for k in sums])
    so_far = Window.partitionBy("__range").orderBy(key, *ties)
    out = parts.join(F.broadcast(starts), "__range")
    for k, c in sums.items():
        out = out.withColumn(k, F.sum(c).over(so_far) + F.coalesce(F.col(f"__b_{k}"), F.lit(0)))
    return out.drop("__range", *[f"__b_{k}" for k in sums])


def batch_by_sqrt_n(df: DataFrame, key: str, *ties: str, total: int | None = None, size: int | None = None) -> DataFrame:
    """Adds ``batch_id``: runs of max(1, floor(sqrt(rows))) rows in key order; the last may be short."""
    size = size or max(1, math.isqrt(df.count() if total is None else total))
    numbered = global_row_number(df, key, *ties, name="__row")
    return numbered.withColumn("batch_id", F.floor((F.col("__row") - 1) / F.lit(size)).cast("long")).drop("__row")


def buffer_batches(df: DataFrame, key: str, *ties: str, size: int = UNKNOWN_STREAM_BATCH) -> DataFrame:
    """The bounded form of count-based micro-batches."""
    return batch_by_sqrt_n(df, key, *ties, size=size)


def fold(df: DataFrame, seed: Column, step: Callable[[Column, Column], Column], element: Column, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """An ordered fold of each key's elements (collected, so for groups that fit into a row); keys none: of all."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*order, element.alias("__e")))), lambda x: x["__e"])
    return df.groupBy(*keys).agg(F.aggregate(ordered, seed, step).alias("result"))


def running_snapshots(df: DataFrame, value: Column, key: str, *ties: str, every: int | None = None) -> DataFrame:
    """Snapshots (n, total) of a running sum after every k-th row in key order: what a checkpointed fold keeps.

    Sums combine per interval; the intervals' sums run on range by range."""
    every = every or interval(df.count())
    numbered = global_row_number(df.withColumn("__v", value), key, *ties, name="__row")
    whole = numbered.withColumn("__k", F.floor((F.col("__row") - 1) / F.lit(every)).cast("long"))
    sums = whole.groupBy("__k").agg(F.sum("__v").alias("__s"), F.count(F.lit(1)).alias("__n"))
    total = running_sum(sums, "__k", {"total": "__s"})
    return total.where(F.col("__n") == every).select(((F.col("__k") + 1) * every).alias("n"), "total")


def postings(df: DataFrame, word: str, document: str, width: int = 4096) -> DataFrame:
    """Rows (word, block, documents): each word's distinct documents in order, a row for each ``width`` of document ids.

    No row holds more than ``width`` ids, and the blocks of a word that a third of all documents hold are dealt
    to as many tasks as they need."""
    block = F.floor(F.col(document) / F.lit(width)).cast("long")
    return df.groupBy(F.col(word).alias("word"), block.alias("block")).agg(F.sort_array(F.collect_set(document)).alias("documents"))


def to_checkpointed(df: DataFrame) -> DataFrame:
    """The rows behind a reliable checkpoint: lineage is cut and a lost executor costs a read."""
    return df.checkpoint(eager=True)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """A sort and a limit that Spark runs as a heap of k rows per task."""
    return df.orderBy(*order).limit(k)


def salted_sum(df: DataFrame, keys: Sequence[str], value: str, salts: int = 32) -> DataFrame:
    """A sum in two levels, for keys so hot that even their partial sums meet in one task."""
    first = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).groupBy(*keys, "__salt").agg(F.sum(value).alias("__p"))
    return first.groupBy(*keys).agg(F.sum("__p").alias(value))


def small(df: DataFrame, most: int) -> DataFrame:
    """The frame, if it has no more rows than stated; for what compares or copies all its rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def save_snapshots(df: DataFrame, path: str, key: str, *ties: str, every: int | None = None) -> int:
    """Writes rows in key order as numbered snapshots of ``every`` rows (the root of their number); gives that number."""
    every = every or max(1, math.isqrt(df.count()))
    numbered = batch_by_sqrt_n(df, key, *ties, size=every).withColumnRenamed("batch_id", "__snapshot")
    full = F.count(F.lit(1)).over(Window.partitionBy("__snapshot")) == every
    numbered.withColumn("__whole", full.cast("int")).write.partitionBy("__whole").parquet(path)
    return every


def restored(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The rows of whole snapshots, of the first so many where stated; an unfinished one is left out."""
    rows = spark.read.parquet(path).where("__whole = 1")
    return (rows if upto is None else rows.where(F.col("__snapshot") < upto)).drop("__snapshot", "__whole")
