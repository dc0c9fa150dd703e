"""Key -> value tables: last write wins, look-ups, prefixes, and which structure a size calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.functions.intervals import Hierarchy

ARRAY_MOST = 4


def last_write_wins(writes: DataFrame, key: str, value: str, *sequence: str, tombstone: Column | None = None) -> DataFrame:
    """The value of each key's last write; keys whose last write is a tombstone are gone."""
    last = writes.withColumn("__gone", tombstone if tombstone is not None else F.lit(False)).groupBy(key).agg(F.max_by(F.struct(value, "__gone"), F.struct(*sequence)).alias("x"))
    return last.where(~F.col("x.__gone")).select(key, F.col(f"x.{value}").alias(value))


def lookup(table: DataFrame, keys: DataFrame, key: str, default: Column | None = None, value: str | None = None) -> DataFrame:
    """All asked keys with their rows; a missing value may have a default."""
    found = keys.join(table, key, "left")
    return found.withColumn(value, F.coalesce(F.col(value), default)) if value and default is not None else found


def prefix_lookup(table: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key starts with a prefix; the scan gets the predicate."""
    return table.where(F.col(key).startswith(prefix))


def range_lookup(table: DataFrame, key: str, low, high) -> DataFrame:
    return table.where(F.col(key).between(low, high))


def structure_for(n: int, hierarchy: Hierarchy = Hierarchy(), entry_bytes: int = 100) -> str:
    """Smallest structure that serves n entries: array, then tree within the last cache, then hash within a tenth of RAM, then disk."""
    if n <= ARRAY_MOST:
        return "array"
    if n <= hierarchy.l3 // entry_bytes:
        return "btree"
    return "hash" if n <= hierarchy.ram // 10 else "external"


def structure_column(n: Column, hierarchy: Hierarchy = Hierarchy(), entry_bytes: int = 100) -> Column:
    return F.when(n <= ARRAY_MOST, "array").when(n <= hierarchy.l3 // entry_bytes, "btree").when(n <= hierarchy.ram // 10, "hash").otherwise("external")


def hash_slots(n: int) -> int:
    """Slots for n entries at three quarters full, in multiples of four."""
    need = -(-133 * n // 100)
    return -(-need // 4) * 4


def stats(writes: DataFrame, key: str) -> DataFrame:
    """One row: keys, writes, and the structure that so many keys call for."""
    per_key = writes.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("__n"), F.lit(0)).alias("writes")).withColumn("structure", structure_column(F.col("size")))


def sequential_share(accesses: DataFrame, by: str, place: str, near: int, weight: float = 0.1) -> DataFrame:
    """Rows (by, sequential): a moving average of whether an access lies within ``near`` after the one before it."""
    gap = F.col(place) - F.lag(place).over(Window.partitionBy(by).orderBy(place))
    steps = accesses.select(by, F.col(place).alias("__at"), F.coalesce(gap.between(1, near), F.lit(False)).cast("double").alias("__s"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("__at", "__s"))), lambda r: r["__s"])
    return steps.groupBy(by).agg(F.aggregate(order, F.lit(0.0), lambda m, v: m * (1 - weight) + v * weight).alias("sequential"))


class ExternalMap:
    """A key -> values table on disk: writes and deletions are runs of Parquet files, the last run of a key wins.

    ``compact`` rewrites all runs as one. Runs are written once and never changed, so a failed write leaves no trace."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.schema = spark.createDataFrame([], schema).schema
        self.runs: list[str] = []
        self.written = 0

    def _add(self, rows: DataFrame, gone: bool) -> None:
        self.written += 1
        run = f"{self.path}/run-{self.written:06}"
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns, F.lit(self.written).alias("__run"), F.lit(gone).alias("__gone")).write.parquet(run)
        self.runs.append(run)

    def put(self, rows: DataFrame, *order: str) -> None:
        """Writes one run; of rows that repeat a key the last in order stays."""
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*") if order else rows
        self._add(last, False)

    def delete(self, keys: DataFrame) -> None:
        self._add(keys, True)

    def items(self) -> DataFrame:
        names = [f.name for f in self.schema]
        if not self.runs:
            return self.spark.createDataFrame([], self.schema)
        last = self.spark.read.parquet(*self.runs).groupBy(self.key).agg(F.max_by(F.struct(*names, "__gone"), "__run").alias("r"))
        return last.where("not r.__gone").select(*[F.col(f"r.{n}").alias(n) for n in names])

    def get(self, keys: DataFrame) -> DataFrame:
        """The asked keys that the map has, with their values; runs are filtered by the keys before they meet."""
        asked = keys.select(self.key).distinct()
        return self.items().join(asked, self.key)

    def size(self) -> int:
        return self.items().count()

    def compact(self) -> None:
        rows, self.runs = self.items(), []
        self._add(rows, False)
