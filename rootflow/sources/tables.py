"""Readers and writers: Parquet tables, the catalog, text logs, JSON results, files of settings."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def table_stats(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> DataFrame:
    """Rows (table_name, row_count, columns, row_size, total_size); 20 bytes are taken for a column."""
    out = None
    for name in names:
        df = table(spark, sf_dir, name)
        n = len(df.columns)
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(n).cast("long").alias("n_columns"), F.lit(20 * n).cast("long").alias("row_size"), (F.col("row_count") * 20 * n).cast("long").alias("total_size")
        )
        out = one if out is None else out.unionByName(one)
    return out


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of text files in a column ``line``."""
    return spark.read.text(list(paths)).withColumnRenamed("value", "line")


def read_jdbc(spark: SparkSession, url: str, table_name: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table of a database, read in ranges of a column where bounds are given."""
    if column and bounds:
        return spark.read.jdbc(url, table_name, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return spark.read.jdbc(url, table_name)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_settings(settings: dict, path: str, style: str = "json") -> None:
    """Settings as JSON, shell commands, a database's conf file or Spark's defaults file."""
    match style:
        case "json":
            text = json.dumps(settings, indent=2, sort_keys=True)
        case "conf":
            text = "".join(f"{k} = {v}\n" for k, v in settings.items())
        case "spark":
            text = "".join(f"{k} {v}\n" for k, v in settings.items())
        case "shell":
            text = "#!/bin/sh\n" + "".join(f"sysctl -w {k}={v}\n" for k, v in settings.items())
        case _:
            raise ValueError(f"unknown style {style}")
    Path(path).write_text(text)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place below ``spark.checkpoint.dir``; a folder of this machine only where the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rootflow-")
    return f"{found.rstrip('/')}/rootflow-{tag}-{uuid.uuid4().hex}"
