"""What the operators share: written intermediate tables, bounded Arrow batches and vectorised word hashing.

Intermediate results that are read more than once are written as Parquet below the folder in
``spark.checkpoint.dir`` (a folder of this machine only where that setting is missing and the master is local, as in tests), so
a lost executor costs a re-read and never a wrong answer.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. A batch holds whole texts, so this bounds a Python worker's memory.
BATCH_ROWS = 256
#: Bytes of text that are hashed at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of input files for one partition of a shuffle, and the most partitions.
PART_BYTES = 256 << 20
MAX_PARTS = 200_000
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: A word in Java's and DuckDB's regex syntax.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this library's folder on the Python workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rootflow-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


_made: list[str] = []


def _clean(spark: SparkSession) -> None:
    """Deletes this process's intermediate tables when it ends, if the session still lives."""
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for x in _made:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder; it is deleted when the process ends."""
    if not _made:
        atexit.register(_clean, spark)
    _made.append(f"{shared_dir(spark)}/rootflow/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read back: its lineage ends here."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts_for(df: DataFrame, rows: int) -> int:
    """Shuffle partitions for the given rows: the session's number, more if partitions would pass 200,000 rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 200_000))


def parts_by_size(df: DataFrame) -> int:
    """Partitions for shuffling a frame's rows: the session's number, more if a partition of its input files would
    pass ``PART_BYTES``. Spark's own estimate of the frame's size is used; adaptive execution can't split a number
    that is given to ``repartition``, so it has to follow the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(MAX_PARTS, -(-size // PART_BYTES))) if size < 1 << 60 else least  # beyond: unknown


def release() -> None:
    """Gives memory that a finished task no longer uses back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def free_name(name: str, df: DataFrame) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def to_binary(c: str) -> F.Column:
    """A text's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")


# ---- texts as byte arrays -------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[list(ASCII_SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers below n of the base and its inverse; only short tables are kept between calls."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    found = []
    for base in (_BASE, _INVERSE):
        x = np.full(1 << (n - 1).bit_length() if n <= 2 * SLICE_BYTES else n, base, np.uint64)
        x[0] = 1
        found.append(np.cumprod(x, dtype=np.uint64, out=x))
    if n <= 2 * SLICE_BYTES:
        _powers[:] = found
    return found[0][:n], found[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column without nulls, offsets from 0."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about the given size together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = b


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and the number of each text's first word (with one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = space[:-1], space[1:]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, whatever its place."""
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct k-word shingles, A-Z lower-cased.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none."""
    offsets, data = buffers(column)
    for a, b in slices(offsets):
        o = offsets[a : b + 1] - offsets[a]
        d = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, own = words(o, d)
        h = word_hashes(d, starts, ends)
        m = max(0, len(h) - k + 1)
        s = np.zeros(m, np.uint64)
        for i in range(k):
            s = mix(s * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m] + np.uint64(i + 1))
        for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            if y - x >= k:
                yield np.unique(s[x : y - k + 1])
            elif y > x:
                one = np.zeros(1, np.uint64)
                for i in range(y - x):
                    one = mix(one * np.uint64(0xD6E8FEB86659FD93) + h[x + i] + np.uint64(i + 1))
                yield mix(one + np.uint64((y - x) << 32))
            else:
                yield np.zeros(0, np.uint64)
