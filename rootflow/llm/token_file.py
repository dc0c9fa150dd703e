"""Token-id files in patched frame-of-reference blocks.

A file is a run of segments; a segment holds whole documents in ascending doc_id order and can be read alone:

    header   "RFT1", then little-endian u32: documents, ids, blocks, ids per block
    documents i64 doc_id, u8 null flag, u32 number of ids, one array each
    index    u32 byte place of each block's start, counted from the end of the index, and one past the last
    blocks   u32 minimum, u8 width, u16 exceptions, packed values, u16 places, u32 values

A block stores ids minus its minimum in ``width`` bits each, little-endian bit order. The width is the one
that ``percentile`` of the block's values fit into; larger ones are exceptions: their low bits are packed
like all others and the exception list has the place and the whole difference, which is patched in on reading.

Segments are binary values in Parquet files, as Spark's writer commits whole files or none when tasks are
retried and works on any store; file k holds the k-th range of doc_ids. ``part_tokens`` (ids of a part's
earlier segments) together with the total of earlier parts gives every document's start.

Memory: a segment of about ``segment_ids`` ids, or one document if that is longer.

Defined results: null and empty texts have the end id alone; a null doc_id sorts first; rows that repeat a
doc_id are ordered by text and all kept; an empty table gives no file rows. Other columns are passed over.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm import tokens
from rootflow.llm.common import buffers, documents, map_batches, new_path, parts_by_size, to_binary

MAGIC = b"RFT1"
BLOCK_IDS = 512
SEGMENT_IDS = 1 << 17
PERCENTILE = 95.0
_SEGMENTS = "part int, seq long, part_tokens long, n_tokens long, segment binary"
_DOCS = "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long"


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    least = int(ids.min())
    rest = (ids - least).astype(np.uint32)
    width = int(np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))[k]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return struct.pack("<IBH", least, width, len(odd)) + np.packbits(bits, bitorder="little").tobytes() + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def unpack_block(raw: memoryview, n: int) -> np.ndarray:
    least, width, odd = struct.unpack_from("<IBH", raw)
    size = -(-n * width // 8)
    bits = np.zeros((n, 32), np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, 7), bitorder="little")[: n * width].reshape(n, width)
    out = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    if odd:
        at = np.frombuffer(raw, "<u2", odd, 7 + size)
        out[at] = np.frombuffer(raw, "<u4", odd, 7 + size + 2 * odd)
    return out + np.uint32(least)


def pack_segment(doc_ids: list[int | None], docs: list[np.ndarray], block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE) -> bytes:
    ids = np.concatenate(docs).astype("<u4") if docs else np.zeros(0, "<u4")
    blocks = [pack_block(ids[i : i + block_ids], percentile) for i in range(0, len(ids), block_ids)]
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u4")
    return b"".join(
        [
            MAGIC,
            struct.pack("<IIII", len(docs), len(ids), len(blocks), block_ids),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array([len(d) for d in docs], "<u4").tobytes(),
            index.tobytes(),
            *blocks,
        ]
    )


class Segment:
    """Reads a segment: whole, or ids from any place on through the block index."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_ids, self.n_blocks, self.block_ids = struct.unpack_from("<IIII", raw, 4)
        at = 20
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.nulls = np.frombuffer(raw, "u1", self.n_docs, at := at + 8 * self.n_docs)
        self.lengths = np.frombuffer(raw, "<u4", self.n_docs, at := at + self.n_docs)
        self.index = np.frombuffer(raw, "<u4", self.n_blocks + 1, at := at + 4 * self.n_docs)
        self.body = memoryview(raw)[at + 4 * (self.n_blocks + 1) :]

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack_block(self.body[self.index[k] : self.index[k + 1]], n)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids : end - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids, at = self.ids(), 0
        for d, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist(), strict=True):
            yield None if null else d, ids[at : at + n]
            at += n


def encoded(batches: Iterable[pa.RecordBatch], column: int, file: str, end_id: int | None, rows: int = 1024, size: int = 4 << 20) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Groups of batches with the ids of their texts; a group has about the given rows or bytes."""
    enc, held, n, b = tokens.encoder(file), [], 0, 0
    tail = None if end_id is None else np.array([end_id], np.uint32)

    def done() -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
        texts: list[bytes] = []
        for x in held:
            offsets, data = buffers(x.column(column))
            raw, o = data.tobytes(), offsets.tolist()
            texts += [raw[i:j] for i, j in zip(o[:-1], o[1:], strict=True)]
        ids = enc.encode(texts)
        return held, ids if tail is None else [np.concatenate([x, tail]).astype("<u4") for x in ids]

    for x in batches:
        held.append(x)
        n, b = n + x.num_rows, b + x.column(column).nbytes
        if n >= rows or b >= size:
            yield done()
            held, n, b = [], 0, 0
    if held:
        yield done()


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = tokens.END_ID, segment_ids: int = SEGMENT_IDS, block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE) -> None:
    """Encodes every text of (doc_id, text) and writes token files in ascending doc_id order below the path."""
    file = tokenizer or tokens.path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, docs_, size, seq, total = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            raw = pack_segment(ids, docs_, block_ids, percentile)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([total], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], ["part", "seq", "part_tokens", "n_tokens", "segment"])

        for held, texts in encoded(batches, 1, file, end_id):
            for d, t in zip([d for x in held for d in x.column(0).to_pylist()], texts, strict=True):
                if size and size + len(t) > segment_ids:
                    yield segment()
                    seq, total, size = seq + 1, total + size, 0
                    ids, docs_ = [], []
                ids.append(d)
                docs_.append(t)
                size += len(t)
        if docs_:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), to_binary("text").alias("text"))
    n = parts_by_size(docs)
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    map_batches(ordered, write, _SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From token files, per document: doc_id, start, n_tokens, ids_crc32. The ids are decoded where they lie."""
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # a row per file range
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col("part").alias("at"), before.alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                out: list[tuple] = []
                for d, ids in Segment(raw.as_py()).documents():
                    out.append((part, d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if out:
                    types = [pa.int32(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    found = map_batches(segments.select("part", "part_tokens", "segment"), read, _DOCS)
    return found.join(F.broadcast(offsets), found["part"] == offsets["at"]).select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return read_tokens(spark, path)
