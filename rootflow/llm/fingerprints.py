"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

A text's five-word shingles (A-Z lower-cased; fewer words: the whole sequence as one) are hashed once. The high
bits of a hash choose one of ``bins`` bins, a bin keeps its least hash. An empty bin is filled by optimal
densification: it draws bins from a fixed random sequence of its own until it meets one that was filled by
shingles, and takes that bin's value. Each bin's low ``bits`` bits are packed into a hex string.

Two fingerprints' share of equal bins overestimates likeness, as unequal bins agree by chance with probability
``c = 2 ** -bits``; ``likeness`` removes that: ``(share - c) / (1 - c)``, cut to 0..1. Texts without words have
an empty fingerprint: likeness 1 among themselves, 0 with all others.

Neighbours in doc_id order come from one range partitioning by doc_id with a sort inside each partition: rows
stream by with one row of memory, and only the first and last row of each partition meet in a second step.

Defined results: null text is empty; a null doc_id sorts last in descending order; rows that repeat a doc_id
are ordered by text and all kept; in a table of one row the row is its own next document; an empty table gives
an empty result. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm.common import documents, map_batches, mix, parts_by_size, shingle_sets, to_binary, written

BINS = 512
BITS = 4
WORDS = 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_TRIES = 64


@lru_cache(maxsize=256)
def _draws(bins: int, turn: int) -> np.ndarray:
    """For each bin the next bins to borrow from, in its own fixed sequence; there is no end of turns."""
    with np.errstate(over="ignore"):
        x = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(turn * _TRIES, (turn + 1) * _TRIES, dtype=np.uint64)[None, :]
        return (mix(x + np.uint64(0x5DEECE66D)) % np.uint64(bins)).astype(np.int64)


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """The densified bins of a set of 64-bit shingle hashes; None for an empty set. ``bins`` is a power of two."""
    if not len(hashes):
        return None
    own = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    out = np.full(bins, _EMPTY)
    # Sorted hashes: the first of each bin is its least.
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out[own[at]] = hashes[at]
    filled = np.zeros(bins, bool)
    filled[own[at]] = True
    open_, t = np.flatnonzero(~filled), 0
    while len(open_):
        draws = _draws(bins, t)[open_]
        hit = filled[draws]
        first = hit.argmax(axis=1)
        ok = hit[np.arange(len(open_)), first]
        out[open_[ok]] = out[draws[np.arange(len(open_)), first][ok]]
        open_, t = open_[~ok], t + 1
    return out


def packed(values: np.ndarray | None, bits: int = BITS) -> str:
    """The low bits of each bin's mixed value as hex, empty for None."""
    if values is None:
        return ""
    # The bin's number goes in too: bins with one value then don't agree by chance together.
    low = (mix(values ^ mix(np.arange(len(values), dtype=np.uint64))) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 4:
        return (low[0::2] | (low[1::2] << 4)).tobytes().hex()
    return np.packbits(np.unpackbits(low[:, None], axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes().hex()


def _unpacked(fingerprint: str, bits: int) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.packbits(np.unpackbits(raw, bitorder="little")[: len(raw) * 8 // bits * bits].reshape(-1, bits), axis=1, bitorder="little").ravel()


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """The estimated Jaccard similarity of two packed fingerprints of the same parameters."""
    if not a or not b:
        return float(a == b)
    share, chance = float((_unpacked(a, bits) == _unpacked(b, bits)).mean()), 2.0**-bits
    return min(1.0, max(0.0, (share - chance) / (1.0 - chance)))


def fingerprint_texts(texts: list[bytes], bins: int = BINS, bits: int = BITS, k: int = WORDS) -> list[str]:
    return [packed(sketch(h, bins), bits) for h in shingle_sets(pa.array(texts, pa.large_binary()), k)]


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, k: int = WORDS) -> DataFrame:
    """Rows (doc_id, fingerprint) of (doc_id, text): one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [packed(sketch(h, bins), bits) for h in shingle_sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), to_binary("text").alias("text")), run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following text, or all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], prints: list[str], bins: int, bits: int, k: int) -> list[list]:
    """Columns for all rows but the last, each with its follower."""
    new = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    raw = [x.encode() for x in new]
    own = fingerprint_texts(raw, bins, bits, k)
    return [
        ids[:-1],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(x).hexdigest() for x in raw],
        prints[:-1],
        own,
        [likeness(a, b, bits) for a, b in zip(prints[:-1], own, strict=True)],
        [likeness(a, b, bits) for a, b in zip(prints[:-1], prints[1:], strict=True)],
    ]


def edit_report(docs: DataFrame, bins: int = BINS, bits: int = BITS, k: int = WORDS) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, descending doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def rows(columns: list[list], which: str, text: list) -> pa.RecordBatch:
            n = len(columns[0])
            more = [pa.array([which] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(text, pa.string())]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)), *more], [*_FIELDS, "which", "part", "text"])

        def edge(which: str, row: tuple) -> pa.RecordBatch:
            return rows([[row[0]], [None], [None], [row[2]], [None], [None], [None]], which, [row[1]])

        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).cast(pa.string()).to_pylist()
            prints = [packed(sketch(h, bins), bits) for h in shingle_sets(b.column(1), k)]
            got = list(zip(b.column(0).to_pylist(), texts, prints, strict=True))
            if held is None:
                yield edge("first", got[0])
            else:
                got.insert(0, held)
            ids, texts, prints = map(list, zip(*got, strict=True))
            if len(got) > 1:
                yield rows(_compared(ids, texts, prints, bins, bits, k), "row", [None] * (len(got) - 1))
            held = got[-1]
        if held is not None:
            yield edge("last", held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, p, nt, np_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                columns = _compared([d, None], [t, nt], [p, np_], bins, bits, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(columns, _TYPES, strict=True)], _FIELDS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), to_binary("text").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(parts_by_size(docs), *order).sortWithinPartitions(*order, "text")
    out = written(map_batches(ranged, run, f"{_SCHEMA}, which string, part int, text string"), "fingerprints")
    # Two rows per partition: the last of each meets the first of the next that has any; after the last comes the first.
    firsts = out.where("which = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    parts = out.where("which = 'first'").select("part")
    order_by, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = parts.select(F.col("part").alias("at"), F.coalesce(F.lead("part").over(order_by), F.first("part").over(whole)).alias("then"))
    edges = out.where("which = 'last'").select("doc_id", "text", "fingerprint", F.col("part").alias("of"))
    pairs = edges.join(following, F.col("of") == F.col("at")).join(firsts, F.col("then") == F.col("part"))
    ends = map_batches(pairs.select("doc_id", "text", "fingerprint", "next_text", "next_print"), meet, _SCHEMA)
    return out.where("which = 'row'").select(*_FIELDS).unionByName(ends)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(documents(spark, sf_dir))
