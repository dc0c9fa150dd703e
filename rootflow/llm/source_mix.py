"""Mixing sources to target weights: pivotal dependent rounding of copy probabilities.

A document of a source with ratio ``r = target / source_size`` is taken ``floor(r)`` times plus once more with
probability ``frac(r)``. Independent draws would miss the target by a sum of many errors; pivotal rounding
pairs two fractional documents and moves words between them at random until one is integral. Each step keeps
the pair's words (``p_i * size_i + p_j * size_j``) and every document's expectation, so one fractional document
is left per source and a source misses its target by less than one document's size. Groups run from large to
small documents, so the one left is usually small.

Distribution: documents are dealt by a hash of their id into groups per source; a group streams through one
open fractional document, so memory is constant. Each group leaves at most one fractional document; these
residuals meet in a reduction tree (``FAN_IN`` groups to one, level by level) until one per source is left,
which a last draw settles. A hot source is simply many groups. Random numbers are hashes of the seed and the
two documents, and groups depend on ids and row counts alone, so reruns and retried tasks agree.

Defined results: null text has size 0; null source is a source of its own, last; a document without words is
taken 0 times; rows that repeat a doc_id are separate rows; an empty table gives an empty result; a source
without words has target 0. Other columns are passed by and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm.common import WORD, documents, parts_for, prepare, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 8
#: Rows of one group, and groups that meet in one at each level of the tree.
GROUP_ROWS = 256
FAN_IN = 64

_SCHEMA = "source string, doc_id long, salt long, size long, whole int, p double, open boolean"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (source, source_size) the targets in words: shares of ``share`` of all words by weight, none above ``cap`` times its source.

    The excess of capped sources is shared again by weight until none is above. That fixed point is found in one
    pass: sources become capped in the order of size per weight, so running sums in that order hold every candidate
    level. The input has one row per source; only this table is sorted as a whole."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.row_number().over(everything) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("n"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    levels = ranked.select(
        "*",
        (F.sum("source_size").over(whole) * share).alias("total"),
        F.coalesce(F.sum("most").over(before), zero).alias("capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)).alias("rest"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    # A source is open from the first level on that does not pass its own cap.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(whole)
    return levels.withColumn("at", level).select("source", "source_size", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("at") * F.col("weight"))).alias("target"))


_BITS = (1 << 64) - 1


def _uniform(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on the seed and two 64-bit numbers alone."""
    x = ((a ^ (seed * 0x9E3779B97F4A7C15)) + (b * 0xD6E8FEB86659FD93)) & _BITS
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * m) & _BITS
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def transfer(pi: float, si: float, pj: float, sj: float, u: float) -> tuple[float, float]:
    """One pivotal step of two fractional documents: afterwards one of them is 0 or 1, the words are the same."""
    up = min((1.0 - pi) * si, pj * sj)  # words from j to i
    down = min(pi * si, (1.0 - pj) * sj)  # words from i to j
    words = up if u * (up + down) < down else -down
    new_i, new_j = pi + words / si, pj - words / sj
    # What the step was to make integral is so exactly, whatever the rounding.
    if words > 0:
        if (1.0 - pi) * si <= pj * sj:
            new_i = 1.0
        else:
            new_j = 0.0
    elif pi * si <= (1.0 - pj) * sj:
        new_i = 0.0
    else:
        new_j = 1.0
    near = lambda p: 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p
    return near(new_i), near(new_j)


def _round_groups(seed: int):
    """Streams rows sorted by (source, group); leaves at most one open document for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None  # the open document's row as a list, and its group
        out: list[list] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["source", "doc_id", "salt", "size", "whole", "p", "open"])

        def settle(row: list) -> None:
            row[4], row[5], row[6] = row[4] + int(row[5]), 0.0, False
            out.append(row)

        for b in batches:
            for source, doc_id, salt, size, whole, p, group in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (source, group) != key:
                    if held is not None:
                        out.append(held)
                    held, key = None, (source, group)
                row = [source, doc_id, salt, size, whole, p, True]
                if p <= 0.0 or p >= 1.0:
                    settle(row)
                elif held is None:
                    held = row
                else:
                    held[5], row[5] = transfer(held[5], held[3], row[5], row[3], _uniform(seed, held[2], row[2]))
                    mine, other = (held, row) if row[5] in (0.0, 1.0) else (row, held)
                    settle(other)
                    held = mine
                    if held[5] in (0.0, 1.0):
                        settle(held)
                        held = None
            if len(out) >= 1024:
                yield batch()
                out.clear()
        if held is not None:
            out.append(held)
        if out:
            yield batch()

    return run


def _level(rows: DataFrame, groups: int, seed: int) -> DataFrame:
    """One level of the tree: rows meet by source and group, in an order that depends on ids alone."""
    prepare(rows.sparkSession)
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "salt"), F.lit(groups)))
    n = parts_for(rows, groups * GROUP_ROWS)
    ordered = dealt.repartition(n, "source", "group").sortWithinPartitions("source", "group", F.col("size").desc(), "doc_id", "salt")
    return ordered.select("source", "doc_id", "salt", "size", "whole", "p", "group").mapInArrow(_round_groups(seed), _SCHEMA)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, salt, source, size, source_size, target, copies), one for each document; salt is a hash of doc_id and text."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("salt"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, "mix-sizes")
    by_source = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    rows = sized.count()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    a, b = sized.alias("a"), by_source.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", ratio.alias("r"))
    whole = F.floor("r").cast("int")
    level = joined.select("source", "doc_id", "salt", "size", F.when(F.col("size") > 0, whole).otherwise(0).alias("whole"), F.when(F.col("size") > 0, F.col("r") - whole).otherwise(0.0).alias("p"))
    groups, done, k = max(1, -(-rows // GROUP_ROWS)), [], 0
    while True:
        out = written(_level(level, groups, seed + k), f"mix-level{k}")
        done.append(out.where(~F.col("open")))
        level, k = out.where("open").drop("open"), k + 1
        if groups == 1:
            break
        groups = -(-groups // FAN_IN)
    # One fractional document per source is left: a draw with its own probability settles it.
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "salt"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    last = level.withColumn("whole", F.col("whole") + (draw < F.col("p")).cast("int"))
    settled = last.select("source", "doc_id", "salt", "size", "whole")
    for d in done:
        settled = settled.unionByName(d.select("source", "doc_id", "salt", "size", "whole"))
    s, t = settled.alias("s"), by_source.alias("t")
    return s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.doc_id", "s.salt", "s.source", "s.size", "t.source_size", "t.target", F.col("s.whole").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    taken = mix_sources(docs, **options).groupBy("salt", "doc_id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("same")).where("copies > 0")
    t = taken.select(F.col("doc_id").alias("of"), F.col("salt").alias("of_salt"), "copies", "same")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("salt"), "doc_id", "source")
    joined = rows.join(t, (rows["salt"] == t["of_salt"]) & rows["doc_id"].eqNullSafe(t["of"]))
    # Rows that are equal in id and text share their copies as evenly as they can.
    nth = F.row_number().over(Window.partitionBy("salt", "doc_id").orderBy("source"))
    share = F.floor(F.col("copies") / F.col("same")) + (nth <= F.col("copies") % F.col("same")).cast("int")
    many = joined.withColumn("many", share).where("many > 0")
    return many.select("row", F.explode(F.sequence(F.lit(1), F.col("many").cast("int")))).select("row.*")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))
