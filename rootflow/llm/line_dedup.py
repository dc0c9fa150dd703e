"""Line dedup (native): hashes in range partitions with a secondary sort, and compressed keep bitmaps.

Lines are the parts of a text between ``\\n``. A line's key is the line with ASCII white space stripped at
both ends and A-Z lower-cased. A key of at least ``min_chars`` code points that at least ``min_docs``
documents hold is repeated: only the document with the largest ``doc_id`` that holds it keeps its lines.

Plan, DataFrame functions only:

1. every long line becomes a narrow row: its key's hash (128 bits), doc_id, the row's own hash, its position. These
   rows are written; texts take part no more;
2. they are range-partitioned by (hash, document descending, position), so a key that a third of all documents hold
   spreads over as many ranges as it needs, and the number of each row's range is written with it;
3. in each range the rows stream by in that order: of a key's rows the first one shows the holder, a running rank
   counts its documents, and what comes after the first document is to go if the rank gets high enough;
4. a key at the border of ranges goes on in the next one. Each range gives (documents, first document, last document)
   of its first and last key; read in the order of ranges these rows, two for each range at most, carry
   the holder and the number of documents over the borders;
5. the positions to drop are aggregated per document into a run-length bitmap, and only the bitmap is returned.

No step collects a key's documents into one row or task. What is broadcast are rows per range.

Defined results: null or empty text has one empty line; a null doc_id sorts below all others; documents are told apart
by doc_id and text: rows that repeat a doc_id with other texts are separate documents, equal rows are one, and all rows
with the largest doc_id keep the line; other columns are passed by and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm.common import documents, parts_by_size, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.octet_length(trimmed) == F.char_length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


def _row_key() -> Column:
    """Tells rows apart that share a doc_id; equal rows stay alike, as do their lines."""
    return F.xxhash64("doc_id", "text")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Rows (doc_id, row_key, keep_runs array<int>) of the documents that lose lines.

    ``keep_runs`` is the keep bitmap in run lengths: lines kept, lines dropped, lines kept, ... from the
    first line on; what follows the last run is kept. A document that loses nothing has no row.
    ``row_key`` is a hash of doc_id and text."""
    ranged = line_ranges(docs, min_chars)
    n = parts_by_size(ranged)
    order = [F.col("doc_id").desc_nulls_last(), "row_key"]
    key = Window.partitionBy("range", "h1", "h2")
    streamed = (
        ranged.repartitionByRange(n, "range")
        .withColumn("nth", F.row_number().over(key.orderBy(*order, "pos")))
        .withColumn("rank", F.dense_rank().over(key.orderBy(*order)))
        .withColumn("holder", F.first("doc_id").over(key.orderBy(*order, "pos")))
        .withColumn("docs", F.max("rank").over(key))
    )
    ends = ranged.groupBy("range").agg(F.min(F.struct("h1", "h2")).alias("first"), F.max(F.struct("h1", "h2")).alias("last"))  # a row for each range
    here = F.struct("h1", "h2")
    marked = streamed.join(F.broadcast(ends), "range").withColumn("border", (here == F.col("first")) | (here == F.col("last")))
    marked = written(marked.where("border or docs >= " + str(int(min_docs))).select("range", "h1", "h2", "doc_id", "row_key", "pos", "nth", "holder", "docs", "border"), "line-keys")

    document = F.struct("doc_id", "row_key")
    parts = marked.where("border").groupBy("range", "h1", "h2").agg(F.first("docs").alias("docs"), F.first("holder").alias("holder"), F.min_by(document, "nth").alias("head"), F.max_by(document, "nth").alias("tail"))
    onward = Window.partitionBy("h1", "h2").orderBy("range")
    # A document that a border cuts is counted on both sides.
    cut = F.when(F.col("head").eqNullSafe(F.lag("tail").over(onward)), 1).otherwise(0)
    carried = parts.withColumn("docs", F.col("docs") - cut).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.min_by("holder", "range").alias("all_holder"))  # two rows for each range at most
    joined = marked.join(F.broadcast(carried), ["h1", "h2"], "left")
    holder = F.when(F.col("all_docs").isNull(), F.col("holder")).otherwise(F.col("all_holder"))
    later = joined.where((F.coalesce("all_docs", "docs") >= min_docs) & holder.isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < holder)))
    return later.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("dropped")).select("doc_id", "row_key", runs_of(F.col("dropped")).alias("keep_runs"))


def line_ranges(docs: DataFrame, min_chars: int = 40, ranges: int | None = None) -> DataFrame:
    """Rows (h1, h2, doc_id, row_key, pos, range) of all long lines; ranges follow (hash, document descending, position)."""
    lines = (
        docs.select("doc_id", _row_key().alias("row_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "row_key", "pos", key_of(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_key", "pos")
    )
    lines = written(lines, "lines")
    ordered = lines.repartitionByRange(ranges or parts_by_size(lines), "h1", "h2", F.col("doc_id").desc_nulls_last(), "row_key", "pos")
    return written(ordered.withColumn("range", F.spark_partition_id()), "line-ranges")


def runs_of(dropped: Column) -> Column:
    """Run lengths (kept, dropped, kept, ...) of sorted distinct positions that are dropped."""
    starts = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))
    ends = F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1))
    return F.flatten(F.transform(starts, lambda s, i: F.array(s - F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1), F.get(ends, i) - s + 1)))


def kept_lines(lines: Column, keep_runs: Column) -> Column:
    """The lines that a keep bitmap leaves; a null bitmap leaves all."""
    mask = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.when(keep_runs.isNull(), lines).otherwise(F.filter(lines, lambda _, i: F.coalesce(F.get(mask, i), F.lit(True))))


def n_dropped(keep_runs: Column) -> Column:
    return F.coalesce(F.aggregate(F.filter(keep_runs, lambda _, i: i % 2 == 1), F.lit(0), lambda a, x: a + x), F.lit(0))


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows (row, text, keep_runs): the documents as structs, so that their columns may have any name."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("of"), "text", _row_key().alias("key"))
    return rows.join(bitmaps, rows["of"].eqNullSafe(bitmaps["doc_id"]) & (rows["key"] == bitmaps["row_key"]), "left").select("row", "text", "keep_runs")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str = "keep_runs") -> DataFrame:
    """The documents, whole, with the bitmap as a further column (null: all lines stay). Each row keeps its columns."""
    return _joined(docs, bitmaps).select("row.*", F.col("keep_runs").alias(name))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with their texts reduced to the kept lines; a null text stays null, n_chars follows the text."""
    joined = _joined(docs, keep_bitmaps(docs, min_chars, min_docs))
    text = F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines_of(F.col("text")), F.col("keep_runs")), "\n"))
    reduced = joined.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")}
    return reduced.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lines = lines_of(F.col("text"))
    return with_bitmaps(docs, keep_bitmaps(docs)).select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        n_dropped(F.col("keep_runs")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join(kept_lines(lines, F.col("keep_runs")), "\n"), 256).alias("kept_sha256"),
    )


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.holder AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
