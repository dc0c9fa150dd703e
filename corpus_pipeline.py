"""A training corpus from raw documents: five stages, each a written table that the next one reads.

1. language     documents without letters, or whose language the model can't tell, go (operator 2)
2. lines        repeated lines go, but for those in the last document that holds them (operator 9)
3. near_copies  one row of each group of near duplicates stays: five words, 0.8 (operator 3); rows are told
                apart by doc_id and text, and what resembles nothing stays whatever its doc_id
4. mixture      sources come to their target weights: documents go or are repeated (operator 8)
5. packing      what is left becomes sequences of at most 4096 tokens (operator 10)

All stages but the last return the columns of their input, whatever they are. SQL can express neither a trained
model nor random rounding nor a tokenizer, so ORACLE_SQL is None; tests hold each stage against a plain
version. A stage's intermediate tables lie in the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootflow.llm import common, language, line_dedup, near_dedup, packing, source_mix

#: A document whose likeliest language is less probable than this is rejected.
MIN_LANGUAGE_SCORE = 0.3
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(language.learning_rows(docs))
    named, score = common.free_name("lang_pred", docs), common.free_name("lang_score", docs)
    told = language.predict(docs, model, named, score)
    kept = told.where((F.col(named) != language.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)) if model is not None else told
    return kept.select(*docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each_group(docs, k=5)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language_stage),
    ("lines", lines_stage),
    ("near_copies", near_copies_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
