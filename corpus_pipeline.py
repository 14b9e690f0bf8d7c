"""A training corpus from documents: language ID, quality classifier, n-gram Jaccard
join, secret scans, best-fit packing.

All stages but the last return the columns of documents; each works on all rows that the
one before kept. The Jaccard join takes five-word shingles and a similarity of 0.8 here,
and secrets are replaced by a mark in the text.

Defined cases: rows with a null or empty text go at the language stage, as does any text
without letters; a row repeated with the same id and text is one row after the Jaccard join,
as is a text that repeats another's words; texts are worked on whole at any length; null
columns are kept as they are, but for a null lang, which becomes the language found; further
columns pass through the stages that return documents, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from onsetlab.llm.common import drop_written, new_place, vocab_path, written_at
from onsetlab.llm.jaccard import one_of_each
from onsetlab.llm.language_id import language_filter
from onsetlab.llm.packing import pack_documents
from onsetlab.llm.quality import quality_filter
from onsetlab.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_filter(docs, vocab_path("piece_bpe_32k.model"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=5, top=4, bottom=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocab_path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("best-fit packing", packing)]
#: The stages are trained models and library tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        place = new_place(spark)
        docs = written_at(stage(spark, docs, sf_dir), place)
        if last:
            drop_written(spark, last)  # the stage after it is written
        last = place
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written, its documents no longer read
    drop_written(spark, last)
    return packed
