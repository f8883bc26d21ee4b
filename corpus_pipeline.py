"""The corpus pipeline over the documents table.

Toxic documents go; repeated chunks of lines are cut; of each group of near
copies one row stays, that of the smallest doc_id; documents with benchmark
passages go; the rest is encoded.  Each stage works on all rows its
predecessor kept and, but for the last, returns the columns of documents.

Each row is decided by itself: rows with one doc_id, or none, may go or stay
apart, and of rows repeated whole one stays unless it has no words; null texts
pass the filters as texts without words.  Columns beyond those of documents,
whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from receptory.llm.bpe import encode_documents
from receptory.llm.common import discard, stored, table, tidy
from receptory.llm.decontaminate import decontaminate
from receptory.llm.line_dedup import dedup_lines
from receptory.llm.ngram_jaccard import one_of_each
from receptory.llm.toxicity import fit_toxicity, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies share four fifths of their shingles of five words.
SHINGLE, LINK = 5, (80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, LINK, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]
#: The network of the first stage is learnt, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again, and deleted when the next is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
