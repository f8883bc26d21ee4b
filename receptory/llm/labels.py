"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receptory.llm.common import fold, text_column

#: Folds of crc32(doc_id); fold 0 is held out from every fit.
FOLDS = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most limit rows (text, label) outside the held-out fold, least hash of doc_id first, so any rerun takes the same rows.

    Rows without id or label, and ids with both labels, are left out.  Of rows
    with one id the largest text is taken.  The ids sent to the executors are
    at most limit numbers.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return docs.select("doc_id", text_column()).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label")).select("doc_id", "text", "label")
