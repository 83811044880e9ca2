"""A bounded sample of labelled documents, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.llm.common import text_bytes, written


def fold(parts: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of parts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def sample(documents: DataFrame, labels: DataFrame, label: str, most: int, allowed: Column, purpose: str) -> DataFrame:
    """(turn, label, text): the documents of at most `most` labelled rows, in a seeded order of their ids.

    Only rows with an id and a label that meet `allowed` count; an id with
    several labels has the largest. The bound makes the label rows small enough
    to broadcast, so the documents are filtered where they are read.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("double").alias("label"))
    some = rows.withColumn("turn", F.xxhash64("_id")).orderBy("turn", "_id").limit(most)
    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), text_bytes().alias("text"))
    return written(texts.join(F.broadcast(some), "_id").select("turn", "label", "text"), purpose)
