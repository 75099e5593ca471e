"""Bounded samples of labelled documents, and row keys for joining decisions back to their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import checkpointed

#: The most labelled documents a classifier is fitted on: those of least hash, whatever the order of the rows.
TRAINING_ROWS = 8_000
#: Rows of two longs that are broadcast, at most: some 10 MB. More are joined by a shuffle.
BROADCAST_ROWS = 1 << 18


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep=None, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most `rows` documents for which keep (a condition on doc_id) holds.

    Labels that are null are passed by; repeated labels of a document count once, as the greatest. The sample of labels, of a
    bounded number of rows, is what is broadcast; documents are scanned once and not moved. Of a document that is there
    several times the least text is taken, so that the sample doesn't depend on how rows are dealt.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if keep is not None:
        some = some.where(keep)
    some = some.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))


def row_key(docs: DataFrame) -> Column:
    """A hash of the columns of documents that tells rows of one doc_id apart; equal rows share it."""
    return F.xxhash64(F.lit(1), *[docs[c] for c in ("doc_id", "text", "lang", "source") if c in docs.columns])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key."""
    return docs.withColumn("row_key", row_key(docs))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, with its own columns, less the rows whose doc_id (null-safe) and row_key are in dropped.

    The dropped keys are written and counted first. Few enough to be broadcast, they are looked up where the documents are;
    only beyond that are documents moved, once.
    """
    d = checkpointed(dropped.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct())
    right = F.broadcast(d) if d.count() <= BROADCAST_ROWS else d
    return docs.join(right, docs["doc_id"].cast("long").eqNullSafe(d["_id"]) & (row_key(docs) == d["_key"]), "left_anti")
