"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, only, spool


def sample(docs: DataFrame, labels: DataFrame, target: str, *, folds: int = 0, held_out: int = -1, rows: int = 20_000, keep: Column | None = None) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents with distinct texts, written to the shared folder.

    Rows of the held-out fold are never read as labels.  The ids are chosen by hash order among all labelled
    ones (a bounded number, so that they may be broadcast), the documents then found by those ids.
    """
    rows_of = only(labels, "doc_id", target).where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    if folds:
        rows_of = rows_of.where(fold(F.col("doc_id"), folds) != held_out)
    ids = rows_of.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(target)), "doc_id").limit(rows)
    found = only(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    once = found.groupBy(F.sha2("text", 256).alias("key")).agg(F.min(F.struct("doc_id", "text", "label")).alias("row")).select("row.*")
    return spool(once, f"labelled-{target}")
