"""Token ids in ORC files.

Documents are dealt out by ranges of their id and sorted, so that file k holds smaller ids than file k + 1.
A row holds a document's id and its token ids; ORC stores those by stripes, with integer run-length encoding,
row indexes and a Bloom filter on the document id.  A reader takes stripes in parallel and skips those whose
metadata excludes the ids it looks for.

Defined results: null text: empty, so the end id alone; null ids come first; repeated ids stand side by side,
ordered by their texts' hashes, and may be split between files; an empty table gives an empty set of rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import DEFAULT_VOCABULARY, ByteBpe, slices, vocabulary_path
from .common import arrow_batches, spool_path

SCHEMA = "doc_id long, ids array<int>"


def write(docs: DataFrame, path: str, *, end_id: int = 2, vocabulary: str = DEFAULT_VOCABULARY, stripe_mb: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the ids to ``path`` in ascending order of the document id."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        coder = ByteBpe.of(vocabulary_path(vocabulary))
        for b in slices(batches):
            flat, lengths = coder.encode(b.column("text"))
            flat = np.insert(flat, np.cumsum(lengths), end_id).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, SCHEMA).write.options(
        **{"compression": "zstd", "orc.stripe.size": str(stripe_mb << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    ).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids as written; filters on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of the files; ``start`` counts the ids before it in the files' order.

    A row's place is its file's number, the block of the file that a task reads, and its place there.  Counts are
    summed for each block first; a block's rows are then numbered apart from all others.
    """
    arrow_batches(spark)

    def run(batches):
        seen: dict[tuple, int] = {}
        for b in slices(batches):
            ids = b.column("ids")
            offsets, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            view = memoryview(flat).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.int64, len(ids))
            # A task reads the rows of a block of a file in their order.
            places = []
            for block in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
                places.append(seen.get(block, 0))
                seen[block] = places[-1] + 1
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(places, pa.int64()), b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(crc)], names=["file", "block", "place", "doc_id", "n_tokens", "ids_crc32"])

    placed = read(spark, path).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file"), F.col("_metadata.file_block_start").alias("block"), "doc_id", "ids")
    rows = placed.mapInArrow(run, "file int, block long, place long, doc_id long, n_tokens long, ids_crc32 long")
    held = spool_path(spark, "token-digest")
    rows.write.parquet(held)
    rows = spark.read.schema(rows.schema).parquet(held)
    blocks = rows.groupBy("file", "block").agg(F.sum("n_tokens").alias("n"))
    # One row a block of a file: this is the only place where rows meet in a single task.
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, 0)
    bases = blocks.select("file", "block", (F.sum("n").over(order) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("within", within).join(bases, ["file", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
