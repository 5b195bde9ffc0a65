"""Packing by power-of-two decomposition.

A document's ids (the end id included) are cut into as many pieces of the longest length as fit and then into
the binary digits of the rest, long before short.  Every piece fills a sequence of its own whose length is a
power of two, so that no sequence crosses documents, none holds padding, and sequences of one length form a
bucket from which batches of equal shape are drawn.  Each document is decided by itself: no shuffle at all.

Defined results: a null text is an empty one (one piece, the end id); an empty table has no pieces; repeated
rows and null ids are packed like any other row; extra columns are ignored; the length of a text isn't bounded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import DEFAULT_VOCABULARY, ByteBpe, slices, vocabulary_path
from .common import arrow_batches

#: Sequence ids: the task's number above, the piece's place in the task below.
_TASK_BITS = 36


def cut(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, piece length) of all pieces of documents of these lengths, in order."""
    assert longest > 0 and longest & (longest - 1) == 0, "the longest sequence must be a power of two"
    bits = np.array([longest >> k for k in range(longest.bit_length())], np.int64)
    times = np.where(bits == longest, lengths[:, None] // longest, (lengths[:, None] & bits) > 0).astype(np.int64)
    per_doc = np.repeat(np.arange(len(lengths)), times.sum(1))
    return per_doc, np.repeat(np.tile(bits, len(lengths)), times.ravel())


def pack(docs: DataFrame, *, longest: int = 2048, end_id: int = 1, vocabulary: str = DEFAULT_VOCABULARY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length (also the bucket), ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds the ids.

    ``sequence_id`` is unique and, as the task's number is part of it, ascends through the table in blocks; a
    recomputed task gives the same ids.  ``offset`` is 0: a sequence holds one piece.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    arrow_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        coder, place = ByteBpe.of(vocabulary_path(vocabulary)), TaskContext.get().partitionId() << _TASK_BITS
        for b in slices(batches):
            flat, lengths = coder.encode(b.column("text"))
            ends = np.cumsum(lengths)
            flat, lengths = np.insert(flat, ends, end_id).astype("<u4"), lengths + 1
            doc, size = cut(lengths, longest)
            stop = np.cumsum(size)
            first = stop - size
            begin = np.cumsum(lengths) - lengths
            view = memoryview(flat).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(first.tolist(), stop.tolist(), strict=True)), np.int64, len(size))
            n = len(size)
            out = [b.column("doc_id").take(pa.array(doc)), pa.array(first - begin[doc]), pa.array(size), pa.array(crc), pa.array(lengths[doc]), pa.array(place + np.arange(n, dtype=np.int64)), pa.array(np.zeros(n, np.int64))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                names.append("ids")
            place += n
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The packed ids (of ``pack(with_ids=True)``) as Parquet, a folder for each sequence length: batches of one shape come from one folder."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length; no other folder is read."""
    return spark.read.parquet(path).where(F.col("bucket") == length)
