"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rule: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names; in a local session without it a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arcwright-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def spool_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/spool-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    The copy is columnar and compressed, later reads prune columns, and a join above it starts at a plain
    scan, so that adaptive execution may split its skewed partitions.
    """
    path = spool_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spooled = path
    return out


def unspool(*tables: DataFrame | None) -> None:
    """Deletes what ``spool`` has written, once all that is read from it is written itself."""
    for t in tables:
        path = getattr(t, "spooled", None)
        if path:
            context = t.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def arrow_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound the bytes of one Arrow batch, so that long texts don't make a batch of thousands of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but the six ASCII white-space characters; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n: the fold that train/held-out splits go by."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name; extra columns, whatever they are called, are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])
