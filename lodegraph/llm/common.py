"""Shared helpers: tables in the shared folder, Arrow batches, word bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder, removed when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="lodegraph-")
    jvm = spark._jvm
    path = f"{base.rstrip('/')}/lodegraph-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


_recorders: list[list[str]] = []


@contextmanager
def recorded_tables(paths: list[str]):
    """Folders that stored() writes inside this context are added to paths."""
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete recorded folders; rows that are still to be read from them are lost."""
    while paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here.

    The table outlives lost executors, and later reads prune its columns.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    for paths in _recorders:
        paths.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with an identity for each row, and the name of its column.

    Rows that come straight from files are told apart by file and place in it, which no
    later reading changes; others are stored once with a number.  Two files whose paths have
    one 64-bit hash would share identities: with ten million files a chance of about 3e-6.
    """
    name = "_row"
    while name in docs.columns:
        name = f"_{name}"
    try:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select("*", place.alias(name)), name
    except AnalysisException:  # not rows of files
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def row_type(docs: DataFrame, row: str | None) -> str:
    """The type of the column of row numbers, in a schema string."""
    return docs.schema[row].dataType.simpleString() if row else "long"


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    for value in binary:
        yield value.as_py() or b""


def crc_remainder(doc_id, modulus: int):
    """crc32 of doc_id written as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
