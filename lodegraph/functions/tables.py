"""Tables that end lineage: written once to the shared folder, read back by every executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed with the session.

    Only in local mode, as in tests, a temporary folder takes its place where it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lodegraph-")
    path = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def row_count() -> Column:
    return F.count(F.lit(1))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys over all shuffle partitions, however few bytes they hold.

    For rows that cost much more work than their size tells: windows by these keys need no
    other shuffle, and small partitions are not joined together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settled(df: DataFrame) -> DataFrame:
    """df as a written table, with the lineage that led to it cut off."""
    return settled_counting(df, row_count())[0]


def settled_counting(df: DataFrame, measure: Column) -> tuple[DataFrame, int]:
    """df as a written table, and an aggregate that the same job measures while it writes."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    seen = Observation()
    df.observe(seen, measure.alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"] or 0


class Rewritten:
    """Rows that each round writes anew: the table of the round before is deleted when the next one stands."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.round = spark, shared_folder(spark), 0

    def write(self, rows: DataFrame, measure: Column) -> tuple[DataFrame, int]:
        """settled_counting() of rows, which may read what was written last but nothing older."""
        before, self.round = f"{self.path}/round{self.round}", self.round + 1
        path, seen = f"{self.path}/round{self.round}", Observation()
        rows.observe(seen, measure.alias("n")).write.parquet(path)
        old = self.spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(rows.schema).parquet(path), seen.get["n"] or 0


class Layers:
    """Rows found round by round: each round's new rows are a partition of one folder."""

    def __init__(self, spark: SparkSession, column: str):
        self.spark, self.column, self.path = spark, column, f"{shared_folder(spark)}/layers"
        self.schema = None

    def add(self, rows: DataFrame, number: int) -> tuple[DataFrame, int]:
        """Write a round; returns it and its number of rows."""
        self.schema = rows.schema
        seen, path = Observation(), f"{self.path}/{self.column}={number}"
        rows.observe(seen, row_count().alias("n")).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), seen.get["n"] or 0

    def all(self) -> DataFrame:
        """All rounds, with the round's number as a long."""
        schema = StructType([*self.schema.fields, StructField(self.column, LongType())])
        return self.spark.read.schema(schema).parquet(self.path)
