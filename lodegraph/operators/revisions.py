"""Files as they stood at a revision: as-of joins of versions on a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.tables import settled
from lodegraph.operators.closure import levels


def before(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """asked (path, ordinal, ...) with blob and since: the last version of a path older than ordinal.

    versions: path, ordinal, blob (null: deleted).  On a linear history a version holds until
    the next one of its path; both sides meet in one order by path, so no version is paired
    with all requests.  blob is null where the path did not exist; since tells from when.
    """
    both = asked.withColumn("_v", F.lit(None).cast("struct<ordinal:bigint,blob:string>")).withColumn("_asks", F.lit(0)).unionByName(
        versions.select("path", "ordinal", F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("blob").cast("string").alias("blob")).alias("_v"), F.lit(1).alias("_asks")),
        allowMissingColumns=True,
    )
    # Requests come first among equals: they ask for what was there before.
    order = Window.partitionBy("path").orderBy("ordinal", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).filter("_asks = 0")
    return found.select(*asked.columns, F.col("_v.blob").alias("blob"), F.col("_v.ordinal").alias("since"))


def intervals(versions: DataFrame) -> DataFrame:
    """path, since, until (exclusive, null: still), blob of versions on a linear history; deletions end intervals."""
    until = F.lead("ordinal").over(Window.partitionBy("path").orderBy("ordinal"))
    return versions.select("path", F.col("ordinal").alias("since"), until.alias("until"), "blob").filter("blob is not null")


def trees(parents: DataFrame, versions: DataFrame, revisions: DataFrame) -> DataFrame:
    """revision, path, blob, hash: every file of revisions (revision) in a history with branches.

    parents: hash, parent; versions: path, hash, blob (null: deleted).  The version of the
    nearest ancestor counts, of equally near ones that with the largest hash.  Rows grow with
    revisions times their ancestors, so revisions are few.
    """
    links = parents.select(F.col("hash").alias("source"), F.col("parent").alias("target"))
    seeds = revisions.select("revision", F.col("revision").alias("id"))
    near = settled(levels(links, seeds, ("revision",))).withColumnRenamed("id", "hash")
    rows = near.join(versions, "hash").groupBy("revision", "path").agg(
        F.min_by(F.struct("blob", "hash"), F.struct("distance", -F.col("hash"))).alias("v")
    )
    return rows.filter("v.blob is not null").select("revision", "path", "v.blob", "v.hash")
