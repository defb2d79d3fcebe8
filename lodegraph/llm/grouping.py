"""Joins by skewed keys and connected components, without unbounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import stored

HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with their groups (one row for each key, size: its number of rows).

    Groups above a thousandth of the rows are at most HOT_SHARE many, so they are
    broadcast; no other key brings more than a thousandth of the rows to the shuffle.
    """
    most = max(1, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(size) <= most), key, "left")
    return rows.join(hot, key).unionByName(rest)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of edges (u, v: long).

    Alternates large-star and small-star steps until the edges are stars: a number of
    rounds logarithmic in the component size.  Each round is written to the shared
    folder, so a lost executor costs one round at most.
    """
    now = stored(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while before != (before := _mark(now)):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that the join below has a shuffle of its own on either side: Spark splits the one of a hub.
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = stored(small)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
