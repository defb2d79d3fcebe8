"""Ranks over a whole table without a window that holds the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.tables import settled

HOT_SHARE = 1000


def half_up(x: Column) -> Column:
    """The nearest integer as a long, halves upward."""
    return F.floor(x + 0.5).cast("long")


def decimals(x: Column, digits: int) -> Column:
    """x rounded to digits after the point, halves upward."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def smaller_counts(values: DataFrame, column: str, groups: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """by, column, n, smaller: how often each value occurs, and how many rows have a smaller one.

    Equal values are added up first.  Distinct values then lie in ranges; sums within a
    range plus sums over ranges give the total, so no task holds more than one range.
    """
    counted = values.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    ranged = settled(
        counted.repartitionByRange(groups, *by, column).withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy("_range", *by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_range", *by).agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["_range", *by])  # at most `groups` rows, and one more for each of by
        .select(*by, column, "n", (F.col("_inside") + F.col("_offset")).alias("smaller"))
    )


def percentiles(rows: DataFrame, columns: list[str], total: int) -> DataFrame:
    """rows with <column>_rank: 0 to 100 by the number of smaller values; 100 where there is one row.

    Columns are numbers, ranked together in long form; null values count and rank as
    smallest.  Values of more than a thousandth of the rows are at most a thousand in each
    column: their ranks are broadcast, so that no key of the shuffled join is frequent.
    """
    base = settled(rows.withColumn("_row", F.monotonically_increasing_id()))
    cells = F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns))
    cells = base.select("_row", F.explode(cells).alias("_x")).select("_row", "_x.*")
    rank = half_up(F.col("smaller") / F.lit(max(1, total - 1)) * 100) if total > 1 else F.lit(100).cast("long")
    ranks = smaller_counts(cells, "_v", by=("_c",)).select("_c", F.col("_v").alias("_w"), "n", rank.alias("_rank"))
    ranks, most = settled(ranks), max(1, total // HOT_SHARE)
    cells = cells.alias("l")

    def same(side):
        return (F.col("l._c") == side["_c"]) & F.col("l._v").eqNullSafe(side["_w"])

    hot, cold = F.broadcast(ranks.filter(F.col("n") > most)), ranks.filter(F.col("n") <= most)
    found = cells.join(hot, same(hot)).select("_row", "l._c", "_rank")
    found = found.unionByName(
        cells.join(hot, same(hot), "left_anti").join(cold, same(cold)).select("_row", "l._c", "_rank")
    )
    wide = found.groupBy("_row").agg(*(F.max(F.when(F.col("_c") == c, F.col("_rank"))).alias(f"{c}_rank") for c in columns))
    return base.join(wide, "_row").drop("_row")


def first_rows(rows: DataFrame, keys: list[str], order: list, most: int = 1) -> DataFrame:
    """The first rows of each group by order; Spark drops the others before the shuffle."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(by)).filter(F.col("_nth") <= most).drop("_nth")
