"""What a changed interface breaks, probes before a migration, and simulated changes of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.tables import settled
from lodegraph.operators import closure, diffs

MOST_OPERATIONS = 100
# Least and greatest value of the integer types.
RANGES = {
    "tinyint": "-128 AND 127",
    "smallint": "-32768 AND 32767",
    "integer": "-2147483648 AND 2147483647",
    "bigint": "-9223372036854775808 AND 9223372036854775807",
}


def api_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """operation, field, change, verdict: request fields (operation, id, type, required) of two revisions.

    Fields of an operation that only one side has are told by the operation alone.
    """
    ops = diffs.presence(before, after, ["operation"])
    gone = F.col("change") == "removed"
    whole = ops.select(
        "operation",
        F.lit(None).cast("long").alias("field"),
        F.concat(F.lit("operation-"), "change").alias("change"),
        F.when(gone, "breaking").otherwise("safe").alias("verdict"),
    )
    found = diffs.changes(before, after, ["operation", "id"], ["type", "required"]).join(ops.select("operation"), "operation", "left_anti")
    typed = (F.col("change") == "changed") & (F.col("old_type") != F.col("new_type"))
    verdict = (
        F.when(gone, "conditional")
        .when(typed, F.when(diffs.widens("old_type", "new_type"), "safe").otherwise("breaking"))
        .otherwise(F.when(F.col("new_required"), "breaking").otherwise("safe"))
    )
    kind = F.when(typed, "type").when(F.col("change") == "changed", "required").otherwise(F.col("change"))
    return whole.unionByName(found.select("operation", F.col("id").alias("field"), kind.alias("change"), verdict.alias("verdict")))


def public_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, name, change: removed, added or changed-signature of public symbols (file, name, type, parameters)."""
    found = diffs.changes(before, after, ["file", "name"], ["type", "parameters"])
    change = F.when(F.col("change") == "changed", "changed-signature").otherwise(F.col("change"))
    return found.select("file", "name", change.alias("change"))


def surface(changes: DataFrame, consumers: DataFrame) -> DataFrame:
    """file, removed, changed, added, breaking, consumers of each file with a changed surface."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    rows = changes.groupBy("file").agg(
        count("removed").alias("removed"), count("changed-signature").alias("changed"), count("added").alias("added")
    )
    rows = rows.withColumn("breaking", F.col("removed") + F.col("changed") > 0)
    return rows.join(consumers, "file", "left").fillna(0, ["consumers"])


def preflight(changes: DataFrame) -> DataFrame:
    """column, check, effect, probe: what must hold of the data before a schema change, as one query each.

    changes: table, column and old_/new_ type, nullable, default, change of columns.
    """
    plain = r"^[A-Za-z_][A-Za-z0-9_]*$"
    rows = changes.filter(F.col("table").rlike(plain) & F.col("column").rlike(plain))
    count = F.concat(F.lit("SELECT COUNT(*) AS violations FROM "), "table")
    where = lambda text: F.concat(count, F.lit(" WHERE "), "column", text)
    ranges = F.create_map(*(F.lit(x) for pair in RANGES.items() for x in pair))
    both = F.col("change") == "changed"
    needed = ~F.col("new_nullable")
    tests = (
        ("add-not-null-column", "blocks", (F.col("change") == "added") & needed & F.col("new_default").isNull(), count),
        ("set-not-null", "blocks", both & F.col("old_nullable") & needed, where(F.lit(" IS NULL"))),
        (
            "drop-column",
            "data-loss",
            F.col("change") == "removed",
            F.concat(F.lit("SELECT COUNT("), "column", F.lit(") AS violations FROM "), "table"),
        ),
        (
            "narrow-integer",
            "blocks",
            both & (F.col("old_type") != F.col("new_type")) & ~diffs.widens("old_type", "new_type") & ranges[F.col("new_type")].isNotNull(),
            where(F.concat(F.lit(" NOT BETWEEN "), ranges[F.col("new_type")])),
        ),
    )
    found = F.array_compact(
        F.array(
            *(
                F.when(test, F.struct(F.lit(name).alias("check"), F.lit(effect).alias("effect"), probe.alias("probe")))
                for name, effect, test, probe in tests
            )
        )
    )
    return rows.select("column", F.explode(found).alias("f")).select("column", "f.*")


def simulate(edges: DataFrame, operations: list[tuple]) -> DataFrame:
    """measure, n: what operations do to edges (source, target: paths), in their order.

    ('cut', source, target), ('add', source, target) or ('move', from, to): a file or
    folder takes another path.  The graph before is the recorded one under the new paths, so
    that a move shows what it changes and not every edge that it renames.  At most
    MOST_OPERATIONS are applied; more raise an error.
    """
    if len(operations) > MOST_OPERATIONS:
        raise ValueError(f"more than {MOST_OPERATIONS} operations")
    before = after = edges.select("source", "target")
    spark = edges.sparkSession

    def moved(rows, old, new):
        for c in ("source", "target"):
            at = (F.col(c) == old) | F.col(c).startswith(old + "/")
            rows = rows.withColumn(c, F.when(at, F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(F.col(c)))
        return rows

    run, kind = [], None

    def flushed(rows):
        if not run:
            return rows
        table = F.broadcast(spark.createDataFrame(run, "source string, target string"))
        return rows.join(table, ["source", "target"], "left_anti") if kind == "cut" else rows.unionByName(table).distinct()

    for op, a, b in operations:
        if op != kind:
            after, run, kind = flushed(after), [], op
        if op == "move":
            before, after = moved(before, a, b), moved(after, a, b)
        else:
            run.append((a, b))
    before, after = settled(before), settled(flushed(after))
    parts = [diffs.presence(before, after, ["source", "target"]).groupBy(F.concat(F.lit("edges-"), "change").alias("measure")).agg(F.count(F.lit(1)).alias("n"))]
    # A cycle is known by its least member, its size and the sum of its members' hashes.
    mark = F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark")
    known = ["cycle", "size", "mark"]
    groups = [closure.cycles(side).groupBy("cycle").agg(F.count(F.lit(1)).alias("size"), mark) for side in (before, after)]
    for name, (a, b) in {"cycles-removed": groups, "cycles-added": groups[::-1]}.items():
        parts.append(a.join(b, known, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
