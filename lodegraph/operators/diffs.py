"""Differences of two revisions and what they break, as full outer joins and anti-joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def presence(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change ('added' or 'removed') of the rows that only one side has."""
    gone = before.select(*keys).distinct().join(after, keys, "left_anti").withColumn("change", F.lit("removed"))
    new = after.select(*keys).distinct().join(before, keys, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def changes(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, old_<field>, new_<field>, change of the rows that differ; rows are unique by keys."""
    old = before.select(*keys, *(F.col(f).alias(f"old_{f}") for f in fields), F.lit(True).alias("_old"))
    new = after.select(*keys, *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("_new"))
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(differs, "changed")
    return old.join(new, keys, "full_outer").withColumn("change", change).filter("change is not null").drop("_old", "_new")


def deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after, delta: sums of value by key on either side; 0 where a side has none."""
    a = before.groupBy(*keys).agg(F.sum(value).alias("before"))
    b = after.groupBy(*keys).agg(F.sum(value).alias("after"))
    rows = a.join(b, keys, "full_outer").fillna(0, ["before", "after"])
    return rows.withColumn("delta", F.col("after") - F.col("before")).filter("delta <> 0")


def field_severity() -> Column:
    """Severity of a contract field's change: removals, types and new demands break."""
    demanded = F.col("new_required") & ~F.coalesce(F.col("old_required"), F.lit(False))
    return (
        F.when(F.col("change") == "removed", "breaking")
        .when((F.col("change") == "changed") & (F.col("old_type") != F.col("new_type")), "breaking")
        .when((F.col("change") == "added") & demanded, "breaking")
        .otherwise("additive")
    )


def field_compatibility() -> Column:
    """The stricter scheme: breaking, conditional or safe."""
    return (
        F.when(F.col("change") == "removed", "breaking")
        .when(F.col("change") == "added", F.when(F.col("new_required"), "conditional").otherwise("safe"))
        .when(F.col("old_type") != F.col("new_type"), F.when(widens("old_type", "new_type"), "conditional").otherwise("breaking"))
        .otherwise("conditional")
    )


def widens(old: str, new: str) -> Column:
    """Whether a number type became a wider one of its family."""
    order = F.create_map(*(F.lit(x) for i, t in enumerate(("tinyint", "smallint", "integer", "bigint")) for x in (t, i)))
    reals = F.create_map(*(F.lit(x) for i, t in enumerate(("real", "double")) for x in (t, i)))
    return F.coalesce((order[F.col(new)] > order[F.col(old)]) | (reals[F.col(new)] > reals[F.col(old)]), F.lit(False))


def column_compatibility() -> Column:
    """What a column's change does to code that still runs against the table."""
    needed = ~F.col("new_nullable") & F.col("new_default").isNull()
    return (
        F.when(F.col("change") == "removed", "breaking")
        .when(F.col("change") == "added", F.when(needed, "breaking").otherwise("safe"))
        .when(
            F.col("old_type") != F.col("new_type"),
            F.when(widens("old_type", "new_type"), "conditional").otherwise("breaking"),
        )
        .when(F.col("old_nullable") != F.col("new_nullable"), F.when(F.col("new_nullable"), "conditional").otherwise("breaking"))
        .when(F.col("old_default").isNull(), "safe")
        .otherwise("conditional")
    )


def without_baseline(findings: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """findings that the baseline does not hold."""
    return findings.join(baseline.select(*keys).distinct(), keys, "left_anti")


# ---------------------------------------------------------------- probes before a migration

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def probe(rows: DataFrame, name: str, condition: str) -> DataFrame:
    """probe, violations: rows that meet a condition."""
    return rows.filter(condition).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("probe"), "violations")


def unique_probe(rows: DataFrame, name: str, keys: list[str], where: str = "true") -> DataFrame:
    """Groups above one row; keys with a null part do not count."""
    groups = rows.filter(where).na.drop(subset=keys).groupBy(*keys).count().filter("count > 1")
    return groups.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("probe"), "violations")


def foreign_key_probe(rows: DataFrame, name: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; null keys pass."""
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    return probe(rows.filter(F.col(key).isNotNull()).join(known, key, "left_anti"), name, "true")


def identifiers(*names: str) -> None:
    """Reject names that are not plain identifiers."""
    for name in names:
        if not _NAME.match(name):
            raise ValueError(f"not a plain identifier: {name!r}")


def read_only(sql: str) -> bool:
    """Whether a probe text is one plain select statement, without comments and without a table to write to."""
    text = sql.strip().rstrip(";").strip()
    words = set(re.findall(r"[a-z]+", re.sub(r"'(?:[^']|'')*'", "", text.lower())))
    changing = {"into", "insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "copy", "merge", "call"}
    return bool(re.match(r"(?is)^select\b", text)) and not re.search(r";|--|/\*", text) and not words & changing


def safe_revision(revision: str) -> bool:
    """Whether a revision cannot be taken for an option."""
    return bool(revision) and not revision.startswith("-")
