"""Predicates and roll-ups over the fact tables of a repository estate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.ranks import first_rows

# Thresholds from which a function shows a signal.
NESTED_LOOPS, DEEP_NESTING, HIGH_COMPLEXITY, LONG_FUNCTION, MANY_PARAMETERS = 2, 4, 10, 50, 5


def relationship() -> Column:
    """What an edge says: as declared, or by its kind and role."""
    declares = F.col("role") == "declare"
    return F.coalesce(
        F.col("relationship"),
        F.when(F.col("kind") == "re-export", "re-export")
        .when(declares & (F.col("kind") == "namespace"), "module-declaration")
        .when(declares, "executable-module")
        .otherwise("import"),
    )


def used_edges(rows: DataFrame, re_exports: bool = False, declared: bool = False) -> DataFrame:
    """Distinct source, target of the edges that count; self-loops never do."""
    kept = F.lit(True) if declared else F.col("role") == "use"
    if re_exports and not declared:
        kept = kept | (F.col("kind") == "re-export")
    return rows.filter((F.col("source") != F.col("target")) & kept).select("source", "target").distinct()


def adjacency_sizes(rows: DataFrame) -> DataFrame:
    """option, n: neighbour pairs under each choice of edges, in one pass over the pairs."""
    pairs = (
        rows.filter("source <> target")
        .groupBy("source", "target")
        .agg(
            F.bool_or(F.col("role") == "use").alias("used"),
            F.bool_or((F.col("role") == "use") | (F.col("kind") == "re-export")).alias("kept"),
        )
    )
    sizes = pairs.agg(
        F.count(F.lit(1)).alias("a"), F.count_if("used").alias("u"), F.count_if("kept").alias("k")
    )
    return sizes.selectExpr("stack(3, 'all', a, 'use', u, 'use and re-export', k) as (option, n)")


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """edges with from_<column> and to_<column> of their end nodes; edges without both ends go."""
    start = nodes.select(F.col("id").alias("source"), *(F.col(c).alias(f"from_{c}") for c in columns))
    end = nodes.select(F.col("id").alias("target"), *(F.col(c).alias(f"to_{c}") for c in columns))
    return edges.join(start, "source").join(end, "target")


def excluded(nodes: DataFrame, markers: list[str]) -> DataFrame:
    """nodes whose path has a segment among markers, with the first such segment as detail."""
    hits = F.filter(F.split("path", "/"), lambda s: s.isin(*markers))
    return nodes.withColumn("detail", F.concat(F.try_element_at(hits, F.lit(1)), F.lit("/"))).filter("detail is not null")


def periphery(path: Column) -> Column:
    """The class of a path outside the authored core, else 'source'."""
    return (
        F.when(path.rlike(r"(^|/)(tests?|specs?)/|[._](test|spec)\."), "tests")
        .when(path.rlike(r"(^|/)(scripts?|tools?)/"), "scripts")
        .when(path.rlike(r"(^|/)(gear|generated)/"), "generated")
        .when(path.rlike(r"(^|/)docs?/"), "docs")
        .otherwise("source")
    )


def signals() -> Column:
    """The signals that a row of functions shows."""
    tests = {
        "nested-loops": F.col("loops") >= NESTED_LOOPS,
        "linear-scan-in-loop": F.col("scans") > 0,
        "sort-in-loop": F.col("sorts") > 0,
        "deep-nesting": F.col("nesting") >= DEEP_NESTING,
        "high-complexity": F.col("decisions") >= HIGH_COMPLEXITY,
        "long-function": F.col("lines") >= LONG_FUNCTION,
        "many-parameters": F.col("parameters") >= MANY_PARAMETERS,
        "recursion": F.col("recursive"),
    }
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items())))


def directory_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """directory, files, fan_in: sums over the files of each directory."""
    fan_in = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return (
        nodes.join(fan_in, "id", "left")
        .groupBy("directory")
        .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("fan_in"), F.lit(0)).alias("fan_in"))
    )


def directory_tops(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """directory, id, fan_in, rank: the most imported files of each directory."""
    from pyspark.sql import Window

    fan_in = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    rows = nodes.join(fan_in, "id", "left").select("directory", "id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
    order = [F.desc("fan_in"), F.col("id")]
    top = first_rows(rows, ["directory"], order, most)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("directory").orderBy(*order)).cast("long"))


def product_candidates(data_edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """dataset, kind, n: datasets that look like products, by three rules."""
    writes, reads = data_edges.filter("access = 'writes'"), data_edges.filter("access = 'reads'")
    written = writes.select("dataset").distinct()
    single = writes.groupBy("dataset").agg(F.count_distinct("unit").alias("n")).filter("n >= 2")
    read = reads.join(written, "dataset", "left_semi")
    port = read.join(writes, ["dataset", "unit"], "left_anti").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    shared = (
        read.join(contracts, "dataset", "left_anti")
        .join(writes, ["dataset", "repository"], "left_anti")
        .groupBy("dataset")
        .agg(F.count_distinct("repository").alias("n"))
    )
    parts = {"no-single-writer": single, "output-port": port, "shared-without-contract": shared}
    found = None
    for kind, part in parts.items():
        rows = part.select("dataset", F.lit(kind).alias("kind"), "n")
        found = rows if found is None else found.unionByName(rows)
    return found


def duplicated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n: groups of rows that share a key; keys with a null part do not count."""
    return rows.na.drop(subset=keys).groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))


def orphans(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """n: rows with a key that others do not have."""
    known = others.select(F.col(other_key).alias(key)).distinct()
    return rows.filter(F.col(key).isNotNull()).join(known, key, "left_anti").agg(F.count(F.lit(1)).alias("n"))


def model_findings(lines: DataFrame, parts: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """finding, name, n: missing keys, tables without use, keys without a row."""
    found = [
        ("no-primary-key", "lineitem", duplicated_keys(lines, ["l_orderkey", "l_linenumber"])),
        ("orphan-table", "part", orphans(parts, "p_partkey", lines, "l_partkey")),
        ("orphan-table", "customer", orphans(customers, "c_custkey", orders, "o_custkey")),
        ("undeclared-key", "orders", orphans(orders, "o_custkey", customers, "c_custkey")),
    ]
    out = None
    for finding, name, count in found:
        row = count.select(F.lit(finding).alias("finding"), F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
