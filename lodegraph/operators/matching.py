"""Joins that resolve references: candidates, prefixes, spans, flows and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import glob_pattern, joined
from lodegraph.functions.ranks import first_rows
from lodegraph.functions.tables import settled

# Extensions that an import may leave out, in the order they are tried.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json")
RULE_ROWS = 10_000
PREFIX_PAIRS = 2


def import_candidates(base: Column) -> Column:
    """Paths that an import of base may name, with the kind of resolution, best first."""
    parts = [F.struct(base.alias("path"), F.lit("exact").alias("resolution"))]
    for prefix, kind in (("", "extension"), ("/index", "index")):
        for extension in EXTENSIONS:
            parts.append(
                F.struct(F.concat(base, F.lit(prefix + extension)).alias("path"), F.lit(kind).alias("resolution"))
            )
    return F.array(*parts)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, specifier, ...) with target and resolution; null where no file matches.

    imports: file is the importer's path.  files: path.  The first candidate that exists wins.
    """
    base = joined(F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(""), F.col("specifier"))
    tried = imports.withColumn("_row", F.monotonically_increasing_id()).select(
        "*", F.posexplode(import_candidates(base)).alias("_at", "_c")
    )
    hits = (
        tried.join(files.select(F.col("path").alias("target")).distinct(), F.col("_c.path") == F.col("target"), "left")
        .groupBy("_row", *imports.columns)
        .agg(F.min(F.when(F.col("target").isNotNull(), F.struct("_at", "target", "_c.resolution"))).alias("_hit"))
    )
    return hits.select(*imports.columns, "_hit.target", "_hit.resolution")


def prefixes(path: Column, separator: str = "/") -> Column:
    """All leading segments of a path, shortest first, itself included."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def longest_prefix(rows: DataFrame, path: str, units: DataFrame, default: str = ".") -> DataFrame:
    """rows with unit: the deepest of units (unit) that encloses path, else default.

    Ancestors are exploded into an equality join, so no row is compared with all units.  Each
    path is placed once and rows take its unit by the path itself: numbers given to rows would
    differ between the two sides of that join whenever their rows come in another order.
    """
    places = rows.select(F.col(path).alias("_path")).filter(F.col(path).isNotNull()).distinct()
    up = places.select("_path", F.posexplode(prefixes(F.col("_path"))).alias("_depth", "unit"))
    best = up.join(units.select("unit").distinct(), "unit").groupBy("_path").agg(F.max_by("unit", "_depth").alias("unit"))
    return rows.join(best, F.col(path) == F.col("_path"), "left").drop("_path").withColumn("unit", F.coalesce("unit", F.lit(default)))


def package_flows(publishers: DataFrame, imports: DataFrame) -> DataFrame:
    """source, target, package, files: repositories that import what another publishes."""
    found = imports.join(publishers.withColumnRenamed("repository", "target"), ["ecosystem", "package"])
    return (
        found.filter("repository <> target")
        .groupBy(F.col("repository").alias("source"), "target", "package")
        .agg(F.count_distinct("file").alias("files"))
    )


def service_flows(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """call, endpoint: calls matched by host and path; a null method matches a sole candidate only."""
    sole = endpoints.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.min("endpoint").alias("only"))
    named = calls.filter("method is not null").join(endpoints, ["host", "path", "method"]).select("call", "endpoint")
    open_ = calls.filter("method is null").join(sole.filter("n = 1"), ["host", "path"])
    return named.unionByName(open_.select("call", F.col("only").alias("endpoint")))


def event_flows(ends: DataFrame) -> DataFrame:
    """kind, topic, producers, consumers; ends: kind, topic, side, file."""
    return ends.groupBy("kind", "topic").agg(
        F.count_distinct(F.when(F.col("side") == "producer", F.col("file"))).alias("producers"),
        F.count_distinct(F.when(F.col("side") == "consumer", F.col("file"))).alias("consumers"),
    )


def unknown_uses(uses: DataFrame, columns: DataFrame) -> DataFrame:
    """kind, name, column of uses (name, column) that columns (name, column) does not declare."""
    declared = columns.select("name").distinct()
    table = uses.join(declared, "name", "left_anti").select(
        F.lit("unknown-table").alias("kind"), "name", F.lit(None).cast("string").alias("column")
    )
    column = (
        uses.join(declared, "name", "left_semi")
        .join(columns, ["name", "column"], "left_anti")
        .select(F.lit("unknown-column").alias("kind"), "name", "column")
    )
    return table.unionByName(column).distinct()


def rule_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, source, target: edges between paths that a rule forbids.

    rules: rule, from_glob, to_glob; declared by people and at most RULE_ROWS.  Each rule
    becomes one expression, so that edges are read once and never paired with all rules.
    """
    found = rules.limit(RULE_ROWS + 1).collect()
    if len(found) > RULE_ROWS:
        raise ValueError(f"more than {RULE_ROWS} rules")
    hits = [
        F.when(
            F.col("source").rlike(glob_pattern(r["from_glob"])) & F.col("target").rlike(glob_pattern(r["to_glob"])),
            F.lit(r["rule"]),
        )
        for r in found
    ]
    return edges.select(F.explode(F.array_compact(F.array(*hits))).alias("rule"), "source", "target")


def string_edges(reads: DataFrame, declarations: DataFrame) -> DataFrame:
    """key, reader, declared_in: readers of each declared key; keys without declaration need two readers."""
    own = reads.groupBy("key").agg(F.count_distinct("reader").alias("readers"))
    joined_ = reads.join(declarations, "key", "left").join(own, "key")
    return joined_.filter("declared_in is not null or readers >= 2").select("key", "reader", "declared_in").distinct()


def route_shape(path: Column) -> Column:
    """A path with its parameters as {}."""
    return F.regexp_replace(path, r"\{[^}]*\}|:[A-Za-z_]+|<[^>]*>", "{}")


def route_conformance(operations: DataFrame, routes: DataFrame) -> DataFrame:
    """operation, route, via: declared operations matched with routes in code, in three passes.

    Both have method and path.  Unmatched operations have a null route, unmatched routes a
    null operation.  A later pass sees what an earlier one left: equal paths, equal shapes,
    and one leading prefix that most of the rest share (PREFIX_PAIRS pairs at least, or the
    only pair), where it leaves a single partner on each side.
    """
    ops = operations.select("operation", "method", F.col("path").alias("key"))
    code = routes.select("route", "method", F.col("path").alias("key"))
    parts = []
    for via in ("exact", "parameters"):
        if via == "parameters":
            ops, code = (d.withColumn("key", route_shape(F.col("key"))) for d in (ops, code))
        firsts = code.groupBy("method", "key").agg(F.min("route").alias("route"))
        hit = ops.join(firsts, ["method", "key"]).select("operation", "route", F.lit(via).alias("via"), "method", "key")
        parts.append(hit.select("operation", "route", "via"))
        ops = ops.join(hit.select("operation"), "operation", "left_anti")
        code = code.join(hit.select("method", "key").distinct(), ["method", "key"], "left_anti")
    hit = settled(_by_prefix(ops, code))
    parts.append(hit.withColumn("via", F.lit("prefix")))
    ops, code = ops.join(hit, "operation", "left_anti"), code.join(hit, "route", "left_anti")
    none = F.lit(None).cast("long")
    parts.append(ops.select("operation", none.alias("route"), F.lit("unimplemented").alias("via")))
    parts.append(code.select(none.alias("operation"), "route", F.lit("undocumented").alias("via")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_prefix(operations: DataFrame, routes: DataFrame) -> DataFrame:
    """operation, route: pairs of one method that the dominant prefix of either side sets apart."""

    def shorter(rows):
        parts = F.split("key", "/")
        cuts = F.sequence(F.lit(2), F.size(parts) - 1)
        cut = F.transform(
            F.when(F.size(parts) > 2, cuts),
            lambda n: F.struct(
                F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix"),
                F.concat(F.lit("/"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/")).alias("tail"),
            ),
        )
        return rows.select("*", F.explode(cut).alias("c")).select(*rows.columns, "c.*")

    spec = shorter(operations).join(routes.withColumnRenamed("key", "tail"), ["method", "tail"])
    code = shorter(routes).join(operations.withColumnRenamed("key", "tail"), ["method", "tail"])
    columns = ["operation", "route", "prefix"]
    pairs = settled(spec.select(*columns, F.lit("spec").alias("side")).unionByName(code.select(*columns, F.lit("code").alias("side"))))
    total = pairs.agg(F.count(F.lit(1)).alias("all"))
    top = pairs.groupBy("side", "prefix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "side", "prefix").limit(1)
    top = top.join(F.broadcast(total)).filter((F.col("n") >= PREFIX_PAIRS) | (F.col("all") == 1)).select("side", "prefix")
    chosen = settled(pairs.join(F.broadcast(top), ["side", "prefix"]).select("operation", "route"))
    def sole(side):
        return chosen.groupBy(side).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(side)

    return chosen.join(sole("operation"), "operation", "left_semi").join(sole("route"), "route", "left_semi").select("operation", "route")


def spans_touched(changes: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """changes (file, line) within spans (file, start, end), as a join on line buckets of width.

    A span is exploded into the buckets it covers: cost follows its length, not the file's.
    """
    bucketed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    lines = changes.withColumn("_b", F.floor(F.col("line") / width))
    return lines.join(bucketed, ["file", "_b"]).filter("line between start and end").drop("_b")


def nearest(rows: DataFrame, candidates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """rows joined with the first of their candidates by order."""
    return first_rows(rows.join(candidates, keys), rows.columns, order)
