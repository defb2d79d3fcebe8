"""Facts that source texts state in literals: routes, calls, events, SQL uses, lineage, contracts; and exports.

Texts are rows (file, content).  Only what a literal names is read; nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.ranks import first_rows

# How frameworks register routes, clients call them, and producers and consumers name topics.
ROUTE_PATTERNS = {
    "express": r"""\b(?:app|router|server|fastify)\.(get|post|put|patch|delete)\(\s*['"`](/[^'"`]*)['"`]""",
    "nest": r"""@(Get|Post|Put|Patch|Delete)\(\s*['"]([^'"]*)['"]""",
    "fastapi": r"""@(?:app|router)\.(get|post|put|patch|delete)\(\s*['"](/[^'"]*)['"]""",
    "spring": r"""@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?"([^"]*)\"""",
}
CALL_PATTERN = r"""\b(?:axios|http|client|requests)\.(get|post|put|patch|delete)\(\s*['"`](https?://[^'"`/]+)?(/[^'"`]*)['"`]"""
PRODUCE = r"""\.(?:emit|publish|send|produce)\(\s*['"]([\w.:/-]+)['"]"""
CONSUME = r"""\.(?:on|subscribe|consume|addListener)\(\s*['"]([\w.:/-]+)['"]"""
TABLE = r"""([A-Za-z_][\w.]*)"""


def _lines(texts: DataFrame) -> DataFrame:
    rows = texts.select("file", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line").cast("long") + 1).filter(~F.col("text").rlike(r"^\s*(//|#|\*)"))


def _found(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))


def routes(texts: DataFrame) -> DataFrame:
    """file, line, framework, method, path of routes that code registers; a place counts once."""
    rows, out = _lines(texts), None
    for framework, pattern in ROUTE_PATTERNS.items():
        part = _found(rows, pattern).select(
            "file",
            "line",
            F.lit(framework).alias("framework"),
            F.upper(F.regexp_extract("m", pattern, 1)).alias("method"),
            F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract("m", pattern, 2)), "^//", "/").alias("path"),
        )
        out = part if out is None else out.unionByName(part)
    return first_rows(out, ["file", "line", "method", "path"], ["framework"])


def service_calls(texts: DataFrame) -> DataFrame:
    """file, line, method, host, path of literal HTTP calls; relative calls have no host."""
    host = F.regexp_extract("m", CALL_PATTERN, 2)
    return _found(_lines(texts), CALL_PATTERN).select(
        "file",
        "line",
        F.upper(F.regexp_extract("m", CALL_PATTERN, 1)).alias("method"),
        F.when(host != "", F.regexp_replace(host, "^https?://", "")).alias("host"),
        F.regexp_extract("m", CALL_PATTERN, 3).alias("path"),
    )


def event_ends(texts: DataFrame) -> DataFrame:
    """file, line, side (producer or consumer), topic of events named in literals."""
    rows = _lines(texts)
    side = lambda pattern, name: _found(rows, pattern).select(
        "file", "line", F.lit(name).alias("side"), F.regexp_extract("m", pattern, 1).alias("topic")
    )
    return side(PRODUCE, "producer").unionByName(side(CONSUME, "consumer"))


def _sql(content: Column) -> Column:
    """SQL text without comments and string values, in one line."""
    plain = F.regexp_replace(content, r"(?s)--[^\n]*|/\*.*?\*/", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"'[^']*'", "''"), r"\s+", " ")


def data_uses(texts: DataFrame) -> DataFrame:
    """file, access (reads or writes), name of the tables that SQL statements in texts use; names of WITH parts are none."""
    rows = texts.select("file", F.explode(F.split(_sql(F.col("content")), ";")).alias("s"))
    rows = rows.filter(F.col("s").rlike(r"(?i)\b(select|insert|update|delete|merge)\b"))
    parts = F.regexp_extract_all("s", F.lit(rf"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*){TABLE}(?:\s*\([^)]*\))?\s+as\s*\("), F.lit(1))
    reads = F.regexp_extract_all("s", F.lit(rf"(?i)\b(?:from|join)\s+{TABLE}"), F.lit(1))
    writes = F.regexp_extract_all("s", F.lit(rf"(?i)\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+{TABLE}"), F.lit(1))
    deleted = F.regexp_extract_all("s", F.lit(rf"(?i)\bdelete\s+from\s+{TABLE}"), F.lit(1))
    lower = lambda c: F.transform(c, F.lower)
    rows = rows.select("file", lower(writes).alias("w"), F.array_except(lower(reads), F.concat(lower(parts), lower(deleted))).alias("r"))
    side = lambda c, name: rows.select("file", F.lit(name).alias("access"), F.explode(c).alias("name"))
    return side("r", "reads").unionByName(side("w", "writes")).filter("name <> 'select'").distinct()


def lineage(texts: DataFrame) -> DataFrame:
    """file, source, target of INSERT ... SELECT and CREATE TABLE ... AS SELECT statements."""
    rows = texts.select("file", F.explode(F.split(_sql(F.col("content")), ";")).alias("s"))
    into = rf"(?i)\b(?:insert\s+(?:into|overwrite)(?:\s+table)?|create\s+(?:or\s+replace\s+)?(?:table|view|materialized\s+view)(?:\s+if\s+not\s+exists)?)\s+{TABLE}.*?\bselect\b"
    target = F.lower(F.regexp_extract("s", into, 1))
    parts = F.transform(F.regexp_extract_all("s", F.lit(rf"(?i)(?:\bwith\s+|,\s*){TABLE}\s+as\s*\("), F.lit(1)), F.lower)
    sources = F.transform(F.regexp_extract_all("s", F.lit(rf"(?i)\b(?:from|join)\s+{TABLE}"), F.lit(1)), F.lower)
    rows = rows.select("file", target.alias("target"), F.explode(F.array_except(sources, parts)).alias("source"))
    return rows.filter("target <> '' and target <> source").select("file", "source", "target").distinct()


def openapi_operations(texts: DataFrame) -> DataFrame:
    """file, method, path, operation_id of OpenAPI documents in JSON."""
    schema = "paths map<string, map<string, struct<operationId:string>>>"
    rows = texts.select("file", F.explode(F.from_json("content", schema)["paths"]).alias("path", "o"))
    rows = rows.select("file", "path", F.explode("o").alias("method", "d"))
    verbs = "get post put patch delete head options".split()
    return rows.filter(F.col("method").isin(verbs)).select("file", F.upper("method").alias("method"), "path", F.col("d.operationId").alias("operation_id"))


def schema_fields(texts: DataFrame) -> DataFrame:
    """file, field, type, required of the properties of JSON schemas."""
    schema = "properties map<string, struct<type:string>>, required array<string>"
    rows = texts.select("file", F.from_json("content", schema).alias("j"))
    needed = F.coalesce("j.required", F.expr("cast(array() as array<string>)"))
    rows = rows.select("file", needed.alias("r"), F.explode("j.properties").alias("field", "p"))
    return rows.select("file", "field", "p.type", F.array_contains("r", F.col("field")).alias("required"))


# ---------------------------------------------------------------- exports


def dot_lines(edges: DataFrame) -> DataFrame:
    """value: one line of a DOT graph for each edge (source, target); a head and a tail line enclose them."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '(["\\\\])', "\\\\$1"), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quoted("source"), F.lit(" -> "), quoted("target"), F.lit(";")).alias("value"))


def lineage_events(edges: DataFrame, namespace: str) -> DataFrame:
    """value: an OpenLineage run event in JSON for each target, with its inputs; edges: source, target."""
    name = lambda c: F.struct(F.lit(namespace).alias("namespace"), F.col(c).cast("string").alias("name"))
    rows = edges.select("target", name("source").alias("i")).distinct()
    rows = rows.groupBy("target").agg(F.array_sort(F.collect_list("i")).alias("inputs"))
    event = F.struct(
        F.lit("COMPLETE").alias("eventType"),
        F.struct(F.lit(namespace).alias("namespace"), F.concat(F.lit("build:"), F.col("target").cast("string")).alias("name")).alias("job"),
        F.col("inputs"),
        F.array(name("target")).alias("outputs"),
    )
    return rows.select(F.to_json(event).alias("value"))


def markdown_table(rows: DataFrame) -> DataFrame:
    """value: a Markdown table line for each row; bars in values are escaped, null is a dash."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"\|", r"\\|") for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
