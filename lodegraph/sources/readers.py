"""Fact tables from texts of a repository estate: commits, coverage, manifests, imports, diffs.

Texts are read as lines with their file and number, so a file may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.tables import settled

# Separators of the log format (records and fields).
RECORD, FIELD = "\u001e", "\u001f"
RULE_ROWS, RULES_AT_ONCE = 10_000, 200
IMPORT = r"""(?:import|export)\s(?:[^'";]*?\sfrom\s*)?['"]([^'"]+)['"]|(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)"""


def numbered(texts: DataFrame) -> DataFrame:
    """file, line (from 1), text of each line of texts (file, content)."""
    lines = F.posexplode(F.split("content", "\r?\n"))
    return texts.select("file", lines.alias("line", "text")).withColumn("line", F.col("line").cast("long") + 1)


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, content of the text files below a folder, read by Spark in parallel."""
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return rows.select(F.col("path").alias("file"), F.decode("content", "utf-8").alias("content"))


def size_class(length):
    """parse up to 2 MiB, node-only up to 20 MiB, else exclude."""
    return F.when(length <= 2 << 20, "parse").when(length <= 20 << 20, "node-only").otherwise("exclude")


def commits(log: DataFrame) -> DataFrame:
    """hash, author, date, subject, path, insertions, deletions from log records (text).

    A record is hash, author, ISO date and subject split by FIELD, then lines of counts
    and paths; '-' counts of binary files are null.
    """
    head = F.split(F.substring_index("record", "\n", 1), FIELD)
    rows = log.select(F.explode(F.split("text", RECORD)).alias("record")).filter(F.trim("record") != "")
    rows = rows.select(
        F.trim(head[0]).alias("hash"),
        head[1].alias("author"),
        F.to_date(F.substring(head[2], 1, 10)).alias("date"),
        head[3].alias("subject"),
        F.explode_outer(F.regexp_extract_all("record", F.lit(r"(?m)^((?:\d+|-)\t(?:\d+|-)\t.+)$"), F.lit(1))).alias("stat"),
    )
    parts = F.split("stat", "\t")
    return rows.select(
        "hash",
        "author",
        "date",
        "subject",
        renamed(parts[2]).alias("path"),
        F.expr("try_cast(split(stat, '\t')[0] as int)").alias("insertions"),
        F.expr("try_cast(split(stat, '\t')[1] as int)").alias("deletions"),
    )


def renamed(path):
    """The new path of a rename written as 'a/{b => c}/d' or 'a => b'."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(inner, r"^.* => ", ""), "//+", "/")


def lcov_lines(texts: DataFrame) -> DataFrame:
    """source, line, hits of LCOV reports (file, content); repeated sources are added up.

    The source named last before a DA record is its file; a missing end_of_record does no harm.
    """
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered(texts).withColumn(
        "source", F.last(F.when(F.col("text").startswith("SF:"), F.expr("substring(text, 4)")), ignorenulls=True).over(order)
    )
    record = F.regexp_extract_all("text", F.lit(r"^DA:(\d+),(\d+)"), F.lit(0))
    hits = rows.filter(F.size(record) > 0).select(
        "source",
        F.regexp_extract("text", r"^DA:(\d+),(\d+)", 1).cast("long").alias("line"),
        F.regexp_extract("text", r"^DA:(\d+),(\d+)", 2).cast("long").alias("hits"),
    )
    return hits.groupBy("source", "line").agg(F.sum("hits").alias("hits"))


def coverage_format(name, content):
    """Format of a coverage report by its name and beginning; null where it is none."""
    begin = F.substring(content, 1, 8192)
    return (
        F.when(begin.rlike(r"(?m)^(TN|SF):"), "lcov")
        .when(begin.rlike(r"<report\b") & begin.rlike("jacoco|JACOCO|<counter"), "jacoco")
        .when(begin.rlike(r"<coverage\b"), "cobertura")
        .when(F.lower(name).endswith(".json") & begin.rlike(r'"(meta|files)"\s*:'), "coverage.py")
    )


def diff_lines(texts: DataFrame) -> DataFrame:
    """file, path, kind (add, del, context), old_line, new_line, text of unified diffs (file, content)."""
    rows = numbered(texts)
    order = Window.partitionBy("file").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    header = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    is_header = F.col("text").rlike(header)
    rows = rows.withColumn(
        "path", F.last(F.when(F.col("text").startswith("+++ "), F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.*)$", 1)), True).over(upto)
    )
    rows = rows.withColumn("hunk", F.sum(is_header.cast("int")).over(upto)).withColumn(
        "start", F.last(F.when(is_header, F.struct(F.regexp_extract("text", header, 1).cast("long").alias("o"), F.regexp_extract("text", header, 2).cast("long").alias("n"))), True).over(upto)
    )
    body = rows.filter(~is_header & (F.col("hunk") > 0) & (F.col("text") != "") & ~F.col("text").rlike(r"^(--- |\+\+\+ |diff |index |\\)"))
    kind = F.when(F.col("text").startswith("+"), "add").when(F.col("text").startswith("-"), "del").otherwise("context")
    body = body.withColumn("kind", kind)
    inside = Window.partitionBy("file", "hunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    old = F.coalesce(F.sum((F.col("kind") != "add").cast("int")).over(inside), F.lit(0))
    new = F.coalesce(F.sum((F.col("kind") != "del").cast("int")).over(inside), F.lit(0))
    return body.select(
        "file",
        "path",
        "kind",
        F.when(F.col("kind") != "add", F.col("start.o") + old).alias("old_line"),
        F.when(F.col("kind") != "del", F.col("start.n") + new).alias("new_line"),
        F.expr("substring(text, 2)").alias("text"),
    )


def script_imports(texts: DataFrame) -> DataFrame:
    """file, line, specifier, relative of the imports in JavaScript and TypeScript texts."""
    rows = numbered(texts).filter(~F.col("text").rlike(r"^\s*(//|\*)"))
    found = F.explode(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(0)))
    rows = rows.select("file", "line", found.alias("m"))
    name = F.coalesce(F.nullif(F.regexp_extract("m", IMPORT, 1), F.lit("")), F.regexp_extract("m", IMPORT, 2))
    return rows.select("file", "line", name.alias("specifier")).withColumn("relative", F.col("specifier").startswith("."))


def python_imports(texts: DataFrame) -> DataFrame:
    """file, line, specifier of import and from-import lines in Python texts."""
    pattern = r"^\s*(?:from\s+([.\w]+)\s+import\b|import\s+([.\w]+))"
    rows = numbered(texts).filter(F.col("text").rlike(pattern))
    name = F.coalesce(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")), F.regexp_extract("text", pattern, 2))
    return rows.select("file", "line", name.alias("specifier"))


def npm_package(specifier):
    """The package that a bare specifier names: scope and name, without deeper paths."""
    scoped = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+)", 1)
    return F.when(scoped != "", scoped).otherwise(F.substring_index(specifier, "/", 1))


def npm_lock(texts: DataFrame) -> DataFrame:
    """file, ecosystem, name, version, dev of npm lock files (file, content)."""
    schema = "packages map<string, struct<version:string, dev:boolean, link:boolean>>"
    rows = texts.select("file", F.explode(F.from_json("content", schema)["packages"]).alias("place", "p"))
    return rows.filter((F.col("place") != "") & ~F.coalesce("p.link", F.lit(False))).select(
        "file",
        F.lit("npm").alias("ecosystem"),
        F.regexp_replace("place", r"^.*node_modules/", "").alias("name"),
        "p.version",
        F.coalesce("p.dev", F.lit(False)).alias("dev"),
    )


def codeowners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path, owner: the last rule (ordinal, pattern, owner) whose regular expression matches.

    Of rules with one pattern only the last counts.  At most RULE_ROWS patterns become
    expressions, so that files are read once and never paired with all rules; more than
    these are a join of files and patterns.
    """
    named = rules.filter("pattern is not null and owner is not null").groupBy("pattern").agg(F.max(F.struct("ordinal", "owner")).alias("last"))
    last = settled(named.select("pattern", "last.*"))
    found = last.orderBy("ordinal", "owner").limit(RULE_ROWS + 1).collect()
    if len(found) > RULE_ROWS:
        hits = files.select("path").distinct().join(last, F.expr("path rlike pattern"))
        best = hits.groupBy("path").agg(F.max(F.struct("ordinal", "owner")).alias("last"))
        return files.select("path").join(best, "path").select("path", "last.owner")
    owner = F.lit(None).cast("string")
    for at in range(0, len(found), RULES_AT_ONCE):
        # Rules become expressions, so that files are read once and never paired with all rules.
        part = found[at : at + RULES_AT_ONCE]
        hits = F.array_compact(F.array(*(F.when(F.col("path").rlike(r["pattern"]), F.lit(r["owner"])) for r in part)))
        files = files.withColumn("_owner", F.coalesce(F.try_element_at(hits, F.lit(-1)), F.col("_owner") if at else owner))
    return files.select("path", F.col("_owner").alias("owner") if found else owner.alias("owner")).filter("owner is not null")
