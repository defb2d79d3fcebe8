"""Dependencies from lock files and manifests, entry points, and coverage reports beside LCOV.

Texts are rows (file, content); what cannot be read gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = "cast(array() as array<string>)"


def blocks(text: Column, start: str) -> Column:
    """Parts of a text that begin with the expression start, each up to the next one."""
    return F.filter(F.split(text, f"(?m)(?={start})"), lambda b: b.rlike(start))


def _field(block: Column, pattern: str) -> Column:
    found = F.regexp_extract(block, pattern, 1)
    return F.when(found != "", found)


def cargo_lock(texts: DataFrame) -> DataFrame:
    """file, ecosystem, name, version of the packages in Cargo lock files that come from a registry."""
    rows = texts.select("file", F.explode(blocks(F.col("content"), r"^\[\[package\]\]")).alias("b"))
    rows = rows.filter(F.col("b").rlike(r"(?m)^source\s*="))
    return rows.select(
        "file",
        F.lit("cargo").alias("ecosystem"),
        _field(F.col("b"), r'(?m)^name\s*=\s*"([^"]+)"').alias("name"),
        _field(F.col("b"), r'(?m)^version\s*=\s*"([^"]+)"').alias("version"),
    )


def maven_pom(texts: DataFrame) -> DataFrame:
    """file, ecosystem, name (group:artifact), version, dev of the dependencies in Maven models.

    A version given as a property takes the property's value where the model has it.
    """
    plain = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    outside = F.regexp_replace(plain, r"(?s)<(build|dependencyManagement|plugins)>.*?</\1>", "")
    found = F.regexp_extract_all(outside, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    pairs = F.regexp_extract_all(plain, F.lit(r"(?s)<properties>(.*?)</properties>"), F.lit(1))
    properties = F.coalesce(F.try_element_at(pairs, F.lit(1)), F.lit(""))
    rows = texts.select("file", properties.alias("p"), F.explode(found).alias("d"))
    tag = lambda name: F.trim(F.regexp_extract("d", rf"(?s)<{name}>(.*?)</{name}>", 1))
    raw = tag("version")
    key = F.regexp_extract(raw, r"^\$\{([^}]+)\}$", 1)
    value = F.expr("regexp_extract(p, concat('<', replace(k, '.', '[.]'), '>([^<]*)</'), 1)")
    rows = rows.select("file", "d", "p", raw.alias("raw"), key.alias("k"))
    version = F.when(F.col("k") == "", F.col("raw")).otherwise(value)
    return rows.select(
        "file",
        F.lit("maven").alias("ecosystem"),
        F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"),
        F.when(version != "", version).alias("version"),
        (tag("scope") == "test").alias("dev"),
    )


def gradle_lock(texts: DataFrame) -> DataFrame:
    """file, ecosystem, name, version of Gradle lock lines 'group:artifact:version=configurations'."""
    lines = texts.select("file", F.explode(F.split("content", "\r?\n")).alias("l"))
    pattern = r"^([^#:=\s]+:[^:=\s]+):([^=\s]+)="
    rows = lines.filter(F.col("l").rlike(pattern))
    return rows.select(
        "file",
        F.lit("maven").alias("ecosystem"),
        F.regexp_extract("l", pattern, 1).alias("name"),
        F.regexp_extract("l", pattern, 2).alias("version"),
    )


def gradle_script(texts: DataFrame) -> DataFrame:
    """file, ecosystem, name, version, dev of coordinates named in Gradle build scripts."""
    pattern = r"""\b(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly))\s*\(?\s*["']([\w.-]+:[\w.-]+)(?::([\w.+-]+))?["']"""
    plain = F.regexp_replace("content", r"(?m)//.*$", "")
    rows = texts.select("file", F.explode(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))).alias("m"))
    version = F.regexp_extract("m", pattern, 3)
    return rows.select(
        "file",
        F.lit("maven").alias("ecosystem"),
        F.regexp_extract("m", pattern, 2).alias("name"),
        F.when(version != "", version).alias("version"),
        F.regexp_extract("m", pattern, 1).startswith("test").alias("dev"),
    )


def entry_points(texts: DataFrame) -> DataFrame:
    """file, entry, reason of the entries that package.json and Cargo.toml files declare, relative to them."""
    name = F.element_at(F.split("file", "/"), -1)
    package = F.from_json("content", "main string, module string, types string, bin string, exports string, start string")
    bins = F.from_json("content", "bin map<string,string>")["bin"]
    js = texts.filter(name == "package.json").select("file", package.alias("p"), bins.alias("bins"))
    named = F.filter(
        F.array(*(F.struct(F.col(f"p.{k}").alias("entry"), F.lit(k).alias("reason")) for k in ("main", "module"))),
        lambda x: x["entry"].isNotNull(),
    )
    many = F.transform(F.coalesce(F.map_values("bins"), F.expr(_EMPTY)), lambda v: F.struct(v.alias("entry"), F.lit("bin").alias("reason")))
    single = F.when(F.col("p.bin").isNotNull() & ~F.col("p.bin").startswith("{"), F.array(F.struct(F.col("p.bin").alias("entry"), F.lit("bin").alias("reason"))))
    found = F.concat(named, many, F.coalesce(single, F.expr("cast(array() as array<struct<entry:string,reason:string>>)")))
    js = js.select("file", F.explode(found).alias("e")).select("file", F.regexp_replace("e.entry", r"^\./", "").alias("entry"), "e.reason")
    cargo = texts.filter(name == "Cargo.toml").select("file", F.explode(blocks(F.col("content"), r"^\[\[?(?:bin|lib)\]")).alias("b"))
    cargo = cargo.select("file", _field(F.col("b"), r'(?m)^path\s*=\s*"([^"]+)"').alias("entry"), F.regexp_extract("b", r"^\[\[?(\w+)", 1).alias("reason"))
    return js.unionByName(cargo.filter("entry is not null"))


# ---------------------------------------------------------------- coverage


def cobertura(texts: DataFrame) -> DataFrame:
    """source, line, hits of Cobertura reports; lines of a file in several classes keep their most hits."""
    rows = texts.select(F.explode(blocks(F.col("content"), r"<class\s")).alias("b"))
    pattern = r'<line\s[^>]*?number="(\d+)"[^>]*?hits="(\d+)"'
    rows = rows.select(_field(F.col("b"), r'^<class\s[^>]*?filename="([^"]+)"').alias("source"), F.explode(F.regexp_extract_all("b", F.lit(pattern), F.lit(0))).alias("l"))
    number = lambda i: F.regexp_extract("l", pattern, i).cast("long")
    return rows.filter("source is not null").groupBy("source", number(1).alias("line")).agg(F.max(number(2)).alias("hits"))


def jacoco(texts: DataFrame) -> DataFrame:
    """source, line, hits of JaCoCo reports: covered instructions of each line of package/file."""
    packages = texts.select(F.explode(blocks(F.col("content"), r"<package\s")).alias("p"))
    files = packages.select(_field(F.col("p"), r'^<package\s[^>]*?name="([^"]*)"').alias("package"), F.explode(blocks(F.col("p"), r"<sourcefile\s")).alias("b"))
    pattern = r'<line\s[^>]*?nr="(\d+)"[^>]*?ci="(\d+)"'
    rows = files.select(
        F.concat_ws("/", "package", _field(F.col("b"), r'^<sourcefile\s[^>]*?name="([^"]+)"')).alias("source"),
        F.explode(F.regexp_extract_all("b", F.lit(pattern), F.lit(0))).alias("l"),
    )
    number = lambda i: F.regexp_extract("l", pattern, i).cast("long")
    return rows.groupBy("source", number(1).alias("line")).agg(F.max(number(2)).alias("hits"))


def coverage_py(texts: DataFrame) -> DataFrame:
    """source, line, hits (1 or 0) of coverage.py JSON reports."""
    schema = "files map<string, struct<executed_lines:array<bigint>, missing_lines:array<bigint>>>"
    rows = texts.select(F.explode(F.from_json("content", schema)["files"]).alias("source", "f"))
    side = lambda c, n: rows.select("source", F.explode(f"f.{c}").alias("line"), F.lit(n).cast("long").alias("hits"))
    return side("executed_lines", 1).unionByName(side("missing_lines", 0))
