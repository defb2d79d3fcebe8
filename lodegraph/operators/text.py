"""Token sequences, clones and module surfaces of source texts, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stay themselves in a normalised sequence.
KEYWORDS = (
    "break case catch class const continue default delete do else export extends finally for from function if import "
    "in instanceof let new of return static super switch this throw try typeof var void while yield async await "
    "null true false undefined get set interface type enum"
).split()

_TOKEN = r"""//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\d[\w.]*|[\p{L}_$][\p{L}\p{N}_$]*|[^\s]"""


def normalised(text: Column) -> Column:
    """Tokens of a text: comments dropped, strings, numbers and names replaced by their kind."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^(//|/\*)"))
    return F.transform(
        tokens,
        lambda t: F.when(t.isin(*KEYWORDS), t)
        .when(t.rlike("^[\"'].+"), "$str")
        .when(t.rlike(r"^\d"), "$num")
        .when(t.rlike(r"^[\p{L}_$]"), "$id")
        .otherwise(t),
    )


def clone_groups(texts: DataFrame, least_tokens: int = 30) -> DataFrame:
    """shape, tokens, files, first_file: texts (file, text) that share a normalised sequence."""
    rows = texts.filter("text is not null").select("file", normalised(F.col("text")).alias("t"))
    rows = rows.filter(F.size("t") >= least_tokens).select(
        "file", F.sha1(F.array_join("t", " ")).alias("shape"), F.size("t").cast("long").alias("tokens")
    )
    return (
        rows.groupBy("shape", "tokens")
        .agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("first_file"))
        .filter("files > 1")
    )


def module_depth(texts: DataFrame) -> DataFrame:
    """file, lines, width, signal of texts (file, text): how much surface stands before how much code."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("*"))
    exports = F.regexp_count("text", F.lit(r"\bexport\b"))
    lists = F.filter(
        F.transform(F.regexp_extract_all("text", F.lit(r"\(([^)]*)\)"), F.lit(1)), F.trim), lambda x: x != ""
    )
    parameters = F.aggregate(lists, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x, ","), lambda p: p != "")))
    members = F.regexp_count("text", F.lit(r"(?m)^\s{0,2}(?:public\s+)?(?:readonly\s+)?\w+\s*[:(]"))
    rows = texts.filter("text is not null").select(
        "file",
        F.size(lines).cast("long").alias("lines"),
        exports.alias("exports"),
        (exports * 2 + parameters + members).cast("long").alias("width"),
    )
    signal = (
        F.when((F.col("exports") > 0) & (F.col("lines") <= 5), "pass-through")
        .when((F.col("lines") > 0) & (F.col("width") / F.nullif(F.col("lines"), F.lit(0)) > 0.5), "wide-interface")
        .otherwise("ok")
    )
    return rows.select("file", "lines", "width", signal.alias("signal"))
