"""Ignore files: which paths the nested rules of a tree leave out.

A rule belongs to the folder of its file and speaks of paths below it.  For every path and
every folder above it the last rule of the deepest folder that matches decides; a path is
ignored if it is decided so itself or one of its folders is, which no later rule undoes.
Paths are exploded to their folders and rules found by what they name: a name, a path, an
ending; only patterns of other shapes are tried on all paths below their folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.tables import settled


def parsed(rules: DataFrame) -> DataFrame:
    """folder, ordinal, keep, folders_only, kind (name, path, ending, pattern), key of rules (folder, ordinal, text)."""
    text = F.regexp_replace(F.regexp_replace("text", r"\r$", ""), r"(?<!\\) +$", "")
    rows = rules.select("folder", "ordinal", text.alias("t")).filter("t <> '' and not startswith(t, '#')")
    rows = rows.withColumn("keep", F.col("t").startswith("!")).withColumn("t", F.regexp_replace(F.regexp_replace("t", "^!", ""), r"^\\(?=[!#])", ""))
    rows = rows.withColumn("folders_only", F.col("t").endswith("/")).withColumn("t", F.regexp_replace("t", "/$", ""))
    rows = rows.withColumn("anchored", F.instr("t", "/") > 0).withColumn("t", F.regexp_replace("t", "^/", "")).filter("t <> ''")
    plain = ~F.col("t").rlike(r"[*?\[\\]")
    ending = ~F.col("anchored") & F.col("t").rlike(r"^\*\.[^*?\[\\]+$")
    kind = F.when(plain & F.col("anchored"), "path").when(plain, "name").when(ending, "ending").otherwise("pattern")
    # A pattern in regular form: ** is any path, * and ? stay within a segment.
    quoted = F.regexp_replace("t", r"([.+^$(){}|])", r"\\$1")
    form = quoted
    for a, b in ((r"\*\*/", "\u0001"), (r"/\*\*$", "\u0002"), (r"\*\*", "\u0003"), (r"\*", "[^/]*"), (r"\?", "[^/]"), (r"\[!", "[^"), ("\u0001", "(?:.*/)?"), ("\u0002", "/.*"), ("\u0003", ".*")):
        form = F.regexp_replace(form, a, b)
    pattern = F.concat(F.when(F.col("anchored"), "^").otherwise("^(?:.*/)?"), form, F.lit("$"))
    key = F.when(kind == "pattern", pattern).when(kind == "ending", F.expr("substring(t, 2)")).otherwise(F.col("t"))
    return rows.select("folder", "ordinal", "keep", "folders_only", kind.alias("kind"), key.alias("key"))


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path, by_path, folder, ordinal: ignored files (path) and the rule that decides, of the topmost part that is ignored.

    rules: folder (no slash at the end, '' for the root), ordinal, text.
    """
    rules = settled(parsed(rules))
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(1), F.size("p"))
    rows = files.select("path").distinct().withColumn("p", parts).select("path", F.size("p").alias("n"), "p", F.explode(depths).alias("depth"))
    rows = rows.select("path", "depth", (F.col("depth") < F.col("n")).alias("is_folder"), F.slice("p", F.lit(1), F.col("depth")).alias("q"))
    shared = rows.select(F.array_join("q", "/").alias("part"), "is_folder", "q").distinct()
    above = shared.withColumn("up", F.explode(F.sequence(F.lit(0), F.size("q") - 1)))
    name = F.element_at("q", -1)
    above = above.select(
        "part", "is_folder", "up", F.array_join(F.slice("q", F.lit(1), F.col("up")), "/").alias("folder"),
        F.array_join(F.slice("q", F.col("up") + 1, F.size("q")), "/").alias("below"), name.alias("name"),
    )
    endings = F.transform(F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr("name", i, F.lit(1)) == "."), lambda i: F.substr("name", i))
    keyed = above.withColumn("k", F.explode(F.concat(
        F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("key")), F.struct(F.lit("path").alias("kind"), F.col("below").alias("key"))),
        F.transform(endings, lambda e: F.struct(F.lit("ending").alias("kind"), e.alias("key"))),
    ))).select("part", "is_folder", "up", "folder", "k.kind", "k.key")
    hits = keyed.join(rules.filter("kind <> 'pattern'"), ["folder", "kind", "key"])
    tried = above.join(rules.filter("kind = 'pattern'"), "folder").filter("below rlike key")
    columns = ["part", "is_folder", "up", "folder", "ordinal", "keep", "folders_only"]
    hits = hits.select(*columns).unionByName(tried.select(*columns)).filter("is_folder or not folders_only")
    last = hits.groupBy("part", "is_folder").agg(F.max_by(F.struct("keep", "folder", "ordinal"), F.struct("up", "ordinal")).alias("r")).filter("not r.keep")
    whole = rows.select("path", "depth", "is_folder", F.array_join("q", "/").alias("part")).join(last, ["part", "is_folder"])
    return whole.groupBy("path").agg(F.min(F.struct("depth", "part", "r")).alias("m")).select("path", F.col("m.part").alias("by_path"), "m.r.folder", "m.r.ordinal")
