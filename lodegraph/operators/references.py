"""References between files: aliases, calls, supertypes, type names, packages, routes and their callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.paths import directory, joined
from lodegraph.functions.ranks import first_rows
from lodegraph.functions.tables import settled
from lodegraph.operators import closure
from lodegraph.operators.matching import import_candidates, longest_prefix, prefixes

# Package roots of well-known libraries whose published group has another name.
PACKAGE_GROUPS = {
    "okhttp3": "com.squareup.okhttp3",
    "okio": "com.squareup.okio",
    "retrofit2": "com.squareup.retrofit2",
    "kotlinx.coroutines": "org.jetbrains.kotlinx",
    "kotlinx.serialization": "org.jetbrains.kotlinx",
    "com.google.gson": "com.google.code.gson",
    "com.google.common": "com.google.guava",
    "org.junit": "junit",
    "io.airlift.compress": "io.airlift",
}
SEVERITIES = ("unknown", "low", "moderate", "high", "critical")


def resolve_aliases(imports: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, specifier) with config, target and claimed.

    configs: unit (folder), ordinal, pattern and template, each with at most one star.  The
    nearest enclosing folder with a config decides; its first pattern that fits claims the
    import, whether or not a file (files: path) is there.
    """
    rows = imports.withColumn("_dir", directory(F.col("file")))
    rows = longest_prefix(rows, "_dir", configs.select("unit")).withColumn("_row", F.monotonically_increasing_id())
    rows = settled(rows.withColumnRenamed("unit", "config").drop("_dir"))
    before, after = F.substring_index("pattern", "*", 1), F.expr("if(instr(pattern, '*') > 0, substring_index(pattern, '*', -1), '')")
    star = F.instr("pattern", "*") > 0
    fits = F.when(
        star,
        F.col("specifier").startswith(before)
        & F.col("specifier").endswith(after)
        & (F.length("specifier") >= F.length(before) + F.length(after)),
    ).otherwise(F.col("specifier") == F.col("pattern"))
    inner = F.substring(F.col("specifier"), F.length(before) + 1, F.length("specifier") - F.length(before) - F.length(after))
    base = F.when(star, F.concat(F.substring_index("template", "*", 1), inner)).otherwise(F.col("template"))
    claims = rows.join(configs.withColumnRenamed("unit", "config"), "config").filter(fits)
    claims = first_rows(claims, ["_row"], [F.col("ordinal"), F.col("pattern")])
    tried = claims.select("_row", F.posexplode(import_candidates(joined(F.lit(""), base))).alias("_at", "_c"))
    hits = tried.join(files.select(F.col("path").alias("target")).distinct(), F.col("_c.path") == F.col("target"))
    hits = hits.groupBy("_row").agg(F.min_by("target", "_at").alias("target"))
    claimed = claims.select("_row", F.lit(True).alias("claimed"))
    return rows.join(claimed, "_row", "left").join(hits, "_row", "left").select(
        "file", "specifier", "config", "target", F.coalesce("claimed", F.lit(False)).alias("claimed")
    )


def call_edges(calls: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """source, target, line: calls that reach an export of another file through an import.

    calls: file, name, receiver, line.  bindings: file, local, kind (named, default or
    namespace), imported, target.  exports: file, name.  A call with a receiver needs a
    namespace import of it, one without needs another kind of import of its name.
    """
    local = F.coalesce("receiver", "name")
    rows = calls.withColumn("local", local).join(bindings, ["file", "local"])
    rows = rows.filter(F.col("receiver").isNotNull() == (F.col("kind") == "namespace"))
    rows = rows.withColumn("wanted", F.when(F.col("kind") == "namespace", F.col("name")).otherwise(F.col("imported")))
    known = exports.select(F.col("file").alias("target"), F.col("name").alias("wanted")).distinct()
    return rows.join(known, ["target", "wanted"]).select(F.col("file").alias("source"), "target", "line").distinct()


def inheritance_edges(supertypes: DataFrame, bindings: DataFrame, types: DataFrame) -> DataFrame:
    """source, target, relation, name: supertypes that an import names and another file exports.

    supertypes: file, name, relation.  types: file, name ('default' for a default export).
    """
    rows = supertypes.withColumnRenamed("name", "local").join(bindings.filter("kind <> 'namespace'"), ["file", "local"])
    rows = rows.withColumn("wanted", F.when(F.col("kind") == "default", "default").otherwise(F.col("imported")))
    known = types.select(F.col("file").alias("target"), F.col("name").alias("wanted")).distinct()
    found = rows.join(known, ["target", "wanted"]).filter("target <> file")
    return found.select(F.col("file").alias("source"), "target", "relation", F.col("local").alias("name")).distinct()


def type_references(uses: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """file, name, target, basis: the file that a type name stands for.

    uses: file, name.  files: id, directory, stem.  A name declared in the file itself comes
    first, then a sole imported file of that stem, then a sole file of the same folder.
    """
    stems = files.select("id", "directory", "stem")
    rows = uses.distinct().join(stems.select(F.col("id").alias("file"), "directory", F.col("stem").alias("own")), "file")
    here = rows.filter("own = name").select("file", "name", F.col("file").alias("target"), F.lit("this-file").alias("basis"))
    rows = rows.filter("own <> name").drop("own")
    imported = edges.select(F.col("source").alias("file"), F.col("target").alias("id")).distinct().join(stems, "id")
    by_import = imported.groupBy("file", F.col("stem").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target"))
    hit = rows.join(by_import.filter("n = 1").drop("n"), ["file", "name"])
    left = rows.join(hit.select("file", "name"), ["file", "name"], "left_anti")
    siblings = stems.groupBy("directory", F.col("stem").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target"))
    folder = left.join(siblings.filter("n = 1"), ["directory", "name"])
    out = here.unionByName(hit.select("file", "name", "target", F.lit("import").alias("basis")))
    return out.unionByName(folder.select("file", "name", "target", F.lit("same-folder").alias("basis")))


def _dependency_keys(imports: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What imports (ecosystem, file, key) and dependencies (ecosystem, name, key) meet on; a dependency has one key."""
    plain = F.when(F.col("ecosystem") == "cargo", F.translate("name", "_", "-")).otherwise(F.col("name"))
    keyed = dependencies.select(
        "ecosystem", "name", F.when(F.col("ecosystem") == "maven", F.substring_index("name", ":", 1)).otherwise(plain).alias("key")
    ).distinct()
    groups = F.create_map(*(F.lit(x) for pair in PACKAGE_GROUPS.items() for x in pair))
    parts = prefixes(F.col("package"), r"\.")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"\\\.", "."))
    known = F.array_compact(F.transform(parts, lambda p: groups[p]))
    keys = F.when(F.col("ecosystem") == "maven", F.array_distinct(F.concat(parts, known))).otherwise(F.array("package"))
    return imports.select("ecosystem", "file", F.explode(keys).alias("key")), keyed


def dependency_imports(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """ecosystem, name, file: imports (ecosystem, package, file) of dependencies (ecosystem, name).

    Cargo names are compared with dashes.  A Maven import belongs to a coordinate whose group
    is a leading part of it, or the published group of its root: its leading parts are
    exploded into an equality join.
    """
    rows, keyed = _dependency_keys(imports, dependencies)
    return rows.join(keyed, ["ecosystem", "key"]).select("ecosystem", "name", "file").distinct()


def dependency_files(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """ecosystem, name, files, first_file: dependency_imports() counted for each dependency.

    Files are counted by key, before they meet the coordinates that share a key.
    """
    rows, keyed = _dependency_keys(imports, dependencies)
    counts = rows.distinct().groupBy("ecosystem", "key").agg(F.count("file").alias("files"), F.min("file").alias("first_file"))
    return counts.join(keyed, ["ecosystem", "key"]).select("ecosystem", "name", "files", "first_file")


def template_callers(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """endpoint, call: calls (call, method, host, path) that fit a path template (endpoint, method, host, path).

    Templates and calls meet on their number of segments, the first and the last one; parameters
    stand for any one segment.  A call without method or host fits any.
    """
    open_ = r"^(\{[^}]*\}|:[A-Za-z_]+|<[^>]*>)$"
    split = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    ends = endpoints.select("endpoint", F.col("method").alias("m"), F.col("host").alias("h"), split(F.col("path")).alias("t"))
    fixed = lambda at: F.when(~F.try_element_at("t", F.lit(at)).rlike(open_), F.try_element_at("t", F.lit(at)))
    ends = settled(ends.withColumn("n", F.size("t")).withColumn("head", fixed(1)).withColumn("tail", fixed(-1)))
    rows = calls.select("call", "method", "host", split(F.col("path")).alias("p"))
    rows = rows.withColumn("n", F.size("p")).withColumn("head", F.try_element_at("p", F.lit(1))).withColumn("tail", F.try_element_at("p", F.lit(-1)))
    met = None
    for known in (["head", "tail"], ["head"], ["tail"], []):
        unknown = [c for c in ("head", "tail") if c not in known]
        part = ends.filter(" and ".join([f"{c} is not null" for c in known] + [f"{c} is null" for c in unknown])).drop(*unknown)
        part = rows.join(part, ["n", *known]).select("call", "method", "host", "p", "endpoint", "m", "h", "t")
        met = part if met is None else met.unionByName(part)
    fits = F.forall(F.arrays_zip("t", "p"), lambda x: (x["t"] == x["p"]) | x["t"].rlike(open_))
    same = (F.col("method").isNull() | (F.col("method") == F.col("m"))) & (F.col("host").isNull() | F.col("host").eqNullSafe(F.col("h")))
    return met.filter(fits & same).select("endpoint", "call").distinct()


def template_calls(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """endpoint, calls: template_callers() counted for each endpoint.

    Callers are counted once for each method, host and path that endpoints share; only endpoints of
    several of these meet their calls one by one.
    """
    keys = ["method", "host", "path"]
    endpoints = settled(endpoints.select("endpoint", *keys).distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("endpoint"))))
    shapes = settled(endpoints.select(*keys).distinct().withColumn("shape", F.monotonically_increasing_id()))
    met = template_callers(shapes.select(F.col("shape").alias("endpoint"), *keys), calls)
    counts = shapes.join(met.groupBy(F.col("endpoint").alias("shape")).agg(F.count("call").alias("calls")), "shape")
    same = F.col("e.method").eqNullSafe(F.col("c.method")) & F.col("e.host").eqNullSafe(F.col("c.host")) & (F.col("e.path") == F.col("c.path"))
    sole = endpoints.filter("_n = 1").alias("e").join(counts.alias("c"), same).select("endpoint", "calls")
    several = template_callers(endpoints.filter("_n > 1"), calls).groupBy("endpoint").agg(F.count("call").alias("calls"))
    return sole.unionByName(several)


def presence_states(declared: DataFrame, live: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, state: what a live schema lacks, has beside the declared one, or has otherwise."""
    a = declared.select(*keys, *(F.col(f).alias(f"d_{f}") for f in fields), F.lit(True).alias("_d"))
    b = live.select(*keys, *(F.col(f).alias(f"l_{f}") for f in fields), F.lit(True).alias("_l"))
    state = F.when(F.col("_l").isNull(), "missing").when(F.col("_d").isNull(), "extra")
    for f in fields:
        state = state.when(~F.col(f"d_{f}").eqNullSafe(F.col(f"l_{f}")), f)
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state")).filter("state is not null")


def observed(entries: DataFrame, names: DataFrame) -> DataFrame:
    """entries (entry, label) with observed: a known name (name) is the label, its last segment or the entry's id."""
    keys = F.array_distinct(F.array(F.col("label"), F.element_at(F.split("label", "[./]"), -1), F.col("entry").cast("string")))
    hits = entries.select("entry", F.explode(keys).alias("name")).join(names.distinct(), "name", "left_semi").select("entry").distinct()
    return entries.join(hits.withColumn("observed", F.lit(True)), "entry", "left").fillna({"observed": False})


# ---------------------------------------------------------------- impact


def advisory_impact(advisories: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """advisory, importers, affected: files that import the advised package, and all that reach them.

    advisories: advisory, ecosystem, name.  imports: ecosystem, name, file.
    """
    seeds = settled(advisories.join(imports, ["ecosystem", "name"]).select("advisory", F.col("file").alias("id")).distinct())
    found = closure.Condensed(edges).beyond(seeds.withColumnRenamed("advisory", "key"), back=True).withColumnRenamed("key", "advisory")
    counts = seeds.groupBy("advisory").agg(F.count(F.lit(1)).alias("importers")).join(found, "advisory", "left")
    counts = counts.select("advisory", "importers", (F.col("importers") + F.coalesce("reached", F.lit(0))).alias("affected"))
    return advisories.select("advisory").distinct().join(counts, "advisory", "left").fillna(0)


def severity(label: Column) -> Column:
    """One of SEVERITIES for the label that a database gives."""
    upper = F.upper(label)
    return (
        F.when(upper.isin("LOW", "HIGH", "CRITICAL"), F.lower(label))
        .when(upper.isin("MODERATE", "MEDIUM"), "moderate")
        .otherwise("unknown")
    )


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), name)


def fixed_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fixed: distinct versions (fixed) of each advisory, sorted and joined."""
    known = rows.filter("fixed is not null").select(*keys, "fixed").distinct()
    return known.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("fixed")), ",").alias("fixed"))


def tiered_impact(changed: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """file, definite, possible, reachable: importers whose specifier names a changed function, the others, and all dependents.

    changed: file.  names: file, name.  edges: source, target, specifier.
    """
    into = edges.join(changed.withColumnRenamed("file", "target"), "target")
    named = into.join(names.withColumnRenamed("file", "target"), "target", "left")
    hits = named.groupBy("target", "source").agg(F.bool_or(F.coalesce(F.col("specifier").contains(F.col("name")), F.lit(False))).alias("hit"))
    sums = hits.groupBy(F.col("target").alias("file")).agg(
        F.count_if("hit").alias("definite"), F.count_if(~F.col("hit")).alias("possible")
    )
    groups = changed.select(F.col("file").alias("key"), F.col("file").alias("id"))
    reach = closure.Condensed(edges).beyond(groups, back=True).filter("reached > 0")
    return sums.join(reach.select(F.col("key").alias("file"), F.col("reached").alias("reachable")), "file")


def contract_impact(governed: DataFrame, derives: DataFrame) -> DataFrame:
    """contract, consumers, units, repositories, downstream over governed (contract, dataset, file, unit, repository)."""
    sums = governed.groupBy("contract").agg(
        F.count_distinct("file").alias("consumers"),
        F.count_distinct("unit").alias("units"),
        F.count_distinct("repository").alias("repositories"),
    )
    groups = governed.select(F.col("contract").alias("key"), F.col("dataset").alias("id"))
    down = closure.Condensed(derives).beyond(groups).select(F.col("key").alias("contract"), F.col("reached").alias("downstream"))
    return sums.join(down, "contract", "left").fillna(0, ["downstream"])


def data_flow(data_edges: DataFrame, files: DataFrame, governed: DataFrame) -> DataFrame:
    """from_tier, to_tier, datasets, flows, governed: writers and readers of a dataset, by their tiers.

    files: file, tier.  Writers and readers of a dataset are counted by tier before they
    meet, so a dataset brings at most one row for each pair of tiers.
    """
    sides = data_edges.join(files, "file").groupBy("dataset", "access", "tier").agg(F.count_distinct("file").alias("n"))
    writes = sides.filter("access = 'writes'").select("dataset", F.col("tier").alias("from_tier"), F.col("n").alias("w"))
    reads = sides.filter("access = 'reads'").select("dataset", F.col("tier").alias("to_tier"), F.col("n").alias("r"))
    rows = writes.join(reads, "dataset").join(governed.select("dataset", F.lit(True).alias("g")), "dataset", "left")
    return rows.groupBy("from_tier", "to_tier").agg(
        F.count(F.lit(1)).alias("datasets"), F.sum(F.col("w") * F.col("r")).alias("flows"), F.count_if("g").alias("governed")
    )


def declared_intent(declared: DataFrame, seen: DataFrame) -> DataFrame:
    """source, target, state: declared edges (source, target, allow) against observed ones (source, target).

    An allowed edge that nothing shows is a ghost; an observed one is confirmed, forbidden or undeclared.
    """
    rows = declared.join(seen.distinct().withColumn("seen", F.lit(True)), ["source", "target"], "full_outer")
    state = (
        F.when(F.col("allow").isNull(), "undeclared")
        .when(F.col("allow") & F.col("seen").isNull(), "ghost")
        .when(F.col("allow"), "confirmed")
        .when(F.col("seen"), "violation")
    )
    return rows.select("source", "target", state.alias("state")).filter("state is not null")
