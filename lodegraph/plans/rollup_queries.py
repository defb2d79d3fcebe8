"""Predicates, roll-ups, windows and top-k over the model tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.adapters.star_schema import with_tables
from lodegraph.functions import paths
from lodegraph.functions.ranks import decimals, first_rows, half_up, percentiles
from lodegraph.operators import facts, history

TIER_RANKS = "case tier when 'frontend' then 5 when 'api' then 4 when 'domain' then 3 when 'data' then 1 end"


def counted(rows, *keys):
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def test_paths(m):
    path = F.col("path")
    return m.nodes.select(
        "id",
        "path",
        paths.file_kind(path, F.col("kind") == "entry").alias("found_kind"),
        paths.extension(path).alias("extension"),
        paths.directory(path).alias("folder"),
        paths.top_directory(path).alias("top"),
    )


GLOBS = ("src/**/*.ts", "**/*.test.ts", "src/*/widget.ts", "tests/???/**")


def globbed(m):
    rows = None
    for glob in GLOBS:
        part = m.nodes.filter(F.col("path").rlike(paths.glob_pattern(glob))).select(F.lit(glob).alias("pattern"), "lines")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


GLOB_SQL = " union all ".join(
    f"select '{g}' as pattern, lines from nodes where regexp_matches(path, '{paths.glob_pattern(g)}')" for g in GLOBS
)


def unit_edges(m):
    """Weights between units without call edges, with the first three specifiers."""
    joined = facts.with_ends(m.edge_rows.filter("kind <> 'call'"), m.nodes, "unit").filter("from_unit <> to_unit")
    weights = joined.groupBy("from_unit", "to_unit").agg(F.count(F.lit(1)).alias("weight"))
    firsts = first_rows(joined, ["from_unit", "to_unit"], ["line", "source", "target"], 3)
    listed = firsts.groupBy("from_unit", "to_unit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("lines")
    )
    return weights.join(listed, ["from_unit", "to_unit"])


def block_edges(m):
    """Distinct edges between directories; of several the first that is not a call stands for them."""
    joined = facts.with_ends(m.edge_rows, m.nodes, "directory").filter("from_directory <> to_directory")
    order = F.struct((F.col("kind") == "call").alias("c"), "line", "source", "target", "kind", "role")
    return (
        joined.groupBy("from_directory", "to_directory")
        .agg(F.min(order).alias("f"))
        .select("from_directory", "to_directory", "f.source", "f.target", "f.kind", "f.line")
    )


def tier_cells(m):
    sets = m.nodes.groupingSets([(), ("tier",), ("unit",), ("unit", "tier")], "unit", "tier").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")
    )
    total = m.nodes.agg(F.count(F.lit(1)).alias("total"))
    return sets.join(F.broadcast(total)).select(
        F.coalesce("unit", F.lit("*")).alias("unit"),
        F.coalesce("tier", F.lit("*")).alias("tier"),
        "files",
        "lines",
        decimals(F.col("files") / F.col("total"), 3).alias("share"),
    )


def tier_flow(m):
    joined = facts.with_ends(m.edge_rows, m.nodes, "tier", "unit")
    return joined.groupBy("from_tier", "to_tier", "kind").agg(
        F.count(F.lit(1)).alias("weight"),
        F.count_if(F.col("from_unit") != F.col("to_unit")).alias("cross_unit"),
        F.count_if(F.col("role") == "declare").alias("declared"),
        F.array_join(F.array_sort(F.collect_set("from_unit")), ",").alias("units"),
        F.min("line").alias("first_line"),
    )


def cohesion(m):
    """Share of the neighbours of a directory's files that lie in it."""
    ends = facts.with_ends(m.edges, m.nodes, "directory")
    both = ends.select(F.col("from_directory").alias("directory"), (F.col("from_directory") == F.col("to_directory")).alias("inside"))
    other = ends.select(F.col("to_directory").alias("directory"), (F.col("from_directory") == F.col("to_directory")).alias("inside"))
    sums = both.unionByName(other).groupBy("directory").agg(
        F.count(F.lit(1)).alias("connections"), F.count_if("inside").alias("inside")
    )
    return sums.withColumn("value", half_up(F.col("inside") / F.col("connections") * 100))


def file_coverage(m):
    return m.coverage.groupBy("file").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("hits") > 0).alias("hit")
    )


def coverage_totals(m):
    """Lines hit and found for each folder and tier, all folders last."""
    rows = file_coverage(m).join(m.nodes, F.col("file") == F.col("id"))
    low = F.col("hit") * 100 < F.col("found") * 50
    return (
        rows.rollup("directory", "tier")
        .agg(F.sum("hit").alias("hit"), F.sum("found").alias("found"), F.count_if(low).alias("untested"))
        .select(
            F.coalesce("directory", F.lit("*")).alias("directory"),
            F.coalesce("tier", F.lit("*")).alias("tier"),
            "hit",
            "found",
            decimals(F.col("hit") / F.col("found") * 100, 1).alias("percent"),
            "untested",
        )
    )


def changed_coverage(m):
    """Lines changed by recent commits that a function covers, semi and anti to covered lines."""
    recent = m.commits.filter("date >= date'2001-01-01'").select(F.col("hash").alias("line"))
    changed = m.commit_files.select(F.col("path").alias("file"), F.col("hash").alias("line")).join(recent, "line")
    hit = m.coverage.filter("hits > 0")
    covered = changed.join(hit, ["file", "line"], "left_semi").withColumn("covered", F.lit(1))
    bare = changed.join(hit, ["file", "line"], "left_anti").withColumn("covered", F.lit(0))
    both = covered.unionByName(bare)
    return both.groupBy("file").agg(
        F.count(F.lit(1)).alias("changed"),
        F.sum("covered").alias("covered"),
        half_up(F.sum("covered") / F.count(F.lit(1)) * 100).alias("percent"),
    )


def external(m):
    """ecosystem, package, file: supplier keys as packages, imported by parts."""
    return m.raw("lineitem").select(
        F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("package"), (F.col("l_suppkey") % 25).alias("ecosystem")
    )


def import_index(m):
    return (
        external(m)
        .groupBy("ecosystem", "package")
        .agg(F.countDistinct("file").alias("files"), F.min("file").alias("first_file"))
    )


def risk_inventory(m):
    """Dependencies of each ecosystem by severity, a column each."""
    balance = F.col("s_acctbal")
    rows = m.raw("supplier").select(
        F.col("s_nationkey").alias("ecosystem"),
        F.when(balance < 0, "critical").when(balance < 3000, "high").otherwise("low").alias("severity"),
    )
    return rows.groupBy("ecosystem").pivot("severity", ["critical", "high", "low"]).count().fillna(0)


def field_drift(m):
    """Contracts (parts) declared by several suppliers with differing fields."""
    rows = m.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_tax").alias("tax"), F.max("l_discount").alias("discount")
    )
    return (
        rows.groupBy(F.col("l_partkey").alias("contract"))
        .agg(
            F.count(F.lit(1)).alias("repositories"),
            F.countDistinct("tax").alias("taxes"),
            F.countDistinct("discount").alias("discounts"),
        )
        .filter("repositories >= 2 and (taxes > 1 or discounts > 1)")
        .withColumn("kind", F.when(F.col("taxes") > 1, "type").otherwise("required"))
    )


def shape_twins(m):
    """Texts whose sorted distinct lines have one fingerprint."""
    lines = F.array_sort(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n")))
    rows = m.raw("documents").select("doc_id", "source", F.substring(F.sha1(F.array_join(lines, "|")), 1, 16).alias("shape"))
    return (
        rows.groupBy("shape")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.countDistinct("source").alias("sources"),
            F.min("doc_id").alias("first_doc"),
        )
        .filter("documents > 1")
    )


def candidates(m):
    return facts.product_candidates(m.data_edges, m.contracts)


def product_level(m):
    """Units of each dataset and the units that read it from outside."""
    writers = m.data_edges.filter("access = 'writes'").select("dataset", "unit").distinct()
    readers = m.data_edges.filter("access = 'reads'").select("dataset", "unit").distinct()
    outside = readers.join(writers, ["dataset", "unit"], "left_anti")
    sides = writers.groupBy("dataset").agg(F.count(F.lit(1)).alias("units")).join(
        outside.groupBy("dataset").agg(F.count(F.lit(1)).alias("consumers")), "dataset", "left"
    )
    return sides.select(
        "dataset", "units", F.coalesce("consumers", F.lit(0)).alias("consumers"), (F.col("units") > 1).alias("spans_units")
    )


def file_complexity(m):
    functions = m.functions.withColumn("signals", F.size(facts.signals()))
    return functions.groupBy("file").agg(
        F.count(F.lit(1)).alias("functions"),
        F.sum("decisions").alias("decisions"),
        F.max("decisions").alias("most_decisions"),
        F.max("nesting").alias("most_nesting"),
        F.sum("lines").alias("loc"),
        decimals(F.count_if(F.col("signals") > 0) / F.count(F.lit(1)), 3).alias("signal_share"),
    )


def percentile_scores(m):
    rows = m.nodes.select("id", "lines")
    return percentiles(rows, ["lines"], rows.count()).select("id", "lines_rank")


def first_last(m):
    """First and last value of each user's series, and their difference."""
    point = F.struct("ts", "event_id", "value")
    ends = m.raw("events").groupBy("user_id").agg(F.min(point).alias("a"), F.max(point).alias("b"))
    return ends.select(
        "user_id",
        F.col("a.value").alias("first_value"),
        F.col("b.value").alias("last_value"),
        (F.col("b.value") - F.col("a.value")).alias("delta"),
    )


def parent_delta(m):
    """Each commit's number of files against the author's commit before."""
    sizes = m.commit_files.groupBy("hash").agg(F.count(F.lit(1)).alias("files"))
    by = Window.partitionBy("author").orderBy("date", "hash")
    return m.commits.join(sizes, "hash").select(
        "hash", "files", F.lag("files").over(by).alias("before"), (F.col("files") - F.lag("files").over(by)).alias("delta")
    )


def upper_median(m):
    """The element at floor(n / 2) of each directory's sorted sizes."""
    return m.nodes.groupBy("directory").agg(F.array_sort(F.collect_list("lines")).alias("s")).select(
        "directory", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("median")
    )


def fill_forward(m):
    """The last sign-up value before each event of a user."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("event_type") == "signup", F.col("value"))
    return m.raw("events").select("event_id", F.last(value, ignorenulls=True).over(by).alias("filled"))


def hotspots(m):
    rows = m.functions.withColumn("signals", F.size(facts.signals()).cast("long"))
    keys = ["file", "line", "name", "decisions", "lines", "signals"]
    return rows.filter("signals > 0").select(*keys).distinct().orderBy(
        F.desc("signals"), F.desc("decisions"), F.desc("lines"), "file", "line", "name"
    ).limit(50)


WEIGHTS = ("high-complexity", "nested-loops", "deep-nesting", "long-function", "many-parameters", "recursion")


def ranked_candidates(m):
    """Files by the sum of the declared weights of their signals."""
    rows = m.functions.select("file", "lines", F.explode(facts.signals()).alias("signal")).filter(
        F.col("signal").isin(*WEIGHTS)
    )
    weights = F.create_map(*(F.lit(x) for i, n in enumerate(WEIGHTS) for x in (n, len(WEIGHTS) - i)))
    return (
        rows.groupBy("file")
        .agg(F.sum(weights[F.col("signal")]).alias("weight"), F.sum("lines").alias("lines"))
        .orderBy(F.desc("weight"), F.desc("lines"), "file")
        .limit(40)
    )


def risky_untested(m):
    """Complexity times churn times uncovered share of each file; a missing input counts as 1."""
    complexity = m.functions.groupBy("file").agg(F.max("decisions").alias("complexity")).filter("complexity > 0")
    churn = history.churn(m.commits, m.commit_files).select(F.col("path").alias("file"), F.col("commits").alias("churn"))
    uncovered = file_coverage(m).select("file", decimals(1 - F.col("hit") / F.col("found"), 3).alias("uncovered"))
    rows = complexity.join(churn, "file", "left").join(uncovered, "file", "left")
    score = F.col("complexity") * F.coalesce("churn", F.lit(1)) * F.coalesce("uncovered", F.lit(1.0))
    return (
        rows.withColumn("score", decimals(score, 3))
        .select("file", "complexity", "churn", "uncovered", "score")
        .orderBy(F.desc("score"), "file")
        .limit(50)
    )


_SIGNALS_SQL = """, signal_rows as (
  select file, name, line, lines, decisions, 'nested-loops' as signal from functions where loops >= 2
  union all select file, name, line, lines, decisions, 'deep-nesting' from functions where nesting >= 4
  union all select file, name, line, lines, decisions, 'high-complexity' from functions where decisions >= 10
  union all select file, name, line, lines, decisions, 'long-function' from functions where lines >= 50
  union all select file, name, line, lines, decisions, 'many-parameters' from functions where parameters >= 5
  union all select file, name, line, lines, decisions, 'recursion' from functions where recursive
  union all select file, name, line, lines, decisions, 'linear-scan-in-loop' from functions where scans > 0
  union all select file, name, line, lines, decisions, 'sort-in-loop' from functions where sorts > 0)"""
_N_SIGNALS = """(cast(loops >= 2 as int) + cast(nesting >= 4 as int) + cast(decisions >= 10 as int)
  + cast(lines >= 50 as int) + cast(parameters >= 5 as int) + cast(recursive as int) + scans + sorts)"""
_FILE_COVERAGE = """, file_coverage as (
  select file, count(*) as found, count(*) filter (hits > 0) as hit from coverage group by 1)"""

QUERIES = {
    "p01_relationship": (
        lambda m: counted(m.edge_rows.select(facts.relationship().alias("relation")), "relation"),
        with_tables("edge_rows", """select coalesce(relationship, case when kind = 're-export' then kind
          when role = 'declare' and kind = 'namespace' then 'module-declaration'
          when role = 'declare' then 'executable-module' else 'import' end) as relation, count(*) as n
          from edge_rows group by 1"""),
    ),
    "p02_adjacency_filter": (
        lambda m: facts.adjacency_sizes(m.edge_rows),
        with_tables("edge_rows", """, pairs as (select source, target, bool_or(role = 'use') as used,
            bool_or(role = 'use' or kind = 're-export') as kept from edge_rows where source <> target group by 1, 2)
          select 'all' as option, count(*) as n from pairs union all
          select 'use', count(*) from pairs where used union all
          select 'use and re-export', count(*) from pairs where kept"""),
    ),
    "p03_path_functions": (
        test_paths,
        with_tables("nodes", """select id, path,
          case when regexp_matches(lower(path), '(^|/)(__tests__|tests?|specs?)(/|$)')
              or regexp_matches(lower(path), '(^|[._-])(test|spec)s?\\.[^.]+$')
              or regexp_matches(lower(path), '(^|/)(test|spec)[._-]') then 'test'
            when kind = 'entry' then 'entry' else 'module' end as found_kind,
          '.' || split_part(path, '.', -1) as extension, regexp_replace(path, '/[^/]*$', '') as folder,
          split_part(path, '/', 1) as top from nodes"""),
    ),
    "p05_minified": (
        lambda m: m.raw("documents").filter(paths.looks_minified(F.col("text"))).select("doc_id"),
        """select doc_id from documents where length(text) > 4096
          and length(text) / (1.0 + length(text) - length(replace(text, chr(10), ''))) > 500""",
    ),
    "p06_excluded_segments": (
        lambda m: facts.excluded(m.nodes, ["widget", "gear"]).groupBy("detail").agg(F.count(F.lit(1)).alias("n")),
        with_tables("nodes", """, found as (select list_filter(string_split(path, '/'),
            lambda x: x in ('widget', 'gear'))[1] as detail from nodes)
          select detail || '/' as detail, count(*) as n from found where detail is not null group by 1"""),
    ),
    "p07_globs": (
        globbed,
        with_tables("nodes", f"""select pattern, count(*) as files, cast(sum(lines) as bigint) as lines
          from ({GLOB_SQL}) x group by 1"""),
    ),
    "p09_signals": (
        lambda m: counted(m.functions.select(F.explode(facts.signals()).alias("signal")), "signal"),
        with_tables("functions", _SIGNALS_SQL + " select signal, count(*) as n from signal_rows group by 1"),
    ),
    "p10_periphery": (
        lambda m: counted(m.nodes.select(facts.periphery(F.col("path")).alias("class")), "class"),
        with_tables("nodes", """select case when regexp_matches(path, '(^|/)(tests?|specs?)/|[._](test|spec)\\.') then 'tests'
          when regexp_matches(path, '(^|/)(scripts?|tools?)/') then 'scripts'
          when regexp_matches(path, '(^|/)(gear|generated)/') then 'generated'
          when regexp_matches(path, '(^|/)docs?/') then 'docs' else 'source' end as class, count(*) as n
          from nodes group by 1"""),
    ),
    "p13_untested": (
        lambda m: file_coverage(m).filter("hit * 100 < found * 50"),
        with_tables("coverage", _FILE_COVERAGE + " select file, found, hit from file_coverage where hit * 100 < found * 50"),
    ),
    "a02_kind_counts": (
        lambda m: m.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")),
        with_tables("nodes", "select kind, count(*) as files, cast(sum(lines) as bigint) as lines from nodes group by 1"),
    ),
    "a03_directory_rollup": (
        lambda m: facts.directory_rollup(m.nodes, m.edges),
        with_tables("nodes edges", """select directory, count(distinct id) as files, count(target) as fan_in
          from nodes left join edges on target = id group by 1"""),
    ),
    "a04_block_rollup": (
        block_edges,
        with_tables("nodes edge_rows", """, j as (select e.*, a.directory as from_directory, b.directory as to_directory
            from edge_rows e join nodes a on a.id = source join nodes b on b.id = target
            where a.directory <> b.directory),
          r as (select *, row_number() over (partition by from_directory, to_directory
            order by kind = 'call', line, source, target, kind, role) as n from j)
          select from_directory, to_directory, source, target, kind, line from r where n = 1"""),
    ),
    "a05_unit_edges": (
        unit_edges,
        with_tables("nodes edge_rows", """, j as (select e.line, source, target, a.unit as from_unit, b.unit as to_unit
            from edge_rows e join nodes a on a.id = source join nodes b on b.id = target
            where a.unit <> b.unit and e.kind <> 'call'),
          r as (select *, row_number() over (partition by from_unit, to_unit order by line, source, target) as n from j)
          select from_unit, to_unit, count(*) as weight,
            string_agg(cast(line as varchar), ',' order by line) filter (n <= 3) as lines from r group by 1, 2"""),
    ),
    "a06_tier_cells": (
        tier_cells,
        with_tables("nodes", """select coalesce(unit, '*') as unit, coalesce(tier, '*') as tier, count(*) as files,
          cast(sum(lines) as bigint) as lines,
          floor(cast(count(*) as double) / (select count(*) from nodes) * 1000 + 0.5) / 1000 as share
          from nodes group by grouping sets ((), (tier), (unit), (unit, tier))"""),
    ),
    "a07_tier_flow": (
        tier_flow,
        with_tables("nodes edge_rows", """select a.tier as from_tier, b.tier as to_tier, e.kind, count(*) as weight,
          count(*) filter (a.unit <> b.unit) as cross_unit, count(*) filter (role = 'declare') as declared,
          string_agg(distinct a.unit, ',' order by a.unit) as units, min(line) as first_line
          from edge_rows e join nodes a on a.id = source join nodes b on b.id = target group by 1, 2, 3"""),
    ),
    "a09_cohesion": (
        cohesion,
        with_tables("nodes edges", """, j as (select a.directory as f, b.directory as t from edges
            join nodes a on a.id = source join nodes b on b.id = target),
          u as (select f as directory, f = t as inside from j union all select t, f = t from j)
          select directory, count(*) as connections, count(*) filter (inside) as inside,
            cast(floor(cast(count(*) filter (inside) as double) / count(*) * 100 + 0.5) as bigint) as value
          from u group by 1"""),
    ),
    "a10_churn": (
        lambda m: history.churn(m.commits, m.commit_files),
        with_tables("commits commit_files", """select path, count(*) as commits, count(distinct author) as authors,
          min(date) as first_date, max(date) as last_date from commit_files join commits using (hash) group by 1"""),
    ),
    "a11_co_change": (
        lambda m: history.co_change(m.commit_files, most_files=8, least_commits=2, least_ratio=0.03),
        with_tables("commit_files", """, churn as (select path, count(*) as n from commit_files group by 1),
          small as (select hash from commit_files group by 1 having count(*) <= 8),
          pairs as (select a.path as source, b.path as target, count(*) as shared from commit_files a
            join commit_files b on a.hash = b.hash and a.path < b.path join small s on s.hash = a.hash group by 1, 2)
          select source, target, shared, x.n + y.n - shared as either,
            floor(cast(shared as double) / (x.n + y.n - shared) * 1000 + 0.5) / 1000 as ratio
          from pairs join churn x on x.path = source join churn y on y.path = target
          where shared >= 2 and cast(shared as double) / (x.n + y.n - shared) >= 0.03"""),
    ),
    "a13_coverage_totals": (
        coverage_totals,
        with_tables("nodes coverage", _FILE_COVERAGE + """ select coalesce(directory, '*') as directory,
          coalesce(tier, '*') as tier, cast(sum(hit) as bigint) as hit, cast(sum(found) as bigint) as found,
          floor(cast(sum(hit) as double) / cast(sum(found) as double) * 100 * 10 + 0.5) / 10 as percent,
          count(*) filter (hit * 100 < found * 50) as untested
          from file_coverage join nodes on id = file group by rollup (directory, tier)"""),
    ),
    "a14_changed_coverage": (
        changed_coverage,
        with_tables("commits commit_files coverage", """select f.path as file, count(*) as changed,
          count(c.file) as covered, cast(floor(cast(count(c.file) as double) / count(*) * 100 + 0.5) as bigint) as percent
          from commit_files f join commits k on k.hash = f.hash and date >= date '2001-01-01'
          left join coverage c on c.file = f.path and c.line = f.hash and hits > 0 group by 1"""),
    ),
    "a15_risk_inventory": (
        risk_inventory,
        """select s_nationkey as ecosystem, count(*) filter (s_acctbal < 0) as critical,
          count(*) filter (s_acctbal >= 0 and s_acctbal < 3000) as high,
          count(*) filter (s_acctbal >= 3000) as low from supplier group by 1""",
    ),
    "a16_import_index": (
        import_index,
        """select l_suppkey % 25 as ecosystem, l_suppkey as package, count(distinct l_partkey) as files,
          min(l_partkey) as first_file from lineitem group by 1, 2""",
    ),
    "a17_field_drift": (
        field_drift,
        """with r as (select l_partkey, l_suppkey, min(l_tax) as tax, max(l_discount) as discount from lineitem group by 1, 2)
          select l_partkey as contract, count(*) as repositories, count(distinct tax) as taxes,
            count(distinct discount) as discounts, case when count(distinct tax) > 1 then 'type' else 'required' end as kind
          from r group by 1 having count(*) >= 2 and (count(distinct tax) > 1 or count(distinct discount) > 1)""",
    ),
    "a18_shape_twins": (
        shape_twins,
        """with r as (select doc_id, source, substr(sha1(array_to_string(
            list_sort(list_distinct(string_split(coalesce(text, ''), chr(10)))), '|')), 1, 16) as shape from documents)
          select shape, count(*) as documents, count(distinct source) as sources, min(doc_id) as first_doc
          from r group by 1 having count(*) > 1""",
    ),
    "a19_product_candidates": (
        candidates,
        with_tables("data_edges contracts", """, w as (select dataset, unit, repository from data_edges
            where access = 'writes'),
          r as (select * from data_edges where access = 'reads'),
          wu as (select dataset, count(distinct unit) as units from w group by 1)
          select dataset, 'no-single-writer' as kind, units as n from wu where units >= 2 union all
          select dataset, 'output-port', count(*) from r where dataset in (select dataset from w)
            and not exists (select 1 from w where w.dataset = r.dataset and w.unit = r.unit) group by 1 union all
          select dataset, 'shared-without-contract', count(distinct repository) from r
            where dataset in (select dataset from w) and dataset not in (select dataset from contracts)
            and not exists (select 1 from w where w.dataset = r.dataset and w.repository = r.repository) group by 1"""),
    ),
    "a20_product_level": (
        product_level,
        with_tables("data_edges", """, w as (select distinct dataset, unit from data_edges where access = 'writes'),
          r as (select distinct dataset, unit from data_edges where access = 'reads'),
          o as (select dataset, count(*) as consumers from (select * from r except select * from w) x group by 1)
          select dataset, count(*) as units, coalesce(any_value(consumers), 0) as consumers, count(*) > 1 as spans_units
          from w left join o using (dataset) group by 1"""),
    ),
    "a22_file_complexity": (
        file_complexity,
        with_tables("functions", f"""select file, count(*) as functions, cast(sum(decisions) as bigint) as decisions,
          max(decisions) as most_decisions, max(nesting) as most_nesting, cast(sum(lines) as bigint) as loc,
          floor(cast(count(*) filter ({_N_SIGNALS} > 0) as double) / count(*) * 1000 + 0.5) / 1000 as signal_share
          from functions group by 1"""),
    ),
    "a24_model_findings": (
        lambda m: facts.model_findings(m.raw("lineitem"), m.raw("part"), m.raw("orders"), m.raw("customer")),
        """select 'no-primary-key' as finding, 'lineitem' as name, count(*) as n from (
            select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1) x union all
          select 'orphan-table', 'part', count(*) from part where p_partkey not in (select l_partkey from lineitem) union all
          select 'orphan-table', 'customer', count(*) from customer where c_custkey not in (select o_custkey from orders) union all
          select 'undeclared-key', 'orders', count(*) from orders where o_custkey not in (select c_custkey from customer)""",
    ),
    "a26_member_counts": (
        lambda m: m.data_edges.groupBy("dataset").agg(
            F.count_distinct(F.when(F.col("access") == "reads", F.col("file"))).alias("readers"),
            F.count_distinct(F.when(F.col("access") == "writes", F.col("file"))).alias("writers"),
        ),
        with_tables("data_edges", """select dataset, count(distinct case when access = 'reads' then file end) as readers,
          count(distinct case when access = 'writes' then file end) as writers from data_edges group by 1"""),
    ),
    "w01_percentile_rank": (
        percentile_scores,
        with_tables("nodes", """select id, cast(floor(percent_rank() over (order by lines) * 100 + 0.5) as bigint)
          as lines_rank from nodes"""),
    ),
    "w04_first_seen": (
        lambda m: first_rows(m.edge_rows, ["target"], ["line", "source", "kind", "role"]).select("target", "source", "line"),
        with_tables("edge_rows", """select target, source, line from (select *, row_number() over (partition by target
          order by line, source, kind, role) as n from edge_rows) x where n = 1"""),
    ),
    "w05_first_last_delta": (
        first_last,
        """select user_id, arg_min(value, (ts, event_id)) as first_value, arg_max(value, (ts, event_id)) as last_value,
          arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) as delta from events group by 1""",
    ),
    "w06_parent_delta": (
        parent_delta,
        with_tables("commits commit_files", """, s as (select hash, count(*) as files from commit_files group by 1)
          select hash, files, lag(files) over w as before, files - lag(files) over w as delta
          from commits join s using (hash) window w as (partition by author order by date, hash)"""),
    ),
    "w09_upper_median": (
        upper_median,
        with_tables("nodes", """select directory, list_sort(list(lines))[cast(floor(count(*) / 2) as int) + 1] as median
          from nodes group by 1"""),
    ),
    "w10_fill_forward": (
        fill_forward,
        """select event_id, last_value(case when event_type = 'signup' then value end ignore nulls) over (
          partition by user_id order by ts, event_id rows between unbounded preceding and current row) as filled
          from events""",
    ),
    "t02_top_files": (
        lambda m: facts.directory_tops(m.nodes, m.edges, 3),
        with_tables("nodes edges", """, f as (select id, directory, count(target) as fan_in from nodes
            left join edges on target = id group by 1, 2)
          select directory, id, fan_in, n as rank from (select *, row_number() over (partition by directory
            order by fan_in desc, id) as n from f) x where n <= 3"""),
    ),
    "t03_hotspots": (
        hotspots,
        with_tables("functions", f"""select distinct file, line, name, decisions, lines,
          cast({_N_SIGNALS} as bigint) as signals from functions where {_N_SIGNALS} > 0
          order by signals desc, decisions desc, lines desc, file, line, name limit 50"""),
    ),
    "t05_candidates": (
        ranked_candidates,
        with_tables("functions", _SIGNALS_SQL + """ select file, cast(sum(case signal when 'high-complexity' then 6
            when 'nested-loops' then 5 when 'deep-nesting' then 4 when 'long-function' then 3
            when 'many-parameters' then 2 else 1 end) as bigint) as weight, cast(sum(lines) as bigint) as lines
          from signal_rows where signal not like '%-in-loop' group by 1 order by weight desc, lines desc, file limit 40"""),
    ),
    "t06_risky_untested": (
        risky_untested,
        with_tables("functions commit_files coverage", _FILE_COVERAGE + """, c as (select file, max(decisions) as complexity
            from functions group by 1 having max(decisions) > 0),
          k as (select path, count(*) as churn from commit_files group by 1),
          u as (select file, floor((1 - cast(hit as double) / found) * 1000 + 0.5) / 1000 as uncovered from file_coverage)
          select c.file, complexity, churn, uncovered,
            floor(complexity * coalesce(churn, 1) * coalesce(uncovered, 1.0) * 1000 + 0.5) / 1000 as score
          from c left join k on path = c.file left join u on u.file = c.file order by score desc, c.file limit 50"""),
    ),
    "t08_co_change_top": (
        lambda m: history.co_change(m.commit_files, most_files=8, least_commits=1, least_ratio=0.0)
        .orderBy(F.desc("shared"), "source", "target")
        .limit(500),
        with_tables("commit_files", """, churn as (select path, count(*) as n from commit_files group by 1),
          small as (select hash from commit_files group by 1 having count(*) <= 8),
          pairs as (select a.path as source, b.path as target, count(*) as shared from commit_files a
            join commit_files b on a.hash = b.hash and a.path < b.path join small s on s.hash = a.hash group by 1, 2)
          select source, target, shared, x.n + y.n - shared as either,
            floor(cast(shared as double) / (x.n + y.n - shared) * 1000 + 0.5) / 1000 as ratio
          from pairs join churn x on x.path = source join churn y on y.path = target
          order by shared desc, source, target limit 500"""),
    ),
}
