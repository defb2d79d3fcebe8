"""References, impact, differences of interfaces and simulated changes over the model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.adapters.star_schema import with_tables
from lodegraph.functions import paths
from lodegraph.functions.tables import settled
from lodegraph.operators import closure, diffs, interfaces, references
from lodegraph.plans.join_queries import package_imports, revision

ALIASES = [("src", 0, "@/*", "src/*"), ("src", 1, "~spec", "src/spec/blue/ring.ts"), ("src/red", 0, "@/*", "src/red/*")]


def aliases(m):
    """Imports by alias: '@/rest' of the part that an edge leads to."""
    start = m.nodes.filter("path like 'src/%'").select(F.col("id").alias("source"), F.col("path").alias("file"))
    end = m.nodes.filter("path like 'src/%'").select(F.col("id").alias("target"), F.col("path").alias("t"))
    rows = m.edges.join(start, "source").join(end, "target")
    rest = F.concat(F.lit("@/"), F.regexp_replace(F.regexp_replace("t", r"^src/", ""), r"\.ts$", ""))
    specifier = F.when(F.col("target") % 5 == 0, "~spec").when(F.col("target") % 7 == 0, "react").otherwise(rest)
    configs = m.spark.createDataFrame(ALIASES, "unit string, ordinal int, pattern string, template string")
    return references.resolve_aliases(rows.select("file", specifier.alias("specifier")).distinct(), configs, m.nodes.select("path"))


def bindings(m):
    """Imports of parts: each edge binds the target under its number, by the kind of its order."""
    kind = F.when(F.col("line") % 3 == 0, "namespace").when(F.col("line") % 3 == 1, "default").otherwise("named")
    return m.edge_rows.filter("source <> target").select(
        F.col("source").alias("file"),
        (F.col("target") % 50).cast("string").alias("local"),
        kind.alias("kind"),
        (F.col("target") % 10).cast("string").alias("imported"),
        "target",
    ).distinct()


def lines(m):
    return m.raw("lineitem")


def call_edges(m):
    calls = lines(m).select(
        F.col("l_partkey").alias("file"),
        (F.col("l_suppkey") % 50).cast("string").alias("name"),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_orderkey") % 50).cast("string")).alias("receiver"),
        F.col("l_orderkey").alias("line"),
    )
    exports = m.nodes.select(F.col("id").alias("file"), (F.col("lines") % 10).cast("string").alias("name"))
    return references.call_edges(calls, bindings(m), exports)


def inheritance_edges(m):
    supertypes = lines(m).select(
        F.col("l_partkey").alias("file"),
        (F.col("l_suppkey") % 50).cast("string").alias("name"),
        F.when(F.col("l_linestatus") == "F", "extends").otherwise("implements").alias("relation"),
    )
    types = m.nodes.select(
        F.col("id").alias("file"), F.when(F.col("lines") % 2 == 0, "default").otherwise((F.col("lines") % 10).cast("string")).alias("name")
    )
    return references.inheritance_edges(supertypes, bindings(m), types)


def stems(m):
    return m.nodes.select("id", "directory", F.regexp_extract("path", r"([^/]+)\.[a-z.]+$", 1).alias("stem"))


def type_references(m):
    known = stems(m)
    names = m.edges.join(known.select(F.col("id").alias("target"), F.col("stem").alias("name")), "target")
    own = known.select(F.col("id").alias("file"), F.lit("ring").alias("name"))
    uses = names.select(F.col("source").alias("file"), "name").unionByName(own)
    found = references.type_references(uses, known, m.edges)
    return found.groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.sum("file").alias("files"), F.sum("target").alias("targets"))


def dependencies(m):
    key, kind = F.col("s_suppkey"), F.col("s_suppkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("pkg-"), key)).when(kind == 1, F.concat(F.lit("crate_"), key)).otherwise(
        F.concat(F.when(key % 7 == 0, "com.google.guava").otherwise(F.concat(F.lit("org.g"), key % 10)), F.lit(":art"), key)
    )
    return m.raw("supplier").select(F.element_at(F.array(F.lit("npm"), F.lit("cargo"), F.lit("maven")), (kind + 1).cast("int")).alias("ecosystem"), name.alias("name"))


def imported_packages(m):
    key, kind = F.col("package"), F.col("package") % 3
    name = F.when(kind == 0, F.concat(F.lit("pkg-"), key)).when(kind == 1, F.concat(F.lit("crate-"), key)).otherwise(
        F.when(key % 7 == 0, "com.google.common.collect").otherwise(F.concat(F.lit("org.g"), key % 10, F.lit(".util")))
    )
    return package_imports(m).select(
        F.element_at(F.array(F.lit("npm"), F.lit("cargo"), F.lit("maven")), (kind + 1).cast("int")).alias("ecosystem"), name.alias("package"), "file"
    )


def dependency_imports(m):
    return references.dependency_files(imported_packages(m).distinct(), dependencies(m))


def callers(m):
    ends = m.raw("part").select(
        F.col("p_partkey").alias("endpoint"),
        F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.when(F.col("p_size") % 3 == 0, "h").alias("host"),
        F.concat(F.lit("/"), F.col("p_brand"), F.lit("/{id}/"), F.translate("p_type", " ", "-")).alias("path"),
    )
    calls = lines(m).join(m.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("call"),
        F.when(F.col("l_linenumber") > 4, "GET").alias("method"),
        F.when(F.col("l_linestatus") == "F", "h").alias("host"),
        F.concat(F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("l_suppkey"), F.lit("/"), F.translate("p_type", " ", "-")).alias("path"),
    )
    return references.template_calls(ends, calls)


def live_drift(m):
    return references.presence_states(revision(m, 0, 3), revision(m, 1, 5), ["id"], ["type", "nullable"])


def observed(m):
    entries = m.raw("part").select(F.col("p_partkey").alias("entry"), F.translate("p_name", " ", "/").alias("label"))
    names = m.data_edges.filter("dataset % 3 = 0").select(F.col("dataset").cast("string").alias("name")).unionByName(
        m.spark.createDataFrame([("ring",), ("small/red",)], "name string")
    )
    return references.observed(entries, names).groupBy("observed").agg(F.count(F.lit(1)).alias("n"), F.sum("entry").alias("total"))


def advisories(m):
    return m.raw("supplier").filter("s_suppkey % 10 = 3").select(
        F.col("s_suppkey").alias("advisory"), F.lit("x").alias("ecosystem"), F.col("s_suppkey").alias("name")
    )


def advisory_impact(m):
    imports = lines(m).filter("l_quantity >= 49").select(
        F.lit("x").alias("ecosystem"), F.col("l_suppkey").alias("name"), F.col("l_partkey").alias("file")
    ).distinct()
    return references.advisory_impact(advisories(m), imports, m.edges)


def advisory_order(m):
    label = F.element_at(F.array(*(F.lit(x) for x in ("LOW", "Medium", "HIGH", "critical", "none"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = m.raw("supplier").select(F.col("s_suppkey").alias("advisory"), references.severity(label).alias("severity"))
    return rows.orderBy(F.desc(references.severity_rank(F.col("severity"))), "advisory").limit(30)


def fixed_versions(m):
    rows = lines(m).filter("l_quantity >= 45").select(F.col("l_suppkey").alias("advisory"), F.concat(F.col("l_linenumber"), F.lit(".0")).alias("fixed"))
    return references.fixed_versions(rows, ["advisory"])


def tiered_impact(m):
    changed = m.commit_files.filter("hash % 100 = 7").select(F.col("path").alias("file")).distinct()
    names = m.functions.select("file", (F.col("name") % 1000).cast("string").alias("name")).distinct()
    edges = m.edge_rows.filter("source <> target").select("source", "target", F.col("line").cast("string").alias("specifier"))
    return references.tiered_impact(settled(changed), names, edges)


def contract_impact(m):
    governed = m.data_edges.join(m.contracts, "dataset").withColumn("contract", F.col("dataset") % 40)
    return references.contract_impact(governed, m.edges)


def data_flow(m):
    files = m.nodes.select(F.col("id").alias("file"), "tier")
    return references.data_flow(m.data_edges, files, m.contracts)


def declared_intent(m):
    tiers = [("frontend", "api", True), ("api", "domain", True), ("domain", "data", True), ("data", "frontend", False), ("api", "data", False), ("domain", "infra", True)]
    declared = m.spark.createDataFrame(tiers, "source string, target string, allow boolean")
    ends = m.edges.join(m.nodes.select(F.col("id").alias("source"), F.col("tier").alias("s")), "source").join(
        m.nodes.select(F.col("id").alias("target"), F.col("tier").alias("t")), "target"
    )
    seen = ends.filter("s <> t and s <> 'unclassified' and t <> 'unclassified'").select(F.col("s").alias("source"), F.col("t").alias("target"))
    return references.declared_intent(declared, seen)


# ---------------------------------------------------------------- interfaces and simulations


def api_side(m, low, high):
    rows = revision(m, low, high)
    return rows.withColumn("operation", F.col("id") % 90).filter(F.col("operation") % 13 != high)


def api_diff(m):
    return interfaces.api_changes(api_side(m, 0, 3), api_side(m, 1, 5))


def public_side(m, low):
    return m.functions.filter(f"name % 2 = {low} and nesting < 3").groupBy("file", (F.col("name") % 40).alias("name")).agg(
        F.max("parameters").alias("parameters"), (F.max("decisions") % 3).cast("string").alias("type")
    )


def public_diff(m):
    return interfaces.public_changes(public_side(m, 0), public_side(m, 1))


def surface_diff(m):
    into = m.edges.groupBy(F.col("target").alias("file")).agg(F.count(F.lit(1)).alias("consumers"))
    return interfaces.surface(public_diff(m), into)


def preflight(m):
    found = diffs.changes(revision(m, 0, 3), revision(m, 1, 5), ["id"], ["type", "nullable", "default"])
    return interfaces.preflight(found.select(F.lit("t").alias("table"), F.concat(F.lit("c"), "id").alias("column"), *found.columns[1:]))


OPERATIONS = [("move", "src/red", "lib/red"), ("move", "tests/small", "lib/small")]


def what_if(m):
    """Edge and cycle differences when folders move, some edges are cut and others added."""
    start = m.nodes.select(F.col("id").alias("s"), F.col("path").alias("source"))
    end = m.nodes.select(F.col("id").alias("t"), F.col("path").alias("target"))
    rows = m.edges.select(F.col("source").alias("s"), F.col("target").alias("t")).join(start, "s").join(end, "t")
    rows = settled(rows.select("source", "target").filter("source <> target").distinct())
    cut = rows.filter(F.crc32(F.concat("source", F.lit(">"), "target").cast("binary")) % 50 == 0).orderBy("source", "target").limit(40)
    back = rows.select(F.col("target").alias("source"), F.col("source").alias("target")).join(rows, ["source", "target"], "left_anti")
    more = back.filter(F.crc32(F.concat("source", F.lit(">"), "target").cast("binary")) % 70 == 1).orderBy("source", "target").limit(40)
    operations = list(OPERATIONS)
    rename = lambda p: p.replace("src/red/", "lib/red/", 1) if p.startswith("src/red/") else p.replace("tests/small/", "lib/small/", 1) if p.startswith("tests/small/") else p
    operations += [("cut", rename(r["source"]), rename(r["target"])) for r in cut.collect()]  # at most 40 rows
    operations += [("add", rename(r["source"]), rename(r["target"])) for r in more.collect()]
    return interfaces.simulate(rows, operations)


_LEVEL = "select * from {}"
_B = """, bi as (select distinct source as file, cast(target % 50 as varchar) as local,
  case line % 3 when 0 then 'namespace' when 1 then 'default' else 'named' end as kind, cast(target % 10 as varchar) as imported, target
  from edge_rows where source <> target)"""
_REVISION = """(select l_partkey as id, ['smallint', 'integer', 'bigint'][count(*) % 3 + 1] as type, max(l_quantity) > 47 as required,
  min(l_quantity) < 3 as nullable, case when min(l_tax) > 0 then cast(min(l_tax) as varchar) end as "default"
  from lineitem where l_orderkey % 2 = {0} and l_partkey % 11 <> {1} group by 1)"""
_BOTH = f"with o as {_REVISION.format(0, 3)}, n as {_REVISION.format(1, 5)}"
_WIDER = """(list_position(['tinyint', 'smallint', 'integer', 'bigint'], n.type)
  > list_position(['tinyint', 'smallint', 'integer', 'bigint'], o.type))"""
_API = f"""with o as (select *, id % 90 as operation from {_REVISION.format(0, 3)} x where id % 90 % 13 <> 3),
  n as (select *, id % 90 as operation from {_REVISION.format(1, 5)} x where id % 90 % 13 <> 5)"""
_PUBLIC = """, pa as (select file, name % 40 as name, max(parameters) as parameters, cast(max(decisions) % 3 as varchar) as type
    from functions where name % 2 = 0 and nesting < 3 group by 1, 2),
  pb as (select file, name % 40 as name, max(parameters) as parameters, cast(max(decisions) % 3 as varchar) as type
    from functions where name % 2 = 1 and nesting < 3 group by 1, 2),
  pc as (select coalesce(pa.file, pb.file) as file, coalesce(pa.name, pb.name) as name,
    case when pa.file is null then 'added' when pb.file is null then 'removed' else 'changed-signature' end as change
    from pa full join pb on pa.file = pb.file and pa.name = pb.name
    where pa.file is null or pb.file is null or pa.parameters <> pb.parameters or pa.type <> pb.type)"""

QUERIES = {
    "j02_alias_resolution": (
        aliases,
        with_tables("nodes edges", """, i as (select distinct s.path as file, case when t.id % 5 = 0 then '~spec' when t.id % 7 = 0 then 'react'
            else '@/' || regexp_replace(regexp_replace(t.path, '^src/', ''), '\\.ts$', '') end as specifier
            from edges join nodes s on s.id = source join nodes t on t.id = target where s.path like 'src/%' and t.path like 'src/%'),
          c as (select *, case when file like 'src/red/%' then 'src/red' else 'src' end as config from i),
          b as (select *, case when specifier like '@/%' then config || substr(specifier, 2) || '.ts'
            when specifier = '~spec' and config = 'src' then 'src/spec/blue/ring.ts' end as base from c)
          select file, specifier, config, case when base in (select path from nodes) then base end as target, base is not null as claimed from b"""),
    ),
    "s08_call_edges": (
        call_edges,
        with_tables("nodes edge_rows", _B + """ select distinct l_partkey as source, target, l_orderkey as line from lineitem
          join bi on bi.file = l_partkey and local = cast(case when l_linenumber % 2 = 0 then l_orderkey % 50 else l_suppkey % 50 end as varchar)
          join nodes on nodes.id = target
          where (l_linenumber % 2 = 0) = (bi.kind = 'namespace')
            and cast(lines % 10 as varchar) = case when bi.kind = 'namespace' then cast(l_suppkey % 50 as varchar) else imported end"""),
    ),
    "s09_inheritance_edges": (
        inheritance_edges,
        with_tables("nodes edge_rows", _B + """ select distinct l_partkey as source, target,
            case when l_linestatus = 'F' then 'extends' else 'implements' end as relation, local as name from lineitem
          join bi on bi.file = l_partkey and local = cast(l_suppkey % 50 as varchar) and bi.kind <> 'namespace'
          join nodes on nodes.id = target where target <> l_partkey
            and case when lines % 2 = 0 then 'default' else cast(lines % 10 as varchar) end = case when bi.kind = 'default' then 'default' else imported end"""),
    ),
    "j22_type_references": (
        type_references,
        with_tables("nodes edges", """, k as (select id, directory, regexp_extract(path, '([^/]+)\\.[a-z.]+$', 1) as stem from nodes),
          u as (select source as file, stem as name from edges join k on k.id = target union select id, 'ring' from k),
          i as (select source as file, stem as name, count(*) as n, min(target) as target from edges join k on k.id = target group by 1, 2),
          s as (select directory, stem as name, count(*) as n, min(id) as target from k group by 1, 2),
          r as (select u.file, case when k.stem = u.name then u.file when i.n = 1 then i.target when s.n = 1 then s.target end as target,
            case when k.stem = u.name then 'this-file' when i.n = 1 then 'import' when s.n = 1 then 'same-folder' end as basis
            from u join k on k.id = u.file left join i on i.file = u.file and i.name = u.name
            left join s on s.directory = k.directory and s.name = u.name)
          select basis, count(*) as n, cast(sum(file) as bigint) as files, cast(sum(target) as bigint) as targets from r where basis is not null group by 1"""),
    ),
    "j09_dependency_imports": (
        dependency_imports,
        """with d as (select s_suppkey as k, ['npm', 'cargo', 'maven'][s_suppkey % 3 + 1] as ecosystem, case s_suppkey % 3 when 0 then 'pkg-' || s_suppkey
            when 1 then 'crate_' || s_suppkey else case when s_suppkey % 7 = 0 then 'com.google.guava' else 'org.g' || s_suppkey % 10 end
              || ':art' || s_suppkey end as name from supplier),
          i as (select distinct l_suppkey as k, o_custkey as file from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)
          select ecosystem, name, count(distinct file) as files, min(file) as first_file from d join i on case when ecosystem = 'maven'
            then i.k % 3 = 2 and ((d.k % 7 = 0 and i.k % 7 = 0) or (d.k % 7 <> 0 and i.k % 7 <> 0 and d.k % 10 = i.k % 10)) else i.k = d.k end
          group by 1, 2""",
    ),
    "j14_template_callers": (
        callers,
        """with e as (select p_partkey as endpoint, case when p_size % 2 = 0 then 'GET' else 'POST' end as method,
            case when p_size % 3 = 0 then 'h' end as host, p_brand, p_type from part),
          c as (select l_orderkey as call, case when l_linenumber > 4 then 'GET' end as method, case when l_linestatus = 'F' then 'h' end as host,
            p_brand, p_type from lineitem join part on l_partkey = p_partkey)
          select endpoint, count(distinct call) as calls from e join c on e.p_brand = c.p_brand and e.p_type = c.p_type
            and (c.method is null or c.method = e.method) and (c.host is null or c.host is not distinct from e.host) group by 1""",
    ),
    "j23_live_drift": (
        live_drift,
        _BOTH + """ select coalesce(o.id, n.id) as id, case when n.id is null then 'missing' when o.id is null then 'extra'
            when o.type <> n.type then 'type' else 'nullable' end as state from o full join n on o.id = n.id
          where o.id is null or n.id is null or o.type <> n.type or o.nullable <> n.nullable""",
    ),
    "j24_observed": (
        observed,
        with_tables("data_edges", """, n as (select distinct cast(dataset as varchar) as name from data_edges where dataset % 3 = 0 union select 'ring' union select 'small/red'),
          e as (select p_partkey as entry, replace(p_name, ' ', '/') as label from part)
          select label in (select name from n) or split_part(label, '/', -1) in (select name from n)
            or cast(entry as varchar) in (select name from n) as observed, count(*) as n, cast(sum(entry) as bigint) as total from e group by 1"""),
    ),
    "g26_advisory_impact": (
        advisory_impact,
        with_tables("edges", """, a as (select s_suppkey as advisory from supplier where s_suppkey % 10 = 3),
          i as (select distinct advisory, l_partkey as id from a join lineitem on l_suppkey = advisory where l_quantity >= 49),
          w(advisory, id) as (select * from i union select advisory, source from w join edges on target = w.id)
          select advisory, (select count(*) from i where i.advisory = a.advisory) as importers,
            (select count(*) from w where w.advisory = a.advisory) as affected from a""", True),
    ),
    "t10_advisory_order": (
        advisory_order,
        """with s as (select s_suppkey as advisory, ['low', 'moderate', 'high', 'critical', 'unknown'][s_suppkey % 5 + 1] as severity from supplier)
          select * from s order by list_position(['unknown', 'low', 'moderate', 'high', 'critical'], severity) desc, advisory limit 30""",
    ),
    "r12_fixed_versions": (
        fixed_versions,
        """select advisory, string_agg(fixed, ',' order by fixed) as fixed from (select distinct l_suppkey as advisory, l_linenumber || '.0' as fixed
          from lineitem where l_quantity >= 45) x group by 1""",
    ),
    "g27_tiered_impact": (
        tiered_impact,
        with_tables("edge_rows functions commit_files", """, ch as (select distinct path as file from commit_files where hash % 100 = 7),
          e as (select source, target, line from edge_rows where source <> target),
          f as (select distinct file, cast(name % 1000 as varchar) as name from functions),
          h as (select target as file, source, bool_or(coalesce(contains(cast(line as varchar), name), false)) as hit from e
            join ch on ch.file = target left join f on f.file = target group by 1, 2),
          w(file, id) as (select file, source from ch join e on target = file union select w.file, source from w join e on target = w.id),
          r as (select file, count(*) as reachable from w where id <> file group by 1)
          select h.file, count(*) filter (hit) as definite, count(*) filter (not hit) as possible, any_value(reachable) as reachable
          from h join r on r.file = h.file group by 1""", True),
    ),
    "g24_contract_impact": (
        contract_impact,
        with_tables("edges data_edges contracts", """, g as (select d.*, d.dataset % 40 as contract from data_edges d join contracts using (dataset)),
          w(contract, id) as (select contract, dataset from g union select contract, target from w join edges on source = w.id),
          k as (select w.contract, count(*) as downstream from w where (contract, id) not in (select contract, dataset from g) group by 1)
          select g.contract, count(distinct file) as consumers, count(distinct unit) as units, count(distinct repository) as repositories,
            coalesce(any_value(downstream), 0) as downstream from g left join k on k.contract = g.contract group by 1""", True),
    ),
    "g28_data_flow": (
        data_flow,
        with_tables("nodes data_edges contracts", """, s as (select dataset, access, tier, count(distinct file) as n from data_edges
            join nodes on nodes.id = file group by 1, 2, 3)
          select w.tier as from_tier, r.tier as to_tier, count(*) as datasets, cast(sum(w.n * r.n) as bigint) as flows,
            count(*) filter (w.dataset in (select dataset from contracts)) as governed
          from s w join s r on w.dataset = r.dataset and w.access = 'writes' and r.access = 'reads' group by 1, 2"""),
    ),
    "g29_declared_intent": (
        declared_intent,
        with_tables("nodes edges", """, d(source, target, allow) as (values ('frontend', 'api', true), ('api', 'domain', true), ('domain', 'data', true),
            ('data', 'frontend', false), ('api', 'data', false), ('domain', 'infra', true)),
          s as (select distinct a.tier as source, b.tier as target from edges join nodes a on a.id = source join nodes b on b.id = target
            where a.tier <> b.tier and a.tier <> 'unclassified' and b.tier <> 'unclassified'),
          r as (select coalesce(d.source, s.source) as source, coalesce(d.target, s.target) as target, case when allow is null then 'undeclared'
            when allow and s.source is null then 'ghost' when allow then 'confirmed' when s.source is not null then 'violation' end as state
            from d full join s on d.source = s.source and d.target = s.target)
          select * from r where state is not null"""),
    ),
    "d06_api_diff": (
        api_diff,
        _API + f""", po as (select distinct operation from o), pn as (select distinct operation from n)
          select operation, cast(null as bigint) as field, 'operation-removed' as change, 'breaking' as verdict from po where operation not in (select operation from pn)
          union all select operation, null, 'operation-added', 'safe' from pn where operation not in (select operation from po)
          union all select coalesce(o.operation, n.operation), coalesce(o.id, n.id),
            case when n.id is null then 'removed' when o.id is null then 'added' when o.type <> n.type then 'type' else 'required' end,
            case when n.id is null then 'conditional' when o.id is null then case when n.required then 'breaking' else 'safe' end
              when o.type <> n.type then case when {_WIDER} then 'safe' else 'breaking' end
              when n.required then 'breaking' else 'safe' end
          from o full join n on o.id = n.id where coalesce(o.operation, n.operation) in (select operation from po)
            and coalesce(o.operation, n.operation) in (select operation from pn)
            and (o.id is null or n.id is null or o.type <> n.type or o.required <> n.required)""",
    ),
    "d07_public_diff": (
        public_diff,
        with_tables("functions", _PUBLIC + " select file, name, change from pc"),
    ),
    "d08_surface_diff": (
        surface_diff,
        with_tables("functions edges", _PUBLIC + """, c as (select target, count(*) as n from edges group by 1)
          select file, count(*) filter (change = 'removed') as removed, count(*) filter (change = 'changed-signature') as changed,
            count(*) filter (change = 'added') as added, count(*) filter (change <> 'added') > 0 as breaking, coalesce(any_value(n), 0) as consumers
          from pc left join c on target = file group by 1"""),
    ),
    "d10_preflight": (
        preflight,
        _BOTH + f""", c as (select 'c' || coalesce(o.id, n.id) as col, o.id as oid, n.id as nid, o.nullable as onull, n.nullable as nnull,
            n."default" as ndef, o.type as ot, n.type as nt, coalesce({_WIDER}, false) as wider from o full join n on o.id = n.id)
          select col as "column", 'add-not-null-column' as "check", 'blocks' as effect, 'SELECT COUNT(*) AS violations FROM t' as probe from c
            where oid is null and not nnull and ndef is null
          union all select col, 'set-not-null', 'blocks', 'SELECT COUNT(*) AS violations FROM t WHERE ' || col || ' IS NULL' from c
            where oid is not null and nid is not null and onull and not nnull
          union all select col, 'drop-column', 'data-loss', 'SELECT COUNT(' || col || ') AS violations FROM t' from c where nid is null
          union all select col, 'narrow-integer', 'blocks', 'SELECT COUNT(*) AS violations FROM t WHERE ' || col || ' NOT BETWEEN '
            || case nt when 'smallint' then '-32768 AND 32767' when 'integer' then '-2147483648 AND 2147483647'
              else '-9223372036854775808 AND 9223372036854775807' end from c where oid is not null and nid is not null and ot <> nt and not wider""",
    ),
    "d02_what_if": (what_if, None),
}
