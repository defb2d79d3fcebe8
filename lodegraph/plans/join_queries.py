"""Joins that resolve references and differences of two revisions, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.adapters.star_schema import with_tables
from lodegraph.functions import paths
from lodegraph.operators import diffs, matching

# ---------------------------------------------------------------- joins


def imports(m):
    """Relative imports between part files: the importer's path, a specifier, the part imported."""
    rows = m.edges.join(m.nodes.select(F.col("id").alias("source"), F.col("path").alias("file")), "source")
    target = m.nodes.select(F.col("id").alias("target"), F.regexp_replace("path", r"\.ts$", "").alias("t"))
    rows = rows.join(target, "target").filter("file like 'src/%' and t like 'src/%' and file not like 'src/spec/%'")
    return rows.select("file", F.concat(F.lit("../"), F.col("t")).alias("specifier")).distinct()


def resolved(m):
    rows = imports(m).withColumn("specifier", F.regexp_replace("specifier", "^../src/", "../../src/x/../"))
    return matching.resolve_imports(rows.filter("file like 'src/%/%'"), m.nodes.filter("lines % 3 > 0"))


def region_units(m):
    """The deepest unit around each path, of a few declared ones."""
    units = m.spark.createDataFrame([("src",), ("src/red",), ("src/spec/blue",), ("tests/small/ring.ts",)], "unit string")
    rows = matching.longest_prefix(m.nodes.select("id", "path"), "path", units)
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("files"), F.min("id").alias("first_id"))


def suppliers(m):
    return m.raw("supplier").select(
        F.col("s_suppkey").alias("package"),
        F.col("s_nationkey").cast("long").alias("repository"),
        (F.col("s_suppkey") % 3).alias("ecosystem"),
    )


def package_imports(m):
    lines = m.raw("lineitem").join(m.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(m.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.select(
        F.col("l_suppkey").alias("package"),
        F.col("c_nationkey").cast("long").alias("repository"),
        (F.col("l_suppkey") % 3).alias("ecosystem"),
        F.col("o_custkey").alias("file"),
    )


def service_flows(m):
    orders = m.raw("orders")
    calls = orders.select(
        F.col("o_orderkey").alias("call"),
        F.col("o_orderstatus").alias("host"),
        (F.col("o_custkey") % 400).alias("path"),
        F.when(F.col("o_orderkey") % 3 > 0, F.substring("o_orderpriority", 1, 1)).alias("method"),
    )
    endpoints = m.raw("customer").select(
        F.col("c_custkey").alias("endpoint"),
        F.when(F.col("c_acctbal") < 1000, "F").when(F.col("c_acctbal") < 5000, "O").otherwise("P").alias("host"),
        (F.col("c_custkey") % 400).alias("path"),
        (F.col("c_nationkey") % 5 + 1).cast("string").alias("method"),
    )
    return matching.service_flows(calls, endpoints)


def event_flows(m):
    ends = m.raw("events").select(
        F.col("event_type").alias("kind"),
        (F.col("event_id") % 50).alias("topic"),
        F.when(F.col("value") > 10, "producer").otherwise("consumer").alias("side"),
        F.col("user_id").alias("file"),
    )
    return matching.event_flows(ends)


def schema_uses(m):
    columns = m.raw("part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("column")).filter("name < 'Brand#5'")
    uses = m.raw("part").join(m.raw("lineitem"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("name"), F.concat("p_type", F.when(F.col("l_linenumber") == 7, "_x").otherwise("")).alias("column")
    )
    return matching.unknown_uses(uses.distinct(), columns.distinct())


def conformance(m):
    """Declared fields (parts) against what suppliers deliver: missing, type or required."""
    declared = m.nodes.select(F.col("id").alias("field"), (F.col("lines") % 9).alias("type"), (F.col("lines") > 25).alias("required"))
    given = m.raw("lineitem").groupBy(F.col("l_partkey").alias("field")).agg(
        (F.max(F.round(F.col("l_tax") * 100)) + 0).cast("long").alias("found"), F.count_if(F.col("l_returnflag") == "N").alias("gaps")
    ).filter("gaps < 15")
    kind = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("found") != F.col("type"), "type")
        .when(F.col("required") & (F.col("gaps") > 10), "required")
    )
    return declared.join(given, "field", "left").select("field", kind.alias("kind")).filter("kind is not null")


def boundaries(m):
    """Datasets that cross units, governed or not, with writers and readers."""
    writers = m.data_edges.filter("access = 'writes'").groupBy("dataset").agg(
        F.count_distinct("unit").alias("writers"), F.min("unit").alias("writer")
    )
    readers = m.data_edges.filter("access = 'reads'").select("dataset", "unit").distinct()
    # A reader crosses when some writer is of another unit: always where there are two.
    crosses = (F.col("writers") > 1) | (F.col("unit") != F.col("writer"))
    crossing = readers.join(writers, "dataset").filter(crosses).groupBy("dataset", "writers").agg(
        F.count(F.lit(1)).alias("readers")
    )
    governed = m.contracts.withColumn("governed", F.lit(True))
    return crossing.join(governed, "dataset", "left").fillna({"governed": False})


def undeclared(m):
    used = package_imports(m).select("package").distinct()
    declared = suppliers(m).filter("repository < 20").select("package")
    return used.join(declared, "package", "left_anti")


RULES = [("no-spec", "src/**", "src/spec/**"), ("no-red", "tests/**", "**/red/*"), ("all", "src/blue/**", "tests/*/*")]


def path_edges(m):
    start = m.nodes.select(F.col("id").alias("s"), F.col("path").alias("source"))
    end = m.nodes.select(F.col("id").alias("t"), F.col("path").alias("target"))
    edges = m.edges.select(F.col("source").alias("s"), F.col("target").alias("t"))
    return edges.join(start, "s").join(end, "t")


def rule_violations(m):
    rules = m.spark.createDataFrame(RULES, "rule string, from_glob string, to_glob string")
    found = matching.rule_violations(path_edges(m), rules)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("first_source"))


RULES_SQL = " union all ".join(
    f"select '{r}' as rule, source from e where regexp_matches(source, '{paths.glob_pattern(a)}') "
    f"and regexp_matches(target, '{paths.glob_pattern(b)}')"
    for r, a, b in RULES
)


def string_edges(m):
    reads = m.raw("events").select((F.col("event_id") % 700).alias("key"), F.col("user_id").alias("reader")).distinct()
    declared = m.raw("orders").filter("o_orderkey < 650 and o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("declared_in")
    )
    return matching.string_edges(reads, declared)


def route_conformance(m):
    path = F.concat(F.lit("/"), F.col("p_type"), F.when(F.col("p_size") % 3 == 0, "/{id}").otherwise("/"), F.col("p_brand"))
    operations = m.raw("part").filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("operation"), F.lit("GET").alias("method"), path.alias("path")
    )
    code = F.when(F.col("p_size") % 2 == 0, F.regexp_replace(path, r"\{id\}", ":key")).otherwise(path)
    mounted = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/api"), code)).otherwise(code)
    routes = m.raw("part").filter("p_partkey % 7 = 0").select(
        F.col("p_partkey").alias("route"), F.lit("GET").alias("method"), mounted.alias("path")
    )
    return matching.route_conformance(operations, routes)


def spans(m):
    """Changed lines (orders of 2001) within spans of a part's orders."""
    lines = m.raw("lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("line"), "l_quantity")
    ranges = lines.filter("l_quantity >= 49").select(
        "file", F.col("line").alias("start"), (F.col("line") + 400).alias("end")
    ).distinct()
    changed = lines.filter("l_quantity <= 2").select("file", "line").distinct()
    return matching.spans_touched(changed, ranges, 400)


def owners(m):
    """Owner of each dataset: its contract, else its one writing unit, else nobody."""
    writers = m.data_edges.filter("access = 'writes'").groupBy("dataset").agg(F.min("unit").alias("unit"))
    contract = m.contracts.withColumn("contract", F.lit("contract"))
    rows = m.nodes.select(F.col("id").alias("dataset")).join(contract, "dataset", "left").join(writers, "dataset", "left")
    owner = F.coalesce("contract", F.when(F.col("unit").isNotNull(), F.concat(F.lit("unit-"), F.col("unit").cast("string"))), F.lit("none"))
    return rows.select("dataset", owner.alias("owner"))


# ---------------------------------------------------------------- differences


def revision(m, low, high):
    """Fields of parts as orders of one half of the keys declare them."""
    rows = m.raw("lineitem").filter(f"l_orderkey % 2 = {low} and l_partkey % 11 <> {high}")
    return rows.groupBy(F.col("l_partkey").alias("id")).agg(
        F.element_at(F.array(*(F.lit(t) for t in ("smallint", "integer", "bigint"))), (F.count(F.lit(1)) % 3 + 1).cast("int")).alias("type"),
        (F.max("l_quantity") > 47).alias("required"),
        (F.min("l_quantity") < 3).alias("nullable"),
        F.when(F.min("l_tax") > 0, F.min("l_tax").cast("string")).alias("default"),
    )


def graph_diff(m):
    heavy = m.edge_rows.filter("kind <> 'call' and source <> target").select("source", "target")
    return diffs.presence(m.edges, heavy.distinct(), ["source", "target"])


def contract_diff(m):
    found = diffs.changes(revision(m, 0, 3), revision(m, 1, 5), ["id"], ["type", "required"])
    return found.select("id", "change", diffs.field_severity().alias("severity"), diffs.field_compatibility().alias("compatibility"))


def schema_diff(m):
    found = diffs.changes(revision(m, 0, 3), revision(m, 1, 5), ["id"], ["type", "nullable", "default"])
    return found.select("id", "change", diffs.column_compatibility().alias("verdict"))


def function_deltas(m):
    before, after = m.functions.filter("name % 2 = 0"), m.functions.filter("name % 2 = 1")
    return diffs.deltas(before, after, ["file"], "decisions")


def change_totals(m):
    rows = function_deltas(m)
    return rows.agg(
        F.sum("before").alias("before"),
        F.sum("after").alias("after"),
        F.sum(F.greatest("delta", F.lit(0))).alias("added"),
        F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("removed"),
    )


def baseline(m):
    findings = m.functions.filter("decisions >= 10").select("file", "name").distinct()
    known = m.functions.filter("loops = 1").select("file", "name")
    return diffs.without_baseline(findings, known, ["file", "name"])


def set_algebra(m):
    a, b = m.edges.select(F.col("source").alias("id")).distinct(), m.edges.select(F.col("target").alias("id")).distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, part in parts.items():
        row = part.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total")).withColumn("operation", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def probes(m):
    """The data probes that precede a schema migration."""
    lines, orders = m.raw("lineitem"), m.raw("orders")
    found = [
        diffs.probe(orders, "add-not-null-column", "true"),
        diffs.probe(m.raw("events"), "set-not-null", "value is null"),
        diffs.unique_probe(lines, "add-unique", ["l_orderkey", "l_linenumber"]),
        diffs.unique_probe(orders, "add-primary-key", ["o_orderkey"]),
        diffs.foreign_key_probe(lines, "add-foreign-key", "l_orderkey", orders, "o_orderkey"),
        diffs.probe(lines, "add-check", "not (l_discount between 0 and 0.08)"),
        diffs.probe(m.raw("documents"), "drop-column", "text is not null"),
        diffs.probe(m.raw("documents"), "shorten-text", "length(text) > 5000"),
        diffs.probe(lines, "narrow-integer", "l_orderkey not between -32768 and 32767"),
        diffs.probe(m.raw("part"), "text-to-integer", r"not (p_brand rlike '^[+-]?[0-9]+$')"),
        diffs.probe(orders, "to-numeric", "abs(o_totalprice) >= 100000"),
    ]
    out = found[0]
    for row in found[1:]:
        out = out.unionByName(row)
    return out


_REVISION = """(select l_partkey as id, ['smallint', 'integer', 'bigint'][count(*) % 3 + 1] as type,
  max(l_quantity) > 47 as required, min(l_quantity) < 3 as nullable,
  case when min(l_tax) > 0 then cast(min(l_tax) as varchar) end as "default"
  from lineitem where l_orderkey % 2 = {} and l_partkey % 11 <> {} group by 1)"""
_BOTH = f"with o as {_REVISION.format(0, 3)}, n as {_REVISION.format(1, 5)}"
_WIDER = """(list_position(['tinyint', 'smallint', 'integer', 'bigint'], n.type)
  > list_position(['tinyint', 'smallint', 'integer', 'bigint'], o.type))"""
_DELTAS = """, a as (select file, sum(decisions) as before from functions where name % 2 = 0 group by 1),
  b as (select file, sum(decisions) as after from functions where name % 2 = 1 group by 1),
  d as (select coalesce(a.file, b.file) as file, cast(coalesce(before, 0) as bigint) as before,
    cast(coalesce(after, 0) as bigint) as after,
    cast(coalesce(after, 0) - coalesce(before, 0) as bigint) as delta from a full join b on a.file = b.file
    where coalesce(after, 0) <> coalesce(before, 0))"""

QUERIES = {
    "j01_import_resolution": (
        resolved,
        with_tables("nodes edges", """, i as (select distinct s.path as file,
            '../../src/x/../' || regexp_replace(regexp_replace(t.path, '\\.ts$', ''), '^src/', '') as specifier,
            regexp_replace(t.path, '\\.ts$', '') as base
            from edges join nodes s on s.id = source join nodes t on t.id = target
            where s.path like 'src/%/%' and t.path like 'src/%' and s.path not like 'src/spec/%'),
          k as (select distinct path from nodes where lines % 3 > 0),
          f as (select file, specifier, case when length(file) - length(replace(file, '/', '')) = 2 then base
            else 'src/' || base end as base from i)
          select file, specifier, k.path as target, case when k.path is not null then 'extension' end as resolution
          from f left join k on k.path = f.base || '.ts'"""),
    ),
    "j03_package_flows": (
        lambda m: matching.package_flows(suppliers(m), package_imports(m)),
        """select c_nationkey::bigint as source, s_nationkey::bigint as target, l_suppkey as package,
            count(distinct o_custkey) as files
          from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
          join supplier on s_suppkey = l_suppkey where c_nationkey <> s_nationkey group by 1, 2, 3""",
    ),
    "j04_service_flows": (
        service_flows,
        """with c as (select o_orderkey as call, o_orderstatus as host, o_custkey % 400 as path,
            case when o_orderkey % 3 > 0 then substr(o_orderpriority, 1, 1) end as method from orders),
          e as (select c_custkey as endpoint, case when c_acctbal < 1000 then 'F' when c_acctbal < 5000 then 'O' else 'P' end
            as host, c_custkey % 400 as path, cast(c_nationkey % 5 + 1 as varchar) as method,
            count(*) over (partition by host, path) as n from customer)
          select call, endpoint from c join e using (host, path) where c.method = e.method or (c.method is null and n = 1)""",
    ),
    "j05_event_flows": (
        event_flows,
        """select event_type as kind, event_id % 50 as topic, count(distinct case when value > 10 then user_id end) as producers,
          count(distinct case when value <= 10 then user_id end) as consumers from events group by 1, 2""",
    ),
    "j06_unknown_uses": (
        schema_uses,
        """with c as (select distinct p_brand as name, p_type as "column" from part where p_brand < 'Brand#5'),
          u as (select distinct p_brand as name, p_type || case when l_linenumber = 7 then '_x' else '' end as "column"
            from part join lineitem on l_partkey = p_partkey)
          select distinct 'unknown-table' as kind, name, cast(null as varchar) as "column" from u
            where name not in (select name from c) union all
          select 'unknown-column', name, "column" from u where name in (select name from c)
            and not exists (select 1 from c where c.name = u.name and c."column" = u."column")""",
    ),
    "j07_conformance": (
        conformance,
        with_tables("nodes", """, g as (select l_partkey, cast(max(round(l_tax * 100)) as bigint) as found,
            count(*) filter (l_returnflag = 'N') as gaps from lineitem group by 1 having gaps < 15),
          r as (select id as field, case when found is null then 'missing' when found <> lines % 9 then 'type'
            when lines > 25 and gaps > 10 then 'required' end as kind from nodes left join g on l_partkey = id)
          select field, kind from r where kind is not null"""),
    ),
    "j08_boundaries": (
        boundaries,
        with_tables("data_edges contracts", """, w as (select dataset, count(distinct unit) as writers, min(unit) as writer
            from data_edges where access = 'writes' group by 1),
          r as (select distinct dataset, unit from data_edges where access = 'reads'),
          c as (select distinct r.dataset, r.unit from r join data_edges d on d.access = 'writes' and d.dataset = r.dataset and d.unit <> r.unit)
          select c.dataset, writers, count(*) as readers, c.dataset in (select dataset from contracts) as governed
          from c join w using (dataset) group by 1, 2"""),
    ),
    "j10_undeclared_packages": (
        undeclared,
        """select distinct l_suppkey as package from lineitem join orders on l_orderkey = o_orderkey
          join customer on o_custkey = c_custkey
          where l_suppkey not in (select s_suppkey from supplier where s_nationkey < 20)""",
    ),
    "j11_rule_violations": (
        rule_violations,
        with_tables("nodes edges", f""", e as (select s.path as source, t.path as target from edges x
            join nodes s on s.id = x.source join nodes t on t.id = x.target)
          select rule, count(*) as n, min(source) as first_source from ({RULES_SQL}) r group by 1"""),
    ),
    "j12_string_edges": (
        string_edges,
        """with r as (select distinct event_id % 700 as key, user_id as reader from events),
          d as (select o_orderkey as key, o_custkey as declared_in from orders where o_orderkey < 650 and o_orderkey % 2 = 0),
          n as (select key, count(*) as readers from r group by 1)
          select distinct r.key, reader, declared_in from r join n using (key) left join d on d.key = r.key
          where declared_in is not null or readers >= 2""",
    ),
    "j13_route_conformance": (
        route_conformance,
        """with p as (select *, '/' || p_type || case when p_size % 3 = 0 then '/{id}' else '/' end || p_brand as path from part),
          o as (select p_partkey as operation, path from p where p_partkey % 2 = 0),
          r as (select p_partkey as route, case when p_partkey % 3 = 0 then '/api' else '' end
            || case when p_size % 2 = 0 then replace(path, '{id}', ':key') else path end as path from p where p_partkey % 7 = 0),
          k1 as (select path, min(route) as route from r group by 1),
          m1 as (select operation, k1.route, path from o join k1 using (path)),
          o2 as (select operation, regexp_replace(path, '\\{[^}]*\\}|:[A-Za-z_]+', '{}', 'g') as shape from o
            where operation not in (select operation from m1)),
          r2 as (select route, regexp_replace(path, '\\{[^}]*\\}|:[A-Za-z_]+', '{}', 'g') as shape from r
            where path not in (select path from m1)),
          k2 as (select shape, min(route) as route from r2 group by 1),
          m2 as (select operation, k2.route, shape from o2 join k2 using (shape)),
          o3 as (select * from o2 where operation not in (select operation from m2)),
          r3 as (select * from r2 where shape not in (select shape from m2)),
          q3 as (select operation, route from o3 join r3 on r3.shape = '/api' || o3.shape),
          m3 as (select * from q3 where (select count(*) from q3) > 0
            and operation in (select operation from q3 group by 1 having count(*) = 1)
            and route in (select route from q3 group by 1 having count(*) = 1))
          select operation, route, 'exact' as via from m1 union all
          select operation, route, 'parameters' from m2 union all
          select operation, route, 'prefix' from m3 union all
          select operation, null, 'unimplemented' from o3 where operation not in (select operation from m3) union all
          select null, route, 'undocumented' from r3 where route not in (select route from m3)""",
    ),
    "j16_span_join": (
        spans,
        """with r as (select distinct l_partkey as file, l_orderkey as start, l_orderkey + 400 as "end" from lineitem
            where l_quantity >= 49),
          c as (select distinct l_partkey as file, l_orderkey as line from lineitem where l_quantity <= 2)
          select c.file, line, start, "end" from c join r on r.file = c.file and line between start and "end" """,
    ),
    "j18_longest_prefix": (
        region_units,
        with_tables("nodes", """, u as (select case when path = 'tests/small/ring.ts' then path
            when path like 'src/spec/blue/%' then 'src/spec/blue' when path like 'src/red/%' then 'src/red'
            when path like 'src/%' then 'src' else '.' end as unit, id from nodes)
          select unit, count(*) as files, min(id) as first_id from u group by 1"""),
    ),
    "j21_dataset_owner": (
        owners,
        with_tables("data_edges contracts", """, w as (select dataset, min(unit) as unit from data_edges
            where access = 'writes' group by 1)
          select p_partkey as dataset, case when p_partkey in (select dataset from contracts) then 'contract'
            when unit is not null then 'unit-' || unit else 'none' end as owner
          from part left join w on dataset = p_partkey"""),
    ),
    "d01_graph_diff": (
        graph_diff,
        with_tables("edges edge_rows", """, h as (select distinct source, target from edge_rows
            where kind <> 'call' and source <> target)
          select source, target, 'removed' as change from edges anti join h using (source, target) union all
          select source, target, 'added' from h anti join edges using (source, target)"""),
    ),
    "d03_contract_diff": (
        contract_diff,
        _BOTH + f""" select coalesce(o.id, n.id) as id,
            case when o.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change,
            case when n.id is null then 'breaking' when o.id is not null and o.type <> n.type then 'breaking'
              when o.id is null and n.required then 'breaking' else 'additive' end as severity,
            case when n.id is null then 'breaking' when o.id is null then case when n.required then 'conditional' else 'safe' end
              when o.type <> n.type then case when {_WIDER} then 'conditional' else 'breaking' end
              else 'conditional' end as compatibility
          from o full join n on o.id = n.id
          where o.id is null or n.id is null or o.type <> n.type or o.required <> n.required""",
    ),
    "d05_schema_diff": (
        schema_diff,
        _BOTH + f""" select coalesce(o.id, n.id) as id,
            case when o.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change,
            case when n.id is null then 'breaking'
              when o.id is null then case when not n.nullable and n."default" is null then 'breaking' else 'safe' end
              when o.type <> n.type then case when {_WIDER} then 'conditional' else 'breaking' end
              when o.nullable <> n.nullable then case when n.nullable then 'conditional' else 'breaking' end
              when o."default" is null then 'safe' else 'conditional' end as verdict
          from o full join n on o.id = n.id
          where o.id is null or n.id is null or o.type <> n.type or o.nullable <> n.nullable
            or o."default" is distinct from n."default" """,
    ),
    "d09_function_deltas": (
        function_deltas,
        with_tables("functions", _DELTAS + " select file, before, after, delta from d"),
    ),
    "a12_change_totals": (
        change_totals,
        with_tables("functions", _DELTAS + """ select cast(sum(before) as bigint) as before, cast(sum(after) as bigint) as after,
          cast(sum(greatest(delta, 0)) as bigint) as added, cast(sum(greatest(-delta, 0)) as bigint) as removed from d"""),
    ),
    "d11_baseline": (
        baseline,
        with_tables("functions", """select distinct file, name from functions where decisions >= 10
          and (file, name) not in (select file, name from functions where loops = 1)"""),
    ),
    "d13_set_algebra": (
        set_algebra,
        with_tables("edges", """, a as (select distinct source as id from edges), b as (select distinct target as id from edges)
          select 'union' as operation, count(*) as n, cast(sum(id) as bigint) as total from (select * from a union select * from b) x
          union all select 'intersect', count(*), cast(sum(id) as bigint) from (select * from a intersect select * from b) x
          union all select 'except', count(*), cast(sum(id) as bigint) from (select * from a except select * from b) x"""),
    ),
    "q01_probes": (
        probes,
        """select 'add-not-null-column' as probe, count(*) as violations from orders
          union all select 'set-not-null', count(*) from events where value is null
          union all select 'add-unique', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) x
          union all select 'add-primary-key', count(*) from (select 1 from orders group by o_orderkey having count(*) > 1) x
          union all select 'add-foreign-key', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
          union all select 'add-check', count(*) from lineitem where not (l_discount between 0 and 0.08)
          union all select 'drop-column', count(text) from documents
          union all select 'shorten-text', count(*) from documents where length(text) > 5000
          union all select 'narrow-integer', count(*) from lineitem where l_orderkey not between -32768 and 32767
          union all select 'text-to-integer', count(*) from part where not regexp_matches(p_brand, '^[+-]?[0-9]+$')
          union all select 'to-numeric', count(*) from orders where abs(o_totalprice) >= 100000""",
    ),
}
