"""Round trips of the readers: the tables write texts, readers read them, and the rows must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.adapters.star_schema import with_tables
from lodegraph.sources import manifests, readers


def _texts(rows, key, line, head="", tail="", between=""):
    """file, content: the lines (a column, in its order) of each key between head and tail."""
    lines = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), between).alias("body"))
    return lines.select(F.col(key).cast("string").alias("file"), F.concat(F.lit(head) if isinstance(head, str) else head, "body", F.lit(tail)).alias("content"))


def lcov(m):
    rows = m.coverage.filter("file is not null")
    return readers.lcov_lines(_texts(rows, "file", F.expr("concat('DA:', line, ',', hits, '\\n')"), F.concat(F.lit("TN:\nSF:src/f"), "file", F.lit("\n")), "end_of_record\n"))


def cobertura(m):
    rows = m.coverage.filter("file is not null")
    head = F.concat(F.lit('<coverage><class name="C" filename="src/f'), "file", F.lit('"><lines>'))
    return manifests.cobertura(_texts(rows, "file", F.expr("""concat('<line number="', line, '" hits="', hits, '"/>')"""), head, "</lines></class></coverage>"))


def jacoco(m):
    rows = m.coverage.filter("file is not null")
    head = F.concat(F.lit('<report><package name="src"><sourcefile name="f'), "file", F.lit('">'))
    return manifests.jacoco(_texts(rows, "file", F.expr("""concat('<line nr="', line, '" mi="1" ci="', hits, '"/>')"""), head, "</sourcefile></package></report>"))


def coverage_py(m):
    rows = m.coverage.filter("file is not null").groupBy("file").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("hits") > 0, F.col("line")))).cast("array<string>"), ",").alias("yes"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("hits") == 0, F.col("line")))).cast("array<string>"), ",").alias("no"),
    )
    text = F.concat(F.lit('{"files": {"src/f'), "file", F.lit('": {"executed_lines": ['), "yes", F.lit('], "missing_lines": ['), "no", F.lit("]}}}"))
    return manifests.coverage_py(rows.select(F.col("file").cast("string").alias("file"), text.alias("content")))


def git_log(m):
    """The commits of all orders, with the files of each as one line of counts."""
    stats = m.raw("lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).agg(F.sum("l_quantity").cast("long").alias("n"), F.min("l_suppkey").alias("s"))
    line = F.expr("concat(if(s % 9 = 0, '-', string(n)), '\\t', if(s % 9 = 0, '-', string(s)), '\\t', if(s % 5 = 0, concat('src/{old => new}/f', p), concat('src/f', p)), '\\n')")
    lines = stats.groupBy("o").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("body"))
    rows = m.commits.join(lines, F.col("hash") == F.col("o"))
    head = F.concat(F.lit(readers.RECORD), F.concat_ws(readers.FIELD, F.col("hash").cast("string"), F.concat(F.lit("a"), "author"), F.concat(F.col("date").cast("string"), F.lit("T10:00:00Z")), F.lit("work; done")), F.lit("\n\n"))
    return readers.commits(rows.select(F.concat(head, "body").alias("text")))


def npm_lock(m):
    """A lock file for each brand: the package of each part with its version."""
    rows = m.raw("part").selectExpr("p_brand as b", """concat('"', if(p_partkey % 4 = 0, 'node_modules/top/', ''), 'node_modules/', if(p_partkey % 3 = 0, '@s/', ''), 'n', p_partkey,
        '": {"version": "', p_size, '.0.', p_partkey % 7, '"', if(p_partkey % 5 = 0, ', "dev": true', ''), '}') as x""")
    return readers.npm_lock(_texts(rows, "b", F.col("x"), '{"packages": {"": {"name": "root"},', "}}", ","))


def cargo_lock(m):
    rows = m.raw("part").selectExpr("p_brand as b", """concat('[[package]]\\nname = "n', p_partkey, '"\\nversion = "', p_size, '.1"\\n',
        if(p_partkey % 4 = 0, '', 'source = "registry+https://x"\\n'), '\\n') as x""")
    return manifests.cargo_lock(_texts(rows, "b", F.col("x"), "# made\nversion = 3\n\n")).select("file", "name", "version")


def script_links(m):
    """The specifiers of a script for each node: one statement for each of its links."""
    rows = m.edges.filter("source is not null").selectExpr("source", """case target % 4 when 0 then concat('import { a, b } from "./m', target, '";\\n')
        when 1 then concat("const x = require('pk", target, "');\\n") when 2 then concat('export * from "../m', target, '";\\n') else concat('const y = await import("@s/m', target, '/deep");\\n') end as x""")
    found = readers.script_imports(_texts(rows, "source", F.col("x"), "// import 'no'\n", "let z = 1;\n"))
    return found.select("file", "specifier", "relative", F.when(~F.col("relative"), readers.npm_package(F.col("specifier"))).alias("package"))


def python_links(m):
    rows = m.edges.filter("source is not null").selectExpr("source", "if(target % 2 = 0, concat('from .m', target, ' import x\\n'), concat('    import pk.m', target, ' as y\\n')) as x")
    return readers.python_imports(_texts(rows, "source", F.col("x"), "# import no\n")).select("file", "specifier")


_OWNERS = """s_suppkey as ordinal, case s_suppkey % 3 when 0 then '^src/' || substr(s_name, 1, 0) || chr(97 + cast(s_suppkey % 26 as int))
    when 1 then '_spec[.]ts$' else '/' || chr(97 + cast(s_suppkey % 20 as int)) || '[a-z]*/' end as pattern, 'team' || s_nationkey as owner"""


def owners(m):
    """The owner of each path: the last of the suppliers' rules that matches."""
    from lodegraph.plans.token_queries import _split

    return readers.codeowners(m.nodes.select("path").distinct(), m.raw("supplier").selectExpr(*_split(_OWNERS)))


QUERIES = {
    "s16_lcov": (lcov, with_tables("coverage", "select 'src/f' || file as source, line, hits from coverage where file is not null")),
    "s16_cobertura": (cobertura, with_tables("coverage", "select 'src/f' || file as source, line, hits from coverage where file is not null")),
    "s16_jacoco": (jacoco, with_tables("coverage", "select 'src/f' || file as source, line, hits from coverage where file is not null")),
    "s16_coverage_py": (coverage_py, with_tables("coverage", "select 'src/f' || file as source, line, least(hits, 1) as hits from coverage where file is not null")),
    "s14_git_log": (
        git_log,
        with_tables("commits", """, s as (select l_orderkey as o, l_partkey as p, cast(sum(l_quantity) as bigint) as n, min(l_suppkey) as s from lineitem group by 1, 2)
        select hash::varchar as hash, 'a' || author as author, date, 'work; done' as subject, case when s % 5 = 0 then 'src/new/f' else 'src/f' end || p as path,
          case when s % 9 <> 0 then cast(n as int) end as insertions, case when s % 9 <> 0 then cast(s as int) end as deletions from commits join s on o = hash"""),
    ),
    "s12_npm_lock": (
        npm_lock,
        """select p_brand as file, 'npm' as ecosystem, case when p_partkey % 3 = 0 then '@s/' else '' end || 'n' || p_partkey as name,
          p_size || '.0.' || (p_partkey % 7) as version, p_partkey % 5 = 0 as dev from part""",
    ),
    "s12_cargo_lock": (cargo_lock, "select p_brand as file, 'n' || p_partkey as name, p_size || '.1' as version from part where p_partkey % 4 <> 0"),
    "s05_script_imports": (
        script_links,
        with_tables("edges", """select source::varchar as file, case target % 4 when 0 then './m' || target when 1 then 'pk' || target when 2 then '../m' || target else '@s/m' || target || '/deep' end as specifier,
          target % 4 in (0, 2) as relative, case target % 4 when 1 then 'pk' || target when 3 then '@s/m' || target end as package from edges"""),
    ),
    "s06_python_imports": (
        python_links,
        with_tables("edges", "select source::varchar as file, case when target % 2 = 0 then '.m' || target else 'pk.m' || target end as specifier from edges"),
    ),
    "j21_code_owners": (
        owners,
        with_tables("nodes", f""", r as (select {_OWNERS} from supplier), f as (select distinct path from nodes)
        select path, arg_max(owner, ordinal) as owner from f join r on regexp_matches(path, pattern) group by path"""),
    ),
}
