"""Findings of round 3: steps whose rows or rounds grew faster than the input, with results worked out by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodegraph.operators import closure, layers, matching, references, scorecard
from lodegraph.sources import ddl, readers, rpc, tokens


def test_cohesion_links_only_fields_that_a_method_joins(spark, monkeypatch):
    wired = [(1, 1, 7), (1, 2, 7), (1, 3, 8), (1, 3, 9), (1, 4, None), (2, 1, 5), (2, 1, 6), (3, None, 4), (4, 9, None)]
    seen, whole = [], closure.components
    monkeypatch.setattr(closure, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    rows = scorecard.cohesion(spark.createDataFrame(wired, "file long, method long, field long")).collect()
    assert {r["file"]: (r["members"], r["clusters"], r["cohesion"]) for r in rows} == {
        1: (7, 3, 67), 2: (3, 1, 100), 3: (1, 1, None), 4: (1, 1, 100)
    }
    assert seen == [2]


def test_files_of_dependencies_are_counted_by_key(spark):
    imports = spark.createDataFrame([("maven", "org.a.x", f) for f in (1, 2, 2, 3)] + [("cargo", "b-c", 9), ("npm", "d", 4)], "ecosystem string, package string, file long")
    wanted = [("maven", "org.a:x"), ("maven", "org.a:y"), ("maven", "org.a.x:z"), ("cargo", "b_c"), ("npm", "e")]
    got = references.dependency_files(imports, spark.createDataFrame(wanted, "ecosystem string, name string")).collect()
    assert {(r["name"], r["files"], r["first_file"]) for r in got} == {("org.a:x", 3, 1), ("org.a:y", 3, 1), ("org.a.x:z", 3, 1), ("b_c", 1, 9)}


def test_more_rules_than_patterns_and_more_patterns_than_expressions(spark, monkeypatch):
    rules = spark.range(30_000).selectExpr("id as ordinal", "concat('^', chr(97 + cast(id % 3 as int)), '/') as pattern", "concat('t', id) as owner")
    files = spark.createDataFrame([("a/x",), ("c/y",), ("d/z",)], "path string")
    want = {("a/x", "t29997"), ("c/y", "t29999")}
    assert {tuple(r) for r in readers.codeowners(files, rules).collect()} == want
    monkeypatch.setattr(readers, "RULE_ROWS", 2)
    assert {tuple(r) for r in readers.codeowners(files, rules).collect()} == want


def test_callers_are_counted_by_template(spark, monkeypatch):
    ends = [(n, "GET", None, "/a/{id}/b") for n in range(50)] + [(90, "POST", "h", "/{x}/b"), (91, "GET", None, "/{x}/b"), (91, "GET", None, "/c/{y}")]
    calls = [(1, "GET", None, "/a/5/b"), (1, None, None, "/a/6/b"), (2, None, None, "/a/7/b"), (3, None, "h", "/c/b"), (4, "GET", None, "/c/b"), (5, "PUT", None, "/a/5/b")]
    seen, pairs = [], references.template_callers
    monkeypatch.setattr(references, "template_callers", lambda e, c: seen.append(e.count()) or pairs(e, c))
    ends = spark.createDataFrame(ends, "endpoint long, method string, host string, path string")
    calls = spark.createDataFrame(calls, "call long, method string, host string, path string")
    got = {r["endpoint"]: r["calls"] for r in references.template_calls(ends, calls).collect()}
    assert got == {**{n: 2 for n in range(50)}, 90: 1, 91: 1}
    assert max(seen) == 4


def test_longest_prefix_does_not_hang_on_the_order_of_rows(spark):
    shuffled = F.udf(lambda _: random.random(), "double").asNondeterministic()
    rows = spark.range(400).selectExpr("concat(if(id % 2 = 0, 'a', 'b'), '/x', id) as path").repartition(4).orderBy(shuffled("path"))
    units = spark.createDataFrame([("a",), ("b",)], "unit string")
    got = matching.longest_prefix(rows, "path", units).collect()
    assert len(got) == 400 and all(r["path"].startswith(r["unit"] + "/") for r in got)


def _copies_of_bow_ties(spark, copies, wide):
    """Copies of: wide nodes -> a cycle of three -> wide nodes, with ids far apart in turns."""
    one = [(n, 500) for n in range(wide)] + [(500, 501), (501, 502), (502, 500)] + [(502, 600 + n) for n in range(wide)]
    return spark.createDataFrame([(s + 1000 * c, t + 1000 * c) for c in range(copies) for s, t in one], "source long, target long")


def test_reach_through_a_hub_is_not_kept_for_each_node(spark, monkeypatch):
    edges, seen, whole = _copies_of_bow_ties(spark, 6, 30), [], closure.ReachBits.sums
    monkeypatch.setattr(closure.ReachBits, "sums", lambda bits, *rest: seen.append(bits.rows.count()) or whole(bits, *rest))
    got = {r["id"]: (r["dependencies"], r["dependents"]) for r in closure.Condensed(edges).counts().collect()}
    assert {v for k, v in got.items() if k % 1000 < 30} == {(33, 0)} and len(got) == 6 * 63
    assert {v for k, v in got.items() if 500 <= k % 1000 < 503} == {(32, 32)} and {v for k, v in got.items() if k % 1000 >= 600} == {(0, 33)}
    assert seen == [2 * 6 * 61]


def _reach(edges):
    """What each node of a list of edges reaches, by distance."""
    out, found = {}, {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
    for start in {x for e in edges for x in e}:
        at, front, steps = {start: 0}, {start}, 0
        while front:
            steps += 1
            front = {t for s in front for t in out.get(s, ())} - set(at)
            at.update(dict.fromkeys(front, steps))
        found[start] = at
    return found


def test_groups_and_marked_nodes_are_counted_as_by_brute_force(spark):
    draw = random.Random(5)
    pairs = {(draw.randrange(60), draw.randrange(60)) for _ in range(75)}
    pairs = sorted((s + c, t + c) for s, t in pairs if s != t for c in (0, 100))
    reach, edges = _reach(pairs), spark.createDataFrame(pairs, "source long, target long")
    groups = {(n % 3, n) for n in reach if n % 5 == 0} | {(7, 999)}
    asked, graph = spark.createDataFrame(sorted(groups), "key long, id long"), closure.Condensed(edges)
    for back in (False, True):
        want = {}
        for key in {k for k, n in groups if n in reach}:
            own = {n for k, n in groups if k == key}
            want[key] = len({n for n in reach if any((m in reach[n]) if back else (n in reach[m]) for m in own)} - own)
        assert {r["key"]: r["reached"] for r in graph.beyond(asked, back).collect()} == want
    marked = sorted(n for n in reach if n % 4 == 0)
    ids = spark.createDataFrame([(n,) for n in marked], "id long")
    assert {r["id"]: r["reached"] for r in graph.counted(ids).collect()} == {n: sum(n in reach[m] for m in marked if m != n) for n in reach}
    near = closure.nearest(edges, ids).filter("seed <> id").groupBy("id").agg(F.min("distance").alias("d")).collect()
    found = {n: [reach[m][n] for m in marked if m != n and n in reach[m]] for n in reach}
    assert {r["id"]: r["d"] for r in near} == {n: min(d) for n, d in found.items() if d}
    both = spark.createDataFrame([(s, t) for s in list(reach)[::3] for t in list(reach)[::4]], "source long, target long")
    left = {(r["source"], r["target"]) for r in closure.unrelated(both, edges).collect()}
    assert left == {(s, t) for s in list(reach)[::3] for t in list(reach)[::4] if t not in reach[s] and s not in reach[t]}


def test_a_route_writes_each_layer_once(spark, monkeypatch):
    edges = spark.createDataFrame([(n, n + 1) for n in range(5)], "source long, target long")
    seen, whole = [], layers.settled
    monkeypatch.setattr(layers, "settled", lambda df: seen.append(1) or whole(df))
    fan_in = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    rows = layers.reading_route(edges, spark.createDataFrame([(0,)], "id long"), fan_in).collect()
    assert {tuple(r) for r in rows} == {(0, 0, None, 0)} | {(n, n, n - 1, 0) for n in range(1, 6)}
    assert len(seen) == 2


def test_statements_of_interfaces_are_rows_and_not_their_tokens(spark, monkeypatch):
    text = """// a; b { c
package a.b ; /* { */ option (x) = { s: "};{" t: 'it' };
message M { // one
  string
    f = 1 [(y) = {min: 3}]; oneof o { int64 g = 2; } { }
  map<string, N.P> h = 4; message N { repeated P p = 5 [deprecated = true]; }
}
service S { rpc Do(M) returns (M); rpc Re (stream .a.b.M.N)
 returns (N) { option (h) = { additional { get: "/x" } post : "/y;z" }; } }
"""
    wide, whole = [], rpc.outline.ancestry
    monkeypatch.setattr(rpc.outline, "ancestry", lambda rows: wide.append(rows.count()) or whole(rows))
    texts = spark.createDataFrame([("p.proto", text), ("q.proto", "service T {" + "rpc Go(M) returns (M);" * 50 + "}")], "file string, content string")
    assert {tuple(r)[1:] for r in rpc.proto_fields(texts).collect()} == {
        ("a.b.M", "f", "string", True, 1), ("a.b.M", "g", "int64", True, 2), ("a.b.M", "h", "map<string,N.P>", False, 4), ("a.b.M.N", "p", "P", False, 5)
    }
    assert wide == [15]
    got = rpc.grpc_endpoints(texts).filter("file = 'p.proto'").collect()
    assert {(r["line"], r["method"], r["path"], r["streaming"], r["request"], r["response"]) for r in got} == {
        (8, "RPC", "/a.b.S/Do", None, "a.b.M", "a.b.M"), (8, "RPC", "/a.b.S/Re", "client-streaming", "a.b.M.N", "N"),
        (8, "GET", "/x", None, "a.b.M.N", "N"),
    }


def test_clauses_of_scripts_are_rows_without_a_row_for_each_token(spark):
    text = "-- c;\nCREATE TABLE \"A b\" (x int, y numeric(10, 2) default ';') with (q);\n;; drop table a,\nb; create"
    rows = ddl.clauses(spark.createDataFrame([("r", "V1.sql", text), ("r", "V2.sql", None), ("r", "V3.sql", "-- ;")], "repository string, file string, content string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert sorted((r["statement"], r["clause"], r["in_table"], r["line"], " ".join(r["t"])) for r in rows.collect()) == [
        (0, 0, False, 2, "create table a b"), (0, 0, True, 2, "( x int"),
        (0, 1, False, 2, ") with )"), (0, 1, True, 2, "y numeric ( 10 , 2 ) default ';' ( q"),
        (3, 0, False, 3, "drop table a"), (3, 1, False, 4, "b"), (4, 0, False, 4, "create"),
    ]


def test_siblings_of_texts_take_no_window_and_survive_small_batches(spark):
    code = "class A { int f(int a, B<C, D> b) { while (a) { g(b.c, 1); } return h(); } }\n"
    texts = spark.createDataFrame([(f"{n}.java", "java", code * (1 + n % 3)) for n in range(9)] + [("s.ts", "typescript", "const q = (x, y) => { if (x) { z(); } };")], "file string, language string, content string")
    rows = tokens.text_siblings(texts)
    assert "Window" not in tokens.siblings(spark.createDataFrame([], tokens.ROWS))._jdf.queryExecution().executedPlan().toString()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        found = tokens.functions(rows)
        assert rows.exceptAll(tokens.siblings(tokens.stream(texts))).count() == 0 and rows.count() == tokens.siblings(tokens.stream(texts)).count()
        got = {(r["file"], r["name"], r["line"]): (r["parameters"], r["loops"], r["nesting"], r["statements"]) for r in tokens.metrics(found, tokens.placed(rows, found)).collect()}
        called = {(r["file"], r["body"] >= 0, r["callee"], r["receiver"], r["loop_depth"]) for r in tokens.calls(tokens.placed(rows, found)).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {**{(f"{n}.java", "f", 1 + i): (2, 1, 1, 3) for n in range(9) for i in range(1 + n % 3)}, ("s.ts", "q", 1): (2, 0, 1, 2)}
    assert called == {(f"{n}.java", True, c, None, d) for n in range(9) for c, d in (("g", 1), ("h", 0))} | {("s.ts", True, "z", None, 0)} | {(f"{n}.java", False, "f", None, 0) for n in range(9)}
