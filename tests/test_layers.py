"""Routes, bands, layers, communities, references and simulations on graphs worked out by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodegraph.operators import closure, interfaces, layers, references, scorecard, text


def edges_of(spark, pairs):
    return spark.createDataFrame([tuple(p) for p in pairs.split()], "source string, target string")


def test_cycles_and_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(closure, "SMALL_EDGES", 3)
    rng = random.Random(4)
    pairs = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(48)} | {(i, i + 1) for i in range(50, 60)} | {(60, 50), (70, 71), (71, 70)}
    edges = spark.createDataFrame(list(pairs), "source long, target long")
    nodes = {x for p in pairs for x in p}

    def reached(start, both):
        seen, front = set(), {start}
        while front:
            front = {t for s, t in pairs if s in front} | ({s for s, t in pairs if t in front} if both else set())
            front -= seen
            seen |= front
        return seen

    forward = {n: reached(n, False) for n in nodes}
    want = {}
    for n in nodes:
        group = {o for o in forward[n] if n in forward[o]} | {n}
        if len(group) > 1:
            want[n] = min(group)
    assert {r["id"]: r["cycle"] for r in closure.cycles(edges).collect()} == want
    linked = {n for s, t in pairs if s != t for n in (s, t)}
    assert {r["id"]: r["component"] for r in closure.components(edges).collect()} == {n: min(reached(n, True) | {n}) for n in linked}
    counts = {r["id"]: r["dependencies"] for r in closure.reach_counts(spark.createDataFrame([(n,) for n in nodes], "id long"), edges).collect()}
    assert counts == {n: len(forward[n] - {n}) for n in nodes}


def test_reading_route_and_order(spark):
    edges = edges_of(spark, "ab ac ad be ce ed de")
    fan_in = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    route = layers.reading_route(edges, spark.createDataFrame([("a",)], "id string"), fan_in, 2)
    got = {r["id"]: (r["depth"], r["parent"], r["entry"]) for r in route.collect()}
    assert got == {"a": (0, None, "a"), "d": (1, "a", "a"), "b": (1, "a", "a"), "e": (2, "b", "a")}
    order = [r["id"] for r in layers.reading_order(route, edges).orderBy("place").collect()]
    assert order == ["a", "b", "d", "e"]


def test_depth_bands_and_layers(spark):
    rows = spark.createDataFrame([("u", d) for d in (0, 0, 0, 1, 2, 2, 3, 4, 5)], "unit string, depth long")
    assert {r["depth"]: r["band"] for r in layers.depth_bands(rows).collect()} == {0: 1, 1: 2, 2: 2, 3: 3, 4: 3, 5: 3}
    files = [("u", "a", 0, "data"), ("u", "b", 3, "api"), ("u", "c", 1, None), ("v", "d", 2, None), ("w", "e", 0, "x"), ("w", "f", 1, None), ("w", "g", 2, None)]
    got = {r["id"]: r["layer"] for r in layers.layers(spark.createDataFrame(files, "unit string, id string, depth long, token string")).collect()}
    assert got == {"a": "data", "b": "api", "c": "data", "d": "layer 2", "e": "x", "f": "band 1", "g": "band 2"}


def test_communities(spark):
    links = edges_of(spark, "ab bc ac de ef df cd").withColumn("unit", F.lit("u"))
    got = {r["id"]: r["community"] for r in layers.communities(links).collect()}
    assert got == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d")}


def test_depths_of_a_chain_and_a_ring(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 300) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(30)], "source long, target long")
    assert closure.cycles(ring).count() == 300
    depths = {r["id"]: r["depth"] for r in closure.depths(ring).collect()}
    assert depths[1000] == 30 and depths[0] == 0


def test_what_if(spark):
    edges = spark.createDataFrame([("s/a", "s/b"), ("s/b", "s/a"), ("s/b", "t/c")], "source string, target string")
    ops = [("move", "s", "r/s"), ("cut", "r/s/b", "r/s/a"), ("add", "t/c", "r/s/b")]
    got = {r["measure"]: r["n"] for r in interfaces.simulate(edges, ops).collect()}
    assert got == {"edges-added": 1, "edges-removed": 1, "cycles-added": 1, "cycles-removed": 1}


def test_references(spark):
    templates = spark.createDataFrame([(1, "GET", None, "/a/{id}"), (2, "POST", "h", "/:x/b")], "endpoint long, method string, host string, path string")
    calls = spark.createDataFrame([(1, None, None, "/a/b"), (2, "GET", "h", "/a/7"), (3, "POST", "h", "/q/b"), (4, "GET", None, "/a/b/c")], "call long, method string, host string, path string")
    got = {(r["endpoint"], r["call"]) for r in references.template_callers(templates, calls).collect()}
    assert got == {(1, 1), (2, 1), (2, 3)}
    row = spark.range(1).select(
        scorecard.guard_status(F.array(F.lit("JwtAuth"), F.lit("permitAll"))).alias("a"),
        scorecard.guard_status(F.array(F.lit("JwtAuth"))).alias("b"),
        scorecard.guard_status(F.array(F.lit("log"))).alias("c"),
    ).first()
    assert tuple(row) == ("anonymous", "guarded", "none-recorded")


def test_clones_and_module_depth(spark):
    same = "function f(a) { return a + 1; } // note\n" * 3
    rows = spark.createDataFrame([("x", same), ("y", same.replace("f(", "g(").replace("1", "22")), ("z", "let x = null;")], "file string, text string")
    assert [(r["files"], r["first_file"]) for r in text.clone_groups(rows, 10).collect()] == [(2, "x")]
    depth = spark.createDataFrame([("p", "export { a } from './a';"), ("q", "\n".join(["const v = 1;"] * 40) + "\nexport const b = 2;"), ("r", None)], "file string, text string")
    assert {r["file"]: r["signal"] for r in text.module_depth(depth).collect()} == {"p": "pass-through", "q": "ok"}
