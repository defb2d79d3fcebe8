"""Findings of round 4: results that differed from SQL, caps, and steps that held or wrote a row for each token."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lodegraph.adapters.star_schema import Model
from lodegraph.functions import tables
from lodegraph.operators import closure, layers, retention
from lodegraph.plans import token_queries
from lodegraph.sources import bodies, outline, products, resolvers, rpc, tokens


def test_marked_nodes_are_counted_within_a_number_of_steps(spark):
    draw = random.Random(8)
    pairs = {(draw.randrange(80), draw.randrange(80)) for _ in range(95)} | {(n, n + 1) for n in range(200, 270)} | {(n, 200) for n in range(300, 330)} | {(200, n) for n in range(400, 430)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    edges, out = spark.createDataFrame(pairs, "source long, target long"), {}
    for s, t in pairs:
        out.setdefault(s, []).append(t)
    nodes = {n for p in pairs for n in p}
    marked = sorted(n for n in nodes if n % 3 == 0)
    for steps in (12, 3):
        want, least = {}, {}
        for m in marked:
            at, front = {m: 0}, [m]
            for d in range(1, steps + 1):
                front = [t for s in front for t in out.get(s, ()) if t not in at and not at.update({t: d})]
            for n, d in at.items():
                if n != m:
                    want[n], least[n] = want.get(n, 0) + 1, min(d, least.get(n, d))
        ids = spark.createDataFrame([(m,) for m in marked], "id long")
        assert {r["id"]: r["reached"] for r in closure.counted_within(edges, ids, steps).collect()} == want
        near = closure.nearest(edges, ids, steps=steps).filter("seed <> id").groupBy("id").agg(F.min("distance").alias("d"))
        assert {r["id"]: r["d"] for r in near.collect()} == least
    assert closure.strides(edges, 60)[1] < 60 and closure.strides(edges, 60, 0)[1] == 60


def test_a_route_admits_every_candidate_of_a_layer(spark):
    pairs = [(0, n) for n in range(1, 61)] + [(n, 100 + n) for n in range(1, 61)]
    edges = spark.createDataFrame(pairs, "source long, target long")
    route = layers.reading_route(edges, spark.createDataFrame([(0,)], "id long"))
    assert {(r["id"], r["depth"], r["parent"]) for r in route.collect()} == {(0, 0, None)} | {(n, 1, 0) for n in range(1, 61)} | {(100 + n, 2, n) for n in range(1, 61)}
    assert layers.reading_order(route, edges).count() == 121


TEXTS = [
    ("a.java", "java", "package p;\nclass A extends B { // x {\n private final RenderEngine e; List<String> l = new L(); private volatile Map<K, V> m;\n void checkReady(int a, M<B, C> b) throws E { while (a) { l.add(1); if (b) { this.e.close(); } }\n model.loadModel(); f.readAllBytes(); Arrays.copyOf(f.readAllBytes()); }\n int g() { return g() ? 1 : 2; } class In { int size; } }\n"),
    ("b.kt", "kotlin", "class Box(val a: Int) {\n val inner: SocketPool = x()\n var ls: ClickListener = y\n fun work(p: Int): Int { when (p) { 1 -> { z.contains(q); } }\n for (i in p) { q.contains(i); q.sort() } } }"),
    ("c.ts", "typescript", "export class C { @In() private box: In.Box<T>; n: number; static work(a: Map<X, Y>, b): void { do { a.set(b) } while (x); const q = async (x, y) => { if (x && y) { q(); } }; } }\nfunction top() { try { top(); } catch (e) { } finally { } }"),
    ("d.py", "python", "# c\nimport x\nclass D:\n    a: Stream = 1\n    def f(self, b,\n          c):\n        '''doc\n        more'''\n        for i in b:\n            if i and c:\n                self.f(i)\n                b.find(i)\n        while a: g()\n\n    def g(self):\n        return [\n  1]\nx = 1\n"),
    ("e.rs", "rust", "pub struct S { r: Reader, pub n: u8 }\nimpl T for S { pub fn run(&self, a: u8) -> Result<A, B> { match a { 1 => { loop { self.run(a); } } _ => () } } }"),
    ("f.cs", "csharp", "#if X\nclass F : G { public Cursor Cur { get; set; } int H(int a) { lock (a) { foreach (var x in y) { y.Sort(); } } } }"),
    ("g.cpp", "cpp", "enum class Color { Red };\nclass V { Socket s; public: int f(int a) const { return s->f(a); } };"),
    ("h.py", "python", ""), ("i.py", "python", "\n\n"), ("j.java", "java", None), ("k.java", "java", "// none\n"),
]


def test_functions_and_signals_of_whole_texts_are_those_of_token_rows(spark):
    texts = spark.createDataFrame(TEXTS, "file string, language string, content string").coalesce(1)
    rows = tables.settled(tokens.siblings(tokens.stream(texts)))
    assert sorted(map(str, tokens.text_siblings(texts).collect())) == sorted(map(str, rows.collect()))
    found, types = tables.settled(tokens.functions(rows)), tokens.types(rows)
    placed = tables.settled(tokens.placed(rows, found))
    want = tokens.metrics(found, placed)
    got = bodies.metrics(texts).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    methods = found.select("file", F.col("body_at").alias("body"), "owner", F.col("name").alias("method"))
    calls = tables.settled(tokens.calls(placed).join(methods, ["file", "body"], "left"))
    facts = tables.settled(retention.facts(tokens.fields(rows, types), types.select("file", "name"), calls))
    signals = sorted(map(str, retention.text_signals(texts).collect()))
    assert signals == sorted(map(str, retention.signals(facts, calls).collect())) and len(signals) > 8


def test_metrics_and_signals_write_no_row_for_a_token(spark):
    m = Model(spark, "/root/testdata/sf0.001")
    for rows in (token_queries.function_metrics(m), token_queries.retention_signals(m)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and "MapInArrow" in plan and "Window" not in plan and "Join" not in plan
    sizes = pa.record_batch({"tokens": pa.array([["a"] * n for n in (3, 0, tokens.PIECE + 5, 1, 2)])})
    assert [b.num_rows for b in tokens._slices([sizes])] == [2, 1, 2]


def test_outlines_take_one_pass_over_each_text(spark):
    text = "a:\n  - b: |\n      x: y\n\n      z\n    c: {d: 1, e: \"f\\ng\"}\n  - h\n    i\n---\n- ~: [j, 'k, l']\n-\n  - m # n\n"
    rows = outline.yaml(spark.createDataFrame([("f", text), ("g", None), ("h", "a: 1")], "file string, content string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Aggregate" not in plan
    assert sorted((r["file"], r["at"], r["line"], r["document"], "/".join(r["path"]), r["value"]) for r in rows.collect()) == [
        ("f", 1, 1, 0, "a", None), ("f", 2, 2, 0, "a/[0]", None), ("f", 3, 2, 0, "a/[0]/b", "x: y\n\nz"), ("f", 4, 6, 0, "a/[0]/c", None),
        ("f", 5, 6, 0, "a/[0]/c/d", "1"), ("f", 6, 6, 0, "a/[0]/c/e", "f\ng"), ("f", 7, 7, 0, "a/[1]", "h i"),
        ("f", 8, 10, 1, "[0]", None), ("f", 9, 10, 1, "[0]/[0]", None), ("f", 10, 10, 1, "[0]/[0]/[0]", "j"), ("f", 11, 10, 1, "[0]/[0]/[1]", "k, l"),
        ("f", 12, 11, 1, "[1]", None), ("f", 13, 12, 1, "[1]/[0]", "m"), ("h", 1, 1, 0, "a", "1"),
    ]


def test_ancestry_goes_on_over_batches(spark):
    rows = spark.createDataFrame([(f, n, n % 7 % 4, "n" if n % 3 else None) for f in "ab" for n in range(40)], "file string, at int, level int, name string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(name), []
    for most in ("3", "1000"):
        spark.conf.set(name, most)
        try:
            got.append(sorted((r["file"], r["at"], tuple(r["path"])) for r in outline.ancestry(rows).collect()))
        finally:
            spark.conf.set(name, before)
    assert got[0] == got[1] and len(got[0]) == 80
    assert [p for f, n, p in got[0] if f == "a"][:5] == [("[0]",), ("[0]", "n"), ("[0]", "n", "n"), ("[0]", "n", "n", "[0]"), ("n",)]


def test_product_fields_of_one_pass_are_those_of_the_joins(spark):
    odps = "product:\n  owner: {email: o@x}\n  ports:\n    output:\n    - plain\n    - dataProduct: second\n      columns:\n      - {name: c, type: int, required: true}\n      - {name: d, nullable: 'false', pii: true}\nports:\n  outputPorts: [no]\n  input:\n  - name: given\n    schema:\n    - name: s\nname: Outer\n"
    dbt = "models:\n- name: m\n  meta: {owner: t}\n  contract:\n    enforced: true\n  columns:\n  - name: c\n    pii: true\n    classification: [z, b]\n- description: nameless\n  columns:\n  - name: x\n"
    groups = "products:\n- name: p\n  outputs:\n  - name: o\n    fields:\n    - {name: f, data_type: long, type: int}\n  inputs: [i]\n"
    odcs = "apiVersion: 1\nkind: DataContract\nteam:\n  name: t\nschema:\n- physicalName: q\n  name: r\n  properties:\n  - name: f\n---\nkind: DataProduct\nports:\n  output:\n  - dataset: u\n    fields:\n    - name: v\n"
    texts = [("a.yml", odps), ("models/b.yaml", dbt), ("x/groups.yml", groups), ("groups2.yml", groups), ("c.yml", odcs), ("d.yml", "x: 1\n"), ("e.json", "{}"), ("n.yml", None)]
    texts = spark.createDataFrame(texts, "file string, content string")
    nodes, keys = tables.settled(products.declared(texts)), ["file", "document", "format", "product"]
    rows = products.product_fields(texts)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    want = products.products(nodes).join(products.fields(nodes), keys).select(rows.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and rows.count() == 7


def test_statements_of_interfaces_are_cut_in_one_pass():
    text = "// a; b { c\npackage a.b ; /* { */ option (x) = { s: \"};{\" t: 'it' };\n;\n}service S {}\n a /\n"
    batch = pa.record_batch({"file": ["p", "q", "r"], "content": [text, None, "x;"]})
    rows = [tuple(r.values()) for b in rpc._cut([batch]) for r in b.to_pylist()]
    assert [(f, at, line, level, opens, " ".join(t.split())) for f, at, line, level, opens, t in rows] == [
        ("p", 1, 2, 0, False, "package a.b"), ("p", 4, 2, 0, True, "option (x) ="), ("p", 5, 2, 1, False, "s: \"};{\" t: 'it'"),
        ("p", 13, 4, -1, True, "service S"), ("p", 15, 5, -1, False, "a /"), ("r", 0, 1, 0, False, "x"),
    ]


def test_links_of_languages_write_no_sibling_of_a_token(spark, monkeypatch):
    seen, whole = [], resolvers.settled
    monkeypatch.setattr(resolvers, "settled", lambda df: seen.append(df.columns) or whole(df))
    texts = [("a/A.java", "java", "package a;\nimport b.B;\nclass A { }\n"), ("b/B.java", "java", "package b;\nclass B { int f() { return 1; } }\n"), ("m.py", "python", "import n\n"), ("n.py", "python", "x = 1\n")]
    links, _ = resolvers.links(spark.createDataFrame(texts, "file string, language string, content string"))
    assert {(r["file"], r["target"]) for r in links.collect()} == {("a/A.java", "b/B.java"), ("m.py", "n.py")}
    assert not any("block" in columns for columns in seen)
