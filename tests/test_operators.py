"""Golden graphs, readers and scalars, with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import paths
from lodegraph.functions.ranks import percentiles, smaller_counts
from lodegraph.operators import closure, diffs, history, matching
from lodegraph.sources import readers


def graph(spark, text):
    pairs = [tuple(p.strip().split("→")) for p in text.split(",")]
    return spark.createDataFrame(pairs, "source string, target string")


G_A = "a→b, b→a, b→c, c→d, e→a, e→d, f→f"
G_B = "a→b, a→c, b→d, c→d, c→e, d→a, e→f, g→g"


@pytest.mark.parametrize(
    "text, forward, backward, cyclic",
    [
        (G_A, "a3 b3 c1 d0 e4 f0", "a2 b2 c3 d4 e0 f0", "ab"),
        (G_B, "a5 b5 c5 d5 e1 f0 g0", "a3 b3 c3 d3 e4 f5 g0", "abcd"),
    ],
)
@pytest.mark.parametrize("small", [500, 0])
def test_golden_graphs(spark, monkeypatch, text, forward, backward, cyclic, small):
    monkeypatch.setattr(closure, "SMALL_EDGES", small)
    edges = graph(spark, text)
    nodes = spark.createDataFrame([(x[0],) for x in forward.split()], "id string")
    got = {r["id"]: (r["dependencies"], r["dependents"]) for r in closure.reach_counts(nodes, edges).collect()}
    assert got == {f[0]: (int(f[1:]), int(b[1:])) for f, b in zip(forward.split(), backward.split())}
    assert {(r["id"], r["cycle"]) for r in closure.cycles(edges).collect()} == {(c, "a") for c in cyclic}


def test_levels_paths_depths(spark):
    edges = graph(spark, "a→b, a→c, b→d, c→d, d→e, e→d")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["distance"] for r in closure.levels(edges, seeds).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r["id"]: r["path"] for r in closure.least_paths(edges, seeds).collect()}["e"] == list("abde")
    assert {r["id"]: r["depth"] for r in closure.depths(edges).collect()} == {"a": 2, "b": 1, "c": 1, "d": 0, "e": 0}


def test_co_change(spark):
    files = [(h, p) for h in range(3) for p in "ab"] + [(3, "a"), (4, "b")]
    table = spark.createDataFrame(files, "hash long, path string")
    assert [tuple(r) for r in history.co_change(table).collect()] == [("a", "b", 3, 5, 0.6)]
    assert history.co_change(table, most_files=1).count() == 0


def test_percentiles(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, 1)], "id int, v int")
    assert {r["id"]: r["v_rank"] for r in percentiles(rows, ["v"], 4).collect()} == {4: 0, 1: 33, 2: 33, 3: 100}
    assert percentiles(rows.limit(1), ["v"], 1).first()["v_rank"] == 100
    assert {(r["v"], r["n"], r["smaller"]) for r in smaller_counts(rows, "v").collect()} == {(1, 1, 0), (5, 2, 1), (9, 1, 3)}


def test_scalars(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert value(paths.joined(F.lit("src/a"), F.lit("../b/./c"))) == "src/b/c"
    assert value(paths.extension(F.lit("x/.env"))) == "<none>" and value(paths.extension(F.lit("a.D.TS"))) == ".ts"
    assert [value(paths.is_test(F.lit(p))) for p in ("a/tests/b", "a/x_test.py", "latest.ts", "test_a.py")] == [True, True, False, True]
    assert value(paths.column_type(F.lit("Character  Varying ( 20 )"))) == "varchar(20)"
    assert value(paths.license_risk(F.lit("(A AND C) OR B"), {"A": "permissive", "B": "weak-copyleft", "C": "strong-copyleft"})) == "weak-copyleft"
    assert value(paths.name_tokens(F.lit("loadHTTPcache_file2Disk"))) == ["load", "httpcache", "file2", "disk"]
    assert paths.glob_pattern("src/**/*.ts") == r"^src/(?:.*/)?[^/]*\.ts$"


def test_imports_resolve_in_order(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/a/index.ts",), ("src/b.js",), ("src/c/index.js",)], "path string")
    imports = spark.createDataFrame([("src/x.ts", s) for s in ("./a", "./b", "./c", "./none", "./b.js")], "file string, specifier string")
    got = {r["specifier"]: (r["target"], r["resolution"]) for r in matching.resolve_imports(imports, files).collect()}
    assert got == {
        "./a": ("src/a.ts", "extension"),
        "./b": ("src/b.js", "extension"),
        "./c": ("src/c/index.js", "index"),
        "./none": (None, None),
        "./b.js": ("src/b.js", "exact"),
    }


def test_readers(spark):
    def texts(content, name="f"):
        return spark.createDataFrame([(name, content)], "file string, content string")

    lcov = "TN:\nSF:a.ts\nDA:1,0\nDA:2,3\nend_of_record\nSF:b.ts\nDA:1,1\nSF:a.ts\nDA:2,1\n"
    assert {tuple(r) for r in readers.lcov_lines(texts(lcov)).collect()} == {("a.ts", 1, 0), ("a.ts", 2, 4), ("b.ts", 1, 1)}
    log = "\u001eaaa\u001fAda\u001f2024-01-02T03:04:05Z\u001ffirst\n3\t1\tsrc/{a => b}/c.ts\n-\t-\tlogo.png\n\u001ebbb\u001fGrace\u001f2024-01-03T00:00:00Z\u001fempty\n"
    rows = readers.commits(spark.createDataFrame([(log,)], "text string")).collect()
    assert [(r["hash"], r["author"], r["path"], r["insertions"]) for r in rows] == [
        ("aaa", "Ada", "src/b/c.ts", 3), ("aaa", "Ada", "logo.png", None), ("bbb", "Grace", None, None)
    ]
    diff = "--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n three\n"
    got = [(r["kind"], r["old_line"], r["new_line"], r["text"]) for r in readers.diff_lines(texts(diff)).collect()]
    assert sorted(got, key=str) == sorted(
        [("context", 1, 1, "one"), ("del", 2, None, "two"), ("add", None, 2, "TWO"), ("context", 3, 3, "three")], key=str
    )
    code = "import a from './a';\n// import b from 'b'\nexport { c } from \"@s/c/deep\";\nconst d = require('d');"
    assert [r["specifier"] for r in readers.script_imports(texts(code)).collect()] == ["./a", "@s/c/deep", "d"]
    lock = '{"packages": {"": {}, "node_modules/@a/b": {"version": "1.0.0", "dev": true}, "node_modules/c": {"version": "2.0.0"}}}'
    assert {(r["name"], r["version"], r["dev"]) for r in readers.npm_lock(texts(lock)).collect()} == {("@a/b", "1.0.0", True), ("c", "2.0.0", False)}


def test_probe_guards():
    assert diffs.read_only("select count(*) from t where a = 'drop it';")
    assert not diffs.read_only("select 1; delete from t") and not diffs.read_only("drop table t")
    assert diffs.safe_revision("main") and not diffs.safe_revision("--output=x")
    with pytest.raises(ValueError):
        diffs.identifiers("a b")


def test_difference_of_a_table_with_itself_is_empty(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert diffs.changes(rows, rows, ["id"], ["v"]).count() == 0
    assert diffs.presence(rows, rows, ["id"]).count() == 0
