"""Contents at a revision, ignore rules and bounded pairs on cases worked out by hand."""

from __future__ import annotations

from lodegraph.operators import history, revisions
from lodegraph.sources import ignores


def test_contents_at_a_revision(spark):
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 4, None), ("a", 6, "y"), ("b", 2, "z")], "path string, ordinal long, blob string")
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("a", 6), ("a", 9), ("b", 9), ("c", 1)], "path string, ordinal long")
    got = {(r["path"], r["ordinal"]): (r["blob"], r["since"]) for r in revisions.before(asked, versions).collect()}
    assert got == {("a", 1): (None, None), ("a", 2): ("x", 1), ("a", 5): (None, 4), ("a", 6): (None, 4), ("a", 9): ("y", 6), ("b", 9): ("z", 2), ("c", 1): (None, None)}
    held = {(r["path"], r["since"], r["until"], r["blob"]) for r in revisions.intervals(versions).collect()}
    assert held == {("a", 1, 4, "x"), ("a", 6, None, "y"), ("b", 2, None, "z")}


def test_trees_of_a_branched_history(spark):
    # 1 - 2 - 4 - 5 with 3 a branch from 1 that 5 merges.
    parents = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (5, 4), (5, 3)], "hash long, parent long")
    versions = spark.createDataFrame([("a", 1, "a1"), ("b", 1, "b1"), ("a", 2, "a2"), ("a", 3, "a3"), ("b", 4, None), ("c", 5, "c5")], "path string, hash long, blob string")
    asked = spark.createDataFrame([(5,), (4,), (3,)], "revision long")
    got = {(r["revision"], r["path"]): r["blob"] for r in revisions.trees(parents, versions, asked).collect()}
    assert got == {(5, "a"): "a3", (5, "c"): "c5", (4, "a"): "a2", (3, "a"): "a3", (3, "b"): "b1"}


def test_ignore_rules(spark):
    rules = [("", 1, "*.log"), ("", 2, "!keep.log"), ("", 3, "/build"), ("", 4, "tmp/"), ("", 5, "docs/**/*.pdf"), ("", 6, "# note"), ("", 7, r"\#odd"), ("", 8, "a?c.[ch]"),
             ("src", 1, "!*.log"), ("src", 2, "gen"), ("src/gen", 1, "!x.ts"), ("", 9, "**/cache"), ("", 10, "trail  ")]
    files = ["a.log", "keep.log", "build/x", "src/build/x", "tmp/f", "src/tmp", "docs/a/b/c.pdf", "docs/c.pdf", "c.pdf", "#odd", "abc.h", "abbc.h", "src/b.log", "src/gen/x.ts", "l/m/cache/n", "trail", "plain.ts"]
    rows = ignores.ignored(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(rules, "folder string, ordinal long, text string"))
    got = {r["path"]: (r["by_path"], r["folder"], r["ordinal"]) for r in rows.collect()}
    assert got == {
        "a.log": ("a.log", "", 1), "build/x": ("build", "", 3), "tmp/f": ("tmp", "", 4), "docs/a/b/c.pdf": ("docs/a/b/c.pdf", "", 5), "docs/c.pdf": ("docs/c.pdf", "", 5),
        "#odd": ("#odd", "", 7), "abc.h": ("abc.h", "", 8), "src/gen/x.ts": ("src/gen", "src", 2), "l/m/cache/n": ("l/m/cache", "", 9), "trail": ("trail", "", 10),
    }


def test_a_large_commit_forms_no_pairs(spark):
    rows = [(1, i) for i in range(10_000)] + [(2, 5), (2, 6), (3, 5), (3, 6), (3, 7)]
    got = {(r["source"], r["target"]): (r["shared"], r["first"]) for r in history.pairs(spark.createDataFrame(rows, "hash long, path long"), 50).collect()}
    assert got == {(5, 6): (2, 2), (5, 7): (1, 3), (6, 7): (1, 3)}
