"""Readers and extracts on small texts, with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.sources import extracts, manifests, readers


def texts(spark, content, name="f"):
    return spark.createDataFrame([(name, content)], "file string, content string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_lock_files(spark):
    cargo = '[[package]]\nname = "serde"\nversion = "1.0"\nsource = "registry"\n\n[[package]]\nname = "own"\nversion = "0.1"\n'
    assert rows(manifests.cargo_lock(texts(spark, cargo)), "name", "version") == [("serde", "1.0")]
    pom = """<project><properties><v.x>3.1</v.x></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId>
      <version>${v.x}</version></dependency><!-- <dependency></dependency> --><dependency><groupId>j</groupId><artifactId>u</artifactId>
      <scope>test</scope></dependency></dependencies></project>"""
    assert rows(manifests.maven_pom(texts(spark, pom)), "name", "version", "dev") == [("g:a", "3.1", False), ("j:u", None, True)]
    lock = "# note\ncom.x:y:1.2=compileClasspath\nempty=\n"
    assert rows(manifests.gradle_lock(texts(spark, lock)), "name", "version") == [("com.x:y", "1.2")]
    script = "dependencies {\n implementation 'a.b:c:1.0'\n testImplementation(\"d:e\")\n // implementation 'x:y:1'\n}"
    assert rows(manifests.gradle_script(texts(spark, script)), "name", "version", "dev") == [("a.b:c", "1.0", False), ("d:e", None, True)]


def test_entry_points(spark):
    package = '{"main": "./lib/a.js", "bin": {"x": "./bin/x.js"}}'
    assert rows(manifests.entry_points(texts(spark, package, "p/package.json")), "entry", "reason") == [("bin/x.js", "bin"), ("lib/a.js", "main")]
    cargo = '[package]\nname = "n"\n[[bin]]\nname = "b"\npath = "src/b.rs"\n[lib]\npath = "src/l.rs"\n'
    assert rows(manifests.entry_points(texts(spark, cargo, "Cargo.toml")), "entry", "reason") == [("src/b.rs", "bin"), ("src/l.rs", "lib")]


def test_coverage_reports(spark):
    xml = '<coverage><class name="A" filename="a.py"><lines><line number="1" hits="2"/><line number="3" hits="0"/></lines></class></coverage>'
    assert rows(manifests.cobertura(texts(spark, xml)), "source", "line", "hits") == [("a.py", 1, 2), ("a.py", 3, 0)]
    xml = '<report><package name="p/q"><sourcefile name="A.java"><line nr="4" mi="0" ci="5"/></sourcefile></package></report>'
    assert rows(manifests.jacoco(texts(spark, xml)), "source", "line", "hits") == [("p/q/A.java", 4, 5)]
    report = '{"files": {"a.py": {"executed_lines": [1], "missing_lines": [2]}}}'
    assert rows(manifests.coverage_py(texts(spark, report)), "source", "line", "hits") == [("a.py", 1, 1), ("a.py", 2, 0)]
    names = spark.createDataFrame([("x", "TN:\nSF:a"), ("r.xml", "<coverage line-rate='1'>"), ("j.xml", "<report><counter/>"), ("c.json", '{"meta": {}}'), ("n", "?")], "name string, content string")
    got = [r[0] for r in names.select(readers.coverage_format(F.col("name"), F.col("content"))).collect()]
    assert got == ["lcov", "cobertura", "jacoco", "coverage.py", None]


def test_owners_sizes_and_python(spark):
    files = spark.createDataFrame([("src/a.ts",), ("docs/b.md",), ("x",)], "path string")
    rules = spark.createDataFrame([(2, "^src/", "two"), (1, "a", "one"), (3, "^docs/", "three")], "ordinal int, pattern string, owner string")
    assert rows(readers.codeowners(files, rules), "path", "owner") == [("docs/b.md", "three"), ("src/a.ts", "two")]
    assert readers.codeowners(files, rules.limit(0)).count() == 0
    sizes = [r[0] for r in spark.createDataFrame([(1,), (3 << 20,), (21 << 20,)], "n long").select(readers.size_class(F.col("n"))).collect()]
    assert sizes == ["parse", "node-only", "exclude"]
    code = "import os.path\nfrom .a import b\nx = 'import no'\n"
    assert [r["specifier"] for r in readers.python_imports(texts(spark, code)).orderBy("line").collect()] == ["os.path", ".a"]


def test_routes_calls_and_events(spark):
    code = """app.get('/users/:id', h);\n@Post('orders')\n@GetMapping("/items")\naxios.post('https://api.x.io/users', b)\nhttp.get(`/local`)\nbus.emit('order.paid', x); bus.on("order.paid", f)\n// app.get('/no', h)"""
    assert rows(extracts.routes(texts(spark, code)), "line", "framework", "method", "path") == [
        (1, "express", "GET", "/users/:id"), (2, "nest", "POST", "/orders"), (3, "spring", "GET", "/items")
    ]
    assert rows(extracts.service_calls(texts(spark, code)), "method", "host", "path") == [("GET", None, "/local"), ("POST", "api.x.io", "/users")]
    assert rows(extracts.event_ends(texts(spark, code)), "side", "topic") == [("consumer", "order.paid"), ("producer", "order.paid")]


def test_sql_uses_and_lineage(spark):
    sql = """with t as (select * from raw.a) insert into mart.b select * from t join raw.c on true; -- from no
      create table d as select 'from x' from mart.b; delete from old; update u set x = 1"""
    assert rows(extracts.lineage(texts(spark, sql)), "source", "target") == [("mart.b", "d"), ("raw.a", "mart.b"), ("raw.c", "mart.b")]
    assert rows(extracts.data_uses(texts(spark, sql)), "access", "name") == [
        ("reads", "mart.b"), ("reads", "raw.a"), ("reads", "raw.c"), ("writes", "mart.b"), ("writes", "old"), ("writes", "u")
    ]


def test_contracts_and_exports(spark):
    api = '{"paths": {"/a/{id}": {"get": {"operationId": "getA"}, "parameters": {}}}}'
    assert rows(extracts.openapi_operations(texts(spark, api)), "method", "path", "operation_id") == [("GET", "/a/{id}", "getA")]
    schema = '{"properties": {"id": {"type": "integer"}, "x": {"type": "string"}}, "required": ["id"]}'
    assert rows(extracts.schema_fields(texts(spark, schema)), "field", "type", "required") == [("id", "integer", True), ("x", "string", False)]
    edges = spark.createDataFrame([('a"b', "c")], "source string, target string")
    assert extracts.dot_lines(edges).first()[0] == '  "a\\"b" -> "c";'
    event = extracts.lineage_events(edges, "n").first()[0]
    assert '"outputs":[{"namespace":"n","name":"c"}]' in event and '"eventType":"COMPLETE"' in event
    assert extracts.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string")).first()[0] == "| a\\|b | - |"
