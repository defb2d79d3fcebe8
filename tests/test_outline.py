"""YAML outlines, products, catalogues, dbt projects and remote calls on texts worked out by hand."""

from __future__ import annotations

from lodegraph.sources import outline

YAML = """# head
version: 2
models:
- name: "a # b"   # note
  columns:
    - {name: x, pii: true}
    - name: 'it''s'
      tags: [p, "q, r", s]
      description: |
        first: line
          - second

        third
      data_type: text
- name: b
  description: >-
    one
    two
  url: http://a:80/b
  note: plain
    goes on
empty:
- - 1
  - 2
---
name: second
'k: 1': ~
"""


def test_yaml_outline(spark):
    rows = outline.yaml(spark.createDataFrame([("f", YAML), ("g", ""), ("h", None)], "file string, content string")).collect()
    assert {r["file"] for r in rows} == {"f"}
    got = {(r["document"], "/".join(r["path"])): (r["line"], r["value"]) for r in rows}
    assert len(got) == len(rows)
    assert got == {
        (0, "version"): (2, "2"),
        (0, "models"): (3, None),
        (0, "models/[0]"): (4, None),
        (0, "models/[0]/name"): (4, "a # b"),
        (0, "models/[0]/columns"): (5, None),
        (0, "models/[0]/columns/[0]"): (6, None),
        (0, "models/[0]/columns/[0]/name"): (6, "x"),
        (0, "models/[0]/columns/[0]/pii"): (6, "true"),
        (0, "models/[0]/columns/[1]"): (7, None),
        (0, "models/[0]/columns/[1]/name"): (7, "it's"),
        (0, "models/[0]/columns/[1]/tags"): (8, None),
        (0, "models/[0]/columns/[1]/tags/[0]"): (8, "p"),
        (0, "models/[0]/columns/[1]/tags/[1]"): (8, "q, r"),
        (0, "models/[0]/columns/[1]/tags/[2]"): (8, "s"),
        (0, "models/[0]/columns/[1]/description"): (9, "first: line\n  - second\n\nthird"),
        (0, "models/[0]/columns/[1]/data_type"): (14, "text"),
        (0, "models/[1]"): (15, None),
        (0, "models/[1]/name"): (15, "b"),
        (0, "models/[1]/description"): (16, "one two"),
        (0, "models/[1]/url"): (19, "http://a:80/b"),
        (0, "models/[1]/note"): (20, "plain goes on"),
        (0, "empty"): (22, None),
        (0, "empty/[0]"): (23, None),
        (0, "empty/[0]/[0]"): (23, "1"),
        (0, "empty/[0]/[1]"): (24, "2"),
        (1, "name"): (26, "second"),
        (1, "k: 1"): (27, None),
    }


MODEL = """-- ref('seen')
with x as (select no from {{ source('raw', "t1") }})
select x.a, b as "B", count(*) as n
from {{ ref(
  'm2') }} join {{ ref(var('v')) }} join {{ ref('p', 'm3') }}
"""


def test_dbt_projects(spark):
    from lodegraph.sources import products

    files = [
        ("dbt_project.yml", "version: 1\n"), ("sub/dbt_project.yml", "name: 'inner' # x\n"),
        ("sub/models/a/models/m1.sql", MODEL), ("sub/models/s.yml", "sources:\n- name: raw\nexposures:\n- {name: e}\n- type: t\n"),
        ("sub/seeds/x.csv", ""), ("models.sql", "select a from b"), ("models/e.sql", ""), ("sub/snapshots/n.sql", None),
    ]
    files = spark.createDataFrame(files, "file string, content string")
    got = {tuple(r)[:5] + (tuple(r["sources"]),) for r in products.dbt_projects(files).collect()}
    assert got == {(".", ".", 1, 0, 0, ()), ("sub", "inner", 1, 1, 1, ("raw",))}
    assert {tuple(r) for r in products.dbt_references(files).collect()} == {
        ("sub/models/a/models/m1.sql", 1, "ref", None, "seen"),
        ("sub/models/a/models/m1.sql", 2, "source", "raw", "t1"),
        ("sub/models/a/models/m1.sql", 4, "ref", None, "m2"),
        ("sub/models/a/models/m1.sql", 5, "ref", None, "v"),
        ("sub/models/a/models/m1.sql", 5, "unresolved", None, "ref('p', 'm3')"),
    }
    assert {(r["model"], r["column"]) for r in products.dbt_columns(files).collect()} == {("m1", "a"), ("m1", "b"), ("m1", "n")}
    assert [(r["name"], r["type"], r["depends_on"]) for r in products.dbt_exposures(files).collect()] == [("e", None, [])]


ODPS = """product:
  owner: {email: o@x}
  ports:
    output:
    - plain
    - dataProduct: second
      columns:
      - {name: c, type: int, required: true}
ports:
  outputPorts: [no]
  input:
  - name: given
name: Outer
"""
DBT = """models:
- name: m
  config: {contract: {enforced: true}}
  meta:
    owner:
      name: team
  contract:
    enforced: true
  columns:
  - name: c
    pii: true
    classification: [secret]
- description: nameless
"""


def test_products(spark):
    from lodegraph.sources import products

    texts = [("a.yml", ODPS), ("models/b.yaml", DBT), ("c.yml", "apiVersion: 1\nkind: DataContract\nteam:\n  name: t\n"), ("d.yml", "x: 1\n"), ("e.json", "{}"), ("n.yml", None)]
    nodes = products.declared(spark.createDataFrame(texts, "file string, content string"))
    got = {(r["file"], r["format"], r["name"], r["owner"], r["enforced"]) for r in products.products(nodes).collect()}
    assert got == {("a.yml", "odps", "Outer", "o@x", False), ("models/b.yaml", "dbt", "m", "team", True), ("c.yml", "odcs", "c.yml", "t", False)}
    ports = {(r["file"], r["direction"], r["dataset"]) for r in products.ports(nodes).collect()}
    assert ports == {("a.yml", "output", "plain"), ("a.yml", "output", "second"), ("a.yml", "input", "given"), ("models/b.yaml", "output", "m")}
    fields = {(r["dataset"], r["field"], r["type"], r["required"], tuple(r["tags"])) for r in products.fields(nodes).collect()}
    assert fields == {("second", "c", "int", True, ()), ("m", "c", "unknown", False, ("secret",))}


def test_catalogues(spark):
    from lodegraph.sources import products

    hub = """{"exportedAt": "d", "entities": [{"urn": "urn:li:dataset:(db, a.b ,PROD)", "ownership": {"owners": [null, {"owner": {"name": "n"}}]},
        "domain": "urn:li:domain:k", "glossaryTerms": ["g", {"name": "h", "column": "c"}]}, {"name": "x.y"}]}"""
    unity = """{"tables": [{"name": "t", "catalog_name": "c", "schema_name": "s", "owner": "o", "domain": {"name": "k"}}, {"fullyQualifiedName": "f", "owners": ["u"]}]}"""
    texts = [("h.json", hub), ("u.json", unity), ("b.json", "no"), ("e.json", ""), ("n.json", None)]
    rows = products.catalogue(spark.createDataFrame(texts, "file string, content string")).collect()
    got = {(r["catalogue"], r["exported_at"], r["dataset"], r["owner"], r["domain"], tuple((t["field"], t["tag"]) for t in r["tags"])) for r in rows}
    assert got == {
        ("datahub", "d", "a.b", "n", "k", ((None, "g"), ("c", "h"))),
        ("datahub", "d", "y", None, None, ()),
        ("unity", None, "c.s.t", "o", "k", ()),
        ("openmetadata", None, "f", "u", None, ()),
    }
