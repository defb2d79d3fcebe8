"""dbt projects, declared data products and catalogue exports, read from their files.

Descriptors are YAML outlines (`outline.yaml`).  What an attribute may be called in which
format is a small table of shapes in order of precedence that meets the nodes in an
equality join; products, ports and fields are groups of nodes by the steps of their path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodegraph.functions.tables import dealt
from lodegraph.sources import outline

# ---------------------------------------------------------------- dbt


def _name(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]*)$", 1)


def _members(files: DataFrame) -> DataFrame:
    """file, root, folder: every folder of a file that a project could own ('.' is the top)."""
    steps = F.split("file", "/")
    rows = files.select("file", F.posexplode(steps).alias("i", "folder"), F.size(steps).alias("n"), steps.alias("s"))
    root = F.when(F.col("i") == 0, ".").otherwise(F.array_join(F.expr("slice(s, 1, i)"), "/"))
    return rows.filter(F.col("folder").isin("models", "seeds", "snapshots") & (F.col("i") < F.col("n") - 1)).select("file", root.alias("root"), "folder")


def dbt_projects(files: DataFrame) -> DataFrame:
    """root, name, models, seeds, snapshots, sources of each dbt project among files (file, content)."""
    manifests = files.filter(_name(F.col("file")).isin("dbt_project.yml", "dbt_project.yaml"))
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    root = F.when(folder == "", ".").otherwise(folder)
    named = outline.yaml(manifests).filter(outline.shape(F.col("path")) == "name").groupBy("file").agg(F.min("value").alias("name"))
    projects = manifests.join(named, "file", "left").groupBy(root.alias("root")).agg(F.min("name").alias("name"))
    projects = projects.withColumn("name", F.coalesce("name", _name(F.col("root"))))
    sql = F.col("file").endswith(".sql")
    counted = _members(files).groupBy("root").agg(
        F.count_if((F.col("folder") == "models") & sql).alias("models"),
        F.count_if(F.col("folder") == "seeds").alias("seeds"),
        F.count_if((F.col("folder") == "snapshots") & sql).alias("snapshots"),
    )
    sources = _schema_nodes(files).filter("shape = 'sources/[]/name' and value is not null").groupBy("root").agg(F.array_sort(F.collect_set("value")).alias("sources"))
    zero = F.lit(0).cast("long")
    return projects.join(counted, "root", "left").join(sources, "root", "left").select(
        "root", "name", *(F.coalesce(c, zero).alias(c) for c in ("models", "seeds", "snapshots")),
        F.coalesce("sources", F.expr("cast(array() as array<string>)")).alias("sources"),
    )


def _schema_nodes(files: DataFrame) -> DataFrame:
    """root, file, path, shape, value of the YAML files below a models folder."""
    below = files.filter(F.lower("file").rlike(r"\.ya?ml$")).join(_members(files).filter("folder = 'models'"), "file").select("file", "root", "content")
    nodes = outline.yaml(below.select("file", "content").distinct()).filter("document = 0")
    return nodes.withColumn("shape", outline.shape(F.col("path"))).join(below.select("file", "root"), "file")


def dbt_exposures(files: DataFrame) -> DataFrame:
    """root, file, name, type, depends_on (array) of the exposures that schema files declare."""
    nodes = _schema_nodes(files).withColumn("item", F.slice("path", 1, 2))
    at = lambda shape: F.when(F.col("shape") == f"exposures/[]/{shape}", F.col("value"))
    return nodes.filter(F.col("shape").startswith("exposures/[]/")).groupBy("root", "file", "item").agg(
        F.min(at("name")).alias("name"), F.min(at("type")).alias("type"), F.array_sort(F.collect_list(at("depends_on/nodes/[]"))).alias("depends_on")
    ).filter("name is not null").drop("item")


def dbt_references(files: DataFrame) -> DataFrame:
    """file, line, kind, source, target of ref() and source() in model files.

    A call with other than one literal for each argument is 'unresolved' and its text the
    target.  Arguments end at the first bracket and literals are only counted: ref(var('v'))
    names 'v'.
    """
    models = files.filter(F.col("file").endswith(".sql")).join(_members(files).filter("folder = 'models'").select("file").distinct(), "file", "left_semi")
    found = outline.matches(models, r"\b(?:ref|source)\s*\([^)]*\)")
    kind = F.regexp_extract("text", r"^(\w+)", 1)
    given = F.regexp_extract("text", r"\(\s*((?s:.*?))\s*\)$", 1)
    literals = F.regexp_extract_all(given, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    count = F.when(given == "", 0).otherwise(F.size(F.split(given, ",")))
    rows = found.select("file", "line", "text", kind.alias("kind"), literals.alias("l"), (F.size(literals) == count).alias("sure"), count.alias("n"))
    one, two = F.col("sure") & (F.col("kind") == "ref") & (F.col("n") == 1), F.col("sure") & (F.col("kind") == "source") & (F.col("n") == 2)
    return rows.select(
        "file", "line", F.when(one | two, F.col("kind")).otherwise("unresolved").alias("kind"),
        F.when(two, F.expr("l[0]")).alias("source"), F.when(one, F.expr("l[0]")).when(two, F.expr("l[1]")).otherwise(F.col("text")).alias("target"),
    )


def dbt_columns(files: DataFrame) -> DataFrame:
    """file, model, column: what the last select of each model file puts out."""
    models = files.filter(F.col("file").endswith(".sql")).join(_members(files).filter("folder = 'models'").select("file").distinct(), "file", "left_semi")
    bare = F.regexp_replace(F.regexp_replace("content", r"--[^\n]*", ""), r"\{\{(?s:.*?)\}\}", "")
    lists = F.regexp_extract_all(bare, F.lit(r"(?is)\bselect\b(.*?)\bfrom\b"), F.lit(1))
    items = models.select("file", F.explode(F.split(F.element_at(F.when(F.size(lists) > 0, lists), -1), ",")).alias("item"))
    item = F.trim(F.regexp_replace("item", r"\s+", " "))
    alias = F.regexp_extract(item, r"(?i)\bas [\"`]?([a-z_][\w$]*)[\"`]?$", 1)
    own = F.regexp_extract(item, r"(?i)^(?:[\w$\"`]+\.)?[\"`]?([a-z_][\w$]*)[\"`]?$", 1)
    column = F.lower(F.when(alias != "", alias).otherwise(own))
    return items.select("file", F.regexp_replace(_name(F.col("file")), r"\.sql$", "").alias("model"), column.alias("column")).filter("column <> ''").distinct()


# ---------------------------------------------------------------- declared products

# Shapes of an attribute in order of precedence.
_OWNER = ("", "/name", "/email")
NAMES = {
    "odps": ("product/name", "name"),
    "datacontract": ("name", "info/title", "id"),
    "odcs": ("name", "info/title", "id"),
    "dbt": ("models/[]/name",),
    "groups": ("products/[]/name",),
}
OWNERS = {
    "odps": ("product/owner", "owner"),
    "datacontract": ("owner", "team/name"),
    "odcs": ("owner", "team/name"),
    "dbt": ("models/[]/meta/owner", "models/[]/config/meta/owner", "models/[]/owner"),
    "groups": ("products/[]/owner",),
}
PORTS = {
    ("odps", "output"): ("product/ports/outputPorts", "product/ports/output", "ports/outputPorts", "ports/output"),
    ("odps", "input"): ("product/ports/inputPorts", "product/ports/input", "ports/inputPorts", "ports/input"),
    ("datacontract", "output"): ("schema",),
    ("odcs", "output"): ("schema",),
    ("dbt", "output"): ("models",),
    ("groups", "output"): ("products/[]/outputs",),
    ("groups", "input"): ("products/[]/inputs",),
}
FIELDS = {"datacontract": ("properties",), "odcs": ("properties",), "dbt": ("columns",)}
# The steps that tell the products of one document apart.
LISTED = ("dbt", "groups")


def _shapes(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, columns))


def declared(texts: DataFrame, groups_file: str = "groups.yml") -> DataFrame:
    """file, document, format, product (its steps), path, shape, value of the nodes of product descriptors.

    The format is told by the keys a document carries; groups_file names the files whose
    'products' list declares products.
    """
    nodes = outline.yaml(texts.filter(F.lower("file").rlike(r"\.ya?ml$"))).withColumn("shape", outline.shape(F.col("path")))
    shape, value = F.col("shape"), F.col("value")
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    formats = nodes.groupBy("file", "document").agg(
        F.when(has(shape.startswith("product/") | (shape == "kind") & (value == "DataProduct")), "odps")
        .when(has((shape == "dataContractSpecification") & value.isNotNull()), "datacontract")
        .when(has((shape == "kind") & (value == "DataContract")) & has((shape == "apiVersion") & value.isNotNull()), "odcs")
        .when(has(shape.rlike(r"^(models|sources|exposures)/\[\]")), "dbt")
        .when(has(shape.startswith("products/[]")) & F.first(_name(F.col("file")) == groups_file), "groups")
        .alias("format")
    )
    product = F.when(F.col("format").isin(*LISTED), F.slice("path", 1, 2)).otherwise(F.expr("cast(array() as array<string>)"))
    found = nodes.join(formats.filter("format is not null"), ["file", "document"])
    root = F.when(F.col("format") == "dbt", "models").when(F.col("format") == "groups", "products")
    return found.filter(root.isNull() | (F.col("path")[0] == root)).withColumn("product", product).drop("at", "line")


def _attribute_rows() -> list[tuple]:
    rows = [(f, s, "name", i) for f, shapes in NAMES.items() for i, s in enumerate(shapes)]
    rows += [(f, s + tail, "owner", i) for f, shapes in OWNERS.items() for i, (s, tail) in enumerate((s, t) for s in shapes for t in _OWNER)]
    return rows + [("dbt", f"models/[]/{s}contract/enforced", "enforced", 0) for s in ("", "config/")]


def products(nodes: DataFrame) -> DataFrame:
    """file, document, format, product, name, owner, enforced of declared() nodes; a listed product needs a name."""
    found = nodes.join(_shapes(nodes.sparkSession, _attribute_rows(), "format string, shape string, attribute string, rank int"), ["format", "shape"], "left")
    at = lambda a: F.col("attribute") == a
    first = lambda a: F.min_by("value", F.when(at(a) & F.col("value").isNotNull(), F.col("rank")))
    rows = found.groupBy("file", "document", "format", "product").agg(
        first("name").alias("name"), first("owner").alias("owner"),
        F.max(F.coalesce(at("enforced") & (F.col("value") == "true"), F.lit(False))).alias("enforced"),
    )
    listed = F.col("format").isin(*LISTED)
    return rows.filter(~listed | F.col("name").isNotNull()).withColumn("name", F.coalesce("name", _name(F.col("file"))))


def _port_rows() -> list[tuple]:
    rows = []
    for (name, direction), lists in PORTS.items():
        tails = ("/name", "/physicalName") if name in ("datacontract", "odcs") else ("/name",) if name == "dbt" else ("", "/name", "/dataset", "/dataProduct")
        rows += [(name, f"{s}/[]{t}", direction, i, j, s.count("/") + 2) for i, s in enumerate(lists) for j, t in enumerate(tails)]
    return rows


def ports(nodes: DataFrame) -> DataFrame:
    """file, document, format, product, direction, port (its steps), dataset of declared() nodes.

    Of several port lists of one direction the first by precedence counts.
    """
    shapes = _shapes(nodes.sparkSession, _port_rows(), "format string, shape string, direction string, list int, rank int, steps int")
    found = nodes.filter("value is not null").join(shapes, ["format", "shape"]).withColumn("port", F.expr("slice(path, 1, steps)"))
    rows = found.groupBy("file", "document", "format", "product", "direction", "list", "port").agg(F.min_by("value", "rank").alias("dataset"))
    best = F.min("list").over(Window.partitionBy("file", "document", "format", "product", "direction"))
    return rows.withColumn("best", best).filter("list = best").drop("list", "best")


def _field_rows() -> list[tuple]:
    rows = []
    for (name, _), lists in PORTS.items():
        for s in lists:
            for inner in FIELDS.get(name, ("fields", "columns", "schema")):
                for a in ("name", "data_type", "type", "required", "nullable", "classification", "classification/[]", "classifications", "classifications/[]", "pii"):
                    rows.append((name, f"{s}/[]/{inner}/[]/{a}", a.removesuffix("/[]"), s.count("/") + 2))
    return sorted(set(rows))


def fields(nodes: DataFrame) -> DataFrame:
    """file, document, format, product, dataset, field, type, required, tags of the fields of ports().

    Tags are declared classifications only: 'classification(s)', or else 'pii' where that is true.
    """
    shapes = _shapes(nodes.sparkSession, _field_rows(), "format string, shape string, attribute string, steps int")
    found = nodes.filter("value is not null").join(shapes, ["format", "shape"])
    found = found.withColumn("port", F.expr("slice(path, 1, steps)")).withColumn("item", F.expr("slice(path, 1, steps + 2)"))
    at = lambda a: F.min(F.when(F.col("attribute") == a, F.col("value")))
    told = F.collect_set(F.when(F.col("attribute").startswith("classification"), F.col("value")))
    pii = F.max((F.col("attribute") == "pii") & (F.col("value") == "true"))
    keys = ["file", "document", "format", "product", "port"]
    rows = found.groupBy(*keys, "item").agg(
        at("name").alias("field"), F.coalesce(at("data_type"), at("type"), F.lit("unknown")).alias("type"),
        (F.coalesce(at("required") == "true", F.lit(False)) | F.coalesce(at("nullable") == "false", F.lit(False))).alias("required"),
        F.when((F.size(told) == 0) & pii, F.array(F.lit("pii"))).otherwise(F.array_sort(told)).alias("tags"),
    ).filter("field is not null")
    return rows.join(ports(nodes), keys).drop("port", "item", "direction")


PRODUCT_FIELDS = (
    "file string, format string, name string, owner string, enforced boolean, dataset string, field string, type string, required boolean, tags array<string>"
)
_ITEM = re.compile(r"\[\d+\]$", re.ASCII)
_LIST_OF_MODELS = re.compile(r"(models|sources|exposures)/\[\]")


def _lookup(rows: list[tuple]) -> dict:
    """Rows (format, shape, ...) by format and shape."""
    found: dict = {}
    for name, shape, *rest in rows:
        found.setdefault(name, {}).setdefault(shape, []).append(tuple(rest))
    return found


def _format(file: str, nodes: list[tuple], groups_file: str) -> str | None:
    """The format of the nodes (path, shape, value) of one document, as declared() tells it."""
    pairs = {(shape, value) for _, shape, value in nodes if shape in ("kind", "apiVersion", "dataContractSpecification")}
    told = {shape for shape, value in pairs if value is not None}
    if ("kind", "DataProduct") in pairs or any(shape.startswith("product/") for _, shape, _ in nodes):
        return "odps"
    if "dataContractSpecification" in told:
        return "datacontract"
    if ("kind", "DataContract") in pairs and "apiVersion" in told:
        return "odcs"
    if any(_LIST_OF_MODELS.match(shape) for _, shape, _ in nodes):
        return "dbt"
    grouped = file.rpartition("/")[2] == groups_file and any(shape.startswith("products/[]") for _, shape, _ in nodes)
    return "groups" if grouped else None


def _document_fields(file: str, nodes: list[tuple], groups_file: str, known: tuple[dict, dict, dict]) -> Iterator[tuple]:
    """The rows of product_fields() of one document's nodes (path, shape, value)."""
    form = _format(file, nodes, groups_file)
    if form is None:
        return
    listed, root = form in LISTED, {"dbt": "models", "groups": "products"}.get(form)
    attributes, port_shapes, field_shapes = (k.get(form, {}) for k in known)
    products, ports, items = {}, {}, {}
    for path, shape, value in nodes:
        if root and path[0] != root:
            continue
        product = tuple(path[:2]) if listed else ()
        own = products.setdefault(product, {})
        if value is None:
            continue
        for attribute, rank in attributes.get(shape, ()):
            if attribute == "enforced":
                own["enforced"] = own.get("enforced", False) or value == "true"
            elif attribute not in own or rank < own[attribute][0]:
                own[attribute] = (rank, value)
        for direction, place, rank, steps in port_shapes.get(shape, ()):
            best = ports.setdefault((product, direction), {}).setdefault(place, {})
            port = tuple(path[:steps])
            if port not in best or rank < best[port][0]:
                best[port] = (rank, value)
        for attribute, steps in field_shapes.get(shape, ()):
            items.setdefault((product, tuple(path[:steps])), {}).setdefault(tuple(path[: steps + 2]), []).append((attribute, value))
    for (product, _), lists in ports.items():
        own = products[product]
        if listed and "name" not in own:
            continue
        name, owner = own.get("name", (0, file.rpartition("/")[2]))[1], own.get("owner", (0, None))[1]
        for port, (_, dataset) in lists[min(lists)].items():
            for told in items.get((product, port), {}).values():
                least = lambda a: min((v for b, v in told if b == a), default=None)  # noqa: B023, E731
                field, tags = least("name"), sorted({v for a, v in told if a.startswith("classification")})
                if field is not None:
                    kind = least("data_type")
                    kind = kind if kind is not None else least("type")
                    required = least("required") == "true" or least("nullable") == "false"
                    tags = ["pii"] if not tags and ("pii", "true") in told else tags
                    yield (file, form, name, owner, own.get("enforced", False), dataset, field, "unknown" if kind is None else kind, required, tags)


def product_fields(texts: DataFrame, groups_file: str = "groups.yml") -> DataFrame:
    """products() joined with fields() of declared() nodes, read in one pass over each text; a task holds one text's nodes."""
    fields = StructType.fromDDL(PRODUCT_FIELDS)
    schema, known = to_arrow_schema(fields), (_lookup(_attribute_rows()), _lookup(_port_rows()), _lookup(_field_rows()))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=schema.names)

    def found(batches):
        rows: list = []
        for file, trees in outline.documents(batches):
            for nodes in trees:
                shaped = [(path, "/".join("[]" if s[:1] == "[" and _ITEM.match(s) else s for s in path), value) for path, value in nodes]
                for row in _document_fields(file, shaped, groups_file, known):
                    rows.append(row)
                    if len(rows) == outline.MOST_NODES:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    read = texts.filter(F.lower("file").rlike(r"\.ya?ml$")).select("file", "content")
    return dealt(read, "file").mapInArrow(found, fields)


# ---------------------------------------------------------------- catalogues

_ENTITY = "struct<urn:string,name:string,ownership:struct<owners:array<string>>,domain:string,tags:array<string>,glossaryTerms:array<string>>"
_TABLE = "struct<name:string,fullyQualifiedName:string,id:string,catalog_name:string,schema_name:string,owner:string,owners:array<string>,domain:string,tags:array<string>,columns:array<string>>"
_CATALOGUE = f"exportedAt string, generatedAt string, asOf string, entities array<{_ENTITY}>, tables array<{_TABLE}>"


def _text(c: Column) -> Column:
    """A trimmed text, null where it is empty or an object."""
    return F.when((F.trim(c) != "") & ~F.trim(c).startswith("{"), F.trim(c))


def _part(c: Column, *names: str) -> Column:
    """The first of the members of an object's text."""
    return F.coalesce(*(_text(F.get_json_object(F.when(F.trim(c).startswith("{"), c), f"$.{n}")) for n in names))


def catalogue(texts: DataFrame) -> DataFrame:
    """file, catalogue, exported_at, dataset, owner, domain, tags (array of field, tag) of catalogue exports in JSON."""
    j = F.from_json("content", _CATALOGUE)
    rows = texts.select("file", j.alias("j")).withColumn("exported_at", F.coalesce(_text(F.col("j.exportedAt")), _text(F.col("j.generatedAt")), _text(F.col("j.asOf"))))
    tags = lambda c: F.filter(
        F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda t: F.struct(
            _part(t, "field", "column").alias("field"), F.coalesce(_text(t), _part(t, "tag", "name", "tagname")).alias("tag"))),
        lambda t: t["tag"].isNotNull(),
    )
    owner = lambda c: F.coalesce(_text(c), _part(c, "name", "email", "urn"))
    tail = lambda c, by: F.coalesce(F.element_at(F.filter(F.split(c, by), lambda s: s != ""), -1), c)
    e = rows.select("file", "exported_at", F.explode("j.entities").alias("e")).filter("e is not null")
    urn = F.coalesce(_text(F.col("e.urn")), _text(F.col("e.name")), F.lit("unknown"))
    inner = F.split(F.regexp_extract(urn, r"\(([^)]*)\)", 1), ",")
    entry = F.transform(F.col("e.ownership.owners"), lambda o: F.when(F.trim(o).startswith("{"), F.get_json_object(o, "$.owner")).otherwise(o))
    domain = F.coalesce(_text(F.col("e.domain")), _part(F.col("e.domain"), "urn"))
    hub = e.select(
        "file", F.lit("datahub").alias("catalogue"), "exported_at",
        F.when(F.size(inner) >= 2, F.trim(inner[1])).otherwise(tail(urn, "[.:]")).alias("dataset"),
        owner(F.get(F.filter(entry, lambda o: F.coalesce(o, F.lit("")) != ""), F.lit(0))).alias("owner"),
        tail(domain, "[,:]").alias("domain"), tags(F.coalesce("e.tags", "e.glossaryTerms")).alias("tags"),
    )
    t = rows.filter("j.entities is null").select("file", "exported_at", F.explode("j.tables").alias("t")).filter("t is not null")
    name = F.coalesce(*(_text(F.col(f"t.{c}")) for c in ("name", "fullyQualifiedName", "id")), F.lit("unknown"))
    tables = t.select(
        "file", F.when(_text(F.col("t.catalog_name")).isNotNull(), "unity").otherwise("openmetadata").alias("catalogue"), "exported_at",
        F.concat_ws(".", _text(F.col("t.catalog_name")), _text(F.col("t.schema_name")), name).alias("dataset"),
        F.coalesce(_text(F.col("t.owner")), owner(F.get("t.owners", F.lit(0)))).alias("owner"),
        F.coalesce(_text(F.col("t.domain")), _part(F.col("t.domain"), "name")).alias("domain"),
        tags(F.coalesce("t.tags", "t.columns")).alias("tags"),
    )
    return hub.unionByName(tables)
