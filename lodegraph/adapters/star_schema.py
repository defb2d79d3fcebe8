"""Star-schema tables seen as the model tables of a repository estate.

Parts are nodes; consecutive heavy lines of one order form edges; orders are commits and
their parts the files of a commit; line items also stand for functions and for covered
lines; suppliers write and customers read datasets.  The mapping only renames and derives
columns, so every operator works on real repositories too.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.operators.closure import Condensed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, directory, unit, kind, tier, lines: one row per part."""
    size = F.col("p_size")
    path = F.concat(
        F.when(size % 7 == 0, "tests/").when(size % 7 == 1, "src/spec/").otherwise("src/"),
        F.translate("p_name", " ", "/"),
        F.when(size % 5 == 0, ".test").when(size % 5 == 1, "_spec").otherwise(""),
        F.lit(".ts"),
    )
    tier = (
        F.when(size >= 40, "frontend").when(size >= 30, "api").when(size >= 20, "domain").when(size >= 12, "data")
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        path.alias("path"),
        F.col("p_brand").alias("directory"),
        F.col("p_type").alias("unit"),
        F.when(size <= 5, "test").when(size >= 48, "entry").otherwise("module").alias("kind"),
        F.coalesce(tier, F.lit("unclassified")).alias("tier"),
        size.cast("long").alias("lines"),
    )


def edge_rows(spark: SparkSession, sf_dir: str, min_quantity: int = 44) -> DataFrame:
    """source, target, kind, role, relationship, line: a row for each pair of consecutive heavy lines."""
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    number = F.col("l_linenumber")
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_quantity") >= min_quantity)
        .select(
            F.col("l_partkey").alias("source"),
            F.lead("l_partkey").over(order).alias("target"),
            F.when(number == 7, "re-export")
            .when(number == 6, "namespace")
            .when(F.col("l_linestatus") == "F", "call")
            .otherwise("import")
            .alias("kind"),
            F.when(F.col("l_returnflag") == "R", "declare").otherwise("use").alias("role"),
            F.when(number == 1, "extends").alias("relationship"),
            F.col("l_orderkey").alias("line"),
        )
        .filter("target is not null")
    )


def edges(spark: SparkSession, sf_dir: str, min_quantity: int = 44) -> DataFrame:
    """source, target: distinct links between consecutive heavy lines of an order."""
    return edge_rows(spark, sf_dir, min_quantity).filter("source <> target").select("source", "target").distinct()


class Model:
    """The model tables of one folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def nodes(self) -> DataFrame:
        return nodes(self.spark, self.sf_dir)

    @cached_property
    def edge_rows(self) -> DataFrame:
        return edge_rows(self.spark, self.sf_dir)

    @cached_property
    def edges(self) -> DataFrame:
        return edges(self.spark, self.sf_dir)

    @cached_property
    def condensed(self) -> Condensed:
        """The graph with its cycles drawn together: one computation for reach, cycles and their sizes."""
        return Condensed(self.edges)

    @cached_property
    def commits(self) -> DataFrame:
        """hash, author, date."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("date")
        )

    @cached_property
    def commit_files(self) -> DataFrame:
        """hash, path: distinct files of each commit."""
        return (
            self.raw("lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path")).distinct()
        )

    @cached_property
    def functions(self) -> DataFrame:
        """file, name, line, lines, decisions, nesting, loops, parameters, recursive, scans, sorts."""
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("file"),
            F.col("l_orderkey").alias("name"),
            F.col("l_linenumber").cast("long").alias("line"),
            (F.col("l_quantity") + 5).cast("long").alias("lines"),
            F.round(F.col("l_discount") * 100).cast("long").alias("decisions"),
            (F.col("l_linenumber") % 6).cast("long").alias("nesting"),
            (F.col("l_suppkey") % 4).alias("loops"),
            F.round(F.col("l_tax") * 100).cast("long").alias("parameters"),
            (F.col("l_suppkey") % 17 == 0).alias("recursive"),
            (F.col("l_suppkey") % 19 == 0).cast("int").alias("scans"),
            (F.col("l_suppkey") % 23 == 0).cast("int").alias("sorts"),
        )

    @cached_property
    def coverage(self) -> DataFrame:
        """file, line, hits: one row for each measured line."""
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("line"))
            .agg(F.sum(F.when(F.col("l_returnflag") == "N", 0).otherwise(1)).alias("hits"))
        )

    @cached_property
    def data_edges(self) -> DataFrame:
        """access, file, dataset, unit, repository: suppliers write parts, customers read them."""
        nation = self.raw("nation").select(
            F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("repository")
        )
        lines = self.raw("lineitem")
        writes = lines.filter("l_discount >= 0.09").join(
            self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")
        ).select(
            F.lit("writes").alias("access"),
            F.col("l_suppkey").alias("file"),
            F.col("l_partkey").alias("dataset"),
            F.col("s_nationkey").alias("unit"),
        )
        reads = (
            lines.filter("l_discount <= 0.01")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.lit("reads").alias("access"),
                F.col("o_custkey").alias("file"),
                F.col("l_partkey").alias("dataset"),
                F.col("c_nationkey").alias("unit"),
            )
        )
        return writes.unionByName(reads).distinct().join(F.broadcast(nation), "unit")

    @cached_property
    def contracts(self) -> DataFrame:
        """dataset: datasets that a contract governs."""
        return self.raw("part").filter("p_size >= 40").select(F.col("p_partkey").alias("dataset"))


EDGES_SQL = """
edges as (
  select distinct l_partkey as source, target from (
    select l_partkey, lead(l_partkey) over (partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as target
    from lineitem where l_quantity >= {q}) x
  where target is not null and target <> l_partkey)"""

# The model tables for DuckDB.
TABLES_SQL = {
    "nodes": """
nodes as (
  select p_partkey as id,
    case p_size % 7 when 0 then 'tests/' when 1 then 'src/spec/' else 'src/' end || replace(p_name, ' ', '/')
      || case p_size % 5 when 0 then '.test' when 1 then '_spec' else '' end || '.ts' as path,
    p_brand as directory, p_type as unit,
    case when p_size <= 5 then 'test' when p_size >= 48 then 'entry' else 'module' end as kind,
    case when p_size >= 40 then 'frontend' when p_size >= 30 then 'api' when p_size >= 20 then 'domain'
      when p_size >= 12 then 'data' else 'unclassified' end as tier,
    cast(p_size as bigint) as lines
  from part)""",
    "edge_rows": """
edge_rows as (
  select * from (
    select l_partkey as source, lead(l_partkey) over (partition by l_orderkey
        order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as target,
      case when l_linenumber = 7 then 're-export' when l_linenumber = 6 then 'namespace'
        when l_linestatus = 'F' then 'call' else 'import' end as kind,
      case when l_returnflag = 'R' then 'declare' else 'use' end as role,
      case when l_linenumber = 1 then 'extends' end as relationship, l_orderkey as line
    from lineitem where l_quantity >= 44) x
  where target is not null)""",
    "edges": EDGES_SQL.format(q=44),
    "commits": """
commits as (select o_orderkey as hash, o_custkey as author, cast(o_orderdate as date) as date from orders)""",
    "commit_files": """
commit_files as (select distinct l_orderkey as hash, l_partkey as path from lineitem)""",
    "functions": """
functions as (
  select l_partkey as file, l_orderkey as name, cast(l_linenumber as bigint) as line,
    cast(l_quantity + 5 as bigint) as lines, cast(round(l_discount * 100) as bigint) as decisions,
    cast(l_linenumber % 6 as bigint) as nesting, l_suppkey % 4 as loops,
    cast(round(l_tax * 100) as bigint) as parameters, l_suppkey % 17 = 0 as recursive,
    cast(l_suppkey % 19 = 0 as int) as scans, cast(l_suppkey % 23 = 0 as int) as sorts
  from lineitem)""",
    "coverage": """
coverage as (
  select l_partkey as file, l_orderkey as line,
    cast(sum(case when l_returnflag = 'N' then 0 else 1 end) as bigint) as hits
  from lineitem group by 1, 2)""",
    "data_edges": """
data_edges as (
  select x.*, n_regionkey as repository from (
    select distinct 'writes' as access, l_suppkey as file, l_partkey as dataset, s_nationkey as unit
    from lineitem join supplier on l_suppkey = s_suppkey where l_discount >= 0.09
    union all
    select distinct 'reads', o_custkey, l_partkey, c_nationkey
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    where l_discount <= 0.01) x
  join nation on n_nationkey = x.unit)""",
    "contracts": """
contracts as (select p_partkey as dataset from part where p_size >= 40)""",
}


def with_tables(names: str, query: str, recursive: bool = False) -> str:
    """query behind the named model tables."""
    parts = ",".join(TABLES_SQL[n] for n in names.split())
    joiner = ", " if query.lstrip().startswith(",") else "\n"
    return f"with {'recursive ' if recursive else ''}{parts}{joiner}{query.lstrip().removeprefix(',')}"
