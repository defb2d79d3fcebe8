"""Routes, bands, layers, communities, tiers and reports over the model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.adapters.star_schema import with_tables
from lodegraph.functions.tables import settled
from lodegraph.operators import closure, diffs, history, layers, text


def route(m):
    return layers.reading_route(m.edges, m.nodes.filter("kind = 'entry'").select("id"))


def reading_order(m):
    return layers.reading_order(settled(route(m)), m.edges)


def unit_depths(m):
    """Import depth of each file within the links of its unit; depth 0 imports nothing there."""
    own = m.nodes.select("id", F.col("tier").alias("unit"))
    inner = m.edges.join(own.select(F.col("id").alias("source"), F.col("unit").alias("u")), "source").join(
        own.select(F.col("id").alias("target"), F.col("unit").alias("v")), "target"
    )
    found = closure.depths(inner.filter("u = v").select("source", "target"))
    return own.join(found, "id", "left").fillna(0, ["depth"])


def depth_bands(m):
    return layers.depth_bands(unit_depths(m))


def file_layers(m):
    size = F.col("id") % 10
    token = F.when(size < 3, "controllers").when(size < 6, F.when(F.col("unit") != "data", "services"))
    rows = unit_depths(m).filter("unit <> 'frontend'").withColumn("token", F.when(F.col("unit") == "api", F.when(size == 0, "views")).otherwise(token))
    rows = rows.unionByName(unit_depths(m).filter("unit = 'frontend'").withColumn("token", F.lit(None).cast("string")))
    found = layers.layers(rows.select("unit", "id", "depth", "token"))
    return found.groupBy("unit", "layer").agg(F.count(F.lit(1)).alias("files"), F.sum("id").alias("ids"))


def communities(m):
    own = m.nodes.select("id", "tier")
    rows = m.edges.join(own.select(F.col("id").alias("source"), F.col("tier").alias("unit")), "source").join(
        own.select(F.col("id").alias("target"), F.col("tier").alias("v")), "target"
    )
    return layers.communities(rows.filter("unit = v"))


def tiers(m):
    path = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("src/api/", "src/domain/db/", "web/ui/", "lib/", "test/core/"))), (F.col("p_size") % 5 + 1).cast("int")), F.translate("p_name", " ", "/"), F.lit(".ts"))
    found = m.raw("part").select(layers.tier_of(path, F.when(F.col("p_partkey") % 11 == 0, "infra")).alias("t")).select("t.*")
    return found.groupBy("tier", "mixed").agg(F.count(F.lit(1)).alias("n"))


def first_pairs(m):
    """The 2000 pairs of files that first stood in one commit; commits of more than 50 files form no pairs."""
    files = m.commit_files.join(m.commits.select("hash"), "hash")
    firsts = history.pairs(files, 50).select("source", "target", "first")
    return layers.first_seen_cap(firsts, 2000)


def function_changes(m):
    before, after = m.functions.filter("name % 2 = 0"), m.functions.filter("name % 2 = 1")
    rows = diffs.deltas(before, after, ["file"], "decisions")
    return rows.orderBy(F.desc(F.abs("delta")), "file").limit(40)


def clone_order(m):
    """The largest groups of equal token sequences."""
    found = text.clone_groups(m.raw("documents").select(F.col("doc_id").alias("file"), "text"), 30)
    return found.orderBy(F.desc("tokens"), "shape").limit(50)


def pain_points(m):
    cycles = m.condensed.cycles().groupBy(F.col("cycle").cast("string").alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("amount"))
    high = cycles.select(F.lit("high").alias("severity"), F.lit("cycle").alias("kind"), "subject", "amount")
    dead = m.nodes.filter("kind = 'module'").join(m.edges.select(F.col("target").alias("id")), "id", "left_anti")
    low = dead.select(F.lit("low").alias("severity"), F.lit("dead").alias("kind"), F.col("id").cast("string").alias("subject"), F.col("lines").cast("double").alias("amount"))
    hubs = m.edges.groupBy(F.col("target").cast("string").alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("amount")).filter("amount >= 5")
    medium = hubs.select(F.lit("medium").alias("severity"), F.lit("hub").alias("kind"), "subject", "amount")
    return layers.pain_points(high.unionByName(medium).unionByName(low))


_REACH = """, reach as (select source, target from edges union
  select r.source, e.target from reach r join edges e on e.source = r.target)"""

QUERIES = {
    "g10_reading_route": (route, None),
    "g11_reading_order": (reading_order, None),
    "w08_depth_bands": (depth_bands, None),
    "g13_layers": (file_layers, None),
    "g14_communities": (communities, None),
    "r10_tiers": (
        tiers,
        """with p as (select case when p_partkey % 11 = 0 then 'infra' else ['api', 'data', 'frontend', 'unclassified', 'domain'][p_size % 5 + 1] end as tier,
            p_partkey % 11 <> 0 and p_size % 5 in (1, 4) as mixed from part)
          select tier, mixed, count(*) as n from p group by 1, 2""",
    ),
    "w07_first_pairs": (
        first_pairs,
        with_tables("commits commit_files", """select a.path as source, b.path as target, min(a.hash) as first from commit_files a
          join commit_files b on a.hash = b.hash and a.path < b.path join commits c on c.hash = a.hash
          where a.hash in (select hash from commit_files group by hash having count(*) <= 50) group by 1, 2 order by first, source, target limit 2000"""),
    ),
    "t11_function_changes": (
        function_changes,
        with_tables("functions", """, a as (select file, sum(decisions) as before from functions where name % 2 = 0 group by 1),
          b as (select file, sum(decisions) as after from functions where name % 2 = 1 group by 1)
          select coalesce(a.file, b.file) as file, cast(coalesce(before, 0) as bigint) as before, cast(coalesce(after, 0) as bigint) as after,
            cast(coalesce(after, 0) - coalesce(before, 0) as bigint) as delta from a full join b on a.file = b.file
          where coalesce(after, 0) <> coalesce(before, 0) order by abs(delta) desc, file limit 40"""),
    ),
    "t12_clone_order": (clone_order, None),
    "r16_pain_points": (
        pain_points,
        with_tables("nodes edges", _REACH + """, c as (select a.source as id, min(a.target) as cycle from reach a
            join reach b on a.source = b.target and a.target = b.source group by 1),
          f as (select 1 as r, 'high' as severity, 'cycle' as kind, cast(cycle as varchar) as subject, cast(count(*) as double) as amount from c group by cycle having count(*) > 1
            union all select 2, 'medium', 'hub', cast(target as varchar), count(*) from edges group by target having count(*) >= 5
            union all select 3, 'low', 'dead', cast(id as varchar), lines from nodes where kind = 'module' and id not in (select target from edges))
          select row_number() over (order by r, amount desc, kind, subject) as place, severity, kind, subject, amount from f
          order by place limit 20""", True),
    ),
    "g12_depths": (
        lambda m: closure.depths(m.edges).groupBy("depth").agg(F.count(F.lit(1)).alias("n")),
        None,
    ),
}
