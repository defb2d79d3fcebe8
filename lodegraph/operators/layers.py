"""Reading routes, import depth bands, layers, communities and tiers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.ranks import first_rows
from lodegraph.functions.tables import Layers, settled
from lodegraph.operators import closure

MOST_BANDS, MOST_PASSES = 4, 10
# Path tokens that name a tier, strongest kind of evidence first.
TIER_TOKENS = {
    "frontend": "ui components pages views frontend client".split(),
    "api": "api routes controllers handlers endpoints".split(),
    "domain": "domain services usecases core model models".split(),
    "integration": "clients adapters integrations gateways".split(),
    "data": "data db database repositories migrations dao".split(),
    "infra": "infra deploy terraform docker".split(),
    "build": "build scripts tools".split(),
    "tests": "test tests spec specs".split(),
}


def reading_route(edges: DataFrame, entries: DataFrame, fan_in: DataFrame | None = None, layer_limit: int | None = None) -> DataFrame:
    """id, depth, parent, entry: files admitted layer by layer from entries (id).

    Every candidate of a layer is admitted, or with a layer_limit the most imported ones
    (fan_in: id, fan_in), then least by id; a file's parent is its least importer in the layer before.
    """
    links = settled(closure.proper(edges))
    if fan_in is not None:
        fan_in = settled(fan_in)
    none = F.lit(None).cast(links.schema["source"].dataType)
    found = Layers(edges.sparkSession, "depth")
    front, n = found.add(entries.select("id", none.alias("parent"), F.col("id").alias("entry")).distinct(), 0)
    depth = 0
    while n:
        depth += 1
        step = front.select(F.col("id").alias("source"), "entry").join(links, "source")
        step = step.groupBy(F.col("target").alias("id")).agg(F.min(F.struct("source", "entry")).alias("f"))
        step = step.join(found.all().select("id"), "id", "left_anti")
        if layer_limit is not None:
            step = step.join(fan_in, "id", "left").fillna(0, ["fan_in"]).orderBy(F.desc("fan_in"), "id").limit(layer_limit)
        front, n = found.add(step.select("id", F.col("f.source").alias("parent"), F.col("f.entry").alias("entry")), depth)
    return found.all().select("id", "depth", "parent", "entry")


def _ordered(frame):
    """Kahn's order of one route: files (id, depth) with their importers within it (list column)."""
    import heapq

    import pandas as pd

    depth = dict(zip(frame["id"], frame["depth"]))
    after, waits = {}, {}
    for name, importers in zip(frame["id"], frame["importers"]):
        known = [i for i in importers if i in depth]
        waits[name] = len(known)
        for i in known:
            after.setdefault(i, []).append(name)
    heap = [(depth[n], n) for n in depth if not waits[n] or depth[n] == 0]
    heapq.heapify(heap)
    out = []
    done = set()
    while heap:
        _, name = heapq.heappop(heap)
        if name in done:
            continue
        done.add(name)
        out.append(name)
        for other in after.get(name, ()):
            waits[other] -= 1
            if waits[other] <= 0 and other not in done:
                heapq.heappush(heap, (depth[other], other))
    out += sorted((n for n in depth if n not in done), key=lambda n: (depth[n], n))
    return pd.DataFrame({"entry": frame["entry"].iloc[0], "id": out, "place": range(1, len(out) + 1)})


def reading_order(route: DataFrame, edges: DataFrame) -> DataFrame:
    """entry, id, place: each entry's files (route: id, depth, entry), importers first.

    The order of one entry's files is sequential, so a task holds them and the links between
    them.  Files of cycles come last, by depth and id.
    """
    inner = closure.proper(edges).join(route.select(F.col("id").alias("source"), "entry"), "source")
    importers = inner.groupBy("entry", F.col("target").alias("id")).agg(F.collect_list("source").alias("importers"))
    kind = route.schema["id"].dataType.simpleString()
    empty = F.expr(f"cast(array() as array<{kind}>)")
    rows = route.select("entry", "id", "depth").join(importers, ["entry", "id"], "left").withColumn("importers", F.coalesce("importers", empty))
    return rows.groupBy("entry").applyInPandas(_ordered, f"entry {kind}, id {kind}, place long")


def depth_bands(rows: DataFrame, most: int = MOST_BANDS) -> DataFrame:
    """unit, depth, band: depths of a unit in at most so many contiguous ranges of similar size.

    rows: unit, depth, one for each file.  A depth never spans two ranges; its files are
    counted first, so a unit brings one row for each depth.
    """
    sizes = rows.groupBy("unit", "depth").agg(F.count(F.lit(1)).alias("n"))
    listed = sizes.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("d"), F.sum("n").alias("all"))
    start = F.struct(
        F.lit(0).cast("long").alias("held"),
        F.lit(1).cast("long").alias("band"),
        F.expr("cast(array() as array<struct<depth:bigint,band:bigint>>)").alias("out"),
    )

    def step(acc, x):
        full = (acc["held"] * most >= F.col("all")) & (acc["band"] < most)
        band = F.when(full, acc["band"] + 1).otherwise(acc["band"])
        held = F.when(full, x["n"]).otherwise(acc["held"] + x["n"])
        row = F.struct(x["depth"].cast("long").alias("depth"), band.alias("band"))
        return F.struct(held.alias("held"), band.alias("band"), F.concat(acc["out"], F.array(row)).alias("out"))

    return listed.select("unit", F.explode(F.aggregate("d", start, step, lambda acc: acc["out"])).alias("x")).select("unit", "x.*")


def layers(rows: DataFrame) -> DataFrame:
    """unit, id, layer: files (unit, id, depth, token) by token, or by depth where few have one.

    A unit without tokens is layered by depth.  Where at most half of the files have no
    token, these join the layer whose median depth is nearest; otherwise they form bands.
    """
    rows = settled(rows)
    units = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("all"), F.count("token").alias("named"))
    rows = rows.join(units, "unit")
    tokens = rows.filter("token is not null").select("unit", "id", F.col("token").alias("layer"))
    plain = rows.filter("named = 0").select("unit", "id", F.concat(F.lit("layer "), F.col("depth").cast("string")).alias("layer"))
    bare = rows.filter("token is null and named > 0")
    order = Window.partitionBy("unit", "token").orderBy("depth", "id")
    size = F.count(F.lit(1)).over(Window.partitionBy("unit", "token"))
    medians = (
        rows.filter("token is not null")
        .select("unit", "token", "depth", F.row_number().over(order).alias("n"), size.alias("size"))
        .filter("n = floor(size / 2) + 1")
        .select("unit", F.col("token").alias("layer"), F.col("depth").alias("median"))
    )
    near = bare.filter("(all - named) * 2 <= all").join(medians, "unit")
    near = first_rows(near, ["unit", "id"], [F.abs(F.col("median") - F.col("depth")), F.col("median"), F.col("layer")])
    far = bare.filter("(all - named) * 2 > all")
    bands = depth_bands(far).withColumnRenamed("band", "b")
    far = far.join(bands, ["unit", "depth"]).select("unit", "id", F.concat(F.lit("band "), F.col("b").cast("string")).alias("layer"))
    return tokens.unionByName(plain).unionByName(near.select("unit", "id", "layer")).unionByName(far)


def _communities(frame):
    """One pass after another of greedy modularity over the members of a unit, in order of their ids."""
    import pandas as pd

    near: dict = {}
    for a, b in zip(frame["source"], frame["target"]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    members = sorted(near)
    place = {v: i for i, v in enumerate(members)}
    weight = {i: len(near[v]) for i, v in enumerate(members)}
    total = sum(weight.values()) / 2
    for _ in range(MOST_PASSES):
        moved = False
        for v in members:
            own, k = place[v], len(near[v])
            links: dict = {}
            for other in near[v]:
                links[place[other]] = links.get(place[other], 0) + 1
            weight[own] -= k
            gain = lambda c: links.get(c, 0) / total - weight[c] * k / (2 * total * total)  # noqa: B023, E731
            best = own
            for c in sorted(links):
                if gain(c) > gain(best):
                    best = c
            place[v] = best
            weight[best] += k
            moved |= best != own
        if not moved:
            break
    return pd.DataFrame({"unit": frame["unit"].iloc[0], "id": members, "community": [place[v] for v in members]})


def communities(links: DataFrame, most_links: int = 1_000_000) -> DataFrame:
    """unit, id, community (least id): groups of files by links (unit, source, target) inside a unit.

    The passes are sequential, so a unit is one task's work; units of more than most_links
    links raise an error instead of filling that task.
    """
    links = settled(links.filter("source <> target").select("unit", "source", "target").distinct())
    large = links.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_links).take(1)
    if large:
        raise ValueError(f"unit {large[0]['unit']!r} has more than {most_links} links")
    kind, unit = (links.schema[c].dataType.simpleString() for c in ("source", "unit"))
    found = links.groupBy("unit").applyInPandas(_communities, f"unit {unit}, id {kind}, community long")
    least = found.groupBy("unit", "community").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members"))
    return found.join(least.filter("members > 1"), ["unit", "community"]).select("unit", "id", F.col("least").alias("community"))


def tier_of(path: Column, declared: Column | None = None) -> Column:
    """struct(tier, mixed): the declared tier, else that of the deepest path token; mixed where two tiers tie there."""
    folders = F.reverse(F.slice(F.split(F.lower(path), "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    pairs = [(token, tier) for tier, tokens in TIER_TOKENS.items() for token in tokens]
    table = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    hits = F.filter(F.transform(folders, lambda s: table[s]), lambda t: t.isNotNull())
    found = F.try_element_at(hits, F.lit(1))
    mixed = F.size(F.array_distinct(hits)) > 1
    chosen = found if declared is None else F.coalesce(declared, found)
    known = F.lit(False) if declared is None else declared.isNotNull()
    return F.struct(F.coalesce(chosen, F.lit("unclassified")).alias("tier"), (~known & mixed).alias("mixed"))


def first_seen_cap(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs (first, source, target, ...) that were seen first, at most so many."""
    return pairs.orderBy("first", "source", "target").limit(most)


def pain_points(findings: DataFrame, most: int = 20) -> DataFrame:
    """place, severity, kind, subject, amount: the worst findings (severity, kind, subject, amount)."""
    rank = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("severity"))
    top = findings.withColumn("_r", rank).orderBy("_r", F.desc("amount"), "kind", "subject").limit(most)
    order = Window.orderBy("_r", F.desc("amount"), "kind", "subject")  # over at most `most` rows
    return top.select(F.row_number().over(order).cast("long").alias("place"), "severity", "kind", "subject", "amount")
