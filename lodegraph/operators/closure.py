"""Iterative operators over directed edges (source, target): reach, cycles, levels, paths.

Every round is one job that writes its rows to the shared checkpoint folder and counts
them on the way, so lineage stays short and a lost executor repeats one round at most.
Loops end when a round adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.ranks import first_rows
from lodegraph.functions.tables import Layers, Rewritten, row_count, settled, settled_counting

SMALL_EDGES = 5000
TRIMS = 4


def proper(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes."""
    return edges.filter("source <> target").select("source", "target").distinct()


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(turned(edges))


def closure(edges: DataFrame) -> DataFrame:
    """source, target: every pair of different nodes with a path from one to the other.

    Paths double in each round, so a graph of depth d takes log2(d) rounds.  Pairs of a
    node with itself are dropped: longer paths through them are found without them.
    """
    reach, count = settled_counting(proper(edges), row_count())
    while True:
        step = reach.alias("a").join(reach.alias("b"), F.col("a.target") == F.col("b.source"))
        longer = step.select(F.col("a.source"), F.col("b.target")).filter("source <> target")
        reach, now = settled_counting(reach.unionByName(longer).distinct(), row_count())
        if now == count:
            return reach
        count = now


def shortcuts(links: DataFrame, times: int = 2, most: int = 64) -> DataFrame:
    """links (source, target) and more: paths of up to 2 ** times links as one.

    Only nodes with few pairs of a link in and a link out are passed by, so that hubs add
    no product of their neighbours.
    """
    now = settled(proper(links))
    for _ in range(times):
        into = now.groupBy(F.col("target").alias("id")).agg(row_count().alias("n"))
        out = now.groupBy(F.col("source").alias("id")).agg(row_count().alias("m"))
        mids = into.join(out, "id").filter(F.col("n") * F.col("m") <= most).select("id")
        start = now.select("source", F.col("target").alias("id")).join(mids, "id")
        longer = start.join(now.select(F.col("source").alias("id"), "target"), "id").select("source", "target")
        now = settled(proper(now.unionByName(longer)))
    return now


class ReachBits:
    """Which of the nodes seeds (id) each node reaches along links, as bits packed in words.

    links have no cycles; sizes: id, size of all nodes.  places: way, id, word, mask of the
    seeds; rows: way, id, word, bits, where a seed has its own bit.  With back, links are
    followed the other way as well.  Words hold seeds of one component of the graph, and each
    component has a hub: what a node reaches through the hub is the hub's own reach, so seeds
    below the hub (odd words) are not pushed to nodes above it.  A round pushes the bits that
    came new in the round before; words without bits have no row.
    """

    def __init__(self, links: DataFrame, seeds: DataFrame, sizes: DataFrame, back: bool = False):
        links = shortcuts(links)
        self.marks = settled(self._marks(links, sizes, back))
        ways = [links.withColumn("way", F.lit(0))] + ([turned(links).withColumn("way", F.lit(1))] if back else [])
        above = self.marks.filter("above").select("way", F.col("id").alias("source"), F.lit(True).alias("cut"))
        links = ways[0].unionByName(ways[1]) if back else ways[0]
        links = settled(links.join(above, ["way", "source"], "left").fillna(False, ["cut"]))
        places = seeds.select("id").distinct().withColumn("way", F.explode(F.array(*(F.lit(w) for w in range(1 + back)))))
        places = places.join(self.marks, ["way", "id"], "left").select("way", "id", "component", F.coalesce("below", F.lit(False)).cast("long").alias("b"))
        # Numbers are dense within a partition, which is all that packing asks for.
        order = ["way", "component", "b", "id"]
        numbers = settled(places.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()))
        mask = F.expr("shiftleft(1L, cast(n % 64 as int))")
        self.places = numbers.select("way", "id", (F.shiftright("n", 6) * 2 + F.col("b")).alias("word"), mask.alias("mask"))
        start = self.places.select("way", "id", "word", F.col("mask").alias("bits"), F.col("mask").alias("fresh"))
        rows, n = settled_counting(start, row_count())
        keys = ["way", "id", "word"]
        while n:
            front = rows.filter("fresh <> 0").select("way", F.col("id").alias("target"), "word", "fresh")
            pushed = links.join(front, ["way", "target"]).filter("not cut or word % 2 = 0")
            pushed = pushed.groupBy("way", F.col("source").alias("id"), "word").agg(F.expr("bit_or(fresh)").alias("came"))
            both = rows.select(*keys, "bits").join(pushed, keys, "full")
            old, came = F.coalesce("bits", F.lit(0)), F.coalesce("came", F.lit(0))
            rows, n = settled_counting(
                both.select(*keys, old.bitwiseOR(came).alias("bits"), came.bitwiseAND(F.bitwise_not(old)).alias("fresh")),
                F.count_if(F.expr("fresh <> 0")),
            )
        self.rows = rows.drop("fresh")

    @staticmethod
    def _marks(links: DataFrame, sizes: DataFrame, back: bool) -> DataFrame:
        """way, id, component, above (reaches the component's hub), below (is reached by it) of nodes with links."""
        ends = links.select("source", "target").withColumn("e", F.expr("array(struct(source as id, 1 as o, 0 as i), struct(target as id, 0 as o, 1 as i))"))
        ends = ends.select(F.explode("e").alias("e")).groupBy("e.id").agg((F.sum("e.o") * F.sum("e.i")).alias("through"))
        part = settled(components(links))
        best = part.join(ends, "id").join(sizes, "id", "left").groupBy("component").agg(F.max(F.struct("size", "through", "id"))["id"].alias("id"))
        # The largest cycle of a component is its hub, else the node that most paths of two links pass.
        tag = lambda df, way: df.select(*(F.struct(F.lit(way).alias("way"), F.col(c).alias("id")).alias(c) for c in ("source", "target")))
        steps = tag(turned(links), 0).unionByName(tag(links, 1))
        starts = best.select(F.explode(F.array(*(F.struct(F.lit(w).alias("way"), "id") for w in (0, 1)))).alias("id"))
        found = levels(steps, starts).select("id.*").groupBy("id").agg(F.count_if(F.col("way") == 0).alias("u"), F.count_if(F.col("way") == 1).alias("d"))
        rows = part.join(found, "id", "left").select("id", "component", F.coalesce(F.col("u") > 0, F.lit(False)).alias("u"), F.coalesce(F.col("d") > 0, F.lit(False)).alias("d"))
        out = rows.select(F.lit(0).alias("way"), "id", "component", F.col("u").alias("above"), F.col("d").alias("below"))
        return out.unionByName(rows.select(F.lit(1).alias("way"), "id", "component", F.col("d").alias("above"), F.col("u").alias("below"))) if back else out

    def sums(self, asked: DataFrame, sizes: DataFrame) -> DataFrame:
        """way, key, reached: sum of the sizes (id, size) of the seeds that any node of a key reaches, itself included.

        asked: way, key, id.
        """
        at = asked.join(self.marks.select("way", "id", "component", "above"), ["way", "id"], "left")
        at = settled(at.select("way", "key", "id", "component", F.coalesce("above", F.lit(False)).alias("above")))
        hubbed = settled(at.filter("above").select("way", "key", "component").distinct())
        seeds = self.places.select("way", "id", "word", "mask").join(sizes, "id")
        below = seeds.filter("word % 2 = 1").join(self.marks.select("way", "id", "component"), ["way", "id"]).groupBy("way", "component").agg(F.sum("size").alias("reached"))
        whole = hubbed.join(below, ["way", "component"]).select("way", "key", "reached")
        near = at.join(hubbed.withColumn("hubbed", F.lit(True)), ["way", "key", "component"], "left")
        bits = near.join(self.rows, ["way", "id"]).filter("hubbed is null or word % 2 = 0")
        bits = settled(bits.groupBy("way", "key", "word").agg(F.expr("bit_or(bits)").alias("bits")))
        large = seeds.filter("size <> 1").select("way", "word", "mask", (F.col("size") - 1).alias("reached"))
        parts = [whole, bits.select("way", "key", F.bit_count("bits").cast("long").alias("reached"))]
        parts.append(bits.join(large, ["way", "word"]).filter("(bits & mask) <> 0").select("way", "key", "reached"))
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("way", "key").agg(F.sum("reached").alias("reached"))

    def reaching(self, pairs: DataFrame, near: str, far: str) -> DataFrame:
        """near, far: the pairs whose near node reaches the far one, which is a seed."""
        asked = pairs.select(near, far).distinct()
        mark = self.marks.filter("way = 0")
        start = mark.filter("above").select(F.col("id").alias(near), F.col("component").alias("_c"))
        end = mark.filter("below").select(F.col("id").alias(far), F.col("component").alias("_d"))
        through = asked.join(start, near).join(end, far).filter("_c = _d").select(near, far)
        places = self.places.filter("way = 0").select(F.col("id").alias(far), F.col("word").alias("_w"), F.col("mask").alias("_m"))
        held = self.rows.filter("way = 0").select(F.col("id").alias(near), F.col("word").alias("_w"), F.col("bits").alias("_b"))
        found = asked.join(places, far).join(held, [near, "_w"]).filter("(_b & _m) <> 0").select(near, far)
        return through.unionByName(found).distinct()


class Condensed:
    """A graph with each cycle as one node: place (id, cycle, size) and links."""

    def __init__(self, edges: DataFrame):
        own = settled(proper(edges))
        cycle = cycles(own)
        ids = both_ways(own).select(F.col("source").alias("id")).distinct()
        place = ids.join(cycle, "id", "left").select("id", F.coalesce("cycle", "id").alias("cycle"))
        sizes = place.groupBy("cycle").agg(row_count().alias("size"))
        self.place = settled(place.join(sizes, "cycle"))
        self.links = settled(condensed(own, cycle))
        self._counts = None

    def cycles(self) -> DataFrame:
        """id, cycle, cycle_size of the members of cycles."""
        return self.place.filter("size > 1").withColumnRenamed("size", "cycle_size")

    def reach_counts(self, nodes: DataFrame) -> DataFrame:
        """id, dependencies, dependents of nodes (id), 0 where isolated."""
        return nodes.select("id").join(self.counts(), "id", "left").fillna(0, ["dependencies", "dependents"])

    def counts(self) -> DataFrame:
        """id, dependencies, dependents of every node with an edge."""
        if self._counts is None:
            sizes = settled(self.place.select(F.col("cycle").alias("id"), "size").distinct())
            asked = sizes.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.col("id").alias("key"), "id")
            reached = ReachBits(self.links, sizes, sizes, back=True).sums(asked, sizes)
            found = reached.groupBy(F.col("key").alias("cycle")).agg(
                F.max(F.when(F.col("way") == 0, F.col("reached"))).alias("f"), F.max(F.when(F.col("way") == 1, F.col("reached"))).alias("b")
            )
            rows = self.place.join(found, "cycle")
            self._counts = settled(rows.select("id", (F.col("f") - 1).alias("dependencies"), (F.col("b") - 1).alias("dependents")))
        return self._counts

    def beyond(self, groups: DataFrame, back: bool = False) -> DataFrame:
        """key, reached: how many nodes outside a group any of its nodes (key, id) reaches, or with back is reached by."""
        sizes = settled(self.place.select(F.col("cycle").alias("id"), "size").distinct())
        members = settled(groups.select("key", "id").distinct().join(self.place.select("id", "cycle"), "id"))
        asked = members.select(F.lit(0).alias("way"), "key", F.col("cycle").alias("id")).distinct()
        reached = ReachBits(turned(self.links) if back else self.links, sizes, sizes).sums(asked, sizes)
        own = members.groupBy("key").agg(row_count().alias("own"))
        return reached.join(own, "key").select("key", (F.col("reached") - F.col("own")).alias("reached"))

    def counted(self, nodes: DataFrame) -> DataFrame:
        """id, reached: how many of nodes (id), itself not counted, reach each node; rows of 0 included."""
        marked = nodes.select("id").distinct().withColumn("own", F.lit(1))
        place = settled(self.place.join(marked, "id", "left").fillna(0, ["own"]))
        sizes = settled(place.select(F.col("cycle").alias("id"), "size").distinct())
        weights = settled(place.groupBy(F.col("cycle").alias("id")).agg(F.sum("own").alias("size")).filter("size > 0"))
        asked = sizes.select(F.lit(0).alias("way"), F.col("id").alias("key"), "id")
        reached = ReachBits(turned(self.links), weights, sizes).sums(asked, weights).withColumnRenamed("key", "cycle")
        rows = place.join(reached, "cycle", "left")
        return rows.select("id", (F.coalesce("reached", F.lit(0)) - F.col("own")).alias("reached"))


def reach_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, dependencies, dependents: sizes of the forward and the backward reach of each node.

    Cycles are condensed first: their members reach each other and the same others.
    """
    return Condensed(edges).reach_counts(nodes)


def unrelated(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (source, target, ...) of which neither end reaches the other."""
    graph = Condensed(edges)
    start = graph.place.select(F.col("id").alias("source"), F.col("cycle").alias("_s"))
    end = graph.place.select(F.col("id").alias("target"), F.col("cycle").alias("_t"))
    rows = pairs.join(start, "source", "left").join(end, "target", "left")
    rows = settled(rows.filter(F.col("_s").isNull() | F.col("_t").isNull() | (F.col("_s") != F.col("_t"))))
    ends = rows.select(F.explode(F.array("_s", "_t")).alias("id")).filter("id is not null").distinct()
    sizes = graph.place.select(F.col("cycle").alias("id"), "size").distinct()
    bits = ReachBits(graph.links, ends, sizes)
    for near, far in (("_s", "_t"), ("_t", "_s")):
        rows = rows.join(bits.reaching(rows, near, far), ["_s", "_t"], "left_anti")
    return rows.select(*pairs.columns)


def levels(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """keys, id, distance: least number of edges from a seed (keys, id); seeds are at 0."""
    names = [*keys, "id"]
    links, found = settled(proper(edges)), Layers(edges.sparkSession, "distance")
    front, n = found.add(seeds.select(*names).distinct(), 0)
    distance = 0
    while n and (most is None or distance < most):
        distance += 1
        step = front.join(links, front["id"] == links["source"]).select(*keys, F.col("target").alias("id")).distinct()
        front, n = found.add(step.join(found.all(), names, "left_anti"), distance)
    return found.all()


def nearest(edges: DataFrame, seeds: DataFrame, most: int = 2, steps: int | None = None) -> DataFrame:
    """seed, id, distance: the nearest seeds (id) that reach each node (in so many steps), at most so many, of equals the least."""
    links, found = settled(proper(edges)), Layers(edges.sparkSession, "distance")
    front, n = found.add(seeds.select(F.col("id").alias("seed"), "id").distinct(), 0)
    distance = 0
    while n and (steps is None or distance < steps):
        distance += 1
        step = front.join(links, front["id"] == links["source"]).select("seed", F.col("target").alias("id")).distinct()
        step = step.join(found.all(), ["seed", "id"], "left_anti")
        step = first_rows(step, ["id"], [F.col("seed")], most)
        held = found.all().groupBy("id").agg(row_count().alias("held"))
        step = step.join(held, "id", "left").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("seed")))
        front, n = found.add(step.filter(F.col("nth") + F.coalesce("held", F.lit(0)) <= most).select("seed", "id"), distance)
    return found.all()


def strides(edges: DataFrame, steps: int, most: int = 8) -> tuple[DataFrame, int]:
    """Paths of up to steps / rounds edges as one link (source, target), and the number of rounds.

    Paths double while steps can be halved and a doubling looks at no more than most paths for each link.
    """
    links, n = settled_counting(proper(edges), row_count())
    while n and steps % 2 == 0:
        into = links.groupBy(F.col("target").alias("id")).agg(row_count().alias("i"))
        out = links.groupBy(F.col("source").alias("id")).agg(row_count().alias("o"))
        if (into.join(out, "id").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0) > most * n:
            break
        longer = links.select("source", F.col("target").alias("id")).join(links.select(F.col("source").alias("id"), "target"), "id")
        links, n = settled_counting(proper(links.unionByName(longer.select("source", "target"))), row_count())
        steps //= 2
    return links, steps


def counted_within(edges: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """id, reached: how many seeds (id), itself not counted, reach each node in at most so many steps; no rows of 0.

    Seeds are bits packed in words of one component of the graph.  A round pushes the bits that came new in the
    round before along strides(): what lies d steps away comes in round d / stride, rounded up, and never sooner.
    """
    links, rounds = strides(edges, steps)
    places = seeds.select("id").distinct().join(components(edges), "id").repartitionByRange("component", "id").sortWithinPartitions("component", "id")
    # Numbers are dense within a partition, which is all that packing asks for.
    numbers = settled(places.select("id", F.monotonically_increasing_id().alias("n")))
    mask = F.expr("shiftleft(1L, cast(n % 64 as int))")
    start = settled(numbers.select("id", F.shiftright("n", 6).alias("word"), mask.alias("bits"), mask.alias("fresh")))
    rows, n, held = start, 1, Rewritten(edges.sparkSession)
    while n and rounds:
        rounds -= 1
        front = rows.filter("fresh <> 0").select(F.col("id").alias("source"), "word", "fresh")
        pushed = links.join(front, "source").groupBy(F.col("target").alias("id"), "word").agg(F.expr("bit_or(fresh)").alias("came"))
        both = rows.select("id", "word", "bits").join(pushed, ["id", "word"], "full")
        old, came = F.coalesce("bits", F.lit(0)), F.coalesce("came", F.lit(0))
        rows, n = held.write(
            both.select("id", "word", old.bitwiseOR(came).alias("bits"), came.bitwiseAND(F.bitwise_not(old)).alias("fresh")),
            F.count_if(F.expr("fresh <> 0")),
        )
    own = start.select("id", F.lit(-1).cast("long").alias("reached"))
    counts = rows.select("id", F.bit_count("bits").cast("long").alias("reached")).unionByName(own)
    return counts.groupBy("id").agg(F.sum("reached").alias("reached")).filter("reached > 0")


def least_paths(edges: DataFrame, seeds: DataFrame, most: int = 12) -> DataFrame:
    """id, distance, path: the shortest path from any seed (id), of equals the least as a list."""
    links, found = settled(proper(edges)), Layers(edges.sparkSession, "distance")
    front, n = found.add(seeds.select("id").distinct().select("id", F.array("id").alias("path")), 0)
    distance = 0
    while n and distance < most:
        distance += 1
        step = (
            front.join(links, front["id"] == links["source"])
            .select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
            .groupBy("id")
            .agg(F.min("path").alias("path"))
        )
        front, n = found.add(step.join(found.all().select("id"), "id", "left_anti"), distance)
    return found.all()


def _trim(edges: DataFrame) -> DataFrame:
    return edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(
        edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi"
    ).select("source", "target")


def trimmed(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """Edges left, and their number, without nodes that have no edge in or no edge out, again and again."""
    left, count = settled_counting(proper(edges), row_count())
    while count and most != 0:
        most = None if most is None else most - 1
        left, now = settled_counting(_trim(_trim(left)), row_count())
        if now == count:
            break
        count = now
    return left, count


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """short, chains, rings: edges with chains drawn together; proper edges are expected.

    A link is a node with one edge in and one out.  short: source, target between other
    nodes, with chains of links as one edge; chains: id, before, after of the links between
    them; rings: id, cycle of links that lead only to each other.  Pointers double, so the
    rounds are logarithmic in the longest chain.
    """
    out = edges.groupBy(F.col("source").alias("id")).agg(row_count().alias("n"), F.min("target").alias("after"))
    into = edges.groupBy(F.col("target").alias("id")).agg(row_count().alias("n"), F.min("source").alias("before"))
    links = out.filter("n = 1").select("id", "after").join(into.filter("n = 1").select("id", "before"), "id")
    pointers, links_left = settled_counting(links.withColumn("least", F.col("id")), row_count())
    moving, same = links_left, 0
    # Only rings keep their number: they are done when as many steps as they can have are doubled.
    while moving and 1 << same <= moving:
        ahead = pointers.select(F.col("id").alias("after"), F.col("after").alias("a"), F.col("least").alias("al"))
        back = pointers.select(F.col("id").alias("before"), F.col("before").alias("b"), F.col("least").alias("bl"))
        rows = pointers.join(ahead, "after", "left").join(back, "before", "left")
        rows = rows.select(
            "id",
            F.coalesce("a", "after").alias("after"),
            F.coalesce("b", "before").alias("before"),
            F.least("least", "al", "bl").alias("least"),
            (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("moved"),
        )
        pointers, now = settled_counting(rows, F.count_if("moved"))
        pointers, moving, same = pointers.drop("moved"), now, same + 1 if now == moving else 0
    inner = pointers.select(F.col("id").alias("after"))
    rings = pointers.join(inner, "after", "left_semi").select("id", F.col("least").alias("cycle"))
    chains = pointers.join(inner, "after", "left_anti").select("id", "before", "after")
    ends = pointers.select(F.col("id").alias("target"), "after")
    short = (
        edges.join(pointers.select(F.col("id").alias("source")), "source", "left_anti")
        .join(ends, "target", "left")
        .select("source", F.coalesce("after", "target").alias("target"))
        .distinct()
    )
    return settled(short), chains, rings


def cycles(edges: DataFrame, contractions: int = 3) -> DataFrame:
    """id, cycle: members of strongly connected components of two nodes and more; cycle is their least id.

    Chains are contracted and nodes outside cycles are trimmed, in turns.  Where at most SMALL_EDGES are
    left, one task finishes them; otherwise each round spreads least labels forward, and the nodes from which a label's owner is reached back make up its component.
    """
    own = settled(proper(edges))
    if not contractions:
        return _coloured(*trimmed(own))
    short, chains, rings = contracted(own)
    left, count = trimmed(short, TRIMS)
    if count > SMALL_EDGES:
        found = cycles(left, contractions - 1)
    else:
        found = _coloured(left, count)
    loops = short.filter("source = target").select(F.col("source").alias("id"), F.col("source").alias("cycle"))
    found = settled(found.unionByName(loops.join(found.select("id"), "id", "left_anti")))
    start = found.select(F.col("id").alias("before"), F.col("cycle").alias("s"))
    end = found.select(F.col("id").alias("after"), F.col("cycle").alias("t"))
    inside = chains.join(start, "before").join(end, "after").filter("s = t").select("id", F.col("s").alias("cycle"))
    whole = found.unionByName(inside)
    least = whole.groupBy("cycle").agg(F.min("id").alias("least"))
    named = whole.join(least, "cycle").select("id", F.col("least").alias("cycle"))
    return settled(named.unionByName(rings))


def _mutual(edges):
    """id, cycle of at most SMALL_EDGES edges: what a node reaches and is reached by, node by node."""
    import pandas as pd

    out, back, found = {}, {}, {}
    for s, t in zip(edges["source"], edges["target"]):
        out.setdefault(s, []).append(t)
        back.setdefault(t, []).append(s)

    def reached(links, start):
        seen, front = {start}, [start]
        while front:
            front = [t for s in front for t in links.get(s, ()) if t not in found and not (t in seen or seen.add(t))]
        return seen

    for node in sorted(set(out) & set(back)):
        if node not in found:
            found.update(dict.fromkeys(reached(out, node) & reached(back, node), node))
    return pd.DataFrame(found.items(), columns=["id", "cycle"]).astype({c: edges["source"].dtype for c in ("id", "cycle")})


def _coloured(left: DataFrame, count: int) -> DataFrame:
    parts = []
    while count > SMALL_EDGES:
        colour = _spread(left)
        inside = left.join(colour.withColumnRenamed("id", "source"), "source").withColumnRenamed("label", "from_label")
        inside = inside.join(colour.withColumnRenamed("id", "target"), "target").filter("from_label = label")
        owners = colour.filter("id = label").select("id")
        part = settled(levels(turned(inside), owners).join(colour, "id").select("id", F.col("label").alias("cycle")))
        parts.append(part)
        left, count = trimmed(
            left.join(part.select(F.col("id").alias("source")), "source", "left_anti").join(
                part.select(F.col("id").alias("target")), "target", "left_anti"
            )
        )
    kind = left.schema["source"].dataType.simpleString()
    found = left.groupBy(F.lit(0).alias("all")).applyInPandas(_mutual, f"id {kind}, cycle {kind}")
    for part in parts:
        found = found.unionByName(part)
    real = found.groupBy("cycle").agg(row_count().alias("n")).filter("n > 1").select("cycle")
    return settled(found.join(real, "cycle").select("id", "cycle"))


def _spread(edges: DataFrame) -> DataFrame:
    """id, label: the least node that reaches each node (itself included).

    Only nodes whose label changed push it on.
    """
    ids = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    label, changed = settled_counting(ids.select("id", F.col("id").alias("label"), F.lit(True).alias("new")), row_count())
    while changed:
        front = label.filter("new").select(F.col("id").alias("source"), F.col("label").alias("pushed"))
        pushed = edges.join(front, "source").groupBy(F.col("target").alias("id")).agg(F.min("pushed").alias("pushed"))
        lower = F.coalesce(F.col("pushed") < F.col("label"), F.lit(False))
        rows = label.join(pushed, "id", "left").select(
            "id", F.when(lower, F.col("pushed")).otherwise(F.col("label")).alias("label"), lower.alias("new")
        )
        label, changed = settled_counting(rows, F.count_if("new"))
    return label.select("id", "label")


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id) of every node that has an edge, edges read both ways.

    Labels start as ids.  In each round a node offers the least label around it to itself
    and to the owner of its label, then every label is replaced by its owner's: rounds
    grow with the logarithm of the longest path, one job each.
    """
    links = settled(both_ways(proper(edges)).distinct())
    ids = links.select(F.col("source").alias("id")).distinct()
    label, changed = settled_counting(ids.select("id", F.col("id").alias("label"), F.lit(True).alias("new")), row_count())
    while changed:
        label = label.select("id", "label")
        around = (
            links.join(label.withColumnRenamed("id", "source"), "source")
            .groupBy(F.col("target").alias("id"))
            .agg(F.min("label").alias("least"))
        )
        offers = label.join(around, "id").select(
            F.explode(F.array(F.struct("id", "least"), F.struct(F.col("label").alias("id"), "least"))).alias("o")
        )
        lowest = offers.groupBy("o.id").agg(F.min("o.least").alias("least"))
        hooked = label.join(lowest, "id").select("id", F.least("label", "least").alias("to"), F.col("label").alias("old"))
        owner = hooked.select(F.col("id").alias("to"), F.col("to").alias("label"))
        rows = hooked.join(owner, "to").select("id", "label", (F.col("label") < F.col("old")).alias("new"))
        label, changed = settled_counting(rows, F.count_if("new"))
    return label.select("id", F.col("label").alias("component"))


def condensed(edges: DataFrame, cycle: DataFrame) -> DataFrame:
    """source, target: distinct edges between components; cycle: id, cycle."""
    start = cycle.select(F.col("id").alias("source"), F.col("cycle").alias("s"))
    end = cycle.select(F.col("id").alias("target"), F.col("cycle").alias("t"))
    joined = proper(edges).join(start, "source", "left").join(end, "target", "left")
    return proper(
        joined.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"))
    )


def depths(edges: DataFrame) -> DataFrame:
    """id, depth: edges on the longest path that leaves a node; members of a cycle share its depth.

    Depth is defined on the condensed graph, where it cannot depend on an order of visits.
    """
    cycle = cycles(edges)
    links = settled(condensed(edges, cycle))
    ends = both_ways(proper(edges)).select(F.col("source").alias("id")).distinct().join(cycle, "id", "left")
    ids = ends.select(F.coalesce("cycle", "id").alias("id")).distinct()
    front, n = settled_counting(ids.select("id", F.lit(0).cast("long").alias("depth"), F.lit(True).alias("new")), row_count())
    found = front
    while n:
        step = (
            links.join(found.filter("new"), links["target"] == found["id"])
            .groupBy(F.col("source").alias("id"))
            .agg((F.max("depth") + 1).alias("up"))
        )
        higher = F.coalesce(F.col("up") > F.col("depth"), F.lit(False))
        rows = found.join(step, "id", "left").select(
            "id", F.when(higher, F.col("up")).otherwise(F.col("depth")).alias("depth"), higher.alias("new")
        )
        found, n = settled_counting(rows, F.count_if("new"))
    members = cycle.join(found.withColumnRenamed("id", "cycle"), "cycle").select("id", "depth")
    alone = found.join(cycle.select("id"), "id", "left_anti").select("id", "depth")
    return alone.unionByName(members)
