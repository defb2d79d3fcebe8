"""Filter interaction audit: what each filter removes, in every order, from a packed bitmap index.

One pass over the texts marks which filters fail each row and gives a digest of its text;
the smallest doc_id of each digest decides the duplicate filter.  Every partition then packs
the marks of each part into bitsets, one for each filter and label, and counts for each
subset of filters (those applied before) and each filter after it: rows removed are the
filter's bits AND NOT those of the subset.  Partition counts are added up: 80 numbers of
each kind for each part, however many rows there are.  The 120 orders read their steps
from these counts.

Defined results: null text counts as empty, null part as the empty string; texts are equal
when their SHA-256 is; a null doc_id has no smaller one, is smaller than none and has no
labels; repeated rows count each, and are no duplicates of rows with the same doc_id; a
label holds if any of the doc_id's label rows has it; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import small_batches, stored, text_bytes
from lodegraph.llm.grouping import join_groups

FILTERS = "ABCDE"
HELD_PARTS = 256
_KINDS = ("rows_left", "removed", "failing", "good_lost", "toxic_lost")
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_FOLLOWING = bytes(range(128, 192))


def marks(text: bytes) -> int:
    """Bits 0 to 3: the text fails filter A, B, C, D."""
    words = text.split()
    points = len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * capitals > 10 * points) << 2
        | any(symbol in text for symbol in _SYMBOLS) << 3
    )


def _marked(batches):
    for batch in batches:
        texts = list(text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("part"),
                pa.array([marks(t) for t in texts], pa.int32()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ],
            names=["doc_id", "part", "fails", "digest"],
        )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits 0 to 4: filters A to E; 5: good; 6: toxic) for each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("part")
    )
    rows = stored(rows.mapInArrow(_marked, "doc_id long, part string, fails int, digest binary"), "marks")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    copies = stored(copies.filter("size > 1"), "copies")
    rows = join_groups(rows, copies, "digest", "size", rows.count())
    rows = rows.withColumn("fails", F.expr("fails + if(doc_id > least, 16, 0)"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.expr("if(quality = 1, 32, 0)")).alias("good"), F.max(F.expr("if(toxic = 1, 64, 0)")).alias("toxic")
    )
    known = stored(known.select("doc_id", (F.col("good") + F.col("toxic")).alias("label")).filter("label > 0"), "known")
    return rows.join(known, "doc_id", "left").selectExpr("part", "fails + coalesce(label, 0) as fails")


def _popcount(packed: np.ndarray) -> int:
    return int(np.bitwise_count(packed).sum(dtype=np.int64))


def counts(fails: np.ndarray) -> np.ndarray:
    """Counts by subset of filters applied before, filter, and kind, for the rows of one part."""
    bits = np.packbits((fails[None, :] >> np.arange(7)[:, None]) & 1, axis=1)
    every = np.packbits(np.ones(len(fails), np.uint8))
    out = np.zeros((32, 5, len(_KINDS)), np.int64)
    for before in range(32):
        gone = np.zeros_like(every)
        for f in range(5):
            if before >> f & 1:
                gone |= bits[f]
        for f in range(5):
            if not before >> f & 1:
                here = bits[f] & ~gone
                out[before, f] = (
                    _popcount(every & ~(gone | bits[f])),
                    _popcount(here),
                    _popcount(bits[f]),
                    _popcount(here & bits[5]),
                    _popcount(here & bits[6]),
                )
    return out


def _index(batches):
    """Counts of each part of a partition; parts beyond HELD_PARTS are handed on as they come."""
    held: dict[str, np.ndarray] = {}

    def out():
        parts = list(held)
        before, f = (x.ravel() for x in np.indices((32, 5)))
        free = (before >> f & 1) == 0
        values = np.stack([held[p][before[free], f[free]] for p in parts]).reshape(-1, len(_KINDS))
        held.clear()
        n = int(free.sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(parts, object), n), pa.string()),
                pa.array(np.tile(before[free], len(parts)), pa.int32()),
                pa.array(np.tile(f[free], len(parts)), pa.int32()),
                *(pa.array(values[:, k]) for k in range(len(_KINDS))),
            ],
            names=["part", "before", "filter", *_KINDS],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("part").dictionary_encode()
        at, fails = codes.indices.to_numpy(), batch.column("fails").to_numpy()
        order = np.argsort(at, kind="stable")
        groups = np.split(fails[order], np.flatnonzero(np.diff(at[order])) + 1)
        for part, rows in zip(codes.dictionary.to_pylist(), groups):
            held[part] = held.get(part, 0) + counts(rows)
            if len(held) >= HELD_PARTS:
                yield out()
    if held:
        yield out()


def orders() -> list[tuple]:
    """(filter_order, step, letter, filter, filters before as a bit set) of all steps of all orders."""
    out = []
    for order in itertools.permutations(range(5)):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order):
            out.append((name, step + 1, f, before))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; docs: doc_id, text, lang; labels: doc_id, quality, toxic."""
    kinds = ", ".join(f"{k} long" for k in _KINDS)
    parts = failures(docs, labels).mapInArrow(_index, f"part string, before int, filter int, {kinds}")
    index = stored(parts.groupBy("part", "before", "filter").agg(*(F.sum(k).alias(k) for k in _KINDS)), "index")
    # A filter comes right behind the set S in |S|! (4 - |S|)! orders.
    weights = F.create_map(*(F.lit(x) for b in range(32) for x in (b, factorial(b.bit_count()) * factorial(max(0, 4 - b.bit_count())))))
    sums = index.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * weights[F.col("before")]).alias("shapley"),
        F.max(F.expr("if(before + shiftleft(1, filter) = 31, removed, null)")).alias("unique_fails"),
    )
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, filter int, before int")
    return (
        index.join(sums, ["part", "filter"])
        .join(F.broadcast(steps), ["before", "filter"])
        .select(
            "part",
            "filter_order",
            "step",
            F.col("rows_left").alias("kept"),
            "removed",
            (F.col("failing") - F.col("removed")).alias("redundant"),
            "unique_fails",
            "good_lost",
            "toxic_lost",
            F.col("shapley").cast("long").alias("shapley"),
        )
    )


SQL = r"""
with base as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
     flags as (select doc_id, part, len(words) < 100 as a,
                      100 * len(list_distinct(words)) < 80 * len(words) as b,
                      100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) as c,
                      regexp_matches(text, '[#$%&*|]') as d,
                      coalesce(doc_id > min(doc_id) over (partition by text), false) as e from base),
     known as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
     r as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as fails,
                  coalesce(good, false) as good, coalesce(toxic, false) as toxic
           from flags left join known using (doc_id)),
     g as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
           from r group by part, fails),
     l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
     o as (select p.x || q.x || s.x || t.x || u.x as filter_order from l p, l q, l s, l t, l u
           where p.bit + q.bit + s.bit + t.bit + u.bit = 31 and (p.bit | q.bit | s.bit | t.bit | u.bit) = 31),
     steps as (select filter_order, step, bit, coalesce((select sum(l2.bit) from l l2
                      where position(l2.x in filter_order) < step), 0)::int as before
               from o, range(1, 6) as k(step), l where l.x = substr(filter_order, step, 1)),
     found as (select part, filter_order, step, bit,
                      coalesce(sum(n) filter (fails & (before | bit) = 0), 0) as kept,
                      coalesce(sum(n) filter (fails & bit > 0 and fails & before = 0), 0) as removed,
                      coalesce(sum(n) filter (fails & bit > 0 and fails & before > 0), 0) as redundant,
                      coalesce(sum(n) filter (fails = bit), 0) as unique_fails,
                      coalesce(sum(good) filter (fails & bit > 0 and fails & before = 0), 0) as good_lost,
                      coalesce(sum(toxic) filter (fails & bit > 0 and fails & before = 0), 0) as toxic_lost
               from g, steps group by part, filter_order, step, bit)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from found"""
