"""SimHash near duplicates found through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments.  Of two fingerprints that differ
in at most three bits, one segment differs in at most one bit, so both carry an equal
variant of it in which that bit is a wildcard.  Each distinct fingerprint is indexed
under its 64 variants; rows with an equal variant meet in one run of a sorted
partition and are verified there.  A run emits a spanning star of its linked
fingerprints, never all its pairs.  Runs above RUN_ROWS are cut again by the variants
of their 33 open bits: at most 2**18 fingerprints then share a key, whatever the input.

Defined results: null text counts as empty; texts without words have fingerprint zero
and link like any other; rows may repeat; a null doc_id takes part and is the last
choice as component id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import numbered, row_type, small_batches, stored, text_bytes
from lodegraph.llm.grouping import components, join_groups

SHINGLE_WORDS = 5
DISTANCE = 3
SEED = 42
RUN_ROWS = 4096
LINKS = "kind int, a long, b long"


def fingerprint(text: bytes, shingle_words: int) -> int:
    """SimHash of lower-cased word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), min(shingle_words, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[s:e], SEED) for s, e in zip(starts.tolist(), ends)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle_words: int):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, shingle_words) for t in text_bytes(batch.column("text"))]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(signed, pa.int64()), batch.column("row")],
                names=["doc_id", "print", "row"],
            )

    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, row: str | None = None) -> DataFrame:
    """doc_id, print, row: the fingerprint of every row as a signed long.

    row: the column of row numbers, if docs has one.
    """
    small_batches(docs.sparkSession)
    number = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", number.alias("row")).mapInArrow(
        _fingerprints(shingle_words), f"doc_id long, print long, row {row_type(docs, row)}"
    )


def local_roots(prints: np.ndarray, distance: int) -> np.ndarray:
    """For each of the fingerprints the smallest position linked to it through others."""
    label, before = np.arange(len(prints)), None
    step = max(1, (1 << 20) // len(prints))
    while before is None or not np.array_equal(before, label):
        before = label
        near = [
            np.where(
                np.bitwise_count(prints[i : i + step, None] ^ prints[None, :]) <= distance, label[None, :], len(prints)
            ).min(axis=1)
            for i in range(0, len(prints), step)
        ]
        label = np.concatenate(near)
        label = label[label]
    return label


def _verify(distance: int, run_rows: int | None):
    """Links of each run of equal keys; runs above run_rows are handed on (kind 1)."""

    def links(prints):
        if len(prints) == 2:
            if int(prints[0] ^ prints[1]).bit_count() > distance:
                return None
            root = np.array([0, 0])
        else:
            root = local_roots(prints, distance)
        other = root != np.arange(len(prints))
        return (prints[other].view(np.int64), prints[root[other]].view(np.int64)) if other.any() else None

    def batch_of(kind, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"]
        )

    def run(batches):
        held_key, held, large = None, [], False
        for batch in batches:
            keys = batch.column("key").to_numpy()
            prints = batch.column("print").to_numpy().astype(np.int64).view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            out_a, out_b = [], []
            single = ends - starts == 1
            last = len(starts) - 1
            for i in np.flatnonzero(~single | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == last)).tolist():
                key, part = int(keys[starts[i]]), prints[starts[i] : ends[i]]
                if key != held_key:
                    if held and not large and (found := links(np.concatenate(held))):
                        out_a.append(found[0])
                        out_b.append(found[1])
                    held_key, held, large = key, [], False
                held.append(part)
                if run_rows and (large or sum(map(len, held)) > run_rows):
                    whole = np.concatenate(held).view(np.int64)
                    yield batch_of(1, np.full(len(whole), key), whole)
                    held, large = [], True
            if out_a:
                yield batch_of(0, np.concatenate(out_a), np.concatenate(out_b))
        if held and not large and (found := links(np.concatenate(held))):
            yield batch_of(0, *found)

    return run


def _variants(prints: DataFrame) -> DataFrame:
    """key, print: 64 one-wildcard variants; bits 0-31 the rest of a segment, 32-37 which."""
    key = """explode(transform(sequence(0, 63), i ->
        shiftleft(cast(i as long), 32)
        | (shiftright(print, if(i < 32, 0, 32)) & 4294967295L & ~shiftleft(1L, i % 32)))) as key"""
    return prints.selectExpr(key, "print")


def _open_variants(runs: DataFrame) -> DataFrame:
    """Variants of what a large run leaves open: the other segment, cut in two, one bit wild.

    The bit that the run's own key leaves open lies in the half that keeps all its bits free.
    """
    other = "shiftright(b, if(shiftright(a, 32) < 32, 32, 0)) & 4294967295L"
    key = f"""explode(transform(sequence(0, 31), i -> xxhash64(a, i,
        ({other}) & if(i < 16, 65535L, 4294901760L) & ~shiftleft(1L, i)))) as key"""
    return runs.selectExpr(key, "b as print")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: a spanning set of the links between the distinct fingerprints (column print)."""
    if distance != DISTANCE:
        raise ValueError("two segments with one wildcard cover a distance of 3")

    def meet(pairs: DataFrame, run_rows: int | None) -> DataFrame:
        return (
            pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(distance, run_rows), LINKS)
        )

    found = stored(meet(_variants(prints), RUN_ROWS), "links")
    more = meet(_open_variants(found.filter("kind = 1")), None)
    return found.filter("kind = 0").unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, row: str | None = None) -> DataFrame:
    """doc_id, print, component_id, row, kept: one row for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most DISTANCE bits;
    kept holds for one row of each component, of those with that doc_id the first.
    """
    marked = stored(fingerprints(docs, shingle_words, row), "fingerprints")
    total = marked.count()
    groups = stored(
        marked.groupBy("print").agg(
            F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("least"),
            F.count(F.lit(1)).alias("size"),
        ),
        "distinct",
    )
    member = components(links(groups.select("print"))).withColumnRenamed("node", "print")
    rooted = groups.join(member, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    placed = rooted.drop("least").join(least, "root").select("print", "size", "first")
    return join_groups(marked, placed, "print", "size", total).select(
        "doc_id",
        "print",
        F.col("first.doc_id").alias("component_id"),
        "row",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each component, of the smallest doc_id; columns unchanged.

    Rows are told apart by identities that stay; rows without doc_id are the last choice.
    """
    rows, row = numbered(docs)
    gone = near_duplicates(rows, shingle_words, row).filter("not kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
