"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. Every text is read once; (doc_id, fingerprint, SHA-256) goes to a shared table.
2. Senders (blocks of that table) sort their distinct fingerprints and send each
   owner its share as Golomb-Rice coded gaps.  A fingerprint leaves a sender once,
   however many copies it stands for.
3. Owners decode the messages and answer each with a bitmap: bit i says that the
   i-th fingerprint of the message occurs more than once overall.
4. Senders turn bitmaps into suspect rows.  Only texts of suspects are shuffled,
   grouped by their bytes, to prove that equal digests mean equal texts.

Defined results: null text counts as empty; empty texts equal each other; of rows
with one doc_id and one text exactly one is kept; a null doc_id sorts below all
others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import numbered, row_type, small_batches, stored, text_bytes

SENDER_ROWS = 1 << 20
OWNER_ROWS = 1 << 21
FINGERPRINT_BITS = 48
FILTER_BITS = 1 << 22
HOT_SHARE = 1000

MESSAGE = "owner long, sender long, n long, rice long, unary binary, low binary, repeated binary"
BITMAP = "owner long, sender long, bits binary"


def rice_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of non-negative gaps: parameter, unary part, low bits."""
    mean = max(1.0, float(gaps.mean(dtype=np.float64)))
    rice = max(0, int(np.log2(mean)), int(gaps.max()).bit_length() - 12)
    ends = np.cumsum((gaps >> np.uint64(rice)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    shifts = np.arange(rice - 1, -1, -1, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return rice, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def rice_decode(n: int, rice: int, unary: bytes, low: bytes) -> np.ndarray:
    """The gaps that rice_encode coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    high = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * rice).reshape(n, rice)
    weights = np.uint64(1) << np.arange(rice - 1, -1, -1, dtype=np.uint64)
    return (high << np.uint64(rice)) + (bits.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)


def _digests(fingerprint_bits: int):
    mask = (1 << fingerprint_bits) - 1

    def run(batches):
        for batch in batches:
            prints, digests = [], []
            for text in text_bytes(batch.column("text")):
                norm = text.lower()
                prints.append(xxhash.xxh3_64_intdigest(norm) & mask)
                digests.append(hashlib.sha256(norm).digest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(prints, pa.int64()),
                    pa.array(digests, pa.binary()),
                    batch.column("row"),
                ],
                names=["doc_id", "print", "digest", "row"],
            )

    return run


def _send(owners: int):
    def run(key, table):
        values, counts = np.unique(table.column("print").to_numpy().astype(np.uint64), return_counts=True)
        owner_of = values % np.uint64(owners)
        rows = []
        for owner in np.unique(owner_of):
            mine = owner_of == owner
            gaps = np.diff(values[mine] // np.uint64(owners), prepend=np.uint64(0))
            rice, unary, low = rice_encode(gaps)
            repeated = np.packbits(counts[mine] > 1).tobytes()
            rows.append((int(owner), key[0].as_py(), len(gaps), rice, unary, low, repeated))
        names = ["owner", "sender", "n", "rice", "unary", "low", "repeated"]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _own(key, table):
    """Bitmaps that answer the messages of one owner."""
    messages = table.to_pylist()
    values = [np.cumsum(rice_decode(m["n"], m["rice"], m["unary"], m["low"])) for m in messages]
    again = [np.unpackbits(np.frombuffer(m["repeated"], np.uint8), count=m["n"]) for m in messages]
    _, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    known = counts > 1
    np.logical_or.at(known, inverse, np.concatenate(again).astype(bool))
    flags = np.split(known[inverse], np.cumsum([len(v) for v in values])[:-1])
    return pa.table(
        [
            pa.array([m["owner"] for m in messages], pa.int64()),
            pa.array([m["sender"] for m in messages], pa.int64()),
            pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
        ],
        names=["owner", "sender", "bits"],
    )


def _receive(owners: int):
    def run(key, rows, bitmaps):
        prints = rows.column("print").to_numpy().astype(np.uint64)
        values = np.unique(prints)
        owner_of, hit = values % np.uint64(owners), np.zeros(len(values), bool)
        for m in bitmaps.to_pylist():
            mine = np.flatnonzero(owner_of == np.uint64(m["owner"]))
            hit[mine] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=len(mine)).astype(bool)
        return rows.select(["row", "doc_id", "print", "digest"]).filter(pa.array(np.isin(prints, values[hit])))

    return run


def _suspect_texts(fingerprint_bits: int, filter_words: bytes):
    mask = (1 << fingerprint_bits) - 1
    words = np.frombuffer(filter_words, np.uint8)

    def run(batches):
        for batch in batches:
            texts, digests = [], []
            for text in text_bytes(batch.column("text")):
                norm = text.lower()
                slot = (xxhash.xxh3_64_intdigest(norm) & mask) % FILTER_BITS
                if words[slot >> 3] >> (slot & 7) & 1:
                    texts.append(norm)
                    digests.append(hashlib.sha256(norm).digest())
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["digest", "norm"]
                )

    return run


def _filter(suspects: DataFrame) -> bytes:
    """A bit for each suspect fingerprint modulo FILTER_BITS: at most 512 KiB, whatever the input.

    A full filter lets more texts through to the byte check; it drops none.
    """
    slot = F.col("print") % FILTER_BITS
    found = (
        suspects.groupBy(F.shiftright(slot, 5).cast("int").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast(print % {FILTER_BITS} % 32 as int)))").alias("bits"))
        .toArrow()
    )
    words = np.zeros(FILTER_BITS // 32, "<u4")
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return words.tobytes()


def classes(docs: DataFrame, fingerprint_bits: int = FINGERPRINT_BITS, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, row: one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z.  docs: doc_id, text and, if
    named, a column of row numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    number = F.col(row) if row else F.monotonically_increasing_id()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", number.alias("row"))
    marked = stored(
        texts.mapInArrow(_digests(fingerprint_bits), f"doc_id long, print long, digest binary, row {row_type(docs, row)}"),
        "fingerprints",
    )
    total = marked.count()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    senders = max(width, -(-total // SENDER_ROWS))
    owners = max(width, -(-total // OWNER_ROWS))
    sent = marked.withColumn("sender", F.pmod(F.xxhash64("row"), F.lit(senders)))
    messages = sent.select("sender", "print").groupBy("sender").applyInArrow(_send(owners), MESSAGE)
    bitmaps = messages.groupBy("owner").applyInArrow(_own, BITMAP)
    suspects = stored(
        sent.groupBy("sender")
        .cogroup(bitmaps.groupBy("sender"))
        .applyInArrow(_receive(owners), f"row {row_type(docs, row)}, doc_id long, print long, digest binary"),
        "suspects",
    )
    checked = (
        texts.select("text")
        .mapInArrow(_suspect_texts(fingerprint_bits, _filter(suspects)), "digest binary, norm binary")
        .groupBy("digest", "norm")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    clashes = checked.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    if clashes.take(1):
        raise ValueError("two different texts share a SHA-256 digest")
    return _decide(marked, suspects, total)


def _decide(marked: DataFrame, suspects: DataFrame, total: int) -> DataFrame:
    """Join the rows with their groups; groups above a thousandth of the rows are broadcast.

    There are at most HOT_SHARE such groups, so the broadcast is bounded, and no key of
    the shuffled join holds more than a thousandth of the rows.
    """
    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = suspects.groupBy("digest").agg(best, F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = stored(groups, "groups")
    hot_size = max(1, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col("size") > hot_size))
    rest = marked.join(hot.select("digest"), "digest", "left_anti").join(
        groups.filter(F.col("size") <= hot_size), "digest", "left"
    )
    rows = marked.join(hot, "digest").unionByName(rest)
    alone = F.col("best").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "digest",
        "row",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of equal texts; columns unchanged.

    Rows are told apart by identities that stay, so repeated and null doc_ids lose no text.
    """
    rows, row = numbered(docs)
    gone = classes(rows, row=row).filter(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
