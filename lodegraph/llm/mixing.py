"""Mixing sources to target weights by blocks, multinomial draws and index permutations.

The words of a source, documents in a fixed order, form one stream cut into blocks of
BLOCK_WORDS.  Every output shard draws a multinomial count of slots for each source;
the i-th slot of a source reads the block that a pseudorandom permutation of its block
numbers gives i (a new permutation in each pass over the source).  Slots and blocks
meet in an equality join on (source, block).

Draws use what each source has left to give, so the counts of all shards add up to
the source's quota; the last slot of a source may be cut to fewer words.

Defined results: null text has size 0 and none of it is taken; the null source comes
last; repeated rows are separate documents; sources without words get a target of 0;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import numbered, row_type, small_batches, stored, text_bytes

BLOCK_WORDS = 256
SHARD_SLOTS = 1 << 14
MOST_SHARDS = 10_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKET_ROWS = 50_000
SEED = 20_240_501


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> list[float]:
    """Word targets of sources in order: weights repeat, no target above epochs times a size."""
    weight = np.resize(np.array(weights, float), len(sizes))
    most = epochs * np.array(sizes, float)
    total, full = share * float(sum(sizes)), np.zeros(len(sizes), bool)
    while True:
        open_ = ~full
        target = most.copy()
        if open_.any():
            target[open_] = weight[open_] * ((total - most[full].sum()) / weight[open_].sum())
        above = open_ & (target > most)
        if not above.any():
            return target.tolist()
        full |= above


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def permute(at: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Image of each index at < n under the permutation of range(n) that key names.

    A four-round Feistel network over the next even power of two; images outside
    range(n) are sent through it again.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = at.astype(np.uint64).copy(), np.arange(len(at))
    while len(left):
        h, m, k = half[left], mask[left], key[left].astype(np.uint64)
        high, low = out[left] >> h, out[left] & m
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            seen = high if back else low
            mixed = (seen + k) * _MIX[0] + np.uint64((r * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1]
            mixed = (mixed ^ (mixed >> np.uint64(32))) & m
            high, low = (low ^ mixed, high) if back else (low, high ^ mixed)
        out[left] = (high << h) | low
        left = left[out[left] >= n[left].astype(np.uint64)]
    return out.astype(np.int64)


def _pass_key(source: int, epoch: int) -> int:
    return zlib.crc32(f"{SEED}:{source}:{epoch}".encode())


def quotas(sizes: list[int], wanted: list[float], block_words: int) -> list[tuple[int, int, int]]:
    """(blocks, slots, words of the last slot) of each source."""
    out = []
    for source, (size, target) in enumerate(zip(sizes, wanted)):
        if not size:
            out.append((0, 0, 0))
            continue
        blocks, words = -(-size // block_words), min(int(round(target)), MOST_EPOCHS * size)
        epochs, rest = divmod(words, size)
        if not rest:
            tail_at = _tail_words(source, epochs - 1, blocks, blocks - 1, size, block_words) if epochs else 0
            out.append((blocks, epochs * blocks, tail_at))
            continue
        tail = size - (blocks - 1) * block_words
        one = np.array([blocks - 1]), np.array([blocks]), np.array([_pass_key(source, epochs)])
        short_at = int(permute(*one, back=True)[0])
        slots = -(-rest // block_words)
        if short_at < slots:
            slots = -(-(rest + block_words - tail) // block_words)
        before = (slots - 1) * block_words - (block_words - tail if short_at < slots - 1 else 0)
        out.append((blocks, epochs * blocks + slots, rest - before))
    return out


def _tail_words(source: int, epoch: int, blocks: int, position: int, size: int, block_words: int) -> int:
    image = int(permute(np.array([position]), np.array([blocks]), np.array([_pass_key(source, epoch)]))[0])
    return size - image * block_words if image == blocks - 1 else block_words


def draws(slots: list[int], shard_slots: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): multinomial counts out of what sources have left."""
    rest, given, rows, shard = np.array(slots, np.int64), np.zeros(len(slots), np.int64), [], 0
    while rest.sum():
        rng, size = np.random.default_rng([SEED, shard]), int(min(shard_slots, rest.sum()))
        counts = np.zeros_like(rest)
        while counts.sum() < size:
            free = rest - counts
            counts += np.minimum(rng.multinomial(size - int(counts.sum()), free / free.sum()), free)
        rows += [(shard, int(s), int(given[s]), int(counts[s])) for s in np.flatnonzero(counts)]
        given, rest, shard = given + counts, rest - counts, shard + 1
    return rows


def _sizes(batches):
    for batch in batches:
        sizes = [len(t.split()) for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "source", "row")), pa.array(sizes, pa.int64())],
            names=["doc_id", "source", "row", "size"],
        )


def _blocks_of_slots(frames):
    for rows in frames:
        n, slot = rows["blocks"].to_numpy(), rows["slot"].to_numpy()
        source, epoch = rows["source_no"].to_numpy(), slot // n
        pairs, at = np.unique(np.stack([source, epoch]), axis=1, return_inverse=True)
        keys = np.array([_pass_key(int(s), int(e)) for s, e in pairs.T], np.uint64)
        yield rows[["source_no", "shard", "slot", "cut"]].assign(
            epoch=epoch, block=permute(slot % n, n, keys[at.ravel()])
        )


class Mix:
    """sized: a row for each document; sources: what each gives; pieces: what slots read."""

    def __init__(self, sized: DataFrame, sources: list[tuple], pieces: DataFrame):
        self.sized, self.sources, self.pieces = sized, sources, pieces


def _placed(sized: DataFrame, numbered: DataFrame, buckets: int) -> DataFrame:
    """sized with source_no and first: the position of a document in its source's stream.

    Positions are sums within (source, bucket) plus sums over a source's buckets, so no
    task holds a whole source.
    """
    rows = sized.join(numbered, sized["source"].eqNullSafe(numbered["name"])).drop("name")
    rows = rows.withColumn("bucket", F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("row")), F.lit(buckets)))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "row")
    rows = rows.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("offset"))
    return rows.join(sums, ["source_no", "bucket"]).withColumn(
        "first", F.coalesce("before", F.lit(0)) + F.col("offset")
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, row: str | None = None) -> Mix:
    """Mix docs (doc_id, text, source; row: the column of row identities, if docs has one).

    Sources are few: the driver holds one row for each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    number = F.col(row) if row else F.monotonically_increasing_id()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", number.alias("row"), "text")
    sized = stored(
        texts.mapInArrow(_sizes, f"doc_id long, source string, row {row_type(docs, row)}, size long"), "sizes"
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    wanted = targets(sizes)
    quota = quotas(sizes, wanted, block_words)
    slots = [q[1] for q in quota]
    plan = draws(slots, max(shard_slots, -(-sum(slots) // MOST_SHARDS)))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planned = spark.createDataFrame(
        [(s, shard, first, n, quota[s][0], slots[s] - 1, quota[s][2]) for shard, s, first, n in plan],
        "source_no int, shard long, first long, n long, blocks long, last long, words long",
    )
    slot_rows = (
        planned.repartition(width)
        .withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
        .withColumn("cut", F.when(F.col("slot") == F.col("last"), F.col("words")))
        .select("source_no", "shard", "slot", "cut", "blocks")
        .mapInPandas(
            lambda frames: _blocks_of_slots(f.astype({"cut": "Int64"}) for f in frames),
            "source_no int, shard long, slot long, cut long, epoch long, block long",
        )
    )
    numbered = spark.createDataFrame(
        [(i, r["source"], float(t), z) for i, (r, t, z) in enumerate(zip(found, wanted, sizes))],
        "source_no int, name string, target double, source_size long",
    )
    if len(found) <= BUCKET_ROWS:
        numbered = F.broadcast(numbered)
    total = sum(r["n"] for r in found)
    placed = stored(_placed(sized, numbered, max(width, -(-total // BUCKET_ROWS))), "placed")
    parts = (
        placed.filter("size > 0")
        .withColumn(
            "block",
            F.explode(F.expr(f"sequence(first div {block_words}, (first + size - 1) div {block_words})")),
        )
        .withColumn("from", F.expr(f"greatest(first, block * {block_words})"))
        .withColumn("to", F.expr(f"least(first + size, (block + 1) * {block_words})"))
    )
    pieces = (
        # Slots grow with the input, though Spark takes them for small: they must be shuffled.
        parts.join(slot_rows.hint("merge"), ["source_no", "block"])
        .withColumn("to", F.expr(f"least(to, coalesce(block * {block_words} + cut, to))"))
        .filter("to > from")
        .select(
            "shard",
            "slot",
            "epoch",
            "source_no",
            "row",
            "doc_id",
            (F.col("from") - F.col("first")).alias("first_word"),
            (F.col("to") - F.col("from")).alias("words"),
        )
    )
    return Mix(placed, [(r["source"], z, t) for r, z, t in zip(found, sizes, wanted)], pieces)


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs."""
    mixed = mix(docs, block_words)
    words = mixed.pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return mixed.sized.join(words, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def _cut(text: bytes, spans: list[tuple[int, int]], n_words: int) -> bytes:
    """The words of spans (first word, words) with the white space between them."""
    import re

    if spans == [(0, n_words)]:
        return text
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    return b"\n".join(text[at[first][0] : at[first + n - 1][1]] for first, n in spans)


def _written(columns: list[str], pieces: str):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                text, groups = (row["text"] or "").encode(), {}
                for piece in sorted(row[pieces], key=lambda p: (p["epoch"], p["first_word"])):
                    groups.setdefault(piece["epoch"], []).append((piece["first_word"], piece["words"]))
                total = len(text.split())
                for spans in groups.values():
                    joined = []
                    for first, n in spans:
                        if joined and joined[-1][0] + joined[-1][1] == first:
                            joined[-1] = (joined[-1][0], joined[-1][1] + n)
                        else:
                            joined.append((first, n))
                    cut = _cut(text, joined, total).decode()
                    out.append({c: row[c] for c in columns} | {"text": cut, "n_chars": len(cut)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(c) for c in columns]))

    return run


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a row for each document and pass over its source, with the words taken.

    A document taken whole twice comes as two rows; n_chars counts the text returned.
    docs needs doc_id, text, source and n_chars; further columns are carried along.  Rows
    are told apart by identities that stay, so rows with one doc_id and text keep their own
    columns.
    """
    rows, row = numbered(docs)
    name = f"{row}_pieces"
    while name in rows.columns:
        name = f"_{name}"
    pieces = (
        mix(rows, block_words, row=row)
        .pieces.groupBy("row")
        .agg(F.collect_list(F.struct("epoch", "first_word", "words")).alias(name))
        .withColumnRenamed("row", row)
    )
    joined = rows.join(pieces, row).select(*docs.columns, name)
    return joined.mapInArrow(_written(docs.columns, name), docs.schema)
