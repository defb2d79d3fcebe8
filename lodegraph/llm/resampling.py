"""Target-distribution importance resampling over hashed word runs.

Two passes over the texts: the first adds up how often each of BUCKETS buckets of word
runs occurs in the corpus and in the target texts, one array for each partition; the gains
of the buckets, an array of fixed size, then score every document in the second.  Gumbel
noise that depends on the doc_id alone turns the highest scores into a weighted draw
without replacement.

The cut is found by radix selection on the composite key (score descending, doc_id, row):
each round counts the rows that still tie with the k-th key by their next DIGIT_BITS bits,
a histogram of fixed size, and keeps one digit.  Rows of the cut and above it are compared
with the full key, and only they are range-sorted and ranked.

Defined results: null and empty texts have no features and weight 0, and are never drawn;
a null doc_id is hashed as empty text and comes last among ties; rows with one doc_id and
one score are told apart by a stored row number; without target texts all gains are those
of counts of zero; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import small_batches, stored, text_bytes

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
RUN_WORDS = 3
DIGIT_BITS = 12
BLOCK_WORDS = 1 << 15

# Lower-case A-Z; what is neither a digit, a letter nor beyond ASCII separates words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def buckets(text: bytes):
    """Arrays of the buckets of all runs of one to three words, block by block, and the number of words."""
    words = text.translate(_WORDS).split()
    crc = zlib.crc32
    for low in range(0, len(words), BLOCK_WORDS):
        part = words[low : low + BLOCK_WORDS + RUN_WORDS - 1]
        line, n = b" ".join(part), min(BLOCK_WORDS, len(part))
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts, ends = (ends - lengths).tolist(), ends.tolist()
        hashes = [crc(w) for w in part[:n]]
        for more in range(1, RUN_WORDS):
            hashes += [crc(line[s:e]) for s, e in zip(starts[:n], ends[more:])]
        yield np.array(hashes, np.int64) % BUCKETS, n


def _counted(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in text_bytes(batch.column("text")):
            for found, _ in buckets(text):
                total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts (column text): one array of BUCKETS counts."""
    small_batches(texts.sparkSession)
    rows = texts.select("text").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found, out = rows.toArrow(), np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log ratio of smoothed shares, for each bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(text_bytes(batch.column("text"))):
                for found, n in buckets(text):
                    out[:, i] += n, len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floor of 1000 times standard Gumbel noise that depends on doc_id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def cut_key(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The k-th smallest key (k from 1, at most the number of rows) in the order of the long columns keys.

    Radix selection: digits of each column are counted from its least value on, in rounds
    of at most 2 ** DIGIT_BITS counts.
    """
    found: list[int] = []
    for key in keys:
        low, high, n = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n == 1:  # no tie is left
            found.append(low)
            continue
        low, width = int(low), max(1, (int(high) - int(low)).bit_length())
        kind = "decimal(38,0)" if width > 62 else "long"  # differences may pass the range of a long
        shift = -(-width // DIGIT_BITS) * DIGIT_BITS
        while shift and n > 1:
            shift -= DIGIT_BITS
            place = F.col(key).cast(kind) - F.lit(low).cast(kind)
            digit = F.call_function("div", place, F.lit(1 << shift).cast(kind))
            bins = rows.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
            for row in sorted(bins, key=lambda r: r["digit"]):
                if k <= row["n"]:
                    break
                k -= row["n"]
            rows, n, low = rows.filter(digit == row["digit"]), row["n"], low + (row["digit"] << shift)
        found.append(int(rows.agg(F.min(key)).first()[0]) if n == 1 else low)
    return found


def up_to(keys: list[str], cut: list[int]) -> Column:
    """True for rows whose key is at most cut."""
    out = F.lit(True)
    for key, value in zip(reversed(keys), reversed(cut)):
        out = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & out)
    return out


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with rank 1, 2, 3, ... in the order of keys: range-sorted parts, offset by the rows before them."""
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = stored(parts.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = at.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    offsets, before = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], before))
        before += row["n"]
    starts = at.sparkSession.createDataFrame(offsets, "_part int, _before long")
    inside = Window.partitionBy("_part").orderBy(*keys)
    return (
        at.join(F.broadcast(starts), "_part")
        .withColumn("rank", F.row_number().over(inside) + F.col("_before"))
        .drop("_part", "_before")
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank is null where not drawn.

    docs: doc_id, text; target: text.  Of the documents with at least LEAST_WORDS words, the
    percent with the highest scores are drawn.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = stored(
        weights(docs, gain)
        .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        .withColumn("_down", -F.col("score"))
        .withColumn("_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
        .withColumn("_row", F.monotonically_increasing_id()),
        "scores",
    )
    keys, fit = ["_down", "_id", "_row"], F.col("n_words") >= LEAST_WORDS
    drawn = percent * scored.filter(fit).count() // 100
    columns = ("doc_id", "n_features", "weight", "score")
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return scored.select(*columns, none)
    chosen = fit & up_to(keys, cut_key(scored.filter(fit).select(*keys), keys, drawn))
    return (
        ranked(scored.filter(chosen), keys)
        .select(*columns, F.col("rank").cast("long").alias("rank"))
        .unionByName(scored.filter(~chosen).select(*columns, none))
    )


SQL = r"""
with texts as (select true as corpus, row_number() over () as rid, doc_id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
               union all
               select false, -row_number() over (), null,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
     runs as (select corpus, rid, array_to_string(w[i:i + more], ' ') as f
              from (select corpus, rid, w, more, unnest(range(1, len(w) - more + 1)) as i
                    from texts, range(0, 3) as m(more))),
     feats as (select corpus, rid, f, count(*) as n from runs group by all),
     names as (select distinct f from feats),
     crc as (select f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda p: ('0x' || substr(hex(encode(f)), 2 * p + 1, 2))::int::bigint),
                 lambda c, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) % 10000 as bucket from names),
     sums as (select bucket, sum(n) filter (corpus) as s, sum(n) filter (not corpus) as t from feats join crc using (f) group by bucket),
     ends as (select sum(s) as big_s, sum(t) as big_t from (select coalesce(s, 0) as s, coalesce(t, 0) as t from sums)),
     gains as (select bucket, cast(floor(1000 * ln((coalesce(t, 0)::double + 1) * (coalesce(big_s, 0)::double + 10000)
                      / ((coalesce(s, 0)::double + 1) * (coalesce(big_t, 0)::double + 10000)))) as bigint) as gain from sums, ends),
     weights as (select rid, sum(n) as n_features, sum(n * gain) as weight
                 from feats join crc using (f) join gains using (bucket) where corpus group by rid),
     scored as (select rid, doc_id, len(w) as n_words, cast(coalesce(n_features, 0) as bigint) as n_features,
                       cast(coalesce(weight, 0) as bigint) as weight,
                       cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint
                            + 0.5::double) / 4294967296))) as bigint) as score
                from texts left join weights using (rid) where corpus),
     placed as (select rid, row_number() over (order by score desc, doc_id nulls last) as rank,
                       5 * count(*) over () // 100 as k from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= k then rank end as rank
from scored left join placed using (rid)"""
