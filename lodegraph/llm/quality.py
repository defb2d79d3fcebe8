"""Quality classifier: random Fourier features of document statistics, ridge, isotonic scores.

Every text is read once for its statistics, which go to a shared table.  Moments of the
training rows scale the statistics; random Fourier features approximate a Gaussian
kernel on them.  Each partition sums its part of the normal equations, Spark adds the
parts, the driver solves one system of FEATURES + 1 unknowns.  Raw scores of training
rows are counted in fixed bins, and pooling adjacent violators over the bins gives the
probability that a score stands for.

Defined results: null text counts as empty and is scored like one; labels that are null
or repeated with both values do not train, agreeing repeats count once; without
training labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import crc_remainder, small_batches, stored, text_bytes

FEATURES = 192
WIDTH = 5.0
RIDGE = 0.1
BINS = 512
FOLDS = 5
SEED = 7

_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
N_STATISTICS = 22


def statistics(text: bytes) -> list[float]:
    """Shape of a text: classes of bytes, words, lines and their repetition."""
    n = len(text)
    if not n:
        return [0.0] * N_STATISTICS
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=6)
    share = counts[counts > 0] / n
    words = text.split()
    n_words = max(1, len(words))
    lower = [w.lower() for w in words]
    distinct = set(lower)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    line_bytes = sum(map(len, lines)) or 1
    repeated_lines = line_bytes - sum(map(len, set(lines)))
    pairs = set(zip(lower, lower[1:]))
    letters = max(1.0, kinds[1] + kinds[2])
    ends = [w[-1] for w in words]
    symbol_end = sum(1 for e in ends if _CLASS[e] == 4)
    plain_end = sum(1 for e in ends if e in b".,;:!?")
    alone = sum(1 for w in words if len(w) == 1 and _CLASS[w[0]] == 4)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        kinds[0] / n,
        kinds[2] / letters,
        kinds[3] / n,
        kinds[4] / n,
        kinds[5] / n,
        float(-(share * np.log2(share)).sum()),
        len(distinct) / n_words,
        1 - len(pairs) / max(1, len(words) - 1),
        repeated_lines / line_bytes,
        symbol_end / n_words,
        (symbol_end - plain_end) / n_words,
        alone / n_words,
        sum(1 for w in words if w.isupper()) / n_words,
        np.log1p(len(words) / n_lines),
        (counts[46] + counts[33] + counts[63]) / n_words,
        counts[124] / n_words,
        float(counts[33:127][_CLASS[33:127] == 4].max()) / n,
    ]


def _statistics(batches):
    for batch in batches:
        rows = np.array([statistics(t) for t in text_bytes(batch.column("text"))], np.float32)
        flat = pa.array(rows.reshape(-1), pa.float32())
        values = pa.FixedSizeListArray.from_arrays(flat, N_STATISTICS).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), values], names=["doc_id", "stats"]
        )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats: one row for each row of docs, stored in the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_statistics, "doc_id long, stats array<float>"), "statistics")


def _matrix(batch, name="stats") -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y: one row for each doc_id whose labels agree, held-out ids left out."""
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.filter(crc_remainder(F.col("doc_id"), FOLDS) != 0)
    same = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(column).cast("double").alias("y"), F.max(column).cast("double").alias("_most")
    )
    return same.filter("y = _most").drop("_most")


class Model:
    """Scaling, random frequencies, weights and the calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.frequency = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weight = np.zeros(FEATURES + 1)
        self.steps = np.full(BINS, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.frequency + self.phase)
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def bin(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw + 0.25) / 1.5 * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability, with a slope inside each step so that order is kept."""
        raw = self.raw(stats)
        place = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.clip(self.steps[self.bin(raw)] * 0.998 + 0.002 * place, 0, 1)


def isotonic(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of bins that fit their counts best (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for n, p in zip(count, positive):
        blocks.append([float(p), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p1, n1, w1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + n1, blocks[-1][2] + w1]
    rates = [p / n if n else 0.5 for p, n, _ in blocks]
    return np.repeat(rates, [int(w) for _, _, w in blocks])


def summed(rows: DataFrame, parts) -> np.ndarray:
    """Sum over partitions of the vector that parts makes of each partition's batches."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                vector = parts(batch)
                total = vector if total is None else total + vector
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"]
            )

    found = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Train on rows of stats (doc_id, stats) that labels (doc_id, y) knows."""
    train = stored(stats.join(labels, "doc_id").select("stats", "y"), "training")

    def moments(batch):
        x = _matrix(batch)
        return np.r_[len(x), x.sum(0), (x * x).sum(0)]

    total = summed(train, moments)
    if not len(total):
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    mean = total[1 : N_STATISTICS + 1] / total[0]
    variance = total[N_STATISTICS + 1 :] / total[0] - mean**2
    model = Model(mean, np.sqrt(np.maximum(variance, 1e-8)))
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def normal(batch):
        z, y = model.features(_matrix(batch)), np.asarray(batch.column("y"), np.float64)
        return np.r_[(z.T @ z)[upper], z.T @ y]

    sums = summed(train, normal)
    gram = np.zeros((size, size))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    model.weight = np.linalg.solve(gram + RIDGE * total[0] * np.eye(size) / size, sums[len(upper[0]) :])

    def calibration(batch):
        at, y = model.bin(model.raw(_matrix(batch))), np.asarray(batch.column("y"), np.float64)
        return np.r_[np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)].astype(float)

    counts = summed(train, calibration)
    rate = counts[BINS:].sum() / counts[:BINS].sum()
    model.steps = isotonic(counts[:BINS] + 1e-3, counts[BINS:] + 1e-3 * rate)
    return model


def score(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels: doc_id and column."""
    stats = document_statistics(docs)
    model = fit(stats, training_labels(labels, column))

    def run(batches):
        for batch in batches:
            values = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values)], names=["doc_id", "score"]
            )

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the documents that the classifier rejects; columns unchanged.

    A row's own text decides, in the pass that hands the row on: no text is stored or
    shuffled, so repeated and null doc_ids cannot be mixed up.  The statistics are taken
    twice instead: once for training, once for the verdict.
    """
    known = training_labels(labels, "quality")
    sent = docs.sparkSession.sparkContext.broadcast(fit(document_statistics(docs), known))

    def run(batches):
        model = sent.value
        for batch in batches:
            if batch.num_rows:
                stats = np.array([statistics(t) for t in text_bytes(batch.column("text"))], np.float32)
                yield batch.filter(pa.array(model.score(stats.astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
