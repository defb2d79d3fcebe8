"""Toxic passages as maximal scoring segments of token log-odds.

Learning counts words of a bounded sample of labelled rows (SAMPLE_ROWS of each label): in
how many different contexts (preceding words) a word stands in toxic texts, so that copies
of one text count once, and how often it stands in other texts.  Dirichlet priors smooth
both; a word's score is a lower confidence bound of its log-odds, every other token costs
a small constant.  A linear scan finds all maximal scoring segments of a text.

Scores of segments in non-toxic texts follow an extreme-value law: lambda solves the
moment equation of the token scores, K is the likeliest one for the best segments of these
texts.  A text's evidence adds up how far its segments exceed what a text of its length
shows by chance.  Isotonic regression turns evidence into probability; its evidence comes
from two models, each fitted on the half of the sample that it does not score, and counts
each label as often as it stands among all labelled training rows.

Defined results: null text counts as empty; texts without scored words share the lowest
score, whatever their length; conflicting labels of a doc_id do not train, agreeing repeats
count once; repeated rows and rows without doc_id are scored each; texts of any length are
scanned whole; further columns are ignored; without labels every score is the same; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import crc_remainder, small_batches, stored, text_bytes
from lodegraph.llm.quality import BINS, FOLDS, isotonic, summed, training_labels

SAMPLE_ROWS = 20_000
PRIOR = 0.5
CONFIDENCE = 2.0
DRIFT = 0.02
EDGES = b".,;:!?\"'()[]{}*&%$#|-_"
EVIDENCE_STEP = 0.125


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [w.strip(EDGES) for w in text.lower().split()]


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a token sequence.

    Tokens at the given positions have positive scores, all others cost drift.  Runs of
    others count as one item, and each segment remembers the nearest earlier one that
    starts lower, so the scan is linear in the scored tokens.
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total, before = 0.0, -1
    for position, gain in zip(at, score):
        total -= drift * (position - before - 1)
        before, low, first = position, total, position
        total += gain
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, position, low, total, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(first, last, high - low) for first, last, low, high, _ in kept]


def _word_counts(batches):
    for batch in batches:
        contexts, plain = set(), Counter()
        for text, toxic in zip(text_bytes(batch.column("text")), batch.column("y").to_pylist()):
            words = tokens(text)
            if toxic:
                contexts.update(zip(words, [b"", *words]))
            else:
                plain.update(words)
        words = [w for w, _ in contexts] + list(plain)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.binary()),
                pa.array([p for _, p in contexts] + [None] * len(plain), pa.binary()),
                pa.array([0] * len(contexts) + list(plain.values()), pa.int64()),
            ],
            names=["word", "context", "n"],
        )


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most rows doc_ids of each label, chosen by a hash of the id."""
    parts = [
        labels.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "y")
        for y in (1.0, 0.0)
    ]
    return parts[0].unionByName(parts[1])


class Model:
    """Word scores, extreme-value parameters and calibration steps."""

    def __init__(self):
        self.words: dict[bytes, float] = {}
        self.scale, self.rate = 1.0, 1e-3
        self.steps = np.full(BINS, 0.5)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        found, get = tokens(text), self.words.get
        hits = [(i, s) for i, w in enumerate(found) if (s := get(w))]
        return len(found), segments([i for i, _ in hits], [s for _, s in hits], DRIFT)

    def significant(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float, float]]:
        """Segments with their excess over chance: -log of the expected number as high."""
        rows = [(a, b, s, self.scale * s - float(np.log(max(self.rate * n, 1e-3)))) for a, b, s in found]
        return [r for r in rows if r[3] > 0]

    def evidence(self, text: bytes) -> float:
        n, found = self.scan(text)
        return sum(r[3] for r in self.significant(n, found))

    def bin(self, evidence: np.ndarray) -> np.ndarray:
        return np.clip(np.ceil(np.asarray(evidence, float) / EVIDENCE_STEP), 0, BINS - 1).astype(np.int64)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        evidence = np.asarray(evidence, float)
        return np.clip(self.steps[self.bin(evidence)] * 0.998 + 0.002 * (1 - np.exp(-evidence / 50)), 0, 1)


def word_scores(counts: DataFrame) -> dict[bytes, float]:
    """Words with positive scores, as many as a bounded sample gives; counts: word, context, n."""
    per_context = counts.groupBy("word", "context").agg(F.sum("n").alias("n"))
    words = per_context.groupBy("word").agg(
        F.count("context").cast("double").alias("c1"), F.sum("n").cast("double").alias("c0")
    )
    words = stored(words, "words")
    total = words.agg(F.sum("c1"), F.sum("c0"), F.count(F.lit(1))).first()
    if not total[2] or not total[0] or not total[1]:
        return {}
    smooth1, smooth0 = (float(t) + PRIOR * total[2] for t in total[:2])
    a, b = F.col("c1") + PRIOR, F.col("c0") + PRIOR
    odds = F.log(a / smooth1) - F.log(b / smooth0)
    rows = (
        words.filter("c1 >= 3")
        .select("word", (odds - CONFIDENCE * F.sqrt(1 / a + 1 / b)).alias("score"))
        .filter("score > 0 and length(word) > 0")
        .toArrow()
    )
    return dict(zip(rows.column("word").to_pylist(), rows.column("score").to_pylist()))


def moment_root(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * values)) = 1."""
    low, high = 0.0, 1.0
    total = lambda x: float((share * np.exp(np.minimum(x * values, 500))).sum())
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return high


def fit_law(model: Model, texts: DataFrame) -> None:
    """lambda and K from the non-toxic texts (columns text, y)."""
    values = np.array(sorted(set(model.words.values())))
    place = {v: i for i, v in enumerate(values.tolist())}
    sent = texts.sparkSession.sparkContext.broadcast((model, place))

    def hits(batch):
        model, place = sent.value
        out = np.zeros(len(place) + 1)
        for text, toxic in zip(text_bytes(batch.column("text")), batch.column("y").to_pylist()):
            if not toxic:
                found = tokens(text)
                out[-1] += len(found)
                for w in found:
                    if (s := model.words.get(w)) is not None:
                        out[place[s]] += 1
        return out

    sums = summed(texts, hits)
    if not len(sums) or not sums[-1]:
        return
    n = sums[-1]
    # One pseudo-token of each score keeps lambda finite when non-toxic texts have none.
    share = (np.r_[sums[:-1], n - sums[:-1].sum()] + np.r_[np.full(len(values), 1 / max(1, len(values))), 0]) / (n + 1)
    scale = model.scale = moment_root(np.r_[values, -DRIFT], share)

    def maxima(batch):
        model, _ = sent.value
        out = np.zeros(2)
        for text, toxic in zip(text_bytes(batch.column("text")), batch.column("y").to_pylist()):
            if not toxic:
                n, found = model.scan(text)
                out += 1, n * np.exp(-scale * max((s for _, _, s in found), default=0.0))
        return out

    texts_, mass = summed(texts, maxima)
    model.rate = max(float(texts_ / max(mass, 1e-9)), 1e-9) if texts_ else model.rate


def fit_texts(texts: DataFrame) -> Model:
    """Word scores and law from texts (text, y)."""
    model = Model()
    model.words = word_scores(texts.select("text", "y").mapInArrow(_word_counts, "word binary, context binary, n long"))
    if model.words:
        fit_law(model, texts.select("text", "y"))
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model with calibration from a bounded sample; docs: doc_id, text; labels: doc_id, y."""
    chosen = _sample(labels, SAMPLE_ROWS).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    chosen = stored(chosen, "sample")
    texts = stored(docs.join(F.broadcast(chosen), "doc_id").select("text", "y", "half"), "training")
    model = fit_texts(texts)
    counts = np.zeros(2 * BINS)
    for half in (0, 1):
        sent = docs.sparkSession.sparkContext.broadcast(fit_texts(texts.filter(F.col("half") != half)))

        def scored(batch, sent=sent):
            other = sent.value
            at = other.bin(np.array([other.evidence(t) for t in text_bytes(batch.column("text"))]))
            toxic = np.asarray(batch.column("y"), float) > 0
            return np.r_[np.bincount(at[~toxic], minlength=BINS), np.bincount(at[toxic], minlength=BINS)].astype(float)

        found = summed(texts.filter(F.col("half") == half).select("text", "y"), scored)
        if len(found):
            counts += found
    shares = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain, toxic = counts[:BINS], counts[BINS:]
    plain = plain * shares.get(0.0, 0) / max(1, plain.sum())
    toxic = toxic * shares.get(1.0, 0) / max(1, toxic.sum())
    total = plain + toxic
    if total.sum():
        model.steps = isotonic(total + 1e-3, toxic + 1e-3 * toxic.sum() / total.sum())
    return model


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, passages for each row of docs.

    passages: number of significant segments.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows, training_labels(labels, column)))

    def scored(batches):
        model = sent.value
        for batch in batches:
            found = [model.significant(*model.scan(t)) for t in text_bytes(batch.column("text"))]
            evidence = np.array([sum(r[3] for r in rs) for rs in found], float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(model.score(evidence), pa.float64()),
                    pa.array(evidence, pa.float64()),
                    pa.array([len(rs) for rs in found], pa.int64()),
                ],
                names=["doc_id", "score", "evidence", "passages"],
            )

    return rows.mapInArrow(scored, "doc_id long, score double, evidence double, passages long").select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
        "passages",
    )


def passages(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> DataFrame:
    """doc_id, first_word, last_word, score, excess: every significant toxic passage."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows, training_labels(labels, column)))

    def run(batches):
        model = sent.value
        for batch in batches:
            out = [
                (i, *row)
                for i, t in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")))
                for row in model.significant(*model.scan(t))
            ]
            names = ["doc_id", "first_word", "last_word", "score", "excess"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    return rows.mapInArrow(run, "doc_id long, first_word long, last_word long, score double, excess double")
