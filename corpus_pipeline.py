"""A training corpus from documents: quality, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  Null texts, repeated rows, empty tables and further columns
have the results that the operators' modules define.

A stage's rows are to be written before the next stage is called: each stage begins by
deleting the helper tables of the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import bpe, exact_dedup, mixing, quality, simhash
from lodegraph.llm.common import drop_tables, read_table, recorded_tables, stored
from lodegraph.llm.queries import vocabulary_path

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS = 3


_helpers: list[str] = []


def _stage(build: Callable) -> Callable:
    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _helpers)
        with recorded_tables(_helpers):
            return build(spark, docs, sf_dir)

    return run_stage


@_stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality classifier rejects."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"), QUALITY_THRESHOLD)


@_stage
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of equal texts: the largest doc_id."""
    return exact_dedup.deduplicate(docs)


@_stage
def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each component of near duplicates: the smallest doc_id."""
    return simhash.keep_one(docs, SHINGLE_WORDS)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source as documents; a document taken twice comes as two rows."""
    return mixing.mixed_documents(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and digests of the ids and the decoded text of each row."""
    path = vocabulary_path()
    rows = bpe.round_trip(docs, path, keep=("doc_id", "lang", "source"))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_texts),
    ("simhash near-dedup", distinct_contents),
    ("mixing", mixed),
    ("bpe", tokens),
]

# The classifier's random features, the SimHash words and the BPE ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    rows, before = read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        now: list[str] = []
        built = stage(spark, rows, sf_dir)
        with recorded_tables(now):
            rows = stored(built, "stage")
        drop_tables(spark, before)
        before = now
    return rows
