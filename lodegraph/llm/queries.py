"""Queries of this subpackage over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import (
    bpe,
    exact_dedup,
    filter_audit,
    gated_lm,
    html_extract,
    mixing,
    page_samples,
    quality,
    quality_rules,
    resampling,
    secrets,
    simhash,
    toxicity,
    va_search,
)
from lodegraph.llm.common import read_table


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.classes(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
           from embeddings
           where embedding is not null and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     q as (select distinct vec_id, v from v where vec_id % 50 = 0),
     c as (select *, row_number() over () as n from v),
     s as (select q.vec_id as query_id, c.n, c.vec_id,
                  max(cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint)) as score
           from q join c on c.vec_id <> q.vec_id and len(q.v) = len(c.v) group by all),
     r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank
           from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"), page_samples.labelled_pages(spark))


def op3_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score(read_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the text decoded from them."""
    path = vocabulary_path()
    rows = bpe.decode(bpe.encode(docs, path), path)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with norm as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
              from documents),
     best as (select t, max(doc_id) as keep_id, count(*) as group_size from norm group by t)
select n.doc_id, b.keep_id, b.group_size, n.doc_id = b.keep_id as kept, sha256(n.t) as text_sha256
from norm n join best b on n.t = b.t"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_top_k": (op1_top_k, OP1_SQL),
    "op2_html": (op2_html, None),
    "op3_gated_lm": (op3_gated_lm, None),
    "op4_secrets": (op4_secrets, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_quality": (op6_quality, None),
    "op7_bpe": (op7_bpe, None),
    "op8_exact_dedup": (op8_exact_dedup, OP8_SQL),
    "op9_simhash": (op9_simhash, None),
    "op10_mixing": (op10_mixing, None),
    "op11_quality_rules": (op11_quality_rules, quality_rules.SQL),
    "op12_resampling": (op12_resampling, resampling.SQL),
    "op13_filter_audit": (op13_filter_audit, filter_audit.SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
