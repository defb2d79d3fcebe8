"""The corpus pipeline stage by stage, on documents made for it and on odd ones."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from lodegraph.llm import queries as llm

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing", "bpe"]
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept.append(docs)
    good, distinct, near, mixed, encoded = kept
    assert all(sorted(d.columns) == COLUMNS for d in kept[:4])
    rejected = {r["doc_id"] for r in llm.op6_quality(spark, SF_DIR).collect() if not r["predicted"]}
    before = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r["doc_id"] for r in good.collect()} == before - rejected
    texts = [lowered(r["text"]) for r in good.collect()]
    assert sorted(set(texts)) == sorted(lowered(r["text"]) for r in distinct.collect())
    assert near.count() <= distinct.count()
    words = sum(len((r["text"] or "").encode().split()) for r in near.collect())
    taken = sum(len((r["text"] or "").encode().split()) for r in mixed.collect())
    sources = {r["source"] for r in near.collect()}
    assert abs(taken - 1.5 * words) <= 0.5 * len(sources)  # each source's target is rounded to whole words
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    library = Tokenizer.from_file(llm.vocabulary_path())
    wanted = sorted((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in mixed.collect())
    assert sorted((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in encoded.collect()) == wanted


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "Same words here", "en", "a", 15), (4, "same WORDS here", "en", None, 15)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, docs, SF_DIR).count() <= 2 * len(data)


def test_null_and_repeated_ids_lose_no_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue", "green", "pink", "grey")]
    pairs = [(9, 0), (5, 0), (5, 1), (None, 0), (None, 2), (None, 2), (None, 3), (7, 4), (7, 4)]
    docs = spark.createDataFrame([(i, texts[t], "en", "a", len(texts[t])) for i, t in pairs], schema)
    whole = sorted([(9, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[4])], key=str)
    got = corpus_pipeline.distinct_texts(spark, docs, SF_DIR).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == whole
    got = corpus_pipeline.distinct_contents(spark, docs, SF_DIR).collect()
    assert sorted((r["text"] for r in got)) == sorted(texts)
    assert (5, texts[0]) in {(r["doc_id"], r["text"]) for r in got}


def test_quality_judges_each_row_of_a_null_or_repeated_id(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*COLUMNS)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rated = llm.op6_quality(spark, SF_DIR).orderBy("score", "doc_id").collect()
    bad, good = text[rated[0]["doc_id"]], text[rated[-1]["doc_id"]]
    odd = [(i, "en", len(t), "odd", t) for i in (None, 10**9) for t in (bad, good)]
    kept = corpus_pipeline.good_documents(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), SF_DIR)
    assert {(r["doc_id"], r["text"]) for r in kept.filter("source = 'odd'").collect()} == {(None, good), (10**9, good)}
