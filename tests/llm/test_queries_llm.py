"""Registered queries: those with SQL equal it, and the pipeline keeps what it should."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_oracles import compare, connect
from zonecast.llm.queries import QUERIES
from zonecast.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    text, good, _ = compare(spark, duck, SF, name)
    assert good, text


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_languages_of_held_out_documents(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op1_string_kernels"](spark, SF).join(lang, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_token_counts_are_those_of_the_library(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op5_trie_counts"](spark, SF).collect()}
    assert got == {i: len(library.encode(text)) if text else 0 for i, text in texts.items()}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        assert docs.count() > 0.3 * n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_near_copies_of_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{name}{i}" for i in range(40)) for name in ("a", "b", "c"))
    rows = [(1, one), (5, one), (5, one), (5, two), (7, two), (7, two), (9, three), (9, three), (9, three + " more"), (None, one), (None, three), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(corpus_pipeline.drop_near_copies(spark, docs, SF).collect(), key=str)
    assert [r for r in kept if r["text"] and r["doc_id"] in (1, 5, 7)] == [(1, one), (5, two)]
    assert [r["doc_id"] for r in kept if r["doc_id"] == 9] == [9]
    assert [r["text"] for r in kept if r["doc_id"] is None] == [one, three] and len(kept) == 7


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
