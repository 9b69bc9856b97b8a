"""Searches are whole however Spark plans and times their joins: a range is scored where it is read."""

from __future__ import annotations

import pytest

from quaestor.operators import keywords, retrieval
from tests.test_retrieval import brute, found, made_chunks


@pytest.mark.parametrize("metric", ["keyword", "bm25"])
def test_no_postings_are_dealt(spark, tmp_path, metric):
    """What is dealt out for a join may be read in parts, and then a chunk's score lacks some of its tokens."""
    chunks = made_chunks(3)
    index = keywords.build_index(spark.createDataFrame(chunks, "doc_id long, chunk_index int, content string").repartition(3), str(tmp_path / "index"))
    queries = [(1, "w1 w2 w3 w17"), (2, chunks[7][2])]
    hits = keywords.search(index, spark.createDataFrame(queries, "item_id long, text string"), metric=metric)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan[plan.index("MapInArrow") :]
    assert found(hits) == brute(queries, chunks, keywords.TOP_K, keywords.THRESHOLD, metric)


def test_queries_in_several_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keywords, "BROADCAST", 20)
    monkeypatch.setattr(keywords, "QUERIES", 3)
    chunks = made_chunks(5)
    index = keywords.build_index(spark.createDataFrame(chunks, "doc_id long, chunk_index int, content string").repartition(3), str(tmp_path / "index"))
    queries = [(i, chunks[i][2]) for i in range(10)]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert found(keywords.search(index, asked, metric="bm25")) == brute(queries, chunks, keywords.TOP_K, keywords.THRESHOLD, "bm25")


def test_documents_stay_where_they_are(spark):
    """A few hits go to the documents; the texts are not dealt out to meet them."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 7, 0, 1.0, 1), (1, 9, 0, 0.5, 2)], "item_id long, doc_id long, chunk_index int, score double, result_rank int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = retrieval.with_content(hits, docs, 1200, 150)
        assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.result_rank, r.content) for r in rows.collect()) == [(1, "text 7"), (2, "text 9")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
