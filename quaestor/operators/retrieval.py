"""Retrieval: asking questions, answerability, citations and reranking; chunks are found by the index of `keywords` or by vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.functions import vector as V
from quaestor.operators.chunking import chunks, sizes
from quaestor.operators.keywords import THRESHOLD, TOP_K, Index, keyword_topk, search
from quaestor.sources import stored

#: Hits that are broadcast to the documents at most.
BROADCAST = 200_000
NO_ANSWER = "NO_CHUNK_ABOVE_THRESHOLD"


def ask(questions: DataFrame, docs: DataFrame, strategy: str = "fixed_1200_150", k: int = TOP_K, threshold: float = THRESHOLD, metric: str = "keyword", index: Index | None = None) -> dict[str, DataFrame]:
    """From questions (item_id, text) to the tables that asking fills, and the answers. Without a stored index of the documents' chunks one is built.

    retrieval_queries: the query as rewritten, and whether it can be answered; retrieval_results: its hits by rank;
    answer_citations: their quotes; answers: the content of the best hit, with its citations as JSON. A question
    without a hit has the reason instead of an answer.
    """
    size, overlap = sizes(strategy)
    asked = questions.select("item_id", "text", X.rewrite(F.col("text")).alias("rewritten_query"))
    queries = asked.select("item_id", F.col("rewritten_query").alias("text"))
    hits = search(index, queries, k, threshold, metric) if index else keyword_topk(queries, chunks(docs.select("doc_id", "text"), strategy), k, threshold, metric=metric)
    results = hits.select(X.uid("hit", F.concat_ws(":", "item_id", "result_rank")).alias("retrieval_result_id"), "item_id", "doc_id", "chunk_index", "result_rank", F.col("score").alias("similarity_score"))
    states = answerable(questions, hits)
    cited = citations(with_content(hits, docs, size, overlap))
    best = cited.where("citation_order = 1").select("item_id", F.col("quote_text").alias("answer"))
    answers = states.join(best, "item_id", "left").join(citations_json(cited), "item_id", "left")
    queries = asked.join(states, "item_id").select("item_id", F.col("text").alias("query_text"), "rewritten_query", F.lit(k).alias("top_k"), F.lit(metric).alias("similarity_metric"), F.lit(threshold).alias("similarity_threshold"), "is_answerable", "no_answer_reason")
    return {"retrieval_queries": queries, "retrieval_results": results, "answer_citations": cited, "answers": answers}


def answerable(queries: DataFrame, hits: DataFrame, query: str = "item_id") -> DataFrame:
    """Every query with n_hits, is_answerable, and the reason if nothing was found."""
    counts = hits.groupBy(query).agg(F.count("*").alias("n_hits"))
    n = F.coalesce("n_hits", F.lit(0))
    return queries.select(query).join(counts, query, "left").select(query, n.cast("long").alias("n_hits"), (n > 0).alias("is_answerable"), F.when(n == 0, NO_ANSWER).alias("no_answer_reason"))


def with_content(hits: DataFrame, docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """hits with the content of their chunks, cut again from the documents they name.

    Hits are written first: up to BROADCAST of them go to the documents, whose texts stay where they are; more meet them by shuffle.
    """
    hits = stored.staged(hits, "hits")
    few = F.broadcast(hits) if hits.count() <= BROADCAST else hits
    content = F.substring(F.col("text"), F.col("chunk_index") * (size - overlap) + 1, F.lit(size))
    return docs.select("doc_id", "text").join(few, "doc_id").select(*hits.columns, content.alias("content"))


def citations(hits: DataFrame, quote: int = 200, query: str = "item_id") -> DataFrame:
    """Citations of each answer in order of rank, with the beginning of the content as quote."""
    order = F.row_number().over(Window.partitionBy(query).orderBy("result_rank"))
    return hits.select(query, order.alias("citation_order"), "doc_id", "chunk_index", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.substring("content", 1, quote).alias("quote_text"))


def cited_with(cited: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations with the score of their result and the title of their document; keys may be null or dangling, and every citation stays."""
    scores = results.select("retrieval_result_id", "similarity_score")
    titles = documents.select("document_id", "document_title")
    return cited.join(scores, "retrieval_result_id", "left").join(titles, "document_id", "left")


def embeddings_with_models(stored: DataFrame, held: DataFrame, models: DataFrame) -> DataFrame:
    """Stored vectors (chunk_id, embedding_model_id, embedding_json) with their chunk and model, and whether they have the model's dimension."""
    named = models.select("embedding_model_id", "model_name", F.col("dimension").alias("model_dimension"))
    rows = stored.join(named, "embedding_model_id").join(held, "chunk_id").withColumn("dimension", F.size(V.from_json(F.col("embedding_json"))))
    return rows.withColumn("right_dimension", F.col("dimension") == F.col("model_dimension"))


def citations_json(cited: DataFrame, query: str = "item_id") -> DataFrame:
    """One row per answer: its citations as JSON text, in order."""
    listed = F.array_sort(F.collect_list(F.struct("citation_order", "doc_id", "chunk_index")))
    return cited.groupBy(query).agg(F.to_json(listed).alias("citations_json"))


def reranked(hits: DataFrame, query: str = "item_id") -> DataFrame:
    """Ranks anew by rerank_score where there is one, else by similarity."""
    order = Window.partitionBy(query).orderBy(F.desc(F.coalesce("rerank_score", "score")), "result_rank")
    return hits.withColumn("result_rank", F.row_number().over(order))


def context_json(hits: DataFrame, query: str = "item_id") -> DataFrame:
    """One row per query: its hits (result_rank, doc_id, chunk_index, content) by rank as JSON text, and the length of what they hold."""
    listed = F.array_sort(F.collect_list(F.struct("result_rank", "doc_id", "chunk_index", F.length("content").alias("n_chars"))))
    return hits.groupBy(query).agg(F.to_json(listed).alias("retrieved_context_json"), F.sum(F.length("content")).alias("context_chars"))
