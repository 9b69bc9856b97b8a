"""Experiment runs: an answer and its metrics for every question, and the dashboard over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.functions import vector as V
from quaestor.operators.chunking import chunks, sizes
from quaestor.operators.keywords import Index, keyword_topk, search
from quaestor.operators.retrieval import with_content

METRICS = ["faithfulness", "answer_relevance", "context_precision", "context_recall", "answer_correctness", "semantic_similarity"]
# Name, strategy, top_k and model of each experiment; a strategy of None has no results, the last model is not in the registry.
EXPERIMENTS = [
    *((f"{s}_top{k}", s, k, "multilingual-e5-base") for s in ("fixed_1200_150", "fixed_600_75") for k in (1, 3, 5)),
    ("dangling_model", "fixed_1200_150", 5, "missing-model"),
    ("no_results", None, 5, None),
]
#: What an answer costs and takes where no model is run that could be timed: by token, as a stated price list.
COST_PER_TOKEN, BASE_MS, MS_PER_TOKEN = "0.000002", 20, 3
# The registry's models.
MODELS = [("multilingual-e5-base", "Local Demo", 128, True), ("text-embedding-3-small", "OpenAI", 1536, False), ("PhoBERT-base", "VinAI", 768, True), ("bge-m3", "BAAI", 1024, True)]


def embedding_models(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(MODELS, "model_name string, provider string, dimension int, is_local boolean")
    return rows.withColumn("embedding_model_id", X.uid("model", F.col("model_name")))


def experiments(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(EXPERIMENTS, "experiment_name string, chunking_strategy string, top_k int, model string")
    model = F.when(F.col("model").isNotNull(), X.uid("model", F.col("model")))
    return rows.select(X.uid("experiment", F.col("experiment_name")).alias("experiment_id"), "experiment_name", F.lit("RAG").alias("experiment_type"), F.when(F.col("chunking_strategy").isNull(), "PENDING").otherwise("COMPLETED").alias("status"), F.lit("simple-local-answerer").alias("llm_model"), model.alias("embedding_model_id"), "chunking_strategy", "top_k")


def question_results(questions: DataFrame, docs: DataFrame, strategy: str, ks: list[int], index: Index | None = None) -> DataFrame:
    """For each question and k: the answer (content of rank 1), the metrics and token counts.

    Retrieval runs once, for the largest k; the smaller ones are its prefixes. Chunks are cut again only for hits.
    Without a stored index of the documents' chunks one is built.
    """
    size, overlap = sizes(strategy)
    asked = questions.select("item_id", F.col("question_text").alias("text"))
    hits = search(index, asked, k=max(ks)) if index else keyword_topk(asked, chunks(docs.select("doc_id", "text"), strategy), k=max(ks))
    found = with_content(hits.select("item_id", "doc_id", "chunk_index", "score", "result_rank"), docs, size, overlap)
    held = found.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("result_rank", "doc_id", "content"))).alias("all_hits"))
    each = questions.join(held, "item_id", "left").withColumn("top_k", F.explode(F.array(*map(F.lit, ks))))
    return measured(each.withColumn("hits", F.slice(F.coalesce("all_hits", F.array().cast("array<struct<result_rank:int,doc_id:bigint,content:string>>")), 1, F.col("top_k"))))


def measured(rows: DataFrame) -> DataFrame:
    """Metrics of rows with question_text, ground_truth_answer, expected_doc_id, top_k and hits in order of rank."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn("answer", F.when(F.size("hits") > 0, F.col("hits")[0]["content"]))
    kept = ["item_id", "top_k", "expected_doc_id", "hits"]
    parts = F.struct(X.tokens(F.col("question_text")).alias("question_tokens"), X.tokens(F.col("ground_truth_answer")).alias("truth_tokens"), F.coalesce(X.tokens(F.col("answer")), none).alias("answer_tokens"), X.token_set(F.array_join(F.transform("hits", lambda h: h["content"]), "\n")).alias("context"))
    # inline() keeps the lists from being worked out anew wherever they are named
    rows = rows.select(*kept, F.inline(F.array(parts)))
    bags = F.struct(V.bag(F.col("answer_tokens")).alias("answer_bag"), V.bag(F.col("truth_tokens")).alias("truth_bag"))
    rows = rows.select("*", F.inline(F.array(bags)))
    s = {c: F.array_distinct(c) for c in ("question_tokens", "truth_tokens", "answer_tokens")}
    right = F.transform("hits", lambda h: (h["doc_id"] == F.col("expected_doc_id")).cast("int"))
    upto = F.transform(right, lambda x, i: F.when(x == 1, F.aggregate(F.slice(right, 1, i + 1), F.lit(0), lambda a, y: a + y) / (i + 1)))
    gains = F.filter(upto, lambda x: x.isNotNull())
    expected = F.col("expected_doc_id").isNotNull()
    precision = F.when(F.size(gains) > 0, F.aggregate(gains, F.lit(0.0), lambda a, x: a + x) / F.size(gains)).otherwise(0.0)
    return rows.select(
        "item_id",
        "top_k",
        F.round(X.coverage(s["answer_tokens"], F.col("context")), 6).alias("faithfulness"),
        F.round(X.coverage(s["question_tokens"], s["answer_tokens"]), 6).alias("answer_relevance"),
        F.when(expected, F.round(precision, 6)).alias("context_precision"),
        F.when(expected, F.array_contains(right, 1).cast("double")).alias("context_recall"),
        F.round(X.f1(s["answer_tokens"], s["truth_tokens"]), 6).alias("answer_correctness"),
        F.round(V.bag_cosine(F.col("answer_bag"), F.col("truth_bag")), 6).alias("semantic_similarity"),
        F.size("question_tokens").alias("input_tokens"),
        F.size("answer_tokens").alias("output_tokens"),
        (F.size("question_tokens") + F.size("answer_tokens")).alias("total_tokens"),
    )


def run_experiments(spark: SparkSession, questions: DataFrame, docs: DataFrame, index: Callable[[str], Index | None] = lambda strategy: None) -> DataFrame:
    """Result rows of all experiments that have a strategy: each strategy's retrieval runs once for all its k. index: the stored one of a strategy."""
    out = None
    for strategy in sorted({s for _, s, _, _ in EXPERIMENTS if s}):
        own = [(n, k) for n, s, k, _ in EXPERIMENTS if s == strategy]
        results = question_results(questions, docs, strategy, sorted({k for _, k in own}), index(strategy))
        named = spark.createDataFrame(own, "experiment_name string, top_k int")
        rows = results.join(F.broadcast(named), "top_k").select(X.uid("experiment", F.col("experiment_name")).alias("experiment_id"), X.uid("question", F.col("item_id")).alias("evaluation_question_id"), X.uid("result", F.concat_ws(":", "experiment_name", "item_id")).alias("experiment_result_id"), *METRICS, (BASE_MS + MS_PER_TOKEN * F.col("output_tokens")).cast("int").alias("latency_ms"), "input_tokens", "output_tokens", "total_tokens", (F.col("total_tokens").cast("decimal(12,0)") * F.lit(COST_PER_TOKEN).cast("decimal(7,6)")).cast("decimal(18,6)").alias("cost"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_questions(results: DataFrame, questions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Results with their question's number and text and the name of its dataset."""
    named = questions.join(datasets.select("dataset_id", "dataset_name"), "dataset_id").select("evaluation_question_id", "question_no", "question_text", "dataset_name")
    return results.join(named, "evaluation_question_id")


KEYS = ["experiment_id", "experiment_name", "experiment_type", "status", "llm_model", "embedding_model", "chunking_strategy", "top_k"]


def _measures() -> list:
    return [F.count("experiment_result_id").alias("total_questions"), *(F.avg(m).alias(f"avg_{m}") for m in METRICS), F.avg(F.col("latency_ms").cast("double")).alias("avg_latency_ms"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("total_cost")]


def dashboard(exps: DataFrame, models: DataFrame, results: DataFrame) -> DataFrame:
    """One row per experiment: its model's name, number of results, averages and sums; experiments without results stay."""
    named = models.select("embedding_model_id", F.col("model_name").alias("embedding_model"))
    joined = exps.join(named, "embedding_model_id", "left").join(results, "experiment_id", "left")
    return joined.groupBy(*KEYS).agg(*_measures())


def dashboard_preaggregated(exps: DataFrame, models: DataFrame, results: DataFrame) -> DataFrame:
    """The same rows with results added up by experiment before they are joined, so that the join moves few rows."""
    summed = results.groupBy("experiment_id").agg(*_measures())
    named = models.select("embedding_model_id", F.col("model_name").alias("embedding_model"))
    rows = exps.join(named, "embedding_model_id", "left").join(summed, "experiment_id", "left")
    return rows.select(*KEYS, F.coalesce("total_questions", F.lit(0)).alias("total_questions"), *(f"avg_{m}" for m in METRICS), "avg_latency_ms", "total_tokens", "total_cost")
