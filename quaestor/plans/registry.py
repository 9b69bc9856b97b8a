"""Registered queries: each takes (spark, sf_dir) and runs over its whole tables; its SQL states the same for DuckDB."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.functions import vector as V
from quaestor.operators import catalog, chat, evaluation, integrity, kept, keywords, retrieval, vectors
from quaestor.operators import store as stores
from quaestor.operators.chunking import chunks, contents, counted, paged_chunks
from quaestor.plans import sql
from quaestor.sources import adapters, stored
from quaestor.sources.adapters import read
from quaestor.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(c, 5).alias(c) if c.startswith("avg_") and c != "avg_latency_ms" else c for c in rows.columns))


def _index(spark: SparkSession, sf_dir: str, strategy: str = "fixed_1200_150") -> keywords.Index:
    """The stored index of the documents' chunks: built by the first query that needs it."""
    return keywords.stored_index(spark, f"{sf_dir}/documents.parquet", strategy)


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    results = evaluation.run_experiments(spark, adapters.evaluation_questions(spark, sf_dir), docs(spark, sf_dir), lambda strategy: _index(spark, sf_dir, strategy))
    return evaluation.experiments(spark), evaluation.embedding_models(spark), results


@query(sql.dashboard())
def experiment_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.dashboard(*_run(spark, sf_dir)))


@query(sql.dashboard())
def dashboard_preaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.dashboard_preaggregated(*_run(spark, sf_dir)))


@query(f"SELECT * FROM ({sql.dashboard()}) WHERE top_k = 5 AND experiment_name = 'fixed_1200_150_top5'")
def dashboard_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.dashboard(*_run(spark, sf_dir)).where("top_k = 5 AND experiment_name = 'fixed_1200_150_top5'"))


def _dashboard_shape_sql() -> str:
    return """SELECT o_orderpriority, c_mktsegment, o_orderstatus, count(l_orderkey) AS n_lines, round(avg(l_quantity), 5) AS avg_quantity, CAST(sum(l_linenumber) AS BIGINT) AS sum_linenumber
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""


@query(_dashboard_shape_sql())
def dashboard_shape_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's shape, left joins to a dimension and to facts, on larger tables; facts are added up before the join."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_linenumber").alias("s"))
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    n = F.sum(F.coalesce("n", F.lit(0)))
    return rows.groupBy("o_orderpriority", "c_mktsegment", "o_orderstatus").agg(n.alias("n_lines"), F.round(F.sum("q") / n, 5).alias("avg_quantity"), F.sum("s").alias("sum_linenumber"))


@query(f"WITH {sql.chunks()} SELECT doc_id, chunk_index, content FROM chunks")
def chunk_fixed_1200_150(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(docs(spark, sf_dir)).select("doc_id", "chunk_index", "content")


@query(f"""WITH {sql.chunks()} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars, CAST(sum(len({sql.tokens("content")})) AS BIGINT) AS n_tokens FROM chunks GROUP BY doc_id""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = docs(spark, sf_dir).where("length(text) > 0").select("doc_id", contents(F.col("text"), 1200, 150).alias("held"))
    total = lambda f: F.aggregate("held", F.lit(0).cast("long"), lambda s, c: s + f(c))
    return held.select("doc_id", F.size("held").cast("long").alias("n_chunks"), total(F.length).alias("n_chars"), total(lambda c: F.size(X.tokens(c))).alias("n_tokens"))


@query(rf"""SELECT doc_id, CAST(length(text) AS INTEGER) AS char_count, CAST(len({sql.tokens("text")}) AS INTEGER) AS token_count,
  CAST(len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda t: t <> '')) AS INTEGER) AS word_count FROM documents""")
def document_word_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", X.char_count(t).alias("char_count"), F.size(X.tokens(t)).alias("token_count"), X.word_count(t).alias("word_count"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&[A-Za-z]+;|&#[0-9]+;', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS cleaned_text FROM pages""")
def page_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.document_pages(spark, sf_dir).select("page_id", "cleaned_text")


def _hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return keywords.search(_index(spark, sf_dir), read(spark, sf_dir, "benchmark"), k=k)


@query(f"WITH {sql.chunks()}, {sql.hits()} SELECT item_id, doc_id, chunk_index, round(score, 6) AS score, result_rank FROM hits")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("item_id", "doc_id", "chunk_index", F.round("score", 6).alias("score"), "result_rank")


@query(f"WITH {sql.chunks()}, {sql.bm25()} SELECT item_id, doc_id, chunk_index, round(score, 6) AS score, result_rank FROM bm25")
def keyword_topk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions by another metric, from the same index: BM25 with the chunks' frequencies and mean length."""
    hits = keywords.search(_index(spark, sf_dir), read(spark, sf_dir, "benchmark"), threshold=0.0, metric="bm25")
    return hits.select("item_id", "doc_id", "chunk_index", F.round("score", 6).alias("score"), "result_rank")


@query(f"""WITH {sql.chunks()}, {sql.hits()} SELECT item_id, count(doc_id) AS n_hits, count(doc_id) > 0 AS is_answerable,
  CASE WHEN count(doc_id) = 0 THEN 'NO_CHUNK_ABOVE_THRESHOLD' END AS no_answer_reason FROM benchmark LEFT JOIN hits USING (item_id) GROUP BY item_id""")
def keyword_threshold_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.answerable(read(spark, sf_dir, "benchmark"), _hits(spark, sf_dir))


_NEAREST = """WITH q AS (SELECT vec_id AS query_id, embedding AS asked FROM embeddings WHERE vec_id % 20 = 0)
  SELECT query_id, vec_id, round(score, 6) AS score, CAST(result_rank AS INTEGER) AS result_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS result_rank FROM (
      SELECT query_id, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(asked AS DOUBLE[])) AS score FROM embeddings, q)) WHERE result_rank <= 5"""


@query(_NEAREST)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a query, against all vectors."""
    return _nearest(vectors.vector_topk(_twentieth(spark, sf_dir), read(spark, sf_dir, "embeddings")))


def _twentieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _nearest(top: DataFrame) -> DataFrame:
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "result_rank")


def _cells(spark: SparkSession, sf_dir: str) -> vectors.InvertedFile:
    """The stored inverted file of the embeddings: built by the first query that needs it."""
    return vectors.stored_inverted_file(spark, f"{sf_dir}/embeddings.parquet")


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries against the nearest cells of an inverted file of all vectors; a test measures the recall."""
    return _nearest(vectors.index_topk(_cells(spark, sf_dir), _twentieth(spark, sf_dir)))


@query(_NEAREST)
def vector_index_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell asked: the rows of vector_topk, from the inverted file."""
    index = _cells(spark, sf_dir)
    return _nearest(vectors.index_topk(index, _twentieth(spark, sf_dir), probes=max(1, len(index.centroids))))


@query(f"""SELECT doc_id, b AS bucket, count(*) AS n FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 128 AS INTEGER) AS b FROM (SELECT doc_id, unnest({sql.tokens("text")}) AS t FROM documents)) GROUP BY doc_id, b""")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-zero places of each document's hashed bag of tokens; no shuffle."""
    return vectors.bags_of(docs(spark, sf_dir), "text", ["doc_id"])


_BAG = "list_transform(range(128), lambda i: CAST(len(list_filter({0}, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 128 = i)) AS DOUBLE))"


@query(f"""WITH {sql.chunks()}, c AS (SELECT doc_id, chunk_index, {_BAG.format(sql.tokens("content"))} AS v FROM chunks),
  q AS (SELECT item_id, {_BAG.format(sql.tokens("coalesce(text, '')"))} AS a FROM benchmark),
  u AS (SELECT doc_id, chunk_index, sqrt(list_dot_product(v, v)) AS s, v FROM c), w AS (SELECT item_id, sqrt(list_dot_product(a, a)) AS s, a FROM q)
  SELECT item_id, doc_id, chunk_index, round(score, 6) AS score, CAST(result_rank AS INTEGER) AS result_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS result_rank FROM (
      SELECT item_id, doc_id, chunk_index, round(CASE WHEN u.s > 0 AND w.s > 0 THEN list_dot_product(v, a) / (u.s * w.s) ELSE 0.0 END, 12) AS score FROM u, w)) WHERE result_rank <= 5""")
def hashed_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks nearest to each benchmark item by the cosine of hashed vectors of 128 places."""
    asked = vectors.vectors_of(read(spark, sf_dir, "benchmark"), "text", ["item_id"]).withColumnRenamed("item_id", "query_id")
    held = vectors.vectors_of(chunks(docs(spark, sf_dir)), "content", ["doc_id", "chunk_index"])
    top = vectors.vector_topk(asked, held, keep=("doc_id", "chunk_index"))
    return top.select(F.col("query_id").alias("item_id"), "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.round("score", 6).alias("score"), "result_rank")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.with_content(_hits(spark, sf_dir), docs(spark, sf_dir), 1200, 150)


@query(f"WITH {sql.chunks()}, {sql.hits()} SELECT item_id, doc_id, chunk_index, result_rank, content FROM hits JOIN chunks USING (doc_id, chunk_index)")
def retrieved_chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).select("item_id", "doc_id", "chunk_index", "result_rank", "content")


@query(f"""WITH {sql.chunks()}, {sql.hits()} SELECT item_id, result_rank AS citation_order, doc_id, chunk_index, 1 AS page_start, 1 AS page_end, substr(content, 1, 200) AS quote_text FROM hits JOIN chunks USING (doc_id, chunk_index)""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.citations(_contents(spark, sf_dir))


@query(f"""WITH {sql.chunks()}, {sql.hits()} SELECT item_id, '[' || string_agg('{{"citation_order":' || result_rank || ',"doc_id":' || doc_id || ',"chunk_index":' || chunk_index || '}}', ',' ORDER BY result_rank) || ']' AS citations_json FROM hits GROUP BY item_id""")
def citations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.citations_json(_hits(spark, sf_dir).withColumnRenamed("result_rank", "citation_order"))


_ANSWERS = f"WITH {sql.QUESTIONS}, {sql.results('fixed_1200_150', 1200, 150)}"


@query(f"{_ANSWERS} SELECT item_id, top_k, context_precision, context_recall FROM r_fixed_1200_150")
def context_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment_results_by_question(spark, sf_dir).select("item_id", "top_k", "context_precision", "context_recall")


@query(f"{_ANSWERS} SELECT item_id, faithfulness, answer_relevance, answer_correctness, semantic_similarity FROM r_fixed_1200_150 WHERE top_k = 5")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment_results_by_question(spark, sf_dir).where("top_k = 5").select("item_id", "faithfulness", "answer_relevance", "answer_correctness", "semantic_similarity")


@query(f"{_ANSWERS} SELECT * FROM r_fixed_1200_150")
def experiment_results_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.question_results(adapters.evaluation_questions(spark, sf_dir), docs(spark, sf_dir), "fixed_1200_150", [1, 3, 5], _index(spark, sf_dir))


@query(f"WITH {sql.QUESTIONS} SELECT item_id, question_text, question_text AS ground_truth_answer, expected_doc_id FROM questions")
def evaluation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.evaluation_questions(spark, sf_dir)


@query("SELECT conv_id, turn, role AS sender_role, text AS message_content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM conversations")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.history(adapters.chat_messages(spark, sf_dir)).select("conv_id", "turn", "sender_role", "message_content", "position")


@query("""SELECT conv_id, turn AS question_turn, answer_turn, text AS question, answer FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(turn) OVER w AS answer_turn, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def chat_qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.qa_pairs(adapters.chat_messages(spark, sf_dir))


@query(f"""SELECT conv_id, count(*) AS n_messages, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS output_tokens, CAST(sum(n) AS BIGINT) AS total_tokens
  FROM (SELECT *, len({sql.tokens("coalesce(text, '')")}) AS n FROM conversations) GROUP BY conv_id""")
def session_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.session_tokens(adapters.chat_messages(spark, sf_dir))


_JSON = "CAST(to_json(coalesce({0}, '')) AS VARCHAR)"


@query(f"""SELECT item_id, '{{"messages":[{{"role":"system","content":"{chat.SYSTEM_PROMPT}"}},{{"role":"user","content":' || {_JSON.format("text")} || '}},{{"role":"assistant","content":' || {_JSON.format("text")} || '}}]}}' AS line FROM benchmark""")
def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return chat.export_questions(b.select("item_id", F.col("text").alias("question_text"), F.col("text").alias("ground_truth_answer")))


@query(f"""SELECT conv_id, '{{"messages":[' || string_agg('{{"role":' || {_JSON.format("role")} || ',"content":' || {_JSON.format("text")} || '}}', ',' ORDER BY turn) || ']}}' AS line FROM conversations GROUP BY conv_id""")
def jsonl_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.export_sessions(adapters.chat_messages(spark, sf_dir))


@query("SELECT count(*) AS total_lines FROM benchmark")
def jsonl_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl_export(spark, sf_dir).agg(F.count("line").alias("total_lines"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def unique_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicates(docs(spark, sf_dir), ["text"])


@query("SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicates(read(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label row, as a reference check in that direction."""
    return integrity.orphans(docs(spark, sf_dir).select("doc_id"), "doc_id", read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT conv_id, turn, upper(role) AS role_name FROM conversations WHERE upper(role) NOT IN ('ADMIN', 'TEACHER', 'STUDENT', 'RESEARCHER')")
def role_check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.role_violations(read(spark, sf_dir, "conversations").select("conv_id", "turn", F.upper("role").alias("role_name")))


def _model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents, chunks and citations of hits as tables of the model, to delete from."""
    d = adapters.course_documents(spark, sf_dir)
    owner = X.uid("user", F.col("source"))
    documents = d.select("document_id", "workspace_id", "course_id", owner.alias("uploaded_by"), "document_title")
    cut = chunks(docs(spark, sf_dir)).select(X.uid("chunk", F.concat_ws(":", "doc_id", "chunk_index")).alias("chunk_id"), X.uid("document", F.col("doc_id")).alias("document_id"), "chunk_index")
    return {"course_documents": documents, "document_chunks": cut}


@query(f"""WITH {sql.chunks()} SELECT {sql.uid("chunk", "doc_id || ':' || chunk_index")} AS chunk_id, {sql.uid("document", "doc_id")} AS document_id, chunk_index FROM chunks JOIN documents USING (doc_id) WHERE source <> 'src3'""")
def cascade_delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that stay when the documents of one source are deleted."""
    tables = _model(spark, sf_dir)
    gone = adapters.course_documents(spark, sf_dir).where("source = 'src3'").select("document_id")
    left, _ = integrity.delete(tables, "course_documents", gone)
    return left["document_chunks"]


@query(f"""SELECT {sql.uid("document", "doc_id")} AS document_id, CASE WHEN source <> 'src3' THEN {sql.uid("user", "source")} END AS uploaded_by FROM documents""")
def set_null_on_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after one user is deleted: they stay, and their uploader is cleared."""
    tables = _model(spark, sf_dir)
    users = tables["course_documents"].select(F.col("uploaded_by").alias("user_id")).distinct()
    gone = spark.range(1).select(X.uid("user", F.lit("src3")).alias("user_id"))
    left, _ = integrity.delete(tables | {"users": users}, "users", gone)
    return left["course_documents"].select("document_id", "uploaded_by")


@query(f"""WITH {sql.chunks()}, {sql.hits()} SELECT item_id, {sql.uid("document", "doc_id")} AS document_id, result_rank FROM hits JOIN documents USING (doc_id) WHERE source = 'src3'""")
def restrict_delete_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval results that keep the documents of one source from being deleted."""
    tables = _model(spark, sf_dir)
    results = _hits(spark, sf_dir).select("item_id", X.uid("hit", F.concat_ws(":", "item_id", "result_rank")).alias("retrieval_result_id"), X.uid("document", F.col("doc_id")).alias("document_id"), X.uid("chunk", F.concat_ws(":", "doc_id", "chunk_index")).alias("chunk_id"), "result_rank")
    gone = adapters.course_documents(spark, sf_dir).where("source = 'src3'").select("document_id")
    _, blocked = integrity.delete(tables | {"retrieval_results": results}, "course_documents", gone)
    return blocked["retrieval_results", "document_id"].select("item_id", "document_id", "result_rank")


@query("""SELECT md5_id AS document_id, 'UPLOADED' AS processing_status, lang AS language, CAST('2024-01-01' AS TIMESTAMP) AS uploaded_at FROM (SELECT *, """ + sql.uid("course_documents", "doc_id") + """ AS md5_id FROM documents)""")
def defaults_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"))
    return integrity.with_defaults(rows, "course_documents", ["doc_id"], "2024-01-01").select("document_id", "processing_status", "language", "uploaded_at")


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'low' ELSE lang END AS lang, source FROM documents LEFT JOIN labels USING (doc_id)")
def patch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").alias("lang"))
    return integrity.patch(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), changes, "doc_id")


@query(f"""SELECT {sql.uid("document", "doc_id")} AS document_id, 'doc_' || doc_id AS document_title, 'doc_' || doc_id || '.txt' AS original_filename, 'TXT' AS file_type, 'UPLOADED' AS processing_status, 1 AS total_pages FROM documents WHERE source = 'src1'""")
def documents_by_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = catalog.listing(adapters.course_documents(spark, sf_dir), "documents_of_workspace", _id("workspace", "src1"))
    return shown.select("document_id", "document_title", "original_filename", "file_type", "processing_status", "total_pages")


def _id(kind: str, key: str) -> str:
    """X.uid() of a known key."""
    h = hashlib.md5(f"{kind}:{key}".encode()).hexdigest()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


@query(f"""WITH {sql.chunks()} SELECT chunk_index, content, CAST(len({sql.tokens("content")}) AS INTEGER) AS token_count FROM chunks WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE length(text) = (SELECT max(length(text)) FROM documents))""")
def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the longest document."""
    d = docs(spark, sf_dir)
    longest = d.agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))
    return counted(chunks(d.join(F.broadcast(longest), "doc_id"))).select("chunk_index", "content", "token_count")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def active_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active(read(spark, sf_dir, "labels").withColumn("is_active", F.col("quality") == 1)).select("doc_id", "quality", "toxic")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) >= 50 AS granted FROM events")
def permissions_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission JSON built from the events' property, and read back."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct((k >= 50).alias("chat"), F.lit(False).alias("all"))).alias("permission_json"))
    return e.select("event_id", catalog.allowed(F.col("permission_json"), "chat").alias("granted"))


@query("""SELECT n_nationkey, n_name, 'ADMIN' AS role_name FROM nation WHERE n_name = 'NATION_1' UNION ALL SELECT n_nationkey, n_name, 'TEACHER' FROM nation WHERE n_name = 'NATION_2'""")
def insert_from_select_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return integrity.insert_from_select(n, [("NATION_1", {"role_name": "ADMIN"}), ("NATION_2", {"role_name": "TEACHER"})], "n_name")


@query("SELECT s_suppkey, s_name, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 99) AS missing_key, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 1) AS found_key FROM supplier")
def scalar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups into a value: null where nothing matches."""
    n = read(spark, sf_dir, "nation")
    one = n.agg(F.max(F.when(F.col("n_regionkey") == 99, F.col("n_nationkey"))).alias("missing_key"), F.max(F.when(F.col("n_regionkey") == 1, F.col("n_nationkey"))).alias("found_key"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").crossJoin(F.broadcast(one))


@query("SELECT lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS rewritten_query, item_id FROM benchmark")
def rewritten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(X.rewrite(F.col("text")).alias("rewritten_query"), "item_id")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) = 64 AS right_dimension, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings")
def embedding_dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as JSON text and parsed again, against the dimension they should have."""
    parsed = read(spark, sf_dir, "embeddings").select("vec_id", V.from_json(F.to_json("embedding")).alias("v"))
    return parsed.select("vec_id", V.right_dimension(F.col("v"), F.lit(64)).alias("right_dimension"), F.size("v").alias("dimension"))


@query("SELECT doc_id, true AS success, 'OK' AS message, lang FROM documents")
def response_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.envelope(read(spark, sf_dir, "documents").select("doc_id", "lang"))
    return e.select("response.data.doc_id", "response.success", "response.message", "response.data.lang")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming window query; an addition of this engine."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("w.start", "event_type", "n", "total")


_PAGES = f"""pages_of AS (SELECT doc_id, {sql.uid("document", "doc_id")} AS document_id, CAST(i + 1 AS INTEGER) AS page_number, {sql.clean(f"substr(text, i * {adapters.PAGE_CHARS} + 1, {adapters.PAGE_CHARS})")} AS cleaned_text
  FROM documents, LATERAL (SELECT unnest(range(CAST(ceil(length(text) / {adapters.PAGE_CHARS}.0) AS BIGINT))) AS i) WHERE length(text) > 0)"""


@query(f"WITH {_PAGES} SELECT document_id, max(page_number) AS total_pages, count(*) AS n_pages, CAST(sum(length(cleaned_text)) AS BIGINT) AS n_chars FROM pages_of GROUP BY document_id")
def document_total_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document, as ingested."""
    p = adapters.paged_documents(spark, sf_dir)
    return p.groupBy("document_id").agg(F.max("page_number").alias("total_pages"), F.count("*").alias("n_pages"), F.sum("char_count").alias("n_chars"))


@query(f"""WITH {_PAGES}, joined AS (SELECT document_id, string_agg(cleaned_text, chr(10) ORDER BY page_number) AS text FROM pages_of GROUP BY document_id),
  places AS (SELECT document_id, page_number, sum(length(cleaned_text) + 1) OVER (PARTITION BY document_id ORDER BY page_number) AS stop, length(cleaned_text) + 1 AS n FROM pages_of),
  cut AS (SELECT document_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * 1050 + 1, 1200) AS content, i * 1050 AS first, least(i * 1050 + 1200, length(text)) AS last
    FROM joined, LATERAL (SELECT unnest(range(1 + greatest(0, CAST(ceil((length(text) - 1200) / 1050.0) AS BIGINT)))) AS i) WHERE length(text) > 0)
  SELECT document_id, chunk_index, content, min(page_number) AS page_start, max(page_number) AS page_end FROM cut JOIN places USING (document_id) WHERE stop - n < last AND stop > first GROUP BY ALL""")
def paged_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks across the pages of each document, with the pages that they cover."""
    return paged_chunks(adapters.paged_documents(spark, sf_dir))


@query(f"""WITH {sql.chunks()}, {sql.hits()}, f AS (SELECT item_id, content FROM hits JOIN chunks USING (doc_id, chunk_index) WHERE result_rank = 1),
  j AS (SELECT item_id, '[' || string_agg('{{"citation_order":' || result_rank || ',"doc_id":' || doc_id || ',"chunk_index":' || chunk_index || '}}', ',' ORDER BY result_rank) || ']' AS citations_json, count(*) AS n FROM hits GROUP BY item_id)
  SELECT item_id, coalesce(n, 0) AS n_hits, coalesce(n, 0) > 0 AS is_answerable, CASE WHEN n IS NULL THEN 'NO_CHUNK_ABOVE_THRESHOLD' END AS no_answer_reason, substr(content, 1, 200) AS answer, citations_json
  FROM benchmark LEFT JOIN f USING (item_id) LEFT JOIN j USING (item_id)""")
def ask_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item asked: answer, reason if there is none, citations."""
    return retrieval.ask(read(spark, sf_dir, "benchmark"), docs(spark, sf_dir), index=_index(spark, sf_dir))["answers"]


@query(f"""WITH {sql.chunks()}, {sql.hits()} SELECT item_id, text AS query_text, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS rewritten_query, 5 AS top_k, 'keyword' AS similarity_metric, 0.05::DOUBLE AS similarity_threshold,
  count(doc_id) > 0 AS is_answerable, CASE WHEN count(doc_id) = 0 THEN 'NO_CHUNK_ABOVE_THRESHOLD' END AS no_answer_reason FROM benchmark LEFT JOIN hits USING (item_id) GROUP BY item_id, text""")
def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ask(read(spark, sf_dir, "benchmark"), docs(spark, sf_dir), index=_index(spark, sf_dir))["retrieval_queries"]


@query(f"""WITH {sql.chunks()}, {sql.hits()}, f AS (SELECT h.*, {sql.tokens("content")} AS c, {sql.tokens("b.text")} AS q FROM hits h JOIN chunks USING (doc_id, chunk_index) JOIN benchmark b USING (item_id)),
  g AS (SELECT item_id, doc_id, chunk_index, score, result_rank, CASE WHEN result_rank % 2 = 1 THEN 2 * len(list_intersect(list_distinct(q), list_distinct(c))) / CAST(len(list_distinct(q)) + len(list_distinct(c)) AS DOUBLE) END AS rerank_score FROM f)
  SELECT item_id, doc_id, chunk_index, round(rerank_score, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY coalesce(rerank_score, score) DESC, result_rank) AS INTEGER) AS result_rank FROM g""")
def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in a new order: those with odd ranks by the F1 of their tokens, the others, which have no such score, by similarity."""
    asked = read(spark, sf_dir, "benchmark").select("item_id", X.token_set(F.col("text")).alias("q"))
    hits = _contents(spark, sf_dir).join(asked, "item_id")
    scored = hits.withColumn("rerank_score", F.when(F.col("result_rank") % 2 == 1, X.f1(F.col("q"), X.token_set(F.col("content")))))
    return retrieval.reranked(scored).select("item_id", "doc_id", "chunk_index", F.round("rerank_score", 6).alias("rerank_score"), "result_rank")


@query(f"""WITH {sql.chunks()}, {sql.hits()}, c AS (SELECT item_id, result_rank AS citation_order, CASE WHEN result_rank > 1 THEN item_id || ':' || result_rank END AS retrieval_result_id, CASE WHEN result_rank < 5 THEN doc_id END AS doc_id FROM hits)
  SELECT item_id, citation_order, CASE WHEN retrieval_result_id IS NOT NULL THEN (SELECT round(score, 6) FROM hits h WHERE h.item_id || ':' || h.result_rank = retrieval_result_id) END AS similarity_score,
    CASE WHEN doc_id IS NOT NULL THEN 'doc_' || doc_id END AS document_title FROM c""")
def citations_with_nullable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations whose result or document is not named stay, without what it would have said."""
    hits = _hits(spark, sf_dir).withColumn("of", F.concat_ws(":", "item_id", "result_rank"))
    cited = hits.select("item_id", F.col("result_rank").alias("citation_order"), F.when(F.col("result_rank") > 1, F.col("of")).alias("retrieval_result_id"), F.when(F.col("result_rank") < 5, X.uid("document", F.col("doc_id"))).alias("document_id"))
    results = hits.select(F.col("of").alias("retrieval_result_id"), F.round("score", 6).alias("similarity_score"))
    return retrieval.cited_with(cited, results, adapters.course_documents(spark, sf_dir)).select("item_id", "citation_order", "similarity_score", "document_title")


@query(f"""WITH {sql.chunks()}, m(model_name, dimension) AS (VALUES {", ".join(f"('{n}', {d})" for n, _, d, _ in evaluation.MODELS)})
  SELECT doc_id, chunk_index, model_name, m.dimension AS model_dimension, 128 AS dimension, m.dimension = 128 AS right_dimension
  FROM chunks JOIN m ON m.model_name = CASE chunk_index % 3 WHEN 0 THEN 'multilingual-e5-base' WHEN 1 THEN 'bge-m3' END""")
def chunk_embeddings_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors with their chunk and their model, whose dimension they should have; a model that is not in the registry joins none."""
    cut = chunks(docs(spark, sf_dir)).withColumn("chunk_id", X.uid("chunk", F.concat_ws(":", "doc_id", "chunk_index")))
    name = F.when(F.col("chunk_index") % 3 == 0, "multilingual-e5-base").when(F.col("chunk_index") % 3 == 1, "bge-m3").otherwise("missing-model")
    made = vectors.vectors_of(cut.withColumn("embedding_model_id", X.uid("model", name)), "content", ["chunk_id", "embedding_model_id"])
    held = made.select("chunk_id", "embedding_model_id", F.to_json("embedding").alias("embedding_json"))
    joined = retrieval.embeddings_with_models(held, cut.select("chunk_id", "doc_id", "chunk_index"), evaluation.embedding_models(spark))
    return joined.select("doc_id", "chunk_index", "model_name", "model_dimension", "dimension", "right_dimension")


@query("SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id % 7 ORDER BY item_id) AS INTEGER) AS question_no, CAST(item_id % 7 AS INTEGER) AS dataset FROM benchmark")
def questions_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions numbered from 1 within their dataset."""
    b = read(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 7).cast("int").alias("dataset"))
    return catalog.numbered(b, "dataset", ["item_id"], "question_no").select("item_id", "question_no", "dataset")


@query("SELECT source, lang, CAST(row_number() OVER (PARTITION BY source ORDER BY lang) AS INTEGER) AS order_index FROM (SELECT DISTINCT source, lang FROM documents)")
def chapters_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter for each language of a course, in order from 1."""
    d = read(spark, sf_dir, "documents").select("source", "lang").distinct()
    return catalog.numbered(d, "source", ["lang"], "order_index").select("source", "lang", "order_index")


@query("""WITH new AS (SELECT 'r' || c_custkey % 140 AS user_role_id, CASE WHEN c_custkey % 11 > 0 THEN 'u' || c_custkey END AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'ADMIN' WHEN 'MACHINERY' THEN 'TEACHER' ELSE c_mktsegment END AS role_name FROM customer WHERE c_custkey % 10 < 5),
  old AS (SELECT 'r' || s_suppkey AS user_role_id FROM supplier WHERE s_suppkey < 50), n AS (SELECT user_role_id, count(*) AS n FROM new GROUP BY ALL)
  SELECT user_role_id, user_id, role_name, array_to_string(list_filter([CASE WHEN user_id IS NULL THEN 'user_id missing' END, CASE WHEN role_name NOT IN ('ADMIN', 'TEACHER', 'STUDENT', 'RESEARCHER') THEN 'role_name not allowed' END,
    CASE WHEN n > 1 OR user_role_id IN (SELECT user_role_id FROM old) THEN 'user_role_id not unique' END, CASE WHEN user_id IS NOT NULL AND user_id NOT IN (SELECT 'u' || o_custkey FROM orders) THEN 'user_id not among users' END], lambda x: x IS NOT NULL), '; ') AS reasons
  FROM new JOIN n USING (user_role_id)""")
def insert_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows may not be added: values that are missing or outside the list, keys that are taken or shared, users who are not there."""
    role = F.when(F.col("c_mktsegment") == "BUILDING", "ADMIN").when(F.col("c_mktsegment") == "MACHINERY", "TEACHER").otherwise(F.col("c_mktsegment"))
    key = F.col("c_custkey")
    new = read(spark, sf_dir, "customer").where(key % 10 < 5).select(F.concat(F.lit("r"), key % 140).alias("user_role_id"), F.when(key % 11 > 0, F.concat(F.lit("u"), key)).alias("user_id"), role.alias("role_name"))
    old = read(spark, sf_dir, "supplier").where("s_suppkey < 50").select(F.concat(F.lit("r"), "s_suppkey").alias("user_role_id"))
    users = read(spark, sf_dir, "orders").select(F.concat(F.lit("u"), "o_custkey").alias("user_id"))
    return integrity.rejections(old, new, "user_roles", {"users": users}).withColumn("reasons", F.array_join("reasons", "; "))


@query("SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role IS NULL OR role = 'tool' THEN 'sender_role' END, CASE WHEN turn % 5 = 0 THEN 'message_content' END], lambda x: x IS NOT NULL), ',') AS missing FROM conversations WHERE role IS NULL OR role = 'tool' OR turn % 5 = 0")
def not_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that lack what the schema asks for, once every fifth turn lost its text and tools their role."""
    c = read(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("role") != "tool", F.col("role")).alias("sender_role"), F.when(F.col("turn") % 5 > 0, F.coalesce("text", F.lit(""))).alias("message_content"))
    return integrity.missing(rows, "chat_messages").select("conv_id", "turn", F.array_join("missing", ",").alias("missing"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'low' ELSE lang END AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def patch_with_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same change given twice, once without a value, doubles no row."""
    changes = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").alias("lang"))
    return integrity.patch(read(spark, sf_dir, "documents").select("doc_id", "lang"), changes.unionByName(changes.withColumn("lang", F.lit(None).cast("string"))), "doc_id")


def _store(spark: SparkSession, *names: str) -> stores.Store:
    """A new database with empty tables in the shared folder."""
    return stores.Store.create(spark, f"quaestor_{uuid.uuid4().hex}", names, stored.new_path(spark, "database"))


def _uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.course_documents(spark, sf_dir)
    return d.select("document_id", "workspace_id", "course_id", "document_title", "original_filename", "file_type", F.concat(F.lit("/uploads/"), "original_filename").alias("file_path"), "file_size_bytes", "doc_id")


@query(f"""SELECT {sql.uid("document", "doc_id")} AS document_id, 'doc_' || doc_id AS document_title, 'UPLOADED' AS processing_status, 'vi' AS language, CAST(NULL AS INTEGER) AS total_pages, octet_length(encode(text)) AS file_size_bytes FROM documents""")
def documents_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added to a written table in two lots without the columns that have defaults; a third lot, whose keys are taken, is rejected. The table read back."""
    store, new = _store(spark, "course_documents"), _uploaded(spark, sf_dir)
    for lot in (0, 1):
        store.append("course_documents", new.where(F.col("doc_id") % 2 == lot).drop("doc_id"))
    try:
        store.append("course_documents", new.where(F.col("doc_id") % 3 == 0).drop("doc_id"))
    except stores.Rejected:
        pass
    else:
        raise AssertionError("keys that are taken were added")
    return store.table("course_documents").select("document_id", "document_title", "processing_status", "language", "total_pages", "file_size_bytes")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(X.uid("user", F.col("c_custkey")).alias("user_id"), F.col("c_name").alias("full_name"), F.concat("c_name", F.lit("@example.org")).alias("email"), F.lit("-").alias("password_hash"), (F.col("c_acctbal") > 0).alias("is_active"), "c_custkey")


@query(f"""SELECT {sql.uid("user", "c_custkey")} AS user_id, c_acctbal > 0 AS is_active, CASE WHEN c_acctbal > 0 AND c_custkey % 7 = 0 THEN TIMESTAMP '2024-02-02 08:00:00' END AS last_login_at,
  CASE WHEN c_custkey % 21 = 0 THEN TIMESTAMP '2024-02-02 17:00:00' END AS last_logout_at FROM customer""")
def login_times_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in a written table, of whom some log in, and some out: their rows' partitions are rewritten. The table read back."""
    store, users = _store(spark, "users"), _users(spark, sf_dir)
    store.append("users", users.drop("c_custkey"))
    some = lambda n, at: users.where(F.col("c_custkey") % n == 0).select("user_id", F.lit(at).cast("timestamp_ntz").alias("at"))
    stores.log_in(store, some(7, "2024-02-02 08:00:00"))
    stores.log_out(store, some(21, "2024-02-02 17:00:00"))
    return store.table("users").select("user_id", "is_active", "last_login_at", "last_logout_at")


@query(f"""SELECT {sql.uid("user", "c_custkey")} AS user_id, c_name || '@example.org' AS email, CASE WHEN c_custkey % 5 = 0 THEN 'TEACHER' ELSE 'STUDENT' END AS role_name FROM customer""")
def users_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and their roles, added together in two lots; read back and joined."""
    store, users = _store(spark, "users", "user_roles"), _users(spark, sf_dir)
    for role, own in (("TEACHER", F.col("c_custkey") % 5 == 0), ("STUDENT", F.col("c_custkey") % 5 > 0)):
        stores.register(store, users.where(own).drop("c_custkey"), role)
    return store.table("users").join(store.table("user_roles"), "user_id").select("user_id", "email", "role_name")


@query(f"WITH {_PAGES} SELECT p.document_id, page_number FROM pages_of p JOIN documents USING (doc_id) WHERE source <> 'src3'")
def cascade_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A course's workspace is deleted from written tables, its documents and their pages with it, three levels down. The pages that stay, read back."""
    store, new = _store(spark, "course_workspaces", "course_documents", "document_pages"), _uploaded(spark, sf_dir)
    store.append("course_workspaces", new.select("workspace_id", "course_id").distinct().withColumn("workspace_title", F.lit("course")))
    store.append("course_documents", new.drop("doc_id"))
    pages = adapters.paged_documents(spark, sf_dir)
    store.append("document_pages", pages.select("document_id", "page_number", "cleaned_text", "word_count", "char_count"), ["document_id", "page_number"])
    gone = spark.range(1).select(X.uid("workspace", F.lit("src3")).alias("workspace_id"))
    store.delete("course_workspaces", gone)
    return store.table("document_pages").select("document_id", "page_number")


@query(sql.dashboard())
def dashboard_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments and models in written tables; results come in three lots, of which the second twice; the view over what they add up to."""
    store = _store(spark, "experiments", "embedding_models")
    exps, models, results = _run(spark, sf_dir)
    store.append("embedding_models", models)
    run = exps.withColumns({"dataset_id": F.lit("benchmark"), "course_id": F.lit("all")})
    store.append("experiments", run.withColumn("embedding_model_id", F.when(F.col("embedding_model_id") != _id("model", "missing-model"), F.col("embedding_model_id"))))
    kept.create_dashboard(store)
    lot = F.pmod(F.xxhash64("experiment_result_id"), F.lit(3))
    done = stored.staged(results.withColumn("lot", lot), "results")
    for n in (0, 1, 1, 2):
        kept.add_results(store, done.where(F.col("lot") == n).drop("lot"), f"lot{n}")
    return rounded(kept.dashboard_view(store))


@query(f"""WITH c AS (SELECT coalesce(text, '') || chr(10) AS raw, {sql.clean("coalesce(text, '')")} AS t FROM documents)
  SELECT sha256(raw) AS raw_sha256, 'TXT' AS file_type, octet_length(encode(raw)) AS file_size_bytes, 'CHUNKED' AS processing_status, 1 AS total_pages, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE 1 + greatest(0, ceil((length(t) - 1200) / 1050.0)) END AS BIGINT) AS n_chunks,
    CAST(CASE WHEN length(t) = 0 THEN 0 ELSE length(t) + 150 * greatest(0, ceil((length(t) - 1200) / 1050.0)) END AS BIGINT) AS n_chars FROM c""")
def documents_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, a file each, and taken by the file stream: their text, status, pages and chunks."""
    folder, out = stored.new_path(spark, "uploads"), stored.new_path(spark, "ingested")
    # files go to their place as their task ends, not one by one at the end of all
    written = read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit(""))).write.option("maxRecordsPerFile", 1)
    written.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder, lineSep="\n")
    made = ingest.ingest(spark, folder, out, batch=100_000)
    chunks = made["document_chunks"].groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))
    texts = made["document_pages"].select("document_id", F.sha2("raw_text", 256).alias("raw_sha256"))
    counts = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_chunks", "n_chars"))
    return made["course_documents"].join(texts, "document_id").join(chunks, "document_id", "left").select("raw_sha256", "file_type", "file_size_bytes", "processing_status", "total_pages", *counts)


@query("""SELECT CAST(json_extract(props, '$.k') AS INTEGER) // 10 AS decade, count(*) AS n, CAST(count(json_extract(props, '$.missing')) AS BIGINT) AS n_missing_path, CAST(sum(CAST(event_id % 5 = 0 AS INTEGER)) AS BIGINT) AS n_broken
  FROM events GROUP BY ALL""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open JSON by path, without a schema: every fifth text is also cut short, which makes it null and stops nothing."""
    v = F.try_parse_json("props")
    broken = F.when(F.col("event_id") % 5 == 0, F.try_parse_json(F.expr("substr(props, 1, length(props) - 1)")).isNull()).otherwise(False)
    e = read(spark, sf_dir, "events").select(F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"), broken.alias("broken"))
    return e.groupBy(F.floor(F.col("k") / 10).cast("int").alias("decade")).agg(F.count("*").alias("n"), F.count("missing").alias("n_missing_path"), F.count_if("broken").alias("n_broken"))


def _listed(name: str, oracle: str, rows: Callable[[SparkSession, str], DataFrame], parent: str | None = None) -> None:
    """Registers a list operation over rows in the model's columns."""
    QUERIES[f"list_{name}"] = lambda spark, sf_dir: catalog.listing(rows(spark, sf_dir), name, parent)
    ORACLES[f"list_{name}"] = oracle


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.chat_messages(spark, sf_dir)
    return m.select(X.uid("message", F.concat_ws(":", "conv_id", "turn")).alias("message_id"), X.uid("session", F.col("conv_id")).alias("chat_session_id"), "sender_role", "message_content", "input_tokens", "output_tokens")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    numbered = catalog.numbered(b.withColumn("dataset_id", X.uid("dataset", F.col("item_id") % 2)), "dataset_id", ["item_id"], "question_no")
    return numbered.select(X.uid("question", F.col("item_id")).alias("evaluation_question_id"), "dataset_id", "question_no", F.col("text").alias("question_text"), F.col("text").alias("ground_truth_answer"), F.lit("FACTUAL").alias("question_type"), F.lit("MEDIUM").alias("difficulty"))


@query(f"""SELECT {sql.uid("message", "conv_id || ':' || turn")} AS message_id, role AS sender_role, 'conversation ' || conv_id AS session_title, n AS session_messages
  FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (conv_id) WHERE turn > 0""")
def messages_with_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages behind the first, each with the title and the size of its session."""
    sessions = _sessions(spark, sf_dir)
    later = _messages(spark, sf_dir).join(read(spark, sf_dir, "conversations").where("turn > 0").select(X.uid("message", F.concat_ws(":", "conv_id", "turn")).alias("message_id")), "message_id", "left_semi")
    return chat.with_sessions(later, sessions).select("message_id", "sender_role", "session_title", "session_messages")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("session_messages"))
    return held.select(X.uid("session", F.col("conv_id")).alias("chat_session_id"), X.uid("workspace", F.col("conv_id") % 5).alias("workspace_id"), F.concat(F.lit("conversation "), "conv_id").alias("session_title"), "session_messages")


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "benchmark").select((F.col("item_id") % 2).alias("n")).distinct()
    return own.select(X.uid("dataset", F.col("n")).alias("dataset_id"), X.uid("course", F.lit("all")).alias("course_id"), F.concat(F.lit("set "), "n").alias("dataset_name"), F.lit("v1").alias("dataset_version"))


@query(f"""{_ANSWERS} SELECT item_id, top_k, context_recall, answer_correctness, question_no, 'set ' || item_id % 2 AS dataset_name
  FROM r_fixed_1200_150 JOIN (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id) AS INTEGER) AS question_no FROM benchmark) USING (item_id)""")
def results_with_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the number of their question and the name of its dataset."""
    results = experiment_results_by_question(spark, sf_dir).withColumn("evaluation_question_id", X.uid("question", F.col("item_id")))
    return evaluation.with_questions(results, _questions(spark, sf_dir), _datasets(spark, sf_dir)).select("item_id", "top_k", "context_recall", "answer_correctness", "question_no", "dataset_name")


@query(f"""WITH {sql.chunks()}, {sql.hits()} SELECT item_id, '[' || string_agg('{{"result_rank":' || result_rank || ',"doc_id":' || doc_id || ',"chunk_index":' || chunk_index || ',"n_chars":' || length(content) || '}}', ',' ORDER BY result_rank) || ']' AS retrieved_context_json, CAST(sum(length(content)) AS BIGINT) AS context_chars
  FROM hits JOIN chunks USING (doc_id, chunk_index) GROUP BY item_id""")
def retrieved_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question retrieved, in order of rank, as JSON."""
    return retrieval.context_json(_contents(spark, sf_dir))


_U = sql.uid
_listed("users", f"SELECT {_U('user', 'c_custkey')} AS user_id, c_name AS full_name, c_acctbal > 0 AS is_active FROM customer", lambda s, d: read(s, d, "customer").select(X.uid("user", F.col("c_custkey")).alias("user_id"), F.col("c_name").alias("full_name"), (F.col("c_acctbal") > 0).alias("is_active"), F.lit("secret").alias("password_hash")))
_listed("courses", f"SELECT DISTINCT {_U('course', 'source')} AS course_id, source AS course_code FROM documents", lambda s, d: read(s, d, "documents").select(X.uid("course", F.col("source")).alias("course_id"), F.col("source").alias("course_code")).distinct())
_listed("pages_of_document", f"WITH {_PAGES} SELECT document_id, page_number, cleaned_text, CAST(length(cleaned_text) AS INTEGER) AS char_count FROM pages_of WHERE doc_id = 7", lambda s, d: adapters.paged_documents(s, d).drop("word_count"), _id("document", "7"))
_listed("chunks_of_document", f"WITH {sql.chunks()} SELECT {_U('chunk', "doc_id || ':' || chunk_index")} AS chunk_id, {_U('document', 'doc_id')} AS document_id, chunk_index, 'fixed_1200_150' AS chunk_strategy, content, 1 AS page_start, 1 AS page_end, CAST(len({sql.tokens('content')}) AS INTEGER) AS token_count FROM chunks WHERE doc_id = 7", lambda s, d: counted(chunks(docs(s, d))).withColumns({"chunk_id": X.uid("chunk", F.concat_ws(":", "doc_id", "chunk_index")), "document_id": X.uid("document", F.col("doc_id"))}), _id("document", "7"))
_listed("history_of_session", f"SELECT {_U('message', "conv_id || ':' || turn")} AS message_id, {_U('session', 'conv_id')} AS chat_session_id, role AS sender_role, text AS message_content, CAST(CASE WHEN role = 'assistant' THEN 0 ELSE n END AS INTEGER) AS input_tokens, CAST(CASE WHEN role = 'assistant' THEN n ELSE 0 END AS INTEGER) AS output_tokens FROM (SELECT *, len({sql.tokens("coalesce(text, '')")}) AS n FROM conversations) WHERE conv_id = 3", _messages, _id("session", "3"))
_listed("embedding_models", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}', {d}, {str(x).lower()})" for n, p, d, x in evaluation.MODELS) + ") AS m(model_name, provider, dimension, is_local)", lambda s, d: evaluation.embedding_models(s).drop("embedding_model_id"))
_listed("questions_of_dataset", f"SELECT {_U('question', 'item_id')} AS evaluation_question_id, CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS question_no, text AS question_text, text AS ground_truth_answer, 'FACTUAL' AS question_type, 'MEDIUM' AS difficulty FROM benchmark WHERE item_id % 2 = 1", _questions, _id("dataset", "1"))
_listed("results_of_experiment", f"{_ANSWERS} SELECT {_U('result', "'fixed_1200_150_top3:' || item_id")} AS experiment_result_id, {_U('experiment', "'fixed_1200_150_top3'")} AS experiment_id, {_U('question', 'item_id')} AS evaluation_question_id, faithfulness, answer_relevance, context_precision, context_recall, answer_correctness, semantic_similarity FROM r_fixed_1200_150 WHERE top_k = 3", lambda s, d: _run(s, d)[2], _id("experiment", "fixed_1200_150_top3"))
_listed("user_roles", f"SELECT {_U('role', 'c_custkey')} AS user_role_id, {_U('user', 'c_custkey')} AS user_id, 'STUDENT' AS role_name FROM customer WHERE c_custkey = 12", lambda s, d: _users(s, d).select(X.uid("role", F.col("c_custkey")).alias("user_role_id"), "user_id", F.lit("STUDENT").alias("role_name")), _id("user", "12"))
_listed("chapters_of_course", f"SELECT {_U('chapter', "source || ':' || lang")} AS chapter_id, {_U('course', 'source')} AS course_id, lang AS chapter_title, CAST(row_number() OVER (ORDER BY lang) AS INTEGER) AS order_index FROM (SELECT DISTINCT source, lang FROM documents WHERE source = 'src2')", lambda s, d: chapters_numbered(s, d).select(X.uid("chapter", F.concat_ws(":", "source", "lang")).alias("chapter_id"), X.uid("course", F.col("source")).alias("course_id"), F.col("lang").alias("chapter_title"), "order_index"), _id("course", "src2"))
_listed("workspaces_of_course", f"SELECT DISTINCT {_U('workspace', 'source')} AS workspace_id, {_U('course', 'source')} AS course_id FROM documents WHERE source = 'src1'", lambda s, d: adapters.course_documents(s, d).select("workspace_id", "course_id").distinct(), _id("course", "src1"))
_listed("sessions_of_workspace", f"SELECT {_U('session', 'conv_id')} AS chat_session_id, {_U('workspace', 'conv_id % 5')} AS workspace_id, 'conversation ' || conv_id AS session_title, count(*) AS session_messages FROM conversations WHERE conv_id % 5 = 2 GROUP BY conv_id", _sessions, _id("workspace", "2"))
_listed("datasets", f"SELECT DISTINCT {_U('dataset', 'item_id % 2')} AS dataset_id, {_U('course', "'all'")} AS course_id, 'set ' || item_id % 2 AS dataset_name, 'v1' AS dataset_version FROM benchmark", _datasets)
_listed("retrieval_results", f"WITH {sql.chunks()}, {sql.hits()} SELECT {_U('hit', "item_id || ':' || result_rank")} AS retrieval_result_id, item_id, doc_id, chunk_index, result_rank, round(score, 6) AS similarity_score FROM hits", lambda s, d: retrieval.ask(read(s, d, "benchmark"), docs(s, d), index=_index(s, d))["retrieval_results"].withColumn("similarity_score", F.round("similarity_score", 6)))
