"""Operators of the model on small fixtures: nulls, empty input, ties, dangling keys, Vietnamese text."""

import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quaestor import schema as S
from quaestor.functions import text as X
from quaestor.functions import vector as V
from quaestor.operators import catalog, chat, evaluation, integrity, keywords, retrieval, vectors
from quaestor.operators.chunking import chunks, paged_chunks, sizes
from quaestor.sources import files
from quaestor.streaming import chat as stream


def test_schema():
    assert len(S.TABLES) == 20
    assert sum(len(S.columns(t)) for t in S.TABLES) == 225
    rules = [r.rule for r in S.references()]
    assert (len(rules), rules.count("C"), rules.count("N"), rules.count("R")) == (42, 15, 6, 21)
    assert S.schema("experiment_results")["cost"].dataType.simpleString() == "decimal(18,6)"
    assert all(r.column in {c.name for c in S.columns(r.child)} for r in S.references())


def test_dashboard(spark):
    exps = spark.createDataFrame([(f"e{i}", f"n{i}", "RAG", "PENDING", "llm", m, "fixed_1200_150", 5) for i, m in enumerate(["m1", "gone", None])], "experiment_id string, experiment_name string, experiment_type string, status string, llm_model string, embedding_model_id string, chunking_strategy string, top_k int")
    models = spark.createDataFrame([("m1", "name")], "embedding_model_id string, model_name string")
    rows = [("r1", "e0", None, 0.5, 2147483647, 10, Decimal("0.000001")), ("r2", "e0", 1.0, 0.5, 10, 20, None), ("r3", "e1", None, None, None, None, None)]
    results = spark.createDataFrame(rows, "experiment_result_id string, experiment_id string, faithfulness double, answer_relevance double, total_tokens int, latency_ms int, cost decimal(18,6)")
    for m in evaluation.METRICS[2:]:
        results = results.withColumn(m, F.lit(None).cast("double"))
    for f in (evaluation.dashboard, evaluation.dashboard_preaggregated):
        out = {r.experiment_id: r for r in f(exps, models, results).collect()}
        assert [out[e].total_questions for e in ("e0", "e1", "e2")] == [2, 1, 0]
        assert (out["e0"].embedding_model, out["e1"].embedding_model) == ("name", None)
        assert (out["e0"].avg_faithfulness, out["e0"].avg_latency_ms, out["e0"].total_tokens) == (1.0, 15.0, 2147483657)
        assert out["e0"].total_cost == Decimal("0.000001") and out["e2"].avg_faithfulness is None and out["e2"].total_tokens is None


def test_chunk_counts_and_reassembly(spark):
    lengths = [0, 1, 1199, 1200, 1201, 2250, 2251]
    docs = spark.createDataFrame([(n, "".join(chr(97 + i % 26) for i in range(n))) for n in lengths] + [(-1, None)], "doc_id int, text string")
    rows = chunks(docs).orderBy("doc_id", "chunk_index").collect()
    held = {n: [r.content for r in rows if r.doc_id == n] for n in lengths}
    assert [len(held[n]) for n in lengths] == [0, 1, 1, 1, 2, 2, 3]
    for n, text in docs.where("doc_id > 0").collect():
        assert held[n][0] + "".join(c[150:] for c in held[n][1:]) == text
    with pytest.raises(ValueError):
        sizes("fixed_10_10")


def test_paged_chunks(spark):
    pages = spark.createDataFrame([("d", 1, "a" * 1000), ("d", 2, "b" * 500), ("d", 3, None)], "document_id string, page_number int, cleaned_text string")
    out = paged_chunks(pages).orderBy("chunk_index").collect()
    assert [(r.page_start, r.page_end, len(r.content)) for r in out] == [(1, 2, 1200), (2, 2, 452)]


def test_vietnamese_text(spark):
    row = spark.createDataFrame([("Đường  ĐI\tHọc 2", "Tiếng")], "a string, b string")
    out = row.select(X.tokens(F.col("a")).alias("a"), X.tokens(F.col("b")).alias("b"), X.word_count(F.col("a")).alias("n"), X.rewrite(F.col("a")).alias("r")).first()
    assert out.a == ["đường", "đi", "học", "2"] and len(out.b) == 1 and out.n == 4 and out.r == "đường đi học 2"


def test_keyword_ties_threshold_and_blocks(spark):
    c = spark.createDataFrame([(2, 0, "alpha beta"), (1, 1, "Alpha beta"), (1, 0, "alpha"), (3, 0, "zzz"), (4, 0, None)], "doc_id long, chunk_index int, content string")
    q = spark.createDataFrame([(1, "alpha BETA"), (2, "nothing here"), (3, ""), (4, None), (5, "zzz alpha")], "item_id long, text string")
    one = [tuple(r) for r in keywords.keyword_topk(q, c, k=2).select("item_id", "doc_id", "chunk_index", "score", "result_rank").orderBy("item_id", "result_rank").collect()]
    assert one == [(1, 1, 1, 1.0, 1), (1, 2, 0, 1.0, 2), (5, 1, 0, 0.5, 1), (5, 1, 1, 0.5, 2)]
    assert one == [tuple(r) for r in keywords.keyword_topk(q.repartition(3), c.repartition(4), k=2).select("item_id", "doc_id", "chunk_index", "score", "result_rank").orderBy("item_id", "result_rank").collect()]
    assert keywords.keyword_topk(q, c, k=5, threshold=0.5).where("item_id = 1").count() == 3
    assert keywords.keyword_topk(q.limit(0), c).count() == 0
    states = {r.item_id: r.is_answerable for r in retrieval.answerable(q, keywords.keyword_topk(q, c)).collect()}
    assert states == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], "[1.5, 2]")], "a array<double>, b array<double>, j string")
    out = row.select(V.cosine(F.col("a"), F.col("b")), V.dot(F.col("b"), F.col("b")), V.from_json(F.col("j"))).first()
    assert tuple(out) == (0.0, 4.0, [1.5, 2.0])


def test_vector_topk(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.5]), (8, [2.0]), (9, None)], "query_id long, embedding array<float>")
    rank = lambda rows: [tuple(r) for r in rows.select("query_id", "vec_id", "score", "result_rank").orderBy("query_id", "result_rank").collect()]
    want = [(7, 1, 1.0, 1), (7, 3, 1.0, 2), (8, 5, 2.0, 1)]
    assert rank(vectors.vector_topk(q, v, k=2)) == want 
    assert rank(vectors.vector_topk(q, v, threshold=1.5)) == [(8, 5, 2.0, 1)] and rank(vectors.vector_topk(q.limit(0), v)) == []


def test_integrity(spark):
    users = spark.createDataFrame([("u1", "a@x"), ("u2", "a@x"), ("u3", None)], "user_id string, email string")
    assert integrity.duplicates(users, ["email"]).collect()[0].n == 2
    roles = spark.createDataFrame([("u1", "ADMIN"), ("u9", "KING"), (None, None)], "user_id string, role_name string")
    assert [r.role_name for r in integrity.role_violations(roles).collect()] == ["KING"]
    assert [r.user_id for r in integrity.orphans(roles, "user_id", users, "user_id").collect()] == ["u9"]
    assert {tuple(r.missing) for r in integrity.missing(roles, "user_roles").collect()} == {("user_id", "role_name")}
    new = spark.createDataFrame([("Name", "b@x", "hash")], "full_name string, email string, password_hash string")
    table = integrity.with_defaults(new, "users", ["email"], "2024-01-01")
    assert table.first().is_active is True and table.dtypes == [(f.name, f.dataType.simpleString()) for f in S.schema("users")]
    with pytest.raises(ValueError):
        integrity.insert(table, new, "users")
    assert integrity.insert(table, new.withColumn("email", F.lit("c@x")), "users", ["email"]).count() == 2
    patched = integrity.patch(users, spark.createDataFrame([("u3", "z@x"), ("u1", None)], "user_id string, email string"), "user_id")
    assert {r.user_id: r.email for r in patched.collect()} == {"u1": "a@x", "u2": "a@x", "u3": "z@x"}


def test_delete(spark):
    make = lambda rows, columns: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))
    tables = {
        "users": make([("u1",), ("u2",)], "user_id"),
        "courses": make([("c1", "u1")], "course_id created_by"),
        "course_workspaces": make([("w1", "c1", "u1")], "workspace_id course_id owner_user_id"),
        "chat_sessions": make([("s1", "w1", "c1", "u2")], "chat_session_id workspace_id course_id user_id"),
        "chat_messages": make([("m1", "s1"), ("m2", "s1")], "message_id chat_session_id"),
        "answer_citations": make([("a1", "m2")], "citation_id assistant_message_id"),
    }
    left, blocked = integrity.delete(tables, "users", make([("u1",)], "user_id"))
    assert left["courses"].first().created_by is None and left["course_workspaces"].first().owner_user_id is None
    assert all(b.isEmpty() for b in blocked.values())
    left, blocked = integrity.delete(tables, "chat_sessions", make([("s1",)], "chat_session_id"))
    assert left["chat_messages"].isEmpty() and left["answer_citations"].count() == 1
    assert [r.citation_id for r in blocked["answer_citations", "assistant_message_id"].collect()] == ["a1"]


def test_export_round_trip(spark, tmp_path):
    q = spark.createDataFrame([(1, 'Ai "là"\nđó?', "Trả lời")], "item_id int, question_text string, ground_truth_answer string")
    lines = chat.export_questions(q)
    assert files.write_jsonl(lines, str(tmp_path / "out")) == 1
    back = files.read_jsonl(spark, str(tmp_path / "out")).first().messages
    assert [(m.role, m.content) for m in back] == [("system", chat.SYSTEM_PROMPT), ("user", 'Ai "là"\nđó?'), ("assistant", "Trả lời")]
    sample = '{"messages":[{"role":"system","content":"Bạn là chatbot hỏi đáp dựa trên tài liệu môn học."},{"role":"user","content":"AI là gì?"},{"role":"assistant","content":"AI là trí tuệ nhân tạo."}]}'
    made = chat.export_questions(spark.createDataFrame([(1, "AI là gì?", "AI là trí tuệ nhân tạo.")], q.schema)).first().line
    assert made == sample and json.loads(made)
    assert [r.total_lines for r in files.jsonl_files(spark, str(tmp_path / "out" / "*.txt")).collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("xin chào")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Một</w:t><w:t xml:space='preserve'> hai</w:t></w:p><w:p><w:t>ba &amp; bốn</w:t></w:p>")
    (tmp_path / "b.docx").write_bytes(data.getvalue())
    (tmp_path / "c.pptx").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.uploads(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].raw_text == "xin chào" and rows["b.docx"].raw_text == "Một hai\nba & bốn"
    assert rows["c.pptx"].extraction_status == "FAILED" and rows["c.pptx"].raw_text is None
    assert files.uploads(spark, str(tmp_path), limit=3).count() == 0
    assert files.read_text(spark, str(tmp_path / "a.txt")).first().text == "xin chào"


def test_catalog(spark):
    p = spark.createDataFrame([('{"all":true}',), ('{"chat":true,"notes":true}',), ("{}",), (None,)], "permission_json string")
    assert [r[0] for r in p.select(catalog.allowed(F.col("permission_json"), "chat")).collect()] == [True, True, False, False]
    rows = spark.createDataFrame([("d1", "w1", "x"), ("d2", "w2", "y")], "document_id string, workspace_id string, secret string")
    assert catalog.listing(rows, "documents_of_workspace", "w1").columns == ["document_id", "workspace_id"]
    assert catalog.envelope(rows).count() == 2 and catalog.failure(spark, "no").first().response.success is False
    catalog.create_database(spark, "model_test")
    assert {t.name for t in spark.catalog.listTables() if not t.isTemporary} == set(S.TABLES)
    spark.sql("USE default")
    spark.sql("DROP DATABASE model_test CASCADE")


def test_stream(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "c"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "in"))
    usage = stream.session_usage(stream.read_stream(spark, str(tmp_path / "in"), turns.schema))
    out = stream.run_once(usage, "usage", str(tmp_path / "ck"))
    assert {r.conv_id: (r.n_messages, r.n_chars) for r in out.collect()} == {1: (2, 3), 2: (1, None)}
