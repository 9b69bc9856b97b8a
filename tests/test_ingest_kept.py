"""Uploads as a file stream, pages of long documents, the kept dashboard, exports and key lookups."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from quaestor.operators import evaluation, integrity, kept
from quaestor.operators import store as ST
from quaestor.operators.chunking import paged_chunks
from quaestor.sources import files
from quaestor.streaming import ingest


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


DOCX = zipped({"word/document.xml": "<w:p><w:r><w:t>Học máy</w:t></w:r></w:p><w:p><w:r><w:t xml:space='preserve'>a &lt; b</w:t></w:r></w:p>"})
PPTX = zipped({f"ppt/slides/slide{n}.xml": f"<a:p><a:r><a:t>slide {n} {'word ' * 300}</a:t></a:r></a:p>" for n in (10, 2, 1)})


def test_files_are_taken_once(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.txt").write_text("plain <b>text</b>\n" * 3)
    (folder / "deep" / "b.docx").write_bytes(DOCX)
    (folder / "c.pptx").write_bytes(PPTX)
    (folder / "broken.docx").write_bytes(b"no zip")
    (folder / "large.txt").write_text("x" * 20_000)
    (folder / "odd.xyz").write_text("?")
    (folder / "empty.txt").write_text("")
    made = ingest.ingest(spark, str(folder), out, limit=10_000)
    got = {r.original_filename: r for r in made["course_documents"].collect()}
    # Spark's file source passes over files without a byte
    assert {n: r.processing_status for n, r in got.items()} == {"a.txt": "CHUNKED", "b.docx": "CHUNKED", "c.pptx": "CHUNKED", "broken.docx": "FAILED", "large.txt": "FAILED", "odd.xyz": "FAILED"}
    assert got["large.txt"].error_message == "larger than 10000 bytes" and "BadZipFile" in got["broken.docx"].error_message and "no reader" in got["odd.xyz"].error_message
    assert (got["c.pptx"].total_pages, got["c.pptx"].file_type, got["c.pptx"].document_title, got["large.txt"].file_size_bytes, got["large.txt"].file_type) == (3, "PPTX", "c", 20_000, "TXT")
    pages = {(r.document_id, r.page_number): r.cleaned_text for r in made["document_pages"].collect()}
    assert pages[got["a.txt"].document_id, 1] == "plain text plain text plain text" and pages[got["b.docx"].document_id, 1] == "Học máy a < b"
    assert [pages[got["c.pptx"].document_id, n].split()[1] for n in (1, 2, 3)] == ["1", "2", "10"] and len(pages) == 5
    chunks = made["document_chunks"].where(F.col("document_id") == got["c.pptx"].document_id).orderBy("chunk_index").collect()
    assert [(c.page_start, c.page_end) for c in chunks] == [(1, 1), (1, 2), (2, 3), (3, 3), (3, 3)][: len(chunks)] and all(c.token_count and c.chunk_strategy == "fixed_1200_150" for c in chunks)
    (folder / "later.txt").write_text("came later")
    again = ingest.ingest(spark, str(folder), out, limit=10_000)
    assert again["course_documents"].count() == 7 and again["document_pages"].count() == 6
    assert ingest.ingest(spark, str(folder), out, limit=10_000)["course_documents"].count() == 7


def test_a_batch_that_is_repeated_replaces_itself(spark, tmp_path):
    """The rows of a batch that died before its checkpoint are written again, not twice."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    ingest.ingest(spark, str(folder), f"file://{out}")
    for commit in (out / "_checkpoint" / "commits").iterdir():
        commit.unlink()
    made = ingest.ingest(spark, str(folder), f"file://{out}")
    assert [made[t].count() for t in ("course_documents", "document_pages", "document_chunks")] == [1, 1, 1]


def test_a_document_of_many_pages(spark):
    """100,000 pages: no row holds more than a chunk, and the chunks are those of the joined text."""
    n = 100_000
    pages = spark.range(n).select(F.lit("long").alias("document_id"), (F.col("id") + 1).cast("int").alias("page_number"), F.concat(F.lit("page "), F.col("id")).alias("cleaned_text"))
    out = {r.chunk_index: r for r in paged_chunks(pages).collect()}
    text = "\n".join(f"page {i}" for i in range(n))
    assert len(out) == 1 + -(-(len(text) - 1200) // 1050)
    assert all(out[i].content == text[i * 1050 : i * 1050 + 1200] for i in out)
    page = lambda at: text.count("\n", 0, at) + 1
    assert all((out[i].page_start, out[i].page_end) == (page(i * 1050), page(min(len(text), i * 1050 + 1200) - 1)) for i in range(0, len(out), 97))


def test_pages_of_all_lengths(spark):
    texts = {"one": [None], "none": ["", None], "gaps": ["a" * 1049, "", None, "b" * 3000, "", "c"], "ends": ["x" * 1200, ""]}
    rows = [(d, i + 1, t) for d, ts in texts.items() for i, t in enumerate(ts)]
    out: dict = {}
    for r in paged_chunks(spark.createDataFrame(rows, "document_id string, page_number int, cleaned_text string")).collect():
        out.setdefault(r.document_id, {})[r.chunk_index] = (r.content, r.page_start, r.page_end)
    for d, ts in texts.items():
        text, places = "\n".join(t or "" for t in ts), []
        for i, t in enumerate(ts):
            begin = sum(len(x or "") + 1 for x in ts[:i])
            places.append((i + 1, begin, begin + len(t or "") + 1))
        want = {}
        for i in range(0 if not text else 1 + max(0, -(-(len(text) - 1200) // 1050))):
            first, last = i * 1050, min(i * 1050 + 1200, len(text))
            hit = [p for p, a, b in places if a < last and b > first]
            want[i] = (text[first:last], min(hit), max(hit))
        assert out.get(d, {}) == want


def test_dashboard_of_lots(spark, tmp_path):
    store = ST.Store.create(spark, f"k_{uuid.uuid4().hex}", ("experiments", "embedding_models"), f"file://{tmp_path}/db")
    model = spark.createDataFrame([("m1", "model", "local", 3)], "embedding_model_id string, model_name string, provider string, dimension int")
    store.append("embedding_models", model)
    exps = spark.createDataFrame([(f"e{i}", "d", "c", f"n{i}", "llm", "m1" if i else None) for i in range(4)], "experiment_id string, dataset_id string, course_id string, experiment_name string, llm_model string, embedding_model_id string")
    store.append("experiments", exps)
    kept.create_dashboard(store)
    rows = spark.range(60).select(
        F.concat(F.lit("r"), "id").alias("experiment_result_id"), F.concat(F.lit("e"), F.col("id") % 3).alias("experiment_id"),
        *(F.when(F.col("id") % (3 + i) > 0, F.col("id") / (7 + i)).alias(m) for i, m in enumerate(evaluation.METRICS)),
        F.when(F.col("id") % 4 > 0, F.col("id").cast("int")).alias("latency_ms"), F.col("id").cast("int").alias("total_tokens"), (F.col("id") / 1000).cast("decimal(18,6)").alias("cost"),
    )
    shown = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows.collect())
    want = shown(evaluation.dashboard(store.table("experiments"), store.table("embedding_models"), rows))
    for lot in (0, 2, 1, 1):
        kept.add_results(store, rows.where(F.floor(F.col("total_tokens") / 20) == lot), f"lot {lot}")
    assert shown(kept.dashboard_view(store)) == want and len(want) == 4
    kept.compact(store)
    assert shown(kept.dashboard_view(store)) == want
    kept.add_results(store, rows.limit(0), "none")
    assert shown(kept.dashboard_view(store)) == want


def test_export_counts_what_it_writes(spark, tmp_path, monkeypatch):
    lines = spark.range(1000).select(F.when(F.col("id") != 5, F.to_json(F.struct("id"))).alias("line"))
    path = f"file://{tmp_path}/out"
    assert files.write_jsonl(lines, path) == 999
    assert len([x for p in (tmp_path / "out").glob("*.txt") for x in p.read_text().splitlines() if json.loads(x)]) == 999
    with pytest.raises(FileExistsError):
        files.write_jsonl(lines, path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_lookups_leave_the_table_where_it_is(spark, tmp_path, monkeypatch):
    spark.range(10_000).select(F.concat(F.lit("u"), "id").alias("user_id")).write.parquet(str(tmp_path / "users"))
    users = spark.read.parquet(str(tmp_path / "users"))
    asked = spark.createDataFrame([("u5",), ("u5",), ("nobody",), (None,)], "user_id string")
    found = integrity.among(users, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("BroadcastHashJoin") :]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in below.split("BroadcastExchange")[0]
    assert [r.user_id for r in found.collect()] == ["u5"]
    monkeypatch.setattr(integrity, "LOOKUP", 1)
    assert [r.user_id for r in integrity.among(users, asked).collect()] == ["u5"]


def test_duplicates_with_nulls_and_long_texts(spark):
    rows = spark.createDataFrame([("a" * 100_000,), ("a" * 100_000,), (None,), (None,), ("b",)], "text string")
    assert sorted((r.text or "", r.n) for r in integrity.duplicates(rows, ["text"]).collect()) == [("", 2), ("a" * 100_000, 2)]
