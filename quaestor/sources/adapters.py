"""The model's tables from the tables at hand: documents, pages, conversations, benchmark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.sources import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def course_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per document; the source stands for its course and workspace."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return d.select(
        X.uid("document", F.col("doc_id")).alias("document_id"),
        X.uid("workspace", F.col("source")).alias("workspace_id"),
        X.uid("course", F.col("source")).alias("course_id"),
        name.alias("document_title"),
        F.concat(name, F.lit(".txt")).alias("original_filename"),
        F.lit("TXT").alias("file_type"),
        F.octet_length("text").cast("long").alias("file_size_bytes"),
        F.lit("UPLOADED").alias("processing_status"),
        F.lit(1).alias("total_pages"),
        F.col("lang").alias("language"),
        "doc_id",
        "source",
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per web page: raw markup, cleaned text and its counts."""
    p = read(spark, sf_dir, "pages").withColumn("cleaned_text", X.clean(F.coalesce("html", F.lit(""))))
    return p.select("page_id", F.lit(1).alias("page_number"), F.col("html").alias("raw_text"), "cleaned_text", X.word_count(F.col("cleaned_text")).alias("word_count"), X.char_count(F.col("cleaned_text")).alias("char_count"), F.lit("TEXT_EXTRACTED").alias("extraction_status"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per conversation; turns give the order, and token counts the usage."""
    c = read(spark, sf_dir, "conversations")
    n = F.size(X.tokens(F.coalesce("text", F.lit(""))))
    answers = F.col("role") == "assistant"
    return c.select("conv_id", "turn", F.col("role").alias("sender_role"), F.col("text").alias("message_content"), F.when(answers, 0).otherwise(n).alias("input_tokens"), F.when(answers, n).otherwise(0).alias("output_tokens"))


#: Characters of a page that a document's text is cut into, and bytes of question texts that one pass over the documents looks for.
PAGE_CHARS, BLOCK_BYTES = 3000, 16 << 20


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paged files: their text in pages of PAGE_CHARS, cleaned and counted as uploads are."""
    d = read(spark, sf_dir, "documents").where(F.length("text") > 0)
    pages = d.select(X.uid("document", F.col("doc_id")).alias("document_id"), "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE_CHARS}}}"), F.lit(0))).alias("at", "raw_text"))
    pages = pages.withColumn("cleaned_text", X.clean(F.col("raw_text")))
    return pages.select("document_id", "doc_id", (F.col("at") + 1).alias("page_number"), "raw_text", "cleaned_text", X.word_count(F.col("cleaned_text")).alias("word_count"), X.char_count(F.col("cleaned_text")).alias("char_count"))


def _holders(docs: DataFrame, texts: list[tuple]) -> DataFrame:
    """(place, doc_id): for each text of a block the least id of a document that holds it, found by one automaton in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, least = ahocorasick.Automaton(), {}
        for place, text in sent.value:
            automaton.add_word(text, (*automaton.get(text, ()), place))
        automaton.make_automaton()
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for _, places in automaton.iter(body.as_py()):
                    for place in places:
                        least[place] = min(doc, least.get(place, doc))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), kind)], names=["place", "doc_id"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    kind = pa.int64() if rows.schema["doc_id"].dataType.simpleString() == "bigint" else pa.string()
    return rows.mapInArrow(work, f"place int, doc_id {rows.schema['doc_id'].dataType.simpleString()}")


def expected_documents(items: DataFrame, docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, expected_doc_id): the least id of a document that holds the item's text, for items whose text some document holds.

    Items are a stated set: they go to the workers in blocks of `block_bytes`, each an automaton and a pass over the
    documents; a task passes on one row for each item it has met. Items with null or empty texts are held nowhere.
    """
    spark, found, block, size, at = docs.sparkSession, None, [], 0, 0
    named = items.where("item_id IS NOT NULL AND length(text) > 0").select("item_id", "text")
    keys: list[tuple] = []

    def close() -> None:
        nonlocal found, block, size, keys
        names = spark.createDataFrame(keys, f"place int, item_id {items.schema['item_id'].dataType.simpleString()}")
        own = _holders(docs, block).groupBy("place").agg(F.min("doc_id").alias("expected_doc_id")).join(F.broadcast(names), "place").select("item_id", "expected_doc_id")
        found, block, size, keys = own if found is None else found.unionByName(own), [], 0, []

    for r in named.toLocalIterator():
        block.append((at, r["text"]))
        keys.append((at, r["item_id"]))
        at, size = at + 1, size + len(r["text"].encode())
        if size > block_bytes:
            close()
    if block or found is None:
        close()
    return found.groupBy("item_id").agg(F.min("expected_doc_id").alias("expected_doc_id"))


def evaluation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per benchmark item; expected is the first document that holds its text, if one does. The documents are passed over once, for all uses."""
    b = read(spark, sf_dir, "benchmark")
    first = stored.staged(expected_documents(b, read(spark, sf_dir, "documents").select("doc_id", "text")), "expected")
    return b.join(first, "item_id", "left").select("item_id", F.col("text").alias("question_text"), F.col("text").alias("ground_truth_answer"), "expected_doc_id")
