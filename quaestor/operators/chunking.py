"""Fixed-size chunks with overlap, by characters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text as X


def sizes(strategy: str) -> tuple[int, int]:
    """Size and overlap from a name such as fixed_1200_150."""
    m = re.fullmatch(r"fixed_(\d+)_(\d+)", strategy)
    if not m or int(m[2]) >= int(m[1]):
        raise ValueError(f"no strategy fixed_<size>_<overlap> with overlap < size: {strategy!r}")
    return int(m[1]), int(m[2])


def n_chunks(length: Column, size: int, overlap: int) -> Column:
    """None of an empty text; else one, and one more for each step that the rest needs."""
    more = F.ceil((length - size) / (size - overlap))
    return F.when(length == 0, 0).otherwise(1 + F.greatest(F.lit(0), more)).cast("int")


def contents(text: Column, size: int, overlap: int) -> Column:
    """The chunks of a text, as an array. Its steps are cut in one pass; a chunk is its step and the beginning of the next ones."""
    step = size - overlap
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    n = n_chunks(F.length(text), size, overlap)
    own = lambda s, i: F.substring(F.array_join(F.slice(s, i + 1, -(-size // step)), ""), 1, size)
    return F.transform(F.array(steps), lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: own(s, i)))[0]


def chunks(docs: DataFrame, strategy: str = "fixed_1200_150", text: str = "text") -> DataFrame:
    """docs without its text, and chunk_index (from 0), chunk_strategy, content, page_start and page_end; no shuffle.

    Null and empty texts have no chunks. Documents of the driver tables are unpaged: page 1.
    """
    size, overlap = sizes(strategy)
    kept = [c for c in docs.columns if c != text]
    cut = docs.where(F.length(text) > 0).select(*kept, F.posexplode(contents(F.col(text), size, overlap)).alias("chunk_index", "content"))
    return cut.select(*kept, "chunk_index", F.lit(strategy).alias("chunk_strategy"), "content", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))


def counted(chunked: DataFrame) -> DataFrame:
    """With token_count, word_count and char_count of the content."""
    return chunked.withColumns({"token_count": F.size(X.tokens(F.col("content"))), "word_count": X.word_count(F.col("content")), "char_count": X.char_count(F.col("content"))})


def paged_chunks(pages: DataFrame, strategy: str = "fixed_1200_150") -> DataFrame:
    """Chunks across a document's pages (document_id, page_number, cleaned_text), with the first and last page of each.

    Pages are joined by line feeds. A chunk covers the pages whose places it touches. A page's place is the running length
    of those before it; it gives each chunk that touches it its piece, and pieces meet by chunk, so no row holds more than
    a chunk or a page, however long the document. Null pages count as empty; documents without text have no chunks.
    """
    size, overlap = sizes(strategy)
    step = size - overlap
    body = F.concat(F.coalesce("cleaned_text", F.lit("")), F.lit("\n"))
    of = Window.partitionBy("document_id")
    placed = pages.select("document_id", "page_number", body.alias("body")).withColumn("length", F.length("body").cast("long"))
    placed = placed.withColumn("end", F.sum("length").over(of.orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("length").over(of) - 1)
    placed = placed.withColumn("begin", F.col("end") - F.col("length")).where("begin < total")
    # no newline behind the last page
    stop = F.least("end", "total")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("begin") - size) / step) + 1)
    last = F.least(F.floor((stop - 1) / step), n_chunks(F.col("total"), size, overlap).cast("long") - 1)
    touched = placed.withColumn("chunk_index", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("begin"), F.col("chunk_index") * step)
    piece = F.substring("body", (start - F.col("begin") + 1).cast("int"), (F.least(stop, F.col("chunk_index") * step + size) - start).cast("int"))
    pieces = touched.select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "page_number", start.alias("start"), piece.alias("piece"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]), "")
    return pieces.groupBy("document_id", "chunk_index").agg(content.alias("content"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
