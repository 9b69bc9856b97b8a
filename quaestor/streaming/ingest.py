"""Uploads as a stream of files: each is taken once, read, cut into pages and chunks, and written with its status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaestor.functions import text as X
from quaestor.operators.chunking import counted, paged_chunks
from quaestor.sources import files, stored

#: Files of one batch at most, and tasks for each core that a batch is read by: Spark would give each few files a task of their own.
FILES, TASKS = 1_000, 4
LOOKUPS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def uploaded(spark: SparkSession, folder: str, limit: int = files.MAX_UPLOAD, batch: int = FILES) -> DataFrame:
    """A stream of the files below a folder (path, length, content). Contents of files above the limit are not read and come as null.

    Both parts are file sources with the limit pushed into them, so the large files' bytes never reach a task. Files
    without a byte are passed over, as Spark's file sources do.
    """
    source = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(batch))
    small = source.load(folder).where(F.col("length") <= limit).select("path", "length", "content")
    large = source.load(folder).where(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def tables_of(batch: DataFrame, strategy: str = "fixed_1200_150", limit: int = files.MAX_UPLOAD) -> dict[str, DataFrame]:
    """course_documents, document_pages and document_chunks of uploaded files (path, length, content).

    A document is CHUNKED, or FAILED with the reason: too large, of a type without a reader, or broken. Its id follows from its path.
    """
    id = X.uid("document", F.col("path"))
    pages = stored.staged(files.extract(batch.where("content IS NOT NULL")), "extracted")
    good = pages.where("extraction_status = 'TEXT_EXTRACTED'").withColumn("cleaned_text", X.clean(F.coalesce("raw_text", F.lit(""))))
    document_pages = good.select(id.alias("document_id"), "page_number", "raw_text", "cleaned_text", X.word_count(F.col("cleaned_text")).alias("word_count"), X.char_count(F.col("cleaned_text")).alias("char_count"), "extraction_status")
    chunks = counted(paged_chunks(document_pages, strategy)).withColumn("chunk_strategy", F.lit(strategy))
    read = pages.groupBy("path").agg(F.max("file_type").alias("read_type"), F.count_if(F.col("extraction_status") == "TEXT_EXTRACTED").cast("int").alias("n"), F.max("error_message").alias("read_error"))
    name = F.element_at(F.split("path", "/"), -1)
    error = F.when(F.col("length") > limit, F.concat(F.lit("larger than "), F.lit(limit), F.lit(" bytes"))).otherwise(F.col("read_error"))
    documents = batch.select("path", "length").join(read, "path", "left").select(
        id.alias("document_id"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("document_title"),
        name.alias("original_filename"),
        F.coalesce("read_type", F.upper(F.element_at(F.split(name, r"\."), -1))).alias("file_type"),
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size_bytes"),
        F.when(error.isNull(), "CHUNKED").otherwise("FAILED").alias("processing_status"),
        F.when(error.isNull(), F.coalesce("n", F.lit(0))).alias("total_pages"),
        error.alias("error_message"),
    )
    return {"course_documents": documents, "document_pages": document_pages, "document_chunks": chunks}


def start(spark: SparkSession, folder: str, out: str, strategy: str = "fixed_1200_150", limit: int = files.MAX_UPLOAD, batch: int = FILES) -> StreamingQuery:
    """Takes all files that are there and were not taken before, in batches, and ends; call it again for what came since.

    A batch's rows go to `out`/<table>/batch=<number>, which a repeated batch overwrites: every file's rows are there once,
    also when a run dies between two tables. The checkpoint is kept beside them. course_documents is written last.
    """

    def write(rows: DataFrame, number: int) -> None:
        kept = stored.staged(rows.coalesce(TASKS * spark.sparkContext.defaultParallelism), "uploads")
        made = tables_of(kept, strategy, limit)
        for name in ("document_pages", "document_chunks", "course_documents"):
            made[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    stream = uploaded(spark, folder, limit, batch).writeStream.foreachBatch(write)
    return stream.option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()


def ingest(spark: SparkSession, folder: str, out: str, **options) -> dict[str, DataFrame]:  # noqa: ANN003
    """start(), waited for; the tables as they stand then. Meanwhile a batch's files are looked up by few tasks, of which Spark would start up to 10,000."""
    before = spark.conf.get(LOOKUPS)
    spark.conf.set(LOOKUPS, str(TASKS * spark.sparkContext.defaultParallelism))
    try:
        start(spark, folder, out, **options).awaitTermination()
    finally:
        spark.conf.set(LOOKUPS, before)
    return {name: spark.read.parquet(f"{out}/{name}") for name in ("course_documents", "document_pages", "document_chunks")}
