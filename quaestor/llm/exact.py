"""Exact deduplication by a stateful stream: disk-backed state, kept without expiry, holds each digest's survivor.

Only DataFrame and Structured Streaming operations are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.tables import listed, maybe_in, new_path, numbered, quoted, renamed_back, staged, with_locator, without

PARTITIONS = "spark.sql.shuffle.partitions"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",  # every store of an executor takes an eighth of it beforehand
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of a query that has ended are unloaded by then
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store reserves some MB of disk
}


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(F.encode(body, "UTF-8"), 256))


def run_state(spark: SparkSession, log_path: str, schema, state_path: str) -> DataFrame:
    """Streams the rows of the digest log that the state has not seen into it, and returns the state as a table.

    One row per digest: digest, keep (the survivor's id and locator) and group_size. The state lies at `state_path`
    in the shared folder and never expires; a second call, after the log has grown, takes only the new files. Each batch
    writes the whole table beside the state, from the stores that are open then: whoever reads the state itself opens
    every store once more, which takes up to a megabyte of an executor's memory for each that is not given back.
    """
    own = spark.newSession()  # the settings hold for this stream alone
    for k, v in {PARTITIONS: spark.conf.get(PARTITIONS), **STATE}.items():
        own.conf.set(k, v)
    stream = own.readStream.schema(schema).parquet(log_path)
    groups = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("group_size"))
    whole = f"{state_path}-table"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{whole}/{number}")  # a batch that failed runs again

    query = groups.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state_path).trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(map(int, listed(spark, whole)))  # of an earlier call, if there was nothing new
    return spark.read.schema(groups.schema).parquet(f"{whole}/{last}")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest, and `_at`, its locator.

    Texts are equal when their normalised bytes are; null counts as empty. The row with the largest doc_id stays; a
    null id is the smallest, and rows with the same id and text are told apart by their locators, of which the largest
    stays, so exactly one row of every group is kept. Other columns are not read, but for `_at`, which is taken
    for the rows' locator where there is one. An empty table gives no rows.
    Equal digests are hits; their rows' full bytes are compared with each other, and should a digest join unequal
    texts, its rows are grouped by the bytes themselves.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"), *(["_at"] if "_at" in docs.columns else []))
    located = narrow if "_at" in docs.columns else with_locator(narrow)
    body = normalise(F.coalesce(F.col("text"), F.lit("")))
    rows = located.select("doc_id", F.col("_at").alias("at"), digest(body).alias("digest"), body.alias("body"))
    log_path, state_path = new_path(spark, "digest-log"), new_path(spark, "digest-state")
    rows.drop("body").write.parquet(log_path)
    log = spark.read.schema(rows.drop("body").schema).parquet(log_path)
    state = run_state(spark, log_path, log.schema, state_path)
    several = state.where("group_size > 1")
    hits = maybe_in(rows, several, "digest").where("_maybe").select("digest", "body").distinct()
    unequal = staged(hits.groupBy("digest").count().where("count > 1").select("digest"), "unequal")
    grouped = log.join(state, "digest").select("doc_id", "at", "digest", "keep", "group_size")
    if not unequal.isEmpty():
        by_bytes = rows.join(unequal, "digest").groupBy("digest", "body").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("group_size"))
        mixed = rows.join(unequal, "digest").join(by_bytes, ["digest", "body"]).select("doc_id", "at", "digest", "keep", "group_size")
        grouped = grouped.join(unequal, "digest", "left_anti").unionByName(mixed)
    return grouped.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep.at")).alias("kept"), "digest", F.col("at").alias("_at"))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts; see exact_groups()."""
    plain, names = numbered(docs)
    located = with_locator(plain)
    groups = exact_groups(located.select(F.col(names[doc_id]).alias("doc_id"), F.col(names[text]).alias("text"), "_at"), **options)
    return renamed_back(without(located, staged(groups.where("NOT kept").select("_at"), "dropped")), names)
