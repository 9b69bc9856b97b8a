"""What the operators share: tables in the cluster's shared folder, row locators and Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where it is unset and all runs in one process, as in tests, a temporary folder is taken and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quaestor-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/quaestor/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends at files that survive executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, wherever Spark's file systems reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def with_locator(docs: DataFrame) -> DataFrame:
    """docs with a column `_at` that names each row's place: file and row number.

    Frames that do not come straight from files are written to the shared folder first; the place is then stable
    when a lost executor's tasks run again.
    """
    at = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    try:
        return docs.select(*(F.col(quoted(c)) for c in docs.columns), at.alias("_at"))
    except AnalysisException:
        kept = staged(docs, "rows")
        return kept.select(*(F.col(quoted(c)) for c in kept.columns), at.alias("_at"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def no_clash(keep: tuple[str, ...], *results: str) -> None:
    """Raises where a kept column would stand beside a result of its name."""
    if both := sorted({c.lower() for c in keep} & set(results)):
        raise ValueError(f"kept columns have the names of results: {', '.join(both)}")


def bytes_of(column: pa.Array) -> pa.Array:
    """A string column's UTF-8 bytes with nulls as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    return column.cast(pa.binary())


def text_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's bytes end to end, and the n + 1 places where its values begin and end; nothing is copied."""
    column = bytes_of(column)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def tidy() -> None:
    """Gives memory that a task has freed back to the machine: worker processes live on and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, with tidy() behind its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        tidy()

    return run


#: Spark's setting for the bytes of a batch that goes to Python, its default, and what is set where that still holds.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "1m"


def in_arrow(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow(work), with memory given back behind the last batch.

    Whole texts go to Python in batches of about BATCH_BYTES, unless the session names a size of its own: two tasks of
    an executor otherwise hold 10,000 texts each, in Spark's buffers and in Python.
    """
    if rows.sparkSession.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        rows.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return rows.mapInArrow(tidied(work), schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `most` bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, at = text_and_offsets(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches whose texts hold about `most` bytes: small ones are put together, large ones cut."""
    held, size = [], 0
    for batch in (part for whole in batches for part in slices(whole, column, most)):
        held.append(batch)
        size += int(text_and_offsets(batch.column(column))[1][-1])
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def sql_lower(column: str) -> str:
    """ascii_lower() as DuckDB SQL."""
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def sql_values(rows: list[tuple]) -> str:
    """Rows as the body of an SQL VALUES list."""
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


#: Bits of the membership bitmap: 8 MB when every bucket is used, whatever the input.
BITMAP_BITS = 1 << 26
BUCKET_BITS = 1 << 15


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with a column `_maybe`: false only where the row's key is surely not among `keys`.

    A bitmap of fixed size over hashed keys is built on the executors and broadcast, so that a later join has to
    move only the rows that can match. A full bitmap costs time, never rows. Null keys are never among `keys`.
    """
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_BITS))
    bucket, place = (bit / F.lit(BUCKET_BITS)).cast("int"), bit % BUCKET_BITS
    maps = keys.where(F.col(key).isNotNull()).select(bucket.alias("_bucket"), place.alias("_place")).groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    probed = rows.withColumns({"_bucket": bucket, "_place": place}).join(F.broadcast(maps), "_bucket", "left")
    hit = F.coalesce(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return probed.withColumn("_maybe", hit).drop("_bucket", "_place", "_bits")


def without(rows: DataFrame, dropped: DataFrame, key: str = "_at") -> DataFrame:
    """rows whose key is not among `dropped`; only rows that the bitmap can't clear are shuffled."""
    probed = maybe_in(rows, dropped, key)
    doubtful = probed.where("_maybe").join(dropped.select(key), key, "left_anti")
    return probed.where("NOT _maybe").drop("_maybe").select(*map(quoted, rows.columns)).unionByName(doubtful.drop("_maybe").select(*map(quoted, rows.columns)))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, ..., so that no name clashes with one of ours, and those names by the old ones."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(quoted(c)).alias(n) for c, n in names.items())), names


def renamed_back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(n).alias(c) for c, n in names.items()))
