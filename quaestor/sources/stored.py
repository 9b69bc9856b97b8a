"""Tables that are written to be read again: in the folder that driver and executors share, or where the caller says."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and all runs in one process, as in tests, a temporary one is taken and set."""
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


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read again, so that their lineage ends at files that survive executors."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _place(spark: SparkSession, path: str):  # noqa: ANN202  a pair of JVM objects
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a file or folder; false where the new name is taken or the old one is gone."""
    files, place = _place(spark, path)
    return not exists(spark, to) and bool(files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(to)))


def signature(rows: DataFrame) -> str:
    """A name for the files that a table read from files has now: another one as soon as a file is added, removed or changed."""
    m = F.col("_metadata")
    files = rows.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t")).distinct()
    r = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{int(r['h'] or 0) % (1 << 64):016x}"
