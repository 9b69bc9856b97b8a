"""A batch of many small uploads is looked up and read by few tasks."""

from __future__ import annotations

from quaestor.streaming import ingest


def test_small_files_share_tasks(spark, tmp_path):
    folder, out, n = tmp_path / "in", f"file://{tmp_path}/out", 120
    folder.mkdir()
    for i in range(n):
        (folder / f"{i}.txt").write_text(f"text {i}")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", ingest.LOOKUPS)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    counter = spark.sparkContext._jsc.sc().dagScheduler().nextStageId
    sizes = spark.sparkContext.statusTracker()
    try:
        first = counter()
        made = ingest.ingest(spark, str(folder), out)
        tasks = [s.numTasks for s in map(sizes.getStageInfo, range(first, counter())) if s]
        assert max(tasks) <= ingest.TASKS * spark.sparkContext.defaultParallelism < n
        assert spark.conf.get(ingest.LOOKUPS) == before[ingest.LOOKUPS]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before["spark.sql.files.maxPartitionBytes"])
    assert made["course_documents"].where("processing_status = 'CHUNKED'").count() == made["document_chunks"].count() == n
