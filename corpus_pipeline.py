"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaestor.llm.queries import tokenizer_path
from quaestor.llm.tables import new_path, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the factorization machine rejects go."""
    from quaestor.llm.toxicity import keep_harmless, train

    return keep_harmless(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the one with the largest doc_id stays."""
    from quaestor.llm.exact import drop_exact_copies

    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies the one with the smallest doc_id stays."""
    from quaestor.llm.simhash import drop_near_copies

    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: passages of the benchmark are cut out; documents that are nothing else go."""
    from quaestor.llm.fmindex import remove_contamination

    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document as piece ids, with a check that they decode to its text."""
    from quaestor.llm.pieces import encode_documents

    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: None: the learned classifier and the merges of the pieces are loops; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every stage's rows are kept in the shared folder, so a run may be looked into later."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
