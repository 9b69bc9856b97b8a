"""Listing and filtering: by parent key, by activity, by permission; responses in an envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor import schema as S

# List operations by name, with their table, the column that filters and the columns returned (all if none).
LISTS = {
    "users": ("users", None, "user_id full_name email avatar_url is_active last_login_at last_logout_at created_at updated_at"),
    "user_roles": ("user_roles", "user_id", ""),
    "courses": ("courses", None, ""),
    "chapters_of_course": ("chapters", "course_id", ""),
    "workspaces_of_course": ("course_workspaces", "course_id", ""),
    "documents_of_workspace": ("course_documents", "workspace_id", "document_id workspace_id course_id chapter_id document_title original_filename file_type processing_status total_pages error_message"),
    "pages_of_document": ("document_pages", "document_id", "page_id document_id page_number cleaned_text word_count char_count"),
    "chunks_of_document": ("document_chunks", "document_id", "chunk_id document_id chunk_index chunk_strategy content page_start page_end token_count"),
    "sessions_of_workspace": ("chat_sessions", "workspace_id", ""),
    "history_of_session": ("chat_messages", "chat_session_id", ""),
    "notes_of_workspace": ("saved_notes", "workspace_id", ""),
    "embedding_models": ("embedding_models", None, ""),
    "retrieval_queries": ("retrieval_queries", None, ""),
    "retrieval_results": ("retrieval_results", None, ""),
    "citations": ("answer_citations", None, "citation_id assistant_message_id document_title page_start page_end quote_text"),
    "datasets": ("evaluation_datasets", None, ""),
    "questions_of_dataset": ("evaluation_questions", "dataset_id", "evaluation_question_id question_no question_text ground_truth_answer question_type difficulty"),
    "experiments": ("experiments", None, ""),
    "results_of_experiment": ("experiment_results", "experiment_id", "experiment_result_id experiment_id evaluation_question_id generated_answer faithfulness answer_relevance context_precision context_recall answer_correctness semantic_similarity"),
}


def listing(table: DataFrame, name: str, parent: str | None = None) -> DataFrame:
    """The rows of a list operation: filtered by its parent's id, with its columns. No order, no activity filter."""
    _, column, shown = LISTS[name]
    rows = table if column is None else table.where(F.col(column) == parent)
    kept = [c for c in shown.split() if c in table.columns]
    return rows.select(*kept) if kept else rows


def numbered(table: DataFrame, parent: str, order: list[str], name: str) -> DataFrame:
    """The table with its rows' places under their parent, from 1, as `name`."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def active(table: DataFrame) -> DataFrame:
    return table.where("is_active")


def allowed(permissions: Column, what: str) -> Column:
    """Whether permission JSON grants something, by name or by `all`."""
    flags = F.from_json(permissions, "map<string,boolean>")
    return F.coalesce(F.try_element_at(flags, F.lit("all")), F.lit(False)) | F.coalesce(F.try_element_at(flags, F.lit(what)), F.lit(False))


def envelope(rows: DataFrame, message: str = "OK") -> DataFrame:
    """Each row as the data of a successful response."""
    return rows.select(F.struct(F.lit(True).alias("success"), F.lit(message).alias("message"), F.struct(*rows.columns).alias("data")).alias("response"))


def failure(spark: SparkSession, message: str) -> DataFrame:
    return spark.range(1).select(F.struct(F.lit(False).alias("success"), F.lit(message).alias("message"), F.lit(None).cast("string").alias("data")).alias("response"))


def create_database(spark: SparkSession, database: str) -> None:
    """The database with empty tables of the model; views and tables of those names are dropped before, children first."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"USE {database}")
    spark.sql("DROP VIEW IF EXISTS v_experiment_dashboard")
    for name in reversed(S.TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for name in S.TABLES:
        spark.sql(S.ddl(name))
