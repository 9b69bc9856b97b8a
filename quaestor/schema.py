"""The twenty tables of the model: columns with types and defaults, keys, references and their delete rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The columns of the model's tables, one to a line. The first is the primary key; uuid() and localtimestamp() are made when a row is added.
TABLES = {
    "users": """
        user_id STRING NOT NULL DEFAULT uuid()
        full_name STRING NOT NULL
        email STRING NOT NULL
        password_hash STRING NOT NULL
        avatar_url STRING
        is_active BOOLEAN NOT NULL DEFAULT true
        last_login_at TIMESTAMP_NTZ
        last_logout_at TIMESTAMP_NTZ
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "user_roles": """
        user_role_id STRING NOT NULL DEFAULT uuid()
        user_id STRING NOT NULL
        role_name STRING NOT NULL
        permission_json STRING
        assigned_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        is_active BOOLEAN NOT NULL DEFAULT true
    """,
    "courses": """
        course_id STRING NOT NULL DEFAULT uuid()
        course_code STRING NOT NULL
        course_name STRING NOT NULL
        description STRING
        created_by STRING
        is_active BOOLEAN NOT NULL DEFAULT true
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "chapters": """
        chapter_id STRING NOT NULL DEFAULT uuid()
        course_id STRING NOT NULL
        chapter_title STRING NOT NULL
        description STRING
        order_index INT NOT NULL DEFAULT 1
        is_active BOOLEAN NOT NULL DEFAULT true
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "course_workspaces": """
        workspace_id STRING NOT NULL DEFAULT uuid()
        course_id STRING NOT NULL
        owner_user_id STRING
        workspace_title STRING NOT NULL
        description STRING
        visibility STRING NOT NULL DEFAULT 'PRIVATE'
        is_active BOOLEAN NOT NULL DEFAULT true
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "course_documents": """
        document_id STRING NOT NULL DEFAULT uuid()
        workspace_id STRING NOT NULL
        course_id STRING NOT NULL
        chapter_id STRING
        uploaded_by STRING
        document_title STRING NOT NULL
        original_filename STRING NOT NULL
        file_type STRING NOT NULL
        mime_type STRING
        file_path STRING NOT NULL
        file_size_bytes BIGINT
        processing_status STRING NOT NULL DEFAULT 'UPLOADED'
        total_pages INT
        language STRING NOT NULL DEFAULT 'vi'
        error_message STRING
        uploaded_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "document_pages": """
        page_id STRING NOT NULL DEFAULT uuid()
        document_id STRING NOT NULL
        page_number INT NOT NULL
        raw_text STRING
        cleaned_text STRING
        word_count INT
        char_count INT
        extraction_status STRING NOT NULL DEFAULT 'TEXT_EXTRACTED'
        error_message STRING
        extracted_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "document_chunks": """
        chunk_id STRING NOT NULL DEFAULT uuid()
        document_id STRING NOT NULL
        workspace_id STRING NOT NULL
        course_id STRING NOT NULL
        chapter_id STRING
        chunk_index INT NOT NULL
        chunk_strategy STRING NOT NULL DEFAULT 'fixed_1200_150'
        chunk_size INT
        chunk_overlap INT
        content STRING NOT NULL
        page_start INT
        page_end INT
        token_count INT
        word_count INT
        char_count INT
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "embedding_models": """
        embedding_model_id STRING NOT NULL DEFAULT uuid()
        model_name STRING NOT NULL
        provider STRING NOT NULL
        dimension INT NOT NULL
        is_local BOOLEAN NOT NULL DEFAULT false
        description STRING
        config_json STRING
        is_active BOOLEAN NOT NULL DEFAULT true
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "chunk_embeddings": """
        chunk_embedding_id STRING NOT NULL DEFAULT uuid()
        chunk_id STRING NOT NULL
        embedding_model_id STRING NOT NULL
        embedding_json STRING NOT NULL
        dimension INT NOT NULL
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "chat_sessions": """
        chat_session_id STRING NOT NULL DEFAULT uuid()
        workspace_id STRING NOT NULL
        user_id STRING
        course_id STRING NOT NULL
        chapter_id STRING
        session_title STRING
        selected_embedding_model_id STRING
        selected_chunking_strategy STRING
        system_prompt STRING
        is_active BOOLEAN NOT NULL DEFAULT true
        started_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "chat_messages": """
        message_id STRING NOT NULL DEFAULT uuid()
        chat_session_id STRING NOT NULL
        sender_role STRING NOT NULL
        message_content STRING NOT NULL
        llm_model STRING
        input_tokens INT
        output_tokens INT
        total_tokens INT
        latency_ms INT
        cost DECIMAL(18,6)
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "retrieval_queries": """
        retrieval_query_id STRING NOT NULL DEFAULT uuid()
        chat_session_id STRING NOT NULL
        user_message_id STRING NOT NULL
        workspace_id STRING NOT NULL
        query_text STRING NOT NULL
        rewritten_query STRING
        embedding_model_id STRING
        top_k INT NOT NULL DEFAULT 5
        similarity_metric STRING NOT NULL DEFAULT 'keyword'
        similarity_threshold DOUBLE NOT NULL DEFAULT 0.05
        is_answerable BOOLEAN
        no_answer_reason STRING
        latency_ms INT
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "retrieval_results": """
        retrieval_result_id STRING NOT NULL DEFAULT uuid()
        retrieval_query_id STRING NOT NULL
        chunk_id STRING NOT NULL
        document_id STRING NOT NULL
        result_rank INT NOT NULL
        similarity_score DOUBLE NOT NULL
        rerank_score DOUBLE
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "answer_citations": """
        citation_id STRING NOT NULL DEFAULT uuid()
        assistant_message_id STRING NOT NULL
        retrieval_result_id STRING
        document_id STRING
        chunk_id STRING
        citation_order INT NOT NULL DEFAULT 1
        document_title STRING
        page_start INT
        page_end INT
        quote_text STRING
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "saved_notes": """
        note_id STRING NOT NULL DEFAULT uuid()
        workspace_id STRING NOT NULL
        user_id STRING
        document_id STRING
        chat_session_id STRING
        note_title STRING NOT NULL
        note_content STRING NOT NULL
        note_type STRING NOT NULL DEFAULT 'MANUAL'
        source_reference_json STRING
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "evaluation_datasets": """
        dataset_id STRING NOT NULL DEFAULT uuid()
        course_id STRING NOT NULL
        workspace_id STRING
        dataset_name STRING NOT NULL
        dataset_version STRING NOT NULL DEFAULT 'v1'
        description STRING
        created_by STRING
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "evaluation_questions": """
        evaluation_question_id STRING NOT NULL DEFAULT uuid()
        dataset_id STRING NOT NULL
        course_id STRING NOT NULL
        chapter_id STRING
        question_no INT NOT NULL
        question_text STRING NOT NULL
        ground_truth_answer STRING NOT NULL
        expected_document_id STRING
        expected_page INT
        question_type STRING NOT NULL DEFAULT 'FACTUAL'
        difficulty STRING NOT NULL DEFAULT 'MEDIUM'
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "experiments": """
        experiment_id STRING NOT NULL DEFAULT uuid()
        dataset_id STRING NOT NULL
        course_id STRING NOT NULL
        workspace_id STRING
        experiment_name STRING NOT NULL
        experiment_type STRING NOT NULL DEFAULT 'RAG'
        llm_model STRING NOT NULL
        embedding_model_id STRING
        chunking_strategy STRING
        top_k INT NOT NULL DEFAULT 5
        temperature DOUBLE NOT NULL DEFAULT 0.2
        fine_tuned_model_name STRING
        config_json STRING
        status STRING NOT NULL DEFAULT 'PENDING'
        created_by STRING
        started_at TIMESTAMP_NTZ
        completed_at TIMESTAMP_NTZ
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
        updated_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
    "experiment_results": """
        experiment_result_id STRING NOT NULL DEFAULT uuid()
        experiment_id STRING NOT NULL
        evaluation_question_id STRING NOT NULL
        generated_answer STRING
        retrieved_context_json STRING
        citations_json STRING
        faithfulness DOUBLE
        answer_relevance DOUBLE
        context_precision DOUBLE
        context_recall DOUBLE
        answer_correctness DOUBLE
        semantic_similarity DOUBLE
        latency_ms INT
        input_tokens INT
        output_tokens INT
        total_tokens INT
        cost DECIMAL(18,6)
        error_message STRING
        created_at TIMESTAMP_NTZ NOT NULL DEFAULT localtimestamp()
    """,
}
UNIQUE = [("users", ["email"]), ("courses", ["course_code"]), ("chapters", ["course_id", "order_index"]), ("document_pages", ["document_id", "page_number"]), ("embedding_models", ["model_name"])]
ROLES = ["ADMIN", "TEACHER", "STUDENT", "RESEARCHER"]


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    required: bool
    default: str | None


@dataclass(frozen=True)
class Reference:
    """child.column names a row of parent; rule: C cascade, N set null, R no action when that is deleted."""

    child: str
    column: str
    parent: str
    rule: str

    @property
    def key(self) -> str:
        return columns(self.parent)[0].name


# The references between them, with their delete rules.
REFERENCES = [
    Reference("user_roles", "user_id", "users", "C"),
    Reference("courses", "created_by", "users", "N"),
    Reference("chapters", "course_id", "courses", "C"),
    Reference("course_workspaces", "course_id", "courses", "C"),
    Reference("course_workspaces", "owner_user_id", "users", "N"),
    Reference("course_documents", "workspace_id", "course_workspaces", "C"),
    Reference("course_documents", "course_id", "courses", "R"),
    Reference("course_documents", "chapter_id", "chapters", "R"),
    Reference("course_documents", "uploaded_by", "users", "N"),
    Reference("document_pages", "document_id", "course_documents", "C"),
    Reference("document_chunks", "document_id", "course_documents", "C"),
    Reference("document_chunks", "workspace_id", "course_workspaces", "R"),
    Reference("document_chunks", "course_id", "courses", "R"),
    Reference("document_chunks", "chapter_id", "chapters", "R"),
    Reference("chunk_embeddings", "chunk_id", "document_chunks", "C"),
    Reference("chunk_embeddings", "embedding_model_id", "embedding_models", "R"),
    Reference("chat_sessions", "workspace_id", "course_workspaces", "C"),
    Reference("chat_sessions", "user_id", "users", "N"),
    Reference("chat_sessions", "course_id", "courses", "R"),
    Reference("chat_sessions", "chapter_id", "chapters", "R"),
    Reference("chat_messages", "chat_session_id", "chat_sessions", "C"),
    Reference("retrieval_queries", "chat_session_id", "chat_sessions", "C"),
    Reference("retrieval_queries", "user_message_id", "chat_messages", "R"),
    Reference("retrieval_queries", "workspace_id", "course_workspaces", "R"),
    Reference("retrieval_results", "retrieval_query_id", "retrieval_queries", "C"),
    Reference("retrieval_results", "chunk_id", "document_chunks", "R"),
    Reference("retrieval_results", "document_id", "course_documents", "R"),
    Reference("answer_citations", "assistant_message_id", "chat_messages", "R"),
    Reference("answer_citations", "retrieval_result_id", "retrieval_results", "R"),
    Reference("answer_citations", "document_id", "course_documents", "R"),
    Reference("answer_citations", "chunk_id", "document_chunks", "R"),
    Reference("saved_notes", "workspace_id", "course_workspaces", "C"),
    Reference("saved_notes", "user_id", "users", "N"),
    Reference("evaluation_datasets", "course_id", "courses", "C"),
    Reference("evaluation_datasets", "workspace_id", "course_workspaces", "R"),
    Reference("evaluation_datasets", "created_by", "users", "N"),
    Reference("evaluation_questions", "dataset_id", "evaluation_datasets", "C"),
    Reference("evaluation_questions", "course_id", "courses", "R"),
    Reference("experiments", "dataset_id", "evaluation_datasets", "R"),
    Reference("experiments", "course_id", "courses", "R"),
    Reference("experiment_results", "experiment_id", "experiments", "C"),
    Reference("experiment_results", "evaluation_question_id", "evaluation_questions", "R"),
]


TYPES = {"STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "DECIMAL(18,6)": T.DecimalType(18, 6), "TIMESTAMP_NTZ": T.TimestampNTZType()}


def _column(line: str) -> Column:
    head, _, default = line.strip().partition(" DEFAULT ")
    name, kind, *rest = head.split(" ", 2)
    return Column(name, TYPES[kind], rest == ["NOT NULL"], default or None)


_COLUMNS = {table: [_column(line) for line in text.strip().splitlines()] for table, text in TABLES.items()}


def columns(table: str) -> list[Column]:
    return _COLUMNS[table]


def schema(table: str) -> T.StructType:
    """The table's Spark schema. Nullability is declared true: readers don't enforce it, integrity checks do."""
    return T.StructType([T.StructField(c.name, c.type, True) for c in columns(table)])


def references() -> list[Reference]:
    return REFERENCES


#: Defaults that Spark's tables don't take, as each row has its own; they are filled in before rows are written.
PER_ROW = {"uuid()"}


def ddl(table: str, database: str | None = None, partition: str | None = None) -> str:
    """CREATE TABLE of a Parquet table with types, NOT NULL marks and defaults; `partition` is a whole number to partition by, overwritten partition by partition."""
    default = lambda c: f" DEFAULT {c.default}" if c.default and c.default not in PER_ROW else ""
    body = ", ".join(f"{c.name} {c.type.simpleString()}{' NOT NULL' * c.required}{default(c)}" for c in columns(table))
    by = f" OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({partition})" if partition else ""
    return f"CREATE TABLE IF NOT EXISTS {f'{database}.' if database else ''}{table} ({body}{f', {partition} INT' if partition else ''}) USING parquet{by}"
