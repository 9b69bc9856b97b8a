"""Chat: history, question-answer pairs, usage, and chat records for fine-tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the system prompt of the sample record.
SYSTEM_PROMPT = "Bạn là chatbot hỏi đáp dựa trên tài liệu môn học."


def history(messages: DataFrame) -> DataFrame:
    """Messages with their place in the session, from 1."""
    return messages.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def qa_pairs(messages: DataFrame) -> DataFrame:
    """User turns whose next turn is the assistant's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = messages.select("conv_id", "turn", "sender_role", F.col("message_content").alias("question"), F.lead("sender_role").over(w).alias("next_role"), F.lead("turn").over(w).alias("answer_turn"), F.lead("message_content").over(w).alias("answer"))
    return both.where("sender_role = 'user' AND next_role = 'assistant'").select("conv_id", F.col("turn").alias("question_turn"), "answer_turn", "question", "answer")


def session_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def with_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with their session's columns; messages without a session are left out, as the reference allows none."""
    return messages.join(sessions, "chat_session_id")


def record(messages: Column) -> Column:
    """A chat record as one line of JSON."""
    return F.to_json(F.struct(messages.alias("messages")))


def export_questions(questions: DataFrame) -> DataFrame:
    """A line per evaluation question: system prompt, question, ground truth."""
    part = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return questions.select("item_id", record(F.array(part("system", F.lit(SYSTEM_PROMPT)), part("user", F.col("question_text")), part("assistant", F.col("ground_truth_answer")))).alias("line"))


def export_sessions(messages: DataFrame) -> DataFrame:
    """A line per conversation with its turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("sender_role").alias("role"), F.coalesce("message_content", F.lit("")).alias("content"))))
    held = messages.groupBy("conv_id").agg(turns.alias("turns"))
    return held.select("conv_id", record(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))).alias("line"))
