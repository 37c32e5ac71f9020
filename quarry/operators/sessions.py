"""Conversations: sessions folded from messages, and their reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(messages: DataFrame, session: str = "session_id", ts: str = "timestamp") -> DataFrame:
    """A session row from its messages: message_count, created_at, updated_at and the last agent_uri that isn't null."""
    out = [F.count("*").alias("message_count"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at")]
    if "agent_uri" in messages.columns:
        out.append(F.max_by("agent_uri", F.when(F.col("agent_uri").isNotNull(), F.col(ts))).alias("agent_uri"))
    return messages.groupBy(session).agg(*out)


def messages_of(messages: DataFrame, session_id, limit: int = 100, session: str = "session_id", ts: str = "timestamp") -> DataFrame:
    return messages.where(F.col(session) == F.lit(session_id)).orderBy(ts).limit(limit)


def get_session(sessions: DataFrame, session_id, tenant_id) -> DataFrame:
    """No row where the session belongs to another tenant."""
    return sessions.where((F.col("session_id") == F.lit(session_id)) & (F.col("tenant_id") == F.lit(tenant_id)))


def with_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Messages with their number of feedbacks and mean score (0 to 1)."""
    per = feedback.groupBy("message_id").agg(F.count("*").alias("n_feedback"), F.avg("score").alias("avg_score"))
    return messages.join(per, "message_id", "left").withColumn("n_feedback", F.coalesce("n_feedback", F.lit(0)))
