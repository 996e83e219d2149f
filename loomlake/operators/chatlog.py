"""Sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import delete


def summaries(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Per session: updated_at (its own time without messages), message_count, last_answer."""
    last = F.max_by("content", F.when(F.col("role") == "assistant", F.struct(F.col("m_at"), F.col("message_id"))))
    m = messages.select("session_id", "role", "content", F.col("created_at").alias("m_at"), "message_id")
    agg = m.groupBy("session_id").agg(F.max("m_at").alias("last_at"), F.count("message_id").alias("message_count"), last.alias("last_answer"))
    return sessions.join(agg, "session_id", "left").select("session_id", "title", "created_at", F.coalesce("last_at", "created_at").alias("updated_at"), F.coalesce("message_count", F.lit(0)).alias("message_count"), "last_answer")


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.desc("session_id")).limit(1)


def recent_sessions(summary: DataFrame, n: int = 3) -> DataFrame:
    return summary.where("message_count > 0").orderBy(F.desc("updated_at"), "session_id").limit(n)


def recent_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """Each session's last n messages, in time order by ``turn_no``."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    kept = messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("turn_no", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "message_id")))


def filter_titles(sessions: DataFrame, query: str) -> DataFrame:
    q = query.strip()
    return sessions.where(F.contains(F.lower("title"), F.lower(F.lit(q)))) if q else sessions


def bucket(updated_ms: Column, as_of: Column, zone: str = "UTC") -> Column:
    """TODAY (also the future), YESTERDAY, LAST_7_DAYS, OLDER (from seven days ago on)."""
    days = F.datediff(as_of, F.to_date(F.from_utc_timestamp(F.timestamp_millis(updated_ms), zone)))
    return F.when(days <= 0, "TODAY").when(days == 1, "YESTERDAY").when(days < 7, "LAST_7_DAYS").otherwise("OLDER")


def without_last_exchange(messages: DataFrame) -> DataFrame:
    """Drops each session's last answer with the question before it; a lone last question goes too."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    last = messages.select("session_id", "message_id", "role", F.row_number().over(w).alias("r"), F.lead("role").over(w).alias("before"), F.lag("role").over(w).alias("next"))
    doomed = last.where("(r = 1 AND role IN ('user', 'assistant')) OR (r = 2 AND role = 'user' AND next = 'assistant')")
    return delete(messages, doomed.select("message_id"), ["message_id"])


def delete_sessions(sessions: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions of ``doomed``; messages go with theirs."""
    return delete(sessions, doomed, ["session_id"]), delete(messages, doomed, ["session_id"])


def restore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Puts back rows that are not there, with their ids."""
    return table.unionByName(delete(rows, table.select(key), [key]), allowMissingColumns=True)
