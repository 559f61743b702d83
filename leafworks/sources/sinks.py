"""Writers: JSONL samples and traces, session logs, rating sheets. All write through Spark, in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SENSITIVE_KEYS
from . import snapshots


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    """One JSON object a line; null fields are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append" if append else "overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_sessions(df: DataFrame, path: str) -> DataFrame:
    """Append rows to their session's folder; (session_id, samples) of what stands there now."""
    df.write.partitionBy("session_id").mode("append").json(path)
    return session_counts(df.sparkSession.read.json(path))


def session_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("samples"))


def safe_payload(payload: Column) -> Column:
    """A map without keys that name a secret."""
    return F.map_filter(payload, lambda k, v: ~k.rlike(f"(?i)({'|'.join(SENSITIVE_KEYS)})"))


def log_requests(df: DataFrame, path: str) -> None:
    """Requests with a ``payload`` map and a ``logged_at`` time, in folders by year and month."""
    safe = df.withColumn("payload", safe_payload(F.col("payload"))).withColumn("yymm", F.date_format("logged_at", "yyMM"))
    safe.write.partitionBy("yymm").mode("append").json(path)


def recent_logs(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """What stays of a log when rows older than ``days`` are left out."""
    return df.where(F.col("logged_at") >= now - F.make_dt_interval(F.lit(days)))


def rewrite_logs(spark: SparkSession, path: str, target: str, now: Column, days: int = 7) -> DataFrame:
    """A log without rows older than ``days``, written to ``target`` in folders by year and month; months that are over have none. The caller swaps the folders."""
    kept = recent_logs(spark.read.json(path).withColumn("logged_at", F.col("logged_at").cast("timestamp")), now, days)
    kept.write.partitionBy("yymm").mode("overwrite").json(target)
    return kept


_LOG = "payload map<string,string>, logged_at timestamp, yymm string"


def log_in_place(df: DataFrame, path: str) -> int:
    """Append requests (payload, logged_at) to a log with versions; the version's number."""
    safe = df.select(safe_payload(F.col("payload")).alias("payload"), "logged_at", F.date_format("logged_at", "yyMM").alias("yymm"))
    return snapshots.append(safe, path)


def logs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(payload, logged_at, yymm) of a log with versions."""
    return snapshots.read(spark, path, _LOG, version)


def retain_logs(spark: SparkSession, path: str, now: Column, days: int = 7) -> int:
    """Drop rows older than ``days`` from a log, in place: readers have the old rows or the new ones, requests logged meanwhile stay."""
    return snapshots.rewrite(spark, path, _LOG, lambda rows: recent_logs(rows, now, days))


def export_trace(session: DataFrame, path: str) -> None:
    """One session's trace as a single indented JSON value; a session is small by its step limit."""
    if session.limit(2).count() != 1:
        raise ValueError("one row, one session, is asked for; write_jsonl takes many")
    session.select(F.to_json(F.struct(*session.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def rating_rows(viz: DataFrame) -> DataFrame:
    """Rows of a rating sheet: what is rated, cut short, and empty scores."""
    return viz.withColumns({"query": F.left("query", F.lit(100)), "viz_dsl": F.left("viz_dsl", F.lit(300)), "faith_score": F.lit(""), "coverage_score": F.lit("")})


def write_ratings(viz: DataFrame, path: str) -> None:
    rating_rows(viz).write.mode("overwrite").option("header", True).csv(path)
