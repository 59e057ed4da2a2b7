"""Queries that run as streams over the events table, to the end of what is there."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import ensure_checkpoint_dir
from codestrata.streaming import changes

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return changes.file_events(spark, f"{folder}/events.parq*", EVENTS, "parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _collected(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream as a table in the shared folder: the last batch, or all of them if they are appended."""
    name = f"q-{uuid.uuid4().hex}"
    out = os.path.join(ensure_checkpoint_dir(spark), "results", name)
    place = (lambda n: f"{out}/batch={n}") if mode == "append" else lambda n: out
    changes.run_to_end(stream, lambda batch, n: batch.write.mode("overwrite").parquet(place(n)), name, mode)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def stream_running_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _collected(spark, changes.running_counts(_stream(spark, folder), "event_type"), "complete").select("event_type", "n_hits")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of each user that the watermark has closed; their state goes with them, and what is open stays in it."""
    events = _stream(spark, folder).select("ts", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("related_path"))
    out = _collected(spark, changes.coalesced(events, "30 minutes", "1 hour"), "append")
    return out.select("path", "n_events", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


def stream_identity(spark: SparkSession, folder: str) -> DataFrame:
    """A stream against a static index: customers that are known, by market segment, and others."""
    events = _stream(spark, folder).select(F.col("user_id").alias("path"), F.when(F.col("event_type") != "error", F.lit("h")).alias("hash"))
    index = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").alias("path"), F.when(F.col("c_acctbal") > 0, "h").otherwise("old").alias("known_hash"))
    return _collected(spark, changes.with_identity(events, index).groupBy("state").agg(F.count(F.lit(1)).alias("n")), "complete")


def stream_proof_debt(spark: SparkSession, folder: str) -> DataFrame:
    events = _stream(spark, folder).select(F.col("user_id").cast("string").alias("project"), "ts", F.when(F.col("event_type") == "signup", "proof").otherwise("change").alias("kind"))
    return _collected(spark, changes.proof_debt(events, 5), "update").select("project", "n_changes", "due")


QUERIES = {f.__name__: f for f in (stream_running_counts, stream_sessions, stream_identity, stream_proof_debt)}

ORACLE = {
    "stream_running_counts": "SELECT event_type, count(*) AS n_hits FROM events GROUP BY 1",
    "stream_sessions": """SELECT user_id::VARCHAR AS path, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
        FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_identity": """SELECT CASE WHEN e.event_type = 'error' THEN CASE WHEN c.c_custkey IS NULL THEN 'transient' ELSE 'tombstone' END WHEN c.c_custkey IS NULL THEN 'unknown' WHEN c.c_acctbal > 0 THEN 'unchanged' ELSE 'verified' END AS state,
        count(*) AS n FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id GROUP BY 1""",
    "stream_proof_debt": """SELECT user_id::VARCHAR AS project, count(*) FILTER (event_type <> 'signup' AND (proof IS NULL OR (ts, k) > (proof))) AS n_changes,
        count(*) FILTER (event_type <> 'signup' AND (proof IS NULL OR (ts, k) > (proof))) >= 5 AS due FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN (ts, k) END) OVER (PARTITION BY user_id) AS proof
        FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 'proof' ELSE 'change' END AS k FROM events)) GROUP BY 1""",
}
