"""Streams of file changes: rename split, coalescing, identity against an index, ledgers and counters.

Every function takes a streaming or a batch DataFrame with ts timestamp, path, kind (create, modify,
delete, rename) and related_path. State is kept by key; the only global state is that of the
amplification guard, which looks at one micro-batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codestrata.session import ensure_checkpoint_dir

EVENT_SCHEMA = "ts timestamp, path string, kind string, related_path string"


def file_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, fmt: str = "json", per_trigger: int | None = None) -> DataFrame:
    """Events from files that arrive in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


def split_renames(events: DataFrame) -> DataFrame:
    """A rename becomes the end of the old path and the begin of the new one, linked to each other."""
    whole = lambda p, k, r: F.struct(p.alias("path"), k.alias("kind"), r.alias("related_path"))
    path, other = F.col("path"), F.col("related_path")
    parts = F.when(
        F.col("kind") == "rename", F.array(whole(path, F.lit("rename_from"), other), whole(other, F.lit("rename_to"), path))
    ).otherwise(F.array(whole(path, F.col("kind"), other)))
    return events.select("ts", F.explode(parts).alias("e")).select("ts", "e.path", "e.kind", "e.related_path")


def coalesced(events: DataFrame, gap: str = "1.5 seconds", late: str = "10 seconds", keyed: bool = True) -> DataFrame:
    """One row for each burst of events of a path (or of all paths): the last event wins, a create stays one.

    With ``keyed=False`` a single timer runs over all paths, as for a small local watcher; the state
    then lies in one partition.
    """
    window = F.session_window("ts", gap)
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    keys = [window, F.col("path")] if keyed else [window]
    made = F.bool_or(F.col("kind") == "create")
    last = F.max_by("kind", "ts")
    out = events.groupBy(*keys).agg(
        F.when(made & last.isin("modify", "create"), "create").otherwise(last).alias("kind"),
        F.max_by("related_path", "ts").alias("related_path"), F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        *([] if keyed else [F.count_distinct("path").alias("n_paths")] if not events.isStreaming else [F.approx_count_distinct("path").alias("n_paths")]),
    )
    return out.drop("session_window")


def with_identity(events: DataFrame, index: DataFrame) -> DataFrame:
    """Adds state: unchanged, verified, unknown, transient or tombstone.

    events: path, hash (null: the file is gone). index: path, known_hash; a static table.
    """
    known = index.select("path", "known_hash", F.lit(True).alias("_known"))
    state = (
        F.when(F.col("hash").isNull() & F.col("_known").isNull(), "transient")
        .when(F.col("hash").isNull(), "tombstone")
        .when(F.col("_known").isNull(), "unknown")
        .when(F.col("hash") == F.col("known_hash"), "unchanged")
        .otherwise("verified")
    )
    return events.join(known, "path", "left").withColumn("state", state).drop("_known")


def guard(batch: DataFrame, threshold: int) -> tuple[DataFrame, bool]:
    """The changes to hand on, and whether the batch is held: many paths and an unknown one among them."""
    seen = batch.agg(F.count_distinct("path").alias("n"), F.bool_or(F.col("state") == "unknown").alias("unknown")).first()
    held = bool(seen["n"] >= threshold and seen["unknown"])
    return batch.where(F.lit(not held) & (F.col("state") != "unchanged") & (F.col("state") != "transient")), held


def ledger_step(ledger: DataFrame, sighted: DataFrame, pulse: int) -> DataFrame:
    """The ledger after a pulse: open entries that were sighted count on, others resolve, new ones open.

    ledger: key, status, first_pulse, last_pulse, n_seen; sighted: key.
    """
    now = sighted.select("key").where("key is not null").distinct().withColumn("_seen", F.lit(True))
    open_rows = ledger.where("status = 'open'").join(now, "key", "full_outer")
    fresh = F.col("first_pulse").isNull()
    kept = open_rows.select(
        "key",
        F.when(F.col("_seen"), "open").otherwise("resolved").alias("status"),
        F.when(fresh, F.lit(pulse)).otherwise(F.col("first_pulse")).cast("long").alias("first_pulse"),
        F.when(F.col("_seen"), F.lit(pulse)).otherwise(F.col("last_pulse")).cast("long").alias("last_pulse"),
        (F.when(F.col("_seen"), 1).otherwise(0) + F.coalesce("n_seen", F.lit(0))).cast("long").alias("n_seen"),
    )
    return ledger.where("status <> 'open'").unionByName(kept)


class Ledger:
    """A ledger in a folder: each pulse writes a version of its own, and reads the one before.

    A pulse that is run again after a failure reads the same version and writes the same rows.
    """

    SCHEMA = "key string, status string, first_pulse long, last_pulse long, n_seen long"

    def __init__(self, folder: str):
        self.folder = folder

    def read(self, spark: SparkSession, pulse: int) -> DataFrame:
        path = f"{self.folder}/pulse={pulse}"
        jvm = spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return spark.read.schema(self.SCHEMA).parquet(path)
        return spark.createDataFrame([], self.SCHEMA)

    def __call__(self, batch: DataFrame, pulse: int) -> None:
        spark = batch.sparkSession
        ledger_step(self.read(spark, pulse - 1), batch, pulse).write.mode("overwrite").parquet(f"{self.folder}/pulse={pulse}")


def running_counts(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"), F.max("ts").alias("last_at"))


def proof_debt(events: DataFrame, limit: int) -> DataFrame:
    """project, n_changes, n_pulses, due: changes since the last proof of each project.

    events: project, ts, kind (``change`` or ``proof``). A proof sets the counters back.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        changes, pulses = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "kind"])
        pulses += 1
        for kind in rows["kind"]:
            if kind == "proof":
                changes, pulses = 0, 0
            else:
                changes += 1
        state.update((changes, pulses))
        yield pd.DataFrame({"project": [key[0]], "n_changes": [changes], "n_pulses": [pulses], "due": [changes >= limit]})

    out = "project string, n_changes long, n_pulses long, due boolean"
    return events.select("project", "ts", "kind").groupBy("project").applyInPandasWithState(fold, out, "n_changes long, n_pulses long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str, mode: str = "update") -> None:
    """Run all that is there, then stop."""
    place = os.path.join(ensure_checkpoint_dir(stream.sparkSession), "streams", name)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def pulsed(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str, interval: str = "1.5 seconds", mode: str = "append") -> StreamingQuery:
    """Runs until it is stopped, one pulse at a time: what arrives while the sink is busy waits, and is the next pulse as a whole."""
    place = os.path.join(ensure_checkpoint_dir(stream.sparkSession), "streams", name)
    return stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(processingTime=interval).foreachBatch(sink).start()
