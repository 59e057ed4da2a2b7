import json
import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codestrata.streaming import changes

T0 = datetime(2025, 5, 1, 12, 0, 0)
AT = lambda s: (T0 + timedelta(seconds=s))


def test_bursts_keep_a_create_and_split_renames(spark):
    events = spark.createDataFrame(
        [(AT(0), "a", "create", None), (AT(1), "a", "modify", None), (AT(5), "a", "modify", None), (AT(0), "b", "rename", "c")], changes.EVENT_SCHEMA
    )
    got = {(r.path, r.kind, r.n_events, r.related_path) for r in changes.coalesced(changes.split_renames(events)).collect()}
    assert got == {("a", "create", 2, None), ("a", "modify", 1, None), ("b", "rename_from", 1, "c"), ("c", "rename_to", 1, "b")}


def test_identity_and_guard(spark):
    events = spark.createDataFrame([("same", "1"), ("new", "2"), ("changed", "3"), ("gone", None), ("never", None)], "path string, hash string")
    index = spark.createDataFrame([("same", "1"), ("changed", "0"), ("gone", "4")], "path string, known_hash string")
    rows = changes.with_identity(events, index)
    assert {r.path: r.state for r in rows.collect()} == {"same": "unchanged", "new": "unknown", "changed": "verified", "gone": "tombstone", "never": "transient"}
    kept, held = changes.guard(rows, 100)
    assert not held and {r.path for r in kept.collect()} == {"new", "changed", "gone"}
    kept, held = changes.guard(rows, 3)
    assert held and kept.count() == 0


def test_ledger_over_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, keys in enumerate((["a", "b"], ["a", None], ["b"])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"key": k}) for k in keys))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    ledger = changes.Ledger(str(tmp_path / "ledger"))
    stream = changes.file_events(spark, str(source), "key string", per_trigger=1)
    pulses = []

    def sink(batch, n):
        pulses.append(n)
        ledger(batch, n)

    changes.run_to_end(stream, sink, tmp_path.name, "append")
    rows = {(r.key, r.status, r.n_seen) for r in ledger.read(spark, max(pulses)).collect()}
    assert rows == {("a", "resolved", 2), ("b", "resolved", 1), ("b", "open", 1)}


def test_proof_debt_sets_back(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [("p", 0, "change"), ("p", 1, "change"), ("q", 0, "change"), ("p", 2, "proof"), ("p", 3, "change")]
    (source / "a.json").write_text("\n".join(json.dumps({"project": p, "ts": AT(s).isoformat(), "kind": k}) for p, s, k in lines))
    out = []
    stream = changes.proof_debt(changes.file_events(spark, str(source), "project string, ts timestamp, kind string"), 1)
    changes.run_to_end(stream, lambda b, n: out.extend(b.collect()), tmp_path.name)
    assert {(r.project, r.n_changes, r.due) for r in out} == {("p", 1, True), ("q", 1, True)}


def test_global_timer_counts_paths(spark):
    events = spark.createDataFrame([(AT(0), "a", "modify", None), (AT(1), "b", "modify", None), (AT(9), "c", "delete", None)], changes.EVENT_SCHEMA)
    got = sorted((r.n_paths, r.n_events) for r in changes.coalesced(events, keyed=False).select(F.col("n_paths"), F.col("n_events")).collect())
    assert got == [(1, 1), (2, 2)]


def test_what_arrives_while_a_pulse_runs_is_the_next_one(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text('{"path": "one"}')
    seen = []

    def sink(batch, pulse):
        if not seen:
            for n in (2, 3):
                (inbox / f"b{n}.json").write_text(f'{{"path": "p{n}"}}')
        seen.append(sorted(r.path for r in batch.collect()))

    query = changes.pulsed(changes.file_events(spark, str(inbox)), sink, f"busy-{tmp_path.name}", "0 seconds")
    try:
        for _ in range(200):
            if len(seen) > 1:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert seen[:2] == [["one"], ["p2", "p3"]]
