"""Payloads in parts are members of the sequence that likeness is taken from."""

from difflib import SequenceMatcher

import __spark_entry__ as entry

PAYLOADS = "name string, payload string, storage_mode string, generation_id string, part_count long, updated_at string"
PARTS = "name string, generation_id string, part_index long, payload binary"


def test_a_payload_in_parts_is_compared_and_compared_with(spark, tmp_path):
    texts = {"g0": '{"a": 1}', "g1": '{"a": "größer", "b": 2}', "g2": '{"a": 1, "c": 3}'}
    rows = [("n", "stub" if k == 1 else text, "partitioned_json_v1" if k == 1 else None, g, 2 if k == 1 else 0, f"2025-01-0{k + 1}{'T' if k else ' '}10:00:00.000") for k, (g, text) in enumerate(texts.items())]
    whole = texts["g1"].encode()
    spark.createDataFrame(rows + rows[:2], PAYLOADS).write.parquet(f"{tmp_path}/state_payloads.parquet")
    spark.createDataFrame([("n", "g1", 1, whole[9:]), ("n", "g1", 0, whole[:9])], PARTS).write.parquet(f"{tmp_path}/state_payload_parts.parquet")
    got = {r.generation_id: r.likeness for r in entry.queries()["snapshot_likeness"](spark, str(tmp_path)).collect()}
    ratio = lambda a, b: SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio()
    assert got == {"g1": ratio("g0", "g1"), "g2": ratio("g1", "g2")}
