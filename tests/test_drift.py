import json
import random

from codestrata.operators import drift

PAYLOADS = "name string, payload string, storage_mode string, generation_id string, part_count long, updated_at string, kind string, seq int"
PARTS = "name string, generation_id string, part_index long, payload binary, fields string"


def rows(*values, name="n"):
    return [(name, json.dumps(v) if not isinstance(v, str) else v, None, f"g{k}", 0, f"2025-01-{k + 1:02d}{'T' if k % 2 else ' '}10:00:00.000{'Z' if k % 2 else ''}", "x", 1) for k, v in enumerate(values)]


def found(spark, payloads, parts=()):
    maps = drift.payload_maps(spark.createDataFrame(payloads, PAYLOADS), spark.createDataFrame(list(parts), PARTS))
    return {(r.name, r.generation_id, r.change_kind, r.old_field, r.new_field) for r in drift.changes(maps).collect()}


def test_kinds_of_change(spark):
    p = rows({"a": 1, "b": {"c": "x"}}, {"a": 1.0, "b": {"d": "x"}}, {"a": "1", "b": {"d": "x"}, "e": [1]}, {"a": "1", "e": [1]})
    assert found(spark, p) == {
        ("n", "g1", "renamed", "b.c", "b.d"), ("n", "g2", "retyped", "a", "a"), ("n", "g2", "added", "", "e"), ("n", "g3", "removed", "b.d", ""),
    }


def test_nulls_change_nothing_and_the_last_type_stays(spark):
    p = rows({"a": 1}, {"a": None}, {"a": 2}, {"a": None}, {"a": "x"})
    assert found(spark, p) == {("n", "g4", "retyped", "a", "a")}


def test_a_field_that_turns_into_an_object_is_one_change(spark):
    assert found(spark, rows({"a": 1, "z": 1}, {"a": {"value": 1, "unit": "s"}, "z": 1}, {"a": {"value": 1, "unit": "s"}, "z": 1})) == {("n", "g1", "retyped", "a", "a")}


def test_parts_wrapped_json_repeats_and_broken_payloads(spark):
    whole = json.dumps({"a": "größer", "b": 2}).encode()
    parts = [("n", "g1", 1, whole[7:], None), ("n", "g1", 0, whole[:7], None), ("n", "g1", 0, whole[:7], None), ("n", "other", 0, b"{}", None)]
    p = rows({"a": "größer", "b": 1}, "stub", json.dumps(json.dumps({"a": "größer"})), "{broken", {"a": "größer", "c": True})
    p[1] = (*p[1][:2], drift.PARTED, "g1", 2, *p[1][5:])
    assert found(spark, p + p[:2], parts) == {("n", "g2", "removed", "b", ""), ("n", "g4", "added", "", "c")}


def test_equal_values_pair_by_name_and_names_stay_apart(spark):
    p = rows({"a": 5, "b": 5}, {"x": 5, "y": 5, "z": 5}) + rows({"a": 1}, {"a": 1}, name="m")
    assert found(spark, p) == {("n", "g1", "renamed", "a", "x"), ("n", "g1", "renamed", "b", "y"), ("n", "g1", "added", "", "z")}


def test_empty_tables_and_null_payloads(spark):
    assert found(spark, []) == set()
    assert found(spark, [("n", None, None, "g0", 0, "2025-01-01 00:00:00.000", None, None), (None, "{}", None, None, None, None, None, None)]) == set()


def test_sequence_over_months_and_null_names(spark):
    p = [(None, json.dumps({"a": k}), None, f"g{k}", 0, f"2025-{k + 1:02d}-01 00:00:00.000", None, None) for k in range(5)]
    maps = drift.payload_maps(spark.createDataFrame(p, PAYLOADS), spark.createDataFrame([], PARTS))
    seq = {r.generation_id: (r.seq, r.last_seq) for r in drift.numbered(maps).collect()}
    assert seq == {f"g{k}": (k + 1, 5) for k in range(5)}


def test_typed_table_reports_failed_casts(spark):
    p = rows({"a": 1}, {"a": 2}, {"a": "x"}, {"a": "3"}, {"a": None})
    maps = drift.payload_maps(spark.createDataFrame(p, PAYLOADS), spark.createDataFrame([], PARTS))
    t = {r.generation_id: (r.number_value, r.cast_failed) for r in drift.typed_table(maps).collect()}
    # of the two types two payloads each have, number comes first by name
    assert t == {"g0": (1.0, False), "g1": (2.0, False), "g2": (None, True), "g3": (3.0, False), "g4": (None, False)}
    wide = {r.generation_id: r.a for r in drift.wide_table(maps, {"a": "number"}).collect()}
    assert wide["g1"] == 2.0 and wide["g2"] is None and wide["g3"] == 3.0


def by_hand(values):
    """Changes of one name by a walk along its payloads, flat fields only."""
    out, known, last = set(), {}, None
    kind = lambda v: {bool: "boolean", int: "number", str: "text", list: "list"}.get(type(v))
    for k, value in enumerate(values):
        if last is not None:
            gone, new = sorted(set(last) - set(value)), sorted(set(value) - set(last))
            for path in list(gone):
                match = next((n for n in new if value[n] == last[path] and value[n] is not None and kind(value[n]) == kind(last[path])), None)
                if match:
                    out.add(("n", f"g{k}", "renamed", path, match))
                    gone.remove(path)
                    new.remove(match)
            out |= {("n", f"g{k}", "removed", p, "") for p in gone} | {("n", f"g{k}", "added", "", p) for p in new}
            out |= {("n", f"g{k}", "retyped", p, p) for p in value if p in last and kind(value[p]) and known.get(p) not in (None, kind(value[p]))}
        known = {p: kind(v) or (known.get(p) if last is not None and p in last else None) for p, v in value.items()}
        last = value
    return out


def test_borders_of_stretches_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(drift, "BLOCK_SEQ", 3)
    rng = random.Random(2)
    values = [{p: rng.choice([None, None, 7, "x" * 40, [1], True, f"u{k}"]) for p in "abc" if rng.random() < 0.85} for k in range(28)]
    assert found(spark, rows(*values)) == by_hand(values)
    held = [{"a": 1}] + [{"a": None}] * 9 + [{"a": "x"}]
    assert found(spark, rows(*held)) == {("n", "g10", "retyped", "a", "a")}
