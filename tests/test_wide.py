"""The wide table has every value of every payload, in columns or in the map beside them."""

import json

import __spark_entry__ as entry

PAYLOADS = "name string, generation_id string, updated_at string, payload string, part_count long, storage_mode string"
PARTS = "name string, generation_id string, part_index long, payload binary"


def test_paths_beyond_the_columns_are_in_the_map(spark, tmp_path):
    whole = {f"k{n:02d}": n for n in range(20)}
    rows = [("n", f"g{n}", f"2024-01-01T00:00:0{n}Z", text, None, None) for n, text in enumerate((json.dumps(whole), json.dumps(whole | {"k19": "x", "k18": None}), '{"k00": 1}', "[]"))]
    spark.createDataFrame(rows, PAYLOADS).write.parquet(f"{tmp_path}/state_payloads.parquet")
    spark.createDataFrame([], PARTS).write.parquet(f"{tmp_path}/state_payload_parts.parquet")
    got = {r.generation_id: r for r in entry.queries()["p3_wide_table"](spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got["g0"].k00 == 0.0 and got["g0"].k11 == 11.0
    assert {p: c.number_value for p, c in got["g0"].others.items()} == {f"k{n}": float(n) for n in range(12, 20)}
    assert got["g1"].others["k19"].cast_failed and got["g1"].n_failed_casts == 1 and got["g1"].others["k18"].raw_kind is None
    assert got["g2"].others == {} and got["g3"].others is None and got["g0"].n_failed_casts == 0
