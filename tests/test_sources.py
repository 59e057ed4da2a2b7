import json
import sqlite3

import pytest

from codestrata.plans import reports
from codestrata.plans.steps import Plan, Step
from codestrata.sources import documents, stores, trees


def test_tree_owner_and_changes(spark, tmp_path):
    for name, text in {"app/package.json": "{}", "app/src/a.ts": "export const a = 1;\n", "app/node_modules/x/i.js": "1", "lib/setup.py": "setup()", "lib/m.py": "import os\n", "app/bad.py": b"\xff\xfe"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())
    tree = trees.read_tree(spark, str(tmp_path))
    assert {r.rel_path for r in tree.select("rel_path").collect()} == {"app/package.json", "app/src/a.ts", "lib/setup.py", "lib/m.py", "app/bad.py"}
    owned = {r.rel_path: r.root for r in trees.owner(tree.select("rel_path"), trees.project_roots(tree)).collect()}
    assert owned["app/src/a.ts"] == "app" and owned["lib/m.py"] == "lib"
    text = trees.texts(tree)
    assert {r.rel_path: r.text for r in text.collect()}["app/bad.py"] is None
    before = text.select("rel_path", "sha256").collect()
    (tmp_path / "lib/m.py").write_text("import sys\n")
    snapshot = spark.createDataFrame(before)
    assert [r.rel_path for r in trees.changed_since(trees.read_tree(spark, str(tmp_path)), snapshot).collect()] == ["lib/m.py"]


def test_documents_in_parts_round_trip(spark):
    docs = spark.createDataFrame([("a", "größer" * 50), ("b", "")], "name string, payload string")
    parts = stores.in_parts(docs, 7)
    assert {(r.name, r.payload, r.intact) for r in stores.from_parts(parts).collect()} == {("a", "größer" * 50, True), ("b", "", True)}
    broken = stores.from_parts(parts.where("not (name = 'a' and part_index = 1)")).collect()
    assert {r.name: r.intact for r in broken} == {"a": False, "b": True}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", "x"), (2, "q", "x")], "k int, project string, v string")
    stores.upsert_parquet(spark, str(tmp_path / "t"), 0, rows, ["k"])
    again = stores.upsert_parquet(spark, str(tmp_path / "t"), 1, spark.createDataFrame([(2, "q", "y"), (3, "q", "y")], rows.schema), ["k"])
    assert {(r.k, r.v) for r in again.collect()} == {(1, "x"), (2, "y"), (3, "y")}
    stores.rebuild_scopes(rows, str(tmp_path / "s"), "project")
    stores.rebuild_scopes(spark.createDataFrame([(9, "q", "z")], rows.schema), str(tmp_path / "s"), "project")
    assert {(r.k, r.project) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(1, "p"), (9, "q")}


def test_sqlite_and_logs(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (a integer, b text)")
        db.executemany("insert into t values (?, ?)", [(k, f"v{k}") for k in range(25)])
    assert stores.read_sqlite(spark, str(tmp_path / "x.db"), "t", "a long, b string", 3).count() == 25
    (tmp_path / "log.txt").write_text("step atlas took 12.5 s\nnoise\nstep audit took 3 s\n")
    got = {(r.metric, r.value) for r in stores.parse_log(spark.read.text(str(tmp_path / "log.txt")), {"seconds": r"took ([0-9.]+) s"}).collect()}
    assert got == {("seconds", 12.5), ("seconds", 3.0)}


def test_steps():
    ran = []
    step = lambda n, **k: Step(n, lambda: ran.append(n), **k)
    plan = Plan([step("scan", writes=("atlas",)), step("audit", reads=("atlas",), writes=("report",)), step("gate", reads=("report",)), step("other")])
    assert plan.closure(["gate"]) == ["scan", "audit", "gate"] and plan.stale(["atlas"]) == ["audit", "gate"]
    assert set(plan.execute(["gate"]).values()) == {"done"} and ran == ["scan", "audit", "gate"]
    bad = Plan([Step("a", lambda: 1 / 0), Step("b", after=("a",)), Step("c")])
    assert bad.execute() == {"a": "failed", "b": "skipped", "c": "done"}
    with pytest.raises(ValueError):
        Plan([Step("a", after=("b",)), Step("b", after=("a",))])


def test_reports(spark):
    df = spark.createDataFrame([("a|b", "c", 2), ("c", "d", 5)], "src string, dst string, weight int")
    assert "a\\|b" in reports.markdown(df, "Edges") and "n0 -->|5| n1" in reports.diagram(df)


def test_documents(spark, tmp_path):
    from codestrata.sources import documents

    text = '{"a": "x // y", /* note */ "b": [1, 2,],} // end'
    row = spark.createDataFrame([(text,), ("no json",), (None,)], "t string").select(documents.parsed(documents.F.col("t"), "a string, b array<int>").alias("d")).collect()
    assert row[0].d.a == "x // y" and list(row[0].d.b) == [1, 2] and row[2].d is None
    schema = "name string, n int"
    assert documents.read_document(spark, str(tmp_path / "none.json"), schema, {"name": "d", "n": 0}).collect()[0].name == "d"
    (tmp_path / "bundle-1.json").write_text('{"name": "x",\n "n": 2}')
    (tmp_path / "profile.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    assert documents.read_document(spark, str(tmp_path / "bundle-1.json"), schema).collect()[0].n == 2
    got = {(r.kind, r.name, r.ok) for r in documents.read_evidence(spark, str(tmp_path), {"bundle": "bundle", "profile": "profile"}).selectExpr("kind", "name", "content is not null ok").collect()}
    assert got == {("bundle", "bundle-1.json", True), ("profile", "profile.json", False)}


def test_documents_are_put_in_place_at_once(spark, tmp_path):
    path = f"{tmp_path}/a.json"
    for n in (1, 2):
        documents.write_document(spark, path, json.dumps({"n": n, "t": "größer"}))
        row = documents.read_document(spark, path, "n long, t string").first()
        assert (row.n, row.t) == (n, "größer")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.json"]


def test_rebuild_points_to_the_last_version(spark, tmp_path):
    folder = str(tmp_path)
    assert stores.rebuild(spark.range(3), folder, 1).count() == 3
    spark.range(9).write.parquet(f"{folder}/version=2")  # written, and not yet pointed to
    assert stores.current(spark, folder).count() == 3
    assert stores.rebuild(spark.range(5), folder, 2).count() == 5


def test_canonical_orders_keys(spark):
    row = spark.sql("SELECT named_struct('b', 1, 'a', named_struct('z', 2, 'c', CAST(null AS int))) AS x, map('q', 1, 'a', 2) AS m").select(stores.canonical("x").alias("x"), stores.canonical("m").alias("m")).first()
    assert (row.x, row.m) == ('{"a":{"z":2},"b":1}', '{"a":2,"q":1}')
