"""The cockpit counts the tests of every component without listing their pairs, and leaves no shuffle behind."""

import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from codestrata.operators import graph

FILES = "file_id long, project_key string, rel_path string, language string, size_bytes long, hash string, indexed_at timestamp, removed_at timestamp"


def test_components_are_counted_and_not_listed(spark, tmp_path, monkeypatch):
    ids = [100 * c + k for c in range(3) for k in range(6)]
    links = [(n, n + 1 if n % 100 < 5 else n - 5) for n in ids]
    spark.createDataFrame([(n, "p", f"{'tests' if n % 100 < 2 else 'src'}/f{n}.ts", "ts", 1, "h", None, None) for n in ids], FILES).write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame(links, "source_file_id long, target_file_id long").write.parquet(f"{tmp_path}/dependencies.parquet")
    listed, by_hubs = [], graph.reach_by_hubs

    def watched(*args):
        out = by_hubs(*args)
        listed.append(out[2].count())
        return out

    monkeypatch.setattr(graph, "reach_by_hubs", watched)
    got = {r.file_id: r.n_tests for r in entry.queries()["review_cockpit"](spark, str(tmp_path)).collect()}
    assert got == {n: 0 if n % 100 < 2 else 2 for n in ids}
    assert listed == [0]


def write(spark, folder, files, links):
    spark.createDataFrame(files, FILES).write.parquet(f"{folder}/files.parquet")
    spark.createDataFrame(links, "source_file_id long, target_file_id long").write.parquet(f"{folder}/dependencies.parquet")


def test_odd_files_and_links_against_the_sql(spark, tmp_path):
    """Paths and names that several files have, keys that are missing, links that are repeated or lead nowhere."""
    names = [("p", "src/a/b/c/d/one.ts"), ("p", "tests/one.ts"), ("p", "src/one.ts"), (None, "src/one.ts"), (None, "tests/one.ts"), ("p", None), (None, None), ("q", "tests/one.ts")]
    rows = [(k, *names[k % 8], "ts" if k % 3 else None, 15000 + 2000 * (k % 7), "h" if k % 5 else None, None, None) for k in range(48)]
    rows += [(3, "p", "src/one.ts", "TS", 90000, None, None, None), (None, "p", "tests/one.ts", None, 1, None, None, None), (None, "p", "src/one.ts", "ts", 1, "h", None, None)]
    links = [(1, 2), (1, 2), (2, 10), (10, 2), (9, 18), (9, 999), (998, 2), (5, 5), (None, 2), (4, None), (4, 11), (11, 26), (15, 10)]
    write(spark, str(tmp_path), rows, links)
    db = duckdb.connect()
    for name in ("files", "dependencies"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("review_cockpit", "test_impact"):
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, db.sql(entry.oracle_sql()[name]).fetchall()))


def test_no_shuffle_waits_for_the_garbage_of_the_driver(spark, tmp_path):
    ids = range(40)
    write(spark, str(tmp_path), [(n, "p", f"{'tests' if n % 4 == 0 else 'src'}/f{n % 30}.ts", "ts", 1, "h", None, None) for n in ids], [(n, n + 1) for n in ids])
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    there = lambda: {p.name.split("_")[1] for d in folders for p in Path(d).rglob("shuffle_*")}
    before = there()
    kept = entry.queries()["review_cockpit"](spark, str(tmp_path))  # up to the last join; the loops have run
    until = time.time() + 20
    while len(there() - before) > 4 and time.time() < until:  # files go in the background; sums of one row may stay
        time.sleep(0.2)
    assert len(there() - before) <= 4
    assert kept.count() == len(ids)
