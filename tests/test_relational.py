import pandas as pd
from pyspark.sql import functions as F

from codestrata.functions import paths, scores
from codestrata.operators import findings, relational, scans


def test_full_diff_treats_equal_nulls_as_unchanged(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (2, None), (4, "y")], "k int, v string")
    got = {r.k: r.state for r in relational.full_diff(a, b, ["k"], "v").collect()}
    assert got == {1: "modified", 2: "unchanged", 3: "removed", 4: "added"}


def test_suffix_lookup_states(spark):
    nodes = spark.createDataFrame([("a/b/c.ts",), ("x/b/c.ts",), ("d/e.ts",), ("e.ts",)], "node string")
    wanted = spark.createDataFrame([("b/c.ts",), ("d/e.ts",), ("e.ts",), ("b.ts",), ("a/b/c.ts",)], "path string")
    got = {r.path: (r.node, r.status) for r in relational.suffix_lookup(wanted, nodes).collect()}
    assert got == {"b/c.ts": (None, "ambiguous"), "d/e.ts": ("d/e.ts", "exact"), "e.ts": ("e.ts", "exact"), "b.ts": (None, "unknown"), "a/b/c.ts": ("a/b/c.ts", "exact")}


def test_similar_by_tokens_against_all_pairs(spark):
    sets = {k: {f"t{(k * j) % 11}" for j in range(1, 6)} for k in range(30)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id int, tokens array<string>")
    got = {(r.left_id, r.right_id) for r in relational.similar_by_tokens(df, df, 0.6, 1000).collect()}
    assert got == {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_nearest_rank(spark):
    values = [5, 1, 1, 9, 7, None]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v int")
    for p in (0.0, 0.5, 0.95, 1.0):
        s = sorted(v for v in values if v is not None)
        assert [r.v for r in relational.nearest_rank(df, ["k"], "v", p).collect()] == [s[round((len(s) - 1) * p)]]


def test_majority_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None)], "k int, v string")
    assert [(r.v, r.n) for r in relational.majority(df, ["k"], "v").collect()] == [("a", 1)]


def test_rollups_add_up(spark):
    f = spark.createDataFrame([("r1", "p", "a", "d", "low"), ("r1", "q", "a", "d", "low"), ("r2", "p", "b", "d", "low")], "rule string, project string, path string, detail string, severity string")
    t = findings.rollups(f).toPandas()
    assert set(t.groupby("level")["n"].sum()) == {3}


def test_upsert_and_scope(spark):
    old = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert {tuple(r) for r in relational.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "b")}
    assert {tuple(r) for r in relational.replace_scope(old, new, "v", spark.createDataFrame([("b",)], "v string")).collect()} == {(1, "a"), (2, "a"), (2, "b"), (3, "b")}


def test_column_functions(spark):
    df = spark.createDataFrame([(".\\src\\HTTPServer2Test.tsx", "L10-L22", 3, 0)], "p string, s string, a int, b int")
    p = paths.normalized(F.col("p"))
    row = df.select(
        p.alias("p"), paths.language_of(p).alias("lang"), paths.span_lines(F.col("s")).alias("lines"), paths.identifier_tokens(paths.stem(p)).alias("t"),
        scores.ratio(F.col("a"), F.col("b"), 0).alias("r"), paths.has_fragment(p, "src").alias("h"), paths.has_fragment(p, "sr").alias("no"), scores.band(F.col("a"), [(5, "hi"), (2, "mid")], "lo").alias("band"),
    ).first()
    assert row.asDict() == {"p": "src/HTTPServer2Test.tsx", "lang": "typescript", "lines": 13, "t": ["http", "server", "2", "test"], "r": 0.0, "h": True, "no": False, "band": "mid"}


def test_scans(spark):
    py = "class A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    rows = scans.python_symbols(spark.createDataFrame([(1, py), (2, "def ("), (3, None)], "record_id long, text string")).collect()
    assert {(r.record_id, r.name, r.kind, r.parent) for r in rows} == {(1, "A", "class", None), (1, "f", "method", "A"), (1, "g", "function", None), (2, None, "unparsed", None)}
    assert scans.brace_spans("a {\n '}' // {\n { }\n}") == [(3, 3, 1), (1, 4, 0)]
    df = spark.createDataFrame([("import a from './x';\n// import b from 'no'\nexport const c = 1; /* export const d */", "typescript"), ("import os\nfrom .a import b", "python")], "t string, l string")
    got = [(list(r.i), list(r.e)) for r in df.select(scans.import_strings(F.col("t"), F.col("l")).alias("i"), scans.named_exports(F.col("t")).alias("e")).collect()]
    assert got[0][0][0] == "./x" and got[0][1] == ["c"] and sorted(got[1][0]) == [".a", "os"]
    like = spark.createDataFrame(pd.DataFrame({"a": ["abcd", None], "b": ["abxd", "x"]})).select(scans.likeness("a", "b").alias("r")).collect()
    assert like[0].r == 0.75 and like[1].r is None
