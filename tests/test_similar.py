"""Pairs that are alike only by tokens that many files hold."""

import random

import __spark_entry__ as entry
from codestrata.operators import relational

FILES = "file_id long, project_key string, rel_path string, language string, size_bytes long, hash string, indexed_at timestamp, removed_at timestamp"


def alike(a, b):
    return len(a & b) / len(a | b)


def test_frequent_tokens_propose_pairs(spark):
    rng = random.Random(5)
    sets = {k: {f"t{int(rng.random() ** 3 * 12)}" for _ in range(rng.randrange(1, 7))} for k in range(60)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id int, tokens array<string>")
    for threshold in (0.4, 0.7, 1.0):
        got = {(r.left_id, r.right_id): r.similarity for r in relational.similar_by_tokens(df, df, threshold, 1).collect()}
        assert got == {(a, b): alike(sets[a], sets[b]) for a in sets for b in sets if a != b and alike(sets[a], sets[b]) >= threshold}


def test_variants_are_found_by_stem_without_shared_words(spark, tmp_path):
    rows = [(1, "a", "x/FooBar.ts"), (2, "a", "src/one.ts"), (3, "a", "p/q/lost.ts"), (5, "a", "z/y.ts"), (10, "b", "y/foobar.ts"), (11, "b", "src/one.ts"), (12, "b", "src/one.js"), (13, "b", "n/ew.ts")]
    spark.createDataFrame([(k, p, path, "ts", 1, "h", None, None) for k, p, path in rows], FILES).write.parquet(f"{tmp_path}/files.parquet")
    got = {(r.file_id, r.base_id, r.score, r.state) for r in entry.queries()["variation_reconciler"](spark, str(tmp_path)).collect()}
    assert got == {  # each file of b against a, the first of the largest projects
        (10, 1, 0.5, "drift"), (11, 2, 1.0, "identical"), (12, 2, 1.0, "identical"), (13, None, None, "new"), (None, 3, None, "deleted"), (None, 5, None, "deleted"),
    }
