import pytest
from pyspark.sql import functions as F

from codestrata.llm import mixing

DOCS = "doc_id long, text string, source string, whole int, rank double"
TARGETS = "mix_name string, source string, target_share double, max_repeats long"


def counts(spark, sizes):
    rows = [(n, source, size) for n, (source, size) in enumerate((s, x) for s, sized in sizes.items() for x in sized)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def run(spark, c, targets, total=None, seed=7):
    t = spark.createDataFrame(targets, TARGETS)
    used = mixing.mixed(c, t, total, seed)
    return used, {(r.mix_name, r.source): r for r in mixing.shares(mixing.quotas(c, t, total), used).collect()}


def test_shares_and_caps(spark):
    sizes = {"big": [10 + k % 90 for k in range(2000)], "mid": [50] * 100, "small": [100] * 10}
    used, got = run(spark, counts(spark, sizes), [("m", "Big", 0.5, 1), ("m", "mid", 0.3, 4), ("m", " SMALL ", 0.1, 3), ("m", "none", 0.1, 2)])
    assert got["m", "small"].used_tokens == 3000 and got["m", "small"].most_copies == 3
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert got["m", source].actual_share == pytest.approx(share / 0.9, abs=0.01)
    assert got["m", "none"].actual_share == 0
    most = {r.source: r.m for r in used.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["big"] == 1 and most["mid"] <= 4


def test_given_total_leaves_capped_sources_behind(spark):
    _, got = run(spark, counts(spark, {"a": [10] * 10, "b": [10] * 1000}), [("m", "a", 0.5, 2), ("m", "b", 0.5, 2)], total=10_000)
    assert got["m", "a"].used_tokens == 200 and got["m", "b"].used_tokens == 5000


def test_the_choice_depends_on_seed_and_ids_alone(spark):
    c = counts(spark, {"a": [5 + k % 50 for k in range(500)], "b": [7] * 30})
    t = [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)]
    pick = lambda df, s: {(r.source, r.doc_id, r.copies) for r in run(spark, df, t, None, s)[0].collect()}
    assert pick(c, 1) == pick(c.repartition(7), 1) != pick(c, 2)


def test_larger_documents_are_likelier(spark):
    c = counts(spark, {"a": [10] * 1000 + [100] * 1000})
    used, _ = run(spark, c, [("m", "a", 1.0, 1)], total=20_000)
    n = {r.n_tokens: r["count"] for r in used.groupBy("n_tokens").count().collect()}
    assert n[100] > 4 * n[10]


def test_large_documents_are_certain_and_the_rest_is_solved_again(spark):
    c = counts(spark, {"a": [500, 300] + [1 + k % 3 for k in range(600)]})
    t = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    row = mixing.certain_sizes(c, mixing.quotas(c, t, 900)).first()
    small = [1 + k % 3 for k in range(600)]
    assert (row.certain, row.room, row.squares) == (300, 100.0, float(sum(x * x for x in small)))
    for seed in range(3):
        used, got = run(spark, c, [("m", "a", 1.0, 1)], 900, seed)
        assert {500, 300} <= {r.n_tokens for r in used.collect()} and abs(got["m", "a"].used_tokens - 900) <= 3


def test_empty_tables_nulls_and_ties(spark):
    assert run(spark, counts(spark, {}), [("m", "a", 0.5, 1)])[1]["m", "a"].used_tokens == 0
    used, got = run(spark, counts(spark, {"a": [5] * 8}), [("m", "a", None, None), ("m", None, 0.5, 1), ("n", "a", 0.5, 1), ("n", "a", 0.5, 1)])
    assert got["n", "a"].used_tokens == 40 and got["m", "a"].used_tokens == 0
    assert run(spark, counts(spark, {"a": [5]}), [])[1] == {}


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "Hello world", "Review-Thread ", 1, 1.0), (2, "", "a", 1, 1.0), (3, None, "a", 1, 1.0), (4, "x", None, 1, 1.0), (5, "word " * 50_000, "a", 1, 1.0), (6, "<|endoftext|>", "a", 1, 1.0)], DOCS)
    got = {r.doc_id: (r.source, r.n_tokens) for r in mixing.token_counts(docs).collect()}
    assert got[1] == ("review_thread", 2) and set(got) == {1, 5, 6} and got[5][1] >= 50_000 and got[6][1] > 1
