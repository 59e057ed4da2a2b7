import random
from datetime import datetime, timedelta

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.operators import orphans

DEPS = "dep_id long, project_key string, source_file_id long, target_file_id long, recorded_at timestamp, key string, endpoint string, period int"
FILES = "file_id long, indexed_at timestamp, removed_at timestamp, start string, stop string, pos int"
T0 = datetime(2025, 1, 1)


def brute(deps, files):
    out = set()
    for d in deps:
        for end, key in (("source", d[2]), ("target", d[3])):
            at = d[4]
            if key is None or at is None:
                continue
            own = [f for f in files if f[0] == key]
            begun = [f for f in own if f[1] is None or f[1] <= at]
            if any(f[2] is None or f[2] > at for f in begun):
                continue
            out.add((d[0], end, "missing" if not own else "deleted" if begun else "late"))
    return out


def found(spark, deps, files):
    rows = orphans.dependency_orphans(spark.createDataFrame(deps, DEPS), spark.createDataFrame(files, FILES)).collect()
    got = [(r.ref_id, r.endpoint, r.reason) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def random_case(seed, n_deps=300, n_files=60):
    rng = random.Random(seed)
    day = lambda: T0 + timedelta(days=rng.randrange(120), seconds=rng.randrange(86400))
    files = []
    for k in range(n_files):
        key = rng.choice([k, k + 40_000, -k, 0])
        start = rng.choice([day(), None, T0 + timedelta(days=31)])
        files.append((key, start, rng.choice([None, (start or T0) + timedelta(days=rng.randrange(60))]), "x", "y", 1))
    deps = []
    for k in range(n_deps):
        key = lambda: rng.choice([None, rng.randrange(-70, 70), rng.randrange(39_990, 40_070), 1])
        deps.append((k, None, key(), key(), rng.choice([None, day(), day(), day()]), "a", "b", 3))
    return deps + deps[:20], files + files[:5]


def test_against_brute_force(spark):
    for seed in (1, 2):
        deps, files = random_case(seed)
        assert found(spark, deps, files) == brute(deps, files)


def test_empty_tables(spark):
    deps, files = random_case(3, 20)
    assert found(spark, [], files) == set()
    assert {r[2] for r in found(spark, deps, [])} == {"missing"}


def test_boundaries(spark):
    month = datetime(2025, 2, 1)
    files = [(5, month, datetime(2025, 3, 1), None, None, None)]
    deps = [(1, None, 5, None, month, None, None, None), (2, None, 5, None, datetime(2025, 3, 1), None, None, None), (3, None, 5, 5, month - timedelta(microseconds=1), None, None, None)]
    assert found(spark, deps, files) == {(2, "source", "deleted"), (3, "source", "late"), (3, "target", "late")}


def test_hot_key_and_counts(spark):
    files = [(1, T0, None, None, None, None)]
    deps = [(k, None, 1, 9, T0 + timedelta(days=k % 40), None, None, None) for k in range(400)]
    refs = orphans.dependency_references(spark.createDataFrame(deps, DEPS))
    counts = orphans.orphan_counts(
        orphans.find_orphans(refs, spark.createDataFrame(files, FILES).selectExpr("file_id key", "indexed_at start", "removed_at stop")), "dependencies"
    ).toPandas()
    assert counts["n_references"].sum() == 400 and set(counts["n_keys"]) == {1}


def test_dictionary_of_text_keys(spark):
    codes = orphans.encode_keys(spark.createDataFrame(pd.DataFrame({"k": ["a", "b", None, "a", "c"]})), "k").toPandas()
    assert sorted(codes["k"]) == ["a", "b", "c"] and codes["code"].is_unique


def test_text_keys_and_sparse_keys(spark):
    deps, files = random_case(4)
    want = brute(deps, files)
    name = lambda k: None if k is None else f"file-{k}"
    refs = spark.createDataFrame([(d[0], e, name(k), d[4]) for d in deps for e, k in (("source", d[2]), ("target", d[3]))], "ref_id long, endpoint string, key string, at timestamp")
    parents = spark.createDataFrame([(name(f[0]), f[1], f[2]) for f in files], "key string, start timestamp, stop timestamp")
    rows = orphans.find_orphans(refs, parents).collect()
    assert {(r.ref_id, r.endpoint, r.reason) for r in rows} == want and all(r.key.startswith("file-") for r in rows)
    far = lambda k: None if k is None else k * (1 << 44) + 7
    assert found(spark, [(d[0], None, far(d[2]), far(d[3]), *d[4:]) for d in deps], [(far(f[0]), *f[1:]) for f in files]) == want


def test_many_versions_of_one_parent(spark):
    files = [(1, T0 + timedelta(days=k), T0 + timedelta(days=k, hours=12), None, None, None) for k in range(200)]
    deps = [(k, None, 1, None, T0 + timedelta(days=k, hours=6 if k % 2 else 18), None, None, None) for k in range(200)]
    assert found(spark, deps, files) == {(k, "source", "deleted") for k in range(0, 200, 2)}


@settings(max_examples=50, deadline=None)
@given(st.integers(-(1 << 62), 1 << 62))
def test_word_and_bit_give_the_key_back(key):
    assert (key >> 6) * 64 + (key & 63) == key
