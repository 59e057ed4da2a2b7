"""Tests and the files that they reach, against a search from each test."""

import random

import pytest

import __spark_entry__ as entry

FILES = "file_id long, project_key string, rel_path string, language string, size_bytes long, hash string, indexed_at timestamp, removed_at timestamp"


def stem(path):
    return path.rsplit("/", 1)[-1].split(".")[0].lower()


def expected(files, links):
    """target to (n_tests, confidence, n_direct)."""
    out = {}
    for t, (tp, path) in files.items():
        if "/tests/" not in f"/{path}/":
            continue
        seen, todo = set(), [t]
        while todo:
            n = todo.pop()
            more = {b for a, b in links if a == n} - seen
            seen |= more
            todo += more
        for s, (sp, target) in files.items():
            if "/tests/" in f"/{target}/":
                continue
            direct, naming = (t, s) in links, tp == sp and stem(path) == stem(target)
            if s in seen or naming:
                n, c, d = out.get(s, (0, 0.0, 0))
                out[s] = (n + 1, max(c, 1.0 if direct else 0.8 if naming else 0.6), d + direct)
    return out


def write(spark, folder, files, links):
    spark.createDataFrame([(k, p, path, "ts", 1, "h", None, None) for k, (p, path) in files.items()], FILES).write.parquet(f"{folder}/files.parquet")
    spark.createDataFrame(sorted(links), "source_file_id long, target_file_id long").write.parquet(f"{folder}/dependencies.parquet")


def check(spark, folder, files, links):
    write(spark, folder, files, links)
    want = expected(files, links)
    got = {r.target: (r.n_tests, r.confidence, r.n_direct) for r in entry.queries()["test_impact"](spark, folder).collect()}
    assert got == want
    open_files = {r.file_id for r in entry.queries()["test_gap"](spark, folder).collect()}
    assert open_files == {k for k, (_, p) in files.items() if "/tests/" not in f"/{p}/"} - set(want)


def test_a_chain_of_imports_is_followed_to_its_end(spark, tmp_path):
    files = {k: ("p", f"src/f{k}.ts") for k in range(2, 9)} | {1: ("p", "tests/t.ts"), 9: ("q", "src/t.ts")}
    check(spark, str(tmp_path), files, {(k, k + 1) for k in range(1, 7)})


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_in_a_graph_with_cycles(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = {k: (rng.choice("pq"), f"{'tests' if k % 4 == 0 else 'src'}/n{rng.randrange(15)}.ts") for k in range(60)}
    links = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(75)) if a != b}
    check(spark, str(tmp_path), files, links)


def test_no_name_is_left_out(spark, tmp_path):
    files = {k: ("p", f"src/a{k}/{name}.ts") for k, name in enumerate(("index", "main", "mod", "__init__", "other"))}
    files |= {k + 10: ("p", f"tests/{name}.ts") for k, name in enumerate(("index", "main", "mod", "__init__"))} | {20: ("p", "tests/b/index.ts")}
    check(spark, str(tmp_path), files, {(20, 0), (20, 4)})
