"""Small cases of the operators on symbols, rules of texts and graphs."""

import random

from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.operators import graph, relational, scans

EDGES = "src long, dst long"


def test_names_follow_edges_to_their_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8), (None, 1)], EDGES)
    marked = spark.createDataFrame([(1, "a"), (9, "b"), (4, "a"), (None, "x"), (1, "a")], "node long, name string")
    got = {(r.node, r.name) for r in graph.propagate_names(marked, edges).collect()}
    assert got == {(1, "a"), (2, "a"), (3, "a"), (4, "a"), (9, "b"), (8, "b"), (None, "x")}


def test_reach_counts_against_a_walk(spark):
    rng = random.Random(4)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    links = [(a, b) for a, b in links if a != b]
    ahead = {}
    for a, b in links:
        ahead.setdefault(a, set()).add(b)

    def reached(n):
        seen, todo = set(), [n]
        while todo:
            for m in ahead.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return len(seen - {n})

    nodes = sorted(ahead)
    got = {r.node: r.n for r in graph.reach_counts(spark.createDataFrame(links, EDGES), spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    assert got == {n: reached(n) for n in nodes}


def test_cycles_of_all_lengths_against_a_search(spark):
    rng = random.Random(6)
    links = {(rng.randrange(9), rng.randrange(9)) for _ in range(30)}
    want = set()

    def walk(path):
        for a, b in links:
            if a != path[-1]:
                continue
            if b == path[0] and len(path) > 1:
                want.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < 5:
                walk(path + [b])

    for n in range(9):
        walk([n])
    got = [tuple(r.path) for r in graph.cycles(spark.createDataFrame(sorted(links), EDGES), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(map(len, got)) == 5


def test_components_with_loops(spark):
    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 2), (5, 6)], EDGES)
    assert {(r.node, r.component) for r in graph.components(edges, loops=True).collect()} == {(1, 1), (2, 3), (3, 3)}
    assert {(r.node, r.component) for r in graph.components(edges.where("src = dst"), loops=True).collect()} == {(1, 1), (2, 2)}
    assert graph.components(edges.where("src = 5"), loops=True).count() == 0


def test_folded_case(spark):
    words = ["Straße", "STRASSE", "ΣΟΦΟΣ", "σοφος", "ﬁle", "FILE", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(paths.folded_case(F.col("w"))).collect()]
    assert got[0] == got[1] == "strasse" and got[2] == got[3] and got[4] == got[5] and got[6] is None
    assert all(g == w.casefold() for g, w in zip(got, words) if w)


def test_exports_in_lists_and_namespaces(spark):
    text = "export { a, b as c, type D };\nexport type { E } from './e';\nexport * as ns from './n';\nexport const f = 1; // export const no = 1\nexport default class G {}\nexport {};"
    got = spark.createDataFrame([(text,)], "t string").select(scans.named_exports(F.col("t"))).first()[0]
    assert sorted(got) == ["D", "E", "G", "a", "c", "f", "ns"]


def test_suffixes_of_any_length(spark):
    node = "/".join("abcdefghijklm")
    wanted = spark.createDataFrame([("/".join("cdefghijklm"),), ("m",), ("x",), (node,)], "path string")
    got = {r.path: r.status for r in relational.suffix_lookup(wanted, spark.createDataFrame([(node,), ("z/m",)], "node string")).collect()}
    assert got == {"/".join("cdefghijklm"): "suffix", "m": "ambiguous", "x": "unknown", node: "exact"}


def test_missing_keys_against_the_largest(spark):
    rows = [("g", "en", k) for k in "abcd"] + [("g", "de", k) for k in "abx"] + [("g", "fr", None)]
    got = {r.i: (r.n_keys, r.n_missing, r.completeness) for r in relational.missing_from_largest(spark.createDataFrame(rows, "g string, i string, k string"), "g", "i", "k").collect()}
    assert got == {"en": (4, 0, 1.0), "de": (3, 2, 0.5)}


def test_rules_count_and_leave_out(spark):
    rows = spark.createDataFrame([(1, "P", '<img src="a"><img alt="b">'), (2, "P", ""), (3, None, None)], "record_id long, project_key string, text string")
    rules = [("image", "access", 5.0, 20.0, r"<img\b", r"<img\b[^>]*\balt="), ("never", "x", 1.0, 1.0, "zzz", "")]
    assert [(r.record_id, r.rule, r.n) for r in scans.rule_hits(rows, rules).collect()] == [(1, "image", 1)]
