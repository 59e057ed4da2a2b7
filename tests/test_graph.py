import random

from codestrata.operators import graph

EDGES = "src long, dst long"


def make(n=60, m=110, seed=3):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def reach(edges, start):
    seen, todo = set(), list(start)
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_build_edges_splits_self_links_and_drops_unknown(spark):
    links = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (1, 9), (None, 1)], EDGES)
    nodes = spark.createDataFrame([(1,), (2,), (None,)], "node long")
    edges, loops = graph.build_edges(links, nodes)
    assert [tuple(r) for r in edges.collect()] == [(1, 2)] and [tuple(r) for r in loops.collect()] == [(2, 2)]


def test_reach_with_and_without_depth(spark):
    edges = make()
    df = spark.createDataFrame(edges, EDGES)
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node for r in graph.reach(df, start).collect()} == reach(edges, [0]) | {0}
    one = {r.node for r in graph.reach(df, start, 1).collect() if r.depth == 1}
    assert one == {b for a, b in edges if a == 0} - {0}


def test_pairs_leave_out_the_origin_even_on_a_cycle(spark):
    pairs = {(r.origin, r.node) for r in graph.reach_pairs(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], EDGES)).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)}


def test_components_against_mutual_reach(spark):
    for seed in (3, 4):
        edges = make(seed=seed)
        to = {n: reach(edges, [n]) for n in range(60)}
        want = {}
        for n in range(60):
            own = {m for m in to[n] if n in to[m]} | {n}
            if len(own) > 1:
                want[n] = max(own)
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, EDGES)).collect()}
        assert got == want


def test_no_component_in_a_tree(spark):
    assert graph.components(spark.createDataFrame([(1, 2), (2, 3)], EDGES)).count() == 0


def test_cycles_keep_their_direction(spark):
    edges = [(1, 2), (2, 3), (3, 1), (1, 3), (3, 2), (2, 1), (4, 4)]
    got = {tuple(r.path) for r in graph.cycles(spark.createDataFrame(edges, EDGES), 3).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 2, 3), (1, 3, 2)}


def test_witness_is_a_shortest_cycle(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 3)], EDGES)
    row = graph.shortest_witness(df, graph.components(df)).collect()
    assert [(r.length, list(r.witness)) for r in row] == [(3, [1, 2, 3])]


def test_bounded_closure_says_what_it_left_out(spark):
    df = spark.createDataFrame([(1, k) for k in range(2, 12)], EDGES)
    rows = graph.bounded_closure(df, spark.createDataFrame([(1,)], "node long"), 4, 3).collect()
    assert {r.node for r in rows if r.taken} == {1, 2, 3, 4} and all(r.truncated for r in rows) and len(rows) == 11
