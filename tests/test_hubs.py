"""Reach by hubs: no large component is listed, however many there are and however they hang together."""

import random

import pytest

from codestrata.operators import graph

EDGES = "src long, dst long"


def reached(links):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    to = {}
    for start in {n for link in links for n in link}:
        seen, todo = {start}, [start]
        while todo:
            more = out.get(todo.pop(), set()) - seen
            seen |= more
            todo += more
        to[start] = seen - {start}
    return to


def found(spark, links, origins):
    near = graph.adjacency(spark.createDataFrame(sorted(links), EDGES))
    up, down, rest = (df.collect() for df in graph.reach_by_hubs(near, spark.createDataFrame([(n,) for n in origins], "node long")))
    by_hub = [(u.node, d.node) for u in up for d in down if (u.split, u.part) == (d.split, d.part) and u.node != d.node]
    listed = [tuple(r) for r in rest]
    assert len(set(by_hub + listed)) == len(by_hub + listed)  # each pair once
    return set(by_hub + listed), listed


def ring(first, n=12):
    return {(first + k, first + (k + 1) % n) for k in range(n)}


def test_every_component_has_its_hub(spark):
    links = set().union(*(ring(100 * k) for k in range(4)))
    origins = [100 * k + 3 for k in range(4)]
    got, listed = found(spark, links, origins)
    assert got == {(a, b) for a, to in reached(links).items() if a in origins for b in to} and not listed


def test_components_in_a_row_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROOM", 5)
    links = set().union(*(ring(100 * k) for k in range(3))) | {(4, 104), (104, 207)}
    origins = [n for n in {a for a, _ in links} if n % 2]
    got, listed = found(spark, links, origins)
    assert got == {(a, b) for a, to in reached(links).items() if a in origins for b in to}
    assert len(listed) < len(links)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_a_search(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "ROOM", 10)
    rng = random.Random(seed)
    links = {(a, b) for a, b in ((rng.randrange(50), rng.randrange(50)) for _ in range(60)) if a != b}
    origins = [n for n in {n for link in links for n in link} if n % 3 == 0]
    got, _ = found(spark, links, origins)
    assert got == {(a, b) for a, to in reached(links).items() if a in origins for b in to}
