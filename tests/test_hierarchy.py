import random

from codestrata.operators import hierarchy

SCHEMA = "parent long, child long, node long, depth string"


def brute(links):
    parent = {}
    for p, c, *_ in links:
        if p is not None and c is not None and p != c:
            parent[c] = min(p, parent.get(c, p))
    nodes = set(parent) | set(parent.values())
    on_cycle = set()
    for n in nodes:
        seen, at = [], n
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            on_cycle.update(seen[seen.index(at):])

    def ring(n):
        out, at = [n], parent[n]
        while at != n:
            out.append(at)
            at = parent[at]
        return out

    children = {}
    for c, p in parent.items():
        children.setdefault(p, []).append(c)

    def below(n):
        seen, todo = set(), [n]
        while todo:
            for c in children.get(todo.pop(), []):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return len(seen - {n})

    out = {}
    for n in nodes:
        way, at = [n], n
        while at not in on_cycle and at in parent:
            at = parent[at]
            way.append(at)
        status = "on_cycle" if n in on_cycle else "below_cycle" if at in on_cycle else "tree"
        root = min(ring(at)) if at in on_cycle else at
        out[n] = (root, len(way) - 1, "/".join(map(str, reversed(way))), below(n), status)
    return out


def found(spark, links):
    rows = hierarchy.hierarchies(spark.createDataFrame(links, SCHEMA)).collect()
    out = {r.node: (r.root, r.depth, r.path, r.n_descendants, r.status) for r in rows}
    assert len(out) == len(rows)
    return out


def test_trees_cycles_and_what_hangs_below(spark):
    links = [(1, 2, 0, ""), (2, 3, 0, ""), (2, 4, 0, ""), (7, 8, 0, ""), (8, 9, 0, ""), (9, 7, 0, ""), (9, 20, 0, ""), (20, 21, 0, ""), (30, 31, 0, ""), (31, 30, 0, ""), (None, 5, 0, ""), (5, None, 0, ""), (6, 6, 0, ""), (1, 2, 1, "")]
    assert found(spark, links) == brute(links)


def test_random_forests_with_cycles(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), c, None, None) for c in range(400) if rng.random() < 0.9]
    assert found(spark, links) == brute(links)


def test_several_parents_keep_the_smallest(spark):
    links = [(5, 9, 0, ""), (3, 9, 0, ""), (1, 3, 0, "")]
    assert found(spark, links) == brute(links)


def test_no_links(spark):
    assert found(spark, []) == {}


def small_blocks(monkeypatch, merge):
    for name, value in (("BLOCK_ROWS", 8), ("PAGE_IDS", 16), ("WIDER", 4), ("MERGE_ROWS", merge)):
        monkeypatch.setattr(hierarchy, name, value)


def test_long_chain_over_small_blocks(spark, monkeypatch):
    small_blocks(monkeypatch, 10)
    chain = [(k, k + 1, None, None) for k in range(60)] + [(100 + k, 101 + k, None, None) for k in range(12)] + [(112, 100, None, None)]
    random.Random(1).shuffle(chain)
    assert found(spark, chain) == brute(chain)


def test_levels_and_halving_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    near = [(max(0, c - rng.randrange(1, 9)), c, None, None) for c in range(1, 150)] + [(130, 3, 0, ""), (1, 0, 0, "")]
    far = [(rng.randrange(150), c, None, None) for c in range(150)]
    for merge in (0, 40):  # 0: paths are halved as soon as a level doesn't shrink
        small_blocks(monkeypatch, merge)
        for links in (near, far):
            assert found(spark, links) == brute(links)


def test_deep_chain(spark, monkeypatch):
    n = 20_000
    links = spark.range(1, n).selectExpr("id - 1 AS parent", "id AS child")
    monkeypatch.setattr(hierarchy, "OUT_CHARS", 500_000)
    rows = hierarchy.hierarchies(links).selectExpr("node", "depth", "n_descendants", "length(path) AS size").toPandas().set_index("node")
    assert (rows["depth"] == rows.index).all() and (rows["n_descendants"] == n - 1 - rows.index).all()
    assert rows["size"][n - 1] == len("/".join(map(str, range(n))))
