"""Operators on directed graphs, given as edges(src, dst).

Loops run on the driver, one join a round over the frontier alone; each round is checkpointed, so
that plans stay short and a lost executor costs one round. Edges with a null end don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.session import cut, cut_clean, release


def build_edges(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between two different known nodes, self links as a side output); each once.

    links: src, dst. nodes: node.
    """
    known = nodes.select("node").where("node is not null").distinct()
    links = links.where("src is not null and dst is not null").select("src", "dst").distinct()
    links = links.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    links = links.select("src", "dst")
    return links.where("src <> dst"), links.where("src = dst")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in, with one pass over the edges and one exchange."""
    end = lambda node, out: F.struct(F.col(node).alias("node"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"))
    ends = F.explode(F.array(end("src", 1), end("dst", 0)))
    return edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def reach(edges: DataFrame, origins: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth: what can be reached from any of origins(node), itself at depth 0."""
    edges = cut(edges.select("src", "dst"))  # read each round
    seen = cut(origins.select("node", F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if depth % 16 == 0 else seen.unionByName(frontier)
    return seen


def reach_pairs(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """origin, node, depth for every origin; the origin itself isn't in its own result.

    The result may hold a row for each pair of nodes: bound max_depth, or condense the graph first.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())  # read each round
    pairs = edges.select(F.col("src").alias("origin"), F.col("dst").alias("node"), F.lit(1).alias("depth"))
    frontier, depth = pairs, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).where("origin <> node").distinct()
        frontier = cut(step.join(pairs, ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        pairs = pairs.unionByName(frontier)  # each part is checkpointed
    return pairs


def pairs_of(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """origin, node for all that each of origins(node) reaches; itself isn't in its own result."""
    edges = cut(edges.select("src", "dst"))  # read each round
    pairs = frontier = cut(origins.select(F.col("node").alias("origin"), "node").distinct())
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(pairs, ["origin", "node"], "left_anti"))
        pairs = cut(pairs.unionByName(frontier)) if depth % 16 == 0 else pairs.unionByName(frontier)
    return pairs.where("origin <> node")


def reach_by_hub(edges: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(origins that reach a hub, nodes that the hub reaches, all other pairs), as node, node and origin, node.

    An origin reaches a node if both are in the first two, or if the third has the pair; never both. The
    hub is the node with the most links in times out, so that in a graph with one large component few
    pairs are listed. The result is exact for any hub.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    hub = cut(degrees(edges).orderBy(F.desc(F.col("n_out") * F.col("n_in")), "node").limit(1).select("node"))
    down = cut(reach(edges, hub).select("node"))
    up = cut(origins.select("node").distinct().join(reach(reverse(edges), hub), "node", "left_semi"))
    away = edges.join(down.select(F.col("node").alias("dst")), "dst", "left_anti")
    return up, down, pairs_of(away, up).unionByName(pairs_of(edges, origins.select("node").join(up, "node", "left_anti")))


def aligned(df: DataFrame, key: str) -> DataFrame:
    """Cut, by partitions of key and in its order, and known to be: a plan that adapts doesn't say how it lies, so this one doesn't.

    Joins by key then leave it where it is, so that a loop exchanges no more than its frontier.
    """
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_clean(df.repartition(key).sortWithinPartitions(key))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def adjacency(edges: DataFrame) -> DataFrame:
    """node, outs, ins: one row a node with a link to another one; edges are distinct."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("out"), F.lit(None).alias("in")), F.struct(F.col("dst").alias("node"), F.lit(None).alias("out"), F.col("src").alias("in"))))
    rows = edges.where("src <> dst").select(ends.alias("e")).select("e.*").repartition("node")
    return aligned(rows.groupBy("node").agg(F.collect_list("out").alias("outs"), F.collect_list("in").alias("ins")), "node")


def adjacency_within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``adjacency`` of the edges that ``build_edges`` gives for links(src, dst) and nodes(node), in one plan.

    The links are exchanged three times: by source, where they are made distinct, by target, and by source again.
    """
    known = nodes.select("node").where("node is not null").distinct()
    at = lambda end: known.select(F.col("node").alias(end))
    links = links.where("src <> dst").select("src", "dst").repartition("src").distinct()
    links = links.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")
    ins = links.groupBy(F.col("dst").alias("node")).agg(F.collect_list("src").alias("ins"))
    outs = links.repartition("src").groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("outs"))
    rows = known.join(outs, "node", "left").join(ins, "node", "left").where("outs is not null or ins is not null")
    none = F.array().cast(T.ArrayType(known.schema["node"].dataType))
    return aligned(rows.select("node", F.coalesce("outs", none).alias("outs"), F.coalesce("ins", none).alias("ins")), "node")


def weak_components(near: DataFrame) -> DataFrame:
    """node, part: the components of an adjacency, whatever the direction of its links.

    Every node points to its smallest neighbour, if that is smaller; chains of pointers are halved until they
    end, and the links between different ends are the graph of the next round, where no end is alone.
    """
    linked = F.explode("outs").alias("b")
    points = near.select("node", F.array_min(F.concat("outs", "ins", F.array("node"))).alias("part"))
    links, left, whole = near.select(F.col("node").alias("a"), linked), None, None
    while True:
        at = cut_clean(points)
        while True:  # each round reads what the one before has written
            points = at.select("node", "part")
            ahead = points.select(F.col("node").alias("part"), F.col("part").alias("next"))
            last, at = at, cut_clean(points.join(ahead, "part").select("node", F.col("next").alias("part"), (F.col("next") < F.col("part")).alias("moved")))
            release(last)
            if at.where("moved").isEmpty():
                break
        points = at.select("node", "part")
        ends = points.select(F.col("node").alias("a"), F.col("part").alias("x"))
        links = links.join(ends, "a").select("x", "b").join(ends.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
        last, left = left, cut_clean(links.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        links = left
        if last is not None:
            release(last)
        whole = points if whole is None else whole.join(points.select(F.col("node").alias("part"), F.col("part").alias("next")), "part", "left").select("node", F.coalesce("next", "part").alias("part"))
        if links.isEmpty():
            return whole
        both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))
        points = links.select(both.alias("e")).groupBy("e.node").agg(F.min("e.near").alias("near")).select("node", F.least("node", "near").alias("part"))


def _flood(near: DataFrame, hubs: DataFrame, way: str) -> DataFrame:
    """node, part: what hubs(node, part) lead to by one way of the adjacency, themselves with it."""
    seen = frontier = aligned(hubs, "node")
    while True:
        found = frontier.join(near, "node").select(F.explode(way).alias("node"), "part").repartition("node").distinct()
        frontier = aligned(found.join(seen, "node", "left_anti"), "node")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


ROOM = 1_000_000  # pairs that are listed at least before the graph is split once more


def reach_by_hubs(near: DataFrame, origins: DataFrame, splits: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(origins that reach a hub, nodes that it reaches, all other pairs), as node, split, part twice and origin, node.

    An origin reaches a node if both have a split and a part in common, or if the third has the pair: one of
    them, and once. Every weak component has its hub, so that large components aren't listed, however many
    there are. If what the hubs leave is more than ROOM and the links, it is split again at hubs of its own
    (what goes round the hub, and what doesn't reach it, are graphs of their own), as long as a split saves
    more pairs than it reads links; so large components in a row aren't listed either. Exact for any hubs.

    near: an ``adjacency``.
    """
    score = F.struct((F.size("outs").cast("long") * F.size("ins")).alias("n"), "node")
    hubs = near.join(weak_components(near), "node").groupBy("part").agg(F.max(score)["node"].alias("node")).select("node", F.col("node").alias("part"))
    hubs = cut_clean(hubs)
    origins = cut_clean(origins.select("node").distinct())
    down, above = _flood(near, hubs, "outs"), _flood(near, hubs, "ins")
    up = cut_clean(above.join(origins, "node", "left_semi"))
    n_links = near.agg(F.sum(F.size("outs").cast("long"))).first()[0] or 0
    sizes = up.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(down.groupBy("part").agg(F.count(F.lit(1)).alias("m")), "part")
    saved = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    most = max(ROOM, n_links) if saved > n_links else None
    tag = F.lit(splits).alias("split")
    own_up, own_down = up.select("node", tag, "part"), down.select("node", tag, "part")
    starts = origins.join(up.select("node", F.lit(True).alias("is_up")), "node", "left").select(F.col("node").alias("origin"), "node", F.coalesce("is_up", F.lit(False)).alias("is_up"))
    rest = _rest_pairs(near, starts, down.select("node", F.lit(True).alias("is_down")), most)
    if rest is not None:
        return own_up, own_down, rest
    for inside, some in ((down, up), (above, origins.join(up, "node", "left_anti"))):
        links = near.join(inside, "node", "left_anti").select(F.col("node").alias("src"), F.explode("outs").alias("dst"))
        more = reach_by_hubs(adjacency(links.join(inside.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")), some, 2 * splits + (1 if inside is down else 2))
        own_up, own_down = own_up.unionByName(more[0]), own_down.unionByName(more[1])
        rest = more[2] if rest is None else rest.unionByName(more[2])
    return own_up, own_down, rest


def _rest_pairs(near: DataFrame, starts: DataFrame, down: DataFrame, most: int | None) -> DataFrame | None:
    """origin, node of all pairs but those of an origin that is up and a node that is down; None if they are more than most."""
    pairs = frontier = cut_clean(starts)
    n, depth, parts = 0, 0, [pairs]
    while True:
        depth += 1
        step = frontier.join(near, "node").select("origin", F.explode("outs").alias("node"), "is_up").repartition("node").distinct()
        step = step.join(down, "node", "left").where("not is_up or is_down is null").select("origin", "node", "is_up")
        frontier = cut_clean(step.join(pairs, ["origin", "node"], "left_anti"))
        found = frontier.count()
        if not found:
            return pairs.where("origin <> node").select("origin", "node")
        n += found
        if most is not None and n > most:
            release(*parts, frontier)
            return None
        pairs = pairs.unionByName(frontier)
        if depth % 16:
            parts.append(frontier)
        else:
            pairs = cut_clean(pairs)
            release(*parts)
            parts = [pairs, frontier]  # the frontier is read once more


def reach_counts(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """node, n: how many others each of origins(node) reaches. Those that reach the hub are counted with it."""
    up, down, rest = reach_by_hub(edges, origins)
    n_down = F.lit(down.count())
    own = up.join(down.withColumn("inside", F.lit(1)), "node", "left").select("node", (n_down - F.coalesce("inside", F.lit(0))).alias("n"))
    others = rest.groupBy(F.col("origin").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(others).groupBy("node").agg(F.sum("n").alias("n"))


def bounded_closure(edges: DataFrame, origins: DataFrame, max_nodes: int, max_depth: int) -> DataFrame:
    """node, depth, taken, truncated: the closure in order of (depth, node), up to max_nodes."""
    found = reach(edges, origins, max_depth)
    sizes = {r["depth"]: r["n"] for r in found.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a level
    room, whole = max_nodes, -1
    for depth in sorted(sizes):
        if sizes[depth] > room:
            break
        room, whole = room - sizes[depth], depth
    # Of the level that is cut only its first nodes are wanted, not a rank of all of them.
    edge = found.where(F.col("depth") == whole + 1).orderBy("node").limit(room).select("node", F.lit(True).alias("_first"))
    taken = (F.col("depth") <= whole) | F.coalesce("_first", F.lit(False))
    return found.join(edge, "node", "left").select("node", "depth", taken.alias("taken"), F.lit(sum(sizes.values()) > max_nodes).alias("truncated"))


def propagate(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """node: the nodes of marked and all that follow from them along the edges (fixpoint)."""
    return reach(edges, marked).select("node")


def propagate_names(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """node, name: marked, and each name carried on along the edges of the nodes that have it (fixpoint)."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = frontier = cut(marked.select("node", "name").distinct())
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "name").distinct()
        frontier = cut(step.join(seen, ["node", "name"], "left_anti"))
        seen = cut(seen.unionByName(frontier)) if depth % 16 == 0 else seen.unionByName(frontier)
    return seen


def trim(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """Edges between nodes that have edges in and out; what goes can't be on a cycle. Each round reads the one before three times, so it is cut."""
    for _ in range(rounds):
        edges = cut(
            edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            .join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            .select("src", "dst")
        )
    return edges


def components(edges: DataFrame, loops: bool = False) -> DataFrame:
    """node, component: strongly connected components of two nodes or more, with ``loops`` of one with a self loop, too, named by their largest node.

    Colouring: every node takes the largest node that reaches it; a node that keeps its own name is
    the head of a component, which is what reaches the head within its colour.
    """
    left = cut(trim(edges.where("src <> dst").distinct()))
    out = None
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = cut(nodes.withColumn("colour", F.col("node")))
        changed = colours
        while True:
            offers = changed.join(left, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
            merged = colours.join(offers, "node", "left").select(
                "node", F.greatest("colour", "offer").alias("colour"), F.coalesce(F.col("offer") > F.col("colour"), F.lit(False)).alias("moved")
            )
            merged = cut(merged)
            changed = merged.where("moved").select("node", "colour")
            colours = merged.select("node", "colour")
            if changed.isEmpty():
                break
        # Backwards from the heads, within the colour.
        tinted = (
            left.join(colours.withColumnRenamed("node", "src"), "src")
            .join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("dst_colour")), "dst")
            .where("colour = dst_colour")
            .select("src", "dst", "colour")
        )
        tinted = cut(tinted)
        member = frontier = cut(colours.where("node = colour"))
        while True:
            step = frontier.select(F.col("node").alias("dst"), "colour").join(tinted, ["dst", "colour"])
            back = step.select(F.col("src").alias("node"), "colour")
            frontier = cut(back.distinct().join(member, "node", "left_anti"))
            if frontier.isEmpty():
                break
            member = member.unionByName(frontier)
        out = member if out is None else out.unionByName(member)
        gone = member.select("node")
        left = cut(
            trim(
                left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
            )
        )
    own = edges.where("src = dst" if loops else "false").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    if out is None:
        return own
    sizes = out.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = cut(out.join(sizes, "colour").select("node", F.col("colour").alias("component")))
    return found.unionByName(own.join(found, "node", "left_anti"))


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """path array, length: every elementary cycle of up to max_length nodes, from its smallest node.

    A path only grows to nodes above its first one, so that each cycle is found once and keeps its
    direction; links that lie on no cycle are taken away first. The last step is the join that closes.
    """
    edges = cut(trim(edges.where("src <> dst").distinct()))
    back = edges.select(F.col("src").alias("last"), F.col("dst").alias("first"))
    paths = edges.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    out = None
    for length in range(2, max_length + 1):
        closed = paths.join(back, ["last", "first"]).select("path", F.lit(length).alias("length"))
        out = closed if out is None else out.unionByName(closed)
        if length < max_length:
            paths = paths.join(edges, F.col("last") == F.col("src")).where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst")))
            paths = paths.select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))
    return out


def cycle_class(length: Column) -> Column:
    return F.when(length == 2, "mutual").when(length > 4, "long").otherwise("other")


def undirected_key(path: Column) -> Column:
    """The same for a cycle and the one that runs the other way."""
    return F.concat_ws(">", F.sort_array(path))


def shortest_witness(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component, length, witness: a shortest cycle through the smallest node of each component.

    members: node, component. Of equal cycles the first in order of nodes.
    """
    inner = (
        edges.join(members.select(F.col("node").alias("src"), "component"), "src")
        .join(members.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst")
        .where("component = c2")
        .select("src", "dst", "component")
    )
    inner = cut(inner)
    heads = members.groupBy("component").agg(F.min("node").alias("head"))
    walk = cut(heads.select("component", "head", F.col("head").alias("node"), F.array("head").alias("path")))
    seen, out = walk.select("component", "node"), None
    while not walk.isEmpty():
        ahead = walk.withColumnRenamed("node", "src").join(inner, ["src", "component"]).select("component", "head", F.col("dst").alias("node"), "path")
        ahead = cut(ahead)
        done = ahead.where("node = head").groupBy("component").agg(F.min("path").alias("witness"))
        out = done if out is None else out.unionByName(done)
        rest = ahead.join(done.select("component"), "component", "left_anti")
        rest = rest.groupBy("component", "head", "node").agg(F.min("path").alias("path")).join(seen, ["component", "node"], "left_anti")
        walk = cut(rest.select("component", "head", "node", F.concat("path", F.array("node")).alias("path")))
        seen = seen.unionByName(walk.select("component", "node"))
    return out.select("component", F.size("witness").alias("length"), "witness")


def condensed(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """src, dst, weight: edges between groups(node, group) of nodes; those within a group don't count."""
    g = groups.select("node", "group").distinct()
    return (
        edges.join(g.select(F.col("node").alias("src"), F.col("group").alias("a")), "src")
        .join(g.select(F.col("node").alias("dst"), F.col("group").alias("b")), "dst")
        .where("a <> b")
        .groupBy(F.col("a").alias("src"), F.col("b").alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def importers(edges: DataFrame, width: int = 1000) -> DataFrame:
    """node, chunk, n_importers, importers (sorted): the importers whose ids lie in one range of ``width``.

    Ids are integers, so that no array outgrows the width, however many files import one.
    """
    return edges.groupBy(F.col("dst").alias("node"), F.floor(F.col("src") / width).cast("long").alias("chunk")).agg(
        F.count_distinct("src").alias("n_importers"), F.sort_array(F.collect_set("src")).alias("importers")
    )
