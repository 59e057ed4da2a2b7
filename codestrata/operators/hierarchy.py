"""Parent-child links to full hierarchies.

Method: a weighted disjoint-set forest, merged hierarchically. Links are put in blocks by pages of ids; in
a block every node gets the top of its chain there, with the number of links to it (the weight) and the
ids between. Only the pointers of those nodes that others point to go to the next level, whose pages are
wider, until a level fits one block (MERGE_ROWS, counted before). The levels are then read backwards: one
join each gives every node its root, depth and path. How many levels there are depends on the number of
rows, not on the depth. Where a level doesn't shrink (ids without locality) and is larger than one block,
its paths are halved by joins instead (``_halved``), which is exact as well.

Cycles are found first, by the same levels: a block in which a chain comes back to itself names one head
a cycle. The link above each head is cut, which leaves a forest; the path from the head to the node that
was above it is the cycle. Descendants are summed bottom up along the same levels.

Defined results
---------------
* Links with a null end, and links from a node to itself, don't count; equal links count once.
* A child with several parents keeps the smallest; the forest needs one parent a node.
* No links: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

BLOCK_ROWS = 50_000  # links that one block combines
MERGE_ROWS = 1_000_000  # pointers that the last block combines at most; bounds a worker's memory
PAGE_IDS = 65_536  # ids to a page of the first level
WIDER = 64  # times as many at the next one
OUT_CHARS = 8_000_000  # characters of paths that a worker holds before it hands them on


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    held = [b for b in batches if len(b)]
    return pd.concat(held, ignore_index=True) if held else None


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """child, top of a block, and one row with a null top for each cycle in it; what ends in such a cycle is left out."""
    frame = _whole(batches)
    if frame is None:
        return
    up = dict(zip(frame["child"].tolist(), frame["top"].tolist()))
    top: dict[int, int | None] = {}  # None: ends in a cycle
    heads = []
    for start in up:
        trail, node, own = [], start, set()
        while node in up and node not in top and node not in own:
            own.add(node)
            trail.append(node)
            node = up[node]
        if node in own:
            heads.append(min(trail[trail.index(node):]))
            end = None
        else:
            end = top.get(node, node)
        for member in trail:
            top[member] = end
    rows = [(c, t) for c, t in top.items() if t is not None]
    yield pd.DataFrame({"child": pd.array([c for c, _ in rows] + heads, dtype="Int64"), "top": pd.array([t for _, t in rows] + [None] * len(heads), dtype="Int64")})


def _walk(frame: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
    """(row, its root, how many rows are above it in the block), each row after the one above it."""
    below: dict[int, list[int]] = {}
    child, top = frame["child"].tolist(), frame["top"].tolist()
    for row, node in enumerate(top):
        below.setdefault(node, []).append(row)
    inner = set(child)
    for root in below:
        if root in inner:
            continue
        todo = [(row, 1) for row in below[root]]
        while todo:
            row, level = todo.pop()
            yield row, root, level
            todo += [(r, level + 1) for r in below.get(child[row], ())]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """child, top, links, above of a block: chains up to the top in it. The current chain alone is held."""
    frame = _whole(batches)
    if frame is None:
        return
    child, links, above = frame["child"].tolist(), frame["links"].tolist(), frame["above"].tolist()
    chain: list[tuple[int, str]] = []
    out: list[tuple[int, int, int, str]] = []
    size = 0
    for row, root, level in _walk(frame):
        del chain[level - 1:]
        n, way = chain[-1] if chain else (0, "")
        n, way = n + links[row], f"{way}/{above[row]}" if way else above[row]
        chain.append((n, way))
        out.append((child[row], root, n, way))
        size += len(way)
        if size > OUT_CHARS:
            yield pd.DataFrame(out, columns=["child", "top", "links", "above"])
            out, size = [], 0
    yield pd.DataFrame(out, columns=["child", "top", "links", "above"])


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, below of the children of a block: the weights of all below them there, and what hangs on those from outside."""
    frame = _whole(batches)
    if frame is None:
        return
    child, top, weight, hung = (frame[c].tolist() for c in ("child", "top", "weight", "hung"))
    total = {c: h for c, h in zip(child, hung)}
    for row in reversed([row for row, _, _ in _walk(frame)]):
        if top[row] in total:
            total[top[row]] += total[child[row]] + weight[row]
    yield pd.DataFrame({"node": child, "below": [total[c] for c in child]})


def _blocks(pointers: DataFrame, rows: int, page: int) -> DataFrame:
    """The pointers in blocks, those of a page together; a single one if they fit the last block."""
    if page > PAGE_IDS and rows <= MERGE_ROWS:
        return pointers.repartition(1)
    return pointers.repartition(max(1, -(-rows // BLOCK_ROWS)), F.floor(F.col("child") / page))


def _tops(table: DataFrame) -> DataFrame:
    """The pointers of those nodes that others point to."""
    return table.join(table.select(F.col("top").alias("child")).distinct(), "child", "left_semi")


def cycle_heads(pointers: DataFrame, rows: int, page: int = PAGE_IDS) -> DataFrame:
    """node: one node of each cycle among pointers (child, top)."""
    combined = cut(_blocks(pointers, rows, page).mapInPandas(_heads, "child long, top long"))
    heads = combined.where("top is null").select(F.col("child").alias("node"))
    rest = cut(_tops(combined.where("top is not null")))
    left = rest.count()
    if not left:
        return heads
    if left > MERGE_ROWS and left * 2 > rows:
        return heads.unionByName(_halved_heads(rest))
    return heads.unionByName(cycle_heads(rest, left, page * WIDER))


def _halved_heads(tops: DataFrame) -> DataFrame:
    """cycle_heads by joins: after more steps than rows are left, whatever is pointed at stands on a cycle."""
    jumps, steps = tops.select(F.col("child").alias("node"), F.col("top").alias("to")), 1
    while True:
        ahead = jumps.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumps = cut(jumps.join(ahead, "to").select("node", F.col("next").alias("to")))
        steps *= 2
        if jumps.count() <= steps:
            break
    ring = cut(tops.join(jumps.select(F.col("to").alias("child")).distinct(), "child", "left_semi"))
    lows = ring.select(F.col("child").alias("node"), F.col("top").alias("to"), F.col("child").alias("low"))
    size, steps = ring.count(), 1
    while steps < size:
        ahead = lows.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("low").alias("low2"))
        lows = cut(lows.join(ahead, "to").select("node", F.col("next").alias("to"), F.least("low", "low2").alias("low")))
        steps *= 2
    return lows.select(F.col("low").alias("node")).distinct()


def forest(pointers: DataFrame, rows: int, page: int = PAGE_IDS) -> tuple[DataFrame, DataFrame]:
    """(child, top, links, above with top at the root) and (node, below) of pointers without cycles.

    pointers: child, top, links, above (the ids from top down to the one above child), weight. below: the
    weights of all that is below a node.
    """
    pointers = _blocks(pointers, rows, page)
    table = cut(pointers.mapInPandas(_forest, "child long, top long, links long, above string"))
    weights = pointers.select("child", "weight")
    # What hangs on the tops of blocks; a top's own weight counts in its own block.
    hung = cut(table.join(weights, "child").groupBy(F.col("top").alias("node")).agg(F.sum("weight").alias("hung")))
    upper = cut(_tops(table).join(hung.select(F.col("node").alias("child"), F.col("hung").alias("weight")), "child"))
    left = upper.count()
    if left:
        if left > MERGE_ROWS and left * 2 > rows:
            over, below = _halved(upper)
        else:
            over, below = forest(upper, left, page * WIDER)
        over = over.select(F.col("child").alias("top"), F.col("top").alias("root"), F.col("links").alias("links2"), F.col("above").alias("above2"))
        table = table.join(over, "top", "left").select(
            "child", F.coalesce("root", "top").alias("top"), (F.col("links") + F.coalesce("links2", F.lit(0))).alias("links"),
            F.concat_ws("/", "above2", "above").alias("above"),
        )
        hung = hung.join(below, "node", "left").select("node", (F.col("hung") + F.coalesce("below", F.lit(0))).alias("hung"))
        hung = cut(hung)
    hanging = pointers.select("child", "top", "weight").join(hung.withColumnRenamed("node", "child"), "child", "left").fillna(0, ["hung"])
    inner = _blocks(hanging, rows, page).mapInPandas(_sums, "node long, below long")
    outer = hung.join(pointers.select(F.col("child").alias("node")), "node", "left_anti").select("node", F.col("hung").alias("below"))
    return table, inner.unionByName(outer)


def _halved(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """forest by joins: in round k each pointer skips 2^k nodes, and each node adds what is 2^k nodes below."""
    roots = pointers.select(F.col("top").alias("node")).distinct().join(pointers.select(F.col("child").alias("node")), "node", "left_anti")
    sums = cut(pointers.select(F.col("child").alias("node"), F.col("weight").alias("low"), F.lit(0).cast("long").alias("below")).unionByName(
        roots.select("node", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    ))
    lift = cut(pointers.select("child", "top", "links", "above"))
    exact = lift.select("child", "top")  # 2^k nodes up, where there are so many
    while not exact.isEmpty():
        # low + below: the weights of a node and of those less than 2^k below it.
        more = exact.join(sums.withColumnRenamed("node", "child"), "child").groupBy(F.col("top").alias("node")).agg(F.sum(F.col("low") + F.col("below")).alias("more"))
        sums = cut(sums.join(more, "node", "left").select("node", "low", (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))
        higher = lift.select(F.col("child").alias("top"), F.col("top").alias("root"), F.col("links").alias("links2"), F.col("above").alias("above2"))
        lift = cut(lift.join(higher, "top", "left").select(
            "child", F.coalesce("root", "top").alias("top"), (F.col("links") + F.coalesce("links2", F.lit(0))).alias("links"), F.concat_ws("/", "above2", "above").alias("above")
        ))
        exact = cut(exact.join(exact.select(F.col("child").alias("top"), F.col("top").alias("next")), "top").select("child", F.col("next").alias("top")))
    return lift, sums.select("node", "below")


def hierarchies(links: DataFrame) -> DataFrame:
    """node, root, depth, path, n_descendants, status of every node in a link.

    links: parent long, child long. status: ``tree``, ``on_cycle`` or ``below_cycle``. Within a
    tree root and path start at its top. With a cycle, root is the smallest node on it, and path
    and depth start at the nearest node on it.
    """
    links = (
        links.where(F.col("parent").isNotNull() & F.col("child").isNotNull() & (F.col("parent") != F.col("child")))
        .groupBy("child")
        .agg(F.min("parent").alias("top"))
    )
    links = cut(links)
    rows = links.count()
    heads = cut(cycle_heads(links, rows))
    over = links.join(heads.withColumnRenamed("node", "child"), "child", "left_semi")  # cut, so that a forest is left
    pointers = cut(links.join(heads.withColumnRenamed("node", "child"), "child", "left_anti").select(
        "child", "top", F.lit(1).cast("long").alias("links"), F.col("top").cast("string").alias("above"), F.lit(1).cast("long").alias("weight")
    ))
    table, below = forest(pointers, rows)
    placed = cut(table.select(F.col("child").alias("node"), F.col("top").alias("root"), F.col("links").alias("depth"), F.concat_ws("/", "above", F.col("child").cast("string")).alias("path")))
    nodes = links.select(F.explode(F.array("top", "child")).alias("node")).distinct()
    starts = nodes.join(placed, "node", "left_anti").select(
        "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.col("node").cast("string").alias("path")
    )
    # The way from a head down to the node that was above it is its cycle.
    ring = F.split("path", "/")
    rings = placed.join(over.select(F.col("top").alias("node"), F.col("child").alias("head")), "node").where("root = head").select(
        F.col("head").alias("root"), ring.alias("ring"), F.array_min(F.transform(ring, lambda x: x.cast("long"))).alias("low")
    )
    sizes = placed.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("n_all"))
    rings = cut(rings.join(sizes, "root"))
    everyone = placed.unionByName(starts).join(rings, "root", "left").join(below, "node", "left")
    ids = F.split("path", "/")
    shared = F.size(F.array_intersect(ids, "ring"))  # the first ids of the way are those on the cycle
    depth = F.when(F.col("low").isNull(), F.col("depth")).otherwise((F.size(ids) - shared).cast("long"))
    return everyone.select(
        "node",
        F.coalesce("low", "root").alias("root"),
        depth.alias("depth"),
        F.when(F.col("low").isNull(), F.col("path")).otherwise(F.array_join(F.slice(ids, shared, F.size(ids)), "/")).alias("path"),
        F.when(F.col("low").isNotNull() & (depth == 0), F.col("n_all") - 1).otherwise(F.coalesce("below", F.lit(0))).alias("n_descendants"),
        F.when(F.col("low").isNull(), "tree").when(depth == 0, "on_cycle").otherwise("below_cycle").alias("status"),
    )


def reexport_links(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """The links of re-export-all rows between two different files that both are known."""
    known = files.select(F.col("file_id").alias("id")).where("id is not null").distinct()
    return (
        dependencies.where(F.lower(F.trim("import_kind")) == "reexport_all")
        .select(F.col("source_file_id").alias("parent"), F.col("target_file_id").alias("child"))
        .where("parent <> child")
        .distinct()
        .join(known.withColumnRenamed("id", "parent"), "parent", "left_semi")
        .join(known.withColumnRenamed("id", "child"), "child", "left_semi")
    )
