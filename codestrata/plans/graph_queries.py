"""Queries on the import graph of files and on the graph of their modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.scores import capped
from codestrata.operators import graph, relational
from codestrata.plans.common import EDGE, FILE, KIND, edges, files, kind
from codestrata.session import cut, table

DEPTH = 3
CYCLE = 5
MODULE = """CASE WHEN position('/' IN rel_path) = 0 THEN project_key || '::.' ELSE project_key || '::' || split_part(rel_path, '/', 1) END"""
MODULE_EDGE = f"""(SELECT a.m AS src, b.m AS dst, count(*) AS weight FROM {EDGE} e
    JOIN (SELECT file_id, {MODULE} AS m FROM {FILE}) a ON a.file_id = e.src
    JOIN (SELECT file_id, {MODULE} AS m FROM {FILE}) b ON b.file_id = e.dst WHERE a.m <> b.m GROUP BY 1, 2)"""
HUB = f"(SELECT dst AS node FROM {EDGE} GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def modules(spark: SparkSession, folder: str) -> DataFrame:
    """node, group: the module (project and first directory) of each file."""
    name = F.concat_ws("::", "project_key", paths.directory(F.col("rel_path"), 1))
    return files(spark, folder).select(F.col("file_id").alias("node"), name.alias("group"))


def module_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.condensed(edges(spark, folder), modules(spark, folder))


def hub(spark: SparkSession, folder: str) -> DataFrame:
    """The file that most files import."""
    counts = edges(spark, folder).groupBy(F.col("dst").alias("node")).count()
    return counts.orderBy(F.desc("count"), "node").limit(1).select("node")


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return edges(spark, folder)


def graph_self_edges(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "dependencies").select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    known = table(spark, folder, "files").select(F.col("file_id").alias("node"))
    return graph.build_edges(links, known)[1].select(F.col("src").alias("node"))


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(edges(spark, folder))


def graph_importers(spark: SparkSession, folder: str) -> DataFrame:
    return graph.importers(edges(spark, folder)).select("node", "chunk", "n_importers", F.array_join(F.transform("importers", lambda x: x.cast("string")), ",").alias("importers"))


def graph_cross_project(spark: SparkSession, folder: str) -> DataFrame:
    """Links that leave a project, by pair of projects; links within one, and to projects not listed, are counted apart."""
    f = files(spark, folder).select("file_id", "project_key")
    listed = table(spark, folder, "projects").select("project_key", F.lit(True).alias("listed"))
    e = (
        edges(spark, folder)
        .join(f.select(F.col("file_id").alias("src"), F.col("project_key").alias("from_project")), "src")
        .join(f.select(F.col("file_id").alias("dst"), F.col("project_key").alias("to_project")), "dst")
        .join(listed.withColumnRenamed("project_key", "to_project"), "to_project", "left")
    )
    state = F.when(F.col("listed").isNull(), "inactive").when(F.col("from_project") == F.col("to_project"), "internal").otherwise("cross")
    return e.groupBy("from_project", "to_project", state.alias("state")).agg(F.count(F.lit(1)).alias("n_edges"))


def graph_impact_of_hub(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a change to the most imported file reaches, by depth."""
    return graph.reach(graph.reverse(edges(spark, folder)), hub(spark, folder), DEPTH).where("depth > 0")


def graph_impact_everything(spark: SparkSession, folder: str) -> DataFrame:
    return graph.reach(graph.reverse(edges(spark, folder)), hub(spark, folder)).where("depth > 0").select("node")


def graph_upstream_trace(spark: SparkSession, folder: str) -> DataFrame:
    """What the most imported file itself depends on, to a depth."""
    return graph.reach(edges(spark, folder), hub(spark, folder), DEPTH)


def graph_bounded_closure(spark: SparkSession, folder: str) -> DataFrame:
    return graph.bounded_closure(edges(spark, folder), hub(spark, folder), 50, DEPTH)


def graph_reexport_fixpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Files that count as imported once that is carried along re-exports."""
    d = table(spark, folder, "dependencies")
    known = table(spark, folder, "files").select(F.col("file_id").alias("node"))
    links = d.where(kind().isin("reexport", "reexport_all")).select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    proxies = graph.build_edges(links, known)[0]
    imported = d.where(kind().isin("named", "namespace")).select(F.col("target_file_id").alias("node")).distinct().join(known.distinct(), "node", "left_semi")
    return graph.propagate(imported, proxies)


def graph_module_edges(spark: SparkSession, folder: str) -> DataFrame:
    return module_edges(spark, folder)


def graph_module_top_edges(spark: SparkSession, folder: str) -> DataFrame:
    return relational.top_k_per_group(module_edges(spark, folder), ["src"], [F.desc("weight"), F.col("dst")], 3)


def graph_module_dependents(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and all dependents of each module; the latter include the direct ones."""
    e = cut(graph.reverse(module_edges(spark, folder)))
    direct = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_direct"))
    return graph.reach_counts(e, direct.select("node")).join(direct, "node").select("node", "n_direct", F.col("n").alias("n_transitive"))


def blast_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each module: direct + half of all dependents + a capped bonus for its size."""
    counts = graph_module_dependents(spark, folder)
    sizes = modules(spark, folder).groupBy(F.col("group").alias("node")).agg(F.count(F.lit(1)).alias("n_files"))
    score = F.col("n_direct") * 1.0 + F.col("n_transitive") * 0.5 + capped(F.col("n_files"), 0.25, 10.0)
    return sizes.join(counts, "node", "left").fillna(0).select("node", "n_files", "n_direct", "n_transitive", score.alias("score"))


def blast_radius_top(spark: SparkSession, folder: str) -> DataFrame:
    return blast_radius(spark, folder).orderBy(F.desc("score"), "node").limit(50)


def graph_module_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(module_edges(spark, folder).select("src", "dst"))


def graph_file_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(edges(spark, folder))


def graph_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Cycles of up to five files, so that every class occurs."""
    found = graph.cycles(edges(spark, folder), CYCLE)
    chain = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return found.select(chain.alias("chain"), "length", graph.cycle_class(F.col("length")).alias("class"), graph.undirected_key(F.col("path")).alias("undirected_key"))


def graph_cycles_by_project(spark: SparkSession, folder: str) -> DataFrame:
    """How many cycles of up to five files each project takes part in."""
    f = files(spark, folder).select(F.col("file_id").alias("node"), "project_key")
    members = graph.cycles(edges(spark, folder), CYCLE).select("path", F.explode("path").alias("node"))
    return members.join(f, "node").groupBy("project_key").agg(F.count_distinct("path").alias("n_cycles"))


def graph_witness(spark: SparkSession, folder: str) -> DataFrame:
    """A shortest cycle through the smallest module of each component of modules."""
    e = module_edges(spark, folder).select("src", "dst")
    found = graph.shortest_witness(e, graph.components(e))
    return found.select("component", "length", F.array_join("witness", " > ").alias("witness"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, graph_self_edges, graph_degrees, graph_importers, graph_cross_project, graph_impact_of_hub, graph_impact_everything,
        graph_upstream_trace, graph_bounded_closure, graph_reexport_fixpoint, graph_module_edges, graph_module_top_edges,
        graph_module_dependents, blast_radius, blast_radius_top, graph_module_components, graph_file_components, graph_cycles,
        graph_cycles_by_project, graph_witness,
    )
}

_REACH = f"""WITH RECURSIVE edge AS {EDGE}, found(node, depth) AS (
    SELECT node, 0 FROM {HUB} UNION SELECT {{next}}, depth + 1 FROM found JOIN edge ON {{at}} = node WHERE depth < {DEPTH})"""
_BACK = _REACH.format(next="src", at="dst")
_CLOSURE = f"""WITH RECURSIVE edge AS {MODULE_EDGE}, pair(origin, node) AS (
    SELECT dst, src FROM edge UNION SELECT pair.origin, edge.src FROM pair JOIN edge ON edge.dst = pair.node)"""
_DEPENDENTS = f"""{_CLOSURE}, dependents AS (SELECT d.origin AS node, (SELECT count(*) FROM edge WHERE edge.dst = d.origin) AS n_direct, count(*) AS n_transitive
    FROM pair d WHERE d.origin <> d.node GROUP BY d.origin)"""
_BLAST = f"""{_DEPENDENTS} SELECT s.m AS node, s.n AS n_files, coalesce(n_direct, 0) AS n_direct, coalesce(n_transitive, 0) AS n_transitive,
    coalesce(n_direct, 0) * 1.0::DOUBLE + coalesce(n_transitive, 0) * 0.5::DOUBLE + least(s.n * 0.25::DOUBLE, 10.0::DOUBLE) AS score
    FROM (SELECT {MODULE} AS m, count(*) AS n FROM {FILE} GROUP BY 1) s LEFT JOIN dependents d ON d.node = s.m"""
_CYCLES = f"""WITH RECURSIVE edge AS {EDGE}, walk(path) AS (SELECT [src, dst] FROM edge WHERE src < dst
    UNION ALL SELECT list_append(path, dst) FROM walk JOIN edge ON src = path[-1] WHERE len(path) < {CYCLE} AND dst > path[1] AND NOT list_contains(path, dst)),
    found AS (SELECT path FROM walk JOIN edge ON src = path[-1] AND dst = path[1])"""
ORACLE = {
    "graph_edges": f"SELECT * FROM {EDGE}",
    "graph_self_edges": "SELECT DISTINCT source_file_id AS node FROM dependencies WHERE source_file_id = target_file_id AND source_file_id IN (SELECT file_id FROM files)",
    "graph_degrees": f"SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {EDGE} UNION ALL SELECT dst, 0, 1 FROM {EDGE}) GROUP BY node",
    "graph_importers": f"SELECT dst AS node, (src // 1000)::BIGINT AS chunk, count(*) AS n_importers, array_to_string(list_sort(list(src)), ',') AS importers FROM {EDGE} GROUP BY 1, 2",
    "graph_cross_project": f"""SELECT a.project_key AS from_project, b.project_key AS to_project,
        CASE WHEN b.project_key NOT IN (SELECT project_key FROM projects) THEN 'inactive' WHEN a.project_key = b.project_key THEN 'internal' ELSE 'cross' END AS state,
        count(*) AS n_edges FROM {EDGE} e JOIN {FILE} a ON a.file_id = e.src JOIN {FILE} b ON b.file_id = e.dst GROUP BY 1, 2, 3""",
    "graph_impact_of_hub": f"{_BACK} SELECT node, min(depth) AS depth FROM found GROUP BY node HAVING min(depth) > 0",
    "graph_impact_everything": f"""WITH RECURSIVE edge AS {EDGE}, found(node) AS (SELECT node FROM {HUB} UNION SELECT src FROM found JOIN edge ON dst = node)
        SELECT node FROM found WHERE node NOT IN (SELECT node FROM {HUB})""",
    "graph_upstream_trace": f"{_REACH.format(next='dst', at='src')} SELECT node, min(depth) AS depth FROM found GROUP BY node",
    "graph_bounded_closure": f"""{_REACH.format(next='dst', at='src')} SELECT node, depth, row_number() OVER (ORDER BY depth, node) <= 50 AS taken, count(*) OVER () > 50 AS truncated
        FROM (SELECT node, min(depth) AS depth FROM found GROUP BY node)""",
    "graph_reexport_fixpoint": f"""WITH RECURSIVE proxy AS (SELECT DISTINCT source_file_id AS src, target_file_id AS dst FROM dependencies WHERE {KIND} IN ('reexport', 'reexport_all')
            AND source_file_id <> target_file_id AND source_file_id IN (SELECT file_id FROM files) AND target_file_id IN (SELECT file_id FROM files)),
        found(node) AS (SELECT DISTINCT target_file_id FROM dependencies WHERE {KIND} IN ('named', 'namespace') AND target_file_id IN (SELECT file_id FROM files)
            UNION SELECT dst FROM found JOIN proxy ON src = node) SELECT node FROM found""",
    "graph_module_edges": f"SELECT * FROM {MODULE_EDGE}",
    "graph_module_top_edges": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)::INTEGER AS rank FROM {MODULE_EDGE}) WHERE rank <= 3",
    "graph_module_dependents": f"{_DEPENDENTS} SELECT * FROM dependents",
    "blast_radius": _BLAST,
    "blast_radius_top": f"{_BLAST} ORDER BY score DESC, node LIMIT 50",
    "graph_module_components": f"""{_CLOSURE} SELECT a.origin AS node, greatest(a.origin, max(a.node)) AS component FROM pair a
        JOIN pair b ON b.origin = a.node AND b.node = a.origin WHERE a.origin <> a.node GROUP BY a.origin""",
    "graph_witness": f"""{_CLOSURE}, comp AS (SELECT a.origin AS node, greatest(a.origin, max(a.node)) AS component FROM pair a JOIN pair b ON b.origin = a.node AND b.node = a.origin WHERE a.origin <> a.node GROUP BY a.origin),
        head AS (SELECT component, min(node) AS head FROM comp GROUP BY 1), inner_edge AS (SELECT e.src, e.dst FROM edge e JOIN comp a ON a.node = e.src JOIN comp b ON b.node = e.dst AND b.component = a.component),
        two AS (SELECT h.component, [h.head, a.dst] AS way FROM head h JOIN inner_edge a ON a.src = h.head JOIN inner_edge b ON b.src = a.dst AND b.dst = h.head),
        three AS (SELECT h.component, [h.head, a.dst, b.dst] AS way FROM head h JOIN inner_edge a ON a.src = h.head JOIN inner_edge b ON b.src = a.dst JOIN inner_edge c ON c.src = b.dst AND c.dst = h.head WHERE b.dst <> h.head),
        four AS (SELECT h.component, [h.head, a.dst, b.dst, c.dst] AS way FROM head h JOIN inner_edge a ON a.src = h.head JOIN inner_edge b ON b.src = a.dst JOIN inner_edge c ON c.src = b.dst JOIN inner_edge d ON d.src = c.dst AND d.dst = h.head WHERE b.dst <> h.head AND c.dst <> h.head)
        SELECT component, min(len(way))::INTEGER AS length, array_to_string(arg_min(way, (len(way), way)), ' > ') AS witness FROM (SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four) GROUP BY 1""",
    "graph_file_components": f"""WITH RECURSIVE edge AS {EDGE}, pair(origin, node) AS (SELECT src, dst FROM edge UNION SELECT pair.origin, edge.dst FROM pair JOIN edge ON edge.src = pair.node)
        SELECT a.origin AS node, max(a.node) AS component FROM pair a JOIN pair b ON b.origin = a.node AND b.node = a.origin GROUP BY a.origin HAVING count(*) > 1""",
    "graph_cycles": f"""{_CYCLES} SELECT array_to_string(path, '>') AS chain, len(path)::INTEGER AS length, CASE WHEN len(path) = 2 THEN 'mutual' WHEN len(path) > 4 THEN 'long' ELSE 'other' END AS class,
        array_to_string(list_sort(path), '>') AS undirected_key FROM found""",
    "graph_cycles_by_project": f"""{_CYCLES} SELECT project_key, count(DISTINCT path) AS n_cycles FROM (SELECT path, unnest(path) AS node FROM found) m
        JOIN {FILE} f ON f.file_id = m.node GROUP BY project_key""",
}
