"""Queries of the general problems, over the whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import drift, hierarchy, orphans
from codestrata.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphans.dependency_orphans(table(spark, folder, "dependencies"), table(spark, folder, "files"))
    return found.select(F.col("ref_id").alias("dep_id"), "endpoint", "reason")


def p1_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = orphans.dependency_orphans(table(spark, folder, "dependencies"), table(spark, folder, "files"))
    return orphans.orphan_counts(found, "dependencies")


def _maps(spark: SparkSession, folder: str) -> DataFrame:
    return drift.payload_maps(table(spark, folder, "state_payloads"), table(spark, folder, "state_payload_parts"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(_maps(spark, folder))


def p3_path_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return drift.path_statistics(_maps(spark, folder))


def p3_typed_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.typed_table(_maps(spark, folder))


def p3_wide_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row a payload: the paths that most names have, a typed column each, a map of all others, and how many of its values didn't cast."""
    maps = drift.cut(_maps(spark, folder))
    kinds = drift.column_types(maps)
    held = maps.select("name", F.explode("fields").alias("f")).where("f.kind is not null and f.kind <> 'object'").select("name", "f.path").distinct()
    top = held.groupBy("path").agg(F.count(F.lit(1)).alias("n")).join(kinds.where("column_kind <> 'object'"), "path").orderBy(F.desc("n"), "path").limit(WIDTH).collect()
    return drift.whole_table(maps, {r["path"]: r["column_kind"] for r in top})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    links = hierarchy.reexport_links(table(spark, folder, "dependencies"), table(spark, folder, "files"))
    return hierarchy.hierarchies(links).select(
        F.col("node").alias("file_id"),
        F.col("root").alias("root_file_id"),
        "depth",
        F.col("path").alias("full_path"),
        "n_descendants",
        "status",
    )


WIDTH = 12  # columns of the wide table; all other paths are in its map

QUERIES = {
    "p1_found": p1_found,
    "p1_orphan_counts": p1_orphan_counts,
    "p3_found": p3_found,
    "p3_path_statistics": p3_path_statistics,
    "p3_typed_table": p3_typed_table,
    "p3_wide_table": p3_wide_table,
    "p4_found": p4_found,
}

_ORPHANS = """
    SELECT DISTINCT r.dep_id, r.endpoint, r.file_id, r.recorded_at,
        CASE WHEN f.n IS NULL THEN 'missing' WHEN f.first_at <= r.recorded_at THEN 'deleted' ELSE 'late' END AS reason
    FROM (SELECT dep_id, 'source' AS endpoint, source_file_id AS file_id, recorded_at FROM dependencies
          UNION ALL SELECT dep_id, 'target', target_file_id, recorded_at FROM dependencies) r
    LEFT JOIN (SELECT file_id, count(*) AS n, min(indexed_at) AS first_at FROM files GROUP BY file_id) f ON f.file_id = r.file_id
    WHERE r.file_id IS NOT NULL AND r.recorded_at IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM files g WHERE g.file_id = r.file_id AND g.indexed_at <= r.recorded_at
            AND (g.removed_at IS NULL OR g.removed_at > r.recorded_at))
"""

# Every file has at most one parent, so that one climb along the parents meets each ancestor once.
_CLIMB = """
    WITH RECURSIVE link AS (
        SELECT target_file_id AS child, min(source_file_id) AS parent FROM dependencies
        WHERE lower(trim(import_kind)) = 'reexport_all' AND source_file_id <> target_file_id
            AND source_file_id IN (SELECT file_id FROM files) AND target_file_id IN (SELECT file_id FROM files)
        GROUP BY 1),
    node AS (SELECT child AS id FROM link UNION SELECT parent FROM link),
    up(id, pos, links, path, turned) AS (
        SELECT id, id, 0, [id], false FROM node
        UNION ALL
        SELECT u.id, l.parent, u.links + 1, list_prepend(l.parent, u.path), list_contains(u.path, l.parent)
        FROM up u JOIN link l ON l.child = u.pos WHERE NOT u.turned),
    ended AS (SELECT id, arg_max(pos, links) AS top, max(links) AS links, arg_max(path, links) AS path, bool_or(turned) AS turned
              FROM up GROUP BY id),
    ring AS (SELECT id, list_min(path) AS low FROM ended WHERE turned AND top = id),
    below AS (SELECT pos AS id, count(DISTINCT id) - 1 AS n FROM up GROUP BY pos)
"""

_FIELDS = """
    WITH parts AS (SELECT name, generation_id, count(*) AS n, list_reduce(list(payload ORDER BY part_index), lambda a, b: a || b) AS whole
        FROM (SELECT DISTINCT name, generation_id, part_index, payload FROM state_payload_parts) GROUP BY 1, 2),
    content AS (SELECT r.name, r.generation_id, r.moment, CASE WHEN r.mode <> 'partitioned_json_v1' THEN r.payload WHEN p.n = r.part_count THEN decode(p.whole) END AS doc
        FROM (SELECT DISTINCT name, generation_id, replace(replace(updated_at, 'T', ' '), 'Z', '')::TIMESTAMP AS moment, payload, part_count, coalesce(storage_mode, 'inline_json') AS mode FROM state_payloads) r
        LEFT JOIN parts p ON p.name = r.name AND p.generation_id = r.generation_id),
    plain AS (SELECT name, generation_id, moment, CASE WHEN json_type(doc) = 'VARCHAR' THEN json_extract_string(doc, '$') ELSE doc END AS doc FROM content WHERE json_valid(doc)),
    seq AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY moment, generation_id) AS seq, count(*) OVER (PARTITION BY name) AS last_seq FROM plain WHERE json_type(doc) = 'OBJECT'),
    field AS (SELECT s.name, s.generation_id, s.moment, s.seq, s.last_seq, substr(t.fullkey, 3) AS path,
        CASE t.type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind,
        CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN (t.value::DOUBLE)::VARCHAR WHEN t.type <> 'NULL' THEN t.value::VARCHAR END AS value,
        t.type = 'OBJECT' AND t.value::VARCHAR <> '{}' AS holder
        FROM seq s, json_tree(s.doc) t WHERE t.fullkey <> '$' AND t.fullkey NOT LIKE '%[%')
"""
_CHANGES = f"""{_FIELDS},
    step AS (SELECT *, lag(seq) OVER w AS before, lead(seq) OVER w AS after, lag(holder) OVER w AS held, CASE WHEN lag(seq) OVER w IS NULL OR lag(seq) OVER w < seq - 1 THEN seq END AS start FROM field WINDOW w AS (PARTITION BY name, path ORDER BY seq)),
    run AS (SELECT *, max(start) OVER (PARTITION BY name, path ORDER BY seq) AS run FROM step),
    known AS (SELECT *, last_value(CASE WHEN kind IS NOT NULL THEN kind END IGNORE NULLS) OVER (PARTITION BY name, path, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM run),
    retyped AS (SELECT name, seq, path, holder OR coalesce(held, false) AS shell FROM known WHERE kind <> known),
    moved AS (SELECT name, seq, 'added' AS event, path, coalesce(value, chr(1) || path) AS value FROM known WHERE start IS NOT NULL AND seq > 1 AND NOT holder
        UNION ALL SELECT name, seq + 1, 'removed', path, coalesce(value, chr(1) || path) FROM known WHERE (after IS NULL OR after > seq + 1) AND seq < last_seq AND NOT holder),
    own AS (SELECT *, row_number() OVER (PARTITION BY name, seq, value, event ORDER BY path) AS nth FROM moved m
        WHERE NOT EXISTS (SELECT 1 FROM retyped r WHERE r.name = m.name AND r.seq = m.seq AND r.shell AND starts_with(m.path, r.path || '.'))),
    pair AS (SELECT name, seq, max(path) FILTER (event = 'removed') AS old, max(path) FILTER (event = 'added') AS new FROM own GROUP BY name, seq, value, nth),
    change AS (SELECT name, seq, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'renamed' END AS change_kind, coalesce(old, '') AS old_field, coalesce(new, '') AS new_field FROM pair
        UNION ALL SELECT name, seq, 'retyped', path, path FROM retyped)
    SELECT c.name, s.generation_id, change_kind, old_field, new_field FROM change c JOIN seq s ON s.name = c.name AND s.seq = c.seq
"""

ORACLE = {
    "p1_found": f"SELECT dep_id, endpoint, reason FROM ({_ORPHANS})",
    "p1_orphan_counts": f"""
        SELECT 'dependencies' AS table_name, endpoint, strftime(recorded_at, '%Y-%m') AS period, reason,
            count(*) AS n_references, count(DISTINCT file_id) AS n_keys
        FROM ({_ORPHANS}) GROUP BY endpoint, period, reason""",
    "p3_found": _CHANGES,
    "p3_path_statistics": f"{_FIELDS} SELECT name, path, kind, count(*) AS n_payloads, min(moment) AS first_at, max(moment) AS last_at FROM field GROUP BY 1, 2, 3",
    "p4_found": f"""{_CLIMB}
        SELECT e.id AS file_id,
            coalesce(own.low, near.low, e.top) AS root_file_id,
            CASE WHEN own.id IS NOT NULL THEN 0 WHEN e.turned THEN near.links ELSE e.links END::BIGINT AS depth,
            array_to_string(CASE WHEN own.id IS NOT NULL THEN [e.id] WHEN e.turned THEN near.path ELSE e.path END, '/') AS full_path,
            b.n AS n_descendants,
            CASE WHEN own.id IS NOT NULL THEN 'on_cycle' WHEN e.turned THEN 'below_cycle' ELSE 'tree' END AS status
        FROM ended e JOIN below b ON b.id = e.id LEFT JOIN ring own ON own.id = e.id
        LEFT JOIN (SELECT u.id, arg_min(u.path, u.links) AS path, min(u.links) AS links, arg_min(r.low, u.links) AS low
                   FROM up u JOIN ring r ON r.id = u.pos GROUP BY u.id) near ON near.id = e.id""",
}
