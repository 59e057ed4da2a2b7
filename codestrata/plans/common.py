"""Base tables that the queries share, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.operators import graph
from codestrata.session import table

#: One row a file, whatever its history.
FILE = """(SELECT file_id, min(project_key) AS project_key, min(rel_path) AS rel_path, min(lower(language)) AS language,
    max(size_bytes) AS size_bytes, max(hash) AS hash, min(indexed_at) AS indexed_at, bool_or(removed_at IS NULL) AS present
    FROM files GROUP BY file_id)"""

#: Links between two different known files, once each.
EDGE = """(SELECT DISTINCT source_file_id AS src, target_file_id AS dst FROM dependencies
    WHERE source_file_id <> target_file_id AND source_file_id IN (SELECT file_id FROM files) AND target_file_id IN (SELECT file_id FROM files))"""

NORM = r"regexp_replace(replace(rel_path, chr(92), '/'), '^(\./)+', '')"
PAYLOAD = f"""(SELECT DISTINCT project_key, {NORM} AS rel_path, payload, size_bytes FROM atlas_staging_files WHERE stage_kind = 'atlas_record')"""
EXPORT = f"""(SELECT DISTINCT project_key, rel_path, unnest(from_json(json_extract(payload, '$.exports'), '["VARCHAR"]')) AS name FROM {PAYLOAD})"""
KIND = "lower(trim(import_kind))"


def files(spark: SparkSession, folder: str) -> DataFrame:
    return by_file(table(spark, folder, "files"))


def by_file(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("file_id")
        .agg(
            F.min("project_key").alias("project_key"), F.min("rel_path").alias("rel_path"), F.min(F.lower("language")).alias("language"),
            F.max("size_bytes").alias("size_bytes"), F.max("hash").alias("hash"), F.min("indexed_at").alias("indexed_at"),
            F.bool_or(F.col("removed_at").isNull()).alias("present"),
        )
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "dependencies").select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    return graph.build_edges(links, table(spark, folder, "files").select(F.col("file_id").alias("node")))[0]


def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """The same edges, as a row for each file."""
    links = table(spark, folder, "dependencies").select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    return graph.adjacency_within(links, table(spark, folder, "files").select(F.col("file_id").alias("node")))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Staged records as they are; a repeated row is there twice."""
    rows = table(spark, folder, "atlas_staging_files").where("stage_kind = 'atlas_record'")
    return rows.select("project_key", paths.normalized(F.col("rel_path")).alias("rel_path"), "payload", "size_bytes")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Each staged record once."""
    return records(spark, folder).distinct()


def exports(spark: SparkSession, folder: str) -> DataFrame:
    """Exported names, once each; whole payloads aren't exchanged for that."""
    names = F.from_json("payload", "exports array<string>")["exports"]
    return records(spark, folder).select("project_key", "rel_path", F.explode(names).alias("name")).distinct()


def kind():
    return F.lower(F.trim("import_kind"))
