"""Source trees as tables: files of a folder, their language, text and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths

EXCLUDED = ("node_modules", ".git", "__pycache__", "dist", "build", ".venv", "target")
ROOT_SIGNS = ("package.json", "pyproject.toml", "setup.py", "go.mod", "pom.xml", "Cargo.toml")


def read_tree(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """rel_path, language, size_bytes, modified_at, content of the files below root.

    The listing alone is read until content is asked for. Spark's reader skips files of no bytes.
    """
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    rel = F.replace(rel, F.lit(base + "/"), F.lit(""))
    out = rows.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    for name in excluded:
        out = out.where(~paths.has_fragment(F.col("rel_path"), name))
    if extensions:
        out = out.where(paths.extension(F.col("rel_path")).isin(*extensions))
    return out.select("rel_path", paths.language_of(F.col("rel_path")).alias("language"), "size_bytes", "modified_at", "content")


def project_roots(tree: DataFrame) -> DataFrame:
    """root, sign: folders that hold a sign of a project."""
    return tree.where(paths.basename(F.col("rel_path")).isin(*ROOT_SIGNS)).select(paths.dirname(F.col("rel_path")).alias("root"), paths.basename(F.col("rel_path")).alias("sign"))


def owner(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files with root, the longest root that holds the path (an equi join on the folders above it)."""
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    tried = files.select("rel_path", F.posexplode(above).alias("depth", "root"))
    best = tried.join(roots.select("root").distinct(), "root").groupBy("rel_path").agg(F.max_by("root", "depth").alias("root"))
    return files.join(best, "rel_path", "left")


def texts(tree: DataFrame) -> DataFrame:
    """rel_path, language, text (null if not UTF-8), n_lines, md5, sha256."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return tree.select("rel_path", "language", text.alias("text"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")).withColumn(
        "n_lines", F.size(F.split("text", "\n"))
    )


def changed_since(tree: DataFrame, previous: DataFrame) -> DataFrame:
    """Files of the tree whose (rel_path, sha256) the previous snapshot doesn't have."""
    now = tree.withColumn("sha256", F.sha2("content", 256))
    return now.join(previous.select("rel_path", "sha256"), ["rel_path", "sha256"], "left_anti")
