"""Stores: named JSON documents in parts, upserts, scoped rebuilds, SQLite and logs."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.relational import upsert
from codestrata.sources.documents import write_document


def canonical(row: Column | str) -> Column:
    """A struct or map as JSON with its keys in order, null fields left out; equal values have equal digests."""
    return F.to_json(F.parse_json(F.to_json(row, {"ignoreNullFields": "true"})))


def in_parts(documents: DataFrame, size: int) -> DataFrame:
    """name, part_index, payload, part_sha256, sha256 of documents(name, payload string) cut every ``size`` characters."""
    n = F.greatest(F.ceil(F.length("payload") / size), F.lit(1)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("part_index"), F.substring("payload", k * size + 1, F.lit(size)).alias("payload")))
    rows = documents.select("name", F.sha2("payload", 256).alias("sha256"), F.explode(cuts).alias("p"))
    return rows.select("name", "p.part_index", "p.payload", F.sha2("p.payload", 256).alias("part_sha256"), "sha256")


def from_parts(parts: DataFrame) -> DataFrame:
    """name, payload, intact of the parts joined in order; intact says whether the digest agrees."""
    whole = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("part_index", "payload"))).alias("p"), F.first("sha256").alias("sha256"))
    text = F.array_join(F.transform("p", lambda x: x["payload"]), "")
    return whole.select("name", text.alias("payload"), (F.sha2(text, 256) == F.col("sha256")).alias("intact"))


def upsert_parquet(spark: SparkSession, folder: str, version: int, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Writes version ``version`` of a table as the one before with the new rows put in; returns it."""
    target = f"{folder}/version={version}"
    rows = new if version == 0 else upsert(spark.read.parquet(f"{folder}/version={version - 1}"), new, keys)
    rows.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def rebuild(df: DataFrame, folder: str, version: int) -> DataFrame:
    """Writes the whole table as a version of its own, then points to it; readers see the old one until then."""
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")
    write_document(df.sparkSession, f"{folder}/current.json", f'{{"version":{int(version)}}}')
    return current(df.sparkSession, folder)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The version that ``rebuild`` wrote last."""
    version = spark.read.schema("version long").json(f"{folder}/current.json").first()["version"]
    return spark.read.parquet(f"{folder}/version={version}")


def rebuild_scopes(df: DataFrame, folder: str, scope: str) -> None:
    """Replaces the partitions of the scopes that df holds, and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(folder)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, slices: int = 8) -> DataFrame:
    """A table of an SQLite file that every executor can see, read in slices of its row ids."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as connection:
                for k in batch["id"]:
                    yield from pd.read_sql_query(f'SELECT * FROM "{table}" WHERE rowid % {slices} = {int(k)}', connection, chunksize=10_000)

    return spark.range(slices).repartition(slices, "id").mapInPandas(rows, schema)


def parse_log(lines: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """metric, value (double), line of log lines(value); a pattern's first group is the number."""
    hits = F.array(*[F.struct(F.lit(name).alias("metric"), F.regexp_extract("value", pattern, 1).alias("found")) for name, pattern in patterns.items()])
    rows = lines.select(F.col("value").alias("line"), F.explode(hits).alias("h")).where("h.found <> ''")
    return rows.select("h.metric", F.col("h.found").try_cast("double").alias("value"), "line")
