"""Named JSON documents: read with a schema and a default, with comments, and as evidence of many kinds."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def without_json_comments(text: Column) -> Column:
    """JSON from JSON with comments and trailing commas; what stands in strings stays."""
    kept = F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")
    return F.regexp_replace(kept, r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', "$1")


def parsed(text: Column, schema: str) -> Column:
    """A struct, or null where the text isn't JSON of that shape."""
    return F.from_json(without_json_comments(text), schema, {"mode": "PERMISSIVE"})


def read_document(spark: SparkSession, path: str, schema: StructType | str, default: Mapping | None = None) -> DataFrame:
    """One JSON document as rows of a schema; ``default`` as the only row if there is no such file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([dict(default)] if default is not None else [], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """Puts one document in place of what is there, at once: it is written beside it first, and then renamed."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    place = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    system = place.getFileSystem(conf)
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(beside), system.makeQualified(place), overwrite)


def read_evidence(spark: SparkSession, folder: str, kinds: Mapping[str, str]) -> DataFrame:
    """kind, name, content of the JSON files of a folder; kinds: kind to a part of the file name.

    Files that fit no kind are left out; a file that isn't JSON has a null content.
    """
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_extract(F.input_file_name(), r"[^/]*$", 0)
    kind = None
    for label, part in kinds.items():
        kind = F.when(F.contains(name, F.lit(part)), label) if kind is None else kind.when(F.contains(name, F.lit(part)), label)
    return rows.select(kind.alias("kind"), name.alias("name"), F.try_parse_json("value").alias("content")).where("kind is not null")
