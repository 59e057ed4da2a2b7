"""Schemas that drift between payloads: one table of all of them, and every change.

Method: each payload becomes a map of paths to raw types and values; statistics by path and type
give the column types, and which paths of a name drift at all; typed columns are projected with a report
of failed casts. Only the fields of drifting paths are put in sequence, where windows over stretches of
BLOCK_SEQ payloads of a (name, path) find where it begins, ends or changes its type; long values travel
as digests.

Defined results
---------------
* A repeated row counts once. Of two payloads with the same time the smaller generation_id is first.
* Paths are those of leaves; an object is a field only where a leaf turns into it (``retyped``).
* A payload that isn't a JSON object, misses parts or is null has no fields; it is listed with a
  null map, and is left out of the sequence that changes are taken from.
* An empty object gives one path of type object; null values have no type and change nothing.
* A gone field and a new one of the same value are one ``renamed``; of several equal ones the n-th
  by name goes with the n-th.
* Numbers are compared as numbers (1 and 1.0 are equal), objects without the order of keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut

BLOCK_SEQ = 4096  # payloads of a name to one window; what crosses a border is carried over
SHORT_VALUE = 22  # characters up to which a value travels as it is
MOST_DRIFTING = 100_000  # drifting (name, path) up to which they go to every task; beyond it Spark chooses
FIELDS = "array<struct<path:string,kind:string,value:string>>"
INLINE, PARTED = "inline_json", "partitioned_json_v1"


def _plain(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_plain(x) for x in value]
    if isinstance(value, dict):
        return {k: _plain(x) for k, x in value.items()}
    return value


def _kind(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "text"
    return "list" if isinstance(value, list) else "object"


def _refuse(word: str):
    raise ValueError(word)


def path_map(text: str | None) -> list[tuple[str, str | None, str | None]] | None:
    """(path, raw type, canonical JSON) of a payload; a JSON text inside JSON text is unwrapped."""
    try:
        value = json.loads(text, parse_constant=_refuse)
        for _ in range(4):
            if not isinstance(value, str):
                break
            value = json.loads(value, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    out: list[tuple[str, str | None, str | None]] = []
    stack = [("", value)]
    while stack:
        prefix, node = stack.pop()
        for key, item in node.items():
            path, kind = prefix + key, _kind(item)
            if kind == "object":
                out.append((path, kind, None if item else "{}"))
                stack.append((path + ".", item))
            else:
                text = None if kind is None else json.dumps(_plain(item), ensure_ascii=False, sort_keys=True)
                out.append((path, kind, text))
    return list({path: (path, kind, text) for path, kind, text in out}.values())


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        raw = [bytes(b).decode("utf-8", "replace") if b is not None else None for b in batch["content"]]
        rows = batch.drop(columns=["content"])
        yield rows.assign(
            fields=[
                None if (m := path_map(text)) is None else [{"path": p, "kind": k, "value": v} for p, k, v in m] for text in raw
            ]
        )


def assembled(payloads: DataFrame, parts: DataFrame) -> DataFrame:
    """name, generation_id, at, content (binary) of each payload, its parts joined in order."""
    at = F.to_timestamp(F.regexp_replace(F.regexp_replace("updated_at", "T", " "), "Z$", ""))
    rows = payloads.select(
        "name", "generation_id", at.alias("at"), "payload", "part_count", F.coalesce("storage_mode", F.lit(INLINE)).alias("mode")
    ).distinct()
    inline = rows.where(F.col("mode") != PARTED).select("name", "generation_id", "at", F.encode("payload", "UTF-8").alias("content"))
    pieces = (
        parts.groupBy("name", "generation_id", "part_index")
        .agg(F.first("payload").alias("payload"))
        .groupBy("name", "generation_id")
        .agg(F.sort_array(F.collect_list(F.struct("part_index", "payload"))).alias("pieces"))
    )
    whole = F.aggregate("pieces", F.lit(b""), lambda acc, p: F.concat(acc, p["payload"]))
    parted = rows.where(F.col("mode") == PARTED).join(pieces, ["name", "generation_id"], "left").select(
        "name", "generation_id", "at",
        F.when((F.size("pieces") == F.col("part_count")) | (F.col("part_count").isNull() & F.col("pieces").isNotNull()), whole).alias("content"),
    )
    return inline.unionByName(parted)


def payload_maps(payloads: DataFrame, parts: DataFrame) -> DataFrame:
    """name, generation_id, at, fields: every payload as a map of paths to raw types and values."""
    return assembled(payloads, parts).mapInPandas(_maps, f"name string, generation_id string, at timestamp, fields {FIELDS}")


def numbered(maps: DataFrame) -> DataFrame:
    """Adds seq, 1, 2, ... by time within a name, and last_seq.

    Counted within (name, hour) and carried over the hours and the days, so that a name with a large share
    of all rows isn't numbered by one task. maps: name, generation_id, at and what else is to be kept.
    """
    rows = maps.withColumn("day", F.date_trunc("day", "at")).withColumn("hour", F.date_trunc("hour", "at"))
    hours = rows.groupBy("name", "day", "hour").agg(F.count(F.lit(1)).alias("n"))
    days = hours.groupBy("name", "day").agg(F.sum("n").alias("n_day"))
    by_day, by_hour = Window.partitionBy("name").orderBy(F.col("day").asc_nulls_first()), Window.partitionBy("name", "day").orderBy("hour")
    days = days.select(
        F.col("name").alias("d_name"), F.col("day").alias("d_day"), (F.sum("n_day").over(by_day) - F.col("n_day")).alias("before_day"),
        F.sum("n_day").over(Window.partitionBy("name")).alias("last_seq"),
    )
    hours = hours.withColumn("before_hour", F.sum("n").over(by_hour) - F.col("n"))
    before = hours.join(days, F.col("name").eqNullSafe(F.col("d_name")) & F.col("day").eqNullSafe(F.col("d_day"))).select(
        F.col("name").alias("h_name"), F.col("hour").alias("h_hour"), (F.col("before_day") + F.col("before_hour")).alias("before"), "last_seq"
    )
    inner = Window.partitionBy("name", "hour").orderBy("at", "generation_id")
    return (
        rows.withColumn("rn", F.row_number().over(inner))
        .join(before, F.col("name").eqNullSafe(F.col("h_name")) & F.col("hour").eqNullSafe(F.col("h_hour")))
        .withColumn("seq", F.col("rn") + F.col("before"))
        .drop("day", "hour", "h_name", "h_hour", "rn", "before")
    )


def path_statistics(maps: DataFrame) -> DataFrame:
    """name, path, kind, n_payloads, first_at, last_at: the types that each path has had."""
    one = maps.select("name", "at", F.explode("fields").alias("f"))
    return (
        one.groupBy("name", "f.path", "f.kind")
        .agg(F.count(F.lit(1)).alias("n_payloads"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    )


def drifting_paths(maps: DataFrame) -> DataFrame:
    """name, path of those that some payload of the name lacks, or that have had two types."""
    totals = maps.groupBy(F.col("name").alias("t_name")).agg(F.count(F.lit(1)).alias("n_all"))
    stats = path_statistics(maps).groupBy("name", "path").agg(F.sum("n_payloads").alias("n"), F.count("kind").alias("n_kinds"))
    return stats.join(totals, F.col("name").eqNullSafe(F.col("t_name"))).where((F.col("n") < F.col("n_all")) | (F.col("n_kinds") > 1)).select("name", "path")


def _walked(long: DataFrame) -> DataFrame:
    """long with start (seq, if the field wasn't there before), going (it isn't there after), known (its type before) and held.

    long: name, path, seq, last_seq, kind, value, holder. Each stretch of BLOCK_SEQ payloads is a window of
    its own and sees the last row of the one before and the first of the one after. A type that was last
    known further back is carried over by a row a stretch.
    """
    block = F.floor(F.col("seq") / BLOCK_SEQ)
    near = F.array_compact(F.array(
        block,
        F.when(F.col("seq") % BLOCK_SEQ == BLOCK_SEQ - 1, block + 1),  # seen from the next stretch
        F.when((F.col("seq") % BLOCK_SEQ == 0) & (block > 0), block - 1),
    ))
    rows = long.withColumn("own", block).withColumn("block", F.explode(near))
    order = Window.partitionBy("name", "path", "block").orderBy("seq")
    rows = rows.withColumn("start", F.when(~F.coalesce(F.lag("seq").over(order) == F.col("seq") - 1, F.lit(False)), F.col("seq")))
    rows = rows.withColumn("going", ~F.coalesce(F.lead("seq").over(order) == F.col("seq") + 1, F.lit(False)))
    rows = rows.withColumn("held", F.lag("holder").over(order)).withColumn("run", F.last("start", ignorenulls=True).over(order))
    typed = F.when(F.col("kind").isNotNull(), F.struct("run", "kind"))
    rows = rows.withColumn("known", F.last(typed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("known", F.when(F.col("known.run") == F.col("run"), F.col("known.kind")))
    rows = cut(rows)  # read for what crosses borders, and for itself
    # What is known at the end of a stretch: a type, that nothing is (a run that began in it), or what was before.
    ends = rows.where((F.col("own") == F.col("block")) & (F.col("seq") % BLOCK_SEQ == BLOCK_SEQ - 1)).select(
        "name", "path", "block",
        F.coalesce(F.col("kind"), F.col("known"), F.when(F.col("run") >= F.col("block") * BLOCK_SEQ, F.lit(""))).alias("at_end"),
    )
    blocks = Window.partitionBy("name", "path").orderBy("block")
    ends = ends.withColumn("gap", F.col("block") - F.row_number().over(blocks))  # stretches that follow each other
    carried = ends.select(
        "name", "path", (F.col("block") + 1).alias("block"),
        F.last("at_end", ignorenulls=True).over(Window.partitionBy("name", "path", "gap").orderBy("block")).alias("carried"),
    )
    carried = carried.where("carried <> ''")
    rows = rows.where(F.col("own") == F.col("block"))
    early = F.col("known").isNull() & F.col("start").isNull() & (F.col("run") < F.col("own") * BLOCK_SEQ)  # the run comes from before
    joined = rows.join(carried, ["name", "path", "block"], "left")
    return joined.withColumn("known", F.when(early, F.col("carried")).otherwise(F.col("known"))).drop("carried", "own", "block", "run")


def changes(maps: DataFrame) -> DataFrame:
    """name, generation_id, change_kind, old_field, new_field of each payload against the one before."""
    # Parsing is the larger part of the work; numbered as they lie in the checkpoint.
    key = F.coalesce(F.concat(F.lit("="), "name"), F.lit(""))  # no nulls, so that joins keep the partitions of windows
    maps = cut(maps.where("fields is not null").withColumn("name", key)).withColumn("row", F.monotonically_increasing_id())
    index = cut(numbered(maps.select("name", "generation_id", "at", "row")).select("row", "name", "generation_id", "seq", "last_seq"))
    drifting = cut(drifting_paths(maps))
    small = F.broadcast if drifting.limit(MOST_DRIFTING + 1).count() <= MOST_DRIFTING else lambda df: df
    digest = F.when(F.length("f.value") > SHORT_VALUE, F.concat(F.lit("#"), F.md5("f.value"))).otherwise(F.col("f.value"))
    long = maps.select("row", "name", F.explode("fields").alias("f")).select(
        "row", "name", "f.path", "f.kind", digest.alias("value"),
        (F.col("f.kind").eqNullSafe("object") & F.col("f.value").isNull()).alias("holder"),  # an object with fields inside
    )
    long = long.join(small(drifting), ["name", "path"], "left_semi")
    walk = _walked(long.drop("name").join(index.select("row", "name", "seq", "last_seq"), "row").drop("row"))
    turned = (F.col("kind") != F.col("known")) & F.col("start").isNull()
    unknown = F.concat(F.lit("\u0000"), F.col("path"))  # no value is equal to an unknown one
    events = F.array_compact(
        F.array(
            F.when(turned, F.struct(F.col("seq").alias("at_seq"), F.lit("retyped").alias("event"), F.col("kind").alias("value"))),
            F.when(
                F.col("start").isNotNull() & (F.col("seq") > 1) & ~F.col("holder"),
                F.struct(F.col("seq").alias("at_seq"), F.lit("added").alias("event"), F.coalesce("value", unknown).alias("value")),
            ),
            F.when(
                F.col("going") & (F.col("seq") < F.col("last_seq")) & ~F.col("holder"),
                F.struct((F.col("seq") + 1).alias("at_seq"), F.lit("removed").alias("event"), F.coalesce("value", unknown).alias("value")),
            ),
        )
    )
    found = walk.select("name", "path", F.explode(events).alias("e"), "holder", "held").select(
        "name", "path", "e.at_seq", "e.event", "e.value", "holder", "held"
    )
    found = cut(found)  # few rows, read three times
    retyped = found.where("event = 'retyped'")
    # What lies inside a field that turned into an object (or back) is no change of its own.
    shells = retyped.where("holder or held").select(F.col("name").alias("s_name"), F.col("at_seq").alias("s_seq"), F.concat("path", F.lit(".")).alias("s_path"))
    moved = found.where("event <> 'retyped'").join(
        shells, (F.col("name") == F.col("s_name")) & (F.col("at_seq") == F.col("s_seq")) & F.col("path").startswith(F.col("s_path")), "left_anti"
    )
    pairing = Window.partitionBy("name", "at_seq", "value", "event").orderBy("path")
    paired = (
        moved.withColumn("nth", F.row_number().over(pairing))
        .groupBy("name", "at_seq", "value", "nth")
        .agg(
            F.max(F.when(F.col("event") == "removed", F.col("path"))).alias("old"),
            F.max(F.when(F.col("event") == "added", F.col("path"))).alias("new"),
        )
        .select(
            "name", "at_seq",
            F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("renamed").alias("change_kind"),
            F.coalesce("old", F.lit("")).alias("old_field"),
            F.coalesce("new", F.lit("")).alias("new_field"),
        )
    )
    every = paired.unionByName(
        retyped.select("name", "at_seq", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_field"), F.col("path").alias("new_field"))
    )
    index = index.select("name", F.col("seq").alias("at_seq"), "generation_id")
    name = F.when(F.col("name") != "", F.substr("name", F.lit(2))).alias("name")
    return every.join(index, ["name", "at_seq"]).select(name, "generation_id", "change_kind", "old_field", "new_field")


def column_types(maps: DataFrame) -> DataFrame:
    """path, column_kind: the type that most payloads have at a path; of equals the first by name."""
    counts = maps.select(F.explode("fields").alias("f")).groupBy("f.path", "f.kind").agg(F.count(F.lit(1)).alias("n")).where("kind is not null")
    best = Window.partitionBy("path").orderBy(F.desc("n"), "kind")
    return counts.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("path", F.col("kind").alias("column_kind"))


def typed_table(maps: DataFrame) -> DataFrame:
    """One row a payload and path: the value in the column of the path's type, and failed casts.

    The number of paths isn't bounded, so the consistent table is kept long; ``wide_table`` turns
    chosen paths into columns.
    """
    long = maps.select("name", "generation_id", "at", F.explode("fields").alias("f")).select(
        "name", "generation_id", "at", "f.path", F.col("f.kind").alias("raw_kind"), "f.value"
    ).where("raw_kind is null or raw_kind <> 'object' or value is not null")
    joined = long.join(column_types(maps), "path", "left")
    bare = F.when(F.col("raw_kind") == "text", F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]).otherwise(F.col("value"))
    joined = joined.withColumn("bare", bare)
    number = F.when(F.col("column_kind") == "number", F.expr("try_cast(bare as double)"))
    truth = F.when(F.col("column_kind") == "boolean", F.expr("try_cast(bare as boolean)"))
    text = F.when(F.col("column_kind").isin("text", "list", "object"), F.col("bare"))
    fits = F.coalesce(number.isNotNull() | truth.isNotNull(), F.lit(False)) | (
        (F.col("column_kind") == "text") | ((F.col("column_kind") == F.col("raw_kind")) & text.isNotNull())
    )
    return joined.select(
        "name", "generation_id", "at", "path", "column_kind", "raw_kind",
        number.alias("number_value"), truth.alias("boolean_value"),
        F.when(fits, text).alias("text_value"),
        (F.col("raw_kind").isNotNull() & ~F.coalesce(fits, F.lit(False))).alias("cast_failed"),
    )


def whole_table(maps: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``wide_table`` with others: a map of all paths without a column to their typed values; n_failed_casts has theirs, too.

    A null map has null others, a payload with no such path an empty map. maps is cut, so that its rows keep their numbers.
    """
    maps = maps.withColumn("_row", F.monotonically_increasing_id())
    rest = F.filter("fields", lambda f: ~f["path"].isin(*columns)) if columns else F.col("fields")
    long = typed_table(maps.select(F.col("_row").alias("name"), "generation_id", "at", rest.alias("fields")))
    cell = F.struct("column_kind", "raw_kind", "number_value", "boolean_value", "text_value", "cast_failed")
    others = long.groupBy(F.col("name").alias("_row")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", cell.alias("cell"))))).alias("others"), F.count_if("cast_failed").alias("_failed")
    )
    none = F.map_from_entries(F.filter(F.array(F.struct(F.lit("").alias("path"), F.lit(None).cast(others.schema["others"].dataType.valueType).alias("cell"))), lambda x: F.lit(False)))
    every = F.when(F.col("fields").isNotNull(), F.coalesce("others", none)).alias("others")
    return wide_table(maps.join(others, "_row", "left"), columns, F.coalesce(F.col("_failed").cast("int"), F.lit(0)), [every])


def wide_table(maps: DataFrame, columns: dict[str, str], failed: Column | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """name, generation_id, at, one column a path, and n_failed_casts; columns: path to ``text``, ``number``, ``boolean`` or ``list``.

    A dot in a path is ``__`` in the name of its column; the three columns before them keep their names. failed: casts that
    failed elsewhere; more: columns that follow.
    """
    spark_type = {"number": "double", "boolean": "boolean"}
    lookup = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["path"], f["value"])))
    out = maps.withColumn("_m", lookup)
    cells, failed = [], F.lit(0) if failed is None else failed
    for path, kind in columns.items():
        raw = F.try_element_at("_m", F.lit(path))
        text = F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)
        cell = text.try_cast(spark_type[kind]) if kind in spark_type else text
        failed = failed + (raw.isNotNull() & cell.isNull()).cast("int")
        name = path.replace(".", "__")
        cells.append(cell.alias(name if name not in ("name", "generation_id", "at", "others", "n_failed_casts") else f"{name}__"))
    return out.select("name", "generation_id", "at", *cells, *more, failed.alias("n_failed_casts"))
