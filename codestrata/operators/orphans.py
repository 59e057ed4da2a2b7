"""References to records that do not exist.

Method: keys are integers, or become them by a dictionary (``encoded``); the references become a bitmap
for each key range and period, the parents bitmaps of the keys that were there during whole runs of
periods, and reference AND-NOT parent leaves the bits that may be orphans. Only those are decoded and
held against the exact intervals of the parents.

A bitmap is compressed by keeping its 64-bit words that aren't empty, one a row: a range of keys that
nothing refers to costs nothing, and sparse keys cost a word each. Words are built by the partial
aggregation of a hash aggregate, so that a hot key is one bit a task and period before any exchange.

Defined results
---------------
* A null key or a null reference time is no reference and gives no row.
* Whole repeated rows count once, in references and in parents.
* A parent row without a start time exists from the beginning of time.
* An empty parent table makes every reference ``missing``; an empty reference table gives no rows.
* Columns are taken by name and renamed inside; further columns of the inputs don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

OPEN_PERIOD = 1_000_000  # after every period


def period_number(ts: Column) -> Column:
    """Months since year 0; the period in which bitmaps are kept and counts are reported."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def period_label(number: Column) -> Column:
    return F.format_string("%04d-%02d", (F.floor(number / 12)).cast("int"), (number % 12 + 1).cast("int"))


def encode_keys(keys: DataFrame, column: str) -> DataFrame:
    """A dictionary of keys that aren't integers: ``column``, ``code``.

    Codes are dense within each partition, so that pages stay filled. The dictionary is
    checkpointed, for the numbering must not change when a partition is computed again.
    """
    named = keys.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    return cut(named.withColumn("code", F.monotonically_increasing_id() + 1))


def encoded(refs: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs and parents with integers for keys; integers are their own dictionary.

    Keys of another type get the codes of ``encode_keys``, and keep their value as ``key_value``.
    """
    if dict(refs.dtypes)["key"] in ("tinyint", "smallint", "int", "bigint"):
        return refs.withColumn("key", F.col("key").cast("long")), parents.withColumn("key", F.col("key").cast("long"))
    codes = encode_keys(refs.select("key").unionByName(parents.select("key")), "key")
    put = lambda df: df.join(codes, "key").withColumn("key_value", F.col("key")).withColumn("key", F.col("code")).drop("code")
    return put(refs), put(parents)


def _bit(key: Column) -> Column:
    return F.expr("shiftleft(1L, cast(key & 63 AS int))")


def surviving_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(key, period) of the references that no parent covers for the whole period.

    refs: key long, at timestamp. parents: key long, start timestamp, stop timestamp. Parents are put
    together by word and run of periods first, so that versions of a key don't add up.
    """
    word = F.shiftright("key", 6).alias("word")
    ref_bits = refs.select(word, period_number(F.col("at")).alias("period"), _bit(F.col("key")).alias("bit")).groupBy("word", "period").agg(F.bit_or("bit").alias("bits"))
    # The periods that lie wholly within an interval: the start's own only if it begins with it.
    starts = period_number(F.col("start"))
    whole = F.date_trunc("month", F.col("start")) == F.col("start")
    covered = (
        parents.select(
            word,
            _bit(F.col("key")).alias("bit"),
            F.when(F.col("start").isNull(), -1).when(whole, starts).otherwise(starts + 1).alias("first_full"),
            F.coalesce(period_number(F.col("stop")) - 1, F.lit(OPEN_PERIOD)).alias("last_full"),
        )
        .where("first_full <= last_full")
        .groupBy("word", "first_full", "last_full")
        .agg(F.bit_or("bit").alias("there"))
    )
    alive = F.bit_or(F.when(F.col("period").between(F.col("first_full"), F.col("last_full")), F.col("there")).otherwise(F.lit(0).cast("long")))
    rest = (
        ref_bits.join(covered, "word", "left")
        .groupBy("word", "period")
        .agg(F.first("bits").alias("bits"), alive.alias("alive"))
        .select("word", "period", F.expr("bits & ~coalesce(alive, 0L)").alias("left"))
        .where("left <> 0")
    )
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(F.col("left"), k) == 1)
    return rest.select("period", "word", F.explode(places).alias("place")).select((F.col("word") * 64 + F.col("place")).alias("key"), "period")


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """ref_id, endpoint, key, at, reason of every reference without a parent at its time.

    refs: ref_id, endpoint, key, at timestamp. parents: key, start, stop timestamps.
    reason: ``missing`` (no parent row), ``deleted`` (one began before), else ``late``.
    """
    refs = refs.where(F.col("key").isNotNull() & F.col("at").isNotNull())
    parents = parents.where(F.col("key").isNotNull())
    back = "key_value" if dict(refs.dtypes)["key"] not in ("tinyint", "smallint", "int", "bigint") else "key"
    refs, parents = encoded(refs, parents)
    suspects = surviving_keys(refs, parents)
    doubtful = refs.withColumn("period", period_number(F.col("at"))).join(suspects, ["key", "period"])
    begun = lambda at: F.col("start").isNull() | (F.col("start") <= at)
    spans = parents.select(F.col("key").alias("p_key"), "start", "stop")
    alive = (F.col("key") == F.col("p_key")) & begun(F.col("at")) & (F.col("stop").isNull() | (F.col("stop") > F.col("at")))
    lost = doubtful.join(spans, alive, "left_anti")
    first = parents.groupBy("key").agg(F.min("start").alias("first_at"), F.bool_or(F.col("start").isNull()).alias("always"))
    reason = F.when(F.col("always").isNull(), "missing").when(F.col("always") | (F.col("first_at") <= F.col("at")), "deleted").otherwise("late")
    return lost.join(first, "key", "left").select("ref_id", "endpoint", F.col(back).alias("key"), "at", reason.alias("reason")).distinct()


def dependency_references(dependencies: DataFrame) -> DataFrame:
    """The references that the two endpoints of each dependency make."""
    ends = F.array(
        F.struct(F.lit("source").alias("endpoint"), F.col("source_file_id").alias("key")),
        F.struct(F.lit("target").alias("endpoint"), F.col("target_file_id").alias("key")),
    )
    return dependencies.select(F.col("dep_id").alias("ref_id"), F.col("recorded_at").alias("at"), F.explode(ends).alias("e")).select(
        "ref_id", "e.endpoint", "e.key", "at"
    )


def dependency_orphans(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    parents = files.select(F.col("file_id").alias("key"), F.col("indexed_at").alias("start"), F.col("removed_at").alias("stop"))
    return find_orphans(dependency_references(dependencies), parents)


def orphan_counts(orphans: DataFrame, table_name: str) -> DataFrame:
    """Orphans per table, endpoint, period and reason."""
    return (
        orphans.groupBy("endpoint", period_label(period_number(F.col("at"))).alias("period"), "reason")
        .agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("key").alias("n_keys"))
        .select(F.lit(table_name).alias("table_name"), "endpoint", "period", "reason", "n_references", "n_keys")
    )


__all__ = ["dependency_orphans", "dependency_references", "encode_keys", "encoded", "find_orphans", "orphan_counts", "surviving_keys"]
