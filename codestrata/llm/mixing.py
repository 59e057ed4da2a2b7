"""Mixing sources to target weights.

Method: a source's quota of tokens is met by whole copies of all its documents, which are certain,
and a Pareto order sample for the rest: each document gets a random number u and an inclusion
probability p in proportion to its size, documents are ranked by (u / (1 - u)) / (p / (1 - p)), and
the first ones fill the quota. Documents so large that p would reach 1 are certain, and the others'
probabilities are solved for what is left (``certain_sizes``). The cut is found from sums over bands of
the rank, then over parts of the band in which it falls, and only one part is sorted, so that no source
is ranked by one task.

Defined results
---------------
* The total of a mix is the largest one at which every source that has documents reaches its share
  within max_repeats. With a ``total`` given, a source that can't reach its share gives all it may.
* A source without documents reaches 0, and the others share its part in proportion; the shares
  reached are reported as they are.
* Sources are compared in lower case, with ``_`` for blanks and hyphens. Documents without text,
  without tokens or of a source in no mix aren't used.
* The last document is taken if that brings the source nearer to its quota. Ties go by doc_id.
* The choice depends on the seed, the mix and doc_id alone, not on partitions.
* A repeated row of targets counts once. A null share or cap counts as 0.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut

DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"
BANDS = 64  # bands of the rank to one power of e
PARTS = 65_536  # parts of the band in which the cut falls
CERTAIN_RANK = -1e6  # before every other rank
MOST_TARGETS = 10_000  # rows of targets up to which what is derived from them goes to every task
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where a public vocabulary lies: a path as it is, else a file of the tokenizers' folder."""
    folder = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
    return name if os.path.sep in name else os.path.join(folder, name)


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def canonical_source(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def token_counts(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of every document with text."""
    path = tokenizer_path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, type=pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = documents.select("doc_id", canonical_source(F.col("source")).alias("source"), "text").where(
        "doc_id is not null and source is not null and text is not null"
    )
    return rows.mapInArrow(count, "doc_id long, source string, n_tokens long").where("n_tokens > 0")


def quotas(counts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row a mix and source: what is there, the quota, whole copies and the tokens still to sample."""
    targets = targets.select(
        "mix_name",
        canonical_source(F.col("source")).alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
    ).distinct()
    there = counts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum("n_tokens").alias("available"),
    )
    rows = targets.join(there, "source", "left").fillna({"n_documents": 0, "available": 0})
    most = (F.col("max_repeats") * F.col("available")).cast("double")
    reach = F.min(F.when(F.col("available") > 0, F.try_divide(most, F.col("target_share")))).over(Window.partitionBy("mix_name"))
    size = F.lit(float(total)) if total is not None else F.coalesce(reach, F.lit(0.0))
    quota = F.least(F.col("target_share") * size, most)
    return (
        rows.withColumn("quota", quota)
        .withColumn("whole", F.coalesce(F.floor(F.try_divide("quota", F.col("available").cast("double"))), F.lit(0)).cast("long"))
        .withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("available"), F.lit(0.0)))
    )


def certain_sizes(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """mix_name, source, certain, room, squares: the size from which on documents are certain, and what is left.

    With p = rest n / sum(n^2), a document of n tokens is certain if it still is once all larger ones are
    taken out: (rest - their tokens) n >= the squares of those that aren't larger. A row for each different
    size of a source is looked at; sums are exact, so that they don't depend on partitions.
    """
    sizes = counts.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    big = lambda c: c.cast("decimal(38,0)")
    sizes = sizes.select(
        "source", "n_tokens", (big(F.col("n_tokens")) * big(F.col("n"))).cast("decimal(38,0)").alias("tokens"),
        (big(F.col("n_tokens")) * big(F.col("n_tokens") * F.col("n"))).cast("decimal(38,0)").alias("square"),
    )
    rows = sizes.join(plan.where("rest > 0").select("mix_name", "source", "rest"), "source")
    each = Window.partitionBy("mix_name", "source")
    larger = each.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("over", F.coalesce(F.sum("tokens").over(larger), F.lit(0)).cast("double")).withColumn(
        "left", (F.sum("square").over(each) - F.coalesce(F.sum("square").over(larger), F.lit(0))).cast("double")
    )
    sure = (F.col("rest") - F.col("over")) * F.col("n_tokens") >= F.col("left")
    # What holds from the largest size down to the first that isn't certain.
    rows = rows.withColumn("open", F.max((~sure).cast("int")).over(each.orderBy(F.desc("n_tokens"))))
    return rows.groupBy("mix_name", "source").agg(
        F.min(F.when(F.col("open") == 0, F.col("n_tokens"))).alias("certain"),
        F.max(F.when(F.col("open") == 1, F.struct("n_tokens", (F.col("rest") - F.col("over")).alias("room"), F.col("left").alias("squares")))).alias("s"),
    ).select("mix_name", "source", "certain", "s.room", "s.squares")


def _with_cut(rows: DataFrame, key: list[str], unit: str, before: str) -> DataFrame:
    """key, edge, upto: the unit (a band, or a part of one) in which the quota is filled, and the tokens before it."""
    sums = rows.groupBy(*key, unit).agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"), F.first(before).alias("held"))
    order = Window.partitionBy(*key).orderBy(unit)
    sums = sums.withColumn("upto", F.col("held") + F.sum("size").over(order) - F.col("size"))
    return sums.where("upto < rest and upto + size >= rest").select(*key, F.col(unit).alias(f"{unit}_edge"), F.col("upto").alias(f"{unit}_upto"))


def mixed(counts: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """mix_name, source, doc_id, n_tokens, copies of every document used."""
    plan = quotas(counts, targets, total)
    key = ["mix_name", "source"]
    # One row a mix and source; joined by exchange a source with a third of all rows would be one
    # partition. Beyond the bound Spark chooses, and splits such a partition.
    small = F.broadcast if targets.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS else lambda df: df
    plan = plan.where("quota > 0").select(*key, "whole", "rest")
    plan = cut(plan.join(certain_sizes(counts, plan), key, "left"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    p = F.least(F.greatest(F.col("room") * F.col("n_tokens") / F.col("squares"), F.lit(1e-12)), F.lit(1 - 1e-12))
    log_rank = F.when(F.col("n_tokens") >= F.col("certain"), F.lit(CERTAIN_RANK)).otherwise(F.log(F.col("u") / (1 - F.col("u"))) - F.log(F.col("p") / (1 - F.col("p"))))
    rows = (
        counts.join(small(plan), "source")
        .withColumn("u", u)
        .withColumn("p", p)
        .withColumn("rank", log_rank)
        .withColumn("band", F.floor(F.col("rank") * BANDS))
        .withColumn("part", F.floor((F.col("rank") * BANDS - F.col("band")) * PARTS))
        .withColumn("zero", F.lit(0).cast("long"))
        .select(*key, "doc_id", "n_tokens", "whole", "rest", "rank", "band", "part", "zero")
    )
    bands = cut(_with_cut(rows.where("rest > 0"), key, "band", "zero"))
    placed = rows.join(small(bands), key, "left")
    parts = cut(_with_cut(placed.where("rest > 0 and band = band_edge"), key, "part", "band_upto"))
    edge = (F.col("band") == F.col("band_edge")) & (F.col("part") == F.col("part_edge"))
    placed = placed.join(small(parts), key, "left").withColumn("edge", F.coalesce(edge, F.lit(False)))
    inside = Window.partitionBy(*key).orderBy("rank", "doc_id")
    close = (
        placed.where("edge")
        .withColumn("upto", F.sum("n_tokens").over(inside) + F.col("part_upto"))
        .withColumn("extra", ((F.col("upto") - F.col("rest")) <= (F.col("rest") - (F.col("upto") - F.col("n_tokens")))).cast("long"))
    )
    before = (F.col("band") < F.col("band_edge")) | ((F.col("band") == F.col("band_edge")) & (F.col("part") < F.col("part_edge")))
    # No band fills the quota: all documents are wanted.
    clear = placed.where("not edge").withColumn(
        "extra", F.when(F.col("rest") <= 0, 0).otherwise(F.when(F.col("band_edge").isNull(), 1).otherwise(before.cast("int"))).cast("long")
    )
    columns = [*key, "doc_id", "n_tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    return clear.select(*columns).unionByName(close.select(*columns)).where("copies > 0")


def shares(plan: DataFrame, used: DataFrame) -> DataFrame:
    """The shares reached, a row for each mix and source."""
    got = used.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"),
        F.count(F.lit(1)).alias("used_documents"),
        F.max("copies").alias("most_copies"),
    )
    rows = plan.select("mix_name", "source", "target_share", "max_repeats", "n_documents", F.col("available").alias("available_tokens"))
    rows = rows.join(got, ["mix_name", "source"], "left").fillna({"used_tokens": 0, "used_documents": 0, "most_copies": 0})
    everything = F.sum("used_tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), everything), F.lit(0.0)))


def counted(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Token counts, written once: every mix and both passes over the ranks read them again."""
    return cut(token_counts(documents, tokenizer))
