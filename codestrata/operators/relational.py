"""Relational operators that the analyses share. Ties always break by the columns given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank. Spark keeps only k a group before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k_per_group(df, keys, order, 1, "_rank").drop("_rank")


def winners_and_losers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], identity: str) -> DataFrame:
    """Adds is_winner, and winner (the identity that the losers lost to)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("is_winner", F.row_number().over(w) == 1).withColumn("winner", F.first(identity).over(w))


def first_k_and_omitted(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """keys, the k smallest different values as an array, and how many were left out."""
    one = df.select(*keys, value).distinct()
    ranked = one.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return ranked.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("_n") <= k, F.col(value)))).alias("shown"),
        F.count_if(F.col("_n") > k).alias("n_omitted"),
    )


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered table."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def full_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, before, after, state: added, removed, modified or unchanged; equal nulls are unchanged."""
    b = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_b"))
    a = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_a"))
    state = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(F.col("before").eqNullSafe(F.col("after")), "unchanged")
        .otherwise("modified")
    )
    return b.join(a, list(keys), "full_outer").select(*keys, "before", "after", state.alias("state"))


def array_containment(df: DataFrame, array: str, names: DataFrame, name: str) -> DataFrame:
    """Rows of df for each element of the array that names has (an equi join on the elements)."""
    return df.withColumn(name, F.explode(F.array_distinct(array))).join(names, name)


def first_candidate(df: DataFrame, identity: Sequence[str], candidates: Column, known: DataFrame, key: str) -> DataFrame:
    """identity, key, ordinal: the first of the candidates (an array) that known has; null if none."""
    tried = df.select(*identity, F.posexplode_outer(candidates).alias("ordinal", key))
    hits = tried.join(known.select(key).distinct(), key, "left_semi")
    best = hits.groupBy(*identity).agg(F.min_by(key, "ordinal").alias(key), F.min("ordinal").alias("ordinal"))
    return df.select(*identity).distinct().join(best, list(identity), "left")


def first_rule(df: DataFrame, rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def suffix_lookup(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, node, status: exact, suffix, ambiguous or unknown.

    wanted: path. nodes: node (a path). All suffixes of the nodes form an index, a row for each segment.
    """
    exact = wanted.join(nodes.select(F.col("node").alias("path")).distinct(), "path", "left_semi")
    parts = F.split("node", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    index = nodes.select("node", F.explode(tails).alias("path")).groupBy("path").agg(F.count_distinct("node").alias("n"), F.min("node").alias("node"))
    found = wanted.distinct().join(index, "path", "left").join(exact.distinct().withColumn("_exact", F.lit(True)), "path", "left")
    status = F.when(F.col("_exact"), "exact").when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("suffix")
    node = F.when(F.col("_exact"), F.col("path")).when(F.col("n") == 1, F.col("node"))
    return found.select("path", node.alias("node"), status.alias("status"))


def jaccard(a: str, b: str) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left, right, similarity of all pairs of sets that share a token and reach the threshold.

    left: left, right: right, sorted arrays without repeats. A pair of the threshold shares one of the
    rarest tokens of either side, n - ceil(n threshold) + 1 of n; only those propose pairs.
    """
    each = left.select(F.col("left").alias("s")).unionByName(right.select(F.col("right").alias("s"))).distinct()
    tokens = each.select("s", F.explode("s").alias("token"))
    ranked = tokens.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("r"))
    needed = F.greatest(F.lit(1), F.ceil(F.size("s") * F.lit(threshold) - 1e-9))  # tokens that a pair shares at least
    posted = ranked.select("s", F.explode(F.slice("r", F.lit(1), (F.size("s") - needed + 1).cast("int"))["token"]).alias("token"))
    side = lambda d, name: posted.withColumnRenamed("s", name).join(d.select(name).distinct(), name, "left_semi")
    close = (F.size("left") >= F.size("right") * F.lit(threshold) - 1e-9) & (F.size("right") >= F.size("left") * F.lit(threshold) - 1e-9)
    pairs = side(left, "left").join(side(right, "right"), "token").where(close).select("left", "right", jaccard("left", "right").alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold).distinct()


def similar_by_tokens(left: DataFrame, right: DataFrame, threshold: float, common: int | None = None) -> DataFrame:
    """left_id, right_id, similarity (Jaccard of token sets) of all pairs that share a token and reach the threshold.

    left, right: id, tokens. Equal sets are compared once. ``common`` changes nothing: frequent tokens count like others.
    """
    side = lambda d, name: d.select(F.col("id").alias(f"{name}_id"), F.sort_array(F.array_distinct("tokens")).alias(name))
    a, b = side(left, "left"), side(right, "right")
    pairs = similar_sets(a, b, threshold).join(a, "left").join(b, "right")
    return pairs.where("left_id <> right_id").select("left_id", "right_id", "similarity")


def in_all_instances(df: DataFrame, group: str, instance: str, value: str) -> DataFrame:
    """group, value: the values that every instance of a group has."""
    one = df.select(group, instance, value).distinct()
    n = one.groupBy(group).agg(F.count_distinct(instance).alias("n"))
    return one.groupBy(group, value).agg(F.count(F.lit(1)).alias("has")).join(n, group).where("has = n").select(group, value)


def missing_from_largest(df: DataFrame, group: str, instance: str, key: str) -> DataFrame:
    """group, instance, n_keys, n_missing, completeness: what each instance lacks of the keys of the largest one.

    Of equally large ones the first by name. A key that the largest hasn't doesn't count for completeness.
    """
    one = df.select(group, instance, key).where(F.col(key).isNotNull()).distinct()
    own = one.groupBy(group, instance).agg(F.count(F.lit(1)).alias("n_keys"))
    largest = own.groupBy(group).agg(F.min_by(instance, F.struct(-F.col("n_keys"), F.col(instance))).alias("largest"), F.max("n_keys").alias("n_all"))
    wanted = one.join(largest.select(group, F.col("largest").alias(instance)), [group, instance], "left_semi").select(group, key)
    shared = one.join(wanted, [group, key], "left_semi").groupBy(group, instance).agg(F.count(F.lit(1)).alias("n_shared"))
    rows = own.join(shared, [group, instance], "left").fillna(0, ["n_shared"]).join(largest.drop("largest"), group)
    return rows.select(
        group, instance, "n_keys", (F.col("n_all") - F.col("n_shared")).alias("n_missing"), (F.col("n_shared") / F.col("n_all")).alias("completeness")
    )


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """keys, value at index round-half-even((n - 1) p) of the sorted values.

    Counts of equal values are added up first, so that the window runs over different values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    run = F.sum("_n").over(w.orderBy(value))
    at = F.bround((F.sum("_n").over(w) - 1) * F.lit(p))
    placed = counts.withColumn("_upto", run).withColumn("_at", at)
    return placed.where("_upto > _at and _upto - _n <= _at").select(*keys, value)


def array_median(values: Column) -> Column:
    """The median of a sorted array, for frames in which no percentile is to be had."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2.0


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, the most frequent value (the smallest of equals) and how often it occurs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def rollup_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts in total, by either column and by both; level says which."""
    g = df.groupingSets([[], [first], [second], [first, second]], first, second).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(first, second).cast("int").alias("gid")
    )
    level = F.element_at(F.create_map(*[F.lit(x) for x in (0, "both", 1, first, 2, second, 3, "total")]), F.col("gid"))
    return g.select(level.alias("level"), first, second, "n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new put in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new).select(*old.columns)


def replace_scope(old: DataFrame, new: DataFrame, scope: str, changed: DataFrame) -> DataFrame:
    """old without the rows of the changed scopes, and the rows of new in those scopes."""
    kept = old.join(changed.select(scope).distinct(), scope, "left_anti")
    return kept.unionByName(new.join(changed.select(scope).distinct(), scope, "left_semi")).select(*old.columns)
