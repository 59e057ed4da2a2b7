"""Findings: rules over rows, one table of what they found, policy, suppression and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from codestrata.operators.relational import top_k_per_group

SUBJECT = ("project", "path", "detail")


def apply_rules(rows: DataFrame, rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """rule, severity, project, path, detail: what the rules find in rows(project, path, ...), in one pass.

    rules: (name, severity, condition, detail). A finding that is there twice counts once.
    """
    hits = F.array_compact(
        F.array(*[F.when(condition, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))) for name, severity, condition, detail in rules])
    )
    return rows.select("project", "path", F.explode(hits).alias("f")).select("f.rule", "f.severity", "project", "path", "f.detail").distinct()


def n_found(rules: Sequence[tuple[str, str, Column, Column]], of: WindowSpec) -> Column:
    """How many findings ``apply_rules`` has for the rows of a window, without a row for each: the different details of each rule."""
    details = [F.collect_set(F.when(condition, F.struct(detail.cast("string")))).over(of) for _, _, condition, detail in rules]
    return sum((F.size(d) for d in details), F.lit(0)).cast("long")


def with_policy(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds mode; policy: project, rule (null stands for any), mode. The most exact entry decides."""
    p = policy.select(F.col("project").alias("p_project"), F.col("rule").alias("p_rule"), "mode")
    exact = F.when(F.col("p_project").isNotNull(), 2).otherwise(0) + F.when(F.col("p_rule").isNotNull(), 1).otherwise(0)
    fits = (F.col("p_project").isNull() | (F.col("p_project") == F.col("project"))) & (F.col("p_rule").isNull() | (F.col("p_rule") == F.col("rule")))
    joined = findings.join(p, fits, "left")
    keys = findings.columns
    return joined.groupBy(*keys).agg(F.coalesce(F.max_by("mode", exact), F.lit("report")).alias("mode"))


def suppressed(findings: DataFrame, suppressions: DataFrame, today: str) -> DataFrame:
    """Adds suppression, the id of the first entry that fits and hasn't expired, or null.

    suppressions: id, project, rule, path_like (null stands for any), expires (date or null), enabled.
    """
    s = suppressions.where(F.col("enabled") & (F.col("expires").isNull() | (F.col("expires") >= F.lit(today).cast("date"))))
    s = s.select(F.col("id").alias("suppression"), *[F.col(c).alias(f"s_{c}") for c in ("project", "rule", "path_like")])
    fits = (
        (F.col("s_project").isNull() | (F.col("s_project") == F.col("project")))
        & (F.col("s_rule").isNull() | (F.col("s_rule") == F.col("rule")))
        & (F.col("s_path_like").isNull() | F.rlike("path", F.col("s_path_like")))
    )
    return findings.join(s, fits, "left").groupBy(*findings.columns).agg(F.min("suppression").alias("suppression"))


def rollups(findings: DataFrame) -> DataFrame:
    """level, project, rule, n; the sums of each level are the total."""
    g = findings.groupingSets([[], ["project"], ["rule"], ["project", "rule"]], "project", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id("project", "rule").cast("int").alias("gid")
    )
    level = F.element_at(F.create_map(*[F.lit(x) for x in (0, "project_rule", 1, "project", 2, "rule", 3, "total")]), F.col("gid"))
    return g.select(level.alias("level"), "project", "rule", "n")


def backlog(findings: DataFrame, bucket: Column, k: int) -> DataFrame:
    """rule, bucket, n, rank: where each rule finds most."""
    counts = findings.groupBy("rule", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(counts, ["rule"], [F.desc("n"), F.col("bucket")], k)
