"""Queries of rules over source texts, of metrics against policies, and of variants of files between projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.scores import band
from codestrata.operators import scans
from codestrata.plans import analysis_queries as analysis
from codestrata.plans.common import FILE, files
from codestrata.session import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Rules over component sources: name, family, weight, cap, what counts, and what of it doesn't (a tag with the attribute wanted).
RULES = (
    ("handler_in_markup", "runtime", 2.0, 10.0, r"on[A-Z]\w+=\{\(", ""),
    ("raw_html", "safety", 20.0, 40.0, r"dangerouslySetInnerHTML", ""),
    ("image_without_alt", "access", 5.0, 20.0, r"<img\b", r"<img\b[^>]*\balt="),
    ("button_without_type", "access", 3.0, 15.0, r"<button\b", r"<button\b[^>]*\btype="),
    ("literal_text", "language", 1.0, 10.0, r">[A-Za-z][^<>{}\n]*</", ""),
    ("effect", "runtime", 4.0, 16.0, r"\buseEffect\(", ""),
    ("request", "data", 4.0, 16.0, r"\bfetch\(", ""),
    ("request_unchecked", "resilience", 6.0, 24.0, r"await fetch\([^)]*\);", r"await fetch\([^)]*\);\s*if \(!"),
    ("untyped", "types", 3.0, 15.0, r":\s*any\b", ""),
    ("console", "runtime", 2.0, 10.0, r"\bconsole\.\w+\(", ""),
    ("throws", "resilience", 1.0, 5.0, r"\bthrow new \w+", ""),
    ("class_state", "state", 2.0, 10.0, r"private \w+ = new (Map|Set|WeakMap)\b", ""),
    ("mutates_argument", "state", 2.0, 12.0, r"\b\w+\.(push|splice|sort|reverse)\(", ""),
    ("loop_with_await", "data", 8.0, 24.0, r"for \([^)]*\) \{[^}]*\bawait\b", ""),
    ("empty_catch", "resilience", 8.0, 24.0, r"catch( \(\w+\))? \{\s*\}", ""),
)
_TEXT = r"""(SELECT DISTINCT record_id, project_key, relative_path, try(decode(content)) AS text FROM source_records WHERE regexp_matches(lower(relative_path), '\.[jt]sx?$'))"""
_HITS = f"""(SELECT record_id, project_key, rule, family, weight, cap, n FROM ({' UNION ALL '.join(f"SELECT record_id, project_key, '{r}' AS rule, '{f}' AS family, {w}::DOUBLE AS weight, {c}::DOUBLE AS cap, len(regexp_extract_all(text, '{p}'))" + (f" - len(regexp_extract_all(text, '{m}'))" if m else "") + f" AS n FROM {_TEXT} WHERE text IS NOT NULL" for r, f, w, c, p, m in RULES)}) WHERE n > 0)"""


def components(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_records").where(F.lower("relative_path").rlike(r"\.[jt]sx?$"))
    return rows.select("record_id", "project_key", "relative_path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).distinct().where("text is not null")


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, project_key, rule, family, weight, cap, n: all rules in one pass over the texts."""
    return scans.rule_hits(components(spark, folder), RULES)


@query(f"SELECT record_id, rule, family, n FROM {_HITS}")
def component_risks(spark: SparkSession, folder: str) -> DataFrame:
    return hits(spark, folder).select("record_id", "rule", "family", "n")


@query(f"SELECT project_key, family, count(DISTINCT record_id) AS n_files, sum(n)::BIGINT AS n_hits, sum(least(n * weight, cap)) AS burden FROM {_HITS} GROUP BY 1, 2")
def component_families(spark: SparkSession, folder: str) -> DataFrame:
    burden = F.sum(F.least(F.col("n") * F.col("weight"), F.col("cap")))
    return hits(spark, folder).groupBy("project_key", "family").agg(F.count_distinct("record_id").alias("n_files"), F.sum("n").alias("n_hits"), burden.alias("burden"))


_READY = f"(SELECT t.record_id, greatest(0.0, 100.0 - coalesce(sum(least(n * weight, cap)), 0.0)) AS score, count(rule) AS n_rules FROM (SELECT record_id FROM {_TEXT} WHERE text IS NOT NULL) t LEFT JOIN {_HITS} h ON h.record_id = t.record_id GROUP BY 1)"


@query(f"SELECT record_id, score, n_rules, CASE WHEN score >= 90 THEN 'ready' WHEN score >= 70 THEN 'near' ELSE 'blocked' END AS state FROM {_READY}")
def component_readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Each component's score: 100 less the capped weights of what the rules find in it."""
    sums = hits(spark, folder).groupBy("record_id").agg(F.sum(F.least(F.col("n") * F.col("weight"), F.col("cap"))).alias("burden"), F.count(F.lit(1)).alias("n_rules"))
    rows = components(spark, folder).select("record_id").join(sums, "record_id", "left").fillna(0, ["burden", "n_rules"])
    score = F.greatest(F.lit(0.0), 100.0 - F.col("burden"))
    return rows.select("record_id", score.alias("score"), "n_rules", band(score, [(90, "ready"), (70, "near")], "blocked").alias("state"))


CLIENT, SERVER = r"use client|\buse(State|Effect|Memo|Ref)\(|\bwindow\.|\bdocument\.|on[A-Z]\w+=\{", r"use server|process\.env|\bawait fetch\(|from 'node:|from 'fs'"


@query(rf"""SELECT record_id, n_client, n_server, CASE WHEN n_client > 0 AND n_server > 0 THEN 'mixed' WHEN n_client > 0 THEN 'client' WHEN n_server > 0 THEN 'server' ELSE 'shared' END AS side FROM (
    SELECT record_id, len(regexp_extract_all(text, '{CLIENT.replace("'", "''")}')) AS n_client, len(regexp_extract_all(text, '{SERVER.replace("'", "''")}')) AS n_server FROM {_TEXT} WHERE text IS NOT NULL)""")
def component_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Which side of the boundary a source runs on, by the signs of either."""
    rows = components(spark, folder).select("record_id", F.regexp_count("text", F.lit(CLIENT)).alias("n_client"), F.regexp_count("text", F.lit(SERVER)).alias("n_server"))
    c, s = F.col("n_client") > 0, F.col("n_server") > 0
    return rows.withColumn("side", F.when(c & s, "mixed").when(c, "client").when(s, "server").otherwise("shared"))


AROUND = 8  # lines before and after
RISKY = r"\bthrow\b|\bfetch\("


@query(rf"""SELECT record_id, i::INTEGER AS line_no, lines[i] AS line, md5(array_to_string(lines[greatest(i - {AROUND}, 1):i + {AROUND}], chr(10))) AS context, len(list_filter(lines[greatest(i - {AROUND}, 1):i + {AROUND}], lambda x: contains(x, 'if ('))) > 0 AS guarded
    FROM (SELECT record_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT record_id, string_split(text, chr(10)) AS lines FROM {_TEXT} WHERE text IS NOT NULL)) WHERE regexp_matches(lines[i], '{RISKY}')""")
def line_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that throw or ask, and whether a condition stands within eight lines; a text's lines stay in its row, so that nothing is exchanged."""
    lines = F.col("lines")
    rows = components(spark, folder).select("record_id", F.split("text", "\n").alias("lines"))
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at(lines, i).rlike(RISKY))
    rows = rows.select("record_id", "lines", F.explode(at).alias("line_no"))
    first = F.greatest(F.col("line_no") - AROUND, F.lit(1))
    context = F.slice(lines, first, F.col("line_no") + AROUND - first + 1)
    guarded = F.exists(context, lambda x: F.contains(x, F.lit("if (")))
    return rows.select("record_id", "line_no", F.element_at(lines, F.col("line_no")).alias("line"), F.md5(F.array_join(context, "\n")).alias("context"), guarded.alias("guarded"))


CATEGORIES = (("hook", r"(^|/)use[A-Z][^/]*\.[jt]sx?$"), ("page", r"(^|/)(pages|routes|app)/"), ("component", r"\.[jt]sx$"), ("style", r"\.(css|scss)$"), ("story", r"\.stories\."))


@query(f"""SELECT project_key, category, count(*) AS n_files, sum(size_bytes)::BIGINT AS size_bytes, arg_max(rel_path, (coalesce(size_bytes, -1), rel_path)) AS largest FROM (SELECT *, CASE {' '.join(f"WHEN regexp_matches(rel_path, '{p}') THEN '{n}'" for n, p in CATEGORIES)} END AS category FROM {FILE}) WHERE category IS NOT NULL GROUP BY 1, 2""")
def interface_map(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the interface by the part they play, the first that fits."""
    category = None
    for name, pattern in CATEGORIES:
        hit = F.col("rel_path").rlike(pattern)
        category = F.when(hit, name) if category is None else category.when(hit, name)
    rows = files(spark, folder).withColumn("category", category).where("category is not null")
    return rows.groupBy("project_key", "category").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.max_by("rel_path", F.struct(F.coalesce("size_bytes", F.lit(-1)), "rel_path")).alias("largest"))


FLAGS = (("environment", r"process\.env|os\.environ"), ("storage", r"localStorage|sessionStorage"), ("timer", r"\bset(Timeout|Interval)\("), ("evaluation", r"\beval\(|new Function\("), ("process", r"subprocess|child_process"),
         ("network", r"\bfetch\(|requests\.|urllib"), ("file", r"\bopen\(|readFile"), ("random", r"Math\.random|\brandom\."), ("clock", r"Date\.now|datetime\.now"), ("log", r"\bprint\(|console\."))
_ANY = r"(SELECT DISTINCT record_id, relative_path, try(decode(content)) AS text FROM source_records)"


@query(f"""SELECT record_id, array_to_string(flags, ',') AS flags, len(flags)::INTEGER AS n_flags FROM (SELECT record_id, list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in FLAGS)}], lambda x: x IS NOT NULL) AS flags FROM {_ANY} WHERE text IS NOT NULL) WHERE len(flags) > 0""")
def review_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of any language with the signs of what they do at run time."""
    rows = table(spark, folder, "source_records").select("record_id", "relative_path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).distinct().where("text is not null")
    flags = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in FLAGS]))
    return rows.select("record_id", flags.alias("f")).where(F.size("f") > 0).select("record_id", F.array_join("f", ",").alias("flags"), F.size("f").alias("n_flags"))


# Metrics against policies

OBLIGATIONS = (("n_no_hash", 5.0, 3.0), ("n_large", 20.0, 2.0), ("n_unimported", 100.0, 1.0))
_DUE = f"""(SELECT m.project, o.metric, m.actual, o.allowed, m.actual / o.allowed AS ratio, o.weight, CASE WHEN m.actual <= o.allowed THEN 'met' WHEN m.actual <= 1.5 * o.allowed THEN 'close' ELSE 'open' END AS state
    FROM (UNPIVOT (SELECT project, n_no_hash::DOUBLE AS n_no_hash, n_large::DOUBLE AS n_large, n_unimported::DOUBLE AS n_unimported FROM {analysis._METRIC}) ON n_no_hash, n_large, n_unimported INTO NAME metric VALUE actual) m
    JOIN (VALUES {', '.join(f"('{m}', {a}::DOUBLE, {w}::DOUBLE)" for m, a, w in OBLIGATIONS)}) o(metric, allowed, weight) ON o.metric = m.metric)"""


def due(spark: SparkSession, folder: str) -> DataFrame:
    policy = spark.createDataFrame(list(OBLIGATIONS), "metric string, allowed double, weight double")
    m = analysis.metrics(spark, folder)
    long = m.select("project", *[F.col(n).cast("double").alias(n) for n, _, _ in OBLIGATIONS]).unpivot("project", [n for n, _, _ in OBLIGATIONS], "metric", "actual")
    ratio = F.col("actual") / F.col("allowed")
    return long.join(policy, "metric").select("project", "metric", "actual", "allowed", ratio.alias("ratio"), "weight", F.when(ratio <= 1.0, "met").when(ratio <= 1.5, "close").otherwise("open").alias("state"))


@query(f"SELECT project, metric, actual, allowed, ratio, state FROM {_DUE}")
def obligations(spark: SparkSession, folder: str) -> DataFrame:
    """Each metric against what is allowed, as a ratio."""
    return due(spark, folder).select("project", "metric", "actual", "allowed", "ratio", "state")


@query(f"""SELECT project, score, n_open, CASE WHEN n_open = 0 AND score >= 90 THEN 5 WHEN n_open = 0 THEN 4 WHEN n_open = 1 AND score >= 60 THEN 3 WHEN n_open = 1 THEN 2 ELSE 1 END AS step
    FROM (SELECT project, sum(weight * greatest(0.0, 100.0 - 50.0 * ratio)) / sum(weight) AS score, count(*) FILTER (state = 'open') AS n_open FROM {_DUE} GROUP BY 1)""")
def quality_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """A weighted score and the step of the ladder that it and the open obligations allow."""
    part = F.col("weight") * F.greatest(F.lit(0.0), 100.0 - 50.0 * F.col("ratio"))
    rows = due(spark, folder).groupBy("project").agg((F.sum(part) / F.sum("weight")).alias("score"), F.count_if(F.col("state") == "open").alias("n_open"))
    n, s = F.col("n_open"), F.col("score")
    return rows.withColumn("step", F.when((n == 0) & (s >= 90), 5).when(n == 0, 4).when((n == 1) & (s >= 60), 3).when(n == 1, 2).otherwise(1))


@query(f"""SELECT metric, count(*) AS n_projects, count(*) FILTER (state = 'met') AS n_met, max(ratio) AS worst_ratio, arg_max(project, (ratio, project)) AS worst_project FROM {_DUE} GROUP BY 1""")
def release_summary(spark: SparkSession, folder: str) -> DataFrame:
    return due(spark, folder).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_projects"), F.count_if(F.col("state") == "met").alias("n_met"), F.max("ratio").alias("worst_ratio"), F.max_by("project", F.struct("ratio", "project")).alias("worst_project")
    )


# Variants of files between projects

PACK = 12
_VARIANT = f"(SELECT v.*, f.project_key, f.size_bytes FROM ({analysis.ORACLE['variation_reconciler']}) v JOIN {FILE} f ON f.file_id = v.file_id)"


def variants(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.variation_reconciler(spark, folder).where("file_id is not null").join(files(spark, folder).select("file_id", "project_key", "size_bytes"), "file_id")


@query(f"""SELECT project_key, count(*) AS n_files, count(*) FILTER (state = 'identical') AS n_identical, count(*) FILTER (state = 'refined') AS n_refined, count(*) FILTER (state = 'drift') AS n_drift, count(*) FILTER (state = 'new') AS n_new,
    sum(score * size_bytes) / nullif(sum(CASE WHEN score IS NOT NULL THEN size_bytes END), 0) AS confidence FROM {_VARIANT} GROUP BY 1""")
def variant_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each project against the largest one: its files by state, and the likeness weighted by size."""
    n = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    weight = F.sum(F.when(F.col("score").isNotNull(), F.col("size_bytes")))
    return variants(spark, folder).groupBy("project_key").agg(
        F.count(F.lit(1)).alias("n_files"), n("identical"), n("refined"), n("drift"), n("new"), F.try_divide(F.sum(F.col("score") * F.col("size_bytes")), weight).alias("confidence")
    )


_ACTION = "CASE state WHEN 'identical' THEN 'drop' WHEN 'refined' THEN 'merge' WHEN 'drift' THEN 'compare' ELSE 'adopt' END"


@query(f"""SELECT file_id, base_id, action, wave, ((row_number() OVER (PARTITION BY project_key, action ORDER BY score DESC NULLS LAST, file_id) - 1) // {PACK} + 1)::INTEGER AS pack FROM (
    SELECT *, {_ACTION} AS action, CASE WHEN base_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY project_key, base_id ORDER BY score DESC, file_id) END::INTEGER AS wave FROM {_VARIANT})""")
def variant_packs(spark: SparkSession, folder: str) -> DataFrame:
    """What is to be done with each file, in waves (those with one partner follow each other) and packs of twelve."""
    s = F.col("state")
    action = F.when(s == "identical", "drop").when(s == "refined", "merge").when(s == "drift", "compare").otherwise("adopt")
    rows = cut(variants(spark, folder).withColumn("action", action))
    twins = rows.where("base_id is not null").withColumn("wave", F.row_number().over(Window.partitionBy("project_key", "base_id").orderBy(F.desc("score"), "file_id")))
    rows = twins.unionByName(rows.where("base_id is null").withColumn("wave", F.lit(1)))
    rn = F.row_number().over(Window.partitionBy("project_key", "action").orderBy(F.desc_nulls_last("score"), "file_id"))
    return rows.select("file_id", "base_id", "action", "wave", (F.floor((rn - 1) / PACK) + 1).cast("int").alias("pack"))
