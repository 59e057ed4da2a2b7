"""Queries of the composite analyses: findings, scores, gates, diffs, tests, search and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.scores import band, capped, clamp, compare, ratio
from codestrata.operators import findings as fnd
from codestrata.operators import drift, graph, scans
from codestrata.operators import relational as rel
from codestrata.plans.common import EDGE, EXPORT, FILE, KIND, PAYLOAD, adjacency, by_file, edges, exports, files, kind, records
from codestrata.session import cut, cut_clean, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FORBIDDEN = r"(^|/)(tools|tests)/"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Findings

_FINDING = f"""(SELECT rule, severity, project, path, detail FROM (
    SELECT 'large_file' AS rule, 'medium' AS severity, project_key AS project, rel_path AS path, size_bytes::VARCHAR AS detail FROM {FILE} WHERE size_bytes > 20000
    UNION ALL SELECT 'no_hash', 'low', project_key, rel_path, 'hash' FROM {FILE} WHERE hash IS NULL
    UNION ALL SELECT 'no_language', 'low', project_key, rel_path, 'language' FROM {FILE} WHERE language IS NULL
    UNION ALL SELECT 'deep_path', 'high', project_key, rel_path, len(string_split(rel_path, '/'))::VARCHAR FROM {FILE} WHERE len(string_split(rel_path, '/')) > 4) GROUP BY ALL)"""


def _rules(path: str) -> list:
    return [
        ("large_file", "medium", F.col("size_bytes") > 20000, F.col("size_bytes")),
        ("no_hash", "low", F.col("hash").isNull(), F.lit("hash")),
        ("no_language", "low", F.col("language").isNull(), F.lit("language")),
        ("deep_path", "high", paths.depth(F.col(path)) > 4, paths.depth(F.col(path))),
    ]


def found(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder).select(F.col("project_key").alias("project"), F.col("rel_path").alias("path"), "size_bytes", "hash", "language")
    return fnd.apply_rules(f, _rules("path"))


@query(f"SELECT * FROM {_FINDING}")
def findings(spark: SparkSession, folder: str) -> DataFrame:
    return found(spark, folder)


@query(f"""SELECT rule, mode, count(*) AS n FROM (SELECT rule, CASE WHEN project = 'ORBIT_WEB' AND rule = 'no_hash' THEN 'block' WHEN project = 'ORBIT_WEB' THEN 'off' WHEN rule = 'no_language' THEN 'off' ELSE 'report' END AS mode FROM {_FINDING}) GROUP BY 1, 2""")
def findings_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by mode of their project and rule; those switched off are counted."""
    policy = spark.createDataFrame([("ORBIT_WEB", None, "off"), (None, "no_language", "off"), ("ORBIT_WEB", "no_hash", "block")], "project string, rule string, mode string")
    return fnd.with_policy(found(spark, folder), policy).groupBy("rule", "mode").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT rule, project, path, detail, CASE WHEN rule = 'large_file' AND regexp_matches(path, '^tests/') THEN 1 WHEN project = 'AMBER_LEDGER' THEN 3 END AS suppression FROM {_FINDING}""")
def findings_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    """Wildcards, a switch and a date of expiry; the first entry that fits counts."""
    entries = [(1, None, "large_file", "^tests/", None, True), (2, None, "no_hash", None, "2020-01-01", True), (3, "AMBER_LEDGER", None, None, "2099-01-01", True), (4, None, None, None, None, False)]
    s = spark.createDataFrame(entries, "id int, project string, rule string, path_like string, expires string, enabled boolean").withColumn("expires", F.to_date("expires"))
    return fnd.suppressed(found(spark, folder), s, "2026-01-01").select("rule", "project", "path", "detail", "suppression")


@query(f"""SELECT CASE WHEN project IS NULL AND rule IS NULL THEN 'total' WHEN rule IS NULL THEN 'project' WHEN project IS NULL THEN 'rule' ELSE 'project_rule' END AS level, project, rule, count(*) AS n
    FROM {_FINDING} GROUP BY GROUPING SETS ((), (project), (rule), (project, rule))""")
def findings_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return fnd.rollups(found(spark, folder))


@query(f"""SELECT * FROM (SELECT rule, split_part(path, '/', 1) AS bucket, count(*) AS n, row_number() OVER (PARTITION BY rule ORDER BY count(*) DESC, split_part(path, '/', 1))::INTEGER AS rank FROM {_FINDING} GROUP BY 1, 2) WHERE rank <= 5""")
def remediation_backlog(spark: SparkSession, folder: str) -> DataFrame:
    return fnd.backlog(found(spark, folder), F.split("path", "/")[0], 5)


_DEAD = f"""(SELECT e.project_key, e.rel_path, e.name, CASE WHEN regexp_matches(e.rel_path, '(^|/)index\\.[jt]sx?$') THEN 'barrel' WHEN contains('/' || e.rel_path || '/', '/tests/') THEN 'test'
        WHEN f.file_id IS NULL THEN 'unknown_file' WHEN n.file_id IS NOT NULL THEN 'namespace_import' WHEN u.name IS NOT NULL AND i.dst IS NOT NULL THEN 'consumed' ELSE 'candidate' END AS reason,
        CASE WHEN i.dst IS NULL AND u.name IS NULL THEN 'HIGH' WHEN u.name IS NULL THEN 'MEDIUM' ELSE 'LOW' END AS confidence
    FROM {EXPORT} e LEFT JOIN (SELECT project_key, rel_path, min(file_id) AS file_id FROM {FILE} GROUP BY 1, 2) f ON f.project_key = e.project_key AND f.rel_path = e.rel_path
    LEFT JOIN (SELECT DISTINCT dst FROM {EDGE}) i ON i.dst = f.file_id
    LEFT JOIN (SELECT DISTINCT target_file_id AS file_id FROM dependencies WHERE {KIND} = 'namespace' AND target_file_id IS NOT NULL) n ON n.file_id = f.file_id
    LEFT JOIN (SELECT DISTINCT lower(split_part(regexp_replace(s, '^[./@]+', ''), '/', 1)) AS name FROM (SELECT unnest(from_json(json_extract(payload, '$.imports'), '["VARCHAR"]')) AS s FROM {PAYLOAD})) u ON u.name = lower(e.name))"""


# Scores and gates

_METRIC = f"""(SELECT f.project_key AS project, count(*) AS n_files, sum((f.hash IS NULL)::INTEGER)::BIGINT AS n_no_hash, sum((size_bytes > 20000)::INTEGER)::BIGINT AS n_large,
    sum(coalesce(o.n, 0))::BIGINT AS n_links, sum((i.n IS NULL)::INTEGER)::BIGINT AS n_unimported FROM {FILE} f LEFT JOIN (SELECT src, count(*) AS n FROM {EDGE} GROUP BY 1) o ON o.src = f.file_id
    LEFT JOIN (SELECT dst, count(*) AS n FROM {EDGE} GROUP BY 1) i ON i.dst = f.file_id GROUP BY 1)"""
MISSING = 50.0  # of a project that no rule was applied to, or that none found anything in
PURITY = {"large_file": (2.0, 30.0), "deep_path": (1.0, 30.0), "no_hash": (0.5, 20.0), "no_language": (0.5, 20.0)}  # weight and cap
_PURITY = f"""(SELECT project, 100 - sum(least(n * w, cap)) AS purity FROM (SELECT project, rule, count(*)::DOUBLE AS n FROM {_FINDING} GROUP BY 1, 2) f
    JOIN (VALUES {', '.join(f"('{r}', {w}::DOUBLE, {c}::DOUBLE)" for r, (w, c) in PURITY.items())}) v(rule, w, cap) ON v.rule = f.rule GROUP BY 1)"""
_HEALTH = f"""(SELECT m.project, 100 - least(100.0::DOUBLE, 400.0::DOUBLE * n_no_hash / n_files) AS identity, 100 - least(100.0::DOUBLE, 300.0::DOUBLE * n_large / n_files) AS size,
    100 - least(100.0::DOUBLE, 100.0::DOUBLE * n_unimported / n_files) AS used, 100 - least(100.0::DOUBLE, 5.0::DOUBLE * n_links / n_files) AS coupling, coalesce(purity, {MISSING}::DOUBLE) AS purity FROM {_METRIC} m LEFT JOIN {_PURITY} p ON p.project = m.project)"""
_SCORE = f"(SELECT *, 0.2 * identity + 0.15 * size + 0.25 * used + 0.2 * coupling + 0.2 * purity AS score FROM (SELECT project, identity::DOUBLE AS identity, size::DOUBLE AS size, used::DOUBLE AS used, coupling::DOUBLE AS coupling, purity::DOUBLE AS purity FROM {_HEALTH}))"


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    e = edges(spark, folder)
    f = files(spark, folder).join(graph.degrees(e).withColumnRenamed("node", "file_id"), "file_id", "left")
    return f.groupBy(F.col("project_key").alias("project")).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("hash").isNull()).alias("n_no_hash"), F.count_if(F.col("size_bytes") > 20000).alias("n_large"),
        F.sum(F.coalesce("n_out", F.lit(0))).alias("n_links"), F.count_if(F.coalesce("n_in", F.lit(0)) == 0).alias("n_unimported"),
    )


def health(spark: SparkSession, folder: str, missing_default: float = MISSING) -> DataFrame:
    """Five parts and their weighted sum; purity is missing_default where no rule found anything."""
    part = lambda name, weight: 100 - F.least(F.lit(100.0), F.lit(float(weight)) * F.col(name) / F.col("n_files"))
    weight = F.create_map(*[F.lit(x) for r, (w, c) in PURITY.items() for x in (r, w)])
    cap = F.create_map(*[F.lit(x) for r, (w, c) in PURITY.items() for x in (r, c)])
    n = found(spark, folder).groupBy("project", "rule").agg(F.count(F.lit(1)).alias("n"))
    purity = n.groupBy("project").agg((100 - F.sum(F.least(F.col("n") * F.element_at(weight, F.col("rule")), F.element_at(cap, F.col("rule"))))).alias("purity"))
    parts = metrics(spark, folder).join(purity, "project", "left").select(
        "project", part("n_no_hash", 400).alias("identity"), part("n_large", 300).alias("size"), part("n_unimported", 100).alias("used"), part("n_links", 5).alias("coupling"),
        F.coalesce("purity", F.lit(missing_default)).alias("purity"),
    )
    shares = (("identity", 0.2), ("size", 0.15), ("used", 0.25), ("coupling", 0.2), ("purity", 0.2))
    score = F.lit(shares[0][1]) * F.col(shares[0][0])
    for name, share in shares[1:]:
        score = score + F.lit(share) * F.col(name)
    return parts.withColumn("score", score)


@query(f"SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade FROM {_SCORE}")
def health_score(spark: SparkSession, folder: str) -> DataFrame:
    return health(spark, folder).withColumn("grade", band(F.col("score"), [(85, "A"), (70, "B"), (55, "C")], "D"))


_TOP = "split_part(rel_path, '/', 1)"


@query(f"""SELECT m, n_files, n_large, n_findings, dead_share, coupling, n_mutual, risk, CASE WHEN risk >= 50 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT *,
    least(n_large * 2.0::DOUBLE, 15.0::DOUBLE) + least(n_findings * 0.5::DOUBLE, 25.0::DOUBLE) + least(dead_share * 40.0::DOUBLE, 25.0::DOUBLE) + least(coupling * 2.0::DOUBLE, 20.0::DOUBLE) + least(n_mutual * 1.0::DOUBLE, 15.0::DOUBLE) AS risk
    FROM (SELECT coalesce(a.m, b.m, d.m) AS m, coalesce(n_files, 0) AS n_files, coalesce(n_large, 0) AS n_large, coalesce(n_findings, 0) AS n_findings, coalesce(dead_share, 0.0)::DOUBLE AS dead_share, coalesce(coupling, 0.0)::DOUBLE AS coupling, coalesce(n_mutual, 0) AS n_mutual
    FROM (SELECT {_TOP} AS m, count(*) AS n_files, sum((size_bytes > 20000)::INTEGER)::BIGINT AS n_large, sum(coalesce(o.n, 0))::DOUBLE / count(*) AS coupling, count(u.src) AS n_mutual FROM {FILE} f LEFT JOIN (SELECT src, count(*) AS n FROM {EDGE} GROUP BY 1) o ON o.src = f.file_id
        LEFT JOIN (SELECT DISTINCT x.src FROM {EDGE} x JOIN {EDGE} y ON y.src = x.dst AND y.dst = x.src) u ON u.src = f.file_id GROUP BY 1) a
    FULL JOIN (SELECT split_part(path, '/', 1) AS m, count(*) AS n_findings FROM {_FINDING} GROUP BY 1) b ON a.m = b.m
    FULL JOIN (SELECT {_TOP} AS m, count(*) FILTER (reason = 'candidate')::DOUBLE / count(*) AS dead_share FROM {_DEAD} GROUP BY 1) d ON d.m = coalesce(a.m, b.m)))""")
def module_risk_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Five inputs of each top directory, merged by full joins: size, findings, dead exports, links a file, and files that import each other."""
    e = cut(edges(spark, folder))
    out = e.groupBy(F.col("src").alias("file_id")).agg(F.count(F.lit(1)).alias("n_out"))
    mutual = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").select(F.col("src").alias("file_id")).distinct().withColumn("mutual", F.lit(True))
    rows = files(spark, folder).join(out, "file_id", "left").join(mutual, "file_id", "left")
    sizes = rows.groupBy(F.split("rel_path", "/")[0].alias("m")).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("size_bytes") > 20000).alias("n_large"), (F.sum(F.coalesce("n_out", F.lit(0))).cast("double") / F.count(F.lit(1))).alias("coupling"), F.count("mutual").alias("n_mutual")
    )
    counts = found(spark, folder).groupBy(F.split("path", "/")[0].alias("m")).agg(F.count(F.lit(1)).alias("n_findings"))
    unused = dead(spark, folder).groupBy(F.split("rel_path", "/")[0].alias("m")).agg((F.count_if(F.col("reason") == "candidate").cast("double") / F.count(F.lit(1))).alias("dead_share"))
    rows = sizes.join(counts, "m", "full_outer").join(unused, "m", "full_outer").fillna(0)
    risk = capped(F.col("n_large"), 2, 15) + capped(F.col("n_findings"), 0.5, 25) + capped(F.col("dead_share"), 40, 25) + capped(F.col("coupling"), 2, 20) + capped(F.col("n_mutual"), 1, 15)
    rows = rows.select("m", "n_files", "n_large", "n_findings", "dead_share", "coupling", "n_mutual", risk.alias("risk"))
    return rows.withColumn("level", band(F.col("risk"), [(50, "HIGH"), (25, "MEDIUM")], "LOW"))


@query(f"""SELECT project, greatest(0.0, least(100.0, 100 - p)) AS safety, CASE WHEN 100 - p < 40 THEN 'BLOCKED' WHEN 100 - p < 60 THEN 'CAUTION' ELSE 'OPEN' END AS gate
    FROM (SELECT project, ((100 - score) * 0.6::DOUBLE + CASE WHEN used < 50 THEN 25.0::DOUBLE WHEN used < 90 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM {_SCORE})""")
def safety_gate(spark: SparkSession, folder: str) -> DataFrame:
    steps = F.when(F.col("used") < 50, 25.0).when(F.col("used") < 90, 10.0).otherwise(0.0)
    h = health(spark, folder).withColumn("safety", 100 - ((100 - F.col("score")) * 0.6 + steps))
    gate = F.when(F.col("safety") < 40, "BLOCKED").when(F.col("safety") < 60, "CAUTION").otherwise("OPEN")
    return h.select("project", clamp(F.col("safety")).alias("safety"), gate.alias("gate"))


GATES = (("n_large", "<=", 5.0), ("n_no_hash", "<=", 2.0), ("n_unimported", "<", 10.0), ("n_files", ">=", 10.0))


@query(f"""SELECT m.project, m.metric, m.actual, g.op, g.expected, CASE g.op WHEN '<=' THEN m.actual <= g.expected WHEN '<' THEN m.actual < g.expected WHEN '>=' THEN m.actual >= g.expected END AS passed
    FROM (UNPIVOT (SELECT project, n_files::DOUBLE AS n_files, n_no_hash::DOUBLE AS n_no_hash, n_large::DOUBLE AS n_large, n_unimported::DOUBLE AS n_unimported FROM {_METRIC}) ON n_files, n_no_hash, n_large, n_unimported INTO NAME metric VALUE actual) m
    JOIN (VALUES {', '.join(f"('{m}', '{o}', {e}::DOUBLE)" for m, o, e in GATES)}) g(metric, op, expected) ON g.metric = m.metric""")
def quality_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric against every gate set for it."""
    gates = spark.createDataFrame(list(GATES), "metric string, op string, expected double")
    m = metrics(spark, folder)
    long = m.select("project", *[F.col(c).cast("double").alias(c) for c, _, _ in GATES]).unpivot("project", [c for c, _, _ in GATES], "metric", "actual")
    return long.join(gates, "metric").select("project", "metric", "actual", "op", "expected", compare(F.col("actual"), F.col("op"), F.col("expected")).alias("passed"))


@query(f"""SELECT month, metric, value, previous, CASE WHEN previous IS NULL THEN 'first_run' ELSE 'compared' END AS state, CASE WHEN previous IS NULL OR value = previous THEN 'same' WHEN (value > previous) = better THEN 'better' ELSE 'worse' END AS trend
    FROM (SELECT month, metric, value, better, lag(value) OVER (PARTITION BY metric ORDER BY month) AS previous FROM (
        SELECT date_trunc('month', recorded_at)::DATE AS month, 'links' AS metric, count(DISTINCT dep_id) AS value, true AS better FROM dependencies WHERE recorded_at IS NOT NULL GROUP BY 1
        UNION ALL SELECT date_trunc('month', recorded_at)::DATE, 'unresolved', count(DISTINCT dep_id) FILTER (target_file_id IS NULL), false FROM dependencies WHERE recorded_at IS NOT NULL GROUP BY 1))""")
def temporal_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of each month against the month before, with the direction that is good."""
    d = table(spark, folder, "dependencies").where("recorded_at is not null")
    m = d.groupBy(F.date_trunc("month", "recorded_at").cast("date").alias("month")).agg(
        F.count_distinct("dep_id").alias("links"), F.count_distinct(F.when(F.col("target_file_id").isNull(), F.col("dep_id"))).alias("unresolved")
    )
    long = m.unpivot("month", ["links", "unresolved"], "metric", "value")
    previous = F.lag("value").over(Window.partitionBy("metric").orderBy("month"))
    better = F.when(F.col("metric") == "links", F.col("value") > F.col("previous")).otherwise(F.col("value") < F.col("previous"))
    trend = F.when(F.col("previous").isNull() | (F.col("value") == F.col("previous")), "same").when(better, "better").otherwise("worse")
    state = F.when(F.col("previous").isNull(), "first_run").otherwise("compared")
    return long.withColumn("previous", previous).select("month", "metric", "value", "previous", state.alias("state"), trend.alias("trend"))


# Dead code and tests

def dead(spark: SparkSession, folder: str) -> DataFrame:
    e, f = exports(spark, folder), files(spark, folder)
    place = f.groupBy("project_key", "rel_path").agg(F.min("file_id").alias("file_id"))
    imported = edges(spark, folder).select(F.col("dst").alias("file_id")).distinct().withColumn("is_imported", F.lit(True))
    spaces = table(spark, folder, "dependencies").where(kind() == "namespace").select(F.col("target_file_id").alias("file_id")).where("file_id is not null").distinct().withColumn("is_space", F.lit(True))
    used = records(spark, folder).select(F.explode(F.from_json("payload", "imports array<string>")["imports"]).alias("s"))
    used = used.select(F.lower(F.split(F.regexp_replace("s", r"^[./@]+", ""), "/")[0]).alias("key")).distinct().withColumn("is_used", F.lit(True))
    rows = e.join(place, ["project_key", "rel_path"], "left").join(imported, "file_id", "left").join(spaces, "file_id", "left").withColumn("key", F.lower("name")).join(used, "key", "left")
    reason = rel.first_rule(
        rows,
        [
            ("barrel", F.col("rel_path").rlike(r"(^|/)index\.[jt]sx?$")), ("test", paths.has_fragment(F.col("rel_path"), "tests")), ("unknown_file", F.col("file_id").isNull()),
            ("namespace_import", F.col("is_space")), ("consumed", F.col("is_used") & F.col("is_imported")),
        ],
        "candidate",
    )
    confidence = F.when(F.col("is_imported").isNull() & F.col("is_used").isNull(), "HIGH").when(F.col("is_used").isNull(), "MEDIUM").otherwise("LOW")
    return rows.select("project_key", "rel_path", "name", reason.alias("reason"), confidence.alias("confidence"))


@query(f"SELECT * FROM {_DEAD}")
def dead_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Exports with the first exclusion that holds, and how sure it is that nothing uses the others."""
    return dead(spark, folder)


@query(f"SELECT project_key, reason, confidence, count(*) AS n FROM {_DEAD} GROUP BY 1, 2, 3")
def dead_export_counts(spark: SparkSession, folder: str) -> DataFrame:
    return dead(spark, folder).groupBy("project_key", "reason", "confidence").agg(F.count(F.lit(1)).alias("n"))


_IS_TEST = "contains('/' || rel_path || '/', '/tests/')"
_STEM = "lower(regexp_replace(regexp_extract(rel_path, '[^/]*$'), '\\.[^.]*$', ''))"
# Every test's own walk along the imports to their end, and every pair of the same name.
_TEST = f"""(WITH RECURSIVE t AS (SELECT file_id, project_key, {_STEM} AS stem FROM {FILE} WHERE {_IS_TEST}), s AS (SELECT file_id, project_key, {_STEM} AS stem FROM {FILE} WHERE NOT {_IS_TEST}), e AS {EDGE},
    walk(test, node) AS (SELECT file_id, file_id FROM t UNION SELECT walk.test, e.dst FROM walk JOIN e ON e.src = walk.node)
    SELECT test, target, max(direct) AS direct, max(naming) AS naming FROM (
        SELECT test, s.file_id AS target, 0 AS direct, 0 AS naming FROM walk JOIN s ON s.file_id = walk.node
        UNION ALL SELECT t.file_id, s.file_id, 1, 0 FROM e JOIN t ON t.file_id = e.src JOIN s ON s.file_id = e.dst
        UNION ALL SELECT t.file_id, s.file_id, 0, 1 FROM t JOIN s ON s.project_key = t.project_key AND s.stem = t.stem) GROUP BY 1, 2)"""


def _tests_and_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, folder).withColumn("is_test", paths.has_fragment(F.col("rel_path"), "tests")).withColumn("stem", F.lower(paths.stem(F.col("rel_path"))))
    t = f.where("is_test").select(F.col("file_id").alias("test"), "project_key", "stem")
    return t, f.where("not is_test").select(F.col("file_id").alias("target"), "project_key", "stem")


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, is_test, name, n_named, n_findings: a number for project and stem, the tests of it, and the findings of the path.

    Paths are exchanged by file and by name only; what is written has none. That a hash or a language is there is all that the rules ask.
    """
    told = lambda c: F.when(F.col(c).isNotNull(), F.lit("")).alias(c)
    rows = table(spark, folder, "files").select("file_id", "project_key", "rel_path", "size_bytes", told("hash"), told("language"), "indexed_at", "removed_at")
    f = by_file(rows).select("file_id", "project_key", "rel_path", "size_bytes", "hash", "language", F.lower(paths.stem(F.col("rel_path"))).alias("stem"), paths.has_fragment(F.col("rel_path"), "tests").alias("is_test"))
    keys = ["project_key", "stem"]
    path, name = Window.partitionBy(*keys, "rel_path"), Window.partitionBy(*keys)
    known = F.col("project_key").isNotNull() & F.col("rel_path").isNotNull()
    f = f.repartition(*keys).withColumn("n_findings", F.when(known, fnd.n_found(_rules("rel_path"), path)).otherwise(0))
    f = f.withColumn("name", F.when(known, F.min("file_id").over(name))).withColumn("n_named", F.when(known, F.count_if("is_test").over(name)).otherwise(0))
    return cut_clean(f.select("file_id", "is_test", "name", "n_named", "n_findings"))


def test_counts(f: DataFrame, near: DataFrame) -> DataFrame:
    """target, n_tests, confidence, n_direct: the tests that reach a file by imports, over any number of files, or have its name.

    Tests that reach the hub of a component are counted once for all that it reaches, tests of a name once for all
    files of it; those that are both are taken off. Only other pairs are listed.
    """
    t, s = f.where("is_test").select(F.col("file_id").alias("test"), "name"), f.where("not is_test").select(F.col("file_id").alias("target"), "name", "n_named")
    place = ["split", "part"]
    up, down, rest = graph.reach_by_hubs(near, t.select(F.col("test").alias("node")))
    up, down = up.withColumnRenamed("node", "test"), down.withColumnRenamed("node", "target")
    count = lambda name: F.count(F.lit(1)).alias(name)
    alike = up.join(t, "test").groupBy(*place, "name").agg(count("n_alike"))
    inside = s.join(down, "target").join(up.groupBy(*place).agg(count("n_up")), place).join(alike, [*place, "name"], "left")
    own = t.select(F.col("test").alias("origin"), F.col("name").alias("own"))
    others = rest.join(own, "origin").join(s.withColumnRenamed("target", "node"), "node").where(~F.coalesce(F.col("own") == F.col("name"), F.lit(False)))
    direct = near.join(t.select(F.col("test").alias("node")), "node", "left_semi").select(F.explode("outs").alias("target"))
    kinds = lambda df, n, is_named=False, n_direct=0: df.select("target", n.cast("long").alias("n"), F.lit(is_named).alias("naming"), F.lit(n_direct).cast("long").alias("n_direct"))
    rows = kinds(inside, F.col("n_up") - F.coalesce("n_alike", F.lit(0))).unionByName(kinds(s.where("n_named > 0"), F.col("n_named"), True))
    rows = rows.unionByName(kinds(others.withColumnRenamed("node", "target"), F.lit(1))).unionByName(kinds(direct, F.lit(0), n_direct=1))
    rows = rows.groupBy("target").agg(F.sum("n").alias("n_tests"), F.bool_or("naming").alias("naming"), F.sum("n_direct").alias("n_direct"))
    confidence = F.when(F.col("n_direct") > 0, 1.0).when(F.col("naming"), 0.8).otherwise(0.6)
    return cut_clean(rows.select("target", "n_tests", confidence.alias("confidence"), "n_direct").where("n_tests > 0"))


@query(f"""SELECT target, count(*) AS n_tests, max(CASE WHEN direct = 1 THEN 1.0 WHEN naming = 1 THEN 0.8 ELSE 0.6 END)::DOUBLE AS confidence, count(*) FILTER (direct = 1) AS n_direct FROM {_TEST} GROUP BY 1""")
def test_impact(spark: SparkSession, folder: str) -> DataFrame:
    return test_counts(_numbered(spark, folder), adjacency(spark, folder))


@query(f"""SELECT f.file_id, coalesce(n, 0) AS n_importers, CASE WHEN coalesce(n, 0) >= 20 THEN 'P0' WHEN coalesce(n, 0) >= 8 THEN 'P1' WHEN coalesce(n, 0) >= 3 THEN 'P2' ELSE 'P3' END AS priority
    FROM {FILE} f LEFT JOIN (SELECT dst, count(*) AS n FROM {EDGE} GROUP BY 1) i ON i.dst = f.file_id WHERE NOT {_IS_TEST} AND f.file_id NOT IN (SELECT target FROM {_TEST})""")
def test_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Files that no test reaches, by how many files import them."""
    f = files(spark, folder).where(~paths.has_fragment(F.col("rel_path"), "tests")).select("file_id")
    n = edges(spark, folder).groupBy(F.col("dst").alias("file_id")).agg(F.count(F.lit(1)).alias("n_importers"))
    t, s = _tests_and_sources(spark, folder)
    reached = graph.reach(edges(spark, folder), t.select(F.col("test").alias("node"))).select(F.col("node").alias("file_id"))
    named = s.join(t, ["project_key", "stem"], "left_semi").select(F.col("target").alias("file_id"))
    open_files = f.join(reached, "file_id", "left_anti").join(named, "file_id", "left_anti").join(n, "file_id", "left").fillna(0)
    return open_files.withColumn("priority", band(F.col("n_importers"), [(20, "P0"), (8, "P1"), (3, "P2")], "P3"))


# Search, telemetry, text

SEARCH = "gate"
_RANK = f"""CASE WHEN lower(name) = '{SEARCH}' THEN 0 WHEN list_contains(list_transform(regexp_extract_all(name, '[A-Z]+(?:[A-Z]|$)|[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x)), '{SEARCH}') THEN 1 WHEN starts_with(lower(name), '{SEARCH}') THEN 3 WHEN contains(lower(name), '{SEARCH}') THEN 5 END"""


@query(f"""SELECT project_key, rel_path, name, score, n_hits > 10 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY score, name, rel_path) AS k, count(*) OVER (PARTITION BY project_key) AS n_hits
    FROM (SELECT project_key, rel_path, name, {_RANK} AS score FROM {EXPORT}) WHERE score IS NOT NULL) WHERE k <= 10""")
def search_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Exact before whole word, prefix and part; ten a project, with a mark where there are more."""
    name = F.lower("name")
    score = F.when(name == SEARCH, 0).when(F.array_contains(paths.identifier_tokens(F.col("name")), SEARCH), 1).when(name.startswith(SEARCH), 3).when(F.contains(name, F.lit(SEARCH)), 5)
    hits = exports(spark, folder).withColumn("score", score).where("score is not null")
    n = hits.groupBy("project_key").agg(F.count(F.lit(1)).alias("n_hits"))
    top = rel.top_k_per_group(hits, ["project_key"], [F.col("score"), F.col("name"), F.col("rel_path")], 10)
    return top.join(n, "project_key").select("project_key", "rel_path", "name", "score", (F.col("n_hits") > 10).alias("truncated"))


@query("SELECT c.c_custkey AS customer, coalesce(n, 0) AS n_hits, mean_value FROM customer c LEFT JOIN (SELECT user_id, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1) e ON e.user_id = c.c_custkey")
def telemetry_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and mean of each node; nodes that nothing triggers have none."""
    hits = table(spark, folder, "events").groupBy(F.col("user_id").alias("customer")).agg(F.count(F.lit(1)).alias("n_hits"), F.avg("value").alias("mean_value"))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("customer")).join(hits, "customer", "left").fillna(0, ["n_hits"])


@query("""SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS last_type, bool_or(event_type = 'signup') AS has_signup FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def coalesced_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of events of a key, with gaps under 30 minutes, as one row each."""
    s = F.session_window("ts", "30 minutes")
    return table(spark, folder, "events").groupBy("user_id", s).agg(
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n_events"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.bool_or(F.col("event_type") == "signup").alias("has_signup"),
    ).drop("session_window")


@query("""SELECT user_id, first_day, last_day, n_days, last_day < (SELECT max(ts::DATE) FROM events) AS resolved FROM (
    SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS n_days FROM (SELECT user_id, d, (d - DATE '2000-01-01') - row_number() OVER (PARTITION BY user_id ORDER BY d) AS run FROM (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'error')) GROUP BY user_id, run)""")
def violation_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Keys open from the day they are seen until the first day without; coming back opens a new entry."""
    e = table(spark, folder, "events")
    days = e.where("event_type = 'error'").select("user_id", F.to_date("ts").alias("d")).distinct()
    run = F.datediff("d", F.lit("2000-01-01").cast("date")) - F.row_number().over(Window.partitionBy("user_id").orderBy("d"))
    rows = days.withColumn("run", run).groupBy("user_id", "run").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("run")
    today = e.agg(F.max(F.to_date("ts"))).scalar()
    return rows.select("user_id", "first_day", "last_day", "n_days", (F.col("last_day") < today).alias("resolved"))


RULES = (("todo", r"\bTODO\b|\bFIXME\b"), ("import", r"(?m)^import "), ("call", r"[A-Za-z]+\(\)"), ("path", r"(src|packages)/[A-Za-z0-9_/.]+"), ("percent", r"[0-9.,]+ ?%"))


@query(f"""SELECT rule, count(*) AS n_documents, sum(n)::BIGINT AS n_hits FROM ({' UNION ALL '.join(f"SELECT '{n}' AS rule, len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE text IS NOT NULL" for n, p in RULES)}) WHERE n > 0 GROUP BY 1""")
def text_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns over whole texts, all in one pass."""
    d = table(spark, folder, "documents").where("text is not null")
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count("text", F.lit(p)).alias("n")) for n, p in RULES])
    return d.select(F.explode(hits).alias("h")).where("h.n > 0").groupBy("h.rule").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("h.n").alias("n_hits"))


GLOSSARY = (("structure", "graph"), ("structure", "edge"), ("process", "gate"), ("process", "scan"), ("storage", "cache"), ("storage", "snapshot"))


@query(f"""SELECT category, source, count(*) AS n_documents, sum(n)::BIGINT AS n_hits FROM (SELECT g.category, lower(trim(source)) AS source, doc_id, sum(((length(text) - length(replace(text, g.word, ''))) / length(g.word))::BIGINT) AS n
    FROM documents, (VALUES {', '.join(map(str, GLOSSARY))}) g(category, word) WHERE contains(text, g.word) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def keyword_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of a glossary by category and source; the glossary is small and fixed, so it is an expression."""
    d = table(spark, folder, "documents").where("text is not null")
    count = lambda w: F.floor((F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))) / len(w))
    sums = [(c, sum((count(w) for k, w in GLOSSARY if k == c), F.lit(0))) for c in dict(GLOSSARY)]
    hits = F.array(*[F.struct(F.lit(c).alias("category"), n.cast("long").alias("n")) for c, n in sums])
    return d.select(F.lower(F.trim("source")).alias("source"), F.explode(hits).alias("h")).where("h.n > 0").groupBy("h.category", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("h.n").alias("n_hits"))


@query(f"""SELECT project_key, language, count(*) AS n_files, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY project_key) AS share FROM {FILE} WHERE language IS NOT NULL GROUP BY 1, 2""")
def project_languages(spark: SparkSession, folder: str) -> DataFrame:
    n = files(spark, folder).where("language is not null").groupBy("project_key", "language").agg(F.count(F.lit(1)).alias("n_files"))
    return n.withColumn("share", F.col("n_files") / F.sum("n_files").over(Window.partitionBy("project_key")))


@query(f"""SELECT project_key, arg_max(profile, (score, profile)) AS profile, max(score) AS score FROM (SELECT project_key, unnest(['library', 'server', 'interface']) AS profile,
    unnest([count(*) FILTER (contains('/' || rel_path || '/', '/lib/'))::DOUBLE / count(*), count(*) FILTER (contains('/' || rel_path || '/', '/server/') OR contains('/' || rel_path || '/', '/services/'))::DOUBLE / count(*), count(*) FILTER (contains('/' || rel_path || '/', '/components/'))::DOUBLE / count(*)]) AS score FROM {FILE} GROUP BY 1) GROUP BY 1""")
def architecture_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile with the largest share of a project's files."""
    p = F.col("rel_path")
    tests = {"library": paths.has_fragment(p, "lib"), "server": paths.has_fragment(p, "server") | paths.has_fragment(p, "services"), "interface": paths.has_fragment(p, "components")}
    shares = files(spark, folder).groupBy("project_key").agg(*[ratio(F.count_if(t), F.count(F.lit(1))).alias(n) for n, t in tests.items()])
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("score"), F.lit(n).alias("profile")) for n in tests]))
    return shares.select("project_key", best["profile"].alias("profile"), best["score"].alias("score"))


@query(f"""SELECT CASE WHEN len(string_split(rel_path, '/')) = 1 THEN '.' ELSE array_to_string(list_slice(string_split(rel_path, '/'), 1, least(2, len(string_split(rel_path, '/')) - 1)), '/') END AS directory, count(*) AS n_files, count(DISTINCT project_key) AS n_projects, sum(size_bytes)::BIGINT AS size_bytes FROM {FILE} GROUP BY 1""")
def landscape(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).groupBy(paths.directory(F.col("rel_path"), 2).alias("directory")).agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("project_key").alias("n_projects"), F.sum("size_bytes").alias("size_bytes"))


@query(f"""SELECT file_id, '/' || lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rel_path, '^(src|apps|packages)/', ''), '\\.[^.]*$', ''), '(^|/)index$', ''), '\\(([^)]*)\\)/', '', 'g')) AS route, CASE WHEN regexp_matches(rel_path, '(^|/)index\\.[jt]sx?$') THEN 'index' WHEN contains(rel_path, '[') THEN 'dynamic' ELSE 'page' END AS kind
    FROM {FILE} WHERE regexp_matches(rel_path, '\\.[jt]sx$')""")
def framework_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of pages as routes: without root, extension, index and groups."""
    p = F.col("rel_path")
    route = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^(src|apps|packages)/", ""), r"\.[^.]*$", ""), r"(^|/)index$", ""), r"\(([^)]*)\)/", "")
    kind_ = F.when(p.rlike(r"(^|/)index\.[jt]sx?$"), "index").when(F.contains(p, F.lit("[")), "dynamic").otherwise("page")
    return files(spark, folder).where(p.rlike(r"\.[jt]sx$")).select("file_id", F.concat(F.lit("/"), F.lower(route)).alias("route"), kind_.alias("kind"))


@query(f"""SELECT s.project_key, s.rel_path, CASE WHEN f.indexed_at IS NULL THEN 'never_indexed' WHEN s.at > f.indexed_at THEN 'stale' ELSE 'fresh' END AS state FROM (SELECT project_key, {"regexp_replace(replace(rel_path, chr(92), '/'), '^(./)+', '')".replace('^(./)', '^([.]/)')} AS rel_path, max(updated_at) AS at FROM atlas_staging_files GROUP BY 1, 2) s
    LEFT JOIN (SELECT project_key, rel_path, max(indexed_at) AS indexed_at FROM files GROUP BY 1, 2) f ON f.project_key = s.project_key AND f.rel_path = s.rel_path""")
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Staged files newer than their index entry."""
    s = table(spark, folder, "atlas_staging_files").groupBy("project_key", paths.normalized(F.col("rel_path")).alias("rel_path")).agg(F.max("updated_at").alias("at"))
    f = table(spark, folder, "files").groupBy("project_key", "rel_path").agg(F.max("indexed_at").alias("indexed_at"))
    state = F.when(F.col("indexed_at").isNull(), "never_indexed").when(F.col("at") > F.col("indexed_at"), "stale").otherwise("fresh")
    return s.join(f, ["project_key", "rel_path"], "left").select("project_key", "rel_path", state.alias("state"))


_LEDGER = f"""WITH part AS (SELECT name, generation_id, string_agg(decode_part, '' ORDER BY part_index) AS whole FROM (SELECT DISTINCT name, generation_id, part_index, hex(payload) AS decode_part FROM state_payload_parts) GROUP BY 1, 2),
    entry AS (SELECT name, generation_id, moment, sha256(CASE WHEN mode = 'partitioned_json_v1' THEN unhex(p.whole) ELSE encode(payload) END) AS own, payload_sha AS kept FROM (SELECT DISTINCT name, generation_id,
        replace(replace(updated_at, 'T', ' '), 'Z', '')::TIMESTAMP AS moment, payload, payload_sha, coalesce(storage_mode, 'inline_json') AS mode FROM state_payloads) LEFT JOIN part p USING (name, generation_id)),
    chain AS (SELECT *, sha256(concat_ws('|', coalesce(lag(kept) OVER w, '-'), kept)) AS link, coalesce(own = kept, false) AS valid FROM entry WINDOW w AS (PARTITION BY name ORDER BY moment, generation_id))"""


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    """name, generation_id, at, kept, valid, link: each entry's recorded digest held against its content, and the digest of it with the one before."""
    kept = table(spark, folder, "state_payloads").select("name", "generation_id", F.col("payload_sha").alias("kept")).distinct()
    own = drift.assembled(table(spark, folder, "state_payloads"), table(spark, folder, "state_payload_parts")).select("name", "generation_id", "at", F.sha2("content", 256).alias("own"))
    previous = F.lag("kept").over(Window.partitionBy("name").orderBy("at", "generation_id"))
    link = F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("-")), "kept"), 256)
    return own.join(kept, ["name", "generation_id"]).select("name", "generation_id", "at", "kept", F.coalesce(F.col("own") == F.col("kept"), F.lit(False)).alias("valid"), link.alias("link"))


@query(f"""{_LEDGER} SELECT name, count(*) AS n, count(*) FILTER (valid) AS n_valid, bool_and(valid) AS intact, arg_max(link, (moment, generation_id)) AS head, arg_min(generation_id, (moment, generation_id)) FILTER (NOT valid) AS broken_at FROM chain GROUP BY 1""")
def ledger_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every entry of a history has the digest recorded for it, the first that hasn't, and the head of the chain of digests."""
    c = _chain(spark, folder)
    order = F.struct("at", "generation_id")
    return c.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.bool_and("valid").alias("intact"), F.max_by("link", order).alias("head"),
        F.min_by("generation_id", F.when(~F.col("valid"), order)).alias("broken_at"),
    )


_PAD = {x: "".join(f"{b ^ x:02x}" for b in b"public example key".ljust(64, b"\0")) for x in (0x36, 0x5C)}


@query(f"""{_LEDGER} SELECT name, generation_id, sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}') || encode(link)))) AS signature, true AS verified FROM chain""")
def ledger_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """A keyed digest (HMAC-SHA-256, of two built-in digests) of each link of the chain, and whether it verifies against one made anew."""
    sign = scans.keyed_digest("public example key")
    signed = cut(_chain(spark, folder).select("name", "generation_id", "link", sign(F.col("link")).alias("signature")))
    return signed.select("name", "generation_id", "signature", (F.col("signature") == sign(F.col("link"))).alias("verified"))


_SOURCE = r"""(SELECT record_id, language, text, regexp_replace(regexp_replace(text, '(?s)/[*].*?[*]/', ' ', 'g'), '(?m)//[^\n]*$', '', 'g') AS bare FROM (SELECT DISTINCT record_id, try(decode(content)) AS text,
    CASE lower(regexp_extract(relative_path, '[.]([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript'
        WHEN 'cjs' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'cs' THEN 'csharp' WHEN 'json' THEN 'json' WHEN 'css' THEN 'css' WHEN 'md' THEN 'markdown' WHEN 'sql' THEN 'sql' ELSE 'unknown' END AS language FROM source_records) WHERE text IS NOT NULL)"""
_IMPORTED = rf"""SELECT record_id, language, unnest(CASE language
    WHEN 'python' THEN list_filter(list_concat(regexp_extract_all(text, '(?m)^\s*from\s+([.\w]+)\s+import', 1), regexp_extract_all(text, '(?m)^\s*import\s+([.\w]+)', 1)), lambda x: x <> '')
    WHEN 'typescript' THEN regexp_extract_all(text, '(?:from|import|require[(])\s*["'']([^"''\n]+)["'']', 1) WHEN 'javascript' THEN regexp_extract_all(text, '(?:from|import|require[(])\s*["'']([^"''\n]+)["'']', 1)
    WHEN 'java' THEN regexp_extract_all(text, '(?m)^\s*import\s+(?:static\s+)?([\w.]+)', 1) WHEN 'csharp' THEN regexp_extract_all(text, '(?m)^\s*using\s+([\w.]+)\s*;', 1)
    WHEN 'go' THEN regexp_extract_all(text, '(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"\n]+)"', 1) END) AS import FROM {_SOURCE}"""
_EXPORTED = rf"""SELECT DISTINCT record_id, name FROM (SELECT record_id, unnest(list_concat(regexp_extract_all(bare, '\bexport\s+(?:declare\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:const|let|var|function[*]?|class|interface|type|enum|namespace)\s+([A-Za-z_$][\w$]*)', 1),
    list_concat(list_transform(flatten(list_transform(regexp_extract_all(bare, '\bexport\s+(?:type\s+)?[{{]([^{{}}]*)[}}]', 1), lambda x: string_split(x, ','))), lambda y: regexp_extract(y, '([A-Za-z_$][\w$]*)\s*$', 1)),
    regexp_extract_all(bare, '\bexport\s+[*]\s+as\s+([A-Za-z_$][\w$]*)', 1)))) AS name FROM {_SOURCE} WHERE language = 'typescript') WHERE name <> ''"""
_SCRIPT_NAMES = r"regexp_extract_all(bare, '(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|async\s+)*(?:class|interface|type|enum|function[*]?|const|let|var)\s+([A-Za-z_$][\w$]*)', 1)"
_DECLARED = rf"""SELECT record_id, language, names[i] AS name, (i - 1)::INTEGER AS ordinal FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM (SELECT record_id, language, CASE language WHEN 'python' THEN regexp_extract_all(text, '(?m)^\s*(?:async\s+)?(?:def|class)\s+(\w+)', 1)
    WHEN 'java' THEN regexp_extract_all(bare, '(?m)^\s*(?:public|protected|private|static|final|abstract|\s)*\b(?:class|interface|enum|record)\s+(\w+)', 1)
    WHEN 'csharp' THEN regexp_extract_all(bare, '(?m)^\s*(?:public|protected|private|internal|static|sealed|abstract|partial|\s)*\b(?:class|interface|enum|struct|record)\s+(\w+)', 1)
    WHEN 'go' THEN regexp_extract_all(bare, '(?m)^\s*(?:func\s+(?:[(][^)]*[)]\s*)?|type\s+)(\w+)', 1) WHEN 'typescript' THEN {_SCRIPT_NAMES} WHEN 'javascript' THEN {_SCRIPT_NAMES} END AS names FROM {_SOURCE}))"""
_OCCURRENCE = rf"""SELECT record_id, len(regexp_extract_all(bare, '\b(?:if|for|while|return|await|async|yield|match|switch|try)\b'))::INTEGER AS density,
    greatest(0, 100 - 10 * len(regexp_extract_all(bare, '\b(?:global|window|document|process[.]env|os[.]environ|print|console[.]log)\b')))::INTEGER AS decoupling,
    md5(regexp_replace(regexp_replace(bare, '[A-Za-z_][A-Za-z0-9_]*', 'w', 'g'), '\s+', ' ', 'g')) AS dna FROM {_SOURCE}"""


@query()
def python_symbol_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_records").where(F.lower("relative_path").rlike(r"\.pyi?$"))
    return scans.python_symbols(rows.select("record_id", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).distinct())


@query(_IMPORTED)
def source_imports(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_records").select("record_id", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), paths.language_of(F.col("relative_path")).alias("language")).distinct()
    return rows.select("record_id", "language", F.explode(scans.import_strings(F.col("text"), F.col("language"))).alias("import"))


@query(_EXPORTED)
def source_exports(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_records").where(F.lower("relative_path").rlike(r"\.tsx?$")).select("record_id", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).distinct()
    return rows.select("record_id", F.explode(scans.named_exports(F.col("text"))).alias("name"))


@query()
def source_brace_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_records").where(F.lower("relative_path").rlike(r"\.tsx?$")).select("record_id", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).distinct()
    return rows.select("record_id", F.explode(scans.brace_spans_of("text")).alias("s")).select("record_id", "s.first", "s.last", "s.depth")


@query()
def snapshot_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """How alike each payload, inline or in parts, is to the one before it of the same name."""
    p = drift.assembled(table(spark, folder, "state_payloads"), table(spark, folder, "state_payload_parts"))
    p = p.withColumn("payload", F.make_valid_utf8(F.col("content").cast("string")))
    previous = F.lag("payload").over(Window.partitionBy("name").orderBy("at", "generation_id"))
    return p.withColumn("previous", previous).where("previous is not null").select("name", "generation_id", scans.likeness("previous", "payload").alias("likeness"))


# Joins of candidates, variants and updates

MUTATING, READING = ("emit", "flush", "merge", "update", "write", "sync", "collect", "push"), ("use", "read", "load", "fetch", "find", "list", "select", "count")
_NOUNS = f"""(SELECT DISTINCT file_id, project_key, words[1] AS verb, noun FROM (SELECT file_id, project_key, words, unnest(words[2:]) AS noun FROM (SELECT file_id, project_key,
    list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_extract(rel_path, '[^/]*$'), '[.][^.]*$', ''), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) AS words FROM {FILE})))"""


@query(f"""SELECT m.file_id AS mutation, m.noun, q.n AS n_queries, coalesce(o.n, 0) AS n_own, coalesce(o.first, q.first) AS first_query FROM {_NOUNS} m JOIN (SELECT noun, count(*) AS n, min(file_id) AS first FROM {_NOUNS} WHERE verb IN {READING} GROUP BY 1) q ON q.noun = m.noun
    LEFT JOIN (SELECT project_key, noun, count(*) AS n, min(file_id) AS first FROM {_NOUNS} WHERE verb IN {READING} GROUP BY 1, 2) o ON o.project_key = m.project_key AND o.noun = m.noun WHERE m.verb IN {MUTATING}""")
def state_invalidation(spark: SparkSession, folder: str) -> DataFrame:
    """What writes a thing against what reads it, by the words behind the verb: how many read it, in the same project and in all.

    The readers of a word are counted first, so that writers and readers of a common one aren't multiplied.
    """
    words = paths.identifier_tokens(paths.stem(F.col("rel_path")))
    f = files(spark, folder).select("file_id", "project_key", words[0].alias("verb"), F.explode(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))).alias("noun")).distinct()
    readers = f.where(F.col("verb").isin(*READING))
    own = readers.groupBy("project_key", "noun").agg(F.count(F.lit(1)).alias("n_own"), F.min("file_id").alias("own_query"))
    every = readers.groupBy("noun").agg(F.count(F.lit(1)).alias("n_queries"), F.min("file_id").alias("any_query"))
    rows = f.where(F.col("verb").isin(*MUTATING)).join(every, "noun").join(own, ["project_key", "noun"], "left").fillna(0, ["n_own"])
    return rows.select(F.col("file_id").alias("mutation"), "noun", "n_queries", "n_own", F.coalesce("own_query", "any_query").alias("first_query"))


@query(f"""SELECT dep_id, arg_min(f.file_id, (f.project_key <> d.project_key, f.project_key, f.file_id)) AS candidate, CASE WHEN bool_or(f.project_key = d.project_key) THEN 'own' ELSE 'other' END AS place, count(*) AS n_candidates
    FROM (SELECT DISTINCT dep_id, project_key, lower(regexp_extract(regexp_replace(import_specifier, '(/index)?(\\.[a-z]+)?$', ''), '[^/]*$')) AS stem FROM dependencies
        WHERE target_file_id IS NOT NULL AND target_file_id NOT IN (SELECT file_id FROM files) AND project_key IS NOT NULL AND import_specifier IS NOT NULL) d
    JOIN (SELECT file_id, project_key, {_STEM} AS stem FROM {FILE}) f ON f.stem = d.stem WHERE d.stem <> '' GROUP BY dep_id""")
def recovery_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Files by which links to missing ones may be mended: of the same name in the project, else in another.

    Candidates are gathered per name and project first, so that a common name isn't multiplied with
    all its links.
    """
    known = table(spark, folder, "files").select(F.col("file_id").alias("target_file_id")).distinct()
    name = F.lower(paths.basename(F.regexp_replace("import_specifier", r"(/index)?(\.[a-z]+)?$", "")))
    broken = table(spark, folder, "dependencies").where("target_file_id is not null and project_key is not null and import_specifier is not null").join(known, "target_file_id", "left_anti")
    broken = broken.select("dep_id", "project_key", name.alias("stem")).where("stem <> ''").distinct()
    f = files(spark, folder).select("file_id", "project_key", F.lower(paths.stem(F.col("rel_path"))).alias("stem"))
    own = f.groupBy("stem", "project_key").agg(F.min("file_id").alias("own_file"))
    every = f.groupBy("stem").agg(F.count(F.lit(1)).alias("n_candidates"), F.min_by("file_id", F.struct("project_key", "file_id")).alias("other_file"))
    rows = broken.join(every, "stem").join(own, ["stem", "project_key"], "left")
    return rows.select("dep_id", F.coalesce("own_file", "other_file").alias("candidate"), F.when(F.col("own_file").isNull(), "other").otherwise("own").alias("place"), "n_candidates")


@query(f"""SELECT f.file_id, coalesce(o.n, 0) AS n_links, coalesce(t.n, 0) AS n_tests, coalesce(x.n, 0) AS n_findings, array_to_string(list_filter([CASE WHEN coalesce(t.n, 0) = 0 THEN 'untested' END, CASE WHEN coalesce(x.n, 0) > 0 THEN 'findings' END, CASE WHEN coalesce(o.n, 0) > 10 THEN 'coupled' END], lambda r: r IS NOT NULL), ',') AS reasons
    FROM {FILE} f LEFT JOIN (SELECT src, count(*) AS n FROM {EDGE} GROUP BY 1) o ON o.src = f.file_id LEFT JOIN (SELECT target, count(*) AS n FROM {_TEST} GROUP BY 1) t ON t.target = f.file_id
    LEFT JOIN (SELECT project, path, count(*) AS n FROM {_FINDING} GROUP BY 1, 2) x ON x.project = f.project_key AND x.path = f.rel_path""")
def review_cockpit(spark: SparkSession, folder: str) -> DataFrame:
    """What is joined to each file, and the reasons to look at it."""
    f, near = _numbered(spark, folder), adjacency(spark, folder)
    links = near.select(F.col("node").alias("file_id"), F.size("outs").cast("long").alias("n_links"))
    tests = test_counts(f, near).select(F.col("target").alias("file_id"), "n_tests")
    rows = f.join(links, "file_id", "left").join(tests, "file_id", "left").fillna(0, ["n_links", "n_tests"])
    reasons = F.array_compact(F.array(F.when(F.col("n_tests") == 0, "untested"), F.when(F.col("n_findings") > 0, "findings"), F.when(F.col("n_links") > 10, "coupled")))
    return rows.select("file_id", "n_links", "n_tests", "n_findings", F.array_join(reasons, ",").alias("reasons"))


@query(f"""WITH RECURSIVE edge AS {EDGE}, walk(hook, node, depth) AS (SELECT file_id, file_id, 0 FROM {FILE} WHERE contains('/' || rel_path || '/', '/hooks/')
    UNION SELECT walk.hook, edge.src, depth + 1 FROM walk JOIN edge ON edge.dst = walk.node WHERE depth < 2) SELECT hook, count(DISTINCT node) AS n_consumers FROM walk WHERE node <> hook GROUP BY 1""")
def hook_consumers(spark: SparkSession, folder: str) -> DataFrame:
    """Files that use a hook, themselves or over one other file."""
    e = cut(graph.reverse(edges(spark, folder)))
    hooks = files(spark, folder).where(paths.has_fragment(F.col("rel_path"), "hooks")).select(F.col("file_id").alias("src"))
    one = e.join(hooks, "src").select(F.col("src").alias("hook"), F.col("dst").alias("node"))
    two = one.join(e, F.col("node") == F.col("src")).select("hook", F.col("dst").alias("node"))
    # Made distinct on both sides of the exchange before they are counted.
    return one.unionByName(two).where("node <> hook").distinct().groupBy("hook").agg(F.count(F.lit(1)).alias("n_consumers"))


_VERSION = """(SELECT DISTINCT project_key, rel_path, unnest(from_json(json_extract(p, '$.exports'), '["VARCHAR"]')) AS name FROM (SELECT project_key, {path} AS rel_path, {pick}(payload, (updated_at, payload)) AS p
    FROM atlas_staging_files WHERE stage_kind = 'atlas_record' GROUP BY 1, 2))"""
_AT = "regexp_replace(replace(rel_path, chr(92), '/'), '^([.]/)+', '')"


@query(f"""SELECT * FROM {_VERSION.format(path=_AT, pick='arg_min')} WHERE project_key IS NULL OR project_key NOT IN (SELECT project_key FROM projects WHERE lower(type) = 'python')
    UNION ALL SELECT * FROM {_VERSION.format(path=_AT, pick='arg_max')} WHERE project_key IN (SELECT project_key FROM projects WHERE lower(type) = 'python')""")
def surgical_update(spark: SparkSession, folder: str) -> DataFrame:
    """Exports of the first staged versions, with those of the last versions in the projects that changed (the Python ones)."""
    rows = table(spark, folder, "atlas_staging_files").where("stage_kind = 'atlas_record'")
    keys = ["project_key", paths.normalized(F.col("rel_path")).alias("rel_path")]
    names = lambda p: F.explode(F.from_json(p, "exports array<string>")["exports"]).alias("name")
    version = lambda pick: rows.groupBy(*keys).agg(pick("payload", F.struct("updated_at", "payload")).alias("p")).select("project_key", "rel_path", names(F.col("p"))).distinct()
    changed = table(spark, folder, "projects").where(F.lower("type") == "python").select("project_key")
    return rel.replace_scope(version(F.min_by), version(F.max_by), "project_key", changed).select("project_key", "rel_path", "name")


@query("""SELECT file_id, project_key, coalesce(n.hash, f.hash) AS hash, n.file_id IS NOT NULL AS replaced FROM (SELECT file_id, min(project_key) AS project_key, max(hash) AS hash FROM files WHERE removed_at IS NULL GROUP BY 1) f
    FULL JOIN (SELECT file_id, max('gone') AS hash, min(project_key) AS p FROM files WHERE file_id NOT IN (SELECT file_id FROM files WHERE removed_at IS NULL) GROUP BY 1) n USING (file_id) WHERE f.project_key IS NOT NULL
    UNION ALL SELECT file_id, min(project_key), 'gone', true FROM files WHERE file_id NOT IN (SELECT file_id FROM files WHERE removed_at IS NULL) GROUP BY 1""")
def upserted_files(spark: SparkSession, folder: str) -> DataFrame:
    """The present files, with a row put in for each file that is gone."""
    f = table(spark, folder, "files")
    here = f.where("removed_at is null").groupBy("file_id").agg(F.min("project_key").alias("project_key"), F.max("hash").alias("hash")).withColumn("replaced", F.lit(False))
    gone = f.groupBy("file_id").agg(F.min("project_key").alias("project_key"), F.count_if(F.col("removed_at").isNull()).alias("n")).where("n = 0")
    return rel.upsert(here, gone.select("file_id", "project_key", F.lit("gone").alias("hash"), F.lit(True).alias("replaced")), ["file_id"])


@query("""SELECT cluster, count(*) AS n_documents, min(doc_id) AS first_doc, count(DISTINCT md5(text)) AS n_texts, CASE WHEN count(DISTINCT md5(text)) = 1 THEN 'identical' ELSE 'new_head' END AS band
    FROM (SELECT doc_id, text, md5(CASE WHEN position(chr(10) IN text) = 0 THEN text ELSE substr(text, position(chr(10) IN text) + 1) END) AS cluster FROM documents WHERE text IS NOT NULL AND length(text) >= 200) GROUP BY 1 HAVING count(*) > 1""")
def duplicate_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are equal but for their first line, as one cluster each."""
    d = table(spark, folder, "documents").where("text is not null and length(text) >= 200")
    at = F.instr("text", "\n")
    body = F.when(at == 0, F.col("text")).otherwise(F.substr("text", at + 1))
    rows = d.select("doc_id", F.md5("text").alias("own"), F.md5(body).alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc"), F.count_distinct("own").alias("n_texts"))
    return rows.where("n_documents > 1").withColumn("band", F.when(F.col("n_texts") == 1, "identical").otherwise("new_head"))


_KEY_WORDS = """list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(rel_path, '/?[^/]*$', '') || ' ' || regexp_replace(regexp_extract(rel_path, '[^/]*$'), '[.][^.]*$', ''), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))))"""


@query(f"""WITH f AS (SELECT file_id, project_key, {_KEY_WORDS} AS words, {_STEM} AS stem, size_bytes FROM {FILE}), base AS (SELECT project_key FROM f WHERE project_key IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, project_key LIMIT 1),
    a AS (SELECT * FROM f WHERE project_key NOT IN (SELECT project_key FROM base)), b AS (SELECT * FROM f WHERE project_key IN (SELECT project_key FROM base)),
    pair AS (SELECT a.file_id, b.file_id AS base_id, len(list_intersect(a.words, b.words))::DOUBLE / nullif(len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)), 0) AS j, a.stem = b.stem AS same, a.size_bytes IS NOT DISTINCT FROM b.size_bytes AS size FROM a, b),
    scored AS (SELECT *, CASE WHEN same THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.5::DOUBLE * coalesce(j, 0) AS score FROM pair),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, base_id) AS k FROM scored WHERE score >= 0.4) WHERE k = 1)
    SELECT file_id, base_id, score, CASE WHEN j = 1 AND same AND size THEN 'identical' WHEN score >= 0.7 THEN 'refined' ELSE 'drift' END AS state FROM best
    UNION ALL SELECT file_id, NULL, NULL, 'new' FROM a WHERE file_id NOT IN (SELECT file_id FROM best) UNION ALL SELECT NULL, file_id, NULL, 'deleted' FROM b WHERE file_id NOT IN (SELECT base_id FROM best)""")
def variation_reconciler(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of the other projects against the largest project: the best partner by name and words.

    identical (same name and words, same size), refined (0.7 and above), drift (0.4 and above), new (none) and,
    for files of the largest project that are nobody's partner, deleted. Of partners alike the first by id.
    """
    words = paths.identifier_tokens(F.concat_ws(" ", paths.dirname(F.col("rel_path")), paths.stem(F.col("rel_path"))))
    f = cut(files(spark, folder).where("project_key is not null").select(
        "file_id", "project_key", F.sort_array(F.array_distinct(words)).alias("words"), F.lower(paths.stem(F.col("rel_path"))).alias("stem"), "size_bytes"
    ))
    base = f.groupBy("project_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project_key").limit(1).select("project_key")
    a, b = f.join(base, "project_key", "left_anti"), f.join(base, "project_key", "left_semi")
    # Files of the same stem and words have the same best partner, and of partners alike the first by id is taken.
    kinds = a.select(F.col("words").alias("left"), F.col("stem").alias("ls")).distinct()
    partners = cut(b.groupBy(F.col("words").alias("right"), F.col("stem").alias("rs")).agg(F.min("file_id").alias("base_id")))
    # 0.4 is reached by the stem alone, or by words that are alike by 0.8.
    by_words = kinds.join(rel.similar_sets(kinds.select("left").distinct(), partners.select("right").distinct(), 0.8), "left").join(partners, "right")
    by_stem = kinds.join(partners, F.col("ls") == F.col("rs")).withColumn("similarity", rel.jaccard("left", "right"))
    both = by_words.select("left", "ls", "right", "rs", "base_id", "similarity").unionByName(by_stem.select("left", "ls", "right", "rs", "base_id", "similarity"))
    pairs = both.withColumn("score", 0.5 * F.coalesce(F.col("ls") == F.col("rs"), F.lit(False)).cast("double") + 0.5 * F.col("similarity")).where("score >= 0.4")
    best = rel.best_per_key(pairs, ["left", "ls"], [F.desc("score"), F.col("base_id")])
    best = a.join(best, (F.col("words") == F.col("left")) & (F.col("stem") == F.col("ls"))).join(b.select(F.col("file_id").alias("base_id"), F.col("size_bytes").alias("base_size")), "base_id")
    state = F.when((F.col("similarity") == 1) & (F.col("ls") == F.col("rs")) & F.col("size_bytes").eqNullSafe(F.col("base_size")), "identical").when(F.col("score") >= 0.7, "refined").otherwise("drift")
    told = cut(best.select("file_id", "base_id", "score", state.alias("state")))
    none = F.lit(None)
    new = a.select("file_id").join(told, "file_id", "left_anti").select("file_id", none.cast("long").alias("base_id"), none.cast("double").alias("score"), F.lit("new").alias("state"))
    deleted = b.select(F.col("file_id").alias("base_id")).join(told, "base_id", "left_anti").select(none.cast("long").alias("file_id"), "base_id", none.cast("double").alias("score"), F.lit("deleted").alias("state"))
    return told.unionByName(new).unionByName(deleted)


# Signals, bindings and integrity

_LAST = f"(SELECT max(indexed_at) - INTERVAL 60 DAY FROM {FILE})"


@query(f"""SELECT * FROM (SELECT project_key, file_id, n_dependents, n_findings, score, CASE WHEN n_findings > 0 AND n_dependents >= 10 THEN 'fix_first' WHEN n_dependents >= 10 THEN 'review' WHEN n_findings > 0 THEN 'tidy' ELSE 'watch' END AS lane,
    row_number() OVER (PARTITION BY project_key ORDER BY score DESC, file_id)::INTEGER AS halo_rank FROM (SELECT f.project_key, f.file_id, coalesce(i.n, 0) AS n_dependents, coalesce(x.n, 0) AS n_findings, coalesce(i.n, 0) * 2.0::DOUBLE + least(coalesce(x.n, 0) * 5.0::DOUBLE, 20.0::DOUBLE) AS score
    FROM {FILE} f LEFT JOIN (SELECT dst, count(*) AS n FROM {EDGE} GROUP BY 1) i ON i.dst = f.file_id LEFT JOIN (SELECT project, path, count(*) AS n FROM {_FINDING} GROUP BY 1, 2) x ON x.project = f.project_key AND x.path = f.rel_path WHERE f.indexed_at >= {_LAST})) WHERE halo_rank <= 3""")
def change_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the last sixty days with their dependents and findings; the three with the most weight of each project."""
    last = files(spark, folder).agg((F.max("indexed_at") - F.expr("interval 60 days"))).scalar()
    changed = files(spark, folder).where(F.col("indexed_at") >= last)
    n = edges(spark, folder).groupBy(F.col("dst").alias("file_id")).agg(F.count(F.lit(1)).alias("n_dependents"))
    hits = found(spark, folder).groupBy(F.col("project").alias("project_key"), F.col("path").alias("rel_path")).agg(F.count(F.lit(1)).alias("n_findings"))
    rows = changed.join(n, "file_id", "left").join(hits, ["project_key", "rel_path"], "left").fillna(0, ["n_dependents", "n_findings"])
    many, bad = F.col("n_dependents") >= 10, F.col("n_findings") > 0
    lane = F.when(bad & many, "fix_first").when(many, "review").when(bad, "tidy").otherwise("watch")
    rows = rows.withColumn("score", F.col("n_dependents") * 2.0 + capped(F.col("n_findings"), 5, 20)).withColumn("lane", lane)
    rows = rows.select("project_key", "file_id", "n_dependents", "n_findings", "score", "lane")
    return rel.top_k_per_group(rows, ["project_key"], [F.desc("score"), F.col("file_id")], 3, "halo_rank")


@query(f"""SELECT e.name, CASE WHEN i.n IS NULL THEN 'unbound' ELSE 'bound' END AS state, coalesce(i.n, 0) AS n_users FROM (SELECT DISTINCT name FROM {EXPORT}) e
    LEFT JOIN (SELECT key, count(*) AS n FROM (SELECT DISTINCT project_key, rel_path, lower(split_part(regexp_replace(s, '^[./@]+', ''), '/', 1)) AS key FROM (SELECT project_key, rel_path, unnest(from_json(json_extract(payload, '$.imports'), '["VARCHAR"]')) AS s FROM {PAYLOAD})) GROUP BY 1) i ON i.key = lower(regexp_extract(e.name, '^[A-Z][a-z]+'))""")
def port_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """Exported names against the files whose import lists name their first word; those that nobody names are unbound."""
    key = F.lower(F.split(F.regexp_replace("s", r"^[./@]+", ""), "/")[0])
    lists = records(spark, folder).select("project_key", "rel_path", F.explode(F.from_json("payload", "imports array<string>")["imports"]).alias("s"))
    users = lists.select("project_key", "rel_path", key.alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_users"))
    names = exports(spark, folder).select("name", F.lower(F.regexp_extract("name", "^[A-Z][a-z]+", 0)).alias("key")).distinct()
    return names.join(users, "key", "left").select("name", F.when(F.col("n_users").isNull(), "unbound").otherwise("bound").alias("state"), F.coalesce("n_users", F.lit(0)).alias("n_users"))


@query(f"""WITH RECURSIVE proxy AS (SELECT DISTINCT source_file_id AS src, target_file_id AS dst FROM dependencies WHERE {KIND} IN ('reexport', 'reexport_all') AND source_file_id <> target_file_id AND source_file_id IN (SELECT file_id FROM files) AND target_file_id IN (SELECT file_id FROM files)),
    open(node) AS (SELECT file_id FROM {FILE} WHERE regexp_matches(rel_path, '(^|/)index\\.[jt]sx?$') UNION SELECT dst FROM open JOIN proxy ON src = node) SELECT node FROM open""")
def public_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Files that re-exports make reachable from an index file."""
    links = table(spark, folder, "dependencies").where(kind().isin("reexport", "reexport_all")).select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    f = files(spark, folder)
    proxies = graph.build_edges(links, f.select(F.col("file_id").alias("node")))[0]
    return graph.propagate(f.where(F.col("rel_path").rlike(r"(^|/)index\.[jt]sx?$")).select(F.col("file_id").alias("node")), proxies)


@query(f"""SELECT n.rule, n.project, n.path, n.detail, CASE WHEN o.file_id IS NULL THEN 'new' ELSE 'existing' END AS state FROM {_FINDING} n
    LEFT JOIN (SELECT DISTINCT project_key, rel_path, 1 AS file_id FROM {FILE} WHERE indexed_at < {_LAST}) o ON o.project_key = n.project AND o.rel_path = n.path""")
def violation_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Findings on files of the last sixty days are new, the others were there before."""
    last = files(spark, folder).agg((F.max("indexed_at") - F.expr("interval 60 days"))).scalar()
    old = files(spark, folder).where(F.col("indexed_at") < last).select(F.col("project_key").alias("project"), F.col("rel_path").alias("path")).distinct().withColumn("old", F.lit(True))
    rows = found(spark, folder).join(old, ["project", "path"], "left")
    return rows.select("rule", "project", "path", "detail", F.when(F.col("old"), "existing").otherwise("new").alias("state"))


@query(f"""SELECT file_id, count(*) OVER (PARTITION BY project_key, regexp_replace(rel_path, '/?[^/]*$', '')) - 1 AS n_neighbours, count(*) OVER (PARTITION BY project_key, regexp_replace(rel_path, '/?[^/]*$', ''), language) - 1 AS n_same_language FROM {FILE}""")
def directory_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """How many files share a directory with each; counted by directory, then joined back."""
    f = files(spark, folder).withColumn("dir", paths.dirname(F.col("rel_path"))).withColumn("lang", F.coalesce("language", F.lit("?")))
    by = lambda keys, name: f.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias(name))
    return (
        f.join(by(["project_key", "dir"], "n_neighbours"), ["project_key", "dir"])
        .join(by(["project_key", "dir", "lang"], "n_same_language"), ["project_key", "dir", "lang"])
        .select("file_id", "n_neighbours", "n_same_language")
    )


@query(_OCCURRENCE)
def occurrence_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Density, decoupling and a digest of the structure of each source text."""
    rows = table(spark, folder, "source_records").select("record_id", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null").distinct()
    bare = scans.without_comments(F.col("text"))
    hits = F.regexp_count(bare, F.lit(r"\b(if|for|while|return|await|async|yield|match|switch|try)\b"))
    leaks = F.regexp_count(bare, F.lit(r"\b(global|window|document|process\.env|os\.environ|print|console\.log)\b"))
    shape = F.md5(F.regexp_replace(F.regexp_replace(bare, r"[A-Za-z_]\w*", "w"), r"\s+", " "))
    return rows.select("record_id", hits.alias("density"), F.greatest(F.lit(0), 100 - leaks * 10).alias("decoupling"), shape.alias("dna"))


@query(_DECLARED)
def polyglot_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations by the form of each language, without parsing."""
    rows = table(spark, folder, "source_records").select(
        "record_id", paths.language_of(F.col("relative_path")).alias("language"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")
    ).where("text is not null").distinct()
    return scans.declared_symbols(rows)


@query("""SELECT 'documents' AS store, count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys FROM documents UNION ALL SELECT 'files', count(*), count(DISTINCT file_id) FROM files
    UNION ALL SELECT 'dependencies', count(*), count(DISTINCT dep_id) FROM dependencies UNION ALL SELECT 'staging', count(*), count(DISTINCT (project_key, rel_path)) FROM atlas_staging_files""")
def store_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and keys of each store; repeated rows show as the difference."""
    parts = [("documents", "documents", ["doc_id"]), ("files", "files", ["file_id"]), ("dependencies", "dependencies", ["dep_id"]), ("staging", "atlas_staging_files", ["project_key", "rel_path"])]
    out = None
    for store, name, keys in parts:
        one = table(spark, folder, name).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys")).select(F.lit(store).alias("store"), "n_rows", "n_keys")
        out = one if out is None else out.unionByName(one)
    return out
