"""Queries on symbols: consumption closed over re-exports, dead symbols, closures, search and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.scores import band
from codestrata.operators import graph
from codestrata.operators import relational as rel
from codestrata.plans.common import EDGE, EXPORT, FILE, KIND, NORM, edges, exports, files, kind, records
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


WHOLE = ("namespace", "require", "dynamic")  # imports that use all that a file exports
ALLOWED = ("main", "setup", "default", "handler")  # names that something outside calls

#: Names that a file's own scan found in it.
SCAN = f"""(SELECT DISTINCT project_key, {NORM} AS rel_path, unnest(from_json(json_extract(payload, '$.symbols'), '["VARCHAR"]')) AS name FROM atlas_staging_files WHERE stage_kind = 'symbol_scan')"""
#: Exports of files that the index has.
OWN = f"(SELECT DISTINCT f.file_id AS node, e.name FROM {EXPORT} e JOIN {FILE} f ON f.project_key = e.project_key AND f.rel_path = e.rel_path)"
_USED = f"(SELECT DISTINCT f.file_id AS node, s.name FROM {SCAN} s JOIN {FILE} f ON f.project_key = s.project_key AND f.rel_path = s.rel_path)"
_LINK = f"(SELECT DISTINCT e.src, e.dst, d.kind FROM {EDGE} e JOIN (SELECT source_file_id AS src, target_file_id AS dst, coalesce({KIND}, 'unknown') AS kind FROM dependencies) d ON d.src = e.src AND d.dst = e.dst)"
_CONSUMED = f"""(WITH RECURSIVE link AS {_LINK}, own AS {OWN}, used AS {_USED}, first(node, name) AS (
        SELECT l.dst, o.name FROM link l JOIN own o ON o.node = l.dst WHERE l.kind IN {WHOLE} UNION SELECT l.dst, u.name FROM link l JOIN used u ON u.node = l.src WHERE l.kind NOT IN ('type', 'side_effect')),
    consumed(node, name) AS (SELECT node, name FROM first UNION SELECT l.dst, c.name FROM consumed c JOIN link l ON l.src = c.node WHERE l.kind IN ('reexport', 'reexport_all'))
    SELECT DISTINCT c.node, c.name FROM consumed c JOIN own o ON o.node = c.node AND o.name = c.name)"""


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "atlas_staging_files").where("stage_kind = 'symbol_scan'")
    names = F.explode(F.from_json("payload", "symbols array<string>")["symbols"]).alias("name")
    return rows.select("project_key", paths.normalized(F.col("rel_path")).alias("rel_path"), names).distinct()


def owned(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """node, name of rows (project_key, rel_path, name) whose file the index has."""
    return rows.join(files(spark, folder).select("project_key", "rel_path", "file_id"), ["project_key", "rel_path"]).select(F.col("file_id").alias("node"), "name").distinct()


def consumed(spark: SparkSession, folder: str) -> DataFrame:
    """node, name of the exports that an import uses, itself or over re-exports."""
    d = table(spark, folder, "dependencies").select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"), F.coalesce(kind(), F.lit("unknown")).alias("kind"))
    link = cut(d.distinct().join(edges(spark, folder), ["src", "dst"], "left_semi"))
    own, used = cut(owned(spark, folder, exports(spark, folder))), owned(spark, folder, scanned(spark, folder))
    whole = link.where(F.col("kind").isin(*WHOLE)).select(F.col("dst").alias("node")).distinct().join(own, "node")
    named = link.where(~F.col("kind").isin("type", "side_effect")).join(used.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "name").distinct()
    proxies = link.where(F.col("kind").isin("reexport", "reexport_all")).select("src", "dst").distinct()
    return graph.propagate_names(whole.unionByName(named), proxies).join(own, ["node", "name"], "left_semi")


@query(f"SELECT node AS file_id, name FROM {_CONSUMED}")
def consumed_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return consumed(spark, folder).select(F.col("node").alias("file_id"), "name")


_RULES = [
    ("allowed_name", "e.name IN {}".format(ALLOWED)),
    ("unknown_file", "f.file_id IS NULL"),
    ("removed_file", "NOT f.present"),
    ("barrel", r"regexp_matches(e.rel_path, '(^|/)(index\.[jt]sx?|__init__\.py)$')"),
    ("entry_point", r"regexp_matches(e.rel_path, '(^|/)(main|app|server|cli)\.[a-z]+$')"),
    ("test", "contains('/' || e.rel_path || '/', '/tests/')"),
    ("declaration", r"regexp_matches(e.rel_path, '\.(d\.ts|pyi)$')"),
    ("generated", r"regexp_matches(e.rel_path, '(^|/)(__generated__|generated|dist)/')"),
    ("tooling", "contains('/' || e.rel_path || '/', '/tools/')"),
    ("consumed", "c.name IS NOT NULL"),
    ("collision", "n.n > 1"),
]
_DEAD = f"""(SELECT e.project_key, e.rel_path, e.name, reason, CASE WHEN reason <> 'candidate' THEN NULL WHEN base = 'HIGH' AND (regexp_full_match(name, '[A-Z0-9_]+') OR regexp_matches(rel_path, '\\.[jt]sx$')) THEN 'MEDIUM' ELSE base END AS confidence FROM (
    SELECT e.project_key, e.rel_path, e.name, CASE {' '.join(f"WHEN {c} THEN '{r}'" for r, c in _RULES)} ELSE 'candidate' END AS reason, CASE WHEN u.name IS NOT NULL THEN 'LOW' WHEN i.dst IS NOT NULL THEN 'MEDIUM' ELSE 'HIGH' END AS base
    FROM {EXPORT} e LEFT JOIN (SELECT project_key, rel_path, min(file_id) AS file_id, bool_or(present) AS present FROM {FILE} GROUP BY 1, 2) f ON f.project_key = e.project_key AND f.rel_path = e.rel_path
    LEFT JOIN {_CONSUMED} c ON c.node = f.file_id AND c.name = e.name LEFT JOIN (SELECT DISTINCT dst FROM {EDGE}) i ON i.dst = f.file_id LEFT JOIN (SELECT DISTINCT name FROM {SCAN}) u ON u.name = e.name
    LEFT JOIN (SELECT project_key, name, count(*) AS n FROM {EXPORT} GROUP BY 1, 2) n ON n.project_key = e.project_key AND n.name = e.name) e)"""


def dead(spark: SparkSession, folder: str) -> DataFrame:
    e = exports(spark, folder)
    f = files(spark, folder).groupBy("project_key", "rel_path").agg(F.min("file_id").alias("file_id"), F.bool_or("present").alias("present"))
    is_used = consumed(spark, folder).select(F.col("node").alias("file_id"), "name", F.lit(True).alias("is_consumed"))
    imported = edges(spark, folder).select(F.col("dst").alias("file_id")).distinct().withColumn("is_imported", F.lit(True))
    elsewhere = scanned(spark, folder).select("name").distinct().withColumn("is_named", F.lit(True))
    n = e.groupBy("project_key", "name").agg(F.count(F.lit(1)).alias("n_files"))
    rows = e.join(f, ["project_key", "rel_path"], "left").join(is_used, ["file_id", "name"], "left").join(imported, "file_id", "left").join(elsewhere, "name", "left").join(n, ["project_key", "name"], "left")
    p = F.col("rel_path")
    reason = rel.first_rule(
        rows,
        [
            ("allowed_name", F.col("name").isin(*ALLOWED)), ("unknown_file", F.col("file_id").isNull()), ("removed_file", ~F.col("present")),
            ("barrel", p.rlike(r"(^|/)(index\.[jt]sx?|__init__\.py)$")), ("entry_point", p.rlike(r"(^|/)(main|app|server|cli)\.[a-z]+$")), ("test", paths.has_fragment(p, "tests")),
            ("declaration", p.rlike(r"\.(d\.ts|pyi)$")), ("generated", p.rlike("(^|/)(__generated__|generated|dist)/")), ("tooling", paths.has_fragment(p, "tools")),
            ("consumed", F.col("is_consumed")), ("collision", F.col("n_files") > 1),
        ],
        "candidate",
    )
    base = F.when(F.col("is_named"), "LOW").when(F.col("is_imported"), "MEDIUM").otherwise("HIGH")
    softer = F.col("name").rlike("^[A-Z0-9_]+$") | p.rlike(r"\.[jt]sx$")
    rows = rows.withColumn("reason", reason).withColumn("confidence", F.when(F.col("reason") != "candidate", None).when((base == "HIGH") & softer, "MEDIUM").otherwise(base))
    return rows.select("project_key", "rel_path", "name", "reason", "confidence")


@query(f"SELECT * FROM {_DEAD}")
def dead_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Every export with the first exclusion that holds (an allow list first), and how sure it is that the others are dead."""
    return dead(spark, folder)


@query(f"""SELECT project_key, confidence, CASE confidence WHEN 'HIGH' THEN 'remove' WHEN 'MEDIUM' THEN 'review' ELSE 'keep' END AS action, count(*) AS n, min(name) AS first_name FROM {_DEAD} WHERE reason = 'candidate' GROUP BY 1, 2, 3""")
def dead_symbol_actions(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("confidence")
    rows = dead(spark, folder).where("reason = 'candidate'").groupBy("project_key", "confidence").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))
    return rows.select("project_key", "confidence", F.when(c == "HIGH", "remove").when(c == "MEDIUM", "review").otherwise("keep").alias("action"), "n", "first_name")


_CERTAINTY = f"""(SELECT project_key, count(*) AS n_exports, count(*) FILTER (reason = 'candidate') AS n_candidates, count(*) FILTER (confidence = 'HIGH') AS n_high FROM {_DEAD} GROUP BY 1)"""
_STATE = f"""(SELECT project_key, count(*) AS n_paths, count(*) FILTER (b IS NULL OR a IS NULL OR a <> b) AS n_changed FROM (SELECT coalesce(x.project_key, y.project_key) AS project_key, x.v AS b, y.v AS a FROM
    (SELECT project_key, {NORM} AS rel_path, max(size_bytes) AS v FROM atlas_staging_files WHERE stage_kind = 'atlas_record' GROUP BY 1, 2) x FULL JOIN (SELECT project_key, rel_path, max(size_bytes) AS v FROM {FILE} GROUP BY 1, 2) y ON x.project_key = y.project_key AND x.rel_path = y.rel_path) GROUP BY 1)"""


@query(f"""SELECT c.project_key, coalesce(n_high::DOUBLE / nullif(n_candidates, 0), 0.0) AS certainty, coalesce(n_changed::DOUBLE / n_paths, 0.0) AS drift, CASE WHEN coalesce(n_changed::DOUBLE / n_paths, 0.0) >= 0.5 THEN 'unsure'
    WHEN coalesce(n_high::DOUBLE / nullif(n_candidates, 0), 0.0) >= 0.6 THEN 'sure' ELSE 'likely' END AS verdict, rank() OVER (ORDER BY coalesce(n_changed::DOUBLE / n_paths, 0.0), c.project_key)::INTEGER AS safety_rank
    FROM {_CERTAINTY} c LEFT JOIN {_STATE} s ON s.project_key = c.project_key WHERE c.project_key IS NOT NULL""")
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    """How sure the findings on each project are: certainty of its dead symbols, drift of its index against what was staged, a rank and a verdict."""
    from pyspark.sql import Window

    dead_ = dead(spark, folder).where("project_key is not null").groupBy("project_key").agg(F.count_if(F.col("reason") == "candidate").alias("n_candidates"), F.count_if(F.col("confidence") == "HIGH").alias("n_high"))
    keys = ["project_key", "rel_path"]
    diff = rel.full_diff(records(spark, folder).groupBy(*keys).agg(F.max("size_bytes").alias("v")), files(spark, folder).groupBy(*keys).agg(F.max("size_bytes").alias("v")), keys, "v")
    changed = (F.col("state") != "unchanged") | F.col("before").isNull()
    state = diff.groupBy("project_key").agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(changed).alias("n_changed"))
    rows = dead_.join(state, "project_key", "left").select(
        "project_key", F.coalesce(F.try_divide("n_high", "n_candidates"), F.lit(0.0)).alias("certainty"), F.coalesce(F.try_divide("n_changed", "n_paths"), F.lit(0.0)).alias("drift")
    )
    verdict = F.when(F.col("drift") >= 0.5, "unsure").when(F.col("certainty") >= 0.6, "sure").otherwise("likely")
    return rows.select("project_key", "certainty", "drift", verdict.alias("verdict"), F.rank().over(Window.orderBy("drift", "project_key")).alias("safety_rank"))  # a row a project


_REF = f"(SELECT DISTINCT o.name AS src, u.name AS dst FROM {OWN} o JOIN {_USED} u ON u.node = o.node WHERE o.name <> u.name)"
_HUB_NAME = f"(SELECT src AS name FROM {_REF} GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def references(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst: names that a file exports, and the names that it refers to."""
    own, used = owned(spark, folder, exports(spark, folder)), owned(spark, folder, scanned(spark, folder))
    return own.withColumnRenamed("name", "src").join(used.withColumnRenamed("name", "dst"), "node").where("src <> dst").select("src", "dst").distinct()


@query(f"""WITH RECURSIVE ref AS {_REF}, walk(name, depth) AS (SELECT name, 0 FROM {_HUB_NAME} UNION SELECT dst, depth + 1 FROM walk JOIN ref ON src = name WHERE depth < 4), home AS (SELECT DISTINCT project_key FROM {EXPORT} WHERE name IN (SELECT name FROM {_HUB_NAME}))
    SELECT w.name, w.depth, CASE WHEN bool_or(e.project_key IN (SELECT project_key FROM home)) THEN 'internal' WHEN count(e.name) > 0 THEN 'sibling' ELSE 'external' END AS place
    FROM (SELECT name, min(depth) AS depth FROM walk GROUP BY 1) w LEFT JOIN {EXPORT} e ON e.name = w.name GROUP BY 1, 2""")
def symbol_closure(spark: SparkSession, folder: str) -> DataFrame:
    """All that the name with the most references refers to, over up to four steps, and where each is defined: in its own project, in another, or nowhere."""
    ref = cut(references(spark, folder))
    start = ref.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("node"))
    found = graph.reach(ref, start, 4).withColumnRenamed("node", "name")
    e = exports(spark, folder)
    home = e.join(start.withColumnRenamed("node", "name"), "name", "left_semi").select("project_key").distinct().withColumn("home", F.lit(True))
    homes = e.join(home, "project_key", "left").groupBy("name").agg(F.max(F.coalesce("home", F.lit(False))).alias("inside"))
    return found.join(homes, "name", "left").select("name", "depth", F.when(F.col("inside"), "internal").when(F.col("inside").isNotNull(), "sibling").otherwise("external").alias("place"))


TERMS = ("gate", "ThreadStore", "LEDGER", "map", "Straße")
_FOLD = "replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ')"
_NAME_TOKENS = "list_transform(regexp_extract_all(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"
_SEARCHED = f"(SELECT DISTINCT 'export' AS kind, project_key, rel_path, name FROM {EXPORT} UNION SELECT DISTINCT 'symbol', project_key, rel_path, name FROM {SCAN})"


@query(f"""SELECT term, kind, name, project_key, rel_path, score, k::INTEGER AS rank, n > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY term, kind ORDER BY score, name, project_key, rel_path) AS k, count(*) OVER (PARTITION BY term, kind) AS n FROM (
    SELECT t.term, kind, name, project_key, rel_path, CASE WHEN {_FOLD.format('name')} = t.f THEN 0 WHEN list_contains({_NAME_TOKENS}, t.f) THEN 1 WHEN starts_with({_FOLD.format('name')}, t.f) THEN 3 WHEN contains({_FOLD.format('name')}, t.f) THEN 5 END AS score
    FROM {_SEARCHED}, (SELECT unnest({list(TERMS)}) AS term, {_FOLD.format(f'unnest({list(TERMS)})')} AS f) t) WHERE score IS NOT NULL) WHERE k <= 5""")
def search_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Terms over exports and scanned symbols, in folded case: exact 0, whole word 1, prefix 3, part 5; five of each kind."""
    rows = exports(spark, folder).withColumn("kind", F.lit("export")).unionByName(scanned(spark, folder).withColumn("kind", F.lit("symbol")))
    rows = rows.withColumn("folded", paths.folded_case(F.col("name"))).withColumn("words", paths.identifier_tokens(F.col("name")))
    terms = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), paths.folded_case(F.lit(t)).alias("f")) for t in TERMS]))
    rows = rows.withColumn("t", terms)
    f = F.col("t.f")
    score = F.when(F.col("folded") == f, 0).when(F.array_contains("words", f), 1).when(F.startswith("folded", f), 3).when(F.contains("folded", f), 5)
    hits = cut(rows.select("t.term", "kind", "name", "project_key", "rel_path", score.alias("score")).where("score is not null"))
    n = hits.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = rel.top_k_per_group(hits, ["term", "kind"], [F.col("score"), F.col("name"), F.col("project_key"), F.col("rel_path")], 5)
    return top.join(n, ["term", "kind"]).select("term", "kind", "name", "project_key", "rel_path", "score", "rank", (F.col("n") > 5).alias("truncated"))


@query(f"""SELECT f.file_id, f.project_key, f.rel_path, coalesce(e.n, 0) AS n_exports, coalesce(o.n, 0) AS n_imports, coalesce(i.n, 0) AS n_importers, coalesce(s.n, 0) AS n_symbols FROM {FILE} f
    LEFT JOIN (SELECT node, count(*) AS n FROM {OWN} GROUP BY 1) e ON e.node = f.file_id LEFT JOIN (SELECT node, count(*) AS n FROM {_USED} GROUP BY 1) s ON s.node = f.file_id
    LEFT JOIN (SELECT src, count(*) AS n FROM {EDGE} GROUP BY 1) o ON o.src = f.file_id LEFT JOIN (SELECT dst, count(*) AS n FROM {EDGE} GROUP BY 1) i ON i.dst = f.file_id""")
def inspect_files(spark: SparkSession, folder: str) -> DataFrame:
    """A card for each file: its exports, scanned symbols, imports and importers."""
    n = lambda df, name: df.groupBy("node").agg(F.count(F.lit(1)).alias(name)).withColumnRenamed("node", "file_id")
    ends = graph.degrees(edges(spark, folder)).select(F.col("node").alias("file_id"), F.col("n_out").alias("n_imports"), F.col("n_in").alias("n_importers"))
    rows = files(spark, folder).select("file_id", "project_key", "rel_path").join(n(owned(spark, folder, exports(spark, folder)), "n_exports"), "file_id", "left").join(ends, "file_id", "left")
    rows = rows.join(n(owned(spark, folder, scanned(spark, folder)), "n_symbols"), "file_id", "left")
    return rows.fillna(0, ["n_exports", "n_imports", "n_importers", "n_symbols"]).select("file_id", "project_key", "rel_path", "n_exports", "n_imports", "n_importers", "n_symbols")


@query(f"""SELECT project_key, regexp_replace(rel_path, '/?[^/]*$', '') AS folder, count(*) AS n_files, sum(size_bytes)::BIGINT AS size_bytes, count(DISTINCT language) AS n_languages, min(regexp_extract(rel_path, '[^/]*$')) AS first_file, max(indexed_at) AS last_at FROM {FILE} GROUP BY 1, 2""")
def inspect_folders(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder)
    return f.groupBy("project_key", paths.dirname(F.col("rel_path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.count_distinct("language").alias("n_languages"), F.min(paths.basename(F.col("rel_path"))).alias("first_file"), F.max("indexed_at").alias("last_at")
    )


@query(f"""SELECT e.name, count(DISTINCT (e.project_key, e.rel_path)) AS n_exporters, count(DISTINCT s.project_key || '|' || s.rel_path) AS n_scans FROM {EXPORT} e LEFT JOIN {SCAN} s ON s.name = e.name GROUP BY 1""")
def inspect_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Where each exported name is exported and scanned; counted on either side before they are joined."""
    e = exports(spark, folder).groupBy("name").agg(F.count(F.lit(1)).alias("n_exporters"))
    s = scanned(spark, folder).where("project_key is not null and rel_path is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n_scans"))
    return e.join(s, "name", "left").fillna(0, ["n_scans"])


_MIN_PAIR = "lower(regexp_replace(regexp_extract(rel_path, '[^/]*$'), '\\.[^.]*$', ''))"


@query(f"""SELECT stem, count(*) AS n_files, min(a.size_bytes)::DOUBLE / nullif(max(a.size_bytes), 0) AS least_ratio, CASE WHEN min(a.size_bytes)::DOUBLE / nullif(max(a.size_bytes), 0) >= 0.95 THEN 'alike' WHEN min(a.size_bytes)::DOUBLE / nullif(max(a.size_bytes), 0) >= 0.5 THEN 'near' ELSE 'apart' END AS band
    FROM (SELECT {_MIN_PAIR} AS stem, size_bytes FROM {FILE} WHERE size_bytes IS NOT NULL) a GROUP BY stem HAVING count(*) > 1""")
def least_pair_score(spark: SparkSession, folder: str) -> DataFrame:
    """The least likeness in size of any two files of a name: that of the smallest and the largest, so that no pair is built."""
    f = files(spark, folder).where("size_bytes is not null").groupBy(F.lower(paths.stem(F.col("rel_path"))).alias("stem")).agg(
        F.count(F.lit(1)).alias("n_files"), F.try_divide(F.min("size_bytes").cast("double"), F.max("size_bytes")).alias("least_ratio")
    )
    return f.where("n_files > 1").withColumn("band", F.when(F.col("least_ratio") >= 0.95, "alike").when(F.col("least_ratio") >= 0.5, "near").otherwise("apart"))


@query(f"""WITH RECURSIVE e AS {EDGE}, node AS (SELECT file_id AS node FROM {FILE}), self AS (SELECT DISTINCT source_file_id AS node FROM dependencies WHERE source_file_id = target_file_id AND source_file_id IN (SELECT file_id FROM files)),
    pair(origin, node) AS (SELECT src, dst FROM e UNION SELECT pair.origin, e.dst FROM pair JOIN e ON e.src = pair.node), comp AS (SELECT origin AS node, max(p.node) AS component FROM pair p WHERE EXISTS (SELECT 1 FROM pair q WHERE q.origin = p.node AND q.node = p.origin) GROUP BY origin HAVING count(*) > 1)
    SELECT n.node AS file_id, coalesce(c.component, s.node) AS component, s.node IS NOT NULL AS self_loop, coalesce(i.n, 0) AS n_importers, CASE WHEN c.node IS NOT NULL THEN 'cycle' WHEN s.node IS NOT NULL THEN 'self' WHEN i.n IS NULL THEN 'unimported' ELSE 'clear' END AS advice
    FROM node n LEFT JOIN comp c ON c.node = n.node LEFT JOIN self s ON s.node = n.node LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON i.dst = n.node""")
def graph_advisories(spark: SparkSession, folder: str) -> DataFrame:
    """Each file with its component (self loops are components too), its importers and what the graph advises."""
    links = table(spark, folder, "dependencies").select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    e, loops = graph.build_edges(links, table(spark, folder, "files").select(F.col("file_id").alias("node")))
    e = cut(e)
    found = graph.components(e.unionByName(loops), loops=True).withColumnRenamed("node", "file_id")
    self_ = loops.select(F.col("src").alias("file_id"), F.lit(True).alias("self_loop"))
    n = e.groupBy(F.col("dst").alias("file_id")).agg(F.count(F.lit(1)).alias("n_importers"))
    rows = files(spark, folder).select("file_id").join(found, "file_id", "left").join(self_, "file_id", "left").join(n, "file_id", "left")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(sizes, "component", "left")
    advice = F.when(F.col("size") > 1, "cycle").when(F.col("self_loop"), "self").when(F.col("n_importers").isNull(), "unimported").otherwise("clear")
    return rows.select("file_id", "component", F.coalesce("self_loop", F.lit(False)).alias("self_loop"), F.coalesce("n_importers", F.lit(0)).alias("n_importers"), advice.alias("advice"))
