"""Queries of the relational operators: filters, joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.scores import band, capped, ratio
from codestrata.operators import relational as rel
from codestrata.plans.common import EDGE, EXPORT, FILE, KIND, PAYLOAD, edges, exports, files, kind, payloads, records
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


# Filters and predicates

WANTED = ("ORBIT_WEB", "AMBER_LEDGER", "NOT_THERE")


@query(f"""SELECT w.project_key, CASE WHEN p.project_key IS NULL THEN 'unavailable' ELSE 'kept' END AS status, coalesce(n, 0) AS n_files
    FROM (SELECT unnest({list(WANTED)}) AS project_key) w LEFT JOIN projects p USING (project_key)
    LEFT JOIN (SELECT project_key, count(*) AS n FROM {FILE} GROUP BY 1) f ON f.project_key = w.project_key""")
def filter_projects(spark: SparkSession, folder: str) -> DataFrame:
    wanted = spark.createDataFrame([(w,) for w in WANTED], "project_key string")
    known = table(spark, folder, "projects").select("project_key", F.lit(True).alias("known"))
    n = files(spark, folder).groupBy("project_key").agg(F.count(F.lit(1)).alias("n_files"))
    status = F.when(F.col("known").isNull(), "unavailable").otherwise("kept")
    return wanted.join(known, "project_key", "left").join(n, "project_key", "left").select("project_key", status.alias("status"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


@query(f"SELECT file_id, rel_path FROM {FILE} WHERE contains('/' || rel_path || '/', '/src/components/')")
def filter_path_fragment(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).where(paths.has_fragment(F.col("rel_path"), "src/components")).select("file_id", "rel_path")


@query(f"SELECT file_id, rel_path FROM {FILE} WHERE rel_path GLOB 'src/*View*.tsx'")
def filter_glob(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).where(F.col("rel_path").rlike(paths.glob_regex("src/*View*.tsx"))).select("file_id", "rel_path")


LAYERS = (("ui", "components"), ("ui", "hooks"), ("domain", "features"), ("server", "server"), ("server", "services"), ("tests", "tests"), ("tools", "tools"))


@query(f"""SELECT CASE {' '.join(f"WHEN contains('/' || rel_path || '/', '/{f}/') THEN '{n}'" for n, f in LAYERS)} ELSE 'unknown' END AS layer,
    project_key, count(*) AS n_files, sum(size_bytes)::BIGINT AS size_bytes FROM {FILE} GROUP BY 1, 2""")
def layer_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """The first rule that fits names the layer."""
    f = files(spark, folder)
    layer = rel.first_rule(f, [(n, paths.has_fragment(F.col("rel_path"), x)) for n, x in LAYERS], "unknown")
    return f.groupBy(layer.alias("layer"), "project_key").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


@query(f"""SELECT project_key, count(*) FILTER (regexp_matches(rel_path, '(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*\\.py$|_test\\.(py|go)$|\\.(test|spec)\\.[jt]sx?$|Tests?\\.(java|cs)$')) AS n_tests,
    count(*) AS n_files FROM {FILE} GROUP BY 1""")
def test_path_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).groupBy("project_key").agg(F.count_if(paths.is_test(F.col("rel_path"))).alias("n_tests"), F.count(F.lit(1)).alias("n_files"))


@query(f"""SELECT reason, count(*) AS n_files FROM (SELECT CASE WHEN language IS NULL THEN 'no_language' WHEN language = 'css' THEN 'not_code'
    WHEN hash IS NULL THEN 'no_hash' WHEN size_bytes > 60000 THEN 'too_large' ELSE 'accepted' END AS reason FROM {FILE}) GROUP BY reason""")
def signal_file_filter(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder)
    reason = rel.first_rule(
        f,
        [("no_language", F.col("language").isNull()), ("not_code", F.col("language") == "css"), ("no_hash", F.col("hash").isNull()), ("too_large", F.col("size_bytes") > 60000)],
        "accepted",
    )
    return f.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


@query(f"SELECT coalesce({KIND}, 'unknown') AS kind, count(DISTINCT dep_id) AS n FROM dependencies WHERE {KIND} IS DISTINCT FROM 'type' GROUP BY 1")
def type_import_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "dependencies").where(~kind().eqNullSafe("type"))
    return d.groupBy(F.coalesce(kind(), F.lit("unknown")).alias("kind")).agg(F.count_distinct("dep_id").alias("n"))


@query(f"""SELECT project_key, rel_path, CASE WHEN contains('/' || rel_path || '/', '/server/') THEN '<hidden ' || length(payload) || '>' ELSE json_extract_string(payload, '$.head') END AS head FROM {PAYLOAD}""")
def restricted_content_mask(spark: SparkSession, folder: str) -> DataFrame:
    head = F.from_json("payload", "head string")["head"]
    hidden = F.concat(F.lit("<hidden "), F.length("payload").cast("string"), F.lit(">"))
    return payloads(spark, folder).select("project_key", "rel_path", F.when(paths.has_fragment(F.col("rel_path"), "server"), hidden).otherwise(head).alias("head"))


# Joins

@query(f"SELECT f.file_id, e.name FROM {FILE} f JOIN {EXPORT} e ON e.project_key = f.project_key AND e.rel_path = f.rel_path")
def join_file_exports(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).join(exports(spark, folder), ["project_key", "rel_path"]).select("file_id", "name")


@query(f"SELECT f.file_id, f.rel_path, count(*) AS n_links FROM {EDGE} e JOIN {FILE} f ON f.file_id = e.src GROUP BY 1, 2 ORDER BY n_links DESC, file_id LIMIT 5")
def join_top_out_degree(spark: SparkSession, folder: str) -> DataFrame:
    counts = edges(spark, folder).groupBy(F.col("src").alias("file_id")).agg(F.count(F.lit(1)).alias("n_links"))
    return counts.join(files(spark, folder).select("file_id", "rel_path"), "file_id").select("file_id", "rel_path", "n_links").orderBy(F.desc("n_links"), "file_id").limit(5)


@query(f"SELECT s.project_key, count(*) FILTER (f.file_id IS NULL) AS n_without, count(*) AS n_staged FROM (SELECT DISTINCT project_key, rel_path FROM {PAYLOAD}) s LEFT JOIN {FILE} f ON f.project_key = s.project_key AND f.rel_path = s.rel_path GROUP BY 1")
def join_left_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Staged files that didn't reach files, by project."""
    staged = records(spark, folder).select("project_key", "rel_path").distinct()
    f = files(spark, folder).select("project_key", "rel_path", "file_id")
    return staged.join(f, ["project_key", "rel_path"], "left").groupBy("project_key").agg(F.count_if(F.col("file_id").isNull()).alias("n_without"), F.count(F.lit(1)).alias("n_staged"))


@query(f"SELECT lower(p.type) AS type, f.language, count(*) AS n_exports FROM {FILE} f JOIN projects p ON p.project_key = f.project_key JOIN {EXPORT} e ON e.project_key = f.project_key AND e.rel_path = f.rel_path GROUP BY 1, 2")
def join_three_tables(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "projects").select("project_key", F.lower("type").alias("type"))
    return files(spark, folder).join(p, "project_key").join(exports(spark, folder), ["project_key", "rel_path"]).groupBy("type", "language").agg(F.count(F.lit(1)).alias("n_exports"))


@query(f"SELECT file_id FROM {FILE} WHERE file_id IN (SELECT dst FROM {EDGE})")
def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).select("file_id").join(edges(spark, folder).select(F.col("dst").alias("file_id")), "file_id", "left_semi")


@query(f"SELECT file_id, project_key FROM {FILE} WHERE file_id NOT IN (SELECT dst FROM {EDGE})")
def join_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nothing imports."""
    return files(spark, folder).select("file_id", "project_key").join(edges(spark, folder).select(F.col("dst").alias("file_id")), "file_id", "left_anti")


_STAGED_SIZE = f"(SELECT project_key, rel_path, max(size_bytes) AS v FROM {PAYLOAD} GROUP BY 1, 2)"
_FILE_SIZE = f"(SELECT project_key, rel_path, max(size_bytes) AS v FROM {FILE} GROUP BY 1, 2)"


@query(f"""SELECT coalesce(b.project_key, a.project_key) AS project_key, coalesce(b.rel_path, a.rel_path) AS rel_path, b.v AS before, a.v AS after,
    CASE WHEN b.project_key IS NULL THEN 'added' WHEN a.project_key IS NULL THEN 'removed' WHEN b.v IS NOT DISTINCT FROM a.v THEN 'unchanged' ELSE 'modified' END AS state
    FROM {_STAGED_SIZE} b FULL JOIN {_FILE_SIZE} a ON a.project_key = b.project_key AND a.rel_path = b.rel_path""")
def join_full_outer_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Staged files against indexed files."""
    keys = ["project_key", "rel_path"]
    before = records(spark, folder).groupBy(*keys).agg(F.max("size_bytes").alias("v"))
    after = files(spark, folder).groupBy(*keys).agg(F.max("size_bytes").alias("v"))
    return rel.full_diff(before, after, keys, "v")


_PERIOD_COUNT = "SELECT {kind} AS kind, count(DISTINCT dep_id) AS n FROM dependencies WHERE year(recorded_at) = {year} GROUP BY 1"


@query(f"""SELECT coalesce(a.kind, b.kind) AS kind, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta
    FROM (SELECT coalesce({KIND}, '?') AS kind, count(DISTINCT dep_id) AS n FROM dependencies WHERE year(recorded_at) = 2026 GROUP BY 1) a
    FULL JOIN (SELECT coalesce({KIND}, '?') AS kind, count(DISTINCT dep_id) AS n FROM dependencies WHERE year(recorded_at) = 2025 GROUP BY 1) b ON a.kind = b.kind""")
def join_key_union_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of import kinds of one year against the year before; a missing key counts 0."""
    d = table(spark, folder, "dependencies").select(F.coalesce(kind(), F.lit("?")).alias("kind"), "dep_id", F.year("recorded_at").alias("y"))
    n = lambda y, name: d.where(F.col("y") == y).groupBy("kind").agg(F.count_distinct("dep_id").alias(name))
    return n(2025, "before").join(n(2026, "after"), "kind", "full_outer").fillna(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


_IMPORT = f"""(SELECT DISTINCT project_key, rel_path, unnest(from_json(json_extract(payload, '$.imports'), '["VARCHAR"]')) AS name FROM {PAYLOAD})"""


@query(f"SELECT i.name, count(*) AS n_files FROM (SELECT project_key, rel_path, name FROM {_IMPORT}) i WHERE i.name IN (SELECT import_specifier FROM dependencies) GROUP BY 1")
def join_array_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Staged import lists against the specifiers that dependencies know."""
    lists = records(spark, folder).select("project_key", "rel_path", F.from_json("payload", "imports array<string>")["imports"].alias("imports"))
    known = table(spark, folder, "dependencies").select(F.col("import_specifier").alias("name")).where("name is not null").distinct()
    hits = rel.array_containment(lists, "imports", known, "name").select("project_key", "rel_path", "name").distinct()
    return hits.groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"""SELECT user_project, provider, count(*) AS n_names FROM (SELECT DISTINCT a.project_key AS user_project, b.project_key AS provider, a.name
    FROM {EXPORT} a JOIN (SELECT name, min(project_key) AS project_key FROM {EXPORT} GROUP BY 1) b ON a.name = b.name WHERE a.project_key <> b.project_key) GROUP BY 1, 2""")
def join_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Names against a registry of providers; a project doesn't provide for itself, each pair once."""
    e = exports(spark, folder)
    registry = e.groupBy("name").agg(F.min("project_key").alias("provider"))
    pairs = e.join(registry, "name").where("provider <> project_key").select(F.col("project_key").alias("user_project"), "provider", "name").distinct()
    return pairs.groupBy("user_project", "provider").agg(F.count(F.lit(1)).alias("n_names"))


_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js")
_PLACED = f"""(SELECT DISTINCT dep_id, project_key, CASE WHEN form = 'alias' THEN ['src/' || rest, rest] WHEN len(dir) >= up THEN [array_to_string(list_concat(dir[:len(dir) - up], [rest]), '/')] ELSE [] END AS stems FROM (
    SELECT x.dep_id, s.project_key, string_split(s.rel_path, '/')[:-2] AS dir, CASE WHEN regexp_matches(import_specifier, '^[@~]/') THEN 'alias' ELSE 'relative' END AS form,
        (len(regexp_extract_all(regexp_extract(import_specifier, '^([.]{{1,2}}/)+'), '[.][.]/')))::BIGINT AS up, regexp_replace(import_specifier, '^([.]{{1,2}}/|[@~]/)+', '') AS rest
    FROM dependencies x JOIN {FILE} s ON s.file_id = x.source_file_id WHERE regexp_matches(import_specifier, '^([.]{{1,2}}|[@~])/')))"""


@query(f"""SELECT dep_id, arg_min(f.file_id, o) AS file_id, min(o)::INTEGER AS ordinal FROM (
    SELECT dep_id, project_key, stem || {list(_SUFFIXES)}[i.o + 1] AS path, i.o + {len(_SUFFIXES)} * (k - 1) AS o FROM (SELECT dep_id, project_key, unnest(stems) AS stem, generate_subscripts(stems, 1) AS k FROM {_PLACED}) d
        CROSS JOIN (SELECT unnest(range({len(_SUFFIXES)})) AS o) i) c
    JOIN (SELECT project_key, rel_path, min(file_id) AS file_id FROM {FILE} GROUP BY 1, 2) f ON f.project_key = c.project_key AND f.rel_path = c.path GROUP BY dep_id""")
def join_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Relative and aliased specifiers to files: the first of the forms with an extension or an index that exists.

    ``../`` climbs from the importing file's directory, one that leaves the project has no candidate; ``@/``
    and ``~/`` stand for src, then for the project's top.
    """
    f = files(spark, folder)
    s = F.col("import_specifier")
    d = table(spark, folder, "dependencies").where(s.rlike(r"^(\.{1,2}|[@~])/")).select("dep_id", F.col("source_file_id").alias("file_id"), "import_specifier").distinct()
    rest, up = F.regexp_replace(s, r"^(\.{1,2}/|[@~]/)+", ""), F.regexp_count(F.regexp_extract(s, r"^(\.{1,2}/)+", 0), F.lit(r"\.\./"))
    parts = F.split("rel_path", "/")
    kept = F.size(parts) - 1 - up
    climbed = F.when(kept >= 0, F.array(F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(kept, F.lit(0))), F.array(rest)), "/"))).otherwise(F.array().cast("array<string>"))
    stems = F.when(s.rlike("^[@~]/"), F.array(F.concat(F.lit("src/"), rest), rest)).otherwise(climbed)
    d = d.join(f.select("file_id", "project_key", "rel_path"), "file_id").select("dep_id", "project_key", stems.alias("stems"))
    tried = F.flatten(F.transform("stems", lambda t: F.array(*[F.struct(F.col("project_key"), F.concat(t, F.lit(x)).alias("rel_path")) for x in _SUFFIXES])))
    known = f.select(F.struct("project_key", "rel_path").alias("place"), "file_id")
    hits = rel.first_candidate(d, ["dep_id"], tried, known, "place").where("place is not null")
    return hits.join(known.groupBy("place").agg(F.min("file_id").alias("file_id")), "place").select("dep_id", "file_id", "ordinal")


@query(f"""SELECT path, CASE WHEN bool_or(e) THEN path WHEN count(node) = 1 THEN min(node) END AS node, CASE WHEN bool_or(e) THEN 'exact' WHEN count(node) = 0 THEN 'unknown' WHEN count(node) > 1 THEN 'ambiguous' ELSE 'suffix' END AS status
    FROM (SELECT w.path, n.node, n.node = w.path AS e FROM (SELECT DISTINCT array_to_string(string_split(rel_path, '/')[-2:], '/') AS path FROM {PAYLOAD}) w
    LEFT JOIN (SELECT DISTINCT rel_path AS node FROM {FILE}) n ON n.node = w.path OR ends_with(n.node, '/' || w.path)) WHERE path <> '' GROUP BY path""")
def join_suffix_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The last two segments of staged paths against the paths of files."""
    staged = records(spark, folder).select(F.array_join(F.slice(F.split("rel_path", "/"), -2, 2), "/").alias("path")).where("path <> ''").distinct()
    return rel.suffix_lookup(staged, files(spark, folder).select(F.col("rel_path").alias("node")).distinct())


@query(f"""SELECT project_key, name, CASE WHEN own THEN 'internal' WHEN other THEN 'sibling' ELSE 'external' END AS place FROM (
    SELECT r.project_key, r.name, bool_or(e.project_key = r.project_key) IS TRUE AS own, bool_or(e.project_key IS NOT NULL) IS TRUE AS other
    FROM (SELECT DISTINCT project_key, split_part(regexp_replace(name, '^[./@]+', ''), '/', 1) AS stem, name FROM {_IMPORT}) r LEFT JOIN (SELECT DISTINCT project_key, lower(name) AS n FROM {EXPORT}) e ON e.n = lower(r.stem) GROUP BY 1, 2)""")
def join_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """Where an imported name lives: in the project, else in another one, else outside."""
    lists = records(spark, folder).select("project_key", F.explode(F.from_json("payload", "imports array<string>")["imports"]).alias("name")).distinct()
    stem = F.lower(F.split(F.regexp_replace("name", r"^[./@]+", ""), "/")[0])
    homes = exports(spark, folder).groupBy(F.lower("name").alias("stem")).agg(F.collect_set("project_key").alias("homes"))
    place = F.when(F.array_contains("homes", F.col("project_key")), "internal").when(F.col("homes").isNotNull(), "sibling").otherwise("external")
    return lists.withColumn("stem", stem).join(homes, "stem", "left").select("project_key", "name", place.alias("place"))


@query(f"""SELECT f.file_id, CASE WHEN o.file_id IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM {FILE} f
    LEFT JOIN (SELECT DISTINCT source_file_id AS file_id FROM dependencies WHERE {KIND} = 'dynamic') o USING (file_id) WHERE f.file_id NOT IN (SELECT dst FROM {EDGE})""")
def join_corroboration(spark: SparkSession, folder: str) -> DataFrame:
    """Unimported files; another sign on the same file raises the confidence."""
    lone = files(spark, folder).select("file_id").join(edges(spark, folder).select(F.col("dst").alias("file_id")), "file_id", "left_anti")
    sign = table(spark, folder, "dependencies").where(kind() == "dynamic").select(F.col("source_file_id").alias("file_id"), F.lit(True).alias("sign")).distinct()
    return lone.join(sign, "file_id", "left").select("file_id", F.when(F.col("sign"), "high").otherwise("medium").alias("confidence"))


# Aggregates

@query(f"""SELECT project_key, count(*) FILTER (size_bytes >= 8000) AS n_large, count(*) FILTER (size_bytes >= 2000 AND size_bytes < 8000) AS n_medium, count(*) FILTER (size_bytes < 2000) AS n_small,
    count(DISTINCT language) AS n_languages, avg(size_bytes) AS avg_size, arg_max(file_id, (size_bytes, -file_id)) AS largest_file FROM {FILE} WHERE size_bytes IS NOT NULL GROUP BY 1""")
def aggregate_conditional(spark: SparkSession, folder: str) -> DataFrame:
    """Conditional and distinct counts, a mean and an argmax."""
    s = F.col("size_bytes")
    return files(spark, folder).where("size_bytes is not null").groupBy("project_key").agg(
        F.count_if(s >= 8000).alias("n_large"), F.count_if((s >= 2000) & (s < 8000)).alias("n_medium"), F.count_if(s < 2000).alias("n_small"),
        F.count_distinct("language").alias("n_languages"), F.avg(s).alias("avg_size"), F.max_by("file_id", F.struct(s, -F.col("file_id"))).alias("largest_file"),
    )


@query(f"SELECT name, count(*) AS n FROM (SELECT unnest(from_json(json_extract(payload, '$.imports'), '[\"VARCHAR\"]')) AS name FROM {PAYLOAD}) GROUP BY 1")
def aggregate_exploded(spark: SparkSession, folder: str) -> DataFrame:
    return payloads(spark, folder).select(F.explode(F.from_json("payload", "imports array<string>")["imports"]).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT project_key, sum(size_bytes * n)::DOUBLE / sum(n) AS weighted_size, sum(n)::BIGINT AS weight FROM {FILE} f JOIN (SELECT src, count(*) AS n FROM {EDGE} GROUP BY 1) e ON e.src = f.file_id WHERE size_bytes IS NOT NULL GROUP BY 1")
def aggregate_weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Size of files, weighted with their imports."""
    n = edges(spark, folder).groupBy(F.col("src").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = files(spark, folder).where("size_bytes is not null").join(n, "file_id")
    return rows.groupBy("project_key").agg(ratio(F.sum(F.col("size_bytes") * F.col("n")), F.sum("n")).alias("weighted_size"), F.sum("n").alias("weight"))


@query(f"""SELECT project_key, 100 - sum(least(n * w, cap)) AS purity FROM (SELECT project_key, rule, count(*)::DOUBLE AS n, any_value(w) AS w, any_value(cap) AS cap FROM (
        SELECT project_key, 'large' AS rule, 0.5::DOUBLE AS w, 20.0::DOUBLE AS cap FROM {FILE} WHERE size_bytes > 20000 UNION ALL SELECT project_key, 'no_hash', 2.0, 15.0 FROM {FILE} WHERE hash IS NULL
        UNION ALL SELECT project_key, 'no_language', 1.0, 10.0 FROM {FILE} WHERE language IS NULL) GROUP BY 1, 2) GROUP BY 1""")
def aggregate_capped_penalty(spark: SparkSession, folder: str) -> DataFrame:
    """Penalties per rule, each up to its cap, then one purity a project."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("size_bytes") > 20000, F.lit("large")), F.when(F.col("hash").isNull(), F.lit("no_hash")), F.when(F.col("language").isNull(), F.lit("no_language"))
        )
    )
    counts = files(spark, folder).select("project_key", F.explode(rules).alias("rule")).groupBy("project_key", "rule").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    penalty = F.when(F.col("rule") == "large", capped(n, 0.5, 20)).when(F.col("rule") == "no_hash", capped(n, 2, 15)).otherwise(capped(n, 1, 10))
    return counts.groupBy("project_key").agg((100 - F.sum(penalty)).alias("purity"))


@query("""SELECT event_type, count(*) AS n, avg(value) AS mean, median(value) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS largest, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1""")
def aggregate_latency(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.median("value").alias("p50"), F.expr("percentile(value, 0.95)").alias("p95"),
        F.max("value").alias("largest"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"),
    )


@query("""SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    WHERE i = round_even((n - 1) * 0.95, 0)""")
def aggregate_nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    return rel.nearest_rank(table(spark, folder, "events"), ["event_type"], "value", 0.95)


@query(f"SELECT project_key, language, n FROM (SELECT project_key, language, count(*) AS n, row_number() OVER (PARTITION BY project_key ORDER BY count(*) DESC, language) AS k FROM {FILE} WHERE language IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def aggregate_majority(spark: SparkSession, folder: str) -> DataFrame:
    return rel.majority(files(spark, folder), ["project_key"], "language")


@query(f"""SELECT CASE WHEN p IS NULL AND l IS NULL THEN 'total' WHEN l IS NULL THEN 'project_key' WHEN p IS NULL THEN 'language' ELSE 'both' END AS level, p AS project_key, l AS language, n
    FROM (SELECT project_key AS p, language AS l, count(*) AS n FROM (SELECT project_key, coalesce(language, '?') AS language FROM {FILE}) GROUP BY GROUPING SETS ((), (project_key), (language), (project_key, language)))""")
def aggregate_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rel.rollup_counts(files(spark, folder).select("project_key", F.coalesce("language", F.lit("?")).alias("language")), "project_key", "language")


@query("""SELECT md5(text) AS fingerprint, count(*) AS n_copies, min(doc_id) AS first_doc, max(lines) AS n_lines, (count(*) - 1) * max(lines) AS wasted_lines
    FROM (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents WHERE text IS NOT NULL) WHERE lines >= 5 GROUP BY 1 HAVING count(*) > 1""")
def clone_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Equal texts of five lines or more, and the lines they waste."""
    d = table(spark, folder, "documents").where("text is not null").select(
        "doc_id", F.md5("text").alias("fingerprint"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines")
    )
    return (
        d.where("lines >= 5").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_doc"), F.max("lines").alias("n_lines"))
        .where("n_copies > 1").withColumn("wasted_lines", (F.col("n_copies") - 1) * F.col("n_lines"))
    )


# Windows, order and limits

@query(f"SELECT * FROM (SELECT project_key, file_id, size_bytes, row_number() OVER (PARTITION BY project_key ORDER BY size_bytes DESC, file_id)::INTEGER AS rank FROM {FILE} WHERE size_bytes IS NOT NULL) WHERE rank <= 20")
def window_top_per_group(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder).where("size_bytes is not null").select("project_key", "file_id", "size_bytes")
    return rel.top_k_per_group(f, ["project_key"], [F.desc("size_bytes"), F.col("file_id")], 20)


@query(f"""SELECT file_id, rel_path, is_winner, winner FROM (SELECT file_id, rel_path, row_number() OVER w = 1 AS is_winner, first_value(file_id) OVER w AS winner FROM
    (SELECT file_id, project_key, rel_path, lower(regexp_replace(regexp_extract(rel_path, '[^/]*$'), '\\.[^.]*$', '')) AS stem, size_bytes FROM {FILE})
    WINDOW w AS (PARTITION BY project_key, stem ORDER BY size_bytes DESC NULLS LAST, file_id))""")
def window_winners(spark: SparkSession, folder: str) -> DataFrame:
    """Of files with the same stem in a project the largest wins; the others keep whom they lost to."""
    f = files(spark, folder).withColumn("stem", F.lower(paths.stem(F.col("rel_path"))))
    return rel.winners_and_losers(f, ["project_key", "stem"], [F.desc_nulls_last("size_bytes"), F.col("file_id")], "file_id").select("file_id", "rel_path", "is_winner", "winner")


@query(f"""SELECT project_key, array_to_string(list_sort(list(language) FILTER (k <= 3)), ',') AS shown, count(*) FILTER (k > 3) AS n_omitted FROM
    (SELECT project_key, language, row_number() OVER (PARTITION BY project_key ORDER BY language) AS k FROM (SELECT DISTINCT project_key, language FROM {FILE} WHERE language IS NOT NULL)) GROUP BY 1""")
def window_truncated(spark: SparkSession, folder: str) -> DataFrame:
    out = rel.first_k_and_omitted(files(spark, folder).where("language is not null"), ["project_key"], "language", 3)
    return out.select("project_key", F.array_join("shown", ",").alias("shown"), "n_omitted")


_MONTH = "(SELECT date_trunc('month', recorded_at)::DATE AS month, count(DISTINCT dep_id) AS n FROM dependencies WHERE recorded_at IS NOT NULL GROUP BY 1)"


@query(f"""SELECT month, n, n - lag(n) OVER w AS delta, median(n) OVER (ORDER BY month ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_median,
    max(n) OVER (ORDER BY month ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_max FROM {_MONTH} WINDOW w AS (ORDER BY month)""")
def window_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Links per month: change to the month before, and median and maximum of the last five."""
    d = table(spark, folder, "dependencies").where("recorded_at is not null")
    n = d.groupBy(F.date_trunc("month", "recorded_at").cast("date").alias("month")).agg(F.count_distinct("dep_id").alias("n"))
    w = Window.orderBy("month")  # one row a month
    return n.select("month", "n", (F.col("n") - F.lag("n").over(w)).alias("delta"), rel.array_median(F.sort_array(F.collect_list("n").over(w.rowsBetween(-4, 0)))).alias("rolling_median"), F.max("n").over(w.rowsBetween(-4, 0)).alias("rolling_max"))


@query("""SELECT doc_id, line_no, line FROM (SELECT doc_id, line_no, line, max((contains(line, 'gate'))::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS line_no FROM documents WHERE text IS NOT NULL)) WHERE near = 1""")
def window_line_context(spark: SparkSession, folder: str) -> DataFrame:
    """Lines within two of a line that speaks of a gate; a text's lines stay in its row, so that nothing is exchanged."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    first = lambda k: F.greatest(k - 2, F.lit(1))
    near = lambda k: F.exists(F.slice("lines", first(k), k + 2 - first(k) + 1), lambda x: F.contains(x, F.lit("gate")))
    kept = F.explode(F.filter(F.sequence(F.lit(1), F.size("lines")), near)).alias("k")
    return rows.select("doc_id", "lines", kept).select("doc_id", (F.col("k") - 1).alias("line_no"), F.element_at("lines", F.col("k")).alias("line"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def window_keep_last(spark: SparkSession, folder: str) -> DataFrame:
    return rel.top_k_per_group(table(spark, folder, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "ts")


@query(f"SELECT file_id, size_bytes FROM {FILE} WHERE size_bytes IS NOT NULL ORDER BY size_bytes DESC, file_id LIMIT 25 OFFSET 50")
def order_page(spark: SparkSession, folder: str) -> DataFrame:
    return rel.page(files(spark, folder).where("size_bytes is not null").select("file_id", "size_bytes"), [F.desc("size_bytes"), F.col("file_id")], 3, 25)


@query(f"SELECT file_id, CASE WHEN size_bytes >= 20000 THEN 'high' WHEN size_bytes >= 5000 THEN 'medium' WHEN size_bytes IS NULL THEN NULL ELSE 'low' END AS severity FROM {FILE} ORDER BY 2, 1 LIMIT 100")
def order_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    severity = band(F.col("size_bytes"), [(20000, "high"), (5000, "medium")], "low")
    return files(spark, folder).select("file_id", severity.alias("severity")).orderBy(F.asc_nulls_last("severity"), "file_id").limit(100)


# Sets

@query(f"SELECT project_key, rel_path, 'both' AS side FROM (SELECT project_key, rel_path FROM {FILE} INTERSECT SELECT project_key, rel_path FROM {PAYLOAD}) UNION ALL SELECT project_key, rel_path, 'staged_only' FROM (SELECT project_key, rel_path FROM {PAYLOAD} EXCEPT SELECT project_key, rel_path FROM {FILE})")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    f, s = files(spark, folder).select("project_key", "rel_path"), payloads(spark, folder).select("project_key", "rel_path")
    return f.intersect(s).withColumn("side", F.lit("both")).unionByName(s.subtract(f).withColumn("side", F.lit("staged_only")))


@query(f"""WITH k AS (SELECT DISTINCT language, project_key, split_part(rel_path, '/', 1) AS d FROM {FILE} WHERE language IS NOT NULL), n AS (SELECT language, project_key, count(*) AS n FROM k GROUP BY 1, 2),
    big AS (SELECT language, arg_min(project_key, (-n, project_key)) AS project_key, max(n) AS n FROM n GROUP BY 1)
    SELECT n.language, n.project_key, n.n AS n_keys, big.n - count(w.d) AS n_missing, count(w.d)::DOUBLE / big.n AS completeness FROM n JOIN big ON big.language = n.language
    JOIN k ON k.language = n.language AND k.project_key = n.project_key LEFT JOIN k w ON w.language = big.language AND w.project_key = big.project_key AND w.d = k.d GROUP BY n.language, n.project_key, n.n, big.n""")
def set_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Top directories that a project lacks of those of the project that has most for a language."""
    f = files(spark, folder).where("language is not null").withColumn("d", F.split("rel_path", "/")[0])
    return rel.missing_from_largest(f, "language", "project_key", "d")


@query(f"SELECT project_key, d FROM (SELECT project_key, d, count(*) AS has FROM (SELECT DISTINCT project_key, language, split_part(rel_path, '/', 1) AS d FROM {FILE} WHERE language IS NOT NULL) GROUP BY 1, 2) x JOIN (SELECT project_key, count(DISTINCT language) AS n FROM {FILE} WHERE language IS NOT NULL GROUP BY 1) y USING (project_key) WHERE has = n")
def set_in_all_instances(spark: SparkSession, folder: str) -> DataFrame:
    """Top directories in which a project has every one of its languages."""
    f = files(spark, folder).where("language is not null").withColumn("d", F.split("rel_path", "/")[0])
    return rel.in_all_instances(f, "project_key", "language", "d")


_WORDS = """list_transform(regexp_extract_all(regexp_replace({}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"""
_NAME_WORDS = _WORDS.format("regexp_replace(rel_path, '/?[^/]*$', '') || ' ' || regexp_replace(regexp_extract(rel_path, '[^/]*$'), '[.][^.]*$', '')")


@query(f"""WITH w AS (SELECT file_id, list_sort(list_distinct({_NAME_WORDS})) AS words FROM {FILE} WHERE rel_path IS NOT NULL), c AS (SELECT words, min(file_id) AS class_id, count(*) AS n_files FROM w GROUP BY words),
    pair AS (SELECT a.class_id, count(*) AS n FROM c a JOIN c b ON a.class_id <> b.class_id AND len(list_intersect(a.words, b.words)) >= 0.7 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) - 1e-9 AND len(list_intersect(a.words, b.words)) > 0 GROUP BY 1)
    SELECT w.file_id, c.class_id, c.n_files, coalesce(p.n, 0) AS n_links FROM w JOIN c ON c.words = w.words LEFT JOIN pair p ON p.class_id = c.class_id""")
def similar_names(spark: SparkSession, folder: str) -> DataFrame:
    """Each file with the class of files that have the same words in their paths, and how many other classes share 0.7 of them.

    The inverted index holds the rarest words of each class, so that all pairs of classes are found.
    """
    words = F.sort_array(F.array_distinct(paths.identifier_tokens(F.concat_ws(" ", paths.dirname(F.col("rel_path")), paths.stem(F.col("rel_path"))))))
    f = files(spark, folder).where("rel_path is not null").select("file_id", words.alias("words"))
    classes = cut(f.groupBy("words").agg(F.min("file_id").alias("class_id"), F.count(F.lit(1)).alias("n_files")))
    pairs = rel.similar_sets(classes.select(F.col("words").alias("left")), classes.select(F.col("words").alias("right")), 0.7).where("left <> right")
    links = pairs.groupBy(F.col("left").alias("words")).agg(F.count(F.lit(1)).alias("n_links"))
    rows = f.join(classes, "words").join(links, "words", "left")
    return rows.select("file_id", "class_id", "n_files", F.coalesce("n_links", F.lit(0)).alias("n_links"))


# Functions

@query(f"""SELECT file_id, regexp_replace(rel_path, '/?[^/]*$', '') AS dir, regexp_extract(rel_path, '[^/]*$') AS base, lower(regexp_extract(rel_path, '\\.([A-Za-z0-9]+)$', 1)) AS ext,
    len(string_split(rel_path, '/'))::INTEGER AS depth, array_to_string({_WORDS.format("regexp_replace(regexp_extract(rel_path, '[^/]*$'), '[.][^.]*$', '')")}, ' ') AS words FROM {FILE}""")
def function_paths(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("rel_path")
    return files(spark, folder).select(
        "file_id", paths.dirname(p).alias("dir"), paths.basename(p).alias("base"), paths.extension(p).alias("ext"), paths.depth(p).alias("depth"),
        F.array_join(paths.identifier_tokens(paths.stem(p)), " ").alias("words"),
    )


@query("""SELECT CASE WHEN s LIKE './%' OR s LIKE '../%' THEN 'relative' WHEN s LIKE '@/%' OR s LIKE '~/%' THEN 'alias' WHEN s LIKE '@%' THEN 'scoped' WHEN s LIKE '/%' THEN 'absolute' ELSE 'external' END AS form,
    (length(regexp_extract(s, '^(\\.\\./)*')) / 3)::INTEGER AS climbs, count(*) AS n FROM (SELECT DISTINCT dep_id, import_specifier AS s FROM dependencies WHERE import_specifier IS NOT NULL) GROUP BY 1, 2""")
def function_import_forms(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "dependencies").where("import_specifier is not null").select("dep_id", "import_specifier").distinct()
    s = F.col("import_specifier")
    return d.groupBy(paths.import_kind_of(s).alias("form"), paths.climbs(s).alias("climbs")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT project_key, rel_path, md5(payload) AS md5, sha256(payload) AS sha256, left(sha256(payload), 12) AS short, sha256(payload) = any_value(payload_sha) AS as_recorded FROM (SELECT project_key, {'rel_path'}, payload, payload_sha FROM atlas_staging_files WHERE payload IS NOT NULL) GROUP BY project_key, rel_path, payload")
def function_digests(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "atlas_staging_files").where("payload is not null").groupBy("project_key", "rel_path", "payload").agg(F.first("payload_sha").alias("sha"))
    sha = F.sha2("payload", 256)
    return rows.select("project_key", "rel_path", F.md5("payload").alias("md5"), sha.alias("sha256"), F.substring(sha, 1, 12).alias("short"), (sha == F.col("sha")).alias("as_recorded"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_keys(props)[1] AS first_key FROM events")
def function_json(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"), F.json_object_keys("props")[0].alias("first_key"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch(date_trunc('second', ts))::BIGINT AS seconds, ts::DATE < DATE '2024-01-15' AS early, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS day_no FROM events")
def function_times(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    day = F.to_date("ts")
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("seconds"),
        (day < F.lit("2024-01-15").cast("date")).alias("early"), F.datediff(day, F.lit("2024-01-01").cast("date")).alias("day_no"),
    )
