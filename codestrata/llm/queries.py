"""Queries of the problems of training text, over the whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import foreign_code, leaks, mixing, sentences, syntax
from codestrata.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = foreign_code.foreign_files(table(spark, folder, "files"), table(spark, folder, "atlas_staging_files"))
    return found.select("project_key", "rel_path")


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    found = foreign_code.foreign_files(table(spark, folder, "files"), table(spark, folder, "atlas_staging_files"))
    return found.groupBy("project_key", "reason").count().withColumnRenamed("count", "n_files")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.syntax_errors(table(spark, folder, "source_records")).where("reason is not null").select("record_id").distinct()


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.error_rates(syntax.syntax_errors(table(spark, folder, "source_records")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, copies and the longest reproduction of each leaked item."""
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("length").alias("longest"))


def p6_clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = leaks.leaks(documents, table(spark, folder, "eval_items"))
    return leaks.without_leaks(documents, found).select("doc_id", "source", "n_chars")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    counts = mixing.counted(table(spark, folder, "documents"))
    return mixing.mixed(counts, table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    counts = mixing.counted(table(spark, folder, "documents"))
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.quotas(counts, targets), mixing.mixed(counts, targets))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "documents"))


QUERIES = {
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_leaked_items": p6_leaked_items,
    "p6_clean_documents": p6_clean_documents,
    "p2_found": p2_found, "p2_reasons": p2_reasons}

# Written apart from the operator: by segments of paths and by the words that an opening comment begins with.
_CLEAN = "regexp_replace(regexp_replace(replace(rel_path, chr(92), '/'), '/{2,}', '/', 'g'), '^(\\./)+', '')"
_PATH_REASON = """
    SELECT project_key, rel_path, CASE
        WHEN list_has_any(seg, ['__generated__', 'generated-sources', 'generated', 'autogen']) OR len(list_filter(seg, lambda s: s LIKE 'zz_generated%')) > 0
            OR (n > 1 AND seg[1] = 'dist') OR (n > 2 AND seg[1] = 'build' AND seg[2] IN ('out', 'output', 'generated', 'classes'))
            OR (len(dot) > 2 AND dot[-2] IN ('gen', 'generated', 'g', 'designer', 'pb', 'pb2') AND regexp_full_match(dot[-1], '[a-z]+'))
            OR list_has_any([right(seg[-1], 7), right(seg[-1], 8), right(seg[-1], 12), right(seg[-1], 13)], ['_pb2.py', '_pb2.pyi', '_pb2_grpc.py', '_pb2_grpc.pyi']) THEN 'generated'
        WHEN list_has_any(seg[:n - 1], ['node_modules', 'bower_components', 'jspm_packages', 'thirdparty', 'third_party', 'third-party', '3rdparty', '3rd_party', '3rd-party', '_vendor', 'site-packages', 'dist-packages', 'pods'])
            OR (n > 2 AND seg[1] = 'vendor') OR (n > 3 AND seg[2] = 'vendor')
            OR len(list_filter(seg[:n - 1], lambda s: regexp_full_match(s, '[a-z_][-a-z0-9_]*-[0-9]+[.][0-9]+([.][0-9]+)?'))) > 0
            OR regexp_full_match(seg[-1], '[a-z_][-a-z0-9_]*-[0-9]+[.][0-9]+([.][0-9]+)?[.][a-z]+') THEN 'third_party'
        WHEN (dot[-1] IN ('js', 'mjs', 'cjs', 'css') AND dot[-1] <> 'cjs' AND (regexp_full_match(dot[-2], '(.*-)?(min|bundle|packed|chunk)') AND (len(dot) > 2 OR contains(dot[-2], '-'))))
            OR (dot[-1] IN ('js', 'mjs') AND len(dot) = 2 AND regexp_full_match(dot[1], 'chunk-[0-9a-f]{6,}')) OR (dot[-1] IN ('js', 'mjs', 'css') AND len(dot) > 2 AND regexp_full_match(dot[-2], '[0-9a-f]{8,}')) THEN 'minified' END AS reason
    FROM (SELECT *, string_split(seg[-1], '.') AS dot FROM (SELECT *, string_split(lower(rel_path), '/') AS seg, len(string_split(rel_path, '/')) AS n FROM (
        SELECT project_key, {clean} AS rel_path FROM files UNION SELECT project_key, {clean} FROM atlas_staging_files) WHERE rel_path IS NOT NULL))
""".replace("{clean}", _CLEAN)
_FOREIGN = rf"""
    WITH path AS ({_PATH_REASON}),
    head AS (SELECT project_key, {_CLEAN} AS rel_path, size_bytes, json_extract_string(payload, '$.head') AS head, try_cast(json_extract_string(payload, '$.loc') AS DOUBLE) AS loc,
        try_cast(json_extract_string(payload, '$.longest_line') AS DOUBLE) AS longest FROM atlas_staging_files WHERE stage_kind = 'atlas_record' AND rel_path IS NOT NULL),
    part AS (SELECT *, lower(regexp_extract(head, '(?s)^\s*(?://|#|/\*+!?|<!--|--)[\s*]*(.*)$', 1)) AS said, regexp_matches(head, '^\s*(//|#|/\*)') AS slash, regexp_replace(head, '(?s)^\s*/\*.*?\*/\s*', '') AS body,
        coalesce(longest, size_bytes / nullif(loc, 0), CASE WHEN NOT contains(rtrim(head, chr(10) || chr(13) || ' '), chr(10)) THEN size_bytes END) >= 400 AS long FROM head),
    count AS (SELECT *, greatest(length(body), 1)::DOUBLE AS n, len(regexp_extract_all(body, '(?:^|[^\w.])[0-9][0-9.]*')) AS numbers, len(regexp_extract_all(body, '[^\W\d]{{2,}}')) AS words,
        length(regexp_replace(body, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(body, '[^\s]', '', 'g')) AS spaces,
        length(translate(body, '[({{', '')) < length(translate(body, '])}}', '')) AS goes_on FROM part),
    told AS (SELECT c.project_key, c.rel_path, body, coalesce(CASE
        WHEN said SIMILAR TO '(@generated|code\s+generated)([^\w].*)?' OR said SIMILAR TO '<auto-?generated([^\w](.|\s)*)?' OR said SIMILAR TO 'auto-?generated\s*(:|((from|by|code|file)([^\w]|$)))(.|\s)*'
            OR regexp_matches(said, '^(@generated|<auto-?generated|code\s+generated|generated\s+(by|from)|compiled\s+output\s+of)([^\w]|$)') OR regexp_matches(said, '^codegen\s+\S+@\S+')
            OR regexp_matches(said, '^(this|the)\s+(file|code|module)\s+(was|is|has\s+been)\s+(auto(matically)?[-\s]*)?(produced|generated|created|written)\s+by([^\w]|$)')
            OR regexp_matches(said, '^diese\s+datei\s+(wird|wurde)\s+(von\s+\S+\s+)?automatisch([^\w]|$)') OR regexp_matches(said, '^automatisch\s+(erzeugt|generiert)')
            OR regexp_matches(said, '^(fichier\s+(généré|genere|produit)\s+automatiquement|archivo\s+generado\s+automáticamente)') THEN 'generated'
        WHEN slash AND regexp_matches(regexp_replace(regexp_replace(said, '^@(preserve|license)\s+', ''), '^copied\s+(unchanged|verbatim|as\s+is)\s+from\s+', ''),
            '^[a-z][\w.-]*\s+v?[0-9]+[.][0-9]+([.][0-9]+)?([^\w\n][^\n]{{0,19}})?(\n[\s*#/]*)?[^\n]{{0,120}}(licen[cs]e|upstream|\(c\)|copyright|[^\w]bsd([^\w]|$)|[^\w]mit([^\w]|$)|apache)') THEN 'third_party'
        WHEN regexp_matches(body, 'base64,[A-Za-z0-9+/]{{40,}}|(\\\\?x[0-9a-fA-F]{{2}}){{12,}}|[A-Za-z0-9+/]{{120,}}') AND long THEN 'data'
        WHEN (numbers >= 0.42 * (numbers + words) OR digits / n >= 0.17) AND numbers >= 4 AND goes_on AND NOT regexp_matches(body, '(?m)^\s*(//|#|/\*)\s*\w+\s+\w+') THEN 'data'
        WHEN long AND spaces / n <= 0.085 AND length(body) >= 40 THEN 'minified' END, p.reason) AS reason
        FROM count c JOIN path p ON p.rel_path = c.rel_path AND p.project_key IS NOT DISTINCT FROM c.project_key),
    line AS (SELECT id, project_key, rel_path, reason, list_sort(list(DISTINCT line)) AS lines FROM (SELECT *, trim(regexp_replace(unnest(string_split(replace(body, chr(13), ''), chr(10))), '\s+', ' ', 'g')) AS line
            FROM (SELECT *, row_number() OVER () AS id FROM told WHERE body IS NOT NULL)) WHERE line <> '' AND NOT regexp_matches(line, '^(//|#|/?\*|<!--|--)') GROUP BY ALL),
    sets AS (SELECT lines, bool_or(reason IS NOT DISTINCT FROM 'third_party') AS known, bool_or(reason IS DISTINCT FROM 'third_party') AS asked, list(DISTINCT project_key) FILTER (reason = 'third_party') AS owners FROM line GROUP BY lines),
    posted AS (SELECT lines, known, asked, owners, line, length(line) * least(1.0, 2 - 2 * ln(count(*) OVER (PARTITION BY line)) / ln(greatest((SELECT count(*) FROM sets), 2) + 1)) AS weight FROM (SELECT *, unnest(lines) AS line FROM sets)),
    total AS (SELECT lines, sum(weight) AS total FROM posted WHERE asked GROUP BY lines),
    hit AS (SELECT a.lines, b.owners FROM posted a JOIN posted b ON b.line = a.line AND b.known AND a.asked JOIN total t ON t.lines = a.lines
        GROUP BY a.lines, b.lines, b.owners, t.total HAVING sum(a.weight) >= greatest(0.8 * t.total, 160.0) - 1e-9),
    every AS (SELECT project_key, rel_path, reason FROM told UNION ALL SELECT project_key, rel_path, reason FROM path
        UNION ALL SELECT l.project_key, l.rel_path, 'third_party' FROM line l JOIN hit h ON h.lines = l.lines WHERE len(list_filter(h.owners, lambda o: o <> l.project_key)) > 0)
    SELECT project_key, rel_path, arg_min(reason, CASE reason WHEN 'generated' THEN 1 WHEN 'third_party' THEN 2 WHEN 'minified' THEN 3 ELSE 4 END) AS reason FROM every WHERE reason IS NOT NULL AND rel_path IS NOT NULL GROUP BY 1, 2
"""

ORACLE: dict[str, str] = {
    "p2_found": f"SELECT project_key, rel_path FROM ({_FOREIGN})",
    "p2_reasons": f"SELECT project_key, reason, count(*) AS n_files FROM ({_FOREIGN}) GROUP BY 1, 2",
}
