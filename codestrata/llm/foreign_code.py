"""Source files that nobody wrote by hand in the project.

Method: the lines of the staged heads are hashed into an inverted index over sets of lines; the rare
lines of a file propose third-party files of other projects, and a file is a vendored copy, edited or
not, with or without its banner, if its lines are contained in one of them by CONTAINMENT or more,
weighed by rarity. Files that say themselves what they are (paths, the opening comment) are the known
ones; the composition of tokens classifies all other files.

Defined results
---------------
* One row a (project_key, path); several staged versions of a file count if one of them counts.
* Paths are compared with ``/`` and without leading ``./``; a null path gives no row.
* A payload that isn't JSON, or misses fields, leaves the rules on paths; an empty head leaves them too.
* A file with several reasons gets the first of: generated, third_party, minified, data.
* Length, size or age alone never count. A file whose head holds less than EVIDENCE characters of rare
  code lines can't be told to be a copy by the index. Comments and blank lines are no evidence.
* A null project_key is no other project, so that nothing is a copy of its files or among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut

# Directories and names that tools, package managers and bundlers write to.
GENERATED_PATH = (
    r"(?i)(^|/)(__generated__|generated-sources|generated|autogen|zz_generated[^/]*)(/|$)"
    r"|^(dist|build/(out|output|generated|classes))/|/zz_generated[^/]*$"
    r"|\.(gen|generated|g|designer|pb|pb2)\.[a-z]+$|_pb2(_grpc)?\.pyi?$"
)
THIRD_PARTY_PATH = (
    r"(?i)(^|/)(node_modules|bower_components|jspm_packages|third[_-]?party|3rd[_-]?party|_vendor|site-packages|dist-packages|pods)/"
    r"|^([^/]+/)?vendor/[^/]+/|(^|/)[a-z_][a-z0-9_-]*-\d+\.\d+(\.\d+)?(/|\.[a-z]+$)"
)
MINIFIED_PATH = (
    r"(?i)([.-](min|bundle|packed|chunk)\.(m?js|css)$)|(^|/)chunk-[0-9a-f]{6,}\.m?js$|\.[0-9a-f]{8,}\.(m?js|css)$"
)

# What an opening comment says of its own file.
GENERATED_HEAD = (
    r"(?is)^\s*(//|#|/\*+!?|<!--|--)[\s*]*("
    r"@generated\b|<auto-?generated\b|auto-?generated\s*(:|from\b|by\b|code\b|file\b)"
    r"|(this|the)\s+(file|code|module)\s+(was|is|has\s+been)\s+(auto(matically)?[\s-]*)?(produced|generated|created|written)\s+by\b"
    r"|code\s+generated\b|generated\s+(by|from)\b|codegen\s+\S+@\S+|compiled\s+output\s+of\b"
    r"|diese\s+datei\s+(wird|wurde)\s+(von\s+\S+\s+)?automatisch\b|automatisch\s+(erzeugt|generiert)"
    r"|fichier\s+(généré|genere|produit)\s+automatiquement|archivo\s+generado\s+automáticamente)"
)
THIRD_PARTY_HEAD = (
    r"(?is)^\s*(//|#|/\*+!?)[\s*]*(@(preserve|license)\s+)?(copied\s+(unchanged|verbatim|as\s+is)\s+from\s+)?"
    r"([a-z][\w.-]*)\s+v?\d+\.\d+(\.\d+)?\b[^\n]{0,20}(\n[\s*#/]*)?[^\n]{0,120}"
    r"(licen[cs]e|upstream|\(c\)|copyright|\bbsd\b|\bmit\b|apache)"
)
NUMBER, WORD = r"(?:^|[^\w.])\d[\d.]*", r"[^\W\d]{2,}"
REMARK = r"(?m)^\s*(//|#|/\*)\s*\w+\s+\w+"
COMMENT_LINE = r"^(//|#|/?\*|<!--|--)"
ENCODED = r"base64,[A-Za-z0-9+/]{40,}|(\\\\?x[0-9a-fA-F]{2}){12,}|[A-Za-z0-9+/]{120,}"
OPENING_COMMENT = r"(?s)^\s*/\*.*?\*/\s*"

LONG_LINE = 400  # characters a line from which on the composition of tokens may tell minified text
PACKED_SPACE = 0.085  # share of white space below which such text isn't laid out for reading
DATA_NUMBERS = 0.42  # share of numbers among the tokens from which on a file is rows of numbers,
DATA_DIGITS = 0.17  # or of digits among the characters, as in tables of long numbers
CONTAINMENT = 0.8  # share of a file's lines, by weight, that lie in one third-party file
EVIDENCE = 160.0  # characters of rare lines below which a likeness may be chance


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"^(\./)+", "")


def staged_heads(staged: DataFrame) -> DataFrame:
    """project_key, rel_path, size_bytes, head, loc, longest_line of the staged files."""
    shape = "loc string, size string, longest_line string, head string"
    p = F.from_json("payload", shape)
    return staged.where("stage_kind = 'atlas_record'").select(
        "project_key",
        clean_path(F.col("rel_path")).alias("rel_path"),
        F.coalesce("size_bytes", p["size"].try_cast("long")).alias("size_bytes"),
        p["head"].alias("head"),
        p["loc"].try_cast("double").alias("loc"),
        p["longest_line"].try_cast("double").alias("longest_line"),
    )


def path_reason(path: Column) -> Column:
    return (
        F.when(path.rlike(GENERATED_PATH), "generated")
        .when(path.rlike(THIRD_PARTY_PATH), "third_party")
        .when(path.rlike(MINIFIED_PATH), "minified")
    )


def head_reason(head: Column, size: Column, loc: Column, longest: Column) -> Column:
    """By the opening comment, then by the composition of what follows it."""
    body = F.regexp_replace(head, OPENING_COMMENT, "")
    n = F.greatest(F.length(body), F.lit(1))
    share = lambda rx: (F.length(body) - F.length(F.regexp_replace(body, rx, ""))) / n
    line = F.coalesce(longest, F.try_divide(size, loc), F.when(~F.rtrim(head).contains("\n"), size))
    long_lines = line >= LONG_LINE
    # Runs of base64 or of escaped bytes are data however short; rows of numbers if they go on beyond the head.
    encoded = body.rlike(ENCODED)
    n_numbers, n_words = F.regexp_count(body, F.lit(NUMBER)), F.regexp_count(body, F.lit(WORD))
    rows = F.coalesce(F.try_divide(n_numbers, n_numbers + n_words), F.lit(0.0)) >= DATA_NUMBERS
    remarks = body.rlike(REMARK)  # somebody keeps them
    signs = lambda rx: F.regexp_count(body, F.lit(rx))
    goes_on = signs(r"[\[({]") > signs(r"[\])}]")  # a list that ends within the head is a handful of constants
    numbers = (rows | (share("[0-9]") >= DATA_DIGITS)) & (n_numbers >= 4) & goes_on & ~remarks
    return (
        F.when(head.rlike(GENERATED_HEAD), "generated")
        .when(head.rlike(THIRD_PARTY_HEAD), "third_party")
        .when(encoded & long_lines, "data")
        .when(numbers, "data")
        .when(long_lines & (share(r"\s") <= PACKED_SPACE) & (F.length(body) >= 40), "minified")
    )


def code_lines(head: Column) -> Column:
    """The distinct lines of a head that aren't blank and no comment, as (hash, length), in order of the hash."""
    lines = F.transform(F.split(F.regexp_replace("head", OPENING_COMMENT, ""), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(COMMENT_LINE))
    return F.sort_array(F.array_distinct(F.transform(kept, lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("size")))))


def line_sets(told: DataFrame) -> DataFrame:
    """set_id, lines, known, asked, owner_low, owner_high: files with the same lines are one set, however many they are.

    told: project_key, set_id, lines, reason. owner_low and owner_high are the first and last project that
    holds the set as third-party code.
    """
    third = F.col("reason").eqNullSafe("third_party")
    return told.where(F.size("lines") > 0).groupBy("set_id").agg(
        F.first("lines").alias("lines"),
        F.bool_or(third).alias("known"),
        F.bool_or(~third).alias("asked"),
        F.min(F.when(third, F.col("project_key"))).alias("owner_low"),
        F.max(F.when(third, F.col("project_key"))).alias("owner_high"),
    )


def vendored_copies(told: DataFrame, containment: float = CONTAINMENT, evidence: float = EVIDENCE) -> DataFrame:
    """project_key, rel_path, share of files whose lines lie in a third-party file of another project.

    told: project_key, rel_path, set_id, lines, reason. A line weighs its length, and less from the square root
    of all sets on, to nothing if all hold it: length min(1, 2 - 2 log(df) / log(n)). A file is a copy if lines of ``containment`` of its weight, and of
    ``evidence`` at least, are in one set. Exact: if a file's lines are put in order of rarity, one of those
    before the rest that weighs less than this must be shared, and only these look up the index of the
    known sets. No line is left out for being common.
    """
    sets = cut(line_sets(told))
    posted = sets.select("set_id", "known", "asked", F.explode("lines").alias("l")).select("set_id", "known", "asked", "l.line", "l.size")
    n_sets = F.greatest(sets.agg(F.count(F.lit(1))).scalar(), F.lit(2))
    df = posted.groupBy("line").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("size") * F.least(F.lit(1.0), 2 * (1 - F.log("df") / F.log(n_sets.cast("double") + 1)))
    posted = cut(posted.join(df, "line").select("set_id", "known", "asked", "line", "df", weight.alias("weight")))
    each = Window.partitionBy("set_id")
    asked = posted.where("asked").withColumn("total", F.sum("weight").over(each)).where(F.col("total") >= evidence)
    asked = asked.withColumn("least", F.greatest(F.col("total") * containment, F.lit(evidence)))
    rest = F.sum("weight").over(each.orderBy(F.desc("df"), "line"))  # of this line and all more common ones
    rare = asked.withColumn("rest", rest).where("rest >= least - 1e-9")
    owned = posted.where("known").select(F.col("set_id").alias("owner"), "line")
    pairs = rare.join(owned, "line").select("set_id", "owner").distinct()
    shared = (
        pairs.join(asked.select("set_id", "line", "weight", "total", "least"), "set_id")
        .join(owned, ["owner", "line"])
        .groupBy("set_id", "owner")
        .agg(F.sum("weight").alias("shared"), F.first("total").alias("total"), F.first("least").alias("least"))
        .where("shared >= least - 1e-9")
    )
    owners = sets.select(F.col("set_id").alias("owner"), "owner_low", "owner_high")
    hits = shared.join(owners, "owner").select("set_id", (F.col("shared") / F.col("total")).alias("share"), "owner_low", "owner_high")
    files = told.where("reason is null or reason <> 'third_party'").select("project_key", "rel_path", "set_id")
    other = (F.col("owner_low") != F.col("project_key")) | (F.col("owner_high") != F.col("project_key"))
    return files.join(hits, "set_id").where(other).groupBy("project_key", "rel_path").agg(F.max("share").alias("share"))


def foreign_files(files: DataFrame, staged: DataFrame) -> DataFrame:
    """project_key, rel_path, reason of every file that isn't written by hand in its project."""
    heads = staged_heads(staged)
    named = files.select("project_key", clean_path(F.col("rel_path")).alias("rel_path")).unionByName(
        staged.select("project_key", clean_path(F.col("rel_path")).alias("rel_path"))
    )
    by_path = named.where("rel_path is not null").select("project_key", "rel_path", path_reason(F.col("rel_path")).alias("reason"))
    told = heads.where("rel_path is not null").withColumn(
        "reason",
        F.coalesce(
            head_reason(F.col("head"), F.col("size_bytes"), F.col("loc"), F.col("longest_line")), path_reason(F.col("rel_path"))
        ),
    )
    # Parsed and judged once; the lines are read again by the index.
    told = cut(told.withColumn("lines", F.coalesce(code_lines(F.col("head")), F.array().cast("array<struct<line:bigint,size:int>>"))).select(
        "project_key", "rel_path", "reason", "lines", F.md5(F.col("lines").cast("string")).alias("set_id")
    ))
    copies = vendored_copies(told).select("project_key", "rel_path")
    every = (
        by_path.unionByName(told.select("project_key", "rel_path", "reason"))
        .where("reason is not null")
        .unionByName(copies.withColumn("reason", F.lit("third_party")))
    )
    rank = F.array_position(F.array(*map(F.lit, ("generated", "third_party", "minified", "data"))), F.col("reason"))
    return every.groupBy("project_key", "rel_path").agg(F.min_by("reason", rank).alias("reason"))


def hand_written(files: DataFrame, staged: DataFrame) -> DataFrame:
    """The rows of files that remain."""
    foreign = foreign_files(files, staged).select(F.col("project_key").alias("_p"), F.col("rel_path").alias("_r"))
    return files.join(
        foreign, files["project_key"].eqNullSafe(F.col("_p")) & (clean_path(files["rel_path"]) == F.col("_r")), "left_anti"
    )
