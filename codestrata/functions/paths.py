"""Column functions on paths, identifiers, spans and imports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSION_LANGUAGE = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "java": "java", "go": "go", "cs": "csharp", "css": "css", "json": "json", "md": "markdown", "sql": "sql",
}


def normalized(path: Column) -> Column:
    """With ``/`` and without leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def directory(path: Column, levels: int) -> Column:
    """The first levels of the directory, or ``.`` at the top."""
    parts = F.split(dirname(path), "/")
    return F.when(dirname(path) == "", ".").otherwise(F.array_join(F.slice(parts, 1, levels), "/"))


def has_fragment(path: Column, fragment: str) -> Column:
    """Whether the segments of fragment follow each other in the path."""
    return F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit(f"/{fragment.strip('/')}/"))


def glob_regex(pattern: str) -> str:
    """The regular expression of a shell pattern: ``*`` and ``?`` also match ``/``."""
    out = []
    for c in pattern:
        out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
    return f"^{''.join(out)}$"


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*\.py$|_test\.(py|go)$|\.(test|spec)\.[jt]sx?$|Tests?\.(java|cs)$")


def logical_name(path: Column) -> Column:
    """The base name without extension and marks of tests, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(stem(path), r"(?i)([._-](test|spec))$|^test_|_test$|Tests?$", ""), r"\.d$", ""))


def span_lines(span: Column) -> Column:
    """``L10-L22`` gives 13; null if it isn't a span."""
    first = F.nullif(F.regexp_extract(span, r"^L(\d+)-L(\d+)$", 1), F.lit("")).cast("int")
    last = F.nullif(F.regexp_extract(span, r"^L(\d+)-L(\d+)$", 2), F.lit("")).cast("int")
    return last - first + 1


def identifier_tokens(name: Column) -> Column:
    """Words of an identifier: camel case, acronyms and digits apart, in lower case."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


# Letters whose folded form isn't their lower one.
FOLDED = {"ß": "ss", "ſ": "s", "ς": "σ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn", "ǰ": "ǰ"}


def folded_case(text: Column) -> Column:
    """For comparisons without case: as lower case, but ``ß`` is ``ss``, ligatures are letters and ``ς`` is ``σ``."""
    text = F.lower(text)
    for letter, folded in FOLDED.items():
        text = F.replace(text, F.lit(letter), F.lit(folded))
    return text


def import_kind_of(specifier: Column) -> Column:
    """relative, alias, scoped, absolute or external, by the form of the specifier."""
    return (
        F.when(specifier.startswith("./") | specifier.startswith("../"), "relative")
        .when(specifier.startswith("@/") | specifier.startswith("~/"), "alias")
        .when(specifier.startswith("@"), "scoped")
        .when(specifier.startswith("/"), "absolute")
        .otherwise("external")
    )


def climbs(specifier: Column) -> Column:
    """How many ``../`` a relative specifier begins with."""
    return F.floor(F.length(F.regexp_extract(specifier, r"^(\.\./)*", 0)) / 3).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
