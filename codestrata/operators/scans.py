"""Scans of source text: what Python's own parser sees, imports and exports of other languages,
spans of braces, and the likeness of two texts. These run in Arrow batches in Python, as no
built-in function does their work.
"""

from __future__ import annotations

import ast
import hashlib
import hmac
import re
import warnings
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IMPORTS = {
    "javascript": r"""(?:from|import|require\()\s*['"]([^'"\n]+)['"]""",
    "python": r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "csharp": r"(?m)^\s*using\s+([\w.]+)\s*;",
    "go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"\n]+)"',
}


def python_symbols(sources: DataFrame) -> DataFrame:
    """record_id, name, kind, line, end_line, parent of the symbols of Python texts (record_id, text).

    A text that doesn't parse gives one row of kind ``unparsed``; a null text gives none.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["record_id"], batch["text"]):
                if text is None:
                    continue
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        tree = ast.parse(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((key, None, "unparsed", None, None, None))
                    continue
                stack = [(tree, None)]
                while stack:
                    node, parent = stack.pop()
                    for child in ast.iter_child_nodes(node):
                        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                            rows.append((key, child.name, kind, child.lineno, child.end_lineno, parent))
                            stack.append((child, child.name))
                        else:
                            stack.append((child, parent))
            yield pd.DataFrame(rows, columns=["record_id", "name", "kind", "line", "end_line", "parent"]).astype({"line": "Int32", "end_line": "Int32"})

    return sources.select("record_id", "text").mapInPandas(scan, "record_id long, name string, kind string, line int, end_line int, parent string")


def import_strings(text: Column, language: Column) -> Column:
    """Array of what a text imports, by the language's form of import."""
    out = None
    for name, pattern in _IMPORTS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if name == "python":
            found = F.filter(F.concat(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(2))), lambda x: x != "")
        same = language.isin("javascript", "typescript") if name == "javascript" else language == name
        out = F.when(same, found) if out is None else out.when(same, found)
    return out


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"(?m)//[^\n]*$", "")


def named_exports(text: Column) -> Column:
    """Names that a JavaScript or TypeScript text exports: declarations, lists (under the outer name) and namespaces; comments left out."""
    bare = without_comments(text)
    pattern = r"\bexport\s+(?:declare\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:const|let|var|function\*?|class|interface|type|enum|namespace)\s+([A-Za-z_$][\w$]*)"
    lists = F.regexp_extract_all(bare, F.lit(r"\bexport\s+(?:type\s+)?\{([^{}]*)\}"), F.lit(1))
    listed = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"([A-Za-z_$][\w$]*)\s*$", 1))
    spaces = F.regexp_extract_all(bare, F.lit(r"\bexport\s+\*\s+as\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    every = F.concat(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)), listed, spaces)
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def brace_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(first line, last line, depth) of each pair of braces outside of strings and comments."""
    if not text:
        return []
    out, stack, line = [], [], 1
    for m in re.finditer(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{}]|\n", text, re.S):
        s = m[0]
        if s == "{":
            stack.append(line)
        elif s == "}" and stack:
            first = stack.pop()
            out.append((first, line, len(stack)))
        line += s.count("\n")
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("first", "last", "depth")])))
def brace_spans_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"first": a, "last": b, "depth": d} for a, b, d in brace_spans(t)])


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts; null if one is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def keyed_digest(secret: str):
    """A column function: HMAC-SHA-256 of a text in hexadecimal."""

    @F.pandas_udf(T.StringType())
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest())

    return digest


_DECLARED = {
    "java": r"(?m)^\s*(?:public|protected|private|static|final|abstract|\s)*\b(?:class|interface|enum|record)\s+(\w+)",
    "csharp": r"(?m)^\s*(?:public|protected|private|internal|static|sealed|abstract|partial|\s)*\b(?:class|interface|enum|struct|record)\s+(\w+)",
    "go": r"(?m)^\s*(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)",
    "typescript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|async\s+)*(?:class|interface|type|enum|function\*?|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "python": r"(?m)^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
}


def declared_symbols(sources: DataFrame) -> DataFrame:
    """record_id, language, name, ordinal of the declarations in texts(record_id, language, text)."""
    text, names = without_comments(F.col("text")), None
    for language, pattern in {**_DECLARED, "javascript": _DECLARED["typescript"]}.items():
        body = F.col("text") if language == "python" else text
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
        names = F.when(F.col("language") == language, found) if names is None else names.when(F.col("language") == language, found)
    return sources.select("record_id", "language", F.posexplode(names).alias("ordinal", "name")).select("record_id", "language", "name", "ordinal")


def rule_hits(sources: DataFrame, rules: Sequence[tuple[str, str, float, float, str, str]]) -> DataFrame:
    """record_id, project_key, rule, family, weight, cap, n of the rules that find something in sources(record_id, project_key, text).

    rules: name, family, weight, cap, a pattern that counts and one whose matches don't ("" for none).
    """
    found = [
        F.struct(
            F.lit(name).alias("rule"), F.lit(family).alias("family"), F.lit(weight).alias("weight"), F.lit(cap).alias("cap"),
            (F.regexp_count("text", F.lit(p)) - (F.regexp_count("text", F.lit(less)) if less else F.lit(0))).cast("long").alias("n"),
        )
        for name, family, weight, cap, p, less in rules
    ]
    return sources.select("record_id", "project_key", F.explode(F.array(*found)).alias("h")).where("h.n > 0").select("record_id", "project_key", "h.*")
