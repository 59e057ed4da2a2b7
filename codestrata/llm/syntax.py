"""Source files that do not parse.

Method: the token stream of each file is run through the memoised derivatives of its language's
grammar (``derivatives``): an empty derivative marks the failing token, a derivative at the end
without the empty form a file that breaks off. For Python and JSON the language's own parser
follows as an exact check, since their grammars also restrict forms by context.

Defined results
---------------
* The language is that of the extension, in any case; other extensions, null paths and null contents
  give no row. An empty file is valid Python and TypeScript, not valid JSON.
* A leading byte-order mark is dropped. Content that isn't UTF-8 is invalid, at the failing byte.
* Repeated rows count once. Columns are taken by name; what older runs said isn't used.
* A file nested too deeply for the exact check counts as the derivatives found it.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import grammars, lexers
from codestrata.llm.derivatives import Grammar

LANGUAGES = {"py": "python", "pyi": "python", "json": "json", "ts": "typescript", "tsx": "tsx"}


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    return Grammar({"json": grammars.JSON, "python": grammars.PYTHON}.get(language, grammars.TYPESCRIPT), "file")


def _refuse(word: str):
    raise ValueError(word)


def _exact(language: str, text: str) -> bool | None:
    """What the language's own parser says; None where there is none or it gives up."""
    try:
        if language == "json":
            json.loads(text, parse_constant=_refuse)
        elif language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        else:
            return None
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError):
        return False
    return True


def check(content: bytes, language: str) -> tuple[str, int, str] | None:
    """None for a valid file, else (reason, offset, token class)."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as error:
        return "not_utf8", error.start, ""
    text = text.removeprefix("﻿")
    if language == "json":
        moves, starts = lexers.json_tokens(text)
    elif language == "python":
        moves, starts = lexers.python_tokens(text)
    else:
        moves, starts = lexers.typescript_tokens(text, language == "tsx")
    own = grammar(language)
    failed = own.failure(moves)
    exact = _exact(language, text)
    if exact or failed is None and exact is None:
        return None
    if failed is None:
        return "refused_by_context", 0, ""
    if failed >= len(moves):
        return "truncated", len(text), ""
    return "unexpected_token", starts[failed], moves[failed][0]


def syntax_errors(records: DataFrame) -> DataFrame:
    """record_id, project_key, language, reason, at, token of every record with a known extension.

    records: record_id, project_key, relative_path, content. reason is null for valid files.
    """
    ending = F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z]+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [check(c, k) or (None, None, None) for c, k in zip(batch.column("content").to_pylist(), batch.column("language").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("record_id"), batch.column("project_key"), batch.column("language"),
                    pa.array([f[0] for f in found], type=pa.string()),
                    pa.array([f[1] for f in found], type=pa.int64()),
                    pa.array([f[2] for f in found], type=pa.string()),
                ],
                names=["record_id", "project_key", "language", "reason", "at", "token"],
            )

    rows = records.select("record_id", "project_key", language.alias("language"), "content").where("language is not null and content is not null")
    out = rows.mapInArrow(run, "record_id long, project_key string, language string, reason string, at long, token string")
    return out.distinct()  # of results, not of contents


def error_rates(checked: DataFrame) -> DataFrame:
    """Files and invalid files of each project and language."""
    return checked.groupBy("project_key", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("reason").alias("n_invalid"), (F.count("reason") / F.count(F.lit(1))).alias("rate")
    )
