import ast
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import syntax
from codestrata.llm.derivatives import Grammar

SCHEMA = "record_id long, project_key string, relative_path string, content binary, reason string, language string, at int"

TS_OK = [
    "", "﻿const a = {b: 1, c};", "type A<T> = T extends string ? 'a' : never;", "for (const [a, b] of Object.entries(x)) console.log(a);", "let x = a < b && c > d;",
    "const f = <T,>(x: T): x is string => true;", "export * as ns from './a';", "const r = /[/\\]]+/g.test(s) ? 1 / 2 : 3;", "const t = `a${b ? `c${d}` : 'e'}f`;",
    "a?.b?.[0]?.();", "var a\nvar b\na = b\n(c)", "type M = { readonly [K in keyof T]?: T[K] };", "let a: Array<Array<number>> = [];",
    "abstract class A<T> extends B<T> implements C { static #x = 1; constructor(private readonly a: number) { super(); } get y(): number { return this.#x } async *gen() { yield* x; } }",
    "const s = `\n<<<<<<< HEAD\n=======\n`;", "/*\n<<<<<<< HEAD\n*/", "export default function () {}", "declare module 'x' { export const a: number; }",
]
TS_BAD = [
    "const a = ;", '{"a": 1, "b": [2]}', "function f( {", "if (a { b }", "let x = 'abc", "a b c", "export interface {{ A }", "import x from ./a';", "}", "x = `abc", "<<<<<<< HEAD\nlet a;\n=======",
    ".a-b { color: red }", "import os\nfrom .a import b", "<!DOCTYPE html>", "const a = 1\n=======\nconst b = 2",
]


def test_typescript():
    assert [t for t in TS_OK if syntax.check(t.encode(), "typescript")] == []
    assert [t for t in TS_BAD if not syntax.check(t.encode(), "typescript")] == []


def test_elements_in_tsx():
    ok = ["const a = <div className=\"x\" {...p} on={() => 1}>text {a} <b/> <></> {/* c */}</div>;", "const f = <T,>(x: T) => x;", "const x = a < b;", "f<string>('');", "<A render={<B />} />;"]
    bad = ["const a = <div></span>;", "const a = <div>;", "const a = <a>}</a>;", "<a></a"]
    assert [t for t in ok if syntax.check(t.encode(), "tsx")] == [] and [t for t in bad if not syntax.check(t.encode(), "tsx")] == []


def test_failing_token_and_truncation():
    assert syntax.check(b"let a = (1 + ;", "typescript") == ("unexpected_token", 13, ";")
    assert syntax.check(b"function f() {\n  return 1;", "typescript")[0] == "truncated"
    assert syntax.check(b'{"a": [1, 2', "json")[0] == "truncated"
    assert syntax.check(b'{"a": 1,}', "json") == ("unexpected_token", 8, "}")
    assert syntax.check(b"a\xff", "json") == ("not_utf8", 1, "")


def test_grammar_takes_the_python_of_the_standard_library():
    import asyncio.tasks
    import dataclasses
    import typing

    own = syntax.grammar("python")
    for module in (ast, json.decoder, dataclasses, typing, asyncio.tasks):
        moves, _ = syntax.lexers.python_tokens(open(module.__file__, encoding="utf-8").read())
        assert own.failure(moves) is None


def test_python_and_json_agree_with_their_parsers():
    for t in ["x = (1", "def f():\npass", "print 'a'", "x = 1\n  y = 2", "except A, b: pass", "a = 'x\n", "f() = 1", "if x:\n\ta\n        b", "<<<<<<< HEAD"]:
        assert syntax.check(t.encode(), "python"), t
    for t in ["", "﻿x = 1\r\n", "match x:\n  case [1, *_] | {'a': b}: pass\n", "def f[T](a, /, *, b: int = 1) -> int: return f'{a!r:>{b}}'\n", "def build(a, a=None): pass\n"]:
        assert not syntax.check(t.encode(), "python"), t
    for t in ["", "NaN", "[1 2]", "{'a': 1}", "01", '"\t"', "[1,]", "{}{}"]:
        assert syntax.check(t.encode(), "json"), t


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=12), st.integers(1, 4))
def test_any_json_and_its_truncations(value, cut):
    text = json.dumps(value, ensure_ascii=False)
    assert syntax.check(text.encode("utf-8", "surrogatepass"), "json") is None or "\\ud" in text.lower() or any(0xD800 <= ord(c) < 0xE000 for c in text)
    if isinstance(value, (list, dict)):
        assert syntax.check(text[:-cut].encode("utf-8", "surrogatepass"), "json")


def test_derivatives_of_a_small_language():
    g = Grammar("file = ('a' file 'b')?", "file")
    word = lambda s: [(c, False) for c in s]
    assert g.failure(word("aabb")) is None and g.failure(word("aab")) == 3 and g.failure(word("aba")) == 2 and g.failure([]) is None


def test_deep_nesting_and_long_texts():
    assert syntax.check(b"[" * 50_000 + b"]" * 50_000, "json") is None
    assert syntax.check(b"x = " + b"1 + " * 20_000 + b"1\n", "python") is None
    assert syntax.check(("const a = [" + "1, " * 100_000 + "];").encode(), "typescript") is None


def test_table(spark):
    rows = [
        (1, "P", "a/B.JSON", b"{}", None, None, None), (2, "P", "a.json", b"", "x", "y", 1), (3, "P", "a.py", b"x = (", None, None, None), (4, None, "a.pyi", b"", None, None, None),
        (5, "P", "a.css", b"{", None, None, None), (6, "P", None, b"{", None, None, None), (7, "P", "a.ts", None, None, None, None), (3, "P", "a.py", b"x = (", None, None, None),
    ]
    checked = syntax.syntax_errors(spark.createDataFrame(rows, SCHEMA))
    assert {(r.record_id, r.reason is not None) for r in checked.collect()} == {(1, False), (2, True), (3, True), (4, False)} and checked.count() == 4
    rates = {(r.project_key, r.language): (r.n_files, r.n_invalid, r.rate) for r in syntax.error_rates(checked).collect()}
    assert rates == {("P", "json"): (2, 1, 0.5), ("P", "python"): (1, 1, 1.0), (None, "python"): (1, 0, 0.0)}
    assert syntax.syntax_errors(spark.createDataFrame([], SCHEMA)).count() == 0
