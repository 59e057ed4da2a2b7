"""Token streams of source texts: (class, may a statement end before it), and where each begins.

A text that can't be cut into tokens ends with an ERROR token, which no grammar takes.
"""

from __future__ import annotations

import io
import re
import token as T
import tokenize

Tokens = tuple[list[tuple[str, bool]], list[int]]

_JSON = re.compile(
    r'[ \t\r\n]*(?:(?P<p>[{}\[\],:])|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z_.])|(?P<w>true|false|null)(?![0-9A-Za-z_])|(?P<e>$)|(?P<x>.))",
    re.S,
)


def json_tokens(text: str) -> Tokens:
    moves, starts = [], []
    for m in _JSON.finditer(text):
        kind = m.lastgroup
        if kind == "e":
            break
        starts.append(m.start(kind))
        if kind == "x":
            moves.append(("ERROR", False))
            break
        moves.append((m[kind] if kind in "pw" else "STRING" if kind == "s" else "NUMBER", False))
    return moves, starts


_PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is"
    " lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_SOFT = frozenset(("match", "case", "type", "_"))
_PY_PLAIN = frozenset("( ) [ ] { } , : ; . ... = := -> + - * ** ~ @ !".split())
_PY_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


def python_tokens(text: str) -> Tokens:
    moves: list[tuple[str, bool]] = []
    starts: list[int] = []
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            kind, s = t.type, t.string
            if kind in (T.COMMENT, T.NL, T.TYPE_COMMENT, T.ENCODING):
                continue
            if kind == T.ENDMARKER:
                break
            if kind == T.NAME:
                out = [s if s in _PY_WORDS else "SOFT" if s in _PY_SOFT else "NAME"]
            elif kind == T.OP:
                out = [s if s in _PY_PLAIN else "AUGMENTED" if s in _PY_AUGMENTED else "SLASH" if s == "/" else "OPERATOR"]
                if s == "!":
                    out = ["BANG"]
            elif kind in (T.NEWLINE, T.INDENT, T.DEDENT):
                out = [T.tok_name[kind]]
            elif kind in (T.NUMBER, T.STRING):
                out = [T.tok_name[kind]]
            elif kind in (T.FSTRING_START, T.FSTRING_MIDDLE, T.FSTRING_END):
                out = [{T.FSTRING_START: "FSTART", T.FSTRING_MIDDLE: "FTEXT", T.FSTRING_END: "FEND"}[kind]]
            else:
                out = ["ERROR"]
            at = lines[min(t.start[0], len(lines)) - 1] + t.start[1]
            moves += [(x, False) for x in out]
            starts += [at] * len(out)
    except (tokenize.TokenError, SyntaxError, ValueError, MemoryError) as error:
        moves.append(("ERROR", False))
        where = error.args[1] if isinstance(error, tokenize.TokenError) and len(error.args) > 1 else (getattr(error, "lineno", None) or len(lines), 0)
        starts.append(lines[max(0, min(where[0], len(lines)) - 1)])
    return moves, starts


_TS_TOKENS = frozenset(
    "this typeof void new import export function class extends in instanceof null const var enum if else for while do return throw try catch"
    " finally switch case default break continue debugger delete super true false with yield let type interface as of async await from is asserts"
    " satisfies declare abstract namespace static readonly keyof infer require get set unique out override implements".split()
)
_TS_ACCESS = frozenset(("public", "private", "protected", "accessor"))
_TS_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*.*?\*/)+", re.S)
_TS_TOKEN = re.compile(
    r"(?P<id>[^\W\d][\w$]*|\$[\w$]*|\\u\{?[0-9a-fA-F]+\}?[\w$]*)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?)(?![\w$])"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.|\\\n)*\"|'(?:[^'\\\n]|\\.|\\\n)*')|(?P<priv>\#[^\W\d][\w$]*)"
    r"|(?P<op>\?\.(?![0-9])|\.\.\.|=>|\+\+|--|[+\-]=|\*\*=?|\*=|/=|%=?|<<=?|<=|===?|!==?|&&=?|\|\|=?|\?\?=?|&=|\|=|\^=?|[{}()\[\];,<>.?:=+\-*/!~&|@])",
    re.S,
)
_TS_PLAIN = frozenset("{ } ( ) [ ] ; , < > . ? : = + - * / ! ~ & | @ ?. ... =>".split())
_TS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TS_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_TS_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \t\r\n]|$)", re.M)
_ENDS_OPERAND = frozenset(("ID", "CONTEXT", "NUMBER", "STRING", "REGEX", "TEMPLATE", "TTAIL", "PRIVATE", ")", "]", "this", "super", "null", "true", "false", "INCREMENT", "JCLOSE", "JSELF"))
_WORDS_BEFORE_OPERAND = frozenset("typeof void new return throw in instanceof delete await yield case do else of as extends default".split())
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
_J_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_J_TEXT = re.compile(r"[^{}<>]+")
_J_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")


def typescript_tokens(text: str, jsx: bool) -> Tokens:
    moves: list[tuple[str, bool]] = []
    starts: list[int] = []
    stack: list[str] = []  # open braces: {, template, tag, children
    names: list[str] = []  # open elements
    at, end, last, line_break = 0, len(text), "", True
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else end
    pending = False  # the name of a closing element comes next

    def emit(kind: str, where: int) -> None:
        nonlocal last, line_break
        moves.append((kind, line_break or kind == "}"))
        starts.append(where)
        last, line_break = kind, False

    while at < end:
        mode = stack[-1] if stack else "{"
        if mode == "children":
            m = _J_TEXT.match(text, at)
            if m:
                emit("JTEXT", at)
                at = m.end()
                continue
            c = text[at]
            if c == "{":
                stack.append("{")
                emit("{", at)
                at += 1
            elif c == "<":
                if text.startswith("</", at):
                    stack[-1] = "tag"
                    pending = True
                    emit("JEND", at)
                    at += 2
                else:
                    stack.append("tag")
                    emit("JOPEN", at)
                    at += 1
            else:
                emit("ERROR", at)
                break
            continue
        if m := _TS_SPACE.match(text, at):
            if "\n" in m[0]:
                line_break = True
            at = m.end()
            if at >= end:
                break
        if text[at] in "<=>|" and _TS_CONFLICT.match(text, at) and (at == 0 or text[at - 1] == "\n"):
            emit("ERROR", at)
            break
        c = text[at]
        if mode == "tag":
            if m := _J_NAME.match(text, at):
                if last == "JOPEN":
                    names.append(m[0])
                elif pending and (not names or names.pop() != m[0]):
                    emit("ERROR", at)
                    break
                emit("JNAME", at)
                at = m.end()
            elif c in "\"'" and last == "JEQUALS" and (m := _J_STRING.match(text, at)):
                emit("JSTRING", at)
                at = m.end()
            elif c == "=":
                emit("JEQUALS", at)
                at += 1
            elif c == "{":
                stack.append("{")
                emit("{", at)
                at += 1
            elif text.startswith("/>", at):
                names.pop() if names else None
                stack.pop()
                emit("JSELF", at)
                at += 2
            elif c == ">":
                if last == "JOPEN":
                    names.append("")
                elif last == "JEND":
                    if not names or names.pop() != "":
                        emit("ERROR", at)
                        break
                emit("JCLOSE", at)
                at += 1
                if pending:
                    pending = False
                    stack.pop()
                else:
                    stack[-1] = "children"
            elif c == "<" and last == "JEQUALS":
                stack.append("tag")
                emit("JOPEN", at)
                at += 1
            else:
                emit("ERROR", at)
                break
            continue
        if c == "`" or c == "}" and mode == "template":
            inner = c == "}"
            m = _TS_TEXT.match(text, at + 1)
            stop = m.end()
            if stop >= end:
                emit("ERROR", at)
                break
            if text[stop] == "`":
                if inner:
                    stack.pop()
                emit("TTAIL" if inner else "TEMPLATE", at)
                at = stop + 1
            else:
                if not inner:
                    stack.append("template")
                emit("TMIDDLE" if inner else "THEAD", at)
                at = stop + 2
            continue
        operand_next = last not in _ENDS_OPERAND and (last != "}" or line_break)
        if c == "/" and operand_next and (m := _TS_REGEX.match(text, at)):
            emit("REGEX", at)
            at = m.end()
            continue
        if c == "<" and jsx and operand_next and at + 1 < end and (text[at + 1].isalpha() or text[at + 1] in ">_$") and not _GENERIC.match(text, at):
            stack.append("tag")
            emit("JOPEN", at)
            at += 1
            continue
        m = _TS_TOKEN.match(text, at)
        if not m:
            emit("ERROR", at)
            break
        kind, s = m.lastgroup, m[0]
        if kind == "id":
            if last in (".", "?.") or s not in _TS_TOKENS:
                emit("ACCESS" if s in _TS_ACCESS and last not in (".", "?.") and not _plain_name(text, m.end()) else "ID", at)
            elif s == "override" or s == "implements":
                emit("ID" if _plain_name(text, m.end()) else s, at)
            else:
                emit(s, at)
        elif kind == "num":
            emit("NUMBER", at)
        elif kind == "str":
            emit("STRING", at)
        elif kind == "priv":
            emit("PRIVATE", at)
        else:
            if s == "{":
                stack.append("{")
            elif s == "}" and stack:
                stack.pop()
            emit(s if s in _TS_PLAIN else "INCREMENT" if s in ("++", "--") else "OPERATOR", at)
        at = m.end()
    return moves, starts


_AFTER_NAME = re.compile(r"\s*([=:;,.)(?!<>\]}+\-*/&|]|$)")


def _plain_name(text: str, at: int) -> bool:
    """Whether a word that may be a modifier stands as a name here."""
    return bool(_AFTER_NAME.match(text, at))
