"""One linear pass over JavaScript / JSX text: route elements, hook calls and
import declarations as a syntax tree would show them.

A finite-state transducer with a stack: code, template, open tag and element
children, nested to any depth.  Comments, strings, regular expressions and JSX
text are consumed where they stand, so an apostrophe in JSX text opens no
string, a ``//`` in a string no comment, and nothing inside a comment is seen.
Every character is consumed once; each step is one anchored match.

``syntax`` is the Column form (an Arrow UDF: the other columns stay in the
JVM).  Defined results: a null text has no routes, hooks or imports; an element
or string that never ends is closed by the end of the text (a route element
whose tag never ends is none).  Files ending in ``.ts`` hold no JSX.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

SYNTAX = ("struct<routes:array<struct<line:int,self_closing:boolean,path:string,component:string,element:string>>,"
          "hooks:array<string>,imports:array<struct<line:int,source:string>>>")

SPACE = r"[ \t\r\n\f\v ﻿]"
CODE = re.compile(
    rf"(?P<skip>{SPACE}++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)|(?P<word>[\w$]++)"
    r"""|(?P<string>"(?:[^"\\\n]|\\[\s\S])*+"?|'(?:[^'\\\n]|\\[\s\S])*+'?)|(?P<sign>=>|[\s\S])""")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
TEXT = re.compile(r"[^{<]*+")
TAG = re.compile(
    rf"""(?P<skip>{SPACE}++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)|(?P<word>[\w$][\w$.:-]*+)|(?P<string>"[^"]*+"?|'[^']*+'?)|(?P<sign>/>|[\s\S])""")
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+")
OPEN = re.compile(r"<(?:([^\W\d][\w$.:-]*+|\$[\w$.:-]*+)|(?=>))")
TYPE_PARAMETER = re.compile(rf"{SPACE}*+(?:,|extends\b)")
CLOSE = re.compile(r"</[^>]*+>?")
# Where an expression may start: after these signs, these words, or nothing.
BEFORE_EXPRESSION = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ =>".split()) | frozenset(
    "return default case yield await else do in of typeof void delete".split()) | {""}
NOT_CALLED = frozenset(("function", "new"))
ROUTE_VALUES = ("path", "component", "element")


class Code:
    """Braces of code: the last sign or word, the word before it, and the
    hook whose type arguments are being read with their depth."""

    def __init__(self, start: int = 0):
        self.start, self.last, self.before, self.generic, self.angles = start, "", "", "", 0


class Tag:
    """An open tag; ``values`` of a route element, else None."""

    def __init__(self, start: int, route: bool):
        self.start, self.from_, self.values, self.name, self.equals = start, start, {} if route else None, None, False

    def word(self, name: str) -> None:
        """An attribute; without a value it stands for its own name."""
        self.name, self.equals = None, False
        if self.values is not None and name in ROUTE_VALUES and name not in self.values:
            self.name, self.values[name] = name, name

    def value(self, text: str, start: int, end: int) -> None:
        if self.equals and self.name:
            self.values[self.name] = text[start:end]
        self.equals = False


def scan(text: str, hooks: frozenset[str], jsx: bool = True) -> tuple[list, list, list]:
    """(routes, hooks, imports) of one text: routes as (start, self-closing,
    path, component, element) by start, distinct hooks by first call, imports
    as (start, source)."""
    routes, called, imports = [], {}, []
    stack: list = [Code()]
    at, n, pending = 0, len(text), -1
    plain = 0  # before here a slash opens no regular expression

    def ended(end: int) -> None:
        """An element is complete: the value or part of what holds it."""
        top = stack[-1]
        if isinstance(top, Code):
            top.last = ""  # another element may follow, no operator
        elif isinstance(top, Tag):
            top.value(text, top.from_, end)

    while at < n:
        top = stack[-1]
        if isinstance(top, Code):
            m = CODE.match(text, at)
            kind, token, begin, at = m.lastgroup, m.group(), at, m.end()
            if kind == "skip":
                continue
            if kind == "word":
                if token == "import" and len(stack) == 1 and top.last != ".":
                    pending = begin
                top.before, top.last = top.last, token
                if not top.angles:
                    top.generic = ""
                continue
            if kind == "string":
                if pending >= 0 and len(stack) == 1:
                    imports.append((pending, token.strip("'\"`")))
                    pending = -1
                top.last = ")"
                continue
            starts = top.last in BEFORE_EXPRESSION
            if token == "<" and jsx and starts and not top.angles:
                m = OPEN.match(text, begin)
                if m and not TYPE_PARAMETER.match(text, m.end()):
                    stack.append(Tag(begin, m.group(1) == "Route"))
                    at = m.end()
                    continue
            if token == "/" and starts and begin >= plain:
                m = REGEX.match(text, begin)
                if m:
                    at, top.last = m.end(), ")"
                    continue
                # Not closed on its line: slashes divide up to the line's end.
                plain = text.find("\n", begin) % (n + 1)
            if token == "`":
                stack.append("`")
                continue
            if token == "{":
                stack.append(Code(begin))
                continue
            if token == "}":
                if len(stack) > 1:
                    stack.pop()
                    top = stack[-1]
                    if isinstance(top, Code):
                        top.last = "}"
                    elif isinstance(top, Tag):
                        top.value(text, top.from_, at)
                continue
            if token == "<":
                if top.angles or top.last in hooks:
                    top.generic, top.angles = top.generic or top.last, top.angles + 1
            elif token == ">":
                top.angles = max(top.angles - 1, 0)
            elif not top.angles:
                if token == "(":
                    name = top.generic or (top.last if top.before not in NOT_CALLED else "")
                    if name in hooks:
                        called.setdefault(name)
                top.generic = ""
            if token in "(.;":
                pending = -1
            top.before, top.last = "", token
        elif isinstance(top, Tag):
            m = TAG.match(text, at)
            kind, token, begin, at = m.lastgroup, m.group(), at, m.end()
            if kind == "word":
                top.word(token)
            elif kind == "string":
                top.value(text, begin, at)
            elif token == "=":
                top.equals = True
            elif token == "{":
                top.from_ = begin
                stack.append(Code(begin))
            elif token == "<" and top.equals:
                m = OPEN.match(text, begin)
                if m:
                    top.from_ = begin
                    stack.append(Tag(begin, m.group(1) == "Route"))
                    at = m.end()
            elif token in (">", "/>"):
                stack.pop()
                if top.values is not None:
                    routes.append((top.start, token == "/>", *[top.values.get(k) for k in ROUTE_VALUES]))
                if token == ">":
                    stack.append(">")
                else:
                    ended(at)
        elif top == "`":
            at = TEMPLATE.match(text, at).end()
            if at < n and text[at] == "`":
                at += 1
                stack.pop()
                stack[-1].last = ")"
            else:
                stack.append(Code(at + 1))
                at += 2
        else:
            at = TEXT.match(text, at).end()
            if at >= n:
                break
            if text[at] == "{":
                stack.append(Code(at))
                at += 1
            elif text.startswith("</", at):
                at = CLOSE.match(text, at).end()
                stack.pop()
                ended(at)
            else:
                m = OPEN.match(text, at)
                if m:
                    stack.append(Tag(at, m.group(1) == "Route"))
                at = m.end() if m else at + 1
    return sorted(routes, key=lambda r: r[0]), list(called), imports


def _with_lines(text: str, found: list) -> list[tuple]:
    """``found`` with each start (ascending) as a 1-based line."""
    out, at, line = [], 0, 1
    for start, *rest in found:
        line += text.count("\n", at, start)
        at = start
        out.append((line, *rest))
    return out


def _structs(rows: list[list[tuple]], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.Array:
    """One list of structs a text."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    flat = [x for r in rows for x in r]
    columns = [pa.array([x[i] for x in flat], k) for i, k in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(names)))


def syntax(text: Column, path: Column, hooks: list[str]) -> Column:
    """The ``SYNTAX`` struct of each source file."""
    wanted = frozenset(hooks)

    def run(texts: pa.Array, paths: pa.Array) -> pa.Array:
        routes, called, imports = [], [], []
        for t, p in zip(texts.to_pylist(), paths.to_pylist()):
            r, h, i = scan(t or "", wanted, not (p or "").lower().endswith(".ts"))
            routes.append(_with_lines(t or "", r))
            called.append(h)
            imports.append(_with_lines(t or "", i))
        s = pa.string()
        return pa.StructArray.from_arrays([
            _structs(routes, ("line", "self_closing", *ROUTE_VALUES), (pa.int32(), pa.bool_(), s, s, s)),
            pa.array(called, pa.list_(s)), _structs(imports, ("line", "source"), (pa.int32(), s))], ["routes", "hooks", "imports"])

    return F.arrow_udf(run, SYNTAX)(text, path)


# The functions travel to the workers by value: no file of this package has to
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
