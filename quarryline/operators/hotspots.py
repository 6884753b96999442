"""Hotspots of JavaScript text, and what is done about them.

A small lexer knows comments, strings, regular expressions and templates, so
matches inside them do not count; two patterns are looked for in its tokens:

* a declarator ``name = 'text'`` of var, let or const whose name has password
  or secret in it, and whose value is one string literal and nothing more;
* a call of the plain name ``eval``.

Broken text is scanned as far as its tokens go; what is not closed does not
match.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.reports import patch_range

SECRET, EVAL = "hardcoded_secret", "insecure_eval_call"
ROWS = "node_type STRING, code_snippet STRING, start_line INT, end_line INT, risk_level STRING"

_SPACE = re.compile(r"[\s﻿]+|//[^\n\r  ]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*", re.S)
_NAME = re.compile(r"[^\W\d][\w$‌‍]*|[$_][\w$‌‍]*|#[\w$]+")
_NUMBER = re.compile(r"\.?\d(?:[\w.]|(?<=[eE])[+-])*")
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|.))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[\w$]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_SIGN = re.compile(r"\?\.(?!\d)|=>|\.\.\.|[<>=!*&|?+\-]{1,4}=?|[/%^]=?|.", re.S)

#: After these words a slash starts a regular expression.
_OPERATOR_WORDS = frozenset("await case delete do else in instanceof new of return throw typeof void yield".split())
#: After a string these go on with the same expression.
_GOES_ON = frozenset([*"+-*/%.[(?<>=&|^`", "?.", "**", "==", "===", "!=", "!==", "<=", ">=", "&&", "||", "??", "<<", ">>", ">>>", "in", "instanceof"])


class Token:
    __slots__ = ("kind", "text", "start", "end", "newline")

    def __init__(self, kind: str, text: str, start: int, end: int, newline: bool):
        self.kind, self.text, self.start, self.end, self.newline = kind, text, start, end, newline


def lex(code: str) -> list[Token]:
    """The tokens: name, string, number, regex, template (its fixed pieces), sign. ``newline``: one stands before it."""
    out: list[Token] = []
    nest: list[str] = []  # open braces; ` for one that a template opened
    i, newline = 0, False

    def put(kind: str, end: int) -> int:
        nonlocal newline
        out.append(Token(kind, code[i:end], i, end, newline))
        newline = False
        return end

    def template(at: int) -> int:
        """From the character after a back tick or a closing brace to the next ${ or the end."""
        end = _CHUNK.match(code, at).end()
        if code.startswith("${", end):
            nest.append("`")
            return end + 2
        return min(end + 1, len(code))

    while i < len(code):
        if m := _SPACE.match(code, i):
            newline |= any(c in m[0] for c in "\n\r  ")
            i = m.end()
            continue
        c = code[i]
        if m := _NAME.match(code, i):
            i = put("name", m.end())
        elif c.isdigit() or (c == "." and code[i + 1 : i + 2].isdigit()):
            i = put("number", _NUMBER.match(code, i).end())
        elif c in "'\"":
            m = _STRING.match(code, i)
            i = put("string", m.end()) if m else put("sign", i + 1)
        elif c == "`":
            i = put("template", template(i + 1))
        elif c == "}" and nest and nest.pop() == "`":
            i = put("template", template(i + 1))
        elif c == "/" and _regex_may_start(out) and (m := _REGEX.match(code, i)):
            i = put("regex", m.end())
        else:
            if c == "{":
                nest.append("{")
            i = put("sign", i + 1 if c in "(){}[];,:~@\\" else _SIGN.match(code, i).end())
    return out


def _regex_may_start(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    if last.kind == "name":
        return last.text in _OPERATOR_WORDS
    if last.kind == "template":
        return last.text.endswith("${")
    return last.kind == "sign" and last.text not in (")", "]", "}", "++", "--")


_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")


def _closings(tokens: list[Token]) -> list[int | None]:
    """For each token that opens a bracket, the index of the one that closes it; else null."""
    out: list[int | None] = [None] * len(tokens)
    open_: list[int] = []
    for k, t in enumerate(tokens):
        if t.kind == "template":
            opens, closes = t.text.endswith("${"), t.text.startswith("}")
            if opens and closes:  # a piece between two values of one template
                continue
        else:
            opens, closes = t.kind == "sign" and t.text in _OPEN, t.kind == "sign" and t.text in _CLOSE
        if opens:
            open_.append(k)
        elif closes and open_:
            out[open_.pop()] = k
    return out


def _declarators(tokens: list[Token], closing: list[int | None], i: int) -> Iterator[tuple[Token, Token]]:
    """(name, string) of the declarators after the keyword at i."""
    k = i + 1
    while k < len(tokens):
        name = tokens[k] if tokens[k].kind == "name" else None
        if name is None:
            if tokens[k].text not in ("{", "["):
                return
            end = closing[k]
            if end is None:
                return
            k = end
        k += 1
        if k < len(tokens) and tokens[k].text == "=":
            value, after = tokens[k + 1 : k + 2], tokens[k + 2 : k + 3]
            if name and value and value[0].kind == "string" and not (after and (after[0].kind == "template" or after[0].text in _GOES_ON)):
                yield name, value[0]
            k = _value_end(tokens, closing, k + 1)
        if k >= len(tokens) or tokens[k].text != ",":
            return
        k += 1


def _value_end(tokens: list[Token], closing: list[int | None], k: int) -> int:
    """The index of the comma or end after the expression at k."""
    first = k
    while k < len(tokens):
        t = tokens[k]
        if k > first and t.newline and t.kind in ("name", "string", "number", "regex") and t.text not in ("in", "instanceof") and _ends_value(tokens[k - 1]):
            return k
        if t.kind == "sign" and t.text in (",", ";", ")", "]", "}"):
            return k
        if (t.kind == "sign" and t.text in _OPEN) or (t.kind == "template" and t.text.startswith("`") and t.text.endswith("${")):
            end = closing[k]
            if end is None:
                return len(tokens)
            k = end
        k += 1
    return k


def _ends_value(t: Token) -> bool:
    return t.kind in ("string", "number", "regex", "template") or (t.kind == "name" and t.text not in _OPERATOR_WORDS) or t.text in (")", "]", "}", "++", "--")


def scan(code: str | None) -> list[tuple[str, str, int, int, str]]:
    """(node_type, code_snippet, start_line, end_line, risk_level) in the order of their start."""
    if not code:
        return []
    tokens, found = lex(code), []
    closing = _closings(tokens)
    for i, t in enumerate(tokens):
        if t.kind != "name" or (i and tokens[i - 1].text in (".", "?.")):
            continue
        if t.text in ("var", "let", "const"):
            for name, value in _declarators(tokens, closing, i):
                lower = name.text.lower()
                if "password" in lower or "secret" in lower:
                    found.append((name.start, value.end, SECRET, "High"))
        elif t.text == "eval" and not (i and tokens[i - 1].text in ("new", "function", "class") or i > 1 and tokens[i - 1].text == "*" and tokens[i - 2].text == "function"):
            k = i + 2 if tokens[i + 1 : i + 2] and tokens[i + 1].text == "?." else i + 1
            if k < len(tokens) and tokens[k].text == "(" and (end := closing[k]) is not None:
                after = tokens[end + 1] if end + 1 < len(tokens) else None
                if not (after and after.text == "{" and not after.newline):  # a method of that name
                    found.append((t.start, tokens[end].end, EVAL, "Critical"))
    starts = [0, *(m.end() for m in re.finditer("\n", code))] if found else []
    line = lambda at: bisect_right(starts, at)
    return [(kind, code[a:b], line(a), line(b), risk) for a, b, kind, risk in sorted(found)]


def hotspots(files: DataFrame, *keys: str, code: str = "code") -> DataFrame:
    """keys, pos and the hotspots of each row, through Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            index, rows = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for pos, hotspot in enumerate(scan(text)):
                    index.append(i)
                    rows.append((pos, *hotspot))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            at = pa.array(index, type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *(pa.array(c, type=t) for c, t in zip(columns, kinds))], names=[*keys, "pos", "node_type", "code_snippet", "start_line", "end_line", "risk_level"])

    rows = files.select(*keys, F.col(code).cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "pos INT", ROWS])
    return rows.mapInArrow(run, schema)


def register_udtf(spark, name: str = "scan_js") -> None:
    """``SELECT * FROM scan_js(code)`` in SQL."""
    from pyspark.sql.functions import udtf

    class ScanJs:
        def eval(self, code: str):
            yield from scan(code)

    spark.udtf.register(name, udtf(ScanJs, returnType=ROWS))


def patched(found: DataFrame, patches: DataFrame, *keys: str) -> DataFrame:
    """Hotspots with their patch by position in the file: an equi join, null where there is none."""
    return found.join(patches.withColumnRenamed("hotspot_index", "pos"), [*keys, "pos"], "left")


def editor_ranges(found: DataFrame, patches: DataFrame, files: DataFrame, *keys: str, code: str = "code") -> DataFrame:
    """keys, pos, start_line, start_char, end_line, end_char of each patch in an editor's units: lines from 0, UTF-16 units.

    A patch of a hotspot that there is none of has no row.
    """
    line = F.get(F.split(F.col(code), "\r\n|\r|\n"), F.col("start_line") - 1)
    placed = patched(found, patches, *keys).where(F.col("original_code").isNotNull()).join(files.select(*keys, code), list(keys))
    at = patch_range(line, F.col("original_code"))
    return placed.select(*keys, "pos", (F.col("start_line") - 1).alias("start_line"), at["start"].alias("start_char"), (F.col("end_line") - 1).alias("end_line"), at["end"].alias("end_char"))
