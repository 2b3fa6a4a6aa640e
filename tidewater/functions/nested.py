"""JSON, URL, array and map functions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_paths(col: Column, paths: Sequence[str]) -> Column:
    """struct(p0, p1, ...) of several JSON paths; null for paths that don't match or texts that aren't JSON."""
    if any(p.count(".") + p.count("[") > 16 for p in paths):
        raise ValueError("a path may have 16 steps")
    return F.struct(*(F.get_json_object(col, p).alias(f"p{i}") for i, p in enumerate(paths)))


_STRING = r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\''
_TOKEN = re.compile(rf"\s*(?:({_STRING})|(-?[0-9][0-9.eE+-]*|true|false|null)|([{{}}\[\],:]))", re.DOTALL)
#: Objects whose values all come out of the JVM's parser as they are written.
_FLAT = r'^\s*\{\s*(?:"[^"\\]*"\s*:\s*(?:"[^"\\]*"|-?[0-9]{1,18}|true|false)\s*(?:,(?!\s*\})\s*|(?=\})))*\}\s*$'


def _unquoted(text: str) -> str:
    if text[0] == "'":
        text = '"' + text[1:-1].replace("\\'", "'").replace('"', '\\"') + '"'
    return json.loads(text, strict=False)


def raw_fields(text: str) -> list[tuple[str, str | None]] | None:
    """The fields of a JSON object with nested values and numbers as they are written; None for other texts."""
    out, stack, at, key, begin, want = [], [], 0, None, 0, "start"
    text = text.rstrip()
    while at < len(text) or want != "end":
        m = _TOKEN.match(text, at)
        if not m or want == "end":
            return None
        string, scalar, sign = m.groups()
        start, at = m.end() - len(string or scalar or sign), m.end()
        if want == "start":
            if sign != "{":
                return None
            stack, want = ["{"], "key or end"
        elif want in ("key", "key or end") and string:
            key, want = string if len(stack) == 1 else key, "colon"
        elif want == "colon" and sign == ":":
            want = "value"
            begin = None if len(stack) == 1 else begin
        elif want in ("value", "value or end") and (string or scalar or sign in ("{", "[")):
            begin = start if len(stack) == 1 else begin
            if sign:
                stack.append(sign)
                want = "key or end" if sign == "{" else "value or end"
            else:
                want = "more"
                if len(stack) == 1:
                    out.append((_unquoted(key), _unquoted(string) if string else None if scalar == "null" else scalar))
        elif want == "more" and sign == ",":
            want = "key" if stack[-1] == "{" else "value"
        elif want in ("more", "key or end", "value or end") and sign and sign == {"{": "}", "[": "]"}[stack[-1]]:
            stack.pop()
            want = "more" if stack else "end"
            if len(stack) == 1:
                out.append((_unquoted(key), text[begin:at]))
        else:
            return None
    return out


def _fields(texts: pd.Series) -> pd.Series:
    def fields(text: str | None) -> list[dict] | None:
        got = None if text is None else raw_fields(text)
        return None if got is None else [{"key": k, "value": v} for k, v in dict(got).items()]

    return texts.map(fields)


def json_map(col: Column) -> Column:
    """MAP<STRING,STRING> of a JSON object's fields; null for other texts.

    Values are verbatim, but strings come without their quotes and escapes and null is null; of a repeated
    field the last counts.  Flat objects are read in the JVM, others by a vectorised UDF.
    """
    flat = F.coalesce(F.regexp_like(col, F.lit(_FLAT)), F.lit(False))
    easy = F.from_json(F.when(flat, col), "map<string,string>")
    others = F.pandas_udf(_fields, "array<struct<key:string,value:string>>")(F.when(~flat, col))
    return F.when(flat, easy).otherwise(F.map_from_entries(others))


def typed(col: Column, kind: T.DataType) -> Column:
    """A value of strings (also in structs, arrays and map values) as ``kind``; what can't be cast is null."""
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(typed(col[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: typed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, x: typed(x, kind.valueType))
    return col.try_cast(kind)


def remove_quotes(col: Column, null_if_bare: bool = False) -> Column:
    """The text within one pair of double quotes; other texts stay, or become null."""
    quoted = (F.length(col) > 1) & col.startswith('"') & col.endswith('"')
    return F.when(quoted, col.substr(F.lit(2), F.length(col) - 2)).otherwise(F.lit(None) if null_if_bare else col)


def url_part(col: Column, part: str, key: Column | str | None = None, mode: str = "try") -> Column:
    """PROTOCOL, HOST, PATH or QUERY of a URL, or one query parameter; invalid URLs give null or fail (ansi)."""
    args = [col, F.lit(part)] + ([] if key is None else [key if isinstance(key, Column) else F.lit(key)])
    return F.call_function("try_parse_url" if mode == "try" else "parse_url", *args)


def slice_list(col: Column, start: Column | int, length: Column | int, checked: bool = True) -> Column:
    """1-based slice, negative starts count from the end; start 0 or a negative length fails, or gives []."""
    s, n = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    if checked:
        return F.slice(col, s, n)
    bad = (s == 0) | (n < 0)
    return F.when(bad & col.isNotNull(), F.slice(col, 1, 0)).otherwise(F.slice(col, F.when(bad, 1).otherwise(s), F.when(bad, 0).otherwise(n)))


def sort_map(col: Column, descending: bool = False) -> Column:
    """The map with its entries in order of their keys; values may be of any type, maps too."""
    entries = F.array_sort(F.map_entries(col), lambda x, y: F.when(x.key < y.key, -1).when(x.key > y.key, 1).otherwise(0))
    return F.map_from_entries(F.reverse(entries) if descending else entries)


def zip_maps(a: Column, b: Column) -> Column:
    """MAP of every key of either map to struct(a, b); a missing side is null."""
    return F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("a"), y.alias("b")))


def first_true(*cols: Column) -> Column:
    """Number of the first true column, or the number of columns; null counts as not true."""
    out = F
    for i, c in enumerate(cols):
        out = out.when(c, i)
    return out.otherwise(len(cols))
