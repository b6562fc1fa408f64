"""Strings of structured files, and the veto they give over hits.

Extractors yield the string literals or leaf values of a file with their lines. Files
that cannot be parsed, and kinds without an extractor, veto nothing.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import plistlib
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.similarity import similar

#: Series that no veto touches.
EXEMPT_SERIES = ("jdbc", "private", "uri", "jwt")
_OUT = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("line_start", T.IntegerType()),
                                 T.StructField("line_end", T.IntegerType()), T.StructField("ord", T.IntegerType())]))


def _leaves(value):
    """Leaf texts of nested data: texts over 3 characters (digits over 4), JSON objects in texts opened. [X12]"""
    if isinstance(value, dict):
        for v in value.values():
            yield from _leaves(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _leaves(v)
    elif isinstance(value, str):
        if value.isdigit():
            if len(value) > 4:
                yield value
        elif len(value) > 3:
            if value.lstrip().startswith("{"):
                try:
                    yield from _leaves(json.loads(value))
                    return
                except ValueError:
                    pass
            yield value
    elif value is not None and len(str(value)) > 4:
        yield str(value)


def _placed(text: str, values) -> list[tuple[str, int, int]]:
    """Every occurrence of each distinct value, by first position. [X13]"""
    out = []
    for value in dict.fromkeys(values):
        for m in re.finditer(re.escape(value), text):
            line = text.count("\n", 0, m.start()) + 1
            out.append((m.start(), m.end(), value, line, line + m.group().count("\n")))
    out.sort(key=lambda x: (x[0], -x[1]))
    return [(v, a, b) for _, _, v, a, b in out]


def _outermost(text: str, values) -> list[tuple[str, int, int]]:
    """Occurrences that lie in no other's span. [X5]"""
    spans = [(m.start(), m.end(), v) for v in dict.fromkeys(values) for m in re.finditer(re.escape(v), text)]
    spans.sort(key=lambda x: (x[0], -x[1]))
    out, reach = [], -1
    for a, b, v in spans:
        if b > reach:
            line = text.count("\n", 0, a) + 1
            out.append((v, line, line + text.count("\n", a, b)))
            reach = b
    return out


def python_strings(text: str) -> list[tuple[str, int, int]]:
    """[X1]"""
    nodes = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    nodes.sort(key=lambda n: (n.lineno, n.col_offset))
    return [(n.value, n.lineno, n.end_lineno or n.lineno) for n in nodes]


_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)


def literal_strings(text: str, quotes: str) -> list[tuple[str, int, int]]:
    """Literals in the given quotes, comments apart: for languages with C-like lexing. [X2-X4]"""
    out = []
    for m in _TOKEN.finditer(text):
        if m.group()[0] in quotes:
            line = text.count("\n", 0, m.start()) + 1
            out.append((m.group()[1:-1], line, line + m.group().count("\n")))
    return out


def _xml(text: str):
    root = ET.fromstring(text)
    for node in root.iter():
        yield from node.attrib.values()
        yield from (t.strip() for t in (node.text, node.tail) if t and t.strip())


def _yaml(text: str):
    import yaml

    return _leaves(yaml.safe_load(text))


#: By extension; every other kind is unstructured. [X1-X11]
EXTRACTORS = {
    "py": python_strings,
    "java": lambda t: literal_strings(t, '"'),
    "js": lambda t: literal_strings(t, "\"'`"), "jsx": lambda t: literal_strings(t, "\"'`"), "ts": lambda t: literal_strings(t, "\"'`"),
    "go": lambda t: literal_strings(t, '"`'),
    "json": lambda t: _outermost(t, (v for v in _leaves(json.loads(t)) if len(v) > 10)),
    "ipynb": lambda t: _placed(t, _leaves(json.loads(t))),
    "yaml": lambda t: _placed(t, _yaml(t)),
    "xml": lambda t: _placed(t, (v for v in _xml(t) if v)),
    "csv": lambda t: _placed(t, (c for row in csv.reader(io.StringIO(t)) for c in row if c)),
    "plist": lambda t: _placed(t, _leaves(plistlib.loads(t.encode()))),
}


def extract(file: str | None, text: str | None) -> list[dict] | None:
    """The strings of a file in order; null where it has none to say. [X15]"""
    find = EXTRACTORS.get((file or "").rpartition(".")[2].lower())
    if find is None or text is None:
        return None
    try:
        return [{"value": v, "line_start": a, "line_end": b, "ord": k} for k, (v, a, b) in enumerate(find(text))]
    except Exception:  # any parse error makes the file unstructured, whatever its parser raises
        return None


@F.pandas_udf(_OUT)
def _extract(files: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([extract(f, t) for f, t in zip(files, texts)], dtype=object)


def extracted(assets: DataFrame) -> DataFrame:
    """(file, value, line_start, line_end, ord) of the structured files in (file, text)."""
    return assets.select("file", F.inline(_extract("file", "text")))


@F.pandas_udf(T.IntegerType())
def _verdict(hit: pd.Series, strings: pd.Series) -> pd.Series:
    def one(value: str, found) -> int:
        for s in found:
            if s == value:
                return 1
            url = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]", s) is not None
            if similar(value, s) or (value in s and not url):
                return 0
        return 1

    return pd.Series([one(v, f) for v, f in zip(hit, strings)], dtype="int32")


def veto(hits: DataFrame, strings: DataFrame) -> DataFrame:
    """``hits`` without those that the first matching string of their line speaks against. [X14, D16]

    Equal strings keep a hit; similar ones, or ones that hold its value and are no url, drop it.
    """
    by_line = strings.groupBy("file", "line_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"]).alias("__strings"))
    joined = hits.join(by_line, ["file", "line_start"], "left")
    judged = F.col("__strings").isNotNull() & ~F.col("series").isin(*EXEMPT_SERIES) & ~F.contains("rule_name", F.lit("url"))
    free = joined.where(~judged).select(*hits.columns)
    kept = joined.where(judged).withColumn("__keep", _verdict("value", "__strings")).where("__keep = 1").select(*hits.columns)
    return free.unionByName(kept)
