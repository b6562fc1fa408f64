"""Text expressions: spans, positions, entropy, names; and the few Python codecs that built-ins lack."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.matching import OutOfTime, time_limit


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty value. [D8]"""
    n = F.length(value)
    chars = F.split(value, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.transform(F.array_distinct(chars), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, b: a + b)
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("match", T.StringType())]))


def spans(text: Column, pattern: str, seconds: float = 30.0) -> Column:
    """(start, end, match) of every match, left to right, offsets in code points from 0; classes know ASCII only. [D5]

    A null text, or one that takes longer, gives none.
    """
    @F.pandas_udf(_SPAN)
    def find(texts: pd.Series) -> pd.Series:
        ready = re.compile(pattern, re.ASCII)

        def one(value: str | None) -> list[dict]:
            try:
                with time_limit(seconds):
                    return [{"start": m.start(), "end": m.end(), "match": m.group()} for m in ready.finditer(value or "")]
            except OutOfTime:
                return []

        return texts.map(one)

    return find(text)


def snake_case(name: Column) -> Column:
    """camelCase, kebab-case and dotted names as snake_case. [R2]"""
    humps = F.regexp_replace(F.trim(name), "([a-z0-9])([A-Z])", "$1_$2")
    flat = F.regexp_replace(F.regexp_replace(humps, "[^A-Za-z0-9_]+", "_"), "_+", "_")
    return F.lower(F.regexp_replace(flat, "^_+|_+$", ""))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether ``text`` contains any of the literals."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(False)


def count_contained(text: Column, words: list[str]) -> Column:
    """How many entries of ``words`` (repeats count again) ``text`` contains."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def before(text: Column, part: Column) -> Column:
    """``text`` up to the first ``part``; all of it if there is none."""
    at = F.position(part, text)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)


def decode_lossy(raw: Column) -> Column:
    """UTF-8 without the undecodable bytes. [S6]"""
    return _lossy(raw)


@F.pandas_udf(T.StringType())
def _lossy(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decode_fallback(raw: Column) -> Column:
    """UTF-8, or latin-1 where that fails. [S7]"""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "iso-8859-1"))


def unescape_text(text: str, rounds: int = 5) -> str:
    """Backslash escapes decoded until nothing changes, ``rounds`` times at most. [D1]

    A round encodes as latin-1 (other characters become ``?``) and decodes
    unicode-escape; texts without a backslash or percent sign stay as they are.
    """
    if "\\" not in text and "%" not in text:
        return text
    for _ in range(rounds):
        try:
            after = text.encode("latin-1", "replace").decode("unicode_escape")
        except UnicodeDecodeError:
            return text
        if after == text:
            return text
        text = after
    return text


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unescape_text(t).encode("utf-8", "replace").decode())


def unescape(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with ``column`` unescaped; only rows that need it go to Python. [D1]"""
    needs = F.contains(column, F.lit("\\")) | F.contains(column, F.lit("%"))
    plain = df.where(~F.coalesce(needs, F.lit(False)))
    return plain.unionByName(df.where(needs).withColumn(column, _unescape(column)))


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "" if t is None else html.unescape(unescape_text(t)).encode("utf-8", "replace").decode())


def plain_text(text: Column) -> Column:
    """Escapes and HTML entities decoded; null as empty. [R1]"""
    return _plain(text)
