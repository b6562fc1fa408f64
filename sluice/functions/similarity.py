"""String similarity: Jaro-Winkler and the ratio of matching blocks."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Thresholds of the two measures.
JARO_WINKLER, RATIO = 0.7, 0.6

_INVISIBLE = re.compile("[\ud800-\udfff﻿​-‏⁠￾￿]")
_NOT_ALNUM = re.compile(r"[\W_]+")


def jaro(a: str, b: str) -> float:
    """Jaro similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for j, c in enumerate(b) if taken[j]]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1, boost: float = 0.7) -> float:
    """Jaro similarity raised for a common prefix of up to four characters, where it is above ``boost``."""
    base = jaro(a, b)
    if base <= boost:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * weight * (1 - base)


def similar(a: str | None, b: str | None) -> bool:
    """Whether two strings are alike by either measure, invisible characters apart. [F18, X14]"""
    if a is None or b is None:
        return False
    a, b = _INVISIBLE.sub("", a), _INVISIBLE.sub("", b)
    if jaro_winkler(a, b) >= JARO_WINKLER:
        return True
    return difflib.SequenceMatcher(None, _NOT_ALNUM.sub("", a), _NOT_ALNUM.sub("", b)).ratio() >= RATIO


@F.pandas_udf(T.BooleanType())
def similar_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype=float)
