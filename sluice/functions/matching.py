"""Matches of rules with exact positions, one file at a time.

Spark's own regular expressions give no positions and have neither a time limit nor a
way out of a runaway pattern: a deep recursion ends the executor. So rules run here in
Python's engine, in one pass a rule, and a file that fails or takes too long gives a
failure in place of its matches; the others go on.
"""

from __future__ import annotations

import math
import re
import signal
import threading
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate


class OutOfTime(Exception):
    """A file took longer than it may."""


@contextmanager
def time_limit(seconds: float | None) -> Iterator[None]:
    """Raise OutOfTime in the block after so many seconds; no limit outside a process's main thread."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise OutOfTime

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def bits(value: str) -> float:
    """Shannon entropy in bits a character; 0 for an empty value. [D8]"""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


class Lines:
    """Lines and columns, from 1, of offsets in one text. [D5]"""

    def __init__(self, text: str):
        self._breaks = [e - 1 for e in accumulate(len(line) + 1 for line in text.split("\n"))][:-1]

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_left(self._breaks, offset)
        return line + 1, offset - (self._breaks[line - 1] if line else -1)


def value_of(match: re.Match, groups: int, series: str) -> str | None:
    """The secret within a match; null drops the hit. [D6, D7]"""
    if series == "uri":
        authority = re.search(r"://([^/?#]*)", match.group())
        userinfo, at, _ = authority[1].rpartition("@") if authority else ("", "", "")
        return userinfo.partition(":")[2] if at and ":" in userinfo else None
    value = match.group(1 if groups else 0)
    return match.group(2) if value is not None and series == "generic" and groups >= 2 else value


def old_value_of(match: re.Match, groups: int, series: str) -> str | None:
    """The oldest way: the only group if there is one, else the whole match; private ones of 100 characters at least. [D4]"""
    value = match.group(1 if groups == 1 else 0)
    return None if value is not None and series == "private" and len(value) < 100 else value


def matches(text: str, rules, most: int | None = None, value_of=value_of) -> Iterator[tuple]:
    """(rule number, value, match, start, end, entropy, lines and columns) of all rules' matches.

    ``rules`` are (number, compiled pattern, series, least entropy, needles). No further
    rule is tried after more than ``most`` hits. [D2, D13]
    """
    lines, found = None, 0
    for number, pattern, series, threshold, needles in rules:
        if most is not None and found > most:
            return
        if needles and not any(n in text for n in needles):
            continue
        for m in pattern.finditer(text):
            value = value_of(m, pattern.groups, series)
            if value is None:
                continue
            entropy = bits(value)
            if threshold is not None and entropy < threshold:
                continue
            if lines is None:
                lines = Lines(text)
            (line, col), (line_end, col_end) = lines.at(m.start()), lines.at(m.end())
            found += 1
            yield number, value, m.group(), m.start(), m.end(), entropy, line, line_end, col, col_end
