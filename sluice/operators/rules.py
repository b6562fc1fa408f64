"""The detection rules: our own catalogue, and loading of others."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    """A detection rule; ``entropy`` is the least that a value must have. [1.3]"""

    rule_name: str
    regex: str
    series: str
    is_mechanical: str = "machine"
    entropy: float | None = None
    need_keyvalue: bool = False
    #: Literals of which every matching text holds one; a text without them is not matched at all.
    needles: tuple[str, ...] = ()

    @property
    def groups(self) -> int:
        return re.compile(self.regex).groups


#: Our own catalogue. Classes are spelled out in ASCII. Look-behinds keep long runs linear: a match
#: that fails from the start of a run, or of a chain of names, fails from within it.
CATALOGUE = (
    Rule("generic-api-key", r"""(token|secret|api_key|apikey|access_key)[ ]{0,3}[=:][ ]{0,3}["']?([0-9A-Za-z_\-]{16,64})["']?""", "generic", entropy=3.0, need_keyvalue=True, needles=("token", "secret", "api_key", "apikey", "access_key")),
    Rule("Email Address", r"(?:(?<![A-Za-z0-9._%+\-])|(?<=[A-Za-z0-9\-])(?=[._%+]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++", "contact", "human", needles=("@",)),
    Rule("IPv4 Address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "address"),
    Rule("Host Name", r"(?<![a-z0-9])(?<![a-z0-9]\.)[a-z0-9]++(?:\.[a-z0-9\-]+)*\.(?:com|org|net|io)", "address", needles=(".com", ".org", ".net", ".io")),
    Rule("Hex Digest", r"[0-9a-f]{40}", "digest", entropy=2.0),
    Rule("Card Number", r"[0-9]{16}", "payment", entropy=2.5),
    Rule("Uri", r"(?:https?|ftp)://[A-Za-z0-9._\-]+:[^@/ \n\"']+@[A-Za-z0-9._\-]+", "uri", needles=("://",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]*", "jwt", needles=("eyJ",)),
    Rule("Private Key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----", "private", needles=("PRIVATE KEY-----",)),
    Rule("AWS API Secret", r"AKIA[0-9A-Z]{16}", "aws", needles=("AKIA",)),
)

#: Series whose rules need each other: a file must show every factor. None of our own rules does. [D15]
FACTORS: dict[str, tuple[str, ...]] = {}


def valid(rules: list[Rule]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """The rules that can run, and (name, reason) of the others. [S8]"""
    good, bad = [], []
    for rule in rules:
        try:
            re.compile(rule.regex)
            good.append(rule)
        except re.error as why:
            bad.append((rule.rule_name, str(why)))
    return good, bad


def load(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a JSON table (an array, or one object a line); invalid ones are left out. [S8]"""
    known = spark.read.option("multiLine", True).json(path)
    missing = {"entropy": "double", "need_keyvalue": "boolean"}
    for name, kind in missing.items():
        if name not in known.columns:
            known = known.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    rows = known.select("rule_name", "regex", "series", "is_mechanical", "entropy", "need_keyvalue").collect()
    return valid([Rule(r.rule_name, r.regex, r.series, r.is_mechanical or "machine", r.entropy, bool(r.need_keyvalue)) for r in rows])[0]


def table(spark: SparkSession, rules: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """The rules as a table."""
    return spark.createDataFrame([(r.rule_name, r.regex, r.series, r.is_mechanical, r.entropy, r.need_keyvalue) for r in rules],
                                 "rule_name string, regex string, series string, is_mechanical string, entropy double, need_keyvalue boolean")
