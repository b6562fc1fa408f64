"""URL allow and block lists as a trie over reversed host labels and path segments.

Rules are strings ``host/path-prefix``. A rule fits its host and every subdomain
if the url's path starts with the rule's path. The longest fitting rule string
decides; of an allow and a block rule with the same string, block decides. Urls
that no rule fits get ``default``.

Defined cases: a null url, an empty url or one without ``://`` has an empty host
and path; no rule fits it. Repeated rows are judged one by one. Columns of the
input named like an output column are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many rules (some hundred MB of trie) are broadcast; more are joined by host.
MAX_BROADCAST_RULES = 200_000
#: Parts that the places of a host like ``com`` are dealt to in that join.
SALTS = 32

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}
_OUT = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class UrlTrie:
    """Host labels from the right, then path segments; the last segment of a rule is a prefix."""

    __slots__ = ("root",)

    def __init__(self, rules: Iterable[tuple[str, str]] = ()):
        self.root = self._node()
        for verdict, rule in rules:
            self.add(verdict, rule)

    @staticmethod
    def _node() -> dict:
        return {"next": {}, "paths": None, "any": None}

    def add(self, verdict: str, rule: str) -> None:
        host, slash, path = rule.partition("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node["next"].setdefault(label, self._node())
        if not slash:
            node["any"] = self._stronger(node["any"], (verdict, rule))
            return
        if node["paths"] is None:
            node["paths"] = {"next": {}, "ends": {}}
        at = node["paths"]
        *whole, last = path.split("/")
        for segment in whole:
            at = at["next"].setdefault(segment, {"next": {}, "ends": {}})
        at["ends"][last] = self._stronger(at["ends"].get(last), (verdict, rule))

    @staticmethod
    def _stronger(a: tuple[str, str] | None, b: tuple[str, str]) -> tuple[str, str]:
        return b if a is None or len(b[1]) > len(a[1]) or (len(b[1]) == len(a[1]) and b[0] == "block") else a

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting (verdict, rule)."""
        best, node = None, self.root
        segments = path.split("/")[1:] if path.startswith("/") else None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["any"]:
                best = self._stronger(best, node["any"])
            if node["paths"] is not None and segments is not None:
                at = node["paths"]
                for k, segment in enumerate(segments):
                    ends = at["ends"]
                    if ends:
                        for n in range(len(segment) + 1) if len(ends) > len(segment) else map(len, ends):
                            hit = ends.get(segment[:n])
                            if hit:
                                best = self._stronger(best, hit)
                    at = at["next"].get(segment) if k + 1 < len(segments) else None
                    if at is None:
                        break
        return best


def host_column(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_trie(spark: SparkSession, df: DataFrame, rules: list[tuple[str, str]], url_col: str, default: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(_OUT)
    def judge(urls: pd.Series) -> pd.DataFrame:
        find, rows = shared.value.find, []
        for url in urls:
            host, path = split_url(url)
            hit = find(host, path)
            rows.append((host, path, hit[1] if hit else None, hit[0] if hit else default))
        return pd.DataFrame(rows, columns=_OUT.names, dtype=object)

    return df.withColumn("__url", judge(F.col(url_col)))


def _by_join(spark: SparkSession, df: DataFrame, rules: list[tuple[str, str]], url_col: str, default: str) -> DataFrame:
    """For rule lists past the bound: rules by host and salt, joined to the distinct hosts and paths of the urls."""
    listed = spark.createDataFrame([(v, r, r.partition("/")[0], "".join(r.partition("/")[1:])) for v, r in rules], "v string, rule string, rule_host string, rule_path string")
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    keyed = df.withColumn("__host", host_column(F.col(url_col))).withColumn("__path", path_column(F.col(url_col)))
    labels = F.split("__host", r"\.")
    places = keyed.select("__host", "__path").distinct().withColumn("salt", F.pmod(F.xxhash64("__host", "__path"), F.lit(SALTS))).withColumn(
        "rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    best = (places.join(listed, ["rule_host", "salt"]).where(F.startswith("__path", "rule_path"))
            .groupBy("__host", "__path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("v") == "block").alias("b"), "rule", "v")).alias("hit")))
    joined = keyed.join(best, ["__host", "__path"], "left")
    return joined.withColumn("__url", F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("hit.rule").alias("rule"),
        F.coalesce("hit.v", F.lit(default)).alias("verdict"))).drop("__host", "__path", "hit")


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]], url_col: str = "url", default: str = "allow",
               max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``df`` with host, path, rule (null if none fits) and verdict of each row's url.

    ``rules`` are (verdict, rule) pairs. Up to ``max_broadcast`` of them travel as
    one broadcast trie, with no shuffle of ``df``; a longer list is joined by host.
    """
    listed = list(rules)
    spark = df.sparkSession
    found = (_by_trie if len(listed) <= max_broadcast else _by_join)(spark, df, listed, url_col, default)
    return found.withColumns({n: F.col(f"__url.{n}") for n in _OUT.names}).drop("__url")
