"""Scanning assets with rules, and the reductions over the hits of a file.

A hit is a row. A scan is one pass over the assets, in Arrow batches and without a
shuffle; the steps after it are windows and joins keyed by file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sluice.functions.batches import bound_batches
from sluice.functions.matching import OutOfTime, matches, old_value_of, time_limit, value_of
from sluice.functions.text import unescape_text
from sluice.operators import strings
from sluice.operators.rules import CATALOGUE, FACTORS, Rule
from sluice.schema import HIT_KEY
from sluice.staging import stage

#: Hits of a file after which no further rule is tried. [D13]
HIT_CAP = 100_000
#: Seconds that a file may take. [D18]
TIMEOUT = 30.0
#: Hits sent on together.
BUFFER = 20_000
#: Offsets of a bin of the containment join.
BIN = 1024
EXEMPT_ENDINGS = ("URL", "ID", "User", "Domain")
_FOUND = T.StructType([T.StructField(name, kind) for kind, names in (
    (T.IntegerType(), ("rule_ord",)), (T.StringType(), ("rule_name", "series", "is_mechanical")), (T.BooleanType(), ("need_keyvalue",)),
    (T.StringType(), ("value", "match")), (T.IntegerType(), ("index_start", "index_end")), (T.DoubleType(), ("entropy",)),
    (T.IntegerType(), ("line_start", "line_end", "col_start", "col_end")), (T.LongType(), ("ord",)), (T.StringType(), ("failure",))) for name in names])


def attempts(assets: DataFrame, rules: Iterable[Rule] = CATALOGUE, unescaped: bool = True, carry: tuple[str, ...] = (),
             most: int | None = None, timeout: float | None = TIMEOUT, oldest: bool = False) -> DataFrame:
    """Hits of all rules in (file, text), and one row with ``failure`` for each file that could not be scanned. [D1, D2, D5-D8, D13, D18, D19]

    A failure (``timeout``, or the error's name) stands in place of all hits of its file.
    ``ord``, the place of a hit in its file by rule and offset, stands for list order
    wherever that decides. A null text has no hits. ``oldest`` takes values the way that
    the first scanner did. [D4] Without a shuffle or state, so it
    also runs on a stream.
    """
    bound_batches(assets.sparkSession)
    kept = assets.select("file", "text", *carry)
    schema = T.StructType([*[f for f in kept.schema if f.name != "text"], *_FOUND])
    arrow = to_arrow_schema(schema)
    listed = list(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(k, re.compile(r.regex), r.series, r.entropy, r.needles) for k, r in enumerate(listed)]
        head = [(k, r.rule_name, r.series, r.is_mechanical, r.need_keyvalue) for k, r in enumerate(listed)]
        fail = (None,) * (len(_FOUND) - 1)

        def scanned(text: str) -> list[tuple]:
            try:
                with time_limit(timeout):
                    plain = unescape_text(text) if unescaped else text
                    if plain is not text:
                        plain = plain.encode("utf-8", "replace").decode()
                    return [(*head[k], value, match, start, end, bits, line, line_end, col, col_end, (k << 40) + start, None)
                            for k, value, match, start, end, bits, line, line_end, col, col_end in matches(plain, ready, most, old_value_of if oldest else value_of)]
            except OutOfTime:
                return [(*fail, "timeout")]
            except Exception as error:  # whatever one file raises, the others go on
                return [(*fail, type(error).__name__)]

        for batch in batches:
            given = [batch.column(f.name) for f in schema if f.name not in _FOUND.names]
            rows: list[tuple] = []
            of: list[int] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    found = scanned(text)
                    rows += found
                    of += [i] * len(found)
                if rows and (len(rows) >= BUFFER or i + 1 == batch.num_rows):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[len(given):])]
                    yield pa.RecordBatch.from_arrays([*[g.take(pa.array(of, pa.int64())) for g in given], *columns], schema=arrow)
                    rows, of = [], []

    return kept.mapInArrow(work, schema)


def scan(assets: DataFrame, rules: Iterable[Rule] = CATALOGUE, unescaped: bool = True, carry: tuple[str, ...] = (),
         most: int | None = None, timeout: float | None = TIMEOUT, oldest: bool = False) -> DataFrame:
    """The hits among ``attempts``."""
    return attempts(assets, rules, unescaped, carry, most, timeout, oldest).where("failure IS NULL").drop("failure")


def failures(assets: DataFrame, rules: Iterable[Rule] = CATALOGUE, unescaped: bool = True, timeout: float | None = TIMEOUT) -> DataFrame:
    """(file, failure) of the files that could not be scanned. [D18, D19]"""
    return attempts(assets, rules, unescaped, timeout=timeout).where("failure IS NOT NULL").select("file", "failure")


def cap(hits: DataFrame, most: int = HIT_CAP) -> DataFrame:
    """Without the hits of rules that come after ``most`` hits of a file. [D13]"""
    counts = hits.groupBy("file", "rule_ord").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("rule_ord").rowsBetween(Window.unboundedPreceding, -1)
    allowed = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("before") <= most)
    return hits.join(allowed.select("file", "rule_ord"), ["file", "rule_ord"], "left_semi")


def complete_factors(hits: DataFrame, factors: dict[str, tuple[str, ...]] = FACTORS) -> DataFrame:
    """Of series with several factors only hits of files that show exactly all of them. [D15]

    Rules named in lower case pass; names that end like a public factor go.
    """
    if not factors:
        return hits
    wanted = reduce(lambda c, kv: c.when(F.col("series") == kv[0], F.array(*[F.lit(x) for x in sorted(set(kv[1]))])), factors.items(), F.when(F.lit(False), F.array(F.lit(""))))
    shown = hits.where(F.col("series").isin(*factors)).groupBy("file", "series").agg(F.array_sort(F.collect_set("rule_name")).alias("__shown"))
    joined = hits.join(shown, ["file", "series"], "left").withColumn("__wanted", wanted)
    upper = F.lower("rule_name") != F.col("rule_name")
    public = reduce(lambda a, e: a | F.endswith("rule_name", F.lit(e)), EXEMPT_ENDINGS, F.lit(False))
    keep = F.col("__wanted").isNull() | ~upper | ((F.col("__shown") == F.col("__wanted")) & ~public)
    return joined.where(keep).select(*hits.columns)


def drop_contained(hits: DataFrame, width: int = BIN) -> DataFrame:
    """Without hits whose span lies in that of another with a different value in the file. [D14]

    Of equal spans the one of greater ``ord`` stays. The containing hit covers the
    contained one's start, so the join is by (file, bin of ``width`` offsets): hits of
    one huge file meet only near ones, and the bins of a hot file are dealt out.
    """
    inner = hits.withColumn("__bin", F.floor(F.col("index_start") / width)).alias("a")
    outer = hits.select("file", "value", "index_start", "index_end", "ord", F.explode(F.sequence(
        F.floor(F.col("index_start") / width), F.floor(F.col("index_end") / width))).alias("__bin")).alias("b")
    inside = ((F.col("a.file") == F.col("b.file")) & (F.col("a.__bin") == F.col("b.__bin"))
              & (F.col("b.index_start") <= F.col("a.index_start")) & (F.col("a.index_end") <= F.col("b.index_end"))
              & (F.col("a.value") != F.col("b.value"))
              & ((F.col("a.index_start") != F.col("b.index_start")) | (F.col("a.index_end") != F.col("b.index_end")) | (F.col("a.ord") < F.col("b.ord"))))
    return inner.join(outer, inside, "left_anti").drop("__bin")


def dedupe(hits: DataFrame) -> DataFrame:
    """One hit a key (file, rule, value, span), the first, with ``n_seen``. [D22]"""
    by_key = Window.partitionBy(*HIT_KEY)
    numbered = hits.withColumn("__n", F.row_number().over(by_key.orderBy("ord"))).withColumn("n_seen", F.count(F.lit(1)).over(by_key))
    return numbered.where("__n = 1").drop("__n")


def drop_series(hits: DataFrame, series: str = "certification") -> DataFrame:
    """Without a series. [D17]"""
    return hits.where(F.col("series") != series)


def prefix_census(hits: DataFrame) -> DataFrame:
    """(prefix, n_hits, sample) of the key names in front of generic values. [D20]

    A sample of a name that holds ``api`` must have entropy 3.5.
    """
    generic = hits.where("series = 'generic'").withColumn("prefix", F.lower(F.regexp_extract("match", r"^([A-Za-z_]+)", 1)))
    fit = ~F.contains("prefix", F.lit("api")) | (F.col("entropy") >= 3.5)
    return generic.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_hits"), F.min(F.when(fit, F.struct("file", "index_start", "value"))).alias("s")).select("prefix", "n_hits", F.col("s.value").alias("sample"))


def rich(hits: DataFrame) -> DataFrame:
    """The opt-in steps of the rich scan: address exemption, length gates, whole secret. [D9-D12]"""
    private = F.col("series") == "private"
    length = F.length("match")
    curve = F.rlike("match", F.lit("ECC|RSA"))
    kept = hits.where(~((F.col("series") == "generic") & (F.length("value") == 42) & F.startswith("value", F.lit("0x"))))
    kept = kept.where(~(private & ((length < 128) | (curve & (length < 256))))).where(F.length("value") >= 5)
    key = F.regexp_extract("match", r"^([A-Za-z_]+)", 1)
    return kept.withColumns({
        "prefix": F.when(F.col("series") == "generic", key),
        "whole_secret_value": F.when(F.col("series").isin("generic", "uri", "jdbc"), F.col("value")).otherwise(F.trim("match")),
        "index_start": F.when(F.col("series") == "generic", F.col("index_start") + F.length(key)).otherwise(F.col("index_start")),
    })


def keyed_urls(assets: DataFrame) -> DataFrame:
    """URLs that carry a key parameter. [D21]"""
    rule = Rule("keyed-url", r"""https?://[^ \n"'<>]+[?&]key=[A-Za-z0-9_\-]+""", "url")
    return scan(assets, [rule], unescaped=False)


def live(assets: DataFrame, rules: Iterable[Rule] = CATALOGUE, factors: dict[str, tuple[str, ...]] = FACTORS) -> DataFrame:
    """The live composition: scan with its cap, factors, containment, string veto, certification drop. [D2, D16]

    The hits are written once to the shared folder, so that the joins over them do not
    scan the texts again. The veto reads only structured files that have hits left.
    """
    return reduced(assets, stage(scan(assets, rules, most=HIT_CAP), "hits"), factors)


def oldest(assets: DataFrame, rules: Iterable[Rule] = CATALOGUE, factors: dict[str, tuple[str, ...]] = FACTORS) -> DataFrame:
    """The first scanner's composition: its values, then the same reductions. [D4]"""
    return reduced(assets, stage(scan(assets, rules, most=HIT_CAP, timeout=None, oldest=True), "hits"), factors)


def reduced(assets: DataFrame, hits: DataFrame, factors: dict[str, tuple[str, ...]] = FACTORS) -> DataFrame:
    """What factors, containment, string veto and the certification drop leave of the staged ``hits``. [D14-D17]"""
    left = stage(drop_contained(complete_factors(hits, factors)), "reduced")
    structured = assets.select("file", "text").where(F.lower(F.element_at(F.split("file", r"\.", -1), -1)).isin(list(strings.EXTRACTORS)))
    read = strings.extracted(structured.join(left.select("file").distinct(), "file", "left_semi"))
    return drop_series(strings.veto(left, read))
