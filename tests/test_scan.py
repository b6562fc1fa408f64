"""Spans, hits and their reductions against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.functions.similarity import jaro_winkler, similar
from sluice.operators import candidate, scan
from sluice.operators.rules import CATALOGUE, Rule, valid

SCHEMA = "file string, rule_name string, value string, index_start int, index_end int, ord long"


def shannon(v):
    return -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v)) if v else 0.0


def test_spans_equal_finditer(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1.@\né😀 ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "a@b.c"]
    pattern = r"[ab]+@[ab]+(?:\.[ab1]+)?|[0-9]+"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(s.start, s.end, s.match) for s in r.s] for r in df.select("i", tx.spans(F.col("t"), pattern).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)], t


def test_positions_and_entropy(spark):
    text = "one\n  token = \"0123456789abcdef0123\"\nlast"
    rows = scan.scan(spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, text string")).where("series = 'generic'").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.line_start, r.col_start, r.value) == (2, 3, "0123456789abcdef0123")
    assert abs(r.entropy - shannon(r.value)) < 1e-9
    assert text[r.index_start:r.index_end] == r.match


@pytest.mark.parametrize("value", ["", "a", "aab", "0123456789abcdef" * 3, "éé"])
def test_entropy(spark, value):
    assert abs(spark.range(1).select(tx.entropy(F.lit(value))).first()[0] - shannon(value)) < 1e-9


def contained(hits):
    def inside(x, y):
        return (x["file"] == y["file"] and y["index_start"] <= x["index_start"] and x["index_end"] <= y["index_end"] and x["value"] != y["value"]
                and ((x["index_start"], x["index_end"]) != (y["index_start"], y["index_end"]) or x["ord"] < y["ord"]))

    return {h["ord"] for h in hits if not any(inside(h, o) for o in hits)}


@pytest.mark.parametrize("seed", range(3))
def test_containment_equals_pairs_and_ignores_order(spark, seed):
    rng = random.Random(seed)
    hits = []
    for k in range(120):
        a = rng.randint(0, 3000)
        hits.append({"file": rng.choice("fg"), "rule_name": "r", "value": rng.choice("uvw"), "index_start": a, "index_end": a + rng.choice([5, 40, 1500]), "ord": k})
    rng.shuffle(hits)
    df = spark.createDataFrame(hits, SCHEMA)
    assert {r.ord for r in scan.drop_contained(df).collect()} == contained(hits)


def test_cap_dedupe_factors(spark):
    rows = [("f", k // 3, f"R{k // 3}", "s", f"v{k}", k, k + 1, k) for k in range(9)]
    df = spark.createDataFrame(rows, "file string, rule_ord int, rule_name string, series string, value string, index_start int, index_end int, ord long")
    assert scan.cap(df, 3).count() == 6
    assert [r.n_seen for r in scan.dedupe(df.union(df)).collect()] == [2] * 9
    assert scan.complete_factors(df, {"s": ("R0", "R1")}).count() == 0
    assert scan.complete_factors(df, {"s": ("R0", "R1", "R2")}).count() == 9
    lower = df.withColumn("rule_name", F.lower("rule_name"))
    assert scan.complete_factors(lower, {"s": ("X",)}).count() == 9


def test_uri_value_is_the_password(spark):
    df = spark.createDataFrame([("f", "see ftp://user:pa55-word@host.example now")], "file string, text string")
    assert [r.value for r in scan.scan(df).where("series = 'uri'").collect()] == ["pa55-word"]


def test_unescape():
    assert tx.unescape_text("plain") == "plain"
    assert tx.unescape_text(r"a\\x41") == "aA"
    assert tx.unescape_text("%41") == "%41"
    assert tx.unescape_text("é\\n中") == "é\n?"


def test_unescape_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a\\tb"), (2, "c"), (3, None)], "i int, text string")
    assert {r.i: r.text for r in tx.unescape(df).collect()} == {1: "a\tb", 2: "c", 3: None}


def test_rules_fail_closed():
    good, bad = valid([Rule("a", "x+", "s"), Rule("b", "(", "s"), Rule("c", "(?P<n>x)", "s"), Rule("d", "x*", "s"), Rule("e", "[a[b]", "s")])
    assert [r.rule_name for r in good] == ["a", "c", "d", "e"] and len(bad) == 1
    assert valid(list(CATALOGUE))[1] == []


def test_chunked_entropy_boundaries(spark):
    def kept(value):
        df = spark.createDataFrame([(value, "machine", "generic")], "value string, is_mechanical string, series string")
        return candidate.chunked_entropy(df).count() == 1

    high = "abcdefghijklmnopqrstuvwxyz0123"
    assert kept(high) and kept("abcdefgh") and not kept("aaaabbbb")
    assert kept(high * 2) and not kept(high + "a" * 30)


def test_patterns_and_words(spark):
    df = spark.createDataFrame([("xkeyabcdq", "generic-api-key", "machine"), ("q8w3z1r7", "generic-api-key", "machine"), ("1.2.3-x", "generic-api-key", "machine")], "value string, rule_name string, is_mechanical string")
    assert candidate.drop_patterns(df).count() == 2
    assert candidate.drop_versions(df).count() == 2
    worded = spark.createDataFrame([("secretmonkeyhouse", "r", "machine"), ("zq8w3z1r7kx", "r", "machine")], "value string, rule_name string, is_mechanical string")
    assert [r.value for r in candidate.drop_words(worded, ["monkey", "house", "secret"]).collect()] == ["zq8w3z1r7kx"]
    assert len(candidate.sequence_patterns()) == len(set(candidate.sequence_patterns()))


def test_similarity():
    assert round(jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert similar("abc​def", "abcdef") and not similar("abc", "xyz") and not similar(None, "a")


def merged(hits):
    gone = set()
    for i, x in enumerate(hits):
        for y in hits[i + 1:]:
            if x["file"] != y["file"]:
                continue
            if x["value"] == y["value"] and x["index_start"] == y["index_start"]:
                gone.add(y["ord"] if "generic" in y["rule_name"] else x["ord"])
            elif x["index_start"] <= y["index_end"] and y["index_start"] <= x["index_end"] and similar(x["value"], y["value"]):
                gone.add(x["ord"] if "generic" in x["rule_name"] else y["ord"])
    return {h["ord"] for h in hits} - gone


def test_similar_merge_equals_pairs(spark):
    rng = random.Random(9)
    hits = [{"file": "f", "rule_name": rng.choice(["generic-x", "aws"]), "value": rng.choice(["abcdef", "abcdeg", "zzz123"]), "index_start": (a := rng.randint(0, 40)), "index_end": a + 6, "ord": k} for k in range(40)]
    assert {r.ord for r in candidate.merge_similar(spark.createDataFrame(hits, SCHEMA)).collect()} == merged(hits)
