"""Scans that cannot crash, the live path against plain Python, and merging in huge files."""

import ast
import json
import random
import re
import time
from bisect import bisect_right

from sluice.functions.similarity import similar
from sluice.operators import candidate, scan, strings
from sluice.operators.rules import CATALOGUE, Rule

ASSET = "file string, text string"


def test_long_runs_and_chains_end_soon(spark):
    rows = [("mail", "a@b" + ".c" * 5_000), ("host", "x.com " + "a" * 60_000), ("chain", "a." * 30_000 + " x.org"), ("local", "a" * 60_000 + "@"), ("dots", "a.b" * 20_000 + "@x.io")]
    began = time.time()
    got = {(r.file, r.rule_name, r.index_start, r.index_end) for r in scan.scan(spark.createDataFrame(rows, ASSET)).collect()}
    assert time.time() - began < 60
    assert ("mail", "Email Address", 0, 3 + 10_000) in got and ("host", "Host Name", 0, 5) in got and ("chain", "Host Name", 60_001, 60_006) in got
    assert ("dots", "Email Address", 0, 60_005) in got and not any(f == "local" for f, *_ in got)


def test_rules_match_as_plain_patterns_do():
    """The look-arounds change no match."""
    plain = {"Email Address": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", "Host Name": r"[a-z0-9]+(?:\.[a-z0-9\-]+)*\.(?:com|org|net|io)"}
    rng = random.Random(21)
    parts = ["a", "b9", ".", ".", "@", "-", "_", "+", "com", "net", "A", " ", ".io", "a.com"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        for rule in CATALOGUE:
            if rule.rule_name in plain:
                assert [m.span() for m in re.finditer(rule.regex, text)] == [m.span() for m in re.finditer(plain[rule.rule_name], text)], (rule.rule_name, text)


def test_a_file_that_fails_stops_no_other(spark):
    rules = [Rule("slow", r"(?:a+)+$", "s"), Rule("word", r"secret", "s")]
    df = spark.createDataFrame([("bad", "a" * 40 + "! secret"), ("good", "my secret"), ("none", None)], ASSET)
    assert [(r.file, r.value) for r in scan.scan(df, rules, timeout=0.5).collect()] == [("good", "secret")]
    assert [tuple(r) for r in scan.failures(df, rules, timeout=0.5).collect()] == [("bad", "timeout")]


def test_cap_within_a_file(spark):
    rules = [Rule("one", "x", "s"), Rule("two", "y", "s")]
    df = spark.createDataFrame([("f", "x" * 5 + "y"), ("g", "xy")], ASSET)
    got = sorted((r.file, r.rule_name) for r in scan.scan(df, rules, most=3).collect())
    assert got == [("f", "one")] * 5 + [("g", "one"), ("g", "two")]


def in_plain_python(file, text):
    """The live path: (rule, value, start) of the hits that stay."""
    hits = []
    for k, rule in enumerate(CATALOGUE):
        pattern = re.compile(rule.regex)
        for m in pattern.finditer(text):
            if rule.series == "uri":
                value = re.search(r"://[^/]*?:([^@]*)@", m.group())
                value = value and value[1]
            else:
                value = m.group(2 if rule.series == "generic" and pattern.groups > 1 else min(1, pattern.groups))
            bits = -sum(value.count(c) / len(value) * __import__("math").log2(value.count(c) / len(value)) for c in set(value)) if value else 0
            if value is not None and (rule.entropy is None or bits >= rule.entropy):
                hits.append((m.start(), m.end(), k, value, rule))
    left = [h for h in hits if not any(o[0] <= h[0] and h[1] <= o[1] and o[3] != h[3] and (o[:2] != h[:2] or h[2] < o[2]) for o in hits)]
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    kind, found = file.rpartition(".")[2], {}
    if kind == "py":
        for n in ast.walk(ast.parse(text)):
            if isinstance(n, ast.Constant) and isinstance(n.value, str):
                found.setdefault(n.lineno, []).append(n.value)
    elif kind == "json":
        for v in [v for v in json.loads(text).values() if len(v) > 10]:
            found.setdefault(line(text.index(v)), []).append(v)
    elif kind == "js":
        for m in re.finditer(r"\"([^\"\n]*)\"|'([^'\n]*)'", text):
            found.setdefault(line(m.start()), []).append(m[1] or m[2] or "")

    def vetoed(value, some):
        for s in some:
            if s == value:
                return False
            if similar(value, s) or (value in s and "://" not in s):
                return True
        return False

    return {(h[4].rule_name, h[3], h[0]) for h in left if h[4].series in strings.EXEMPT_SERIES or not vetoed(h[3], found.get(line(h[0]), []))}


def test_live_path_on_structured_files(spark):
    key = "Zx81kLq09TbVw55eRyUi"
    files = [("a.json", json.dumps({"token": key, "note": f"the secret = {key[::-1]} in a sentence", "mail": "someone@mail.example.com"}, indent=1)),
             ("b.py", f"token = '{key}'\nnote = 'see token={key[::-1]} in text'\nhost = 'db.example.com'\n"),
             ("c.js", f'var token = "{key}";\nvar t = "prefix secret={key[::-1]} suffix";\n'),
             ("d.txt", f"token = {key}\nftp://user:pa55word@host.example/x"), ("e.json", "{broken token = '" + key + "'"), ("f.py", "x = (\ntoken = '" + key)]
    got = {}
    for r in scan.live(spark.createDataFrame(files, ASSET)).collect():
        got.setdefault(r.file, set()).add((r.rule_name, r.value, r.index_start))
    for file, text in files:
        if file[0] in "abcd":
            assert got.get(file, set()) == in_plain_python(file, text), file
    assert any(v == key for _, v, _ in got["b.py"]) and not any(v == key[::-1] for _, v, _ in got["b.py"])
    assert got["e.json"] and got["f.py"]  # a file that cannot be parsed vetoes nothing


def test_merging_in_a_huge_file(spark):
    rng = random.Random(3)
    hits, at = [], 0
    for k in range(50_000):
        at += rng.choice([1, 3, 20])
        hits.append(("f", rng.choice(["generic-x", "aws"]), rng.choice(["abcdef", "abcdeg", "zzz123"]), at, at + 6, k))
    df = spark.createDataFrame(hits, "file string, rule_name string, value string, index_start int, index_end int, ord long")
    gone = set()
    for i, (_, rule, value, start, end, ord_) in enumerate(hits):
        for _, r2, v2, s2, _, o2 in hits[i + 1:i + 8]:
            if s2 > end:
                break
            if value == v2 and start == s2:
                gone.add(o2 if "generic" in r2 else ord_)
            elif similar(value, v2):
                gone.add(ord_ if "generic" in rule else o2)
    assert {r.ord for r in candidate.merge_similar(df).collect()} == {h[5] for h in hits} - gone


def test_classifiers_survive_long_values(spark):
    """Hits of ten thousand dotted parts and the like pass both classifiers."""
    from sluice.operators import bindings, classify_v1, classify_v2
    from pyspark.sql import functions as F

    values = ["a@b" + ".c" * 10_000, "a.b" * 10_000, "+" + "a.b" * 10_000 + "+", "a-b" * 10_000, "A_" * 20_000, "a" * 50_000, "${" * 10_000, "eyJ" + "a." * 10_000]
    rows = [("f", rule, series, v, f'key = "{v}"', "machine", True) for v in values for rule, series in (("generic-api-key", "generic"), ("Uri", "uri"), ("jwt", "jwt"), ("Email Address", "contact"))]
    hits = spark.createDataFrame(rows, "file string, rule_name string, series string, value string, match string, is_mechanical string, need_keyvalue boolean")
    assert classify_v2.classify(hits).count() == len(rows) and classify_v1.classify(hits).count() == len(rows)
    assert len(classify_v2.classify(hits).select("risk").collect()) == len(classify_v1.classify(hits).select("risk_label").collect()) == len(rows)
    assert len(hits.select(bindings.value_class(F.col("value"))).collect()) == len(rows)
    candidate.key_filter(candidate.drop_versions(candidate.chunked_entropy(hits))).collect()
