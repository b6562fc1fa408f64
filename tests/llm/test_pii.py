"""Base spans against Python regular expressions; the model; redaction."""

import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from sluice.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(d))) % 10 == 0


def spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def every(text):
    """(kind, start, end, base, code) of all candidates, from plain Python."""
    text = text or ""
    base = [(k, a, b) for k, a, b in spans(text)]
    hit = lambda a, b, some: any(x < b and a < y for x, y in some)
    taken = [(a, b) for _, a, b in base]
    out = []

    def vote(value, pair):
        return 1 if regex.search(pair[0], value) else 2 if regex.search(pair[1], value) else 0

    def code(kind, a, b):
        value, before = text[a:b], text[max(0, a - 40):a].lower()
        long = len(value) > pii.LONGEST
        form = vote(value, pii.FORM[kind]) if not long else 2
        if kind == "card" and not luhn(re.sub("[^0-9]", "", value)):
            form = 2
        c = 0
        for v in (form, 2 if long else vote(re.sub("[ -]", "", value) if kind == "card" else value, pii.GAZETTEER[kind]), vote(before, pii.WORDS[kind])):
            c = c * 3 + v
        for p in pii.SHAPES[kind]:
            c = c * 2 + (not long and bool(regex.search(p, value)))
        return c

    for kind in pii.KINDS:
        mine = [(m.start(), m.end()) for m in re.finditer(BASE[kind], text)] if kind in BASE else []
        if kind == "card":
            mine = [(a, b) for a, b in mine if len(re.sub("[^0-9]", "", text[a:b])) >= 13]
        good = [(a, b) for k, a, b in base if k == kind]
        loose = [(m.start(), m.end()) for m in regex.finditer(pii.LOOSE[kind], text)] if kind in pii.LOOSE else []
        loose = [(a, b) for a, b in loose if not hit(a, b, taken)]
        failing = [(a, b) for a, b in mine if (a, b) not in good and not hit(a, b, loose) and not hit(a, b, taken)]
        out += [(kind, a, b, (a, b) in good, code(kind, a, b)) for a, b in sorted(good + loose + failing)]
    return out


def held(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(df)
    got = {}
    for r in found.collect():
        got[r.doc_id] = [(k, s.start, s.end, s.base, s.code) for k in pii.KINDS for s in r[f"c_{k}"]]
    want = {i: every(t) for i, t in rows}
    assert got == want
    counts = {}
    for some in want.values():
        for k, _, _, _, c in some:
            counts.setdefault(k, Counter())[c] += 1
    model = pii.model(counts)
    assert pii.fit(found) == model
    return {i: [(k, a, b, base) for k, a, b, base, c in some if base or c in model[k]] for i, some in want.items()}


def test_all_spans_against_plain_python(spark):
    rng = random.Random(8)
    bits = ["+1 (974) 555-3436", "4111111111111111", "4111 1111 1111 1112", "10.1.2.3", "999.1.2.3", "a.b@c.example.com", "joe (at) site (dot) org", 'token = "0123456789abcdef0123456789abcdef01234567"',
            'class="some-long-class-name-here"', "call 555-123-4567", "12", "x", "version 1.2.3.4", "5500005555555559", "+999999999999999999"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for k in range(400)] + [(998, None), (999, "")]
    rows += [(1000, "a@b" + ".c" * 5000), (1001, "1" * 50_000), (1002, "+1" + " 2" * 20_000), (1003, "x" * 50_000 + "@y.org"), (1004, 'k = "' + "aB3" * 30_000 + '"'),
             (1005, "1." * 30_000 + "1"), (1006, "(at) " * 20_000), (1007, "4111 " * 20_000), (1008, 'token = "' * 10_000)]
    held(spark, rows)


def test_query_adds_spans_on_the_given_tables(spark):
    """op2's spans are those of plain Python, and hold spans beyond the base rules."""
    from sluice.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = held(spark, rows)
    got = {r.doc_id: r for r in queries.op2_pii(spark, sf).collect()}
    assert {i: r.spans for i, r in got.items()} == {i: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in some) for i, some in want.items()}
    assert all(r.n_spans == len(want[i]) and r.n_phone == sum(k == "phone" and base for k, _, _, base in want[i]) for i, r in got.items())
    added = Counter(k for some in want.values() for k, _, _, base in some if not base)
    assert added["phone"] and added["card"] and added["secret"] > 100


def test_base_spans(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("a1@.-+ ()_%b29é😀") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0000255", "a@b" + ".c" * 5000, "x" * 50000, "1" * 50000, "+1" + " " * 20000 + "2 +1 (974) 555-3436", "4111 1111 1111 1111-x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    found = pii.candidates(df).select("k", *[F.filter(f"c_{n}", lambda x: x["base"]).alias(n) for n in pii.KINDS])
    got = {r.k: [(n, s.start, s.end) for n in pii.KINDS for s in r[n]] for r in found.collect()}
    for k, t in enumerate(texts):
        assert got[k] == spans(t), t


def code(form, gazetteer, context, *bits):
    c = (form * 3 + gazetteer) * 3 + context
    for b in bits or (0, 0, 0):
        c = c * 2 + b
    return c


def test_model_learns_reliability():
    good, bad, mixed = code(1, 1, 1), code(2, 0, 2), code(2, 1, 1)
    counts = {good: 900, bad: 900, mixed: 30}
    posterior, prior, rates = pii.expectation_maximisation(counts)
    assert posterior[good] > 0.95 and posterior[bad] < 0.05 and 0.3 < prior < 0.7 and rates[0][1][1] > 0.8
    weights = pii.train_classifier(counts, posterior)
    assert pii.probability(weights, good) > pii.probability(weights, mixed) > pii.probability(weights, bad)


def test_classifier_uses_shape():
    a, b = code(0, 1, 0, 1, 0, 0), code(0, 1, 0, 0, 0, 0)
    counts = {code(1, 1, 1, 1, 0, 0): 500, code(2, 2, 2, 0, 0, 0): 500, a: 10, b: 10}
    posterior, _, _ = pii.expectation_maximisation(counts)
    weights = pii.train_classifier(counts, posterior)
    assert abs(posterior[a] - posterior[b]) < 1e-9 and pii.probability(weights, a) > pii.probability(weights, b)


def test_added_spans_keep_base(spark):
    rows = [(k, f"call phone 555-123-{1000 + k} or +1 (974) 555-{1000 + k} mail a{k}@b.example.com") for k in range(60)]
    found = pii.candidates(spark.createDataFrame(rows, "k int, text string"))
    r = pii.accept(found, pii.fit(found)).where("k = 3").first()
    assert len(r.c_phone) == 2 and len(r.c_email) == 1
    assert [s.base for s in r.c_phone] == [False, True]


def test_odd_rows(spark):
    mail = "write to x@y.example.com"
    df = spark.createDataFrame([(1, mail, "a"), (1, mail, "a"), (None, mail, "a"), (2, None, "a")], "doc_id long, text string, c_email string")
    found = pii.candidates(df)
    assert sorted((str(r.doc_id), len(r.c_email)) for r in found.collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]


@pytest.mark.parametrize(("text", "want"), [("mail x@y.example.com now", "mail [EMAIL] now"), (None, None), ("", ""), ("é +1 (974) 555-3436", "é [PHONE]"), ("plain", "plain")])
def test_redaction(spark, text, want):
    df = spark.createDataFrame([(1, text, "keep")], "doc_id long, text string, c_email string")
    assert [tuple(r) for r in pii.redact(df.drop("c_email"), accepted={k: [] for k in pii.KINDS}).collect()] == [(1, want)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.fit(pii.candidates(df)) == {k: [] for k in pii.KINDS}
    assert pii.redact(df).count() == 0
