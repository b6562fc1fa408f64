"""Url rules, chat collapse and quality rules against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.llm import chat, quality, urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "net"), ("allow", "a.net/x/")]


def by_hand(url):
    host, path = urls.split_url(url)
    best = None
    for verdict, rule in RULES:
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return (host, path, best[1] if best else None, best[0] if best else "allow")


def test_urls_by_trie_and_by_join(spark):
    rng = random.Random(1)
    hosts = ["example.org", "a.EXAMPLE.org", "x.com", "com", "b.a.net", "a.net", "net", "q.info", "", "u:p@a.net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123", "/fr/x", "/de/", "/x/", "/x/y/z", "//es/"]
    some = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/es/', '#f'])}" for _ in range(300)] + [None, "", "no-scheme", "://", "http://\nx"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(some)], "k int, url string, host string")
    for bound in (100, 0):
        got = {r.k: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, RULES, max_broadcast=bound).collect()}
        assert [got[k] for k in range(len(some))] == [by_hand(u) for u in some]


def test_urls_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], "url string"), RULES).count() == 0


def collapsed(turns):
    convs = {}
    for c, t, r, x in turns:
        convs.setdefault(c, []).append((t, r, x))
    key = lambda v: tuple((a is not None, a or 0) if not isinstance(a, str) else (True, a) for a in v)
    seqs = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1] is not None, y[1] or "", y[2] is not None, y[2] or ""))] for c, v in convs.items()}
    assert key
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()):
            continue
        same = [d for d, o in seqs.items() if o == s]
        if c == min(same):
            out[c] = (len(s), len(same), "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for r, x in s))
    return out


def test_chat_against_python(spark):
    rng = random.Random(2)
    turns = []
    for c in range(60):
        base = rng.choice([["a", "b", "c", "d"], ["a", "b", "x"], ["", None, "q"]])
        for t, x in enumerate(base[:rng.randint(1, len(base))]):
            turns.append((c, t, rng.choice(["user"]) if t % 2 == 0 else None, x))
    turns += [(99, t, "user", str(t)) for t in range(700)] + [(98, t, "user", str(t)) for t in range(300)] + [(97, None, "user", "z"), (97, 0, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(9)).repartition(7)
    got = {r.conv_id: (r.n_turns, r.n_same, r.rendered) for r in chat.collapse_and_render(df).collect()}
    assert got == collapsed(turns)


def test_chat_empty(spark):
    assert chat.collapse_and_render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def measured(text):
    import re

    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    cover = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


def test_quality_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a b c d e f g h " * 3, "one\none\n\none x", "é😀 \x0b# *"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "k int, text string, n_words int")
    got = {r.k: tuple(r[m] for m in quality.MEASURES) for r in quality.measure(df).collect()}
    assert [got[k] for k in range(len(texts))] == [measured(t) for t in texts]


@pytest.mark.parametrize("bound", [10, 0])
def test_host_verdicts(spark, bound):
    clean, noisy = " ".join(f"word{i}" for i in range(40)), " ".join(f"w{i}##" for i in range(40))
    rows = [("bad", noisy)] * 30 + [("bad", clean)] * 2 + [("good", clean)] * 30 + [("good", noisy)] + [(None, clean), (None, noisy), ("bad", "short")]
    measured_ = quality.measure(spark.createDataFrame(rows, "source string, text string"))
    judged = quality.judge(measured_, max_broadcast=bound)
    got = {(r.source, r.text[:5]): r.kept for r in judged.collect()}
    assert got == {("bad", noisy[:5]): False, ("bad", clean[:5]): True, ("good", clean[:5]): True, ("good", noisy[:5]): True, (None, clean[:5]): True, (None, noisy[:5]): True, ("bad", "short"): False}


def verdicts(rows):
    """(host, failed) by the stated rule."""
    import math
    from statistics import NormalDist

    hosts = {}
    for host, bad in rows:
        if host is not None:
            n, f = hosts.get(host, (0, 0))
            hosts[host] = (n + 1, f + bad)
    mean = sum(f for _, f in hosts.values()) / sum(n for n, _ in hosts.values())
    spread = mean * (1 - mean)
    variance = sum((f / n - mean) ** 2 for n, f in hosts.values()) / len(hosts) - sum(spread / n for n, _ in hosts.values()) / len(hosts)
    weight = min(100.0, max(1.0, spread / variance - 1 if variance > 0 else 100.0))
    out = set()
    for host, (n, f) in hosts.items():
        rate = (f + mean * weight) / (n + weight)
        if rate - NormalDist().inv_cdf(0.8) * math.sqrt(rate * (1 - rate) / (n + weight + 1)) > mean:
            out.add(host)
    return out


def test_host_verdicts_on_the_given_tables(spark):
    """Hosts are rejected by the fitted prior, and lose documents that pass the base rules."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    made = quality.apply_rules(docs, carry=["doc_id", "source", "text"]).withColumn("soft", quality.soft_failed()).collect()
    bad = verdicts([(r.source, r.base_failed or r.soft) for r in made])
    assert {r.doc_id for r in made if r.kept} == {r.doc_id for r in made if not r.base_failed and not (r.soft and r.source in bad)}
    lost = [r for r in made if not r.kept and not r.base_failed]
    assert bad and len(bad) < 10 and lost and all(r.soft for r in lost)


def test_quality_empty(spark):
    assert quality.apply_rules(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_tables_are_no_noise(spark):
    """A table of one-word cells passes the soft rules; words with marks hung on them do not."""
    rows = [(1, " | ".join(f"word{k}" for k in range(40))), (2, " ".join(f"word{k}{m * 3}" for k, m in enumerate("#$%&*" * 8)))]
    got = {r.k: r.soft for r in quality.measure(spark.createDataFrame(rows, "k int, text string")).withColumn("soft", quality.soft_failed()).collect()}
    assert got == {1: False, 2: True}
