"""Urls, links, references, strings, bindings, sources and streaming on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from sluice.operators import analysis, bindings, collect, strings
from sluice.sources import readers, sinks
from sluice.streaming import scan as stream


@pytest.mark.parametrize(("url", "want"), [
    ("http://h", ("http://h/", None)), ("https://h:8080/a?q=1#f", ("https://h:8080/a?q=1", None)), ("ftp://h/", (None, "scheme")), ("h/path", (None, "scheme")),
    ("http://u:p@h/", (None, "userinfo")), ("http://h:x/", (None, "port")), ("http://h:70000/", (None, "port")), (None, (None, "scheme")),
])
def test_normalized(spark, url, want):
    row = spark.createDataFrame([(url,)], "u string").select(collect.normalized(F.col("u")).alias("n")).first().n
    assert (row.url, row.error) == want


def test_directories_differ(spark):
    keys = [r[0] for r in spark.createDataFrame([("http://h/a",), ("http://h/b",)], "u string").select(collect.directory_key(F.col("u"))).collect()]
    assert len(set(keys)) == 2 and all(k.startswith("h_") for k in keys)


@pytest.mark.parametrize(("path", "ok"), [("/" + "a" * 399, True), ("/" + "a" * 400, False), ("/x" * 2, True), ("/x" * 3, False), ("/vendor/a/vendor", False),
                                          ("/" + "/".join(map(str, range(12))), True), ("/" + "/".join(map(str, range(13))), False), ("/A/a/A", False)])
def test_trap_guard(spark, path, ok):
    assert spark.range(1).select(collect.is_valid(F.lit("http://h" + path))).first()[0] is ok


def test_links_and_resolution(spark):
    html = '<script src="/a.js"></script><link rel="stylesheet" href="s.css"><a href="../up">u</a><a href="#x">x</a><a href="http://o/x">o</a><a href="mailto:x">m</a>'
    links = collect.resolve(collect.html_links(spark.createDataFrame([(1, "http://h/d/p", html)], "page_id long, url string, html string")))
    assert {(r.kind, r.target) for r in links.collect()} == {("script", "http://h/a.js"), ("stylesheet", "http://h/d/s.css"), ("page", "http://h/up"), ("page", None)}


def test_references(spark):
    text = 'import("./x.js"); "0123456789ab.chunk.js"; fetch("/w.wasm"); "i18n/en.json"\n//# sourceMappingURL=a.js.map?v'
    got = {(r.kind, r.ref) for r in collect.references(spark.createDataFrame([("f", text)], "file string, text string")).collect()}
    assert {("dynamic_import", "./x.js"), ("chunk", "0123456789ab.chunk.js"), ("wasm", "/w.wasm"), ("i18n", "i18n/en.json"), ("source_map", "a.js.map")} <= got


def test_frontier_budget(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("c", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in collect.frontier(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert [r.url for r in collect.frontier(edges, seeds, 2, 2).collect()] == ["a", "b"]


def test_soft_404_and_payloads(spark):
    schema = "index int, site string, url string, status int, content_type string, resource_type string, saved_path string, content binary"
    land, cut = b"<html>landing</html>", b"a" * 8191 + "é".encode() + b"tail"
    rows = [(1, "h", "http://h/", 200, "text/html", "document", "out/1", land), (2, "h", "http://h/x.js", 200, "text/html", "script", "out/2", b"<html>"),
            (3, "h", "http://h/y", 200, "text/plain", "xhr", "out/3", land), (4, "h", "http://h/z", 200, "text/plain", "xhr", "out/4", b"a\0b"),
            (5, "h", "http://h/q", 200, "text/plain", "xhr", "else/5", b"ok"), (6, "h", "http://h/r", 200, "text/plain", "xhr", "out/6", cut), (7, "h", "http://h/s", 200, "text/plain", "xhr", "out/6", cut)]
    r = spark.createDataFrame(rows, schema)
    landing = r.where("index = 1").select("site", F.md5("content").alias("landing_hash"), F.octet_length("content").alias("landing_size"))
    out = collect.soft_404(r, landing)
    assert {x["index"]: x.soft_404_reason for x in out.collect()} == {1: None, 2: "type_mismatch", 3: "landing_hash", 4: None, 5: None, 6: None, 7: None}
    assert {x["index"] for x in collect.payloads(out, "out/").collect()} == {1, 6}


def test_ssr_and_json(spark):
    html = '<script id="__NEXT_DATA__" type="x">{"a":1}</script><div x-data="{ open: false, more: 1 }">'
    got = {r.frame for r in collect.ssr_findings(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()}
    assert got == {"Next.js", "Alpine.js"}
    j = spark.createDataFrame([("f", json.dumps({"a": ["/x", {"b": "y.wasm"}], "c": 1})), ("g", "{"), ("h", None)], "file string, text string")
    assert {r.ref for r in collect.json_urls(j).collect()} == {"/x", "y.wasm"}


def test_extractors():
    assert [s["value"] for s in strings.extract("a.py", "x = 'one'\ny = f(\"two\")")] == ["one", "two"]
    assert [s["value"] for s in strings.extract("a.java", 'String s = "a\\"b"; // "no"')] == ['a\\"b']
    assert [s["value"] for s in strings.extract("a.json", '{"k": "long enough text", "s": "tiny"}')] == ["long enough text"]
    assert {s["value"] for s in strings.extract("a.csv", "ab,cd\nef,gh")} == {"ab", "cd", "ef", "gh"}
    assert [s["value"] for s in strings.extract("a.xml", "<a b='attr'>text</a>")] == ["attr", "text"]
    assert {s["value"] for s in strings.extract("a.yaml", "k: value\nn: 12345")} == {"value", "12345"}
    assert strings.extract("a.py", "def (") is None and strings.extract("a.txt", "x") is None and strings.extract("a.py", None) is None


def test_veto(spark):
    assets = spark.createDataFrame([("a.json", '{"note": "abcdef0123456789abcdef"}')], "file string, text string")
    hits = spark.createDataFrame([("a.json", "generic", "s", "abcdef0123456789abcdef", 1), ("a.json", "generic", "s", "abcdef0123456789", 1), ("a.json", "x", "uri", "abcdef0123456789", 1), ("b.txt", "x", "s", "v", 1)], "file string, rule_name string, series string, value string, line_start int")
    got = {(r.series, r.value) for r in strings.veto(hits, strings.extracted(assets)).collect()}
    assert got == {("s", "abcdef0123456789abcdef"), ("uri", "abcdef0123456789"), ("s", "v")}


def test_bindings_and_signals(spark):
    value = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0z"
    text = f'var a="{value}";init({{apiKey:a}});let k="{value}";fetch(u,{{Authorization:k}})'
    assets = spark.createDataFrame([("f", text)], "file string, text string")
    assert [(r.prop_key, r.var_name, r.val) for r in bindings.bindings(assets).collect()] == [("apiKey", "a", value)]
    classes = [r[0] for r in spark.createDataFrame([("https://x",), ("1.2.3",), ("0" * 32,), ("a-b-c.js",)], "v string").select(bindings.value_class(F.col("v"))).collect()]
    assert classes == ["path_or_url", "version", "hex_hash", "asset_id"]


def test_analysis(spark):
    hits = spark.createDataFrame([("/c/example_com/a.js", "AWS API Secret", "s", "m"), ("/c/example_com/b.html", "jwt", "s", "<html"), ("/c/other/a.js.map", "jwt", "s", "m")], "file string, rule_name string, series string, match string")
    t = {r.file: r for r in analysis.tagged(hits).collect()}
    assert t["/c/example_com/a.js"].domain == "example.com" and t["/c/example_com/b.html"].context == "inline_html_script" and t["/c/other/a.js.map"].context == "source_map"
    assert analysis.top_domains(analysis.tagged(hits)).first().n == 2
    assert {r.category for r in analysis.categories(analysis.tagged(hits)).collect()} == {"Secret/Auth"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"ok \xff text")
    (tmp_path / "in/b.png").write_bytes(b"x")
    got = readers.files(spark, str(tmp_path / "in")).collect()
    assert [r.text for r in got] == ["ok  text"]
    assert [r.text for r in readers.files(spark, str(tmp_path / "in"), lossy=False).collect()] == ["ok ÿ text"]
    (tmp_path / "m.json").write_text(json.dumps({"format": readers.MANIFEST_FORMAT, "files": [{"path": "a", "url": "u", "method": "GET", "content_type": "t", "bytes": 1}]}))
    assert readers.manifest(spark, str(tmp_path / "m.json")).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps({"format": readers.MANIFEST_FORMAT, "files": [{"path": "../a", "url": "u", "method": "GET", "content_type": "t", "bytes": 1}]}))
    with pytest.raises(Exception, match="not a manifest entry"):
        readers.manifest(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "kb.jsonl").write_text('{"id":"1","vector":[1,2],"payload":{"service":"s","original_full_json":{"original_analysis":{"risk_level":"High"}}}}\n\n{"id":"2","vector":[]}\n')
    assert [(r.id, r.risk_level, r.service) for r in readers.knowledge_base(spark, str(tmp_path / "kb.jsonl")).collect()] == [("1", "High", "s")]
    df = spark.createDataFrame([("jwt", "x"), ("a", "eyJhb"), ("b", "y")], "rule_name string, value string")
    sinks.split_jwt(df).write.partitionBy("bucket").parquet(str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).where("bucket = 'jwt'").count() == 2
    sinks.json_array(df, str(tmp_path / "j"))
    assert len(json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "j"), wholetext=True).collect()))) == 3


def test_stream(spark, tmp_path):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("f", "mail a@b.example.com", t), ("f", "mail a@b.example.com", t)], "file string, text string, seen timestamp").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream.run_available(stream.stream_hits(stream.stream_assets(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    rows = spark.read.parquet(str(tmp_path / "out")).where("rule_name = 'Email Address'").collect()
    assert [r.value for r in rows] == ["a@b.example.com"]


def test_edges_and_frontier_against_plain_python(spark):
    """The registered queries against regular expressions, urljoin and a breadth-first walk."""
    import html as entities
    import re
    from urllib.parse import urljoin, urlparse

    from sluice.plans import queries

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()

    def usable(url):
        segments = [x.lower() for x in urlparse(url).path.split("/") if x]
        return len(urlparse(url).path) <= 400 and len(segments) <= 12 and all(segments.count(x) <= (1 if x in collect.PACKAGE_DIRS else 2) for x in segments)

    edges = set()
    for p in pages:
        for href in re.findall(r"""<a\s[^>]*href=["']((?![#?])[^"']+)["']""", p.html, re.I):
            bare = re.sub(r"[?#].*$", "", entities.unescape(href).strip())
            if not bare or re.match("mailto:|javascript:|data:", bare):
                continue
            target = urljoin(re.sub(r"[?#].*$", "", p.url), bare)
            if urlparse(target).netloc == urlparse(p.url).netloc and usable(target):
                edges.add((p.url, target))
    assert {(r.src, r.dst) for r in queries.link_edges(spark, sf).collect()} == edges
    seeds = {}
    for p in pages:
        url, host = re.sub(r"[?#].*$", "", p.url), urlparse(p.url).netloc
        seeds[host] = min(url, seeds.get(host, url))
    depth = dict.fromkeys(seeds.values(), 0)
    last = set(depth)
    for d in (1, 2, 3):
        giving = {u for u in last if d < 3 or any(urlparse(u).path.startswith(x) for x in collect.LISTINGS)}
        last = {b for a, b in edges if re.sub(r"[?#].*$", "", a) in giving} - set(depth)
        depth |= dict.fromkeys(last, d)
    assert {r.url: r.depth for r in queries.crawl_frontier(spark, sf).collect()} == depth
