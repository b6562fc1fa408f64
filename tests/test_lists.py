"""The fixed lists whole, and a case for each branch that needs them."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import analysis, bindings, candidate, classify_v1, classify_v2, collect, vector
from sluice.schema import CONTEXT
from sluice.sources import readers

HITS = "file string, rule_name string, series string, value string, match string, is_mechanical string, need_keyvalue boolean"


def test_lengths():
    assert [len(x) for x in (readers.BINARY, collect.PROBES_MANIFEST, collect.PROBES_HIGH, collect.PROBES_BUILD, collect.PROBES_DEBUG, collect.SKIPPED)] == [38, 17, 25, 132, 37, 39]
    assert len(analysis.SDK_WORDS) == 116 and len(analysis.SERVER_WORDS) == 38 and len(analysis.CATEGORIES) == 10
    assert len(candidate.sequence_patterns()) == 174 and len(candidate.KEY_RIGHT) == 9 and len(candidate.JWT_SCOPES) == 10
    assert {"flv", "wmv", "aac", "apk", "iso", "dat", "pak", "crx"} <= set(readers.BINARY) and not {"pdf", "jar", "class", "ttf"} & set(readers.BINARY)


@pytest.mark.parametrize(("mode", "n"), [("full", 211), ("balanced", 122), ("lite", 67)])
def test_probe_plan(spark, mode, n):
    assert collect.probe_plan(spark.createDataFrame([("h",)], "site string"), mode).count() == n


def test_preset_overrides():
    assert collect.preset("full", pages=7, depth=None) == collect.Preset(3, 7, 132, 37)


def test_key_sides_and_categories(spark):
    names = spark.createDataFrame([("Render API Key",), ("Supabase key",), ("MongoDB uri",), ("AWS Secret",), ("x",)], "r string")
    assert [r[0] for r in names.select(analysis.key_side(F.col("r"))).collect()] == ["SDK/Public", "SDK/Public", "Server/Secret", "Ambiguous/Uncategorized", "Ambiguous/Uncategorized"]
    hits = spark.createDataFrame([("Heroku", "a"), ("Mapbox", "a"), ("Contentful", "b"), ("Slack", "b"), ("Elastic", "c"), ("none", "c")], "rule_name string, domain string")
    assert {r.category for r in analysis.categories(hits).collect()} == {"DevOps/Hosting", "Maps/Geolocation", "Content/CMS", "Communication", "Search"}


def token(claims):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part({'alg': 'RS256'})}.{part(claims)}.c2ln"


@pytest.mark.parametrize(("claims", "kept"), [({"sub": "x"}, True), ({"scope": "read oauth"}, False), ({"scopes": ["client_id"]}, False), ({"scope": "read"}, True), ({"roles": ["org.team"]}, False),
                                              ({"roles": ["tracking"]}, False), ({"roles": ["admin"]}, True), ({"x": "bugsnag"}, False), ({}, True)])
def test_harmless_tokens(spark, claims, kept):
    value = token(claims)
    df = spark.createDataFrame([("f", "jwt", "jwt", value, value, "machine", False)], HITS)
    assert candidate.key_filter(df).count() == kept


def test_learned_key_endings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"descriptor": 9, "state": 3}))
    learned = readers.suffixes(spark, str(tmp_path / "s.json"))
    assert learned == ["descriptor", "state"]
    df = spark.createDataFrame([("f", "generic-api-key", "generic", "Zx81kLq09TbVw55eRyUi", f"{k}=Zx81kLq09TbVw55eRyUi", "machine", True) for k in ("page_state", "app_key")], HITS)
    assert candidate.key_filter(df).count() == 2
    assert [r.match[:7] for r in candidate.key_filter(df, tuple(learned)).collect()] == ["app_key"]


def test_dictionary_is_whole(spark):
    texts = spark.createDataFrame([(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} common",) for k in range(6000)], "t string")
    assert len(candidate.ranked_words(texts, "t")) == 6001 and candidate.ranked_words(texts, "t", 2) == ["common"]


@pytest.mark.parametrize(("use", "signal"), [("pusher = new Pusher(k)", "SDK_INIT"), ("new  google.maps.Map(k)", "SDK_INIT"), ("f({'X-API-Key': k})", "HTTP_AUTH"), ("md5 (k)", "CRYPTO"), ("newPusher", None), ("k.split('.')", None)])
def test_signals(spark, use, signal):
    value = "Zx81kLq09TbVw55eRyUi-Qa7"
    text = f'let a = "{value}"; {use}'
    assets = spark.createDataFrame([("f", text)], "file string, text string")
    assert [r.signal for r in bindings.context_signals(assets, bindings.local_secrets(assets)).collect()] == ([signal] if signal else [])


def test_signals_need_the_declaration(spark):
    value = "Zx81kLq09TbVw55eRyUi-Qa7"
    assets = spark.createDataFrame([("f", f'x("{value}");' + " " * 300 + f'let a = "{value}"; hmac(a)')], "file string, text string")
    assert bindings.context_signals(assets, bindings.local_secrets(assets)).count() == 0  # the first place of the value declares nothing


def test_embedding_text_names_its_context(spark):
    rows = [("f", "generic-api-key", "generic", "Zx81kLq09TbVw55eRyUi", "x", "q1", [("", "s" * 120, "", "", ""), ("/a", "", "", "", ""), ("", "", "", "t", ""), ("/late", "", "", "", "")])]
    df = spark.createDataFrame(rows, f"file string, rule_name string, series string, value string, match string, variable_name string, context {CONTEXT}")
    made = vector.embedding_text(classify_v2.prepare(df)).first().embedding_text
    assert f"context: [snippet:{'s' * 100}..., path:/a, type:t]" in made and "/late" not in made


@pytest.mark.parametrize(("kb_id", "value", "match", "code"), [
    (vector.POTENTIAL_IDS[0], "0x4AAAAabcdefghijkl", "m", "kb_captcha_id"), (vector.PUBLIC_MAP_IDS[0], "pk.eyJabcdefghijkl", "mapbox m", "kb_map_id"),
    (vector.PUBLIC_MAP_IDS[1], "pk_live_abcdefghijklmn", "m", "kb_payment_id"), (vector.PUBLIC_MAP_IDS[2], "0x4AAAAabcdefghijkl", "m", "kb_site_key_id"), ("other", "0x4AAAAabcdefghijkl", "m", None)])
def test_neighbours_with_rules_of_their_own(spark, kb_id, value, match, code):
    df = spark.createDataFrame([("f", "generic-api-key", "generic", value, match, "q1")], "file string, rule_name string, series string, value string, match string, variable_name string")
    told = classify_v2._staged(df).withColumns({"kb_id": F.lit(kb_id), "kb_risk": F.lit("low"), "kb_service": F.lit(""), "score": F.lit(0.99)})
    from sluice.operators.cascade import decide

    assert told.select(decide(vector.kb_override())["code"]).first()[0] == code


@pytest.mark.parametrize("block", [100_000, 50])
def test_nearest_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[7] = base[3]  # a tie
    kb = spark.createDataFrame([(f"{k:04}", v.tolist(), "low", None) for k, v in enumerate(base)], "id string, vector array<float>, risk_level string, service string")
    q = spark.createDataFrame([(f"{k:04}", base[k].tolist()) for k in range(0, 300, 10)] + [("none", base[3].tolist())], "own string, vector array<float>")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    got = {r.own: (r.kb_id, r.score) for r in vector.nearest(q, kb, block=block, own_col="own").collect()}
    assert got.pop("none")[0] == "0003"
    for own, (found, score) in got.items():
        assert found == f"{scores[int(own)].argmax():04}" and abs(score - scores[int(own)].max()) < 1e-4


def test_pending_hits_take_a_settled_neighbours_risk(spark):
    value = "Zx81kLq09TbVw55eRyUi" * 2
    rows = [("f", "generic-api-key", "generic", value, f'client_secret = "{value}"', "client_secret"), ("g", "generic-api-key", "generic", value + "x", "zz", "client_sekret")]
    df = spark.createDataFrame(rows, "file string, rule_name string, series string, value string, match string, variable_name string")
    got = {r.file: (r.risk, r.score) for r in vector.classify_with_kb(df).collect()}
    assert got["f"][0] != "PendingVector" and got["g"][0] != "PendingVector"


def test_escaped_names_and_claims(spark):
    rows = [("g", "generic", "Zx81kLq09TbVw55eRyUi", r"master\x4bey: 'Zx81kLq09TbVw55eRyUi'"), ("g", "generic", "Zx81kLq09TbVw55eRyUi", "master&#75;ey: 'Zx81kLq09TbVw55eRyUi'"),
            ("jwt", "jwt", token({"iss": "me", "aud": "", "sub": "s" * 60, "x": 1}), "m")]
    made = classify_v1.classify(spark.createDataFrame(rows, "rule_name string, series string, value string, match string")).collect()
    assert [r.var_name for r in made] == ["master_key", "master_key", f"iss me sub {'s' * 50} aud"]


def test_nested_sitemaps(spark):
    loc = lambda *u: "".join(f"<url><loc> {x} </loc></url>" for x in u)
    rows = [("h", "http://h/sitemap-index.xml", loc("http://h/a.xml", "http://other/b.xml")), ("h", "http://h/a.xml", loc("http://h/p?x=1", "http://h/b.XML", "http://h/p")),
            ("h", "http://h/b.XML", loc("http://h/q", "http://h/c.xml")), ("h", "http://h/c.xml", loc("http://h/too-deep")), ("h", "http://h/sitemap.xml", loc("http://h/second")),
            ("i", "http://i/sitemap.xml", loc("http://i/only")), ("j", "http://j/elsewhere.xml", loc("http://j/x"))]
    got = {(r.site, r.url) for r in collect.sitemap_urls(spark.createDataFrame(rows, "site string, url string, text string")).collect()}
    assert got == {("h", "http://h/p"), ("h", "http://h/q"), ("i", "http://i/only")}


def test_build_manifests(spark):
    rows = [("h", "https://h/_nuxt/builds/latest.json", '{"id": "b1"}'), ("h", "https://h/pagefind/pagefind-entry.json", json.dumps({"wasm_url": "w.wasm", "index_chunks": [f"i{k}" for k in range(25)]})), ("h", "https://h/x.json", "{}")]
    got = [(r.kind, r.url) for r in collect.manifest_urls(spark.createDataFrame(rows, "site string, url string, text string")).collect()]
    assert ("nuxt", "https://h/_nuxt/builds/meta/b1.json") in got and ("pagefind", "https://h/pagefind/w.wasm") in got and len(got) == 22


def test_listings_reach_one_step_further(spark):
    edges = spark.createDataFrame([("http://h/", "http://h/blog/"), ("http://h/", "http://h/x"), ("http://h/blog/", "http://h/deep"), ("http://h/x", "http://h/lost")], "src string, dst string")
    seeds = spark.createDataFrame([("http://h/",)], "url string")
    assert {(r.url, r.depth) for r in collect.frontier(edges, seeds, 1).collect()} == {("http://h/", 0), ("http://h/blog/", 1), ("http://h/x", 1), ("http://h/deep", 2)}


def test_entities_in_links(spark):
    links = spark.createDataFrame([("http://h/d/", "a&eacute;b"), ("http://h/d/", "&#47;x"), ("http://h/d/", "plain")], "url string, href string")
    assert sorted(r.target for r in collect.resolve(links).collect()) == ["http://h/d/aéb", "http://h/d/plain", "http://h/x"]


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from sluice import staging

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://h:7077", "_conf": type("C", (), {"get": staticmethod(lambda *a: None)})})

    with pytest.raises(ValueError, match="share"):
        staging.shared_dir(Elsewhere)


def test_sources_check_what_they_are_given(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three")):
        (tmp_path / name).write_text(text)
    uri = tmp_path.as_uri().replace("file:///", "file:/")
    (tmp_path / "list.json").write_text(json.dumps([f"{uri}/a.txt", f"{uri}/b.txt"]))
    assert sorted(r.text for r in readers.listed(spark, str(tmp_path / "list.json"), str(tmp_path)).collect()) == ["one", "two"]
    for bad in ("{}", "[1, null]", "nothing"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="array of paths"):
            readers.listed(spark, str(tmp_path / "bad.json"), str(tmp_path)).collect()
    entry = lambda p: {"path": p, "url": f"http://h/{p}", "method": "GET", "content_type": "text/plain", "bytes": 3}
    (tmp_path / "m.json").write_text(json.dumps({"format": readers.MANIFEST_FORMAT, "files": [entry("a.txt"), entry("b.txt")]}))
    got = readers.manifest_assets(spark, str(tmp_path / "m.json")).collect()
    assert sorted((r.text, r.url) for r in got) == [("one", "http://h/a.txt"), ("two", "http://h/b.txt")]
    (tmp_path / "m.json").write_text(json.dumps({"format": readers.MANIFEST_FORMAT, "files": [entry("lost.txt")]}))
    with pytest.raises(Exception, match="missing"):
        readers.manifest_assets(spark, str(tmp_path / "m.json")).collect()
    first, second = spark.createDataFrame([("x", "1")], "file string, text string"), spark.createDataFrame([("x", "2"), ("y", "3")], "file string, text string")
    assert sorted((r.file, r.text, r.source_ord) for r in readers.gathered(first, second).collect()) == [("x", "1", 0), ("y", "3", 1)]


def test_batch_composition(spark):
    """Against its steps spelled out by hand on a few files."""
    from sluice.operators import batch

    key = "Zx81kLq09TbVw55eRyUi7Qp3"
    files = [("a", f"token = '{key}'"), ("b", "token = 'aaaabbbbccccddddeeeeffff'"), ("c", f"input_token = '{key}'"), ("d", "token = 'monkey-house-secret-words'"), ("e", "no hit")]
    kb = spark.createDataFrame([], "id string, vector array<float>, risk_level string, service string")
    made = batch.run(spark.createDataFrame(files, "file string, text string"), ["monkey", "house", "secret", "words"], kb)
    # b falls by its patterns, d by its words; c's match starts at the key word, so its prefix is not seen
    assert sorted((r.file, r.value, r.risk_label) for r in made.collect()) == [("a", key, "Potential"), ("c", key, "Potential")]


def test_oldest_values(spark):
    from sluice.operators import scan
    from sluice.operators.rules import Rule

    rules = [Rule("two", "(k)=(v+)", "generic"), Rule("one", "x(y+)z", "s"), Rule("pem", "p+", "private")]
    df = spark.createDataFrame([("f", "k=vvv xyyz " + "p" * 99 + " " + "p" * 100)], "file string, text string")
    assert [r.value for r in scan.scan(df, rules, oldest=True).orderBy("ord").collect()] == ["k=vvv", "yy", "p" * 100]


def test_segmentation_is_cheapest():
    """Against all splits of short words."""
    import math
    import random

    rng = random.Random(6)
    words = ["a", "ab", "abc", "bc", "ca", "cab", "b"]
    costs = {w: math.log((k + 1) * math.log(len(words) + 2)) for k, w in enumerate(words)}

    def cost(parts):
        return sum(costs.get(p, 1e3 if len(p) == 1 else math.inf) for p in parts)

    for _ in range(200):
        word = "".join(rng.choice("abcz") for _ in range(rng.randint(1, 8)))
        best = math.inf
        for mask in range(1 << (len(word) - 1)):
            cuts = [0, *[i + 1 for i in range(len(word) - 1) if mask >> i & 1], len(word)]
            best = min(best, cost([word[a:b] for a, b in zip(cuts, cuts[1:])]))
        got = candidate.segment(word, costs, 3)
        assert "".join(got) == word and abs(cost(got) - best) < 1e-9


def test_embedding_text_against_plain_python(spark):
    """Descriptor, preview and order of the parts."""
    import re

    rows = [("ghp_aB1-xyzQ", "generic-api-key", "generic", "tokenName"), ("0123456789abcdef" * 5, "Hex Digest", "digest", ""), ("sk_live_AbC9", "Stripe", "payment", "k")]
    df = spark.createDataFrame([("f", r, s, v, "m", n) for v, r, s, n in rows], "file string, rule_name string, series string, value string, match string, variable_name string")
    got = {r.value: r.embedding_text for r in vector.embedding_text(classify_v2.prepare(df)).collect()}
    for value, rule, series, name in rows:
        groups = list(dict.fromkeys("LowerAlpha" if re.match("[a-z]", c) else "UpperAlpha" if re.match("[A-Z]", c) else "Digit" if c.isdigit() else c for c in value))
        prefix = next((p for p in vector.PREFIXES if value.startswith(p)), "N/A")
        parts = [f"Features - Length: {len(value)}, Charset: {' + '.join(groups)}, prefix: {prefix}", f"value: {value[:64] + '...' if len(value) > 64 else value}", f"Series: {series}", f"Service: {rule}"]
        at = [got[value].index(p) for p in parts]
        assert at == sorted(at) and got[value].startswith("Variable Name: ")
