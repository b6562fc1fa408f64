"""The engine's queries over the driver's tables, and DuckDB SQL for those that SQL can express.

The SQL is written apart from the operators: spans come from gaps and matches there
too, but reductions are spelled out with EXISTS, windows and grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import analysis, batch, bindings, candidate, classify_v1, classify_v2, collect, rules, scan, strings, vector
from sluice.operators.cascade import PENDING
from sluice.plans import oracles
from sluice.sources import readers, sinks
from sluice.staging import stage

#: A clock for queries that need one, so that results do not depend on the day.
NOW = 1_700_000_000
#: A word of the corpus's own dictionary stands in one of so many documents at least.
WORD_SHARE = 10_000
ADDRESS = {"address": ("Host Name", "IPv4 Address")}


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(scan.scan(readers.documents(spark, sf_dir), unescaped=False), "hits")


def _shape(hits: DataFrame) -> DataFrame:
    return hits.select("file", "rule_name", "value", F.col("index_start").cast("bigint").alias("index_start"), F.col("index_end").cast("bigint").alias("index_end"))


def rule_scan(spark, d):
    return _hits(spark, d).groupBy("rule_name", "series").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("file").alias("n_files"))


def span_positions(spark, d):
    cols = [F.col(c).cast("bigint").alias(c) for c in ("index_start", "index_end", "line_start", "col_start", "line_end", "col_end")]
    return _hits(spark, d).select("file", "rule_name", "match", *cols)


def entropy_gate(spark, d):
    return _hits(spark, d).select("file", "rule_name", "value", F.col("index_start").cast("bigint").alias("index_start"), F.round("entropy", 6).alias("entropy")).where("entropy >= 3.0")


def hit_dedup(spark, d):
    hits = scan.dedupe(_hits(spark, d).unionByName(_hits(spark, d)))
    return hits.select("file", "rule_name", "value", F.col("index_start").cast("bigint").alias("index_start"), F.col("n_seen").cast("bigint").alias("n_seen"))


def span_containment(spark, d):
    return _shape(scan.drop_contained(_hits(spark, d)))


def multi_factor(spark, d):
    return _shape(scan.complete_factors(_hits(spark, d), ADDRESS))


def hit_cap(spark, d):
    return _shape(scan.cap(_hits(spark, d), 5))


def prefix_census(spark, d):
    return scan.prefix_census(_hits(spark, d))


def chunked_entropy(spark, d):
    return _shape(candidate.chunked_entropy(_hits(spark, d)))


def sequence_patterns(spark, d):
    return _shape(candidate.drop_patterns(_hits(spark, d)))


def version_strings(spark, d):
    return _shape(candidate.drop_versions(_hits(spark, d)))


def placeholder_filter(spark, d):
    return _shape(candidate.key_filter(_hits(spark, d)))


def dictionary_words(spark, d):
    docs = readers.documents(spark, d)
    words = candidate.ranked_words(docs, "text", max(1, -(-docs.count() // WORD_SHARE)))
    return _shape(candidate.drop_words(_hits(spark, d), words))


def similar_merge(spark, d):
    return _shape(candidate.merge_similar(_hits(spark, d)))


def password_filter(spark, d):
    hits = _hits(spark, d)
    return hits.select("file", "value", candidate.password_class(F.col("value")).cast("bigint").alias("password_class")).distinct()


def unescape(spark, d):
    from sluice.functions.text import unescape as op

    return op(readers.documents(spark, d)).select("file", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def rich_scan(spark, d):
    return scan.rich(_hits(spark, d)).select("file", "rule_name", "prefix", "whole_secret_value", F.col("index_start").cast("bigint").alias("index_start"))


def funnel(spark, d):
    hits = _hits(spark, d)
    reduced = stage(scan.drop_contained(hits), "reduced")
    return candidate.funnel([("raw", hits), ("contained", reduced), ("entropy", candidate.chunked_entropy(reduced)), ("patterns", candidate.drop_patterns(candidate.chunked_entropy(reduced)))])


def resume_scan(spark, d):
    docs = readers.documents(spark, d)
    earlier = readers.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("file"))
    return sinks.unscanned(docs, stage(earlier, "scanned")).select("file")


def live_findings(spark, d):
    """The live findings in their public shape."""
    hits = scan.live(readers.documents(spark, d))
    return classify_v2.findings(stage(classify_v2.classify(hits, NOW), "classified"), include_noise=True).withColumn("line", F.col("line").cast("bigint"))


def live_classified(spark, d):
    """The flagship: scan, reduce and classify; what the rules leave pending takes its nearest settled hit's risk."""
    made = vector.classify_with_kb(scan.live(readers.documents(spark, d)), None, NOW)
    return made.select("file", "rule_name", "value", F.col("line_start").cast("bigint").alias("line"), "risk", "reason_code", "variable")


def findings_summary(spark, d):
    return classify_v2.summary(classify_v2.classify(scan.drop_contained(_hits(spark, d)), NOW))


def classified_v1(spark, d):
    return classify_v1.classify(_hits(spark, d), NOW).groupBy("rule_name", "risk_label", "risk_reason").agg(F.count(F.lit(1)).alias("n"))


def classified_v2(spark, d):
    return classify_v2.classify(_hits(spark, d), NOW).groupBy("rule_name", "risk", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def policy_join(spark, d):
    """Hits by the kind of their rule: a join with the small rule table."""
    policy = F.broadcast(rules.table(spark).select("rule_name", F.col("is_mechanical").alias("kind")))
    return _hits(spark, d).select("rule_name").join(policy, "rule_name").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def uri_triage(spark, d):
    pages = readers.pages(spark, d).select(F.col("page_id").cast("string").alias("file"), F.lit("Uri").alias("rule_name"), F.lit("uri").alias("series"), F.element_at(F.split(F.regexp_extract("url", r"://[^/]*([^?#]*)", 1), "/"), -1).alias("value"), F.col("url").alias("match"))
    return classify_v1.classify(pages, NOW).select("file", "value", "risk_label", "risk_reason")


def jwt_claims(spark, d):
    """Tokens made from the events' properties, classified. [V26]"""
    b64 = lambda c: F.regexp_replace(F.translate(F.base64(F.encode(c, "utf-8")), "+/", "-_"), "[=\\s]", "")
    events = readers.table(spark, d, "events").select("event_id", "user_id", "event_type")
    payload = F.concat(F.lit('{"exp":'), (F.lit(NOW) + (F.col("user_id") % 7 - 3) * 400_000).cast("string"), F.lit(',"scope":"'), F.col("event_type"), F.lit('"}'))
    token = F.concat_ws(".", F.lit("eyJhbGciOiJSUzI1NiJ9"), b64(payload), F.lit("c2ln"))
    hits = events.select(F.col("event_id").cast("string").alias("file"), F.lit("jwt").alias("rule_name"), F.lit("jwt").alias("series"), token.alias("value"), token.alias("match"))
    return classify_v2.classify_tokens(hits, NOW).groupBy("risk", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def labelled_v1(spark, d):
    """Pending hits by their nearest neighbour among all hits that the rules settle."""
    hits = _hits(spark, d)
    return classify_v1.label(hits, _settled(hits), NOW).groupBy("rule_name", "risk_label").agg(F.count(F.lit(1)).alias("n"))


def batch_labelled(spark, d):
    """The batch composition over all documents, its pending hits by the hits that the rules settle."""
    docs = readers.documents(spark, d)
    words = candidate.ranked_words(docs, "text", max(1, -(-docs.count() // WORD_SHARE)))
    return batch.run(docs, words, _settled(_hits(spark, d)), now=NOW).groupBy("rule_name", "risk_label").agg(F.count(F.lit(1)).alias("n"))


def scan_log(spark, d):
    """Every file with its number of hits."""
    return batch.progress(readers.documents(spark, d), _hits(spark, d)).select("file", F.col("n_hits").cast("bigint").alias("n_hits"))


def oldest_scan(spark, d):
    return _shape(scan.oldest(readers.documents(spark, d))).select("file", "rule_name", "index_start", "index_end")


def _settled(hits):
    """The hits that the rules settle, as a knowledge base."""
    settled = classify_v1.classify(hits, NOW).where(F.col("risk_label") != PENDING).select(classify_v1.vector_text().alias("t"), "risk_label").distinct()
    kb = vector.embed(settled, "t").select(F.concat_ws(":", "risk_label", F.md5("t")).alias("id"), "vector", F.lower("risk_label").alias("risk_level"), F.lit(None).cast("string").alias("service"))
    return stage(kb, "kb")


def _kb(spark, d):
    vectors = readers.table(spark, d, "embeddings")
    kb = vectors.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("embedding").alias("vector"),
                                                F.when(F.col("label") < 3, "critical").when(F.col("label") < 7, "medium").otherwise("low").alias("risk_level"), F.lit(None).cast("string").alias("service"))
    return vectors.where("vec_id % 50 = 0").select("vec_id", F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("own"), F.col("embedding").alias("vector")), kb


def kb_nearest(spark, d):
    queries, kb = _kb(spark, d)
    found = vector.nearest(queries, kb, own_col="own")
    return found.select("vec_id", F.col("kb_id").cast("bigint").alias("kb_id"), F.round("score", 3).alias("score"))


def kb_threshold(spark, d):
    queries, kb = _kb(spark, d)
    hit = F.when(F.round("score", 3) >= 0.8, F.col("kb_risk")).otherwise("miss")
    return vector.nearest(queries, kb, own_col="own").groupBy(hit.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def kb_classified(spark, d):
    narrow = vector.embed(_hits(spark, d).select("value").distinct().withColumn("t", F.col("value")), "t").select(F.md5("value").alias("id"), "vector", F.lit("medium").alias("risk_level"), F.lit(None).cast("string").alias("service"))
    return vector.classify_with_kb(_hits(spark, d), narrow, NOW).groupBy("risk", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def embed_context(spark, d):
    ready = vector.embedding_text(classify_v2.prepare(_hits(spark, d)))
    return ready.select("file", F.col("index_start").cast("bigint").alias("index_start"), "rule_name", "embedding_text")


def url_normalize(spark, d):
    return readers.pages(spark, d).select("page_id", collect.normalized(F.col("url")).alias("n")).select("page_id", "n.url", "n.error")


def url_identity(spark, d):
    u = F.col("url")
    return readers.pages(spark, d).select("page_id", collect.identity(u).alias("identity"), collect.directory_key(u).alias("directory"), collect.is_valid(u).alias("valid"))


def url_extension(spark, d):
    return readers.pages(spark, d).select("page_id", collect.extension(F.col("url"), F.lit("text/html"), F.lit("document")).alias("extension"), collect.file_name(F.col("url"), F.lit("document")).alias("file_name"))


def html_links(spark, d):
    return collect.html_links(readers.pages(spark, d)).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("href").alias("n_distinct"))


def link_edges(spark, d):
    return collect.resolve(collect.html_links(readers.pages(spark, d)).where(F.col("kind") == "page")).where("target IS NOT NULL").select(F.col("url").alias("src"), F.col("target").alias("dst")).distinct()


def crawl_frontier(spark, d):
    edges = stage(link_edges(spark, d).select(collect.identity(F.col("src")).alias("src"), "dst"), "edges")
    seeds = readers.pages(spark, d).groupBy(collect.netloc(F.col("url"))).agg(F.min(collect.identity(F.col("url"))).alias("url")).select("url")
    return collect.frontier(edges, seeds, 2).select("url", F.col("depth").cast("bigint").alias("depth"))


def probe_plan(spark, d):
    sites = readers.pages(spark, d).select(collect.netloc(F.col("url")).alias("site")).distinct()
    return collect.probe_plan(sites, "full").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def _resources(spark, d):
    p = readers.pages(spark, d)
    return p.select(F.col("page_id").cast("int").alias("index"), "url", F.when(F.col("page_id") % 5 == 0, "POST").otherwise("GET").alias("method"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"),
                    F.when(F.col("page_id") % 3 == 0, "script").otherwise("document").alias("resource_type"), F.lit("text/html").alias("content_type"), F.concat(F.lit("out/"), F.col("page_id")).alias("saved_path"),
                    F.octet_length("html").cast("bigint").alias("size_bytes"), F.col("html").cast("binary").alias("content"), collect.netloc(F.col("url")).alias("site"))


def soft404(spark, d):
    r = _resources(spark, d)
    landing = r.groupBy("site").agg(F.min_by(F.md5("content"), "index").alias("landing_hash"), F.min_by(F.octet_length("content"), "index").alias("landing_size"))
    return collect.soft_404(r, landing).select("url", "is_soft_404", "soft_404_reason", "spa_shell")


def crawl_stats(spark, d):
    return collect.crawl_stats(_resources(spark, d).drop("content"))


def payload_selection(spark, d):
    r = _resources(spark, d).withColumn("is_soft_404", F.col("status") == 404)
    return collect.payloads(r, "out/").select("url", F.col("size_bytes"))


def ssr_findings(spark, d):
    """Pages with the state that their framework would have put in them."""
    state = (F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"page":"'), "url", F.lit('"}</script>')))
             .when(F.col("page_id") % 3 == 1, F.concat(F.lit('<script>window.__NUXT__ = {"page":"'), "url", F.lit('"};</script>'))).otherwise(F.lit("")))
    return collect.ssr_findings(readers.pages(spark, d).withColumn("html", F.concat("html", state))).select("page_id", "type", "frame", F.md5("snippet").alias("snippet_md5"))


def page_references(spark, d):
    """Pages with the imports and maps that a bundle of theirs would have."""
    name = F.concat(F.lit("p"), "page_id")
    tail = F.concat(F.lit('\nimport("./'), name, F.lit('.js"); import("./'), name, F.lit('.mjs"); var c = "chunk-'), name, F.lit('.js", l = "/locales/'), name, F.lit('.json", w = "'), name,
                    F.lit('.wasm";\nnavigator.serviceWorker.register("/sw-'), name, F.lit('.js");\n//# sourceMappingURL='), name, F.lit(".js.map"))
    return collect.references(readers.pages(spark, d).select(F.col("page_id").cast("string").alias("file"), F.concat("html", tail).alias("text")))


def json_urls(spark, d):
    """The events' properties inside a document that links to their type's page."""
    text = F.concat(F.lit('{"props": '), "props", F.lit(', "links": [{"self": "/events/'), "event_type", F.lit('"}, "https://h.example/'), F.col("user_id").cast("string"), F.lit('", "no link"]}'))
    return collect.json_urls(readers.table(spark, d, "events").select(F.col("event_id").cast("string").alias("file"), text.alias("text")))


def keyed_urls(spark, d):
    """Pages that name their own address with a key parameter."""
    text = F.concat("html", F.lit(' <a href="'), F.regexp_replace("url", r"[?#].*$", ""), F.lit("?lang=x&key=K-"), F.col("page_id").cast("string"), F.lit('">x</a>'))
    return _shape(scan.keyed_urls(readers.pages(spark, d).select(F.col("page_id").cast("string").alias("file"), text.alias("text"))))


def string_veto(spark, d):
    """Events' properties as JSON files, their own values as hits."""
    events = readers.table(spark, d, "events")
    assets = events.select(F.concat(F.col("event_id"), F.lit(".json")).alias("file"), F.concat(F.lit('{"note": "'), F.md5(F.col("event_id").cast("string")), F.lit('"}')).alias("text"))
    hits = events.select(F.concat(F.col("event_id"), F.lit(".json")).alias("file"), F.lit("generic-api-key").alias("rule_name"), F.lit("generic").alias("series"), F.when(F.col("event_id") % 2 == 0, F.md5(F.col("event_id").cast("string"))).otherwise(F.substr(F.md5(F.col("event_id").cast("string")), F.lit(1), F.lit(20))).alias("value"), F.lit(1).alias("line_start"))
    return strings.veto(hits, strings.extracted(assets)).select("file", "value")


def js_bindings(spark, d):
    events = readers.table(spark, d, "events")
    value = F.concat(F.base64(F.md5(F.col("event_id").cast("string")).cast("binary")), F.lit("Q7"))
    assets = events.select(F.col("event_id").cast("string").alias("file"), F.concat(F.lit('var a="'), value, F.lit('",b=2;init({apiKey:a,other:b})')).alias("text"))
    return bindings.bindings(assets).select("file", "prop_key", "var_name", "val", "entropy")


def _local(spark, d):
    value = F.concat(F.base64(F.md5(F.col("event_id").cast("string")).cast("binary")), F.lit("Q7"))
    use = F.when(F.col("event_id") % 3 == 0, "fetch(u,{Authorization:k})").when(F.col("event_id") % 3 == 1, "x.charCodeAt(0)").otherwise("sign (k)")
    return readers.table(spark, d, "events").select(F.col("event_id").cast("string").alias("file"), F.concat(F.lit('let k = "'), value, F.lit('";'), use).alias("text"))


def context_signals(spark, d):
    assets = _local(spark, d)
    return bindings.context_signals(assets, bindings.local_secrets(assets)).select("file", "var", "val", "entropy", "signal")


def value_class(spark, d):
    return _hits(spark, d).groupBy(bindings.value_class(F.col("value")).alias("value_class")).agg(F.count(F.lit(1)).alias("n"))


def _paths(spark, d):
    """Hits with crawl-like paths: the documents' sources as folders, extensions by language."""
    docs = readers.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "source", "lang")
    ext = F.when(F.col("lang") == "en", ".js").when(F.col("lang") == "fr", ".html").when(F.col("lang") == "de", ".json").otherwise(".css")
    return _hits(spark, d).join(docs, "file").withColumn("file", F.concat(F.lit("/corpus/"), F.col("source"), F.lit("_com/"), F.col("file"), ext))


def file_types(spark, d):
    return analysis.file_types(_paths(spark, d))


def rule_pivot(spark, d):
    return analysis.rule_matrix(analysis.tagged(_paths(spark, d)), ["js", "html", "json", "css"]).select("rule_name", *[F.col(c).cast("bigint").alias(c) for c in ("js", "html", "json", "css")])


def topk_rules_per_group(spark, d):
    return analysis.top_rules(analysis.tagged(_paths(spark, d)), "domain", 3)


def framework_rules(spark, d):
    each = _paths(spark, d).withColumn("framework", F.explode(analysis.frameworks(F.col("file"))))
    return analysis.top_rules(each, "framework", 5, 10)


def rule_rollup(spark, d):
    return analysis.rollup(_hits(spark, d))


def leak_context(spark, d):
    return analysis.tagged(_paths(spark, d)).groupBy("context").agg(F.count(F.lit(1)).alias("n"))


def domain_top(spark, d):
    return analysis.top_domains(analysis.tagged(_paths(spark, d)))


def key_sides(spark, d):
    return _hits(spark, d).groupBy(analysis.key_side(F.col("rule_name")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


def business_categories(spark, d):
    """Hits named after providers, as a catalogue of provider rules would."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv]), F.col("rule_name"))
    return analysis.categories(analysis.tagged(_paths(spark, d)).withColumn("rule_name", named))


def event_windows(spark, d):
    from sluice.streaming.scan import event_windows as op

    return op(readers.table(spark, d, "events")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_events"))


PROVIDERS = {"Email Address": "Mailchimp", "IPv4 Address": "AWS", "Host Name": "Fastly", "Hex Digest": "Algolia", "Card Number": "Stripe", "generic-api-key": "jwt"}


QUERIES = {f.__name__: f for f in (
    rule_scan, span_positions, entropy_gate, hit_dedup, span_containment, multi_factor, hit_cap, prefix_census, chunked_entropy, sequence_patterns, version_strings,
    placeholder_filter, dictionary_words, similar_merge, password_filter, unescape, rich_scan, funnel, resume_scan, live_classified, live_findings, findings_summary, classified_v1, labelled_v1, batch_labelled, scan_log, oldest_scan,
    classified_v2, policy_join, uri_triage, jwt_claims, kb_nearest, kb_threshold, kb_classified, embed_context, url_normalize, url_identity, url_extension, html_links,
    link_edges, crawl_frontier, probe_plan, soft404, crawl_stats, payload_selection, ssr_findings, page_references, json_urls, keyed_urls, string_veto, js_bindings,
    context_signals, value_class, file_types, rule_pivot, topk_rules_per_group, framework_rules, rule_rollup, leak_context, domain_top, key_sides,
    business_categories, event_windows)}

ORACLES = oracles.sql()
