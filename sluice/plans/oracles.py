"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sluice.operators import analysis, candidate, collect
from sluice.operators.rules import CATALOGUE, Rule

NOW = 1_700_000_000


#: The patterns that the scan writes with look-arounds, in plain form.
PLAIN = {"Email Address": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", "Host Name": r"[a-z0-9]+(?:\.[a-z0-9\-]+)*\.(?:com|org|net|io)"}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(k: int, rule: Rule, source: str = "documents", file: str = "doc_id", text: str = "text", oldest: bool = False) -> str:
    group = 0 if oldest and rule.groups != 1 else 2 if rule.series == "generic" and rule.groups >= 2 else min(1, rule.groups)
    value = f"regexp_extract(m[i], {_q(PLAIN.get(rule.rule_name, rule.regex))}, {group})" if group else "m[i]"
    if rule.series == "uri" and not oldest:
        value = "nullif(regexp_extract(m[i], '://[^/:@]*:([^@]*)@', 1), '')"
    regex = _q(PLAIN.get(rule.rule_name, rule.regex))
    gate = f" AND bits >= {rule.entropy}" if rule.entropy is not None else ""
    return f"""
SELECT file, text, {_q(rule.rule_name)} AS rule_name, {_q(rule.series)} AS series, {_q(rule.is_mechanical)} AS is_mechanical, {k} AS rule_ord, {str(rule.need_keyvalue).lower()} AS need_keyvalue,
       match, value, s AS index_start, s + length(match) AS index_end, bits AS entropy
FROM (SELECT file, text, m[i] AS match, {value} AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT {file}::VARCHAR AS file, {text} AS text, regexp_extract_all({text}, {regex}) AS m, string_split_regex({text}, {regex}) AS g,
                   unnest(range(1, len(regexp_extract_all({text}, {regex})) + 1)) AS i FROM {source}))
     , LATERAL (SELECT coalesce(-sum(c / n * log2(c / n)), 0.0) AS bits FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS n FROM (SELECT unnest(string_split(value, '')) AS ch) WHERE ch <> '' GROUP BY ch))
WHERE value IS NOT NULL AND value <> ''{gate}"""


def hits(rules: tuple[Rule, ...] = CATALOGUE, **where: str) -> str:
    """A CTE ``hits`` of a catalogue over a table."""
    return "hits AS (" + " UNION ALL ".join(_rule(k, r, **where) for k, r in enumerate(rules)) + ")"


_KEYS = "file, rule_name, value, index_start::BIGINT AS index_start, index_end::BIGINT AS index_end"
_REDUCED = """reduced AS (SELECT * FROM hits x WHERE NOT EXISTS (SELECT 1 FROM hits y WHERE y.file = x.file AND y.index_start <= x.index_start AND x.index_end <= y.index_end
  AND y.value <> x.value AND (y.index_start <> x.index_start OR y.index_end <> x.index_end OR x.rule_ord < y.rule_ord)))"""
_ENTROPY = "coalesce(-list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: len(list_filter(string_split({v}, ''), lambda y: y = c)) / length({v})::DOUBLE * log2(len(list_filter(string_split({v}, ''), lambda y: y = c)) / length({v})::DOUBLE))), 0.0)"


def _contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _patterns() -> str:
    parts = []
    for r in CATALOGUE:
        own = "" if r.rule_name == "generic-api-key" else r.regex.lower()
        parts.append(f"(rule_name = {_q(r.rule_name)} AND {_contains('value', [p for p in candidate.sequence_patterns() if p.lower() not in own])})")
    return " OR ".join(parts)


_LOW = (f"CASE WHEN length(value) < 30 THEN {_ENTROPY.format(v='value')} < 2.4 ELSE len(list_filter(list_transform(range(1, (length(value) // 30)::BIGINT + 1), "
        "lambda k: substr(value, (k - 1) * 30 + 1, CASE WHEN k = length(value) // 30 THEN length(value) ELSE 30 END)), lambda z: " + _ENTROPY.format(v="z") + " < 3)) > 0 END")
_MACHINE_ENTROPY = f"(is_mechanical = 'human' OR series = 'private' OR NOT ({_LOW}))"
_PARTS = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?"
_PATHS = """paths AS (SELECT h.*, '/corpus/' || d.source || '_com/' || h.file || CASE d.lang WHEN 'en' THEN '.js' WHEN 'fr' THEN '.html' WHEN 'de' THEN '.json' ELSE '.css' END AS path,
  CASE d.lang WHEN 'en' THEN 'js' WHEN 'fr' THEN 'html' WHEN 'de' THEN 'json' ELSE 'css' END AS ext, d.source || '.com' AS domain FROM hits h JOIN documents d ON d.doc_id::VARCHAR = h.file)"""
_RESOURCES = """r AS (SELECT page_id AS index, url, CASE WHEN page_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 3 = 0 THEN 'script' ELSE 'document' END AS resource_type, strlen(html)::BIGINT AS size_bytes, html, regexp_extract(url, '://([^/?#]*)', 1) AS site FROM pages)"""


def sql() -> dict[str, str]:
    h = "WITH " + hits()
    out = {
        "rule_scan": f"{h} SELECT rule_name, series, count(*) AS n_hits, count(DISTINCT file) AS n_files FROM hits GROUP BY ALL",
        "span_positions": f"""{h} SELECT file, rule_name, match, index_start::BIGINT AS index_start, index_end::BIGINT AS index_end,
            (length(substr(text, 1, index_start::BIGINT)) - length(replace(substr(text, 1, index_start::BIGINT), chr(10), '')) + 1)::BIGINT AS line_start,
            (length(string_split(substr(text, 1, index_start::BIGINT), chr(10))[-1]) + 1)::BIGINT AS col_start,
            (length(substr(text, 1, index_end::BIGINT)) - length(replace(substr(text, 1, index_end::BIGINT), chr(10), '')) + 1)::BIGINT AS line_end,
            (length(string_split(substr(text, 1, index_end::BIGINT), chr(10))[-1]) + 1)::BIGINT AS col_end FROM hits""",
        "entropy_gate": f"{h} SELECT file, rule_name, value, index_start::BIGINT AS index_start, round(entropy, 6) AS entropy FROM hits WHERE round(entropy, 6) >= 3.0",
        "hit_dedup": f"{h} SELECT file, rule_name, value, index_start::BIGINT AS index_start, (2 * count(*))::BIGINT AS n_seen FROM hits GROUP BY file, rule_name, value, index_start, index_end",
        "span_containment": f"{h}, {_REDUCED} SELECT {_KEYS} FROM reduced",
        "multi_factor": f"""{h} SELECT {_KEYS} FROM hits x WHERE series <> 'address' OR (SELECT count(DISTINCT rule_name) FROM hits y WHERE y.file = x.file AND y.series = 'address') = 2""",
        "hit_cap": f"{h} SELECT {_KEYS} FROM hits x WHERE (SELECT count(*) FROM hits y WHERE y.file = x.file AND y.rule_ord < x.rule_ord) <= 5",
        "prefix_census": f"""{h}, g AS (SELECT lower(regexp_extract(match, '^([A-Za-z_]+)', 1)) AS prefix, * FROM hits WHERE series = 'generic')
            SELECT prefix, count(*) AS n_hits, min(CASE WHEN NOT contains(prefix, 'api') OR entropy >= 3.5 THEN {{'file': file, 'index_start': index_start, 'value': value}} END).value AS sample FROM g GROUP BY prefix""",
        "chunked_entropy": f"{h} SELECT {_KEYS} FROM hits WHERE {_MACHINE_ENTROPY}",
        "sequence_patterns": f"{h} SELECT {_KEYS} FROM hits WHERE is_mechanical = 'human' OR NOT ({_patterns()})",
        "version_strings": f"{h} SELECT {_KEYS} FROM hits WHERE is_mechanical = 'human' OR NOT regexp_matches(value, '^[0-9]+\\.[0-9]+\\.[0-9]+')",
        "policy_join": f"{h} SELECT is_mechanical AS kind, count(*) AS n FROM hits GROUP BY 1",
        "resume_scan": "SELECT doc_id::VARCHAR AS file FROM documents WHERE lang IS NULL OR lang <> 'en'",
        "funnel": f"""{h}, {_REDUCED}, e AS (SELECT * FROM reduced WHERE {_MACHINE_ENTROPY})
            SELECT 'raw' AS stage, count(*) AS n_hits FROM hits UNION ALL SELECT 'contained', count(*) FROM reduced UNION ALL SELECT 'entropy', count(*) FROM e
            UNION ALL SELECT 'patterns', count(*) FROM e WHERE is_mechanical = 'human' OR NOT ({_patterns()})""",
        "scan_log": f"{h} SELECT d.doc_id::VARCHAR AS file, count(x.file) AS n_hits FROM documents d LEFT JOIN hits x ON x.file = d.doc_id::VARCHAR GROUP BY d.doc_id",
        "oldest_scan": "WITH " + hits(oldest=True) + f", {_REDUCED} SELECT file, rule_name, index_start::BIGINT AS index_start, index_end::BIGINT AS index_end FROM reduced",
        "js_bindings": f"""WITH v AS (SELECT event_id, to_base64(encode(md5(event_id::VARCHAR))) || 'Q7' AS val FROM events), e AS (SELECT *, {_ENTROPY.format(v='val')} AS bits FROM v)
            SELECT event_id::VARCHAR AS file, 'apiKey' AS prop_key, 'a' AS var_name, val, round(bits, 2) AS entropy FROM e
            WHERE bits >= 4.5 AND length(val) BETWEEN 20 AND 150 AND NOT regexp_matches(val, '^[A-Za-z]{{20,}}$') AND NOT regexp_matches(val, '__[A-Za-z0-9]{{4,}}$')""",
        "context_signals": f"""WITH v AS (SELECT event_id, to_base64(encode(md5(event_id::VARCHAR))) || 'Q7' AS val FROM events), e AS (SELECT *, {_ENTROPY.format(v='val')} AS bits FROM v)
            SELECT event_id::VARCHAR AS file, 'k' AS var, substr(val, 1, 80) AS val, round(bits, 2) AS entropy, CASE event_id % 3 WHEN 0 THEN 'HTTP_AUTH' ELSE 'CRYPTO' END AS signal
            FROM e WHERE bits >= 4.5 AND event_id % 3 <> 1""",
        "placeholder_filter": f"""{h}, k AS (SELECT *, lower(regexp_replace(substr(match, 1, strpos(match, value) - 1), '[^a-zA-Z]*$', '')) AS key,
              len(list_filter([{', '.join(_q(w) for w in candidate.VALUE_PLACEHOLDERS)}], lambda w: contains(lower(value), w))) + len(list_filter([{', '.join(_q(w) for w in candidate.MATCH_PLACEHOLDERS)}], lambda w: contains(lower(match), w))) AS n FROM hits)
            SELECT {_KEYS} FROM k WHERE NOT (is_mechanical = 'human' AND n >= 2) AND NOT (need_keyvalue AND match <> value AND
              (list_has_any(string_split_regex(key, '[._-]'), [{', '.join(_q(w.lower()) for w in (*candidate.KEY_LEFT, *candidate.KEY_RIGHT))}]) OR {_contains('key', candidate.WHOLE_KEYS)} OR {_contains('lower(value)', candidate.MACHINE_VALUES)}
               OR {' OR '.join(f"ends_with(key, {_q(e)})" for e in candidate.FILE_ENDINGS)}))""",
        "rule_rollup": f"{h} SELECT series, rule_name, count(*) AS n FROM hits GROUP BY ROLLUP (series, rule_name)",
        "rule_pivot": f"{h}, {_PATHS} SELECT rule_name, count(*) FILTER (ext = 'js') AS js, count(*) FILTER (ext = 'html') AS html, count(*) FILTER (ext = 'json') AS json, count(*) FILTER (ext = 'css') AS css FROM paths GROUP BY 1",
        "file_types": f"{h}, {_PATHS} SELECT ext, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM paths), 4) AS percent FROM paths GROUP BY ext ORDER BY n DESC, ext LIMIT 30",
        "topk_rules_per_group": f"""{h}, {_PATHS}, c AS (SELECT domain, rule_name, count(*) AS n FROM paths GROUP BY ALL)
            SELECT domain, rule_name, n FROM c QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, rule_name) <= 3""",
        "leak_context": f"""{h}, {_PATHS} SELECT CASE ext WHEN 'html' THEN CASE WHEN {_contains('lower(substr(match, 1, 100))', ['script', '<html', '{', 'function', 'window.'])} THEN 'inline_html_script' ELSE 'static_html' END
            WHEN 'js' THEN 'external_js' WHEN 'json' THEN 'external_js' ELSE 'css_embed' END AS context, count(*) AS n FROM paths GROUP BY 1""",
        "domain_top": f"""{h}, {_PATHS}, c AS (SELECT domain, rule_name, count(*) AS n FROM paths GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, rule_name) AS i FROM c)
            SELECT domain, sum(n)::BIGINT AS n, string_agg(rule_name || ':' || n, ', ' ORDER BY i) FILTER (i <= 5) AS rules FROM k GROUP BY domain ORDER BY n DESC, domain LIMIT 20""",
        "kb_nearest": """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), k AS (SELECT * FROM embeddings),
            s AS (SELECT q.vec_id, k.vec_id AS kb_id, list_cosine_similarity(q.embedding, k.embedding)::DOUBLE AS score FROM q, k WHERE q.vec_id <> k.vec_id)
            SELECT vec_id, arg_max(kb_id, score) AS kb_id, round(max(score), 3) AS score FROM s GROUP BY vec_id""",
        "kb_threshold": """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), k AS (SELECT * FROM embeddings),
            s AS (SELECT q.vec_id, k.label, list_cosine_similarity(q.embedding, k.embedding)::DOUBLE AS score FROM q, k WHERE q.vec_id <> k.vec_id),
            b AS (SELECT vec_id, arg_max(label, score) AS label, round(max(score), 3) AS score FROM s GROUP BY vec_id)
            SELECT CASE WHEN score < 0.8 THEN 'miss' WHEN label < 3 THEN 'critical' WHEN label < 7 THEN 'medium' ELSE 'low' END AS outcome, count(*) AS n FROM b GROUP BY 1""",
        "url_normalize": f"""WITH p AS (SELECT page_id, lower(regexp_extract(url, {_q(_PARTS)}, 1)) AS s, regexp_extract(url, {_q(_PARTS)}, 2) AS n, regexp_extract(url, {_q(_PARTS)}, 3) AS p, regexp_extract(url, {_q(_PARTS)}, 4) AS q FROM pages),
            e AS (SELECT *, CASE WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN contains(n, '@') THEN 'userinfo' WHEN n = '' THEN 'host' END AS error FROM p)
            SELECT page_id, CASE WHEN error IS NULL THEN s || '://' || n || CASE WHEN p = '' THEN '/' ELSE p END || q END AS url, error FROM e""",
        "url_identity": f"""WITH p AS (SELECT *, list_filter(list_transform(string_split(regexp_extract(url, {_q(_PARTS)}, 3), '/'), lambda x: lower(x)), lambda x: x <> '') AS seg FROM pages)
            SELECT page_id, regexp_replace(url, '[?#].*$', '') AS identity, regexp_replace(regexp_extract(url, {_q(_PARTS)}, 2), '[^A-Za-z0-9._-]', '_', 'g') || '_' || substr(sha256(url), 1, 12) AS directory,
                   length(regexp_extract(url, {_q(_PARTS)}, 3)) <= 400 AND len(seg) <= 12 AND len(list_filter(list_distinct(seg), lambda s: len(list_filter(seg, lambda x: x = s)) > 2)) = 0 AS valid FROM p""",
        "html_links": "WITH l AS (" + " UNION ALL ".join(
            f"SELECT page_id, {_q(kind)} AS kind, unnest(regexp_extract_all(html, {_q(pattern.replace('((?!data:)', '(').replace('((?![#?])', '([^#?]'.replace('[^#?]', '')))}, 1)) AS href FROM pages" for kind, pattern in collect._LINKS)
            + ") SELECT page_id, kind, count(*) AS n, count(DISTINCT href) AS n_distinct FROM l WHERE NOT (kind = 'page' AND (starts_with(href, '#') OR starts_with(href, '?'))) GROUP BY ALL",
        "probe_plan": "WITH s AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS site FROM pages) SELECT t.tier, (count(*) * any_value(t.n))::BIGINT AS n FROM s, (VALUES "
            + f"('manifest', {len(collect.PROBES_MANIFEST)}), ('high', {len(collect.PROBES_HIGH)}), ('build', 132), ('debug', 37)" + ") t(tier, n) GROUP BY t.tier",
        "crawl_stats": f"WITH {_RESOURCES} SELECT resource_type, status, method, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM r GROUP BY GROUPING SETS ((resource_type), (status), (method), ())",
        "payload_selection": f"WITH {_RESOURCES} SELECT url, size_bytes FROM r WHERE status <> 404",
        "soft404": f"""WITH {_RESOURCES}, l AS (SELECT site, arg_min(html, index) AS landing FROM r GROUP BY site),
            e AS (SELECT r.*, html = landing AS same, regexp_extract(url, '://[^/?#]*[^?#]*\\.([A-Za-z0-9]+)(?:[?#]|$)', 1) AS own FROM r JOIN l USING (site))
            SELECT url, coalesce(reason IS NOT NULL, false) AS is_soft_404, reason AS soft_404_reason, same AND resource_type = 'document' AS spa_shell
            FROM (SELECT *, CASE WHEN same AND resource_type <> 'document' THEN 'landing_hash' END AS reason FROM e)""",
        "event_windows": "WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, count(*) AS n_windows, sum(n)::BIGINT AS n_events FROM w GROUP BY 1",
        "uri_triage": f"""WITH v AS (SELECT page_id::VARCHAR AS file, string_split(regexp_extract(url, '://[^/]*([^?#]*)', 1), '/')[-1] AS value FROM pages),
            e AS (SELECT *, {_ENTROPY.format(v='value')} AS bits FROM v)
            SELECT file, value, CASE WHEN length(value) < 8 OR (regexp_matches(value, '^[a-z]+$') AND length(value) < 15) OR bits < 3.5 THEN 'FalsePositive' ELSE 'Critical' END AS risk_label,
                   CASE WHEN length(value) < 8 THEN 'uri_short' WHEN regexp_matches(value, '^[a-z]+$') AND length(value) < 15 THEN 'uri_word' WHEN bits < 3.5 THEN 'uri_entropy' ELSE 'provider_default' END AS risk_reason FROM e""",
        "jwt_claims": f"""WITH t AS (SELECT event_type, {NOW} + (user_id % 7 - 3) * 400000 AS exp FROM events)
            SELECT CASE WHEN {_contains('event_type', ['admin', 'root', 'superuser', 'write', 'delete', 'manage'])} THEN 'Critical' ELSE 'Potential' END AS risk,
                   CASE WHEN {_contains('event_type', ['admin', 'root', 'superuser', 'write', 'delete', 'manage'])} THEN 'jwt_privilege' WHEN exp < {NOW} THEN 'jwt_expired' WHEN exp - {NOW} > 604800 THEN 'jwt_long_lived' ELSE 'jwt_claims' END AS reason_code, count(*) AS n FROM t GROUP BY ALL""",
        "string_veto": "SELECT event_id || '.json' AS file, md5(event_id::VARCHAR) AS value FROM events WHERE event_id % 2 = 0",
        "password_filter": f"""{h}, v AS (SELECT DISTINCT file, value, {_ENTROPY.format(v='value')} AS bits FROM hits)
            SELECT file, value, CASE WHEN length(value) < 4 OR regexp_matches(value, '[ \\t\\n\\r\\f\\x0B(){{}};]') THEN 0
              WHEN length(value) >= 8 AND (regexp_matches(value, '[a-z]')::INT + regexp_matches(value, '[A-Z]')::INT + regexp_matches(value, '[0-9]')::INT + regexp_matches(value, '[^A-Za-z0-9]')::INT >= 3 OR bits >= 3) THEN 2
              ELSE 1 END::BIGINT AS password_class FROM v""",
        "rich_scan": f"""{h}, k AS (SELECT *, regexp_extract(match, '^([A-Za-z_]+)', 1) AS key FROM hits WHERE length(value) >= 5 AND NOT (series = 'generic' AND length(value) = 42 AND starts_with(value, '0x'))
              AND NOT (series = 'private' AND (length(match) < 128 OR (regexp_matches(match, 'ECC|RSA') AND length(match) < 256))))
            SELECT file, rule_name, CASE WHEN series = 'generic' THEN key END AS prefix, CASE WHEN series IN ('generic', 'uri', 'jdbc') THEN value ELSE trim(match) END AS whole_secret_value,
                   (index_start + CASE WHEN series = 'generic' THEN length(key) ELSE 0 END)::BIGINT AS index_start FROM k""",
        "key_sides": f"""{h}, s AS (SELECT {_contains('lower(rule_name)', [w.lower() for w in analysis.SDK_WORDS])} AS sdk, {_contains('lower(rule_name)', [w.lower() for w in analysis.SERVER_WORDS])} AS server FROM hits)
            SELECT CASE WHEN sdk AND NOT server THEN 'SDK/Public' WHEN server AND NOT sdk THEN 'Server/Secret' ELSE 'Ambiguous/Uncategorized' END AS side, count(*) AS n FROM s GROUP BY 1""",
        "business_categories": f"{h}, {_PATHS}, c AS (SELECT *, CASE " + " ".join(
            f"WHEN CASE rule_name WHEN 'Email Address' THEN 'Mailchimp' WHEN 'IPv4 Address' THEN 'AWS' WHEN 'Host Name' THEN 'Fastly' WHEN 'Hex Digest' THEN 'Algolia' WHEN 'Card Number' THEN 'Stripe' ELSE 'jwt' END IN ({', '.join(map(_q, names))}) THEN {_q(category)}" for category, names in analysis.CATEGORIES.items())
            + " END AS category FROM paths) SELECT category, count(*) AS n_hits, count(DISTINCT domain) AS n_domains FROM c WHERE category IS NOT NULL GROUP BY 1",
        "framework_rules": f"{h}, {_PATHS}, e AS (" + " UNION ALL ".join(
            f"SELECT {_q(name)} AS framework, rule_name FROM paths WHERE regexp_matches(path, {_q('(?i)(?:' + pattern + ')')})" for name, pattern in analysis.FRAMEWORKS.items())
            + """), c AS (SELECT framework, rule_name, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY framework) AS total FROM c)
            SELECT framework, rule_name, n FROM t WHERE total >= 10 QUALIFY row_number() OVER (PARTITION BY framework ORDER BY n DESC, rule_name) <= 5""",
        "value_class": f"""{h}, v AS (SELECT value AS v, regexp_replace(value, '[^a-zA-Z0-9]', '', 'g') AS bare FROM hits)
            SELECT CASE WHEN length(bare) >= 30 AND len(list_distinct(string_split(bare, ''))) / length(bare)::DOUBLE > 0.85 THEN 'charset_table' WHEN regexp_matches(v, '^(/|\\.\\.?/|https?://|data:)') THEN 'path_or_url'
              WHEN regexp_matches(v, '[<>{{}}\\s()]') THEN 'code_or_markup' WHEN regexp_matches(v, '^[a-zA-Z][a-zA-Z0-9]*(-[a-zA-Z0-9]+){{2,}}(\\.[a-z]+)?$') THEN 'asset_id'
              WHEN regexp_matches(v, '^(sk_live_|sk_test_|pk_live_|pk_test_|AKIA[0-9A-Z]|AIzaSy|xox[abprs]-|SG\\.[A-Za-z0-9]|ghp_|ya29\\.|eyJ)') THEN 'known_secret_format'
              WHEN regexp_matches(v, '^[0-9a-f]{{32,64}}$') THEN 'hex_hash' WHEN regexp_matches(v, '^[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'version' ELSE 'high_entropy_unknown' END AS value_class, count(*) AS n FROM v GROUP BY 1""",
        "url_extension": f"""WITH p AS (SELECT page_id, regexp_extract(string_split(url, '/')[-1], '^([^?]*)', 1) AS last, string_split(trim(regexp_extract(url, {_q(_PARTS)}, 3), '/'), '/')[-1] AS name FROM pages),
            e AS (SELECT *, lower(regexp_extract(last, '(\\.[^.]*)$', 1)) AS own FROM p)
            SELECT page_id, CASE WHEN contains(last, '.') THEN CASE WHEN own IN ({', '.join(map(_q, collect.SKIPPED))}) THEN '' ELSE own END ELSE '.html' END AS extension,
                   substr(regexp_replace(CASE WHEN name = '' THEN 'document_index' ELSE name END, '[^A-Za-z0-9._-]', '_', 'g'), 1, 200) AS file_name FROM e""",
        "ssr_findings": """SELECT page_id, 'SSR_DATA_INJECTION' AS type, CASE page_id % 3 WHEN 0 THEN 'Next.js' ELSE 'Nuxt.js' END AS frame, md5(substr('{"page":"' || url || '"}', 1, 500)) AS snippet_md5
            FROM pages WHERE page_id % 3 < 2""",
        "page_references": """SELECT page_id::VARCHAR AS file, k.kind, k.pre || 'p' || page_id || k.post AS ref FROM pages, (VALUES ('source_map', '', '.js.map'), ('chunk', 'chunk-', '.js'),
            ('dynamic_import', './', '.js'), ('dynamic_import', './', '.mjs'), ('i18n', '/locales/', '.json'), ('service_worker', '/sw-', '.js'), ('wasm', '', '.wasm')) k(kind, pre, post)""",
        "json_urls": """SELECT event_id::VARCHAR AS file, unnest(['/events/' || event_type, 'https://h.example/' || user_id]) AS ref FROM events""",
        "keyed_urls": """WITH u AS (SELECT page_id, html, regexp_replace(url, '[?#].*$', '') || '?lang=x&key=K-' || page_id AS v FROM pages)
            SELECT page_id::VARCHAR AS file, 'keyed-url' AS rule_name, v AS value, length(html) + 10 AS index_start, length(html) + 10 + length(v) AS index_end FROM u""",
    }
    return out
