"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, chat, decon, neardup, pii, quality, rans, suffix, tokens, unigram, urls
from sluice.staging import new_path, spread, stage

#: The url rules of the contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

TOKENIZER, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 2
PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).drop("url")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stage(pii.candidates(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text"), "pii")
    spans = pii.accept(found, pii.fit(found))
    base = {k: F.filter(f"c_{k}", lambda x: x["base"]) for k in pii.BASE_KINDS}
    every = sum((F.size(f"c_{k}") for k in pii.KINDS[1:]), F.size(f"c_{pii.KINDS[0]}"))
    return spans.select(
        "doc_id", *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed({k: F.col(f"c_{k}") for k in pii.KINDS}).alias("spans"), every.cast("long").alias("n_spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return quality.apply_rules(docs, carry=["doc_id"]).select("doc_id", *quality.MEASURES, "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
again AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 8)) AS p FROM windows w JOIN again a ON a.doc_id = w.doc_id AND a.win = w.win)
  GROUP BY doc_id),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN dup_lines l USING (doc_id)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         coalesce(n_symbols > 0.5 * n_words OR n_dup_lines > 0.1 * n_words
           OR (n_words > 0 AND (word_chars < 2.0 * n_words OR word_chars > 12.0 * n_words)), false) AS soft
  FROM m),
h AS (SELECT source, count(*) AS n, sum((base_failed OR soft)::INT)::DOUBLE AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(bad) / sum(n) AS mean, avg(bad / n) AS rate, avg((bad / n) * (bad / n)) AS square, avg(1.0 / n) AS inverse FROM h),
w AS (SELECT mean, square - 2 * mean * rate + mean * mean - mean * (1 - mean) * inverse AS var FROM p),
k AS (SELECT mean, least(100.0, greatest(1.0, CASE WHEN var > 0 THEN mean * (1 - mean) / var - 1 ELSE 100.0 END)) AS weight FROM w),
r AS (SELECT source, mean, n + weight AS size, (bad + mean * weight) / (n + weight) AS rate FROM h, k),
v AS (SELECT source, rate - 0.8416212335729143 * sqrt(rate * (1 - rate) / (size + 1)) > mean AS rejected FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (coalesce(rejected, false) AND soft)) AS kept
FROM f LEFT JOIN v USING (source)
"""


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), unigram.vocabulary_of(PIECES)).drop("text")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rans.in_id_order(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    ids = tokens.encode(docs, TOKENIZER, "value", "ids", END_ID, width=2, counts_col="counts").drop("value")
    path = new_path(spark, "files")
    rans.write(rans.placed(ids), path, width=2)
    return rans.read(spark, path).select(
        F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.find(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS g, len(w) - 4 AS size FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
i AS (SELECT item_id, n, g, count(*) AS c FROM
       (SELECT item_id, len(w) AS n, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS p FROM b WHERE len(w) >= 5))
      GROUP BY item_id, n, g),
hits AS (SELECT s.doc_id, i.item_id, s.p, s.g, i.c, i.n, i.n - 4 AS m, s.size FROM s JOIN i USING (g)),
pairs AS (SELECT doc_id, item_id, n, m, size, min(p) AS lo, max(p) AS hi FROM hits GROUP BY doc_id, item_id, n, m, size HAVING 4 * count(*) >= 3 * least(m, size)),
starts AS (SELECT doc_id, item_id, n, m, size, unnest(range(greatest(0, lo - m), greatest(0, least(hi, size - m)) + 1)) AS st FROM pairs),
common AS (
  SELECT doc_id, item_id, n, m, size, st, sum(least(k, c))::BIGINT AS n_common
  FROM (SELECT t.doc_id, t.item_id, t.n, t.m, t.size, t.st, h.g, h.c, count(*) AS k
        FROM starts t JOIN hits h ON h.doc_id = t.doc_id AND h.item_id = t.item_id AND h.p >= t.st AND h.p < t.st + t.m
        GROUP BY t.doc_id, t.item_id, t.n, t.m, t.size, t.st, h.g, h.c)
  GROUP BY doc_id, item_id, n, m, size, st),
good AS (SELECT *, least(m, size) + m - n_common AS u FROM common WHERE 4 * n_common >= 3 * (least(m, size) + m - n_common)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_common DESC, st DESC) AS k FROM good)
SELECT doc_id, item_id, st::BIGINT AS start_word, n::BIGINT AS n_words, n_common, n_common::DOUBLE / u::DOUBLE AS similarity FROM ranked WHERE k = 1
"""


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


OP10_SQL = r"""
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations),
cells AS (SELECT *, pos || ':' || coalesce('r' || length(role) || role, '-') || coalesce('t' || length(text) || text, '-') AS cell FROM placed),
rolled AS (SELECT conv_id, pos, string_agg(cell, '') OVER (PARTITION BY conv_id ORDER BY pos) AS h FROM cells),
ends AS (SELECT conv_id, max(pos) AS pos, max_by(h, pos) AS h FROM rolled GROUP BY conv_id),
firsts AS (SELECT pos, h, min(conv_id) AS conv_id, count(*) AS n_same FROM ends GROUP BY pos, h),
longer AS (SELECT DISTINCT r.pos, r.h FROM rolled r JOIN ends e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.pos > r.pos),
kept AS (SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM longer l WHERE l.pos = f.pos AND l.h = f.h))
SELECT k.conv_id, k.pos AS n_turns, k.n_same,
       string_agg('<|' || coalesce(p.role, '') || '|>' || chr(10) || coalesce(p.text, '') || '<|end|>' || chr(10), '' ORDER BY p.pos) AS rendered
FROM kept k JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.pos, k.n_same
"""


def queries() -> dict:
    return {"op1_url_filters": op1_url_filters, "op2_pii": op2_pii, "op3_quality_rules": op3_quality_rules, "op4_suffix_array_dedup": op4_suffix_array_dedup,
            "op5_token_counts": op5_token_counts, "op6_minhash_near_dedup": op6_minhash_near_dedup, "op7_byte_bpe": op7_byte_bpe,
            "op8_token_files": op8_token_files,
            "op9_benchmark_decontamination": op9_benchmark_decontamination, "op10_chat_formatting": op10_chat_formatting}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_quality_rules": OP3_SQL, "op9_benchmark_decontamination": OP9_SQL, "op10_chat_formatting": OP10_SQL}
