"""Candidate filters over hits: keys, placeholders, entropy, patterns, words, similar strings."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.similarity import similar_udf
from sluice.functions.text import before, contains_any, count_contained, entropy
from sluice.operators.rules import CATALOGUE, Rule

#: Offsets of a bin of the join of touching hits.
BIN = 1024
#: Up to so many dictionary words are ranked on the driver and broadcast.
MAX_WORDS = 1_000_000
#: Fixed values that results depend on: word lists of the filters.
VALUE_PLACEHOLDERS = ["changeit", "changeme", "change", "guest", "printf", "return", "test", "user", "pass", "password", "username", "secret", "test",
                      "bar", "foobar", "api_secret", "token", "pwd", "password", "apikey", "parola", "parolan", "wachtwoord", "salasana", "pasahitza",
                      "boolean", "lozinka", "before", "blahblah"]
MATCH_PLACEHOLDERS = ["templateid:", "@tmp", "@example", "example", "@test", "@hostname", "test:test", "example.com", "@somewhere", "_key", "@url",
                      "hello:world@", "****@localhost", "127.0.0.1:443@"]
MACHINE_VALUES = ["ca-pub-"]
KEY_LEFT = ["publickey", "public", "fake", "input", "put", "enter", "invalid"]
KEY_RIGHT = ["oid", "author", "hash", "fingerprint", "keyword", "checksum", "addr", "type", "id"]
WHOLE_KEYS = ["formkey", "?key", " h1", "gpg key", "sapagekey", "pubkey", "key_hex", "fake_", "password_label", "password_action", "password_msg",
              "git-tree", "_id", " id", "sha256", "-sha", "sha1", " h1", "keyword", "apiusername", "publickey", "public", ".js", ".py", ".yaml",
              "_type", "_addr", ".txt"]
FORM_KEYS = ["hubspotformid", "hubspot_formid", "formid", "form_id", "hubspotportal", "portal", "hubspotpageid", "pageid"]
JWT_TRACKING = ["org.tracking", "org.analytics", "tracking", "analytics", "org.sentry", "bugsnag", "rollbar", "datadog"]
JWT_SCOPES = ["org.tracking", "org.analytics", "org.tracker", "tracking", "analytics", "client_id", "client_secret", "oauth", "scopes", "scope"]
FILE_ENDINGS = [".js", ".py", ".java", ".go", ".json", ".yaml", ".xml", ".html", ".css", ".txt", ".md", ".png", ".jpg"]


def sequence_patterns() -> list[str]:
    """Runs that no random secret holds: four equal or consecutive characters, up or down, and a few marks."""
    out = []
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
        for i, c in enumerate(alphabet):
            out.append(c * 4)
            if i + 4 <= len(alphabet):
                out += [alphabet[i:i + 4], alphabet[i:i + 4][::-1]]
    return [*out, "====", "@@@@", "####", "****", "------", "..."]


def chunked_entropy(hits: DataFrame) -> DataFrame:
    """Machine values of even randomness: below 30 characters entropy 2.4, else 3 in each of floor(n / 30) chunks. [F9]

    The last chunk takes the rest. Human rules and private keys pass.
    """
    n = F.length("value")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 30).cast("int"))), lambda k: F.substr(
        "value", (k - 1) * 30 + 1, F.when(k == F.floor(n / 30), n).otherwise(F.lit(30)).cast("int")))
    low = F.when(n < 30, entropy(F.col("value")) < 2.4).otherwise(F.exists(chunks, lambda c: entropy(c) < 3))
    return hits.where((F.col("is_mechanical") == "human") | (F.col("series") == "private") | ~low)


def _exempt(rule: Rule) -> str:
    return "" if rule.rule_name == "generic-api-key" else rule.regex


def drop_patterns(hits: DataFrame, rules: tuple[Rule, ...] = CATALOGUE, patterns: list[str] | None = None) -> DataFrame:
    """Without machine values that hold a pattern their rule's own regex does not. [F10]"""
    found = patterns or sequence_patterns()
    bad = F.lit(False)
    for rule in rules:
        own = _exempt(rule).lower()
        bad = bad | ((F.col("rule_name") == rule.rule_name) & contains_any(F.col("value"), [p for p in found if p.lower() not in own]))
    return hits.where((F.col("is_mechanical") == "human") | ~bad)


def drop_versions(hits: DataFrame) -> DataFrame:
    """Without machine values that start like a version. [F11]"""
    return hits.where((F.col("is_mechanical") == "human") | ~F.rlike("value", F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+")))


def segment(word: str, costs: dict[str, float], longest: int) -> list[str]:
    """The split of ``word`` of least cost; a character that starts no known word costs more than any. [F14]"""
    best, cut = [0.0], [0]
    lower = word.lower()
    for end in range(1, len(word) + 1):
        options = ((best[start] + costs.get(lower[start:end], math.inf if end - start > 1 else 1e3), -start) for start in range(max(0, end - longest), end))
        cost, start = min(options)
        best.append(cost)
        cut.append(-start)
    out, end = [], len(word)
    while end:
        out.append(word[cut[end]:end])
        end = cut[end]
    return out[::-1]


_ready: dict[int, tuple[dict[str, float], int]] = {}


def _segmenter(words: list[str], known_only: bool = False):
    """A UDF from a value to its tokens, or to those that are words; the ranked words are broadcast."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(values: pd.Series) -> pd.Series:
        key = id(shared.value)
        if key not in _ready:
            _ready.clear()
            _ready[key] = ({w: math.log((k + 1) * math.log(len(shared.value) + 2)) for k, w in enumerate(shared.value)}, max(map(len, shared.value), default=1))
        costs, longest = _ready[key]

        def one(value: str | None) -> list[str]:
            out: list[str] = []
            for token in filter(None, re.split(r"[._(){}\-#@$%^&*]", value or "")):
                if token not in costs and len(token) > 3:
                    out += [p for p in segment(token, costs, longest) if len(p) > 2]
                else:
                    out.append(token)
            return [t for t in out if t.lower() in costs] if known_only else out

        return values.map(one)

    return split


def word_tokens(hits: DataFrame, words: list[str]) -> DataFrame:
    """``hits`` with ``tokens``: the value cut at marks, unknown parts segmented by the ranked ``words``. [F14]"""
    return hits.withColumn("tokens", _segmenter(words)(F.col("value")))


def drop_words(hits: DataFrame, words: list[str], rules: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """Without machine values made of dictionary words. [F12]

    Up to 30 characters one word of more than four letters is enough, up to 60 two
    different ones; at any length words may be at most 35 % of the value. Words in
    the rule's own regex do not count.
    """
    regex = F.lit("")
    for rule in rules:
        regex = F.when(F.col("rule_name") == rule.rule_name, F.lit(_exempt(rule).lower())).otherwise(regex)
    told = hits.withColumn("__regex", regex).withColumn("__found", _segmenter(words, known_only=True)(F.col("value")))
    told = told.withColumn("__found", F.filter("__found", lambda t: ~F.contains(F.col("__regex"), F.lower(t))))
    long = F.size(F.filter(F.array_distinct("__found"), lambda t: F.length(t) > 4))
    weight = F.aggregate("__found", F.lit(0), lambda a, t: a + F.length(t))
    n = F.length("value")
    meaning = ((n <= 30) & (long >= 1)) | ((n > 30) & (n <= 60) & (long >= 2)) | (weight / n > 0.35)
    return told.where((F.col("is_mechanical") == "human") | ~meaning).drop("__regex", "__found")


def _key() -> Column:
    return F.regexp_replace(before(F.col("match"), F.col("value")), "[^a-zA-Z]*$", "")


def _harmless_token(payload: Column) -> Column:
    """Whether a token's claims say that it only tracks: by a word anywhere, in its scopes or in its roles. [F2]"""
    field = lambda n: F.get_json_object(payload, f"$.{n}")
    unset = lambda c: c.isNull() | c.isin("", "0", "false", "[]", "{}")
    scope = F.lower(F.when(~unset(field("scope")), field("scope")).otherwise(F.coalesce(field("scopes"), F.lit(""))))
    roles = F.when(F.startswith(field("roles"), F.lit("[")), F.from_json(field("roles"), "array<string>"))
    named = contains_any(F.lower(F.array_join(roles, " ")), JWT_SCOPES) | F.exists(roles, lambda r: F.startswith(r, F.lit("org.")))
    return F.json_object_keys(payload).isNotNull() & (contains_any(F.lower(payload), JWT_TRACKING) | contains_any(scope, JWT_SCOPES) | F.coalesce(named, F.lit(False)))


def key_filter(hits: DataFrame, learned: tuple[str, ...] = ()) -> DataFrame:
    """The key-value filter: keys that name no secret, form ids, tracking tokens, placeholders. [F1-F7]

    ``learned`` are further words that end the keys of harmless values, as read by
    ``readers.suffixes``.
    """
    lower, key = F.lower("rule_name"), _key()
    words = F.transform(F.filter(F.split(key, "[._-]"), lambda w: F.length(w) >= 2), lambda w: F.lower(F.rtrim(w)))
    middle = F.translate(F.split_part("value", F.lit("."), F.lit(2)), "-_", "+/")
    claims = F.try_validate_utf8(F.try_to_binary(F.concat(middle, F.repeat(F.lit("="), F.pmod(-F.length(middle), F.lit(4)))), F.lit("base64")).cast("string"))
    tracking = F.contains(lower, F.lit("jwt")) & (F.size(F.split("value", r"\.", -1)) == 3) & F.coalesce(_harmless_token(claims), F.lit(False))
    form = F.contains(lower, F.lit("hubspot")) & F.exists(F.array(*[F.lit(x) for x in FORM_KEYS]), lambda p: F.startswith(
        F.regexp_replace(F.lower(before(F.col("match"), F.col("value"))), r'[\s_\-.:\\"]+', ""), F.regexp_replace(p, "_", "")))
    ending = F.exists(F.array(*[F.lit(x) for x in FILE_ENDINGS]), lambda e: F.endswith(key, e))
    listed = F.arrays_overlap(words, F.array(*[F.lit(x.lower()) for x in [*KEY_LEFT, *KEY_RIGHT, *learned]])) | contains_any(F.lower(key), WHOLE_KEYS)
    keyed = F.col("need_keyvalue") & (F.col("match") != F.col("value"))
    bad_key = keyed & (ending | listed | contains_any(F.lower("value"), MACHINE_VALUES))
    plain = ~F.col("need_keyvalue") & (F.col("match") != F.col("value")) & ~F.rlike("rule_name", F.lit("password|Jdbc|Uri|jwt")) & ending
    placeholders = count_contained(F.lower("value"), VALUE_PLACEHOLDERS) + count_contained(F.lower("match"), MATCH_PLACEHOLDERS)
    human = (F.col("is_mechanical") == "human") & (placeholders >= F.when(F.rlike("rule_name", F.lit("password|Jdbc|Uri")), 1).otherwise(2))
    return hits.where(~(tracking | form | bad_key | plain | human))


def merge_similar(hits: DataFrame, width: int = BIN) -> DataFrame:
    """One of every two similar hits that touch in a file. [F18]

    Pairs are in ``ord`` order. Same value and start: a generic later one goes, else
    the earlier. Touching spans with similar values: a generic earlier one goes, else
    the later. Of two touching hits the one that starts later starts within the other
    or at its end, so the join is by (file, bin of ``width`` offsets): the hits of one
    huge file meet only near ones.
    """
    points = hits.withColumn("__bin", F.floor(F.col("index_start") / width)).alias("p")
    covers = hits.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("index_start") / width), F.floor(F.col("index_end") / width)))).alias("c")
    earlier = (F.col("c.index_start") < F.col("p.index_start")) | ((F.col("c.index_start") == F.col("p.index_start")) & (F.col("c.ord") < F.col("p.ord")))
    met = points.join(covers, (F.col("p.file") == F.col("c.file")) & (F.col("p.__bin") == F.col("c.__bin")) & earlier & (F.col("p.index_start") <= F.col("c.index_end")))
    side = lambda a: F.struct(f"{a}.ord", f"{a}.value", f"{a}.index_start", F.contains(f"{a}.rule_name", F.lit("generic")).alias("generic"))
    first, second = F.least(side("p"), side("c")).alias("i"), F.greatest(side("p"), side("c")).alias("j")
    pairs = met.where(F.col("p.ord") != F.col("c.ord")).select(F.col("p.file").alias("file"), first, second)
    same = F.col("i.value").eqNullSafe(F.col("j.value")) & (F.col("i.index_start") == F.col("j.index_start"))
    equal = pairs.where(same).select("file", F.when(F.col("j.generic"), F.col("j.ord")).otherwise(F.col("i.ord")).alias("ord"))
    alike = pairs.where(~same).where(similar_udf("i.value", "j.value")).select("file", F.when(F.col("i.generic"), F.col("i.ord")).otherwise(F.col("j.ord")).alias("ord"))
    return hits.join(equal.union(alike).distinct(), ["file", "ord"], "left_anti").select(*hits.columns)


def password_class(value: Column) -> Column:
    """0 not a password, 1 weak, 2 strong: a documented stand-in for trained weights. [F15, F16]

    0: under 4 characters, white space inside, or code marks; 2: eight characters
    with three character classes or entropy 3; else 1.
    """
    kinds = sum((F.rlike(value, F.lit(p)).cast("int") for p in ("[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.rlike(value, F.lit("[a-z]")).cast("int"))
    none = (F.length(value) < 4) | F.rlike(value, F.lit(r"\s|[(){};]"))
    return F.when(none, 0).when((F.length(value) >= 8) & ((kinds >= 3) | (entropy(value) >= 3)), 2).otherwise(1)


def drop_non_passwords(hits: DataFrame) -> DataFrame:
    """Without values of password rules that are no passwords; other rules pass. [F15, F19]"""
    return hits.where(~F.contains(F.lower("rule_name"), F.lit("pass")) | (password_class(F.substr("value", F.lit(1), F.lit(30))) > 0))


def pattern_word_filter(hits: DataFrame, words: list[str], rules: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """Entropy, patterns, versions, words, in that order. [F8]"""
    return drop_words(drop_versions(drop_patterns(chunked_entropy(hits), rules)), words, rules)


def ranked_words(texts: DataFrame, column: str, least: int = 1) -> list[str]:
    """All words that ``least`` texts or more hold, by that number, then name: the corpus as its own dictionary.

    The list goes to the driver and to every worker, so its size is checked: more than
    MAX_WORDS words are an error that asks for a greater ``least``, never a cut.
    """
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = counted.orderBy(F.col("n").desc(), "word").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words; ask for words of more than {least} texts")
    return [r.word for r in rows]


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, n_hits) of each stage of a filter chain. [F20]"""
    from functools import reduce

    return reduce(DataFrame.union, [df.select(F.lit(name).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n_hits")) for name, df in stages])


