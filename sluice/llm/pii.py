"""Personal data by weak supervision, in DataFrame functions only.

Candidates of five kinds come from regular expressions: what the base rules match,
passing or not, and further forms (written-out addresses, numbers within longer runs
of digits, numbers without a country code, quoted values after a key). On each
candidate three labelers vote for (1), against (2) or abstain (0), whatever the base
rules say of it: a regular-expression labeler (strict form, check digits, grouping), a
gazetteer labeler (top-level domains, address ranges, issuers, dialling codes, token
prefixes) and a context labeler (words in the CONTEXT code points before the span).
The votes and three bits of shape form a small integer code. Counts by (kind, code),
at most 5 x 216 rows whatever the input's size, go to the driver, where
expectation-maximisation estimates every labeler's reliability without labels, and its
posteriors train a logistic span classifier over votes and shape, which then accepts
or refuses each code. Base spans always stay; accepted candidates that touch none are
added. Of candidates of a kind that overlap, a further form goes before a match that
fails its base rule.

Positions are code points, ends exclusive. Defined cases: null text counts as
empty; spans of one kind never overlap and are taken leftmost first; repeated rows and
rows with a null id are judged one by one; texts of any length are read whole; output
columns replace input columns of their names; an empty table gives an empty one and a
model that adds nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.staging import stage

#: The kinds with base rules, and all kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
CONTEXT = 40
#: A code is accepted at this probability.
ACCEPT = 0.9

_LOCAL = "A-Za-z0-9._%+-"
#: The base rules. A match may start where the last one ended, else only at the start of a run,
#: which is where a leftmost match starts anyway; runs are possessive, so time stays linear.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the base rule to be tried.
GUARD = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Further forms, and what a text must match for them to be tried.
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": (r"(?<![0-9+])\+[1-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"
              r"|(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    "secret": r"""(?<=[=:]\x20{0,2}["'])[A-Za-z0-9_+/-]{16,128}(?=["'])""",
}
LOOSE_GUARD = {"email": r"[\[(]at[\])]", "card": r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9])", "phone": r"[0-9]{3}[\x20.-]?[0-9]{4}",
               "secret": r"""[=:]\x20{0,2}["'][A-Za-z0-9_+/-]{16}"""}
_AT, _DOT = r"(?:@|\x20?[\[(]at[\])]\x20?)", r"(?:\.|\x20?[\[(]dot[\])]\x20?)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: The regular-expression labeler: forms that speak for a value, and against it.
FORM = {
    "email": (rf"^[A-Za-z0-9]+(?:[._%+-][A-Za-z0-9]+)*{_AT}(?:[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*{_DOT})+[A-Za-z]{{2,24}}$", r"\.\.|[0-9-]$"),
    "ip": (rf"^(?:{_OCTET}\.){{3}}{_OCTET}$", r"(?<![0-9])0*(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[1-9][0-9]{3,})"),
    "card": (r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$", r"^$"),
    "phone": (r"^(?:\+[1-9][0-9]{0,2}(?:[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,5}|\(?[2-9][0-9]{2}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4})$", r"^\+0|(?:[0-9][^0-9]*){16}"),
    "secret": (r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9]).{20,})$", r"^[A-Za-z_/-]+$"),
}
#: The gazetteer labeler's entries for and against, and the context labeler's words.
GAZETTEER = {
    "email": (r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|eu|us)$", r"(?i)\.(?:png|jpe?g|gif|svg|css|js|py|html?)$"),
    "ip": (r"^(?!0|255\.|127\.|22[4-9]\.|2[34][0-9]\.)[0-9]{2,3}\.|^[1-9]\.[0-9]+\.[0-9]*[0-9]{2}", r"^(?:0|255|127)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", r"^[01789]"),
    "phone": (r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})", r"^\(?[01]"),
    "secret": (r"^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk_live_|sk_test_|rk_live_|xox[abprs]-|eyJ|hf_|npm_)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
               r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"),
}
WORDS = {
    "email": (r"mail|contact|write to|reach", r"example:|decorator|regex"),
    "ip": (r"\bip\b|address|host|server|client", r"version|release|section|v\.?$"),
    "card": (r"card|visa|credit|payment|iban", r"order|isbn|serial|invoice|token|hash|\bid\b"),
    "phone": (r"phone|call|tel\b|tel\.|mobile|fax|whatsapp", r"order|isbn|serial|section|version"),
    "secret": (r"(?:token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)[a-z_\x20-]{0,16}[\"']?\x20{0,2}[=:][\x20\"']{0,3}$",
               r"(?:\bid|class|href|src|name|style|type|sha[0-9]*|hash|checksum|integrity|commit|rev)[\"']?\x20{0,2}[=:][\x20\"']{0,3}$"),
}
#: Three bits of shape of each kind.
SHAPES = {
    "email": (r"[0-9]", r"[%+]", r"\..*\.[A-Za-z]+$"), "ip": (r"(?:^|\.)0[0-9]", r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", r"[0-9]{3}"),
    "card": (r"[\x20-]", r"^(?:[^0-9]*[0-9]){15,16}[^0-9]*$", r"(.)\1{5}"), "phone": (r"^\+", r"[()]", r"^(?:[^0-9]*[0-9]){10,12}[^0-9]*$"),
    "secret": (r"^[0-9a-f]+$", r"^.{32,}$", r"[A-Z].*[a-z]|[a-z].*[A-Z]"),
}
_TAG = {k: f"[{k.upper()}]" for k in KINDS}
VOTES, LABELERS, BITS = 3, 3, 3
#: Longer matches are no such value: their form and gazetteer votes are against, their shape bits 0, and no
#: labeler's pattern, which may recurse, is tried on them.
LONGEST = 320


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """(start, end, value) of each match, from the lengths of the matches and of the gaps between them."""
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(found, lambda m: m).alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    begin = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.aggregate(steps, begin, lambda done, x: F.concat(done, F.array(F.struct(
        (F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1)["end"], F.lit(0)) + F.length(x["g"])).cast("long").alias("start"),
        (F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1)["end"], F.lit(0)) + F.length(x["g"]) + F.length(x["m"])).cast("long").alias("end"),
        x["m"].alias("value")))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(
        (n - i) % 2 == 1, F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 2 * F.substr(digits, i, F.lit(1)).cast("int") - 9)
        .otherwise(2 * F.substr(digits, i, F.lit(1)).cast("int"))).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _strict(kind: str, value: Column) -> Column:
    """What the base rule asks of its match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.rlike(value, F.lit(rf"^(?:{part}\.){{3}}{part}$"))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(9, 15)


def _vote(value: Column, patterns: tuple[str, str]) -> Column:
    return F.when(F.rlike(value, F.lit(patterns[0])), 1).when(F.rlike(value, F.lit(patterns[1])), 2).otherwise(0)


def _described(kind: str, text: Column, spans: Column, strict: bool) -> Column:
    """(start, end, base, code) of each span."""

    def one(x: Column) -> Column:
        value = x["value"]
        before = F.lower(F.substr(text, F.greatest(x["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(x["start"], F.lit(CONTEXT)).cast("int")))
        long = F.length(value) > LONGEST
        form = _vote(value, FORM[kind])
        if kind == "card":
            form = F.when(~luhn(_digits(value)), 2).otherwise(form)
        bare = F.regexp_replace(value, r"[\x20-]", "") if kind == "card" else value
        votes = [F.when(long, 2).otherwise(form), F.when(long, 2).otherwise(_vote(bare, GAZETTEER[kind])), _vote(before, WORDS[kind])]
        bits = [F.when(long, 0).otherwise(F.rlike(value, F.lit(p)).cast("int")) for p in SHAPES[kind]]
        code = reduce(lambda c, b: c * 2 + b, bits, reduce(lambda c, v: c * VOTES + v, votes, F.lit(0)))
        base = _strict(kind, value) if strict else F.lit(False)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), code.cast("int").alias("code"))

    return F.transform(spans, one)


_SPANS = "array<struct<start:bigint,end:bigint,base:boolean,code:int>>"


def _apart(spans: str):
    """A test whether a span overlaps none of the column ``spans``."""
    return lambda x: ~F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with an array ``c_<kind>`` of (start, end, base, code) for each kind, by start."""
    none = F.array().cast(_SPANS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df
    for kind in BASE_KINDS:
        tried = F.contains(text, F.lit(GUARD[kind])) if GUARD[kind] else F.lit(True)
        found = _matches(text, BASE[kind])
        if kind == "card":  # short numbers are no candidates
            found = F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), found)
        out = out.withColumn(f"__m_{kind}", F.when(tried, found))
        placed = _placed(text, F.col(f"__m_{kind}"), BASE[kind])
        if kind == "card":
            placed = F.filter(placed, lambda x: F.length(_digits(x["value"])) >= 13)
        out = out.withColumn(f"__b_{kind}", F.when(F.size(f"__m_{kind}") > 0, placed))
        out = out.withColumn(f"c_{kind}", F.coalesce(F.when(F.size(f"__b_{kind}") > 0, _described(kind, text, F.col(f"__b_{kind}"), True)), none))
    out = out.withColumn("__base", F.flatten(F.array(*[F.filter(f"c_{k}", lambda x: x["base"]) for k in BASE_KINDS])))
    free = _apart("__base")
    for kind in KINDS:
        known = F.col(f"c_{kind}") if kind in BASE_KINDS else none
        if kind in LOOSE:
            out = out.withColumn(f"__l_{kind}", F.when(F.rlike(text, F.lit(LOOSE_GUARD[kind])), _matches(text, LOOSE[kind])))
            out = out.withColumn(f"__q_{kind}", F.when(F.size(f"__l_{kind}") > 0, F.filter(_placed(text, F.col(f"__l_{kind}"), LOOSE[kind]), free)))
            out = out.withColumn(f"__p_{kind}", F.when(F.size(f"__q_{kind}") > 0, _described(kind, text, F.col(f"__q_{kind}"), False)))
            failing = F.filter(known, lambda x: x["base"] | _apart(f"__p_{kind}")(x))
            known = F.when(F.size(f"__p_{kind}") > 0, F.array_sort(F.concat(failing, f"__p_{kind}"))).otherwise(known)
        out = out.withColumn(f"c_{kind}", F.filter(known, lambda x: x["base"] | free(x)))
    return out.drop("__base", *[f"__{p}_{k}" for k in KINDS for p in "mblqp"])


def _features(code: int) -> tuple[list[int], list[int]]:
    """The votes and the shape bits of a code."""
    votes, bits = divmod(code, 1 << BITS)
    return [votes // VOTES ** (LABELERS - 1 - i) % VOTES for i in range(LABELERS)], [bits >> (BITS - 1 - i) & 1 for i in range(BITS)]


def expectation_maximisation(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], float, list[list[list[float]]]]:
    """Posterior of each code by its votes, the prior, and P(vote | class) of each labeler (class 0 is wrong, 1 is right).

    Counts start from one imagined candidate of each class on which every labeler votes
    for its class four times out of five, which names the classes and keeps rates off 0 and 1.
    """
    votes = {c: _features(c)[0] for c in counts}
    rates = [[[0.2, 0.16, 0.64], [0.2, 0.64, 0.16]] for _ in range(LABELERS)]
    start, prior, posterior = [[list(r) for r in lab] for lab in rates], 0.5, {}
    for _ in range(rounds):
        for c, v in votes.items():
            odds = [p * math.prod(rates[i][k][x] for i, x in enumerate(v)) for k, p in ((0, 1 - prior), (1, prior))]
            posterior[c] = odds[1] / sum(odds)
        total = sum(counts.values())
        prior = (1 + sum(n * posterior[c] for c, n in counts.items())) / (2 + total)
        for i in range(LABELERS):
            for k in (0, 1):
                cell = list(start[i][k])
                for c, n in counts.items():
                    cell[votes[c][i]] += n * (posterior[c] if k else 1 - posterior[c])
                rates[i][k] = [x / sum(cell) for x in cell]
    return posterior, prior, rates


def _vector(code: int) -> list[float]:
    """One-hot votes, shape bits and a constant."""
    votes, bits = _features(code)
    return [*[float(v == k) for v in votes for k in range(VOTES)], *map(float, bits), 1.0]


def train_classifier(counts: dict[int, int], posterior: dict[int, float], rounds: int = 200) -> list[float]:
    """Weights of a logistic model over votes and shape, fitted to the posteriors by gradient steps."""
    total = max(1, sum(counts.values()))
    rows = [(_vector(c), n / total, posterior[c]) for c, n in sorted(counts.items())]
    weights = [0.0] * (LABELERS * VOTES + BITS + 1)
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for x, n, p in rows:
            off = n * (1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x)))) - p)
            for j, v in enumerate(x):
                slope[j] += off * v
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def probability(weights: list[float], code: int) -> float:
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, _vector(code)))))


def model(counts: dict[str, dict[int, int]]) -> dict[str, list[int]]:
    """The codes accepted for each kind, from the candidates' counts by kind and code."""
    accepted = {}
    for kind in KINDS:
        seen = counts.get(kind, {})
        posterior, _, _ = expectation_maximisation(seen) if seen else ({}, 0.0, [])
        weights = train_classifier(seen, posterior) if seen else []
        accepted[kind] = sorted(c for c in seen if probability(weights, c) >= ACCEPT)
    return accepted


def fit(found: DataFrame) -> dict[str, list[int]]:
    """The codes accepted for each kind, from all candidates of a ``candidates`` table."""
    def coded(kind: str) -> Column:
        return F.transform(f"c_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["code"].alias("code")))

    each = [coded(k) for k in KINDS]
    counts: dict[str, dict[int, int]] = {}
    for r in found.select(F.inline(F.concat(*each))).groupBy("kind", "code").count().collect():
        counts.setdefault(r["kind"], {})[r["code"]] = r["count"]
    return model(counts)


def accept(found: DataFrame, accepted: dict[str, list[int]]) -> DataFrame:
    """A ``candidates`` table with only base spans and accepted ones left in the ``c_`` arrays."""
    def left(kind: str) -> Column:
        return F.filter(f"c_{kind}", lambda x: x["base"] | x["code"].isin(accepted[kind]))

    return found.withColumns({f"c_{k}": left(k) for k in KINDS})


def listed(kinds_of: dict[str, Column]) -> Column:
    """kind:start:end of every span, by kind, then start, comma-joined."""
    def shown(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*[shown(k, c) for k, c in kinds_of.items()]), ",")


def redact(df: DataFrame, text_col: str = "text", accepted: dict[str, list[int]] | None = None) -> DataFrame:
    """``df`` with every span of its text replaced by the tag of its kind, as ``[EMAIL]``.

    The candidates are found once, in a staged table. Spans of two kinds that overlap become the tag of the one that starts first
    (then of the longer). Null texts stay null.
    """
    found = stage(candidates(df, text_col), "candidates")
    found = accept(found, fit(found) if accepted is None else accepted)

    def tagged(kind: str) -> Column:
        return F.transform(f"c_{kind}", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(_TAG[kind]).alias("tag")))

    each, text = [tagged(k) for k in KINDS], F.col(text_col)
    spans = F.array_sort(F.concat(*each))
    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))
    cut = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    built = F.aggregate("__spans", begin, lambda s, x: F.when(
        x["start"] >= s["at"],
        F.struct(F.concat(s["parts"], F.array(cut(s["at"], x["start"]), x["tag"])).alias("parts"), (-x["back"]).alias("at")))
        .otherwise(F.struct(s["parts"].alias("parts"), F.greatest(s["at"], -x["back"]).alias("at"))),
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, (s["at"] + 1).cast("int"), F.greatest(F.length(text) - s["at"], F.lit(0)).cast("int"))))
    out = found.withColumn("__spans", spans).withColumn(text_col, F.when(F.size("__spans") > 0, built).otherwise(text))
    return out.select(*df.columns)
