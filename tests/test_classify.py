"""Decisions of both classifiers, one row each, and their order."""

import base64
import json

import pytest

from sluice.operators import classify_v1, classify_v2, vector
from sluice.operators.cascade import Decision

NOW = 1_700_000_000
COLUMNS = "file string, rule_name string, series string, value string, match string, variable_name string"


def token(payload, header=None):
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{enc(header or {'alg': 'RS256'})}.{enc(payload)}.c2ln"


RANDOM = "Zk3-9Qf7Lw2Xp8Rt5Vb1Nc"
CASES = [
    (("f.js", "generic-api-key", "generic", "ghp_" + "a1B2" * 9, "x", ""), "Critical", "github_token"),
    (("f.js", "generic-api-key", "generic", "AIzaSyA-1234567890abcdefghij_klmnopqrs", "x", ""), "Potential", "google_api_key"),
    (("f.js", "generic-api-key", "generic", "sk_live_" + "4eC39HqLyjWD", "x", ""), "Critical", "live_payment_key"),
    (("f", "generic-api-key", "generic", "0123456789abcdef0123456789abcdef", "x", ""), "FalsePositive", "hex_digest"),
    (("f", "generic-api-key", "generic", RANDOM, f'client_secret = "{RANDOM}"', "client_secret"), "Critical", "direct_secret"),
    (("f", "generic-api-key", "generic", "123E4567-E89B-12D3-A456-426614174000", "x", ""), "FalsePositive", "uuid"),
    (("f", "generic-api-key", "generic", "user@example.com", "x", ""), "FalsePositive", "obvious_noise"),
    (("f", "generic-api-key", "generic", RANDOM, "csrf_token", "zz"), "FalsePositive", "csrf_token"),
    (("f", "generic-api-key", "generic", RANDOM, "x", "writekey"), "Potential", "public_sdk_key"),
    (("f", "generic-api-key", "generic", RANDOM, "x", "dummy_key"), "FalsePositive", "noise_name"),
    (("f", "generic-api-key", "generic", RANDOM, "x", "q1"), "PendingVector", "generic_pending"),
    (("f", "Uri", "uri", "pw8Q", "https://u:pw8Q@h", ""), "Potential", "uri_credential"),
    (("f", "Uri", "uri", "pw8Q", "ftp://u:pw8Q@h", ""), "PendingVector", "uri_pending"),
    (("f", "Private Key", "private", "k", "k", ""), "Critical", "critical_rule"),
    (("f", "Algolia API Key", "algolia", "k", "k", ""), "Potential", "low_risk_rule"),
    (("f", "X", "aws", "k", "k", ""), "Critical", "critical_series"),
    (("f", "X", "posthog", "k", "k", ""), "Potential", "potential_series"),
    (("f", "X", "none", "k", "k", ""), "Unmatched", "unmatched"),
    (("f", "Wit API Key", "wit", "naturalword", "x", ""), "FalsePositive", "broad_rule_noise"),
]


def test_v2_decisions(spark):
    df = spark.createDataFrame([c[0] for c in CASES], COLUMNS)
    got = {(r.file, r.rule_name, r.series, r.value, r.match, r.variable_name): (r.risk, r.reason_code) for r in classify_v2.classify(df, NOW).collect()}
    for row, risk, code in CASES:
        assert got[row] == (risk, code), row


TOKENS = [
    (token({"a": 1}, {"alg": "none"}), "jwt_alg_none"), (token({"password": "x"}, {"alg": "HS256"}), "jwt_shared_secret"), (token({"iss": "https://github.com/x"}), "jwt_issuer"),
    (token({"client_id": "google_1"}), "jwt_app_id"), (token({"scope": "read write"}), "jwt_privilege"), (token({"exp": NOW - 1}), "jwt_expired"),
    (token({"exp": NOW + 8 * 86400}), "jwt_long_lived"), (token({"email": "x"}), "jwt_claims"), (token({"a": 1}), "jwt_default"), ("eyJ.x", "jwt_unreadable"), (token([1]), "jwt_unreadable"),
]


def test_v2_tokens(spark):
    df = spark.createDataFrame([("f", "jwt", "jwt", t, t, "") for t, _ in TOKENS], COLUMNS)
    got = {r.value: r.reason_code for r in classify_v2.classify_tokens(df, NOW).collect()}
    assert [got[t] for t, _ in TOKENS] == [c for _, c in TOKENS]


def test_order_is_kept(spark):
    codes = [d.code for d in classify_v2.refine()]
    assert len(codes) == len(set(codes)) == 54
    before = [("broad_rule_noise", "totp_secret"), ("direct_secret", "github_token"), ("definite_anchor", "obvious_noise"), ("public_sdk_key", "front_end_name"), ("zapier_hook", "uri_credential")]
    assert all(codes.index(a) < codes.index(b) for a, b in before)
    assert all(isinstance(d, Decision) for d in classify_v2.main_cascade(NOW))


V1 = [
    (("f", "Uri", "uri", "short", "m", ""), "FalsePositive", "uri_short"), (("f", "Uri", "uri", "products", "m", ""), "FalsePositive", "uri_word"),
    (("f", "X", "none", "k", "m", ""), "Critical", "provider_default"), (("f", "Lob API Key", "lob", "k", "m", ""), "Potential", "potential_rule"),
    (("f", "Posthog API Key", "posthog", "k", "m", ""), "FalsePositive", "front_end_rule"), (("f", "g", "generic", "AKIA" + "A1" * 8, "m", ""), "Critical", "format_5"),
    (("f", "g", "generic", RANDOM, f"masterKey: '{RANDOM}'", ""), "Critical", "critical_name"), (("f", "g", "generic", RANDOM, f"demoToken={RANDOM}", ""), "FalsePositive", "noise_name"),
    (("f", "g", "generic", "run(x)", "m", ""), "FalsePositive", "non_secret_value"), (("f", "g", "generic", RANDOM, f"zz = {RANDOM}", ""), "PendingVector", "pending"),
    (("f", "jwt", "jwt", token({"exp": NOW - 1}), "m", ""), "FalsePositive", "jwt_expired"), (("f", "jwt", "jwt", token({"iss": "auth0"}), "m", ""), "Critical", "jwt_issuer"),
]


def test_v1_decisions(spark):
    df = spark.createDataFrame([c[0] for c in V1], COLUMNS)
    got = {(r.rule_name, r.series, r.value, r.match): (r.risk_label, r.risk_reason) for r in classify_v1.classify(df, NOW).collect()}
    for row, risk, code in V1:
        assert got[(row[1], row[2], row[3], row[4])] == (risk, code), row


@pytest.mark.parametrize("block", [100_000, 3])
def test_nearest_and_ties(spark, block):
    kb = spark.createDataFrame([("b", [1.0, 0.0], "low", None), ("a", [2.0, 0.0], "high", None), ("c", [0.0, 1.0], "medium", None), ("n", None, "low", None), ("d", [0.0, 0.0], "low", None)], "id string, vector array<float>, risk_level string, service string")
    q = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 5.0]), (3, None)], "i int, vector array<float>")
    got = {r.i: (r.kb_id, round(r.score, 3)) for r in vector.nearest(q, kb, block=block).collect()}
    assert got[1] == ("a", 0.999) and got[2] == ("c", 1.0) and got[3] == (None, -1.0)


def test_nearest_refuses_other_dimensions(spark):
    kb = spark.createDataFrame([("a", [1.0, 0.0], "high", None)], "id string, vector array<float>, risk_level string, service string")
    with pytest.raises(Exception, match="dimensions"):
        vector.nearest(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "i int, vector array<float>"), kb).collect()


def test_labelled_v1_takes_the_neighbours_label(spark, monkeypatch):
    from sluice.plans import queries

    value = RANDOM + "Hd6" + RANDOM[::-1]
    rows = [("f", "g", "generic", value, f"masterKey: '{value}'", ""), ("f", "h", "generic", value, f"zz = {value}", "")]
    monkeypatch.setattr(queries, "_hits", lambda spark, d: spark.createDataFrame(rows, COLUMNS))
    assert {(r.rule_name, r.risk_label, r.n) for r in queries.labelled_v1(spark, "/root/testdata/sf0.001").collect()} == {("g", "Critical", 1), ("h", "Critical", 1)}


def test_whole_classifier(spark):
    hits = spark.createDataFrame([("f", "generic-api-key", "generic", RANDOM, "x", "q1"), ("f", "Private Key", "private", "k", "k", "")], COLUMNS)
    kb = spark.createDataFrame([], "id string, vector array<float>, risk_level string, service string")
    got = {r.rule_name: (r.risk, r.reason_code) for r in vector.classify_with_kb(hits, kb, NOW).collect()}
    assert got == {"generic-api-key": ("Potential", "no_vector"), "Private Key": ("Critical", "critical_rule")}


def test_descriptor(spark):
    from pyspark.sql import functions as F

    d = spark.range(1).select(vector.describe(F.lit("ghp_aB1-")).alias("d")).first().d
    assert (d.length, d.prefix, d.charset) == (8, "ghp_", "LowerAlpha + _ + UpperAlpha + Digit + -")
