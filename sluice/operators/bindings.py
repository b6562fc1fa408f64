"""Secrets bound to short names in minified scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import entropy, spans

# Fixed values that results depend on: property names and context words.
PROPERTY_NAMES = ["apiKey", "api_key", "apikey", "accessKey", "access_key", "accessToken", "access_token", "secretKey", "secret_key", "clientSecret",
                  "client_secret", "clientId", "client_id", "authToken", "auth_token", "privateKey", "private_key", "publishableKey", "token", "secret",
                  "password", "passwd", "credential", "credentials", "appKey", "app_key", "appSecret", "app_secret", "consumerKey", "consumer_key",
                  "consumerSecret", "consumer_secret", "signingKey", "signing_key"]
SDK = (r"(?i)initializeApp|firebase\.init|Stripe\s*\(|stripe\.init|Bugsnag\.start|Sentry\.init|amplitude\.init|mixpanel\.init|analytics\.init|braintree\.create"
       r"|paypal\.Buttons|pusher\s*=\s*new\s*Pusher|new\s*Pusher\s*\(|algolia\s*\(|algoliasearch\s*\(|mapboxgl\.accessToken|google\.maps|new\s*google\.maps")
HTTP = r"(?i)Authorization|X-API-Key|X-Api-Key|api[_-]?key|apikey|access[_-]?token|Bearer\s|api[_-]?secret|client[_-]?secret"
CRYPTO = r"(?i)hmac|HMAC|sha256|SHA256|md5\s*\(|MD5\s*\(|encrypt\s*\(|sign\s*\(|createHmac"
NOISE = r"(?i)split\s*\(|replace\s*\(|charCodeAt|charAt\s*\(|indexOf\s*\(|slice\s*\(|substring\s*\(|toLowerCase|toUpperCase|\.length|RegExp"

_DECLARED = r"""(?<![\w$.])([A-Za-z_$][\w$]{0,2})\s*=\s*(?:"([^"\\\n]{20,150})"|'([^'\\\n]{20,150})')"""
_USED = r"""(?<![\w$])["']?([A-Za-z_]+)["']?\s*:\s*([A-Za-z_$][\w$]{0,2})(?![\w$.(\["'])"""


def secret_like(value: Column) -> Column:
    """20 to 150 random characters, no alphabet, module name or action. [A2]"""
    return (F.length(value).between(20, 150) & (entropy(value) >= 4.5) & ~F.rlike(value, F.lit("^[A-Za-z]{20,}$")) & ~F.rlike(value, F.lit("__[A-Za-z0-9]{4,}$"))
            & ~F.rlike(value, F.lit("^[A-Z_]+/[A-Z_]+")))


def bindings(assets: DataFrame) -> DataFrame:
    """(file, prop_key, var_name, val, entropy): secret properties whose value is a short name bound to a secret. [A1]

    Declarations and uses are two relations of the scripts in (file, text), joined by
    file and name; of several declarations of a name the last counts.
    """
    found = F.transform(spans(F.col("text"), _DECLARED), lambda s: F.struct(
        F.regexp_extract(s["match"], _DECLARED.replace("(?<![\\w$.])", ""), 1).alias("var_name"),
        F.regexp_extract(s["match"], r"""["'](.*)["']$""", 1).alias("val"), s["start"].alias("at")))
    declared = assets.select("file", F.inline(found)).where(secret_like(F.col("val")))
    last = declared.groupBy("file", "var_name").agg(F.max_by("val", "at").alias("val"))
    keys = F.regexp_extract_all("text", F.lit(_USED), F.lit(0))
    plain = _USED.replace("(?<![\\w$])", "").replace("(?![\\w$.(\\[\"'])", "")
    used = assets.select("file", F.inline(F.transform(keys, lambda m: F.struct(F.regexp_extract(m, plain, 1).alias("prop_key"), F.regexp_extract(m, plain, 2).alias("var_name")))))
    return used.where(F.col("prop_key").isin(PROPERTY_NAMES)).join(last, ["file", "var_name"]).select("file", "prop_key", "var_name", "val", F.round(entropy(F.col("val")), 2).alias("entropy"))


_LOCAL = r"""(?:var|let|const)\s+([a-zA-Z$])\s*=\s*["']([^"']{20,150})["']"""


def local_secrets(assets: DataFrame) -> DataFrame:
    """(file, var, val, entropy, pos): one-letter names bound to random literals. [A3]"""
    found = F.transform(spans(F.col("text"), _LOCAL), lambda s: F.struct(
        F.regexp_extract(s["match"], _LOCAL, 1).alias("var"), F.regexp_extract(s["match"], _LOCAL, 2).alias("full"), s["start"].alias("pos")))
    each = assets.select("file", F.inline(found)).withColumn("bits", entropy(F.col("full"))).where("bits >= 4.5")
    return each.select("file", "var", F.left("full", F.lit(100)).alias("val"), F.round("bits", 2).alias("entropy"), "pos")


def value_class(v: Column) -> Column:
    """What a random-looking value probably is, first test that holds. [A4]"""
    bare = F.regexp_replace(v, "[^a-zA-Z0-9]", "")
    table = (F.length(bare) >= 30) & (F.size(F.array_distinct(F.split(bare, ""))) / F.length(bare) > 0.85)
    return (F.when(table, "charset_table").when(F.rlike(v, F.lit(r"^(/|\.\.?/|https?://|data:)")), "path_or_url").when(F.rlike(v, F.lit(r"[<>{}\s()]")), "code_or_markup")
            .when((F.length(v) <= 4_096) & F.rlike(v, F.lit(r"^[a-zA-Z][a-zA-Z0-9]*(-[a-zA-Z0-9]+){2,}(\.[a-z]+)?$")), "asset_id")
            .when(F.rlike(v, F.lit(r"^(sk_live_|sk_test_|pk_live_|pk_test_|AKIA[0-9A-Z]|AIzaSy|xox[abprs]-|SG\.[A-Za-z0-9]|ghp_|ya29\.|eyJ)")), "known_secret_format")
            .when(F.rlike(v, F.lit("^[0-9a-f]{32,64}$")), "hex_hash").when(F.rlike(v, F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")), "uuid")
            .when(F.rlike(v, F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+")), "version").otherwise("high_entropy_unknown"))


def context_signals(assets: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (file, var, val, entropy) with signal and context, where use of the value suggests a credential. [A5, A6]"""
    unknown = found.where(value_class(F.col("val")) == "high_entropy_unknown")
    at = F.position("val", "text")
    joined = unknown.join(assets.select("file", "text"), "file").withColumn("__at", at).where("__at > 0")
    # the name is that of the declaration next to the value, up to 200 characters before it
    from_ = F.greatest(F.col("__at") - 200, F.lit(1))
    near = F.substr("text", from_, F.col("__at") + F.length("val") + 10 - from_)
    declared = F.concat(F.lit(r"""(?:var|let|const)\s+([a-zA-Z$])\s*=\s*["']\Q"""), F.replace(F.left("val", F.lit(30)), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    joined = joined.withColumn("var", F.call_function("regexp_extract", near, declared, F.lit(1))).where("var <> ''")
    window = F.substr("text", F.col("__at"), F.lit(2000))
    has = {n: F.rlike(window, F.lit(p)) for n, p in (("SDK_INIT", SDK), ("HTTP_AUTH", HTTP), ("CRYPTO", CRYPTO))}
    usable = (has["SDK_INIT"] | has["HTTP_AUTH"] | has["CRYPTO"]) & ~(F.rlike(window, F.lit(NOISE)) & ~has["SDK_INIT"] & ~has["HTTP_AUTH"])
    start = F.greatest(F.col("__at") - 100, F.lit(1))
    snippet = F.left(F.replace(F.substr("text", start, F.col("__at") + 500 - start), F.lit("\n"), F.lit(" ")), F.lit(400))
    return joined.where(usable).select("file", "var", F.left("val", F.lit(80)).alias("val"), "entropy",
                                       F.array_join(F.array_compact(F.array(*[F.when(t, n) for n, t in has.items()])), ",").alias("signal"), snippet.alias("context"))
