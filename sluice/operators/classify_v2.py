"""The live classifier: an ordered rule cascade, then the nearest knowledge-base entry.

Columns of a hit that are not there (variable_name, embedding_context, context,
whole_secret_value) count as empty. ``now`` is a parameter, in seconds.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import contains_any
from sluice.operators.cascade import CRITICAL, NOISE, PENDING, POTENTIAL, UNMATCHED, Decision, decide

# Fixed values that results depend on: names of rules and series, variable names, prefixes and anchors.
CRITICAL_SERIES = ["private", "aws", "razorpay", "gcp", "hubspot", "toggltrack", "sumologic", "hive", "contentful", "zendesk", "sirv", "witnessai",
                   "zapier", "host", "onelogin", "grafana", "locationiq"]
POTENTIAL_SERIES = ["algolia", "posthog", "flickr"]
CRITICAL_RULES = ["Private Key", "private-key", "RSA Private Key", "PGP Private Key", "Elliptic Curve Private Key", "age secret key", "AWS API Secret",
                  "Google_YouTube_OAuth ID", "RazorPay API Secret", "Stripe API Key", "Stripe_Restricted API Key", "flutterwave-secret-key",
                  "flutterwave-encryption-key", "Checkout API Key", "HubSpot API Key", "hubspot-api-key", "Toggltrack API Key",
                  "Sumo Logic Access Token", "sumologic-access-token", "Hive API Key", "Sirv API Key", "Contentful API Personal Token",
                  "Zendesk API Token", "Zapier webhook", "Host API Key", "Onelogin OAuth Client Secret", "grafana-api-key", "Firebase API Key",
                  "firebase-api-key", "Flickr Access Token", "flickr-access-token"]
LOW_RISK_RULES = ["Algolia API Key", "Posthog API Key", "Posthog Analytics", "new-relic-browser-api-token", "Google_YouTube_API key", "Flickr API Key",
                  "Mapbox API Key", "mapbox-api-token", "LocationIQ API Key", "Contentful Delivery API Token", "contentful-delivery-api-token",
                  "lob-pub-api-key", "mailgun-pub-key", "PubnubPublish Key", "Pubnub Subscription Key", "Stripe_Standard API Key",
                  "flutterwave-public-key", "RazorPay API Key", "Razorpay API Key", "razorpay-api-key"]
OVERRIDE_RULES = ["Uri", "URL", "AWS API Secret", "RazorPay API Secret", "HubSpot API Key", "hubspot-api-key", "Toggltrack API Key", "Hive API Key",
                  "Zapier webhook", "jwt", "jwt-base64"]
BROAD_RULES = ["Abstract API", "atlassian-api-token", "Azure Client Secret", "Blogger API Key", "CloudFlare API Key", "CoinBase API Key",
               "Contentful API Personal Token", "CustomerIO API Key", "Datafire API Key", "Debounce API Key", "discord-client-secret", "Float API Key",
               "HereAPI Key", "Host API Key", "IBM API Key", "Ideogram-api-key", "Intercom API Key", "Jdbc Token", "Jira Token",
               "LessannoyingCRM API Key", "Mite API Key", "NasDaqdatalink API Key", "private-key", "ProspectCRM API Key", "Raven API Key",
               "sentry-access-token", "Shortcut API Key", "Sirv API Key", "twitter-api-key", "Usersecretscanner API Key", "Wit API Key", "Zendesk API Token"]
WORDLIKE_RULES = ["CustomerIO API Key", "Debounce API Key", "Host API Key", "Mite API Key", "Raven API Key", "Wit API Key"]
NOISE_NAMES = ["_token", "csrf", "csrftoken", "csrf_token", "csrf-token", "merchantkey", "localcachekey", "dtoken", "session_token", "auth0client",
               "yotpositekey", "convivacustomerkey", "sitekey", "vtoken", "sitetoken", "session", "sessiontoken", "acctoken", "dy", "playertoken",
               "pixel_token", "ltoken", "tdtoken", "bptoken", "sktoken", "fetchifytoken", "fetchify_token", "qf", "qftoken", "qf_token", "vrtoken",
               "vr_token", "sftoken", "encodedapikey"]
CONTEXT_NAMES = ["appkey", "app_key", "apikey", "api_key", "api-key", "api_token", "api_secret", "token", "key", "secret", "password", "passwd",
                 "access_token", "access-token", "auth_token", "auth-token", "refresh_token", "refresh-token", "client_id", "client_secret", "id_token",
                 "x_api_key", "x-api-key", "bearer", "bearer_token", "public_key", "private_key"]
PLACEHOLDER_NAMES = ["xxxx", "xxxxx", "xxxxxx", "test123", "dummy", "dummy_key", "dummy_token", "fake", "fake_key", "fake_token", "mock_key",
                     "mock_token", "example_key", "example_token", "example_api_key", "your_api_key", "your_key", "your_token", "your_secret",
                     "your_api_key_here", "insert_key_here", "paste_key_here", "your_key_here", "not_set", "set_api_key_here",
                     "replace_with_your_key", "change_me", "changeme", "changethis", "change_this", "use_your_key", "replace_with_key"]
PLACEHOLDER_PREFIXES = ["test_", "demo_", "sample_", "placeholder_", "dummy_", "fake_", "mock_", "example_", "your_"]
PLACEHOLDER_VALUES = ["API_KEY", "API_KEY_RANDOM", "CLOUDINARY_API_KEY", "ELASTICSEARCH_API_KEY", "INTENTIONALLY_BLANK_WRITE_KEY",
                      "REPLACE_WITH_SDK_KEY", "ZEP_API_KEY_RANDOM"]
ASSET_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".pdf", ".js", ".css", ".map", ".mjs"]
CODE_PARTS = ["${", "encodeURIComponent", "JSON.stringify", "JSON.parse", "function(", "=>", "...", ".concat(", "+encodeURIComponent", "window.",
              "document.", "console.log", "_0x", "(0x", "}=e.r(", "$export$", "=!1}={}"]
QUERY_KEYS = ["apikey=", "api_key=", "api-key=", "key=", "token=", "authkey=", "rlkey=", "client_secret=", "secret_key=", "secret=", "access_token="]
QUERY_TAILS = ["{", "lang=", "rll=", "code=", "group_code=", "noverify=", "v=", "ver=", "callback="]
FRAGMENT_TAILS = ["id=", "expires=", "width=", "height=", "lang=", "rll=", "amp", "quality=", "smart=", "fit=", "group_code=", "noverify="]
AWS_WORDS = ["aws_secret_access_key", "secretaccesskey", "aws_secret", "amazonaws", "aws-sdk", "s3.amazonaws", "access key id"]
HASH_WORDS = [".js", ".map", ".json", "bundle", "chunk", "webpack", "vite", "rollup", "module", "manifest", "commit", "revision", "cache", "checksum",
              "sha1", "hash", "digest", "sentry.io"]
ANCHORS = ["secretkey", "secret_key", "account_secret_key", "client_secret", "sharedkey", "shared_key", "private_key", "privatekey", "password",
           "passwd", "credential", "signing_key", "encryption_key", "hmac", "aes_key"]
DEFINITE_ANCHORS = ["client_secret", "clientsecret", "oauth_secret", "oauthsecret", "private_key", "privatekey", "encryption_secret_key",
                    "encryptionsecretkey", "azpay_secret_key", "azpaysecretkey", "db_password", "database_password", "app_auth", "private_api_key"]
SECRET_ANCHORS = ["client_secret", "app_secret_key", "encryption_secret_key", "api_secret_key", "totp_secret_key"]
KNOWN_PREFIXES = ["ghp_", "github_pat_", "glcbt-", "glpat-", "glptt-", "glsa_", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxs-"]
CODE_ROOTS = ["this", "window", "document", "state", "config", "process", "e", "t", "n", "r", "i", "u", "s", "Kt", "dt", "pt", "Ir"]
CODE_STARTS = ["$", "this.", "state.", "config.", "window.", "document.", "props.", "ctx.", "module.", "exports.", "process."]
VERBS = ["should", "get", "set", "use", "has", "is", "can", "enable", "disable", "create", "update", "remove", "delete", "handle"]
ISSUERS = ["accounts.google.com", "https://accounts.google.com", "https://securetoken.googleapis.com", "api.twitter.com", "auth0.com", "okta.com",
           "onelogin.com", "stripe.com", "paypal.com", "github.com", "https://github.com", "gitlab.com", "https://gitlab.com"]
APP_PREFIXES = ["google_", "goog-", "gcp-", "tw_", "twitch_", "gh_", "github_", "slack_", "discord_", "telegram_"]
PRIVILEGES = ["admin", "root", "superuser", "write", "delete", "manage"]
CLAIMS = ["sub", "user_id", "uid", "account_id", "email", "preferred_username", "username", "role", "roles", "scope", "scopes", "permission",
          "permissions", "admin", "is_admin", "is_superuser", "is_root", "client_id", "azp", "aud", "access_token", "refresh_token", "secret",
          "password", "pwd"]
_HEX8 = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


#: Longer values match no pattern with a repeated group: Java recurses once a repetition, and an overflow ends the executor.
LONGEST = 4_096


def _has(column: Column, pattern: str) -> Column:
    found = F.rlike(column, F.lit(pattern))
    return F.when(F.length(column) > LONGEST, F.lit(False)).otherwise(found) if re.search(r"\)[*+{]", pattern) else found


def _full(column: Column, pattern: str) -> Column:
    return _has(column, rf"\A(?:{pattern})\z")


def _full_i(column: Column, pattern: str) -> Column:
    return _has(column, rf"(?i)\A(?:{pattern})\z")


def _starts(column: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, p: a | F.startswith(column, F.lit(p)), prefixes, F.lit(False))


def _ends(column: Column, endings: list[str]) -> Column:
    return reduce(lambda a, p: a | F.endswith(column, F.lit(p)), endings, F.lit(False))


def _bare(value: Column) -> Column:
    return F.btrim(F.btrim(value), F.lit("\"'"))


def prepare(hits: DataFrame) -> DataFrame:
    """``hits`` with the texts that the decisions read: var, value, text and their parts. [V2, V3, V4]"""
    there = set(hits.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in there else F.lit("")
    out = hits.withColumns({f"_{c}": text(c) for c in ("rule_name", "series", "file", "match", "value", "variable_name", "embedding_context", "whole_secret_value")})
    at = F.position(F.col("_value"), F.col("_match"))
    left = F.substr("_match", F.lit(1), F.greatest(at - 1, F.lit(0)))
    scanned = F.regexp_extract(left, "([\\p{L}\\p{N}_-]+)[ \\t\"'=:]*\\z", 1)
    simple = F.regexp_extract("_match", r"""([A-Za-z0-9_\-]{2,64})["'` ]?\s*[:=]\s*["'`]?""", 1)
    found = F.when((F.length("_match") == 0) | (F.length("_value") == 0) | (at <= 1), simple).otherwise(
        F.when(F.length(scanned).between(2, 49), scanned).otherwise(F.lit("")))
    given = F.trim("_variable_name")
    out = out.withColumn("_var", F.when((given == "") | (given == "N/A"), found).otherwise(F.col("_variable_name")))
    v, low = _bare(F.col("_value")), F.lower(_bare(F.col("_value")))
    head, tail = F.substring_index(v, "&", 1), F.lower(F.regexp_replace(v, r"(?s)\A[^&]*&", ""))
    cut = F.startswith(tail, F.lit("amp;")) | (contains_any(F.lower("_match"), QUERY_KEYS) & (F.contains(tail, F.lit("=")) | _starts(tail, QUERY_TAILS)))
    n = F.length(v)
    value = (F.when(F.endswith(low, F.lit("&amp;")), F.substr(v, F.lit(1), n - 5)).when(F.endswith(low, F.lit("&amp")), F.substr(v, F.lit(1), n - 4))
             .when(F.contains(v, F.lit("&")) & cut, head).otherwise(v))
    context = F.lit("")
    if "context" in there:
        fields = ("path", "snippet", "tag", "type", "scope")
        context = F.array_join(F.transform(F.slice("context", 1, 3), lambda c: F.concat_ws(" ", *[F.when(c[f] != "", c[f]) for f in fields])), " ")
    parts = [F.when(F.col(f"_{c}") != "", F.col(f"_{c}")) for c in ("rule_name", "series", "file", "match", "embedding_context", "whole_secret_value")]
    out = out.withColumns({"_v": value, "_text": F.lower(F.concat_ws(" ", *parts, F.when(context != "", context)))})
    return out.withColumns({"_name": F.lower(F.trim("_var")), "_core": F.regexp_replace(_bare(F.col("_v")), r"\A[-_]+", ""), "_rule": F.lower("_rule_name"),
                            "_vtext": F.lower(F.concat_ws(" ", "_var", "_text")), "_raw": _bare(F.col("_value"))})



def _c(name: str) -> Column:
    return F.col(name)


def is_generic() -> Column:
    return F.contains("_rule", F.lit("generic"))


def is_jwt() -> Column:
    return _c("_rule").isin("jwt", "jwt-base64")


# Fixed values that results depend on: the patterns and words in the tests and decisions from here on, each stated where it
# is used, as are the decisions' order and reasons.


def code_fragment() -> Column:
    """[V14]"""
    return contains_any(F.concat_ws(" ", "_v", "_match"), CODE_PARTS)


def code_reference(v: Column) -> Column:
    """[V9]"""
    dotted = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+"
    cleaned = F.regexp_replace(F.regexp_replace(v, r"\A[!~+\-]+", ""), r";+\z", "")
    segments = F.split(cleaned, r"\.", -1)
    rooted = F.element_at(segments, 1).isin(CODE_ROOTS) | F.exists(F.slice(segments, 2, 1000), lambda s: F.rlike(s, F.lit("[A-Z_]")))
    shapes = ((F.contains(v, F.lit("__WEBPACK_IMPORTED_MODULE_")) | F.contains(v, F.lit("process.env."))) | _starts(v, CODE_STARTS) | _has(v, r"[{}()\[\]]")
              | _has(v, r"=void\b|&&|\|\||=>") | _has(v, dotted + r"\s*=") | _has(v, r"=\s*" + dotted)
              | (_full(v, rf"[!~+\-]*{dotted}(?:[+\-*/]\d+)?;?") & rooted) | _full(v, dotted)
              | (_full(v, r"[A-Za-z0-9_.-]{12,160}") & (F.regexp_count(v, F.lit(r"\.")) >= 2) & _has(v, "[_-]")))
    return (F.length(v) > 0) & ~_starts(v, ["pk.", "sk.", "SG.", "ghp_", "github_pat_", "glpat-", "AIzaSy"]) & shapes


def front_end_artifact(v: Column) -> Column:
    """[V8]"""
    low = F.lower(v)
    nouns = "css|layout|button|header|footer|modal|widget|container|component|module|assets|src|helpers|utils|hooks|theme|style|chunk"
    marks = ["__webpack_imported_module_", "webpack_imported_module", "_module_ts", "assets_src", "node_modules", "sourcemappingurl"]
    return F.length(v).between(12, 180) & (contains_any(low, marks) | (F.contains(v, F.lit("__")) & _has(v, r"[./_\-]")) | _has(low, rf"(?:^|[-_.])(?:{nouns})(?:[-_.]|$)"))


def readable_slug(v: Column) -> Column:
    """[V7]"""
    kebab = F.size(F.filter(F.split(v, "-"), lambda p: F.rlike(p, F.lit("[a-z]")) & (F.length(p) >= 3))) >= 2
    return F.length(v).between(12, 160) & F.when(_full(v, r"[a-z0-9]+(?:-[a-z0-9]+){2,}"), kebab).otherwise(
        _full(v, r"[a-z0-9]+(?:\.[a-z0-9_-]+){2,}") | _full(v, r"\d{9,}-variation-\d+") | _full(v, r"static-\d+\.\d+"))


def readable_identifier(v: Column) -> Column:
    """[V5, V6]"""
    words = F.when(F.contains(v, F.lit("_")), F.filter(F.split(v, "_+"), lambda w: F.length(w) > 0)).otherwise(
        F.regexp_extract_all(v, F.lit(r"[A-Z]+(?=[A-Z][a-z]|$)|[A-Z]?[a-z]+"), F.lit(0)))
    long = F.filter(words, lambda w: F.length(w) >= 4)
    chars = F.aggregate(long, F.lit(0), lambda a, w: a + F.length(w))
    verb = F.lower(F.get(words, 0)).isin(VERBS) & (F.size(words) >= 3)
    shaped = _full(v, "[A-Z][A-Z0-9_]{6,}") | _full(v, "[A-Za-z]+(?:_[A-Za-z]+)+") | _full(v, "[a-z]+(?:-[a-z]+){2,}")
    covered = ((F.size(long) >= 2) & (chars >= F.length(v) - 2)) | ((F.size(long) >= 4) & (chars >= F.length(v) * 0.75))
    return F.length(v).between(8, 80) & ~_has(v, r"\d") & (shaped | F.coalesce(verb, F.lit(False)) | covered)


def query_fragment() -> Column:
    """[V17h]"""
    return F.contains("_value", F.lit("&")) & _starts(F.lower(F.regexp_replace("_value", r"(?s)\A[^&]*&", "")), FRAGMENT_TAILS)


def obvious_noise() -> list[tuple[str, Column]]:
    """The ordered reasons why a value is no credential. [V10, A.2]"""
    v, core = _bare(_c("_v")), _c("_core")
    placeholder = "REPLACE_WITH|PLACEHOLDER|INTENTIONALLY_BLANK|YOUR_(?:API_)?KEY|YOUR_TOKEN|YOUR_SECRET|API_KEY_RANDOM"
    return [
        ("empty_value", F.length(core) == 0),
        ("code_fragment", code_fragment()),
        ("code_reference", code_reference(v)),
        ("placeholder_value", core.isin(PLACEHOLDER_VALUES)),
        ("placeholder_pattern", _has(F.upper(core), placeholder)),
        ("experiment_id", _full_i(core, r"\d{9,}-variation-[a-z0-9]+")),
        ("constant_name", _full(core, "[A-Z][A-Z0-9_]{20,}")),
        ("asset_name", _ends(F.lower(core), ASSET_ENDINGS)),
        ("front_end_artifact", front_end_artifact(core)),
        ("email_address", _full(core, r"[^@\s]+@[^@\s]+\.[^@\s]+")),
        ("format_string", F.startswith(core, F.lit("%")) & F.contains(F.lower(core), F.lit("%s"))),
        ("readable_slug", readable_slug(core)),
        ("readable_identifier", readable_identifier(core)),
        ("query_fragment", F.contains(v, F.lit("&")) & query_fragment()),
    ]


def _any(tests: list[tuple[str, Column]]) -> Column:
    return reduce(lambda a, t: a | F.coalesce(t[1], F.lit(False)), tests, F.lit(False))


def broad_rule_noise() -> Column:
    """[V11]"""
    core, rule = _c("_core"), _c("_rule_name")
    extra = (front_end_artifact(core) | ((rule == "Contentful API Personal Token") & _full_i(core, "[a-f0-9]{24}-[a-f0-9]{24}"))
             | (rule.isin(WORDLIKE_RULES) & _full(core, "[A-Za-z]{8,40}"))
             | ((rule == "Azure Client Secret") & (F.startswith(core, F.lit("%")) | _full_i(core, _HEX8))))
    return rule.isin(BROAD_RULES) & (_c("_obvious") | extra)


def facebook() -> Column:
    """[V12]"""
    here = F.contains("_rule", F.lit("facebook")) | (F.lower("_series") == "facebook")
    client = _full_i(_c("_v"), "[a-f0-9]{32}") & contains_any(_c("_vtext"), ["client_token", "clienttoken", "client_access_token", "facebook_client_token", "facebook_client_access_token"])
    app = _full(_c("_v"), r"\d{15,18}") & contains_any(_c("_vtext"), ["app_id", "appid", "facebook_app_id", "client_id"])
    return here & (client | app)


def service_specific() -> list[Decision]:
    """[V13]"""
    v, rule, text = _bare(_c("_v")), _c("_rule_name"), _c("_vtext")
    code = (code_reference(v) | code_fragment() | _has(v, r'","[A-Za-z_][A-Za-z0-9_]*","') | _has(v, r"</?[A-Za-z][^>]*>|HTML_TAG|</div>|class=")
            | _has(v, r"\b(?:export const|const|let|var)\s+[A-Za-z_$]") | _has(v, r"[A-Za-z_$][\w$]*\s*=\s*[A-Za-z_$][\w$]*"))
    return [
        Decision("razorpay_asset", rule.isin("RazorPay API Key", "Razorpay API Key", "razorpay-api-key") & _full_i(v, "rzp_[a-z0-9_]{8,}"), NOISE),
        Decision("sumo_site_id", (_c("_rule") == "sumologic-access-token") & F.contains(text, F.lit("sumositeid")) & _full_i(v, "[a-f0-9]{64}"), POTENTIAL),
        Decision("dropbox_app_key", (_c("_rule") == "dropbox-api-token") & contains_any(text, ["dropboxappkey", "dropbox_api_key", "dropbox api key", "dropboxapikey"]) & _full_i(v, "[a-z0-9]{15,16}"), POTENTIAL),
        Decision("uuid_text", (rule == "Wit API Key") & F.contains(text, F.lit("without hyphens")) & _full_i(v, "[a-f0-9]{32}"), NOISE),
        Decision("rule_code_artifact", rule.isin("Ideogram-api-key", "Datafire API Key", "Intercom API Key") & code, NOISE),
    ]


def decoded_text(value: Column) -> Column:
    """Base64 text, url-safe or not, if it is UTF-8; else null. [V18]"""
    v = F.trim(value)
    padded = F.concat(F.translate(v, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(v), F.lit(4))))
    return F.when((F.length(v) >= 8) & _full(v, "[A-Za-z0-9+/=_-]+"), F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def aws_shape(v: Column) -> Column:
    """[V15e]"""
    return _full(F.trim(v), "[A-Za-z0-9+/=]{40}") & ~_full_i(F.trim(v), "[0-9a-f]{40}")


def public_key() -> Column:
    """[V20]"""
    v, name, text = _c("_v"), F.lower("_var"), _c("_text")
    n = F.length(v)
    return ((F.startswith(v, F.lit("pk.")) & contains_any(text, ["mapbox", "vector.pbf", "tiles.mapbox", "mapbox-streets"]))
            | (F.startswith(v, F.lit("pk_")) & name.isin("channel-key", "channel_key")) | name.isin("writekey", "analyticswritekey")
            | (name.isin("dd-api-key", "dd_client_token", "dd-client-token", "ddjskey", "clienttoken") & F.startswith(v, F.lit("pub")))
            | (name.isin("sdkkey", "sdk-key", "appkey", "app_key", "apikey", "api_key") & n.between(16, 40) & _full(v, "[A-Za-z0-9_-]+") & contains_any(text, ["sdk", "client", "browser", "frontend", ".js", ".html"]))
            | (name.isin("policykey", "brightcovepolicykey") & (n >= 40)) | (name.isin("segmentkey", "segment_key") & _full(v, "[A-Za-z0-9_-]{16,40}"))
            | ((name == "clientkey") & F.startswith(v, F.lit("sdk-"))) | (name.isin("domain_key", "domainkey") & _full(v, "[A-Za-z0-9_-]{20,48}"))
            | ((name == "projectkey") & _full(v, "[A-Za-z0-9_-]{16,40}")) | (name.isin("readtoken", "read_token") & _full(v, "[A-Za-z0-9]{16,32}"))
            | ((name == "preview_token") & _full(v, "[a-z0-9]{24,40}")))


def monitoring_token() -> Column:
    """[V19]"""
    t = _c("_text")
    return (_has(_c("_v"), r"\bNR(?:JS|BR)-[A-Za-z0-9]{10,}\b") | contains_any(t, ["newreliclicensekey", "boomr_api_key", "boomerang", "mpulse", "ddjskey", "optimonk", "fortertoken", "apestertoken", "contentmapid", "fides_key"])
            | (F.contains(t, F.lit("datadog")) & contains_any(t, ["rum", "browser", "clienttoken", "client token"])) | (F.contains(t, F.lit("userback")) & F.contains(t, F.lit("access_token")))
            | (_has(t, r"""(?:^|["'\s,{])(?:pkey|[0-9]+-client)["'`]?\s*[:=]""") & contains_any(t, ["adthrive", "opscobid", "ad_", "advertis"])))


def refine() -> list[Decision]:
    """The fifty decisions of the override, in order. [V23, A.1]"""
    v, name, text, vtext, match, rule, raw = _c("_v"), _c("_name"), _c("_text"), _c("_vtext"), _c("_match"), _c("_rule_name"), _c("_raw")
    header = _full_i(F.trim(v), "(?:CF|X|HTTP|Sec)-[A-Za-z]+(?:-[A-Za-z]+)*-(?:Secret|Key|Token|Id|Auth)")
    direct = contains_any(text, SECRET_ANCHORS) & ~code_reference(v) & ~code_fragment() & ~header
    code_like = code_reference(v) | _has(v, r"[{}()\[\]]") | _has(v, r"\.[a-zA-Z_]\w*") | (_full(v, "[a-zA-Z_][a-zA-Z0-9_]*") & (F.length(v) < 40))
    public_prefix = _has(F.trim(v), r"(?i)\A(client-|pk_live_|pk_test_|pk\.|pub-|pub_|public-|publishable[_-])")
    aws = (rule == "AWS API Secret") | contains_any(vtext, AWS_WORDS)
    low = F.lower("_var")
    state = low.isin("token", "rectoken", "contextual-token", "preview_token", "guest_token", "share_token") & (
        F.contains(F.lower("_value"), F.lit("&expires=")) | _full(v, "[A-Za-z0-9_-]{8,24}"))
    short = state | (low.isin("_key", "key", "apikey") & _full(v, "[A-Za-z0-9_-]{6,16}")) | (low.isin("data-token", "data-access-token") & F.startswith(v, F.lit("pk.")))
    cursor = (low.isin("after_token", "before_token", "page_token", "cursor", "cursor_token") | contains_any(text, ["after_token", "before_token", "page_token", "cursor"])) & (
        contains_any(F.lower(decoded_text(v)), ["searchdate", "cursor", "sort", "page", "uid="]) | (F.length(v) >= 16))
    file = F.lower("_file")
    page_key = (contains_any(file, ["page-data", "resource_manifest"]) | F.endswith(file, F.lit(".json"))) & low.isin("", "_key", "key") & _full(v, "[A-Za-z0-9_-]{6,16}")
    image = contains_any(text, ["imagekey", "image_key"]) & _ends(F.lower(raw), [".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg"])
    licence = (contains_any(text, ["licensekey", "license_key"]) & ~contains_any(text, ["publishable", "stripe", "pk_live", "pk_test", "lobpublishable", "public_api_key", "publicapikey"])
               & (_full_i(raw, "[A-F0-9]{8}(?:-[A-F0-9]{8}){3}") | contains_any(text, ["lightgallerylicensekey", "newreliclicensekey", "frontend", "browser"])))
    media = _has(text, r"""(?:^|[?&\s"'])auth=""") & contains_any(text, ["width=", "height="]) & contains_any(text, ["quality=", "smart=true", "fit="])
    base64 = _full(v, "[A-Za-z0-9+/]{20,}={0,2}")
    first = service_specific()
    return [
        Decision("broad_rule_noise", broad_rule_noise(), NOISE),
        Decision("facebook_public", facebook(), POTENTIAL),
        *first,
        Decision("totp_secret", direct & _full(v, "[A-Z2-7]{32}"), CRITICAL),
        Decision("direct_secret", direct & _full(v, "[A-Za-z0-9_-]{14,48}"), CRITICAL),
        Decision("github_token", _starts(v, ["ghp_", "github_pat_"]) | _has(match, "(ghp_|github_pat_)[A-Za-z0-9_]+"), CRITICAL),
        Decision("gitlab_token", _starts(v, ["glcbt-", "glpat-", "glptt-", "glsa_"]), CRITICAL),
        Decision("google_api_key", F.startswith(v, F.lit("AIzaSy")), POTENTIAL),
        Decision("live_payment_key", _starts(v, ["sk_live_", "rk_live_"]), CRITICAL),
        Decision("razorpay_key_id", _starts(v, ["rzp_live_", "rzp_test_"]), POTENTIAL),
        Decision("aws_secret", aws & aws_shape(v), CRITICAL),
        Decision("definite_anchor", ~code_like & ~public_prefix & ~header & contains_any(vtext, DEFINITE_ANCHORS), CRITICAL),
        Decision("obvious_noise", _c("_obvious"), NOISE),
        Decision("code_fragment", code_fragment(), NOISE),
        Decision("uuid", _full_i(F.trim(v), _HEX8), NOISE),
        Decision("short_service_token", _full_i(v, "[a-z0-9]{5}-[a-z0-9]{5}-[a-z0-9]{5}-[a-z0-9]{5}"), NOISE),
        Decision("merchant_placeholder", _full_i(v, r"md_key_\d+i\d+"), NOISE),
        Decision("yotpo_public", F.contains(text, F.lit("public_yotpo")) | name.isin("yotpositekey", "yotpo_key", "public_yotpo_key"), NOISE),
        Decision("known_noise_name", ~name.isin(CONTEXT_NAMES) & name.isin(NOISE_NAMES), NOISE),
        Decision("signed_media", media, NOISE),
        Decision("versioned_skey", _has(text, r"""(?i)(?:^|[?&\s"'])skey=[0-9a-f]{8,64}(?:&amp;|&)?v=v\d+"""), NOISE),
        Decision("csrf_token", contains_any(text, ["csrf", "xsrf", "anti-forgery", "antiforgery", "requestverificationtoken"]), NOISE),
        Decision("cursor", cursor, NOISE),
        Decision("page_data_key", page_key, NOISE),
        Decision("media_playlist_key", F.endswith(file, F.lit(".m3u8")) & low.isin("auth_key", "key") & _full(v, "[A-Za-z0-9_-]{16,80}"), NOISE),
        Decision("recommendation_token", ((low == "rectoken") & F.startswith(v, F.lit("rt."))) | ((low == "auth_key") & _full_i(v, r"\d{10,16}-\d+-\d+-[0-9a-f]{32}")), NOISE),
        Decision("public_sdk_key", public_key(), POTENTIAL),
        Decision("short_state_token", short, NOISE),
        Decision("image_key", image, NOISE),
        Decision("library_licence", licence, NOISE),
        Decision("url_misparse", _has(text, r"""(?:^|[?&\s"'])api_key=maps&signature="""), NOISE),
        Decision("monitoring_token", monitoring_token(), NOISE),
        Decision("front_end_name", name.isin("writekey", "analyticswritekey", "ddjskey", "website_token", "optimonkclient", "altkraft_token", "altkraft_token_v3"), NOISE),
        Decision("query_name", name.isin("rlkey", "authkey", "dm_key") & F.contains("_value", F.lit("&")), NOISE),
        Decision("query_api_key", name.isin("apikey", "key", "_key") & query_fragment(), NOISE),
        Decision("auth_fragment", (name == "auth") & query_fragment(), NOISE),
        Decision("shared_key", (name == "sharedkey") & ~F.contains(text, F.lit("base64")) & (F.length(v) >= 32) & base64, POTENTIAL),
        Decision("hex_digest", _full_i(F.trim(v), "[0-9a-f]{32,64}") & (contains_any(vtext, HASH_WORDS) | _c("_rule").isin("generic-api-key", "generic-password", "aws api secret")), NOISE),
        Decision("resource_manifest", F.contains(file, F.lit("resource_manifest")) & base64, NOISE),
        Decision("form_id", rule.isin("HubSpot API Key", "hubspot-api-key") & F.contains(text, F.lit("hubspotformid")), NOISE),
        Decision("merchant_key_id", (rule == "RazorPay API Secret") & _full(v, "Zm[A-Za-z0-9+/=]{20,}"), NOISE),
        Decision("css_class", rule.isin("Toggltrack API Key", "Hive API Key") & _has(match, r"""(?:^|["'\s])(?:Toggle-|hivedMarker-)"""), NOISE),
        Decision("demo_jwt", is_jwt() & F.startswith(v, F.lit("eyJhbGciOiJub25lIn0.")), NOISE),
        Decision("tracker_dsn", (rule == "Uri") & F.contains(text, F.lit("sentry.io")), NOISE),
        Decision("mailto_uri", (rule == "Uri") & F.contains(text, F.lit("mailto:")), NOISE),
        Decision("url_api_parameter", (name == "api") & _has(match, r"(?:^|[?&])api=1(?:&|$)|api\.amazonaws\.com"), NOISE),
        Decision("captcha_site_key", ((name == "sitekey") | F.contains(text, F.lit("sitekey"))) & F.startswith(v, F.lit("6L")), NOISE),
        Decision("unauth_state", (name == "unauth") & F.contains(F.lower(decoded_text(v)), F.lit("uid=")), NOISE),
        Decision("zapier_hook", (rule == "Zapier webhook") & F.startswith(v, F.lit("https://hooks.zapier.com/")), POTENTIAL),
        Decision("uri_credential", (rule == "Uri") & _has(match, r"""https?://[^/\s"']+:[^@\s"']+@"""), POTENTIAL),
    ]


def _part(value: Column, k: int) -> Column:
    raw = F.translate(F.get(F.split(F.trim(value), r"\.", -1), k), "-_", "+/")
    padded = F.concat(raw, F.repeat(F.lit("="), F.pmod(-F.length(raw), F.lit(4))))
    return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def jwt_decisions(now: int) -> list[Decision]:
    """[V26, A.4] A payload that is JSON but no object counts as undecodable."""
    payload, header = _c("_payload"), _c("_header")
    low, field = F.lower(payload), (lambda n: F.get_json_object(payload, f"$.{n}"))
    alg = F.upper(F.coalesce(F.nullif(F.get_json_object(header, "$.alg"), F.lit("")), F.lit("none")))
    issuer = F.lower(F.coalesce(field("iss"), F.lit("")))
    apps = reduce(lambda a, n: a | F.coalesce(_starts(F.lower(field(n)), APP_PREFIXES), F.lit(False)), ("app_id", "client_id", "azp", "clientId"), F.lit(False))
    some = lambda *names: F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names], F.lit(""))
    rights = F.lower(F.concat(some("scope", "scopes"), some("role", "roles", "permissions")))
    expiry = F.try_to_number(F.regexp_extract(F.coalesce(field("exp"), F.lit("")), r"\A([0-9]{1,18})", 1), F.lit("9" * 18)).cast("bigint")
    claims = F.exists(F.json_object_keys(payload), lambda k: F.lower(k).isin(CLAIMS))
    return [
        Decision("jwt_unreadable", payload.isNull() | (F.size(F.split(F.trim("_value"), r"\.", -1)) != 3) | ~_has(payload, r"\A\s*\{") | F.json_object_keys(payload).isNull(), POTENTIAL),
        Decision("jwt_alg_none", alg == "NONE", CRITICAL),
        Decision("jwt_shared_secret", alg.isin("HS256", "HS384", "HS512") & contains_any(low, ["secret", "password", "pwd", "credential"]), CRITICAL),
        Decision("jwt_issuer", _starts(issuer, ISSUERS), CRITICAL),
        Decision("jwt_app_id", apps, CRITICAL),
        Decision("jwt_privilege", contains_any(rights, PRIVILEGES), CRITICAL),
        Decision("jwt_expired", (expiry > 0) & (expiry < now), POTENTIAL),
        Decision("jwt_long_lived", expiry - now > 7 * 24 * 3600, POTENTIAL),
        Decision("jwt_claims", claims, POTENTIAL),
        Decision("jwt_default", F.lit(True), POTENTIAL),
    ]


def noise_name() -> Column:
    """[V24]"""
    name = _c("_name")
    return (F.length(name) >= 2) & ~name.isin(CONTEXT_NAMES) & (name.isin(NOISE_NAMES) | name.isin(PLACEHOLDER_NAMES) | _starts(name, PLACEHOLDER_PREFIXES))


def main_cascade(now: int) -> list[Decision]:
    """After the override. [V25, §2.8]"""
    rule, series = _c("_rule_name"), _c("_series")
    return [
        Decision("facebook_public", facebook(), POTENTIAL),
        *service_specific(),
        Decision("broad_rule_noise", broad_rule_noise(), NOISE),
        Decision("low_risk_rule", rule.isin(LOW_RISK_RULES), POTENTIAL),
        Decision("critical_rule", rule.isin(CRITICAL_RULES), CRITICAL),
        Decision("critical_series", series.isin(CRITICAL_SERIES), CRITICAL),
        Decision("potential_series", series.isin(POTENTIAL_SERIES), POTENTIAL),
        Decision("uri_pending", rule.isin("Uri", "URL"), PENDING),
        Decision("unmatched", ~is_generic() & ~is_jwt(), UNMATCHED),
        *[Decision(d.code, is_jwt() & F.coalesce(d.test, F.lit(False)), d.risk) for d in jwt_decisions(now)],
        Decision("noise_name", noise_name(), NOISE),
        Decision("generic_pending", F.lit(True), PENDING),
    ]


def _staged(hits: DataFrame) -> DataFrame:
    ready = prepare(hits)
    return ready.withColumns({"_obvious": _any(obvious_noise()), "_payload": F.when(is_jwt(), _part(F.col("_value"), 1)), "_header": F.when(is_jwt(), _part(F.col("_value"), 0))})


def classify(hits: DataFrame, now: int = 0, keep_prepared: bool = False) -> DataFrame:
    """``hits`` with risk, reason_code and variable; vector work is left as PendingVector. [V1, V23-V26]"""
    ready = _staged(hits)
    override = is_generic() | is_jwt() | F.col("_rule_name").isin(OVERRIDE_RULES)
    made = ready.withColumn("_refined", F.when(override, decide(refine()))).withColumn("_main", decide(main_cascade(now)))
    chosen = F.coalesce("_refined", "_main")
    out = made.withColumns({"risk": chosen["risk"], "reason_code": chosen["code"], "variable": F.nullif("_var", F.lit(""))})
    return out if keep_prepared else out.select(*hits.columns, "risk", "reason_code", "variable")


def classify_tokens(hits: DataFrame, now: int = 0) -> DataFrame:
    """Web tokens by their content alone: ``hits`` with risk and reason_code. [V26]"""
    ready = _staged(hits).withColumn("_d", decide(jwt_decisions(now)))
    return ready.select(*hits.columns, F.col("_d.risk").alias("risk"), F.col("_d.code").alias("reason_code"))


def findings(classified: DataFrame, include_noise: bool = False) -> DataFrame:
    """The public shape: risk by its long name, without unmatched rows and, unless asked for, noise. [V35]"""
    named = F.when(F.col("risk") == CRITICAL, "Private-by-design secret").when(F.col("risk") == POTENTIAL, "Public-by-design secret").when(F.col("risk") == NOISE, "Non-secret noise")
    score = F.col("score") if "score" in classified.columns else F.lit(-1.0)
    shown = classified.where(F.col("risk").isin(CRITICAL, POTENTIAL, *([NOISE] if include_noise else [])))
    return shown.select(named.alias("risk"), "value", "variable", F.col("rule_name").alias("rule"), "file", F.col("line_start").alias("line"),
                        F.col("reason_code").alias("reason"), score.alias("score"))


def summary(classified: DataFrame, n_files: int | None = None) -> DataFrame:
    """One row of counts. [V36]"""
    files = F.lit(n_files).cast("bigint") if n_files is not None else F.countDistinct("file")
    return classified.agg(files.alias("files"), F.count(F.lit(1)).alias("raw_hits"), *[F.count_if(F.col("risk") == r).alias(n) for r, n in (
        (CRITICAL, "private"), (POTENTIAL, "public"), (NOISE, "noise"), (PENDING, "pending"), (UNMATCHED, "unmatched"))])
