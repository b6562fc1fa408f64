"""Embedding and the nearest entry of a knowledge base.

No embedding model is at hand, so the default embedder hashes character n-grams into
a normalised vector; any function from a series of texts to arrays can take its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.batches import bound_batches
from sluice.functions.text import contains_any
from sluice.operators import classify_v2 as v2
from sluice.operators.cascade import CRITICAL, NOISE, PENDING, POTENTIAL, Decision, decide
from sluice.schema import CONTEXT
from sluice.staging import stage

DIMENSIONS = 256
THRESHOLD, CRITICAL_THRESHOLD = 0.8, 0.85
#: Up to so many entries the knowledge base is broadcast as a matrix; beyond, it is searched in blocks of that size.
BLOCK = 100_000
#: Queries that meet a block together.
QUERIES = 20_000
#: The context entry's fields in the order they are tried; neighbours whose verdict some shapes replace.
CONTEXT_FIELDS = ["path", "snippet", "tag", "type", "scope"]
POTENTIAL_IDS = ["60050910-9b4f-4021-a516-37a785ac6fc3"]
PUBLIC_MAP_IDS = ["540ae999-d45c-47c9-8c0b-38c7b232ae14", "a7a0a0fd-9f9a-4d50-8151-aa34f9f43a67", "374e1300-fcd8-44ed-8ab5-81f3d7934bd1"]
#: Risk words of the knowledge base and the prefixes that the descriptor names, in order.
RISK_CRITICAL = ["critical", "high", "severe"]
RISK_POTENTIAL = ["potentialrisk", "medium", "moderate", "warning"]
RISK_NOISE = ["falsepositive", "lowrisk", "safe", "low", "info"]
PREFIXES = [
    "AGE-SECRET-KEY-1", "AIDA", "AIPA", "AIza", "AKIA", "AGPA", "ANPA", "ANVA", "AM_", "API_KEY", "AQVN", "AROA", "ASIA", "BBFF-",
    "BUNDLE_ENTERPRISE__CONTRIBSYS__COM", "BUNDLE_GEMS__CONTRIBSYS__COM", "CLOJARS_", "EAACEdEose0cBA", "EZAK", "EZTK", "FLWPUBK_TEST-",
    "FLWSECK", "FLWSECK_TEST-", "GR1348941", "NF-", "NRAK-", "NRJS-", "PMAK-", "SG.", "SK", "YC", "access-development-", "access-production-",
    "access-sandbox-", "access_token$production$", "aio_", "amzn.mws.", "api_", "api_org_", "apify_api_", "authress_", "b_", "dapi", "dnkey-",
    "doo_v1_", "dop_v1_", "dor_v1_", "dp.pt.", "dt0c01.", "duffel_live_", "duffel_test_", "ext_", "ey", "fio-u-", "flb_live_", "gho_", "ghp_",
    "ghr_", "ghs_", "ghu_", "github_pat_", "glc_", "glpat-", "glptt-", "glsa_", "hf_", "hvb.", "hvs.", "ico-", "idg", "jina_", "k_", "key", "key-",
    "lin_api_", "live_", "npm_", "nvapi-", "phc_", "pk.", "pk_", "pk_live_", "pk_test_", "pnu_", "pplx_", "pscale_oauth_", "pscale_pw_",
    "pscale_tkn_", "pubkey-", "pul-", "p8e-", "pypi-", "rdme_", "rk_live_", "rubygems_", "rzp_", "sc_", "scauth_", "secret_", "shippo_live_",
    "shippo_test_", "shpat_", "shpca_", "shppa_", "shpss_", "sk", "sk-", "sk.", "sk_", "sk_live_", "sk_test_", "sq0atp-", "sq0csp-", "sq0idp-",
    "t1.", "tfp_", "tk-us-", "web_", "xai-", "xapp-", "xkeysib-", "xoxa", "xoxb-", "xoxe", "xoxp", "xoxr", "xoxs",
]


def hash_embed(texts: pd.Series) -> pd.Series:
    """Hashed character trigrams, L2-normalised; the same text always gives the same vector."""

    def one(text: str | None) -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        padded = f"  {(text or '')[:8192]} "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i:i + 3].encode("utf-8", "replace"))
            out[h % DIMENSIONS] += 1.0 if h & 1 << 16 else -1.0
        norm = float(np.linalg.norm(out))
        return out / norm if norm else out

    return texts.map(one)


def embed(df: DataFrame, text_col: str, vector_col: str = "vector", embedder: Callable[[pd.Series], pd.Series] = hash_embed) -> DataFrame:
    """``df`` with the vector of each text; every distinct text is embedded once. [V29, R13]"""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return embedder(texts.str.replace("\n", " "))

    distinct = df.select(text_col).distinct().withColumn(vector_col, vectors(F.col(text_col)))
    return df.join(distinct, df[text_col].eqNullSafe(distinct[text_col])).drop(distinct[text_col])


def describe(value: Column) -> Column:
    """struct(length, prefix, charset): the first listed prefix, and character groups by first appearance. [V27]"""
    v = F.trim(value)
    prefix = F.get(F.filter(F.array(*[F.lit(p) for p in PREFIXES]), lambda p: F.startswith(v, p)), 0)
    group = lambda c: F.when(F.rlike(c, F.lit("[a-z]")), "LowerAlpha").when(F.rlike(c, F.lit("[A-Z]")), "UpperAlpha").when(F.rlike(c, F.lit("[0-9]")), "Digit").when(F.rlike(c, F.lit(r"[_+/=.@-]")), c)
    groups = F.array_distinct(F.array_compact(F.transform(F.split(v, ""), group)))
    return F.struct(F.length(v).alias("length"), prefix.alias("prefix"), F.array_join(groups, " + ").alias("charset"))


def signature() -> Column:
    """A code for the kind of secret that the shape suggests; null for none. [V28a]"""
    v, m, rule = F.col("_value"), F.lower("_match"), F.col("_rule_name")
    aws = (F.length(v) == 40) & F.rlike(v, F.lit("[+=/]")) & F.rlike(v, F.lit(r"\A[A-Za-z0-9+/=]+\z"))
    return (F.when((rule == "Private Key") | F.rlike(v, F.lit(r"\A-----BEGIN (RSA )?PRIVATE KEY-----")), "pem_private_key").when(F.contains(m, F.lit("smtp://")), "smtp_credential")
            .when(rule.isin("Uri", "URL") & (F.contains(m, F.lit("github")) | F.contains(v, F.lit("ghp_"))), "github_token_in_url").when(rule.isin("AWS API Secret", "AWS") | aws, "aws_secret_key")
            .when(F.rlike(v, F.lit(r"\Agl(pat|cbt)-")), "gitlab_token").when(F.startswith(v, F.lit("ghp_")), "github_token").when(F.rlike(v, F.lit(r"\Arzp_(live|test)_")), "razorpay_key"))


def embedding_text(prepared: DataFrame, out: str = "embedding_text") -> DataFrame:
    """A prepared frame with the text to embed: the enriched context if longer than 10 characters, else a description. [V28]"""
    d = describe(F.col("_value"))
    preview = F.when(F.length("_value") > 64, F.concat(F.substr("_value", F.lit(1), F.lit(64)), F.lit("..."))).otherwise(F.col("_value"))
    parts = [F.concat(F.lit("Variable Name: "), F.coalesce(F.nullif("_var", F.lit("")), F.lit("Unknown"))),
             F.concat(F.lit("Features - Length: "), d["length"].cast("string"), F.lit(", Charset: "), d["charset"], F.lit(", prefix: "), F.coalesce(d["prefix"], F.lit("N/A"))),
             F.concat(F.lit("Semantic Signature: "), signature()), F.when(preview != "", F.concat(F.lit("value: "), preview)),
             F.concat(F.lit("Series: "), F.col("_series")), F.concat(F.lit("Service: "), F.col("_rule_name"))]
    if "context" in prepared.columns:
        entries = F.slice(F.coalesce("context", F.array().cast(CONTEXT)), 1, 3)
        field = lambda x, n: F.when(F.length(x[n]) > 0, F.concat(F.lit(f"{n}:"), F.when(F.length(x[n]) > 100, F.concat(F.substr(x[n], F.lit(1), F.lit(100)), F.lit("..."))).otherwise(x[n])))
        detail = F.array_join(F.array_compact(F.transform(entries, lambda x: F.coalesce(*[field(x, n) for n in CONTEXT_FIELDS]))), ", ")
        parts.insert(3, F.when(detail != "", F.concat(F.lit("context: ["), detail, F.lit("]"))))
    made = F.concat_ws(". ", *parts)
    return prepared.withColumn(out, F.when(F.length(F.trim("_embedding_context")) > 10, F.col("_embedding_context")).otherwise(made))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit rows from a list array without nulls or empty lists."""
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()))} dimensions")
    rows = vectors.flatten().to_numpy().astype(np.float32).reshape(len(vectors), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def _best(queries: np.ndarray, base: np.ndarray, ids: list[str], own: list[str | None] | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and cosine of each query's nearest but its own entry; of equal ones the first, and -1 for none."""
    if len(queries) and len(base) and queries.shape[1] != base.shape[1]:
        raise ValueError(f"vectors of {queries.shape[1]} dimensions, but a knowledge base of {base.shape[1]}")
    at, score = np.zeros(len(queries), np.int64), np.full(len(queries), -1.0)
    place = {x: k for k, x in enumerate(ids)} if own is not None else {}
    for i in range(0, len(queries) if len(base) else 0, 1024):
        scores = queries[i:i + 1024] @ base.T
        if own is not None:
            mine = [(k, place[o]) for k, o in enumerate(own[i:i + 1024]) if o in place]
            scores[[k for k, _ in mine], [p for _, p in mine]] = -2.0
        at[i:i + 1024], score[i:i + 1024] = scores.argmax(1), scores.max(1)
    return at, np.where(score < -1.5, -1.0, score)


def nearest(queries: DataFrame, kb: DataFrame, vector_col: str = "vector", block: int = BLOCK, own_col: str | None = None) -> DataFrame:
    """``queries`` with kb_id, kb_risk, kb_service and score of the entry of greatest cosine. [V30, R14]

    ``kb`` is (id, vector, risk_level, service); rows without a vector are left out.
    A query of another dimension than the entries is an error, not a miss; one without
    a vector, or an empty base, gives nulls and -1. Of equal scores the least id wins.
    ``own_col`` names a column with the id of a query's own entry, which it does not find.
    A base of up to ``block`` entries is one broadcast matrix. A larger one never
    reaches the driver: it is cut into blocks of that size by a hash of the id, each
    chunk of queries meets every block once on the executors, and the best of the
    blocks stays: a stated set of queries against all rows, in blocks.
    """
    entries = kb.where("vector IS NOT NULL AND size(vector) > 0").select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), "risk_level", "service")
    n = entries.limit(block + 1).count()
    return _by_blocks(queries, entries, vector_col, block, own_col) if n > block else _by_broadcast(queries, entries, vector_col, own_col)


def _by_broadcast(queries: DataFrame, entries: DataFrame, vector_col: str, own_col: str | None) -> DataFrame:
    rows = entries.orderBy("id").collect()
    ids, matrix = [(r.id, r.risk_level, r.service) for r in rows], np.array([r.vector for r in rows], np.float32) if rows else np.zeros((0, 1), np.float32)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = queries.sparkSession.sparkContext.broadcast((matrix / np.where(norms == 0, 1, norms), ids))
    shape = T.StructType([*queries.schema.fields, T.StructField("kb_id", T.StringType()), T.StructField("kb_risk", T.StringType()), T.StructField("kb_service", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, names = shared.value
        for batch in batches:
            column = batch.column(vector_col)
            usable = np.flatnonzero([bool(v.is_valid and len(v)) for v in column]) if len(names) else np.zeros(0, np.int64)
            got: list[tuple] = [(None, None, None, -1.0)] * batch.num_rows
            if len(usable):
                taken = pa.array(usable)
                own = batch.column(own_col).take(taken).cast(pa.string()).to_pylist() if own_col else None
                at, score = _best(_matrix(column.take(taken)), base, [n[0] for n in names], own)
                for k, a, s in zip(usable.tolist(), at.tolist(), score.tolist()):
                    if s > -1.0 or not own_col:
                        got[k] = (*names[a], round(s, 6))
            found = list(zip(*got)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(f, pa.string()) for f in found[:3]], pa.array(found[3], pa.float64())], [*batch.schema.names, "kb_id", "kb_risk", "kb_service", "score"])

    return queries.mapInArrow(work, shape)


def _by_blocks(queries: DataFrame, entries: DataFrame, vector_col: str, block: int, own_col: str | None) -> DataFrame:
    bound_batches(queries.sparkSession)
    wide = stage(queries.withColumn("__q", F.monotonically_increasing_id()), "queries")
    parts, chunks = -(-entries.count() // block), -(-wide.count() // QUERIES)
    own = F.col(own_col).cast("string") if own_col else F.lit(None).cast("string")
    asked = wide.where(F.size(vector_col) > 0).select("__q", own.alias("own"), F.col(vector_col).cast("array<float>").alias("v"), F.pmod(F.xxhash64("__q"), F.lit(chunks)).alias("c"))
    dealt = entries.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)))
    left = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    right = dealt.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))

    def work(some: pa.Table, base: pa.Table) -> pa.Table:
        if not some.num_rows or not base.num_rows:
            return pa.table({"__q": pa.array([], pa.int64()), "kb_id": pa.array([], pa.string()), "kb_risk": pa.array([], pa.string()),
                             "kb_service": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        base = base.sort_by("id")
        at, score = _best(_matrix(some.column("v").combine_chunks()), _matrix(base.column("vector").combine_chunks()), base.column("id").to_pylist(),
                          some.column("own").to_pylist() if own_col else None)
        rows = base.take(pa.array(at))
        return pa.table({"__q": some.column("__q"), "kb_id": rows.column("id"), "kb_risk": rows.column("risk_level"), "kb_service": rows.column("service"),
                         "score": pa.array(np.round(score, 6))})

    each = left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInArrow(work, "__q long, kb_id string, kb_risk string, kb_service string, score double")
    best = each.groupBy("__q").agg(F.min_by(F.struct("kb_id", "kb_risk", "kb_service", "score"), F.struct(-F.col("score"), F.col("kb_id"))).alias("t")).select("__q", "t.*")
    return wide.join(best, "__q", "left").withColumn("score", F.coalesce("score", F.lit(-1.0))).drop("__q")


def allows_critical() -> Column:
    """Evidence that a critical neighbour needs. [V32]"""
    raw = F.col("_raw")
    aws = v2.aws_shape(raw) & contains_any(F.col("_vtext"), v2.AWS_WORDS)
    return v2._starts(raw, v2.KNOWN_PREFIXES) | contains_any(F.col("_vtext"), v2.ANCHORS) | (aws & (F.contains(F.lower(F.coalesce("kb_service", F.lit(""))), F.lit("aws")) | (F.col("score") >= 0.92)))


def kb_override() -> list[Decision]:
    """Shapes that overrule the neighbour. [V31]"""
    v, text, name = F.col("_v"), F.col("_text"), F.lower("_var")
    # neighbours of two groups replace nothing but what their own shapes say
    captcha, maps = (F.coalesce(F.col("kb_id").isin(ids), F.lit(False)) for ids in (POTENTIAL_IDS, PUBLIC_MAP_IDS))
    # Fixed values that results depend on: the shapes below.
    dotted = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+"
    return [
        Decision("kb_content_key", v2._full_i(v, r"k\$[a-f0-9]{32}"), NOISE),
        Decision("kb_asset_key", v2._full_i(v, "OGY-[A-F0-9]{12}") & F.contains(text, F.lit("assetkey")), NOISE),
        Decision("kb_auth_state", v2._full(v, "(?:auth-suite|auth)[-_][A-Za-z0-9_-]+") & F.contains(text, F.lit("authorize")), NOISE),
        Decision("kb_host_value", v2._full_i(v, r"[a-z0-9.-]+\.(?:vipserver|com|net|org|io|cn|jp|fr|de|cz|hu)"), NOISE),
        Decision("kb_social_login", contains_any(text, ["super_socializerauth=disqus", "heateorslauth=disqus"]), NOISE),
        Decision("kb_analytics_query", (F.contains(text, F.lit("buzz_key=")) & F.contains(text, F.lit("segment_key="))) | v2._has(text, r"""(?:^|[?&"'])api=0&sn=\d+&"""), NOISE),
        Decision("kb_social_redirect", v2._has(text, r"""(?:heateorslauth|supersocializerauth)=[a-z]+&[^"'\s]*redirect_to="""), NOISE),
        Decision("kb_interpolation", v2._has(v, rf"[+]{dotted}[+]") | (F.startswith(v, F.lit("+")) & v2._has(v, dotted)), NOISE),
        Decision("kb_category_query", F.contains(text, F.lit("cat_key=")) & F.contains(text, F.lit("&aktcat=")), NOISE),
        Decision("kb_licence_id", v2._starts(F.lower(v), ["license-", "prd-"]) & v2._full(v, "[A-Za-z0-9_-]{8,32}"), NOISE),
        Decision("kb_captcha_id", captcha & (contains_any(text, ["sitekey", "captcha"]) | F.startswith(v, F.lit("0x4AAAA"))), POTENTIAL),
        Decision("kb_map_id", maps & F.startswith(v, F.lit("pk.")) & contains_any(text, ["mapbox", "access_token", "map"]), POTENTIAL),
        Decision("kb_payment_id", maps & v2._starts(v, ["pk_live_", "pk_test_"]), POTENTIAL),
        Decision("kb_site_key_id", maps & F.startswith(v, F.lit("0x4AAAA")), POTENTIAL),
        Decision("kb_statsig", ~captcha & ~maps & (name.isin("clientsdkkey", "statsig_client_sdk_key", "statsigclientkey") | F.contains(text, F.lit("statsig"))) & v2._starts(v, ["client-", "sdk-"]) & v2._full(v, "[A-Za-z0-9_-]{18,80}"), POTENTIAL),
        Decision("kb_weather", ~captcha & ~maps & F.contains(text, F.lit("weather")) & v2._full(v, "[A-Fa-f0-9]{30,32}"), POTENTIAL),
    ]


def post_process() -> Column:
    """struct(risk, code) of a pending row with its neighbour. [V33, A.3]"""
    risk = F.lower(F.coalesce(F.nullif("kb_risk", F.lit("")), F.lit("PotentialRisk")))
    return decide([
        Decision("no_vector", F.col("kb_id").isNull() & (F.col("score") < 0), POTENTIAL),
        Decision("below_threshold", F.col("score") < THRESHOLD, POTENTIAL),
        Decision("obvious_noise", F.col("_obvious"), NOISE),
        *kb_override(),
        Decision("kb_critical", risk.isin(RISK_CRITICAL) & (F.col("score") >= CRITICAL_THRESHOLD) & allows_critical(), CRITICAL),
        Decision("kb_critical_downgraded", risk.isin(RISK_CRITICAL), POTENTIAL),
        Decision("kb_potential", risk.isin(RISK_POTENTIAL), POTENTIAL),
        Decision("kb_noise", risk.isin(RISK_NOISE), NOISE),
        Decision("kb_unknown", F.lit(True), POTENTIAL),
    ])


def base_of_settled(done: DataFrame, embedder: Callable[[pd.Series], pd.Series] = hash_embed) -> DataFrame:
    """A knowledge base of the settled rows of a classified, prepared frame: one entry a text, in the words that a base uses."""
    known = embedding_text(done.where(F.col("risk") != PENDING))
    level = F.when(F.col("risk") == CRITICAL, "critical").when(F.col("risk") == NOISE, "falsepositive").otherwise("potentialrisk")
    texts = known.groupBy(F.col("embedding_text").alias("t")).agg(F.max(F.struct(level.alias("risk_level"), F.col("_rule_name").alias("service"))).alias("r"))
    return stage(embed(texts.select("t", "r.*"), "t", "vector", embedder).select(F.md5("t").alias("id"), "vector", "risk_level", "service"), "knowledge")


def classify_with_kb(hits: DataFrame, kb: DataFrame | None = None, now: int = 0, embedder: Callable[[pd.Series], pd.Series] = hash_embed) -> DataFrame:
    """The whole live classifier: cascade, then pending rows by their nearest entry. [V34]

    Without a knowledge base the hits that the cascade settles stand in for one.
    The cascade's result is written once: its decisions are large expressions that a
    filter on the risk would otherwise evaluate again.
    """
    done = stage(v2.classify(hits, now, keep_prepared=True).drop("_refined", "_main"), "classified")
    settled = done.where(F.col("risk") != PENDING).withColumns({"kb_id": F.lit(None).cast("string"), "score": F.lit(-1.0)})
    pending = embedding_text(done.where(F.col("risk") == PENDING))
    kb = base_of_settled(done, embedder) if kb is None else kb
    found = nearest(embed(pending, "embedding_text", "vector", embedder), kb).withColumn("_post", post_process())
    resolved = found.withColumns({"risk": F.col("_post.risk"), "reason_code": F.col("_post.code")})
    columns = [*hits.columns, "risk", "reason_code", "variable", "kb_id", "score"]
    return settled.select(*columns).unionByName(resolved.select(*columns))
