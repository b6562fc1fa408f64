"""Corpus statistics over hits: where secrets leak and through what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import contains_any

# Fixed values that results depend on: path patterns of frameworks, keyword lists.
FRAMEWORKS = {
    "Next.js": r"/next/|next\.js|next\.config", "Nuxt.js": r"/nuxt/", "Gatsby": r"/gatsby/", "React": r"/react/|/rb-|-chunk-|chunk-|\.module\.",
    "Vue": r"/vue/|\.vue\.|/\?vue", "Angular": r"/ng-|angular|\.module\.", "Webpack": r"webpack|\.bundle\.", "Svelte": r"/svelte/",
    "TypeScript": r"\.ts\b|/tsc/|typescript", "Node.js": r"/node_modules/|\.cjs\.|\.mjs\.|yarnrc|package\.json", "Python": r"__pycache__/|\.pyc|\.py\b",
    "PHP": r"/vendor/|composer\.json|Laravel|/php/", "Ruby": r"\.rb\b|/vendor/bundle/|Gemfile", "Java": r"\.java\b|/target/|/build/",
    "Go": r"\.go\b|/vendor/", "Docker": r"Dockerfile|\.dockerignore|docker-compose", "Minified/Source Map": r"\.map$|source map",
    "Static HTML": r"\.html?$", "CSS/SCSS": r"\.css$|\.scss$|\.sass$", "Config JSON": r"\.json$", "Config YAML": r"\.ya?ml$|\.toml$",
    "Env files": r"\.env|\.envrc", "SVG": r"\.svg$", "Media": r"\.(png|jpg|jpeg|gif|webp|ico|woff|woff2|ttf|eot|mp4|mp3)$",
}
SDK_WORDS = ["PostHog", "Segment", "Amplitude", "Mixpanel", "Google_Analytics", "Google_YouTube", "Intercom", "CustomerIO", "Mailchimp", "Sentry", "Datadog",
             "NewRelic", "FullStory", "Hotjar", "Optimizely", "KISSmetrics", "Heap", "Adjust", "AppsFlyer", "Branch.io", "Facebook", "Twitter", "LinkedIn",
             "Stripe", "PayPal", "Algolia", "SearchIQ", "Sphinx", "Swiftype", "Elastic", "Mapbox", "Google_Maps", "Google", "Akamai", "Cloudflare", "Fastly",
             "Cloudfront", "Imgix", "Cloudinary", "SendGrid", "Mailgun", "SparkPost", "Twilio", "Nexmo", "Plivo", "Twilio", "Contentful", "Sanity", "Strapi",
             "Storyblok", "Blogger", "Disqus", "Sumo", "Olark", "Zendesk", "Hubspot", "Pipedrive", "Close.io", "Freshsales", "Chargebee", "Recurly", "Paymill",
             "Braintree", "Razorpay", "Paytm", "Float", "Deputy", "WorkBoard", "Aha", "ProductHunt", "Debounce", "Abstract", "Scraper", "Scraping", "Apify",
             "Crawlera", "Phantom", "Screenshot", "Blocksp", "Datafire", "Iron", "Glitch", "Render", "Netlify", "Vercel", "Heroku", "DigitalOcean", "Linode",
             "AWS", "Azure", "GCP", "Firebase", "Supabase", "Pusher", "Ably", "PubNub", "Firebase", "Clarifai", "Wit", "Microsoft", "IBM", "Nvidia",
             "Replicate", "OpenAI", "Cohere", "AI21", "Anthropic", "Hugging Face", "Deepgram", "AssemblyAI", "Speechmatics", "Rev", "Nuance", "OCR", "abbyy",
             "trainual"]
SERVER_WORDS = ["AWS Secret", "Azure Client Secret", "Private Key", "Jwt", "JWT", "Bearer", "Authorization", "OAuth", "Api Secret", "api_secret", "SecretKey",
                "secret_key", "Client Secret", "connection string", "conn_str", "Database", "Jdbc", "MongoDB", "Redis", "Postgres", "MySQL", "mssql", "oracle",
                "db_", "rds_", "mongo_", "S3 ", "s3_", "storage_account", "storage_key", "Slack", "Discord", "Telegram", "SMTP", "ssh_", "gcp_", "googleapis",
                "firebase_"]
CATEGORIES = {
    "Analytics/Product Analytics": ["Posthog API Key", "Segment", "Amplitude", "Mixpanel", "Heap", "Hotjar"],
    "Marketing/CRM": ["hubspot-api-key", "Intercom API Key", "CustomerIO API Key", "Mailchimp", "Zendesk", "Facebook"],
    "Cloud/Infrastructure": ["AWS", "Azure", "Google", "Firebase", "Cloudflare", "Fastly"],
    "Search": ["Algolia", "Elastic", "Swiftype", "SearchIQ", "Sphinx"],
    "Communication": ["Twilio", "Slack", "SendGrid", "Mailgun", "Discord", "Telegram"],
    "Payments": ["Razorpay", "Stripe", "PayPal", "Braintree", "Chargebee", "Paymill"],
    "Secret/Auth": ["jwt", "Azure Client Secret", "AWS API Secret", "discord-client-secret"],
    "DevOps/Hosting": ["Host API Key", "Heroku", "Netlify", "Vercel", "DigitalOcean"],
    "Content/CMS": ["Contentful", "Blogger", "Sanity", "Strapi"],
    "Maps/Geolocation": ["Mapbox", "Google_Maps"],
}


def samples(rules: DataFrame) -> DataFrame:
    """Rows of (rule_name, samples array) as one row a sample. [N1]"""
    return rules.select("rule_name", F.inline("samples"))


def domain(file: Column) -> Column:
    """The folder above the file, underscores as dots. [N2]"""
    raw = F.regexp_extract(file, "/([^/]+)/[^/]+$", 1)
    spelled = F.replace(F.replace(raw, F.lit("_io_"), F.lit(".io/")), F.lit("_com_"), F.lit(".com/"))
    return F.when(raw == "", "unknown").otherwise(F.regexp_replace(F.replace(spelled, F.lit("_"), F.lit(".")), "/+$", ""))


def extension(file: Column) -> Column:
    """[N2]"""
    ext = F.regexp_extract(F.regexp_replace(file, "#.*$", ""), r"\.([a-zA-Z0-9]+)(?:\.map)?$", 1)
    return F.when(ext == "", "no_ext").otherwise(F.lower(ext))


def fragment(file: Column) -> Column:
    """[N2]"""
    return F.nullif(F.lower(F.regexp_extract(file, "#([a-zA-Z0-9_-]+)$", 1)), F.lit(""))


def frameworks(file: Column) -> Column:
    """All families whose patterns a path shows. [N3]"""
    return F.array_compact(F.array(*[F.when(F.rlike(file, F.lit(f"(?i)(?:{p})")), name) for name, p in FRAMEWORKS.items()]))


def leak_context(file: Column, line: Column) -> Column:
    """Through what kind of file a secret leaks. [N4]"""
    low, ext, told = F.lower(file), extension(file), F.lower(F.left(F.coalesce(line, F.lit("")), F.lit(100)))
    script = contains_any(told, ["script", "<html", "{", "function", "window."])
    return (F.when(F.contains(low, F.lit(".map")) | F.contains(low, F.lit("source map")), "source_map")
            .when(((ext == "html") | F.contains(low, F.lit(".html"))) & script, "inline_html_script").when((ext == "html") | F.contains(low, F.lit(".html")), "static_html")
            .when((ext == "js") | F.contains(low, F.lit(".js")), "external_js").when(ext.isin("json", "jsonc"), "config_json").when(F.contains(low, F.lit("env")), "config_env")
            .when(ext.isin("css", "scss", "sass"), "css_embed").otherwise("other"))


def tagged(hits: DataFrame, line_col: str = "match") -> DataFrame:
    """``hits`` with domain, ext, context. [N2, N4]"""
    file = F.col("file")
    return hits.withColumns({"domain": domain(file), "ext": extension(file), "context": leak_context(file, F.col(line_col))})


def file_types(hits: DataFrame, top: int = 30) -> DataFrame:
    """(ext, n, percent) of the commonest. [N5]"""
    counts = hits.groupBy(extension(F.col("file")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("ext", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent")).orderBy(F.col("n").desc(), "ext").limit(top)


def top_rules(hits: DataFrame, by: str, k: int = 5, at_least: int = 1) -> DataFrame:
    """(by, rule_name, n) of the k commonest rules of each group with ``at_least`` hits. [N6, N7]"""
    counts = hits.groupBy(by, "rule_name").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("__total")).where(F.col("__total") >= at_least)
    ranked = counts.join(totals, by).withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "rule_name")))
    return ranked.where(F.col("__k") <= k).select(by, "rule_name", "n")


def rule_matrix(hits: DataFrame, columns: list[str], column: str = "ext") -> DataFrame:
    """rule_name with one count a value of ``column``. [N8]"""
    return hits.groupBy("rule_name").pivot(column, columns).agg(F.count(F.lit(1))).na.fill(0)


def drill_down(hits: DataFrame, context: str, k: int = 10) -> DataFrame:
    """The first distinct files of a context. [N9]"""
    return tagged(hits).where(F.col("context") == context).groupBy("file").agg(F.min("rule_name").alias("rule_name")).orderBy("file").limit(k)


def key_side(rule: Column) -> Column:
    """SDK/Public, Server/Secret or neither, if one list matches alone. [N10]"""
    low = F.lower(rule)
    sdk, server = (contains_any(low, [w.lower() for w in words]) for words in (SDK_WORDS, SERVER_WORDS))
    return F.when(sdk & ~server, "SDK/Public").when(server & ~sdk, "Server/Secret").otherwise("Ambiguous/Uncategorized")


def top_domains(hits: DataFrame, k: int = 20, rules: int = 5) -> DataFrame:
    """(domain, n, rules): the domains of most hits with their commonest rules as text. [N11]"""
    counts = hits.groupBy("domain", "rule_name").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("domain").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "rule_name"))).alias("r"))
    text = F.array_join(F.transform(F.slice("r", 1, rules), lambda x: F.concat(x["rule_name"], F.lit(":"), (-x["m"]).cast("string"))), ", ")
    return listed.select("domain", "n", text.alias("rules")).orderBy(F.col("n").desc(), "domain").limit(k)


def categories(hits: DataFrame) -> DataFrame:
    """(category, n_hits, n_domains) of business categories by rule name. [N12]"""
    named = reduce(lambda c, kv: c.when(F.col("rule_name").isin(kv[1]), kv[0]), CATEGORIES.items(), F.when(F.lit(False), ""))
    return hits.withColumn("category", named).where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("domain").alias("n_domains"))


def rollup(hits: DataFrame) -> DataFrame:
    """(series, rule_name, n) with subtotals. [N13]"""
    return hits.rollup("series", "rule_name").agg(F.count(F.lit(1)).alias("n"))
