"""Collection-stage operators on pages and resources: urls, links, soft 404s, references, frontier."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.staging import stage

# Fixed values that results depend on: limits, directories, extensions, content types, probe paths, link and reference patterns.
MAX_PATH, MAX_DEPTH, MAX_REPEAT = 400, 12, 2
PACKAGE_DIRS = ["bower_components", "node_modules", "vendor", "packages", "jspm_packages", "web_modules"]
SKIPPED = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff", ".avif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp4", ".mp3", ".webm",
           ".ogg", ".wav", ".avi", ".mov", ".flac", ".aac", ".m4a", ".m4v", ".mkv", ".wmv", ".tga", ".exr", ".hdr", ".dds", ".ktx", ".exe", ".dll", ".so",
           ".dylib", ".bin", ".DS_Store", ".Thumbs.db"]
CONTENT_TYPES = [("javascript", ".js"), ("ecmascript", ".js"), ("/css", ".css"), ("/html", ".html"), ("/json", ".json"), ("application/ld+json", ".json"),
                 ("/xml", ".xml"), ("text/xml", ".xml"), ("/csv", ".csv"), ("wasm", ".wasm"), ("typescript", ".ts"), ("/svg", ".svg"),
                 ("application/rsc", ".rsc"), ("application/graphql", ".graphql"), ("application/protobuf", ".proto"), ("application/zip", ".zip"),
                 ("application/x-tar", ".tar"), ("application/gzip", ".gz"), ("text/x-sh", ".sh"), ("text/x-python", ".py"), ("text/x-php", ".php"),
                 ("text/plain", ".txt")]
RESOURCE_TYPES = {"script": ".js", "stylesheet": ".css", "document": ".html", "xhr": ".json", "fetch": ".json"}
LISTINGS = ["/tags/", "/tag/", "/category/", "/categories/", "/posts/", "/post/", "/blog/", "/articles/", "/article/", "/pages/", "/news/"]
CHUNK_PREFIXES = ["static/js/", "assets/", "_next/static/chunks/", ""]
PROBES_MANIFEST = ["/asset-manifest.json", "/build-manifest.json", "/manifest.json", "/_next/build-manifest.json", "/_next/react-loadable-manifest.json",
                   "/vite-manifest.json", "/.vite/manifest.json", "/static/js/asset-manifest.json", "/routes-manifest.json", "/prerender-manifest.json",
                   "/_next/static/_ssgManifest.js", "/_next/static/_buildManifest.js", "/nitro.json", "/_nuxt/builds/latest.json",
                   "/manifest.webmanifest", "/app.webmanifest", "/site.webmanifest"]
PROBES_HIGH = ["/.env", "/.env.local", "/.env.production", "/.env.development", "/.env.staging", "/.env.backup", "/.env.bak", "/.env.old", "/config.js",
               "/config.json", "/app-config.js", "/runtime-config.js", "/env.js", "/env.json", "/settings.js", "/app.config.js", "/config/database.yml",
               "/config/secrets.yml", "/config/credentials.yml", "/credentials.json", "/secrets.json", "/private.json", "/firebase-credentials.json",
               "/google-credentials.json", "/serviceAccountKey.json"]
PROBES_BUILD = ["/.git/config", "/.git/HEAD", "/.git/COMMIT_EDITMSG", "/.git/refs/heads/main", "/.git/refs/heads/master", "/.git/logs/HEAD",
                "/webpack.config.js", "/webpack.config.production.js", "/webpack.config.js.bak", "/vite.config.js", "/vite.config.ts", "/rollup.config.js",
                "/next.config.js", "/next.config.mjs", "/nuxt.config.js", "/babel.config.js", "/tsconfig.json", "/jsconfig.json", "/.DS_Store", "/Thumbs.db",
                "/package.json", "/package-lock.json", "/yarn.lock", "/pnpm-lock.yaml", "/.npmrc", "/.yarnrc", "/.yarnrc.yml", "/.npmrc.local", "/.nvmrc",
                "/.node-version", "/Dockerfile", "/docker-compose.yml", "/docker-compose.yaml", "/.dockerignore", "/.gitignore", "/Procfile", "/.travis.yml",
                "/.circleci/config.yml", "/.github/workflows/deploy.yml", "/main.js.map", "/app.js.map", "/index.js.map", "/bundle.js.map", "/vendor.js.map",
                "/runtime.js.map", "/index.html.bak", "/index.php.bak", "/config.js.bak", "/.env.bak", "/.env.old", "/.env.backup", "/config.json.bak",
                "/settings.json.bak", "/dist.zip", "/build.zip", "/source.zip", "/backup.zip", "/dist.tar.gz", "/www.tar.gz", "/schema.graphql", "/schema.gql",
                "/api.graphql", "/api.proto", "/service.proto", "/robots.txt", "/sitemap.xml", "/sitemap-index.xml", "/_buildManifest.js", "/_ssgManifest.js",
                "/routes-manifest.json", "/prerender-manifest.json", "/service-worker.js", "/sw.js", "/mockServiceWorker.js", "/firebase-messaging-sw.js",
                "/push-sw.js", "/llms.txt", "/feed.xml", "/rss.xml", "/atom.xml", "/llms-full.txt", "/decapcms/config.yml", "/admin/config.yml",
                "/netlify/config.yml", "/_cms/config.yml", "/pagefind/pagefind-entry.json", "/pagefind/pagefind.js", "/pagefind/pagefind-ui.js",
                "/pagefind/pagefind-ui.css", "/pagefind/pagefind-modular-ui.js", "/pagefind/pagefind-modular-ui.css", "/pagefind/pagefind-highlight.js",
                "/gulpfile.js", "/Gruntfile.js", "/gruntfile.js", "/server.js", "/app.js", "/index.js", "/main.js", "/cypress.json", "/cypress.config.js",
                "/cypress.config.ts", "/jest.config.js", "/jest.config.ts", "/vitest.config.js", "/playwright.config.js", "/playwright.config.ts",
                "/bower.json", "/.bowerrc", "/learn.html", "/demo.html", "/example.html", "/examples.html", "/404.html", "/500.html", "/error.html",
                "/offline.html", "/static/development/_buildManifest.js", "/static/development/_ssgManifest.js", "/cache/next-devtools-config.json",
                "/cache/config.json", "/static/chunks/app/not-found.js", "/static/chunks/app/sitemap.xml/route.js", "/static/chunks/app/robots.txt/route.js",
                "/react-loadable-manifest.json", "/app-build-manifest.json", "/build-manifest.json", "/learn.json", "/learn.template.json", "/data.json",
                "/config.yml", "/config.yaml"]
PROBES_DEBUG = ["/api/health", "/api/status", "/api/version", "/health", "/status", "/version", "/_health", "/__health", "/actuator", "/actuator/health",
                "/actuator/env", "/actuator/info", "/debug", "/debug/vars", "/__debug__", "/__webpack_hmr", "/__vite_pong", "/@vite/client",
                "/_next/webpack-hmr", "/webpack-dev-server", "/graphql", "/graphql/schema.json", "/api/graphql", "/api", "/api/v1", "/api/v2", "/api/config",
                "/api/env", "/api/settings", "/old", "/backup", "/temp", "/tmp", "/test", "/admin", "/wp-admin", "/phpmyadmin"]


@dataclass(frozen=True)
class Preset:
    """Depth, pages and probe sizes of a crawl. [C28]"""

    depth: int
    pages: int
    build: int
    debug: int


def preset(name: str, **overrides: int) -> Preset:
    """A preset with some of its values replaced. [C28]"""
    return replace(PRESETS[name], **{k: v for k, v in overrides.items() if v is not None})


PRESETS = {"full": Preset(3, 120, len(PROBES_BUILD), len(PROBES_DEBUG)), "balanced": Preset(2, 30, 60, 20), "lite": Preset(1, 15, 25, 0)}

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def normalized(url: Column) -> Column:
    """struct(url, error): http(s) with a host, no userinfo, a port in range; empty path as /, no fragment. [C1]"""
    host = F.regexp_replace(netloc(url), r":[^:\]]*$", "")
    port = F.regexp_extract(netloc(url), r":([^:\]]*)$", 1)
    bad_port = (port != "") & (~F.rlike(port, F.lit("^[0-9]{1,5}$")) | (F.coalesce(F.try_to_number(port, F.lit("99999")), F.lit(0)) > 65535))
    error = (F.when(url.isNull() | ~scheme(url).isin("http", "https"), "scheme").when(F.contains(netloc(url), F.lit("@")), "userinfo")
             .when(host == "", "host").when(bad_port, "port"))
    made = F.concat(scheme(url), F.lit("://"), netloc(url), F.when(path(url) == "", "/").otherwise(path(url)), F.regexp_extract(url, _PARTS, 4))
    return F.struct(F.when(error.isNull(), made).alias("url"), error.alias("error"))


def directory_key(url: Column) -> Column:
    """[C2]"""
    return F.concat(F.regexp_replace(netloc(url), "[^A-Za-z0-9._-]", "_"), F.lit("_"), F.substr(F.sha2(url, 256), F.lit(1), F.lit(12)))


def identity(url: Column) -> Column:
    """Scheme, host and path. [C3]"""
    return F.regexp_replace(url, r"[?#].*$", "")


def is_valid(url: Column) -> Column:
    """The crawler-trap guard. [C4]"""
    segments = F.filter(F.transform(F.split(path(url), "/"), F.lower), lambda s: s != "")
    distinct = F.array_distinct(segments)
    times = lambda s: F.size(F.filter(segments, lambda x: x == s))
    trap = F.exists(distinct, lambda s: (s.isin(PACKAGE_DIRS) & (times(s) >= 2)) | (times(s) > MAX_REPEAT))
    return (F.length(path(url)) <= MAX_PATH) & (F.size(segments) <= MAX_DEPTH) & ~trap


def file_name(url: Column, resource_type: Column) -> Column:
    """[C5]"""
    last = F.element_at(F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/"), -1)
    named = F.when(last == "", F.concat(resource_type, F.lit("_index"))).otherwise(last)
    return F.left(F.regexp_replace(named, "[^A-Za-z0-9._-]", "_"), F.lit(200))


def extension(url: Column, content_type: Column, resource_type: Column) -> Column:
    """The extension a resource is kept under; empty to skip it. [C6]"""
    last = F.regexp_extract(F.regexp_replace(url, r"^.*/", ""), r"^([^?]*)", 1)
    own = F.lower(F.regexp_extract(last, r"(\.[^.]*)$", 1))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    typed = reduce(lambda c, kv: c.when(F.contains(kind, F.lit(kv[0])), kv[1]), CONTENT_TYPES[1:], F.when(F.contains(kind, F.lit(CONTENT_TYPES[0][0])), CONTENT_TYPES[0][1]))
    fallback = reduce(lambda c, kv: c.when(resource_type == kv[0], kv[1]), RESOURCE_TYPES.items(), F.when(F.lit(False), ""))
    return F.when(F.contains(last, F.lit(".")), F.when(own.isin(SKIPPED), "").otherwise(own)).otherwise(F.coalesce(typed, fallback, F.lit("")))


def soft_404(resources: DataFrame, landing: DataFrame) -> DataFrame:
    """``resources`` (site, url, status, content_type, resource_type, content) with is_soft_404, reason and spa_shell. [C7-C9]

    ``landing`` has (site, landing_hash, landing_size), one row a site.
    """
    joined = resources.join(landing, "site", "left")
    kind, own = F.lower(F.coalesce("content_type", F.lit(""))), F.regexp_extract(path(F.col("url")), r"\.([A-Za-z0-9]+)$", 1)
    html = F.contains(kind, F.lit("text/html"))
    html_path = (own == "") | F.lower(own).isin("html", "htm", "php", "asp", "aspx", "jsp")
    mismatch = (F.col("status") == 200) & html & ~html_path
    same = F.col("landing_hash").isNotNull() & (F.md5(F.col("content")) == F.col("landing_hash"))
    near = F.col("landing_hash").isNull() & F.col("landing_size").isNotNull() & (F.abs(F.octet_length("content") - F.col("landing_size")) <= 50)
    shell = same & (F.col("resource_type") == "document") & html_path & ~mismatch
    reason = F.when(mismatch, "type_mismatch").when(same & ~shell, "landing_hash").when(near & html, "landing_size")
    return joined.withColumns({"soft_404_reason": reason, "is_soft_404": reason.isNotNull(), "spa_shell": shell}).drop("landing_hash", "landing_size")


# Fixed values that results depend on: the patterns of links and, below, of references.
_LINKS = [("script", r"""(?i)<script[^>]+src=["']((?!data:)[^"']+)["']"""), ("stylesheet", r"""(?i)<link[^>]+rel=["']stylesheet["'][^>]*href=["']((?!data:)[^"']+)["']"""),
          ("icon", r"""(?i)<link[^>]+rel=["'][^"']*(?:shortcut\s+)?icon[^"']*["'][^>]*href=["']((?!data:)[^"']+)["']"""),
          ("manifest", r"""(?i)<link[^>]+rel=["'][^"']*manifest[^"']*["'][^>]*href=["']((?!data:)[^"']+)["']"""),
          ("nomodule", r"""(?i)<script[^>]+nomodule[^>]*src=["']((?!data:)[^"']+)["']"""), ("import", r"""(?i)<link[^>]+rel=["']import["'][^>]*href=["']((?!data:)[^"']+)["']"""),
          ("page", r"""(?i)<a\s[^>]*href=["']((?![#?])[^"']+)["']""")]
PAGE_KINDS = ["manifest", "import", "page"]


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, kind, href) of every link in (page_id, url, html). [C18]"""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("href")))

    return pages.select("page_id", "url", F.inline(F.concat(*[of(k, p) for k, p in _LINKS])))


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href)], dtype=object)


@F.pandas_udf(T.StringType())
def _unescaped(href: pd.Series) -> pd.Series:
    return href.map(lambda h: None if h is None else unescape(h))


def resolve(links: DataFrame, base_col: str = "url") -> DataFrame:
    """``links`` with target: the href as an absolute url of the same host, or null. [C19]"""
    base = F.col(base_col)
    links = links.where(F.contains("href", F.lit("&")) | F.col("href").isNull()).withColumn("__href", _unescaped(F.col("href"))).unionByName(
        links.where(~F.contains("href", F.lit("&"))).withColumn("__href", F.col("href")))
    bare = F.regexp_replace(F.trim("__href"), r"[?#].*$", "")
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    absolute = F.when(F.startswith(bare, F.lit("//")), F.concat(scheme(base), F.lit(":"), bare)).otherwise(bare)
    dropped = (bare == "") | F.rlike(bare, F.lit("^(mailto:|javascript:|data:)"))
    rooted = F.startswith(bare, F.lit("/")) & ~F.startswith(bare, F.lit("//"))
    whole = F.startswith(absolute, F.lit("http"))
    simple = F.when(dropped, F.lit(None)).when(rooted, F.concat(origin, bare)).when(whole, F.when(netloc(absolute) == netloc(base), absolute))
    direct = links.where(dropped | rooted | whole).withColumn("target", simple)
    relative = links.where(~(dropped | rooted | whole)).withColumn("target", _joined(F.concat(F.regexp_replace(base, r"[^/]*$", "")), bare))
    both = direct.unionByName(relative).drop("__href")
    return both.withColumn("target", F.when(is_valid(F.col("target")), F.col("target")))


_REFS = {
    "source_map": ("right(text, 1024)", [r"//# sourceMappingURL=([^\s]+)"]),
    "css_source_map": ("right(text, 512)", [r"/\*# sourceMappingURL=([^\s*]+)"]),
    "chunk": ("text", [r"""["']([a-f0-9]{8,16}\.chunk\.js)["']""", r"""["'](?:\./|/)?(chunk-[A-Za-z0-9_\-]+\.js)["']"""]),
    "dynamic_import": ("text", [r"""import\(["'](\./[^"']+\.(?:js|mjs))["']"""]),
    "i18n": ("text", [r"""["']([^"']*(?:locale|locales|i18n|lang|languages?|translations?|nls)/[^"']+\.json)["']""", r"""["']([^"']*[/\\][a-z]{2}(?:-[A-Z]{2})?\.json)["']"""]),
    "service_worker": ("text", [r"""serviceWorker\.register\s*\(\s*["']([^"']+)["']""", r"""importScripts\s*\(["']([^"']+)["']\)"""]),
    "wasm": ("text", [r"""import\s+[^"']+\s+from\s+["']([^"']+\.wasm)["']""", r"""import\(\s*["']([^"']+\.wasm)["']\s*\)""", r"""new\s+URL\(\s*["']([^"']+\.wasm)["']\s*,\s*import\.meta\.url\s*\)""", r"""["']([^"']+\.wasm)["']"""]),
    "css_url": ("text", [r"""url\(["']?([^"')\s]+)["']?\)"""]),
}


def references(assets: DataFrame) -> DataFrame:
    """(file, kind, ref) of the references in (file, text) scripts and styles. [C10-C17]"""
    each = []
    for kind, (where, patterns) in _REFS.items():
        found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.expr(where), F.lit(p), F.lit(1)) for p in patterns])))
        if kind.endswith("source_map"):
            found = F.slice(found, 1, 1)
        bare = F.transform(found, lambda r: F.regexp_extract(F.trim(r), r"^([^?]*)", 1))
        if kind == "css_url":
            bare = F.filter(bare, lambda r: ~F.startswith(r, F.lit("data:")) & ~F.lower(F.regexp_extract(r, r"(\.[^./]*)$", 1)).isin(SKIPPED))
        each.append(_tagged(bare, kind))
    return assets.select("file", F.inline(F.concat(*each)))


def _tagged(refs: Column, kind: str) -> Column:
    return F.transform(F.filter(refs, lambda r: r != ""), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))


def chunk_urls(refs: DataFrame, public_path: str = "") -> DataFrame:
    """Candidates of chunk references under the usual prefixes. [C12]"""
    prefixes = F.explode(F.array(*[F.lit(p) for p in [public_path, *CHUNK_PREFIXES]]))
    return refs.where("kind = 'chunk'").withColumn("prefix", prefixes).withColumn("candidate", F.concat("prefix", "ref"))


def ssr_findings(pages: DataFrame) -> DataFrame:
    """Server-rendered state in (page_id, url, html): type, frame, snippet. [C20]"""
    next_ = F.regexp_extract("html", r"""(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>""", 1)
    nuxt = F.regexp_extract("html", r"(?s)window\.__NUXT__\s*=\s*(\{.+?\})\s*;", 1)
    alpine = F.slice(F.regexp_extract_all("html", F.lit(r"""x-data=["'](\{[^"']{15,})["']"""), F.lit(1)), 1, 3)
    row = lambda kind, frame, s: F.struct(F.lit(kind).alias("type"), F.lit(frame).alias("frame"), s.alias("snippet"))
    found = F.array(F.when(next_ != "", row("SSR_DATA_INJECTION", "Next.js", F.left(next_, F.lit(500)))), F.when(nuxt != "", row("SSR_DATA_INJECTION", "Nuxt.js", F.left(nuxt, F.lit(500)))),
                    F.when(F.size(alpine) > 0, row("INLINE_LOGIC", "Alpine.js", F.array_join(alpine, "\n"))))
    return pages.select("page_id", "url", F.inline(F.array_compact(found)))


def json_urls(assets: DataFrame, depth: int = 6) -> DataFrame:
    """(file, ref) of path-like strings within ``depth`` levels of (file, text) JSON. [C21]"""
    import json

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def walk(texts: pd.Series) -> pd.Series:
        def leaves(value, left):
            if left < 0:
                return
            if isinstance(value, str):
                if value.startswith(("/", "./", "http")) or ".wasm" in value:
                    yield value
            elif isinstance(value, dict):
                for v in value.values():
                    yield from leaves(v, left - 1)
            elif isinstance(value, list):
                for v in value:
                    yield from leaves(v, left - 1)

        def one(text):
            try:
                return list(dict.fromkeys(leaves(json.loads(text), depth)))
            except (TypeError, ValueError, RecursionError):
                return []

        return texts.map(one)

    return assets.select("file", F.explode(walk("text")).alias("ref"))


SITEMAPS = ["/sitemap-index.xml", "/sitemap.xml", "/sitemap-0.xml"]
SITEMAP_DEPTH = 2


def sitemap_urls(fetched: DataFrame) -> DataFrame:
    """(site, url): the pages named by the sitemaps of each site in (site, url, text), fetched files by their address. [C22]

    Of the usual places the first that leads to a page counts. Locations that end in
    ``.xml`` are sitemaps in turn, followed ``SITEMAP_DEPTH`` levels down; other hosts'
    locations are left out; a page is named once.
    """
    locations = fetched.select("site", F.col("url").alias("of"), F.explode(F.regexp_extract_all("text", F.lit(r"<loc>\s*(https?://[^\s<]+)\s*</loc>"), F.lit(1))).alias("loc"))
    found = stage(locations.withColumn("loc", F.regexp_extract("loc", r"^([^?]*)", 1)).where(netloc(F.col("loc")) == F.col("site")).distinct(), "locations")
    nested = F.endswith(F.lower("loc"), F.lit(".xml"))
    rank = F.array_position(F.array(*[F.lit(p) for p in SITEMAPS]), path(F.col("of")))
    level = found.withColumn("rank", rank).where("rank > 0").select("site", "rank", "loc")
    pages = level.where(~nested)
    for _ in range(SITEMAP_DEPTH):
        level = (level.where(nested).join(found.withColumnRenamed("loc", "inner"), ["site"]).where(F.col("of") == F.col("loc"))
                 .select("site", "rank", F.col("inner").alias("loc")).distinct())
        pages = pages.unionByName(level.where(~nested))
    first = pages.groupBy("site").agg(F.min("rank").alias("rank"))
    chosen = pages.join(first, ["site", "rank"]).select("site", F.col("loc").alias("url"))
    return chosen.groupBy("site", identity(F.col("url")).alias("__id")).agg(F.min("url").alias("url")).select("site", "url")


def manifest_urls(fetched: DataFrame) -> DataFrame:
    """(site, kind, url) of what a framework's build manifest leads to, for (site, url, text) JSON bodies. [C25]

    A Nuxt ``latest.json`` names one build's metadata; a Pagefind entry names its files,
    of each list the first twenty.
    """
    origin = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    build = F.coalesce(F.nullif(F.get_json_object("text", "$.id"), F.lit("")), F.get_json_object("text", "$.buildId"))
    nuxt = (fetched.where(F.contains("url", F.lit("/_nuxt/builds/latest.json"))).withColumn("__b", build).where("length(__b) > 0")
            .select("site", F.lit("nuxt").alias("kind"), F.concat(origin, F.lit("/_nuxt/builds/meta/"), "__b", F.lit(".json")).alias("url")))
    each = []
    for key in PAGEFIND_KEYS:
        raw = F.get_json_object("text", f"$.{key}")
        several = F.slice(F.from_json(raw, "array<string>"), 1, 20)
        each.append(F.coalesce(F.when(F.startswith(raw, F.lit("[")), several), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>")))
    entry = fetched.where(F.contains("url", F.lit("/pagefind/pagefind-entry.json")))
    named = entry.select("site", F.lit("pagefind").alias("kind"), F.concat(origin, F.lit("/pagefind/")).alias("__base"), F.explode(F.concat(*each)).alias("__ref"))
    return nuxt.unionByName(named.select("site", "kind", _joined("__base", "__ref").alias("url")))


PAGEFIND_KEYS = ["wasm_url", "index_chunks", "filter_chunks", "search_chunks", "ranking_chunks"]


def frontier(edges: DataFrame, seeds: DataFrame, depth: int = 3, pages: int | None = None) -> DataFrame:
    """(url, depth) of the pages reached from (url) seeds over (src, dst) edges within ``depth`` steps. [C23]

    A page under a listing prefix passes its links on one step deeper than others. Each
    step is an anti-join with what was seen; a page budget keeps the nearest, listings
    first, then by url.
    """
    listing = lambda u: F.rlike(path(u), F.lit("^(?:" + "|".join(LISTINGS) + ")"))
    seen = stage(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    last = seen
    for d in range(1, depth + 2):
        giving = last if d <= depth else last.where(listing(F.col("url")))
        reached = edges.join(giving, edges["src"] == giving["url"]).select(F.col("dst").alias("url")).distinct()
        last = stage(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if not last.head(1):
            break
        seen = seen.unionByName(last)
    return seen.orderBy("depth", (~listing(F.col("url"))).cast("int"), "url").limit(pages) if pages is not None else seen


def probe_plan(sites: DataFrame, mode: str = "full") -> DataFrame:
    """(site, path, tier, rank) of the probes of each site; the paths are literals, exploded, not joined. [C24]"""
    preset = PRESETS[mode]
    tiers = [("manifest", PROBES_MANIFEST), ("high", PROBES_HIGH), ("build", PROBES_BUILD[:preset.build]), ("debug", PROBES_DEBUG[:preset.debug])]
    rows = [F.struct(F.lit(p).alias("path"), F.lit(t).alias("tier"), F.lit(k + 1).alias("rank")) for t, paths in tiers for k, p in enumerate(paths)]
    return sites.select("site", F.inline(F.array(*rows)))


def crawl_stats(resources: DataFrame) -> DataFrame:
    """(resource_type, status, method, n, bytes): one row a type, a status, a method, and in all. [C27]"""
    kinds = [F.col(c) for c in ("resource_type", "status", "method")]
    return resources.groupingSets([[k] for k in kinds] + [[]], *kinds).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


def payloads(resources: DataFrame, target: str) -> DataFrame:
    """The bodies worth scanning: saved inside ``target``, no soft 404, text, once each. [S14]"""
    head = F.substring("content", 1, 8192)
    nul = F.contains(F.hex(head), F.lit("00")) & F.rlike(F.hex(head), F.lit("^(?:..)*?00"))
    cut = F.greatest(*[F.when(F.is_valid_utf8(F.substring("content", 1, 8192 - k).cast("string")), 1).otherwise(0) for k in range(4)]) == 1
    whole = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(F.octet_length("content") <= 8192, whole).otherwise(cut)
    kept = resources.where(F.col("saved_path").isNotNull() & ~F.coalesce("is_soft_404", F.lit(False)) & F.startswith("saved_path", F.lit(target)) & ~nul & text)
    first = Window.partitionBy("saved_path").orderBy("index")
    return kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def site_status(results: DataFrame) -> DataFrame:
    """(site, status, n_files): ok, timeout, error or empty. [C29]"""
    status = F.when(F.max(F.col("timed_out").cast("int")) == 1, "timeout").when(F.max(F.col("error").isNotNull().cast("int")) == 1, "error").when(F.count("path") == 0, "empty").otherwise("ok")
    return results.groupBy("site").agg(status.alias("status"), F.count("path").alias("n_files"))


def sites_of(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Distinct urls of a text list without blanks and comments. [S12]"""
    return lines.select(F.trim("value").alias("url")).where("url <> '' AND NOT startswith(url, '#')").dropDuplicates(["url"])
