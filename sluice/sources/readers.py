"""Readers of assets, manifests, rules and word lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import decode_fallback, decode_lossy
from sluice.staging import spread

# Fixed values that results depend on: extensions of binaries and media, the size limit, the manifest's format tag.
BINARY = ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp", "ico", "svg", "mp4", "mkv", "avi", "mov", "flv", "wmv", "webm", "mp3", "wav", "ogg", "flac",
          "aac", "zip", "tar", "gz", "rar", "7z", "bz2", "exe", "dll", "so", "bin", "apk", "woff", "woff2", "iso", "dat", "pak", "crx"]
SIZE_LIMIT = 10 << 20
MANIFEST_FORMAT = "sluice-scan/1"


def files(spark: SparkSession, path: str, size_limit: int | None = SIZE_LIMIT, skip: list[str] | None = None, glob: str | None = None, lossy: bool = True) -> DataFrame:
    """(file, text) of a folder and its subfolders, binaries skipped, sizes strictly below the limit. [S1, S2, S6, S7, S13]"""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    if size_limit is not None:
        raw = raw.where(F.col("length") < size_limit)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kept = raw.where(~ext.isin(BINARY if skip is None else skip)) if skip is None or skip else raw
    return kept.select(F.col("path").alias("file"), (decode_lossy if lossy else decode_fallback)(F.col("content")).alias("text"))


def listed(spark: SparkSession, list_path: str, root: str) -> DataFrame:
    """The files of ``root`` that a JSON array of paths names; anything but an array of texts is an error. [S3]"""
    read = spark.read.text(list_path, wholetext=True)
    fit = F.rlike("value", F.lit(r"^\s*\[")) & F.coalesce(~F.exists(F.from_json("value", "array<string>"), lambda x: x.isNull()), F.lit(False))
    names = read.select(F.explode(F.when(fit, F.from_json("value", "array<string>")).otherwise(F.raise_error(F.lit("not a JSON array of paths")))).alias("file"))
    return files(spark, root, None, []).join(names.distinct(), "file", "left_semi")


def gathered(*assets: DataFrame) -> DataFrame:
    """All assets, one row a file, of several that of the input named first; ``source_ord`` is the input's place. [S4]"""
    united = reduce(DataFrame.unionByName, [a.withColumn("source_ord", F.lit(k)) for k, a in enumerate(assets)])
    rest = [c for c in united.columns if c not in ("file", "source_ord")]
    first = united.groupBy("file").agg(F.min_by(F.struct("source_ord", *rest), "source_ord").alias("r"))
    return first.select("file", *[F.col(f"r.{c}").alias(c) for c in (*rest, "source_ord")])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, url, method, content_type, bytes) of a scan manifest; raises on another format or a path that leaves the root. [S5]"""
    read = spark.read.option("multiLine", True).json(path)
    entries = read.select("format", F.inline("files")).withColumn("path", F.when(
        (F.col("format") != MANIFEST_FORMAT) | F.startswith("path", F.lit("/")) | F.rlike("path", F.lit(r"(?:^|/)\.\.(?:/|$)")),
        F.raise_error(F.concat(F.lit("not a manifest entry: "), F.col("path")))).otherwise(F.col("path")))
    return entries.drop("format")


def manifest_assets(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, url) of the bodies that a scan manifest lists, and of no other file beside it; a missing body is an error. [S5]"""
    root = path.rstrip("/").rpartition("/")[0]
    found = files(spark, root, None, []).withColumn("__name", F.element_at(F.split("file", F.lit(re.escape(root.partition(":")[2] or root) + "/")), -1))
    joined = manifest(spark, path).select("path", "url").join(found, F.col("path") == F.col("__name"), "left")
    present = F.when(F.col("file").isNull(), F.raise_error(F.concat(F.lit("a body is missing: "), "path"))).otherwise(F.col("file"))
    return joined.select(present.alias("file"), "text", "url")


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, risk_level, service) of a JSONL knowledge base; rows without a vector are dropped. [S9]"""
    schema = ("id string, vector array<float>, service string, payload struct<service:string,original_full_json:struct<label:string,"
              "original_analysis:struct<risk_level:string,risk:string>>>")
    read = spark.read.schema(schema).json(path)
    risk = F.coalesce("payload.original_full_json.original_analysis.risk_level", "payload.original_full_json.original_analysis.risk", "payload.original_full_json.label")
    return read.where("size(vector) > 0").select("id", "vector", risk.alias("risk_level"), F.coalesce("service", "payload.service").alias("service"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a text list, trimmed, blanks dropped. [S10]"""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def suffixes(spark: SparkSession, path: str) -> list[str]:
    """The keys of a JSON object of learned key endings and their counts: a word list of some hundred entries. [S10, F5]"""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("suffix", "n"))
    return [r.suffix for r in read.orderBy(F.col("n").desc(), "suffix").collect()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets (file, text)."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("file"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
