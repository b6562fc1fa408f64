"""The batch composition: rich scan, candidate filters, merging and labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import candidate, classify_v1, scan
from sluice.operators.rules import CATALOGUE, FACTORS, Rule
from sluice.staging import stage

#: Seconds that a file may take in a batch.
TIMEOUT = 300.0


def rich_hits(assets: DataFrame, rules: Iterable[Rule] = CATALOGUE, factors: dict[str, tuple[str, ...]] = FACTORS, learned: tuple[str, ...] = ()) -> DataFrame:
    """Hits of the rich scan: its gates and the key filter at every hit, then the reductions of the live scan. [D3]"""
    hits = scan.scan(assets, rules, most=scan.HIT_CAP, timeout=TIMEOUT)
    return scan.reduced(assets, stage(candidate.key_filter(scan.rich(hits), learned), "hits"), factors)


def filtered(hits: DataFrame, words: list[str], rules: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """Pattern and word filter, then the password filter over password rules alone, then one of similar hits. [F8, F15, F18, F19]"""
    return candidate.merge_similar(stage(candidate.drop_non_passwords(candidate.pattern_word_filter(hits, words, rules)), "filtered"))


def run(assets: DataFrame, words: list[str], kb: DataFrame, rules: tuple[Rule, ...] = CATALOGUE, factors: dict[str, tuple[str, ...]] = FACTORS,
        learned: tuple[str, ...] = (), now: int = 0) -> DataFrame:
    """Labelled hits of (file, text), without noise: rich scan, filters, labels by rules and knowledge base."""
    return classify_v1.label(stage(filtered(rich_hits(assets, rules, factors, learned), words, rules), "candidates"), kb, now)


def progress(assets: DataFrame, hits: DataFrame) -> DataFrame:
    """(file, n_hits) of every file of ``assets``: the log of a scan, one JSON object a line if written as such. [K4, K7]"""
    counts = hits.groupBy("file").agg(F.count(F.lit(1)).alias("n_hits"))
    return assets.select("file").distinct().join(counts, "file", "left").select("file", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
