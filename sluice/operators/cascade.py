"""Ordered decisions as one column. Order is the semantics: the first true test decides."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITICAL, POTENTIAL, NOISE, PENDING, UNMATCHED = "Critical", "Potential", "FalsePositive", "PendingVector", "Unmatched"


@dataclass(frozen=True)
class Decision:
    """If ``test`` holds, the class is ``risk``, for the stable reason ``code``."""

    code: str
    test: Column
    risk: str


def decide(decisions: list[Decision]) -> Column:
    """struct(risk, code) of the first decision whose test is true; null if none is."""
    start = F.when(F.coalesce(decisions[0].test, F.lit(False)), _made(decisions[0]))
    return reduce(lambda chain, d: chain.when(F.coalesce(d.test, F.lit(False)), _made(d)), decisions[1:], start)


def _made(decision: Decision) -> Column:
    return F.struct(F.lit(decision.risk).alias("risk"), F.lit(decision.code).alias("code"))
