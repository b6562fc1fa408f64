"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u points to the least of u and its neighbours. Small: so do the smaller ones and u."""
    if large:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); a component is named by its least id.

    Rows with a null end are no edges; repeated edges count once; an empty table gives
    an empty one. Rows are two numbers and meet by joins that AQE splits where an id has
    very many neighbours. Each round is written to the shared folder, so lineage stays short. Rounds end
    when the edges, compared by count and hash, no longer change.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, was = stage(ordered, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first()
        if mark == was or mark[0] == 0 or (mark[0] == mark[2] and not now.select("u").intersect(now.select("v")).head(1)):
            break  # nothing changed, or every id already points to its root
        was = mark
        grown = _star(now, True).where("u > v").distinct()
        now = stage(_star(grown, False).where("u > v").distinct(), "edges")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
