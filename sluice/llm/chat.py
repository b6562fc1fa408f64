"""Cumulative-snapshot collapse and chat rendering, in DataFrame functions only.

Chat logs often hold one conversation many times, each time a few turns longer.
Every turn gets the rolling hash of its conversation up to it (128 bits: two
xor-accumulated hashes of position, role and text). A conversation whose last
rolling hash is that of an earlier turn in a longer conversation is a prefix of
it and goes; of conversations that are equal the one of least id stays. Only
maximal conversations are rendered.

Rolling hashes come from running sums in two levels, over chunks of CHUNK
positions and over the chunks' sums, so a hot conversation is many small groups.
Conversations are compared through one row for each distinct (length, hash), made
by partial aggregation, so thousands of equal ones meet in no single task.

Defined cases: turns are ordered by turn, then role, then text, nulls first;
repeated rows count as turns of their own; a null role or text differs from an
empty one when compared and is rendered as empty; rows with a null conversation id
form one conversation; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.staging import stage

#: Positions of one running sum.
CHUNK = 256
OPEN, SPEAK, CLOSE = "<|", "|>\n", "<|end|>\n"


def _cells(seed: int, *columns: Column) -> Column:
    """A hash that tells null from empty."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)])


def positions(turns: DataFrame) -> DataFrame:
    """``turns`` (id, turn, role, text) with ``pos`` from 1 within each id.

    The order is the sum of a chunk's own row number and the rows of the chunks
    before it; chunks are ranges of turn, so no task needs a whole conversation.
    """
    chunked = turns.withColumn("__chunk", F.floor(F.col("turn") / CHUNK).cast("long"))
    sizes = chunked.groupBy("id", "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
    by_id = Window.partitionBy("id").orderBy(F.col("__chunk").asc_nulls_first())
    before = sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(by_id.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("id", "__chunk").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    numbered = chunked.withColumn("__n", F.row_number().over(within))
    return (numbered.alias("a").join(before.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & F.col("a.__chunk").eqNullSafe(F.col("b.__chunk")))
            .select(F.col("a.id").alias("id"), "turn", "role", "text", (F.col("__before") + F.col("__n")).alias("pos")))


def rolling_hashes(placed: DataFrame) -> DataFrame:
    """(id, pos, h1, h2): the hash of each conversation up to each position."""
    cells = placed.select("id", "pos", F.floor(F.col("pos") / CHUNK).alias("__chunk"),
                          *[_cells(s, F.col("pos"), F.col("role"), F.col("text")).alias(f"c{s}") for s in (1, 2)])
    sums = cells.groupBy("id", "__chunk").agg(*[F.bit_xor(f"c{s}").alias(f"s{s}") for s in (1, 2)])
    by_id = Window.partitionBy("id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("id", "__chunk", *[F.coalesce(F.bit_xor(f"s{s}").over(by_id), F.lit(0)).alias(f"b{s}") for s in (1, 2)])
    within = Window.partitionBy("id", "__chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = cells.select("id", "__chunk", "pos", *[F.bit_xor(f"c{s}").over(within).alias(f"r{s}") for s in (1, 2)])
    return (rolled.alias("a").join(before.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.__chunk") == F.col("b.__chunk")))
            .select(F.col("a.id").alias("id"), "pos", *[F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"h{s}") for s in (1, 2)]))


def maximal(rolled: DataFrame) -> DataFrame:
    """(id, n_turns, n_same) of the conversations that prefix no longer one; n_same counts the equal ones."""
    lengths = rolled.groupBy("id").agg(F.max(F.struct("pos", "h1", "h2")).alias("end"))
    ends = lengths.select("id", F.col("end.pos").alias("pos"), F.col("end.h1").alias("h1"), F.col("end.h2").alias("h2"))
    firsts = ends.groupBy("pos", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_same"))
    seen = rolled.groupBy("pos", "h1", "h2").agg(F.count(F.lit(1)).alias("n_seen"))
    # a prefix hash that more conversations show than end at it belongs to a longer one
    inner = firsts.join(seen, ["pos", "h1", "h2"]).where(F.col("n_seen") > F.col("n_same")).select("pos", "h1", "h2")
    return firsts.join(inner, ["pos", "h1", "h2"], "left_anti").select("id", F.col("pos").alias("n_turns"), "n_same")


def render(turns: Column) -> Column:
    """One text from an ordered array of (pos, role, text)."""
    none = F.lit("")
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), F.coalesce(t["role"], none), F.lit(SPEAK), F.coalesce(t["text"], none), F.lit(CLOSE))), "")


def collapse_and_render(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, n_turns, n_same, rendered) of every maximal conversation."""
    turns = df.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    placed = stage(positions(turns), "turns")
    kept = stage(maximal(rolling_hashes(placed)), "maximal")
    shown = (placed.alias("t").join(kept.alias("k"), F.col("t.id").eqNullSafe(F.col("k.id")))
             .groupBy(F.col("t.id").alias(id_col))
             .agg(F.first("n_turns").alias("n_turns"), F.first("n_same").alias("n_same"),
                  F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")))
    return shown.select(id_col, "n_turns", "n_same", render(F.col("turns")).alias("rendered"))
