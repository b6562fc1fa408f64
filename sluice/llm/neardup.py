"""Near-duplicate documents by MinHash bands, odd sketches and exact verification.

Documents are sets of distinct five-word shingles; two are linked if their sets'
Jaccard similarity is at least 0.75, and a group is a connected component.

1. One pass gives each document its set's size and 128-bit key, BANDS band hashes
   of ROWS MinHash values, an odd sketch (its MinHash samples folded into a 256-bit
   parity bitmap) and the parities of its full set over 1,024 cells. Equal sets are
   one class, represented by its least id.
2. Band buckets with several classes are kept. A pair is a candidate if its sizes
   allow the similarity, the population count of its sketches' exclusive or is at
   most FAR, and that of the full sets' parities is at most a seventh of both sizes:
   it never exceeds the symmetric difference, so this rule loses nothing.
3. Candidates are verified on the full sets, in three rounds: each class against
   the least candidate class of its buckets; then, with the components so far,
   each class against its closest candidate in every other component that shares
   a bucket; then against all candidates that are still in other components. Pairs
   within a component are never enumerated, so a group of n copies costs about n.

Only (id, band) rows are dealt by band, buckets of more than HOT classes by a
broadcast of their leaders; what is known of a class is joined by its id. In the
later rounds a bucket is cut into blocks of BLOCK classes, each a group of its own.

With 32 bands of 3 rows a pair at 0.75 shares no bucket with probability 2.4e-8. At
0.75 sketches differ in 40 +- 7 bits; tests measure both on pairs at the threshold.

Defined cases: null text or text without words has the empty set, is linked with
nothing and kept; a null id is linked with nothing; rows repeated whole (same id,
same text) are one document shown as often as it came; ids are otherwise unique;
texts of any length are shingled whole, in tiles; the result has the four columns
named below only, whatever the input's other columns are called; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.arrow import bound_batches, with_columns
from sluice.llm.components import components
from sluice.llm.shingles import U, mix, shingle_sets
from sluice.staging import stage

BANDS, ROWS = 32, 3
WORDS = 5
#: Bits that two sketches may differ in: samples 2 * 96 * (1 - 0.75) = 48 differ on average, which sets 40 +- 7 bits.
FAR = 90
NUMERATOR, DENOMINATOR = 3, 4
PARITY_WORDS = 16
#: Up to so many candidate classes are broadcast to fetch their texts; more are joined.
MAX_BROADCAST_IDS = 2_000_000
#: Buckets with more classes are met by a broadcast, up to so many of them; the others by a shuffle.
HOT, MAX_BROADCAST_BUCKETS = 2_000, 500_000
#: Classes of a bucket that meet in one group.
BLOCK = 1_024

_rng = np.random.default_rng(75)
_XOR, _MUL = (_rng.integers(0, 2**63, BANDS * ROWS).astype(U) * U(2) + U(1) for _ in range(2))
_BAND = _rng.integers(1, 2**63, ROWS + 1).astype(U) * U(2) + U(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS * ROWS minima of each non-empty set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS * ROWS), U)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat((joined ^ _XOR[i]) * _MUL[i], starts)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    cells = samples.reshape(-1, BANDS, ROWS)
    return mix((cells * _BAND[:ROWS]).sum(2) + (np.arange(BANDS).astype(U) + U(1)) * _BAND[ROWS])


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parities of 256 cells over the samples, as four words."""
    cells = mix(samples + np.arange(samples.shape[1]).astype(U) * U(0x9E3779B97F4A7C15)) & U(255)
    out, rows = np.zeros((len(samples), 4), U), np.arange(len(samples))
    for i in range(samples.shape[1]):
        out[rows, (cells[:, i] >> U(6)).astype(int)] ^= U(1) << (cells[:, i] & U(63))
    return out


def estimate(sketch_a: np.ndarray, sketch_b: np.ndarray, samples: int = BANDS * ROWS, bits: int = 256) -> float:
    """Similarity that two sketches suggest."""
    z = min(int(np.bitwise_count(sketch_a ^ sketch_b).sum()), bits // 2 - 1)
    return 1 + bits / (4 * samples) * float(np.log(1 - 2 * z / bits))


def parities(tokens: np.ndarray) -> np.ndarray:
    """Parities of a whole set over 64 * PARITY_WORDS cells."""
    cells = np.bincount((mix(tokens) % U(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8")


def _sign(texts: list[str | None]) -> list[list]:
    sets = shingle_sets(texts, WORDS)
    full = [k for k, s in enumerate(sets) if len(s)]
    empty = np.zeros(0, np.int64)
    band, sketch, parity = [empty] * len(sets), [empty] * len(sets), [empty] * len(sets)
    if full:
        samples = minhashes([sets[k] for k in full])
        for k, b, o in zip(full, bands(samples).view(np.int64), odd_sketches(samples).view(np.int64)):
            band[k], sketch[k], parity[k] = b, o, parities(sets[k])
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return [[len(s) for s in sets], keys, band, sketch, parity]


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n, key, bands, sketch, parity) of (id, text)."""
    longs = T.ArrayType(T.LongType())
    kinds = {"n": T.LongType(), "key": T.BinaryType(), "bands": longs, "sketch": longs, "parity": longs}
    return with_columns(docs.select("id", "text"), ["text"], kinds, lambda: _sign).drop("text")


def _differ(a: str, b: str, column: str, words: int) -> Column:
    """Bits in which two sides' bitmaps differ."""
    each = [F.bit_count(F.get(F.col(f"{a}.{column}"), i).bitwiseXOR(F.get(F.col(f"{b}.{column}"), i))) for i in range(words)]
    return sum(each[1:], each[0])


def _close(a: str, b: str) -> Column:
    """Whether the sizes and bitmaps of two sides leave 0.75 possible."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return ((DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m))
            # a link leaves a symmetric difference of (1 - t) / (1 + t) of both sizes at most
            & ((NUMERATOR + DENOMINATOR) * _differ(a, b, "parity", PARITY_WORDS) <= (DENOMINATOR - NUMERATOR) * (n + m))
            & (_differ(a, b, "sketch", 4) <= FAR))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (a, b) whose sorted sets x and y are similar enough."""
    for batch in batches:
        sides = [(c.offsets.to_numpy(), c.values.to_numpy().view(U)) for c in (batch.column("x"), batch.column("y"))]
        (xs, x), (ys, y) = sides
        good = []
        for k in range(batch.num_rows):
            p, q = x[xs[k]:xs[k + 1]], y[ys[k]:ys[k + 1]]
            if len(q) < len(p):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum())
            if DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both):
                good.append(k)
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are linked."""
    bound_batches(pairs.sparkSession)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_linked, pairs.select("a", "b").schema)


def _tokens(texts: list[str | None]) -> list[list]:
    return [[s.view(np.int64) for s in shingle_sets(texts, WORDS)]]


def _few(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def _sets_of(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(id, tokens): the sorted shingle hashes of the classes in ``ids``."""
    chosen = docs.select("id", "text").join(ids, "id", "left_semi")
    sets = with_columns(chosen, ["text"], {"tokens": T.ArrayType(T.LongType())}, lambda: _tokens).drop("text")
    return sets.dropDuplicates(["id"]) if repeated else sets


def _buckets(reps: DataFrame, hot: int) -> DataFrame:
    """(id, band, leader, c) of the classes in buckets of several; c classes, of which leader is the least."""
    dealt = stage(reps.select("id", F.explode("bands").alias("band")), "bands")
    shared = stage(dealt.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("leader")).where("c > 1"), "buckets")
    large = shared.where(F.col("c") > hot)
    n = large.limit(MAX_BROADCAST_BUCKETS + 1).count()
    if n > MAX_BROADCAST_BUCKETS:
        return stage(dealt.join(shared, "band"), "shared")
    found = dealt.join(shared.where(F.col("c") <= hot), "band")
    return stage(found.unionByName(dealt.join(F.broadcast(large), "band")) if n else found, "shared")


def _across(crossed: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Candidates (x, y, c) of different components in a bucket; c is the component of y.

    A class outside its bucket's main component meets all classes of other components;
    two such meet once. The bucket's classes are dealt to blocks by id, and each class
    outside the main component goes to all blocks.
    """
    known = members.select("id", F.struct("n", "sketch", "parity").alias("m"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    small = crossed.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    every = crossed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    s, o = (df.select("id", "band", "block", "component", "main").join(known, "id").alias(a) for df, a in ((small, "s"), (every, "o")))
    met = s.join(o, (F.col("s.band") == F.col("o.band")) & (F.col("s.block") == F.col("o.block")) & (F.col("s.component") != F.col("o.component"))
                 & ((F.col("o.component") == F.col("o.main")) | (F.col("s.id") < F.col("o.id"))) & _close("s.m", "o.m"))
    return met.select(F.col("s.id").alias("x"), F.col("o.id").alias("y"), F.col("o.component").alias("c"))


def _classes(docs: DataFrame, max_broadcast: int, hot: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows (staged), and (id, component) of the classes that are linked with another."""
    signed = stage(signatures(docs), "signatures")
    least = F.min(F.struct("id", "n", "bands", "sketch", "parity")).alias("r")
    reps = stage(signed.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(least).select("r.*"), "classes")
    found = _buckets(reps, hot)
    ids = stage(found.select("id").distinct(), "candidates")
    if not ids.head(1):
        return signed, ids.select("id", F.col("id").alias("component"))
    chosen = _few(ids, max_broadcast)
    members = stage(reps.join(chosen, "id", "left_semi").drop("bands"), "members")
    repeated = bool(signed.select("id").join(chosen, "id", "left_semi").groupBy("id").count().where("count > 1").head(1))
    sets = stage(_sets_of(docs, chosen, repeated), "sets")

    met = found.where("id <> leader").select("id", "leader").distinct()
    first = (met.join(members.alias("m"), "id").join(members.withColumnRenamed("id", "leader").alias("h"), "leader").where(_close("m", "h"))
             .groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"))
    links = stage(verify(first, sets), "links")
    tried = None
    for last in (False, True):
        label = stage(components(links), "components")
        at = found.select("id", "band").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        at = stage(at, "labelled")
        sizes = at.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"))
        mixed = (sizes.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("size"), F.max(F.struct("c", "component"))["component"].alias("main"))
                 .where("k > 1").select("band", "size", "main"))
        near = _across(stage(at.join(mixed, "band"), "crossed"), members, block)
        if last:
            pairs = near.select("x", "y")
        else:
            pairs = near.groupBy("x", "c").agg(F.min("y").alias("y")).select("x", "y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, "pairs")
        if not pairs.head(1):
            return signed, label
        tried = pairs
        links = links.union(stage(verify(pairs, sets), "links"))
    return signed, stage(components(links), "components")


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_IDS,
          hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of ``df``."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed, label = _classes(docs, max_broadcast, hot, block)
    reps = signed.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"))
    named = stage(reps.join(label, reps["rep"] == label["id"], "left").select("key", F.coalesce("component", "rep").alias("component")), "named")
    out = signed.select("id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.col("component"), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``df`` with one document of each group, the one of least id; a row repeated whole stays once."""
    grouped = stage(group(df, id_col, text_col, max_broadcast), "groups")
    gone = stage(grouped.where(~F.col("kept")).select(id_col).distinct(), "gone")
    again = stage(grouped.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "again")
    few = gone.limit(max_broadcast + 1).count() <= max_broadcast
    left = df.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*df.columns)
    if not again.head(1):
        return left
    return (left.join(again, id_col, "left_anti").select(*df.columns)
            .union(left.join(again, id_col, "left_semi").select(*df.columns).dropDuplicates([id_col])))
