"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

A document is contaminated by a benchmark item if some window of the document, as
long as the item, has a weighted five-word-shingle similarity of at least 0.75 with
it: shingles weigh as often as they occur, similarity is the sum of the lesser
weights over the sum of the greater ones.

1. One pass hashes each document's shingles and looks them up among the items'
   shingles; a document that shares none can have no such window.
2. Windows are sliced from the others. Shifting a window right until it starts with
   a shared shingle loses nothing, so only such windows (and the last of the text)
   are tried, and only if enough of their shingles are shared at all.
3. Windows and items have SimHash fingerprints of 64 * LONGS bits, of shingles numbered
   by occurrence, so that repeated ones count as different. An equi-join on (length,
   block, bits) over the fingerprints' bytes finds every item within BLOCKS - 1 bits,
   and of long ones at similarity 0.75, which differ in 66 +- 7 of 384 bits, all but one
   in 100,000; of unrelated items it finds one in six. Those that differ in more than
   RADIUS bits, over five deviations beyond 0.75, go at once, and so do unrelated ones.
4. Fingerprints of few shingles spread further: of windows of three and items of four,
   some 5 % are lost. What fingerprints leave out is found without loss: a window that
   needs o of an item's m shingles holds one of its m - o + 1 rarest.
5. Candidates are kept if the exact similarity of their shingles is high enough.

Defined cases: texts are lower-cased; null text counts as empty; rows with a null id
are not judged; items of fewer than five words are not searched; equal items and
repeated rows give one row for each (document id, item id); a document shorter than an
item is one window; texts of any length are read whole; the result has the columns
named below only, whatever else the inputs have; empty tables give an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.quality import words_column
from sluice.staging import stage

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
#: Words of a fingerprint, its blocks of eight bits, and the bits that two may differ in.
LONGS = 6
BLOCKS = 8 * LONGS
RADIUS = 105
#: Broadcasts hold so many fixed-size rows, or elements of their arrays, at most; more are joined by shuffles.
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_ELEMENTS = 2_000_000
MAX_BROADCAST_DOCS = 200_000

_LANES, _WIDTH = 4, 16


def shingles_column(words: Column) -> Column:
    """The hash of every five-word shingle, by position; none for fewer words."""
    return F.when(F.size(words) >= WORDS, F.transform(
        F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WORDS)]))).otherwise(F.array().cast("array<bigint>"))


def _spread(x: Column, group: int) -> Column:
    """Bits group, group + 16, group + 32 and group + 48 of x, each at the foot of a 16-bit lane."""
    return F.shiftright(x, group).bitwiseAND(F.lit(0x0001000100010001))


def simhash_column(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes, repeated ones counting again; a tied bit is that of the least hash.

    Four counters share a long, in lanes of 16 bits; arrays are counted in chunks too
    short for a lane to overflow, and the chunks' counts are added.
    """
    n = F.size(hashes)
    chunk = 2**15 - 1
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(chunk))

    def counts(part: Column) -> Column:
        zero = F.array(*[F.lit(0).cast("long")] * _WIDTH)
        return F.aggregate(part, zero, lambda acc, x: F.array(*[F.get(acc, g) + _spread(x, g) for g in range(_WIDTH)]))

    def lane(lanes: Column, k: int) -> Column:
        return F.transform(lanes, lambda c: F.shiftright(c, k * _WIDTH).bitwiseAND(F.lit(0xFFFF)))

    packed = F.transform(starts, lambda s: counts(F.slice(hashes, s, chunk)))
    chunks = F.transform(packed, lambda lanes: F.concat(*[lane(lanes, k) for k in range(_LANES)]))
    total = F.aggregate(chunks, F.array(*[F.lit(0).cast("long")] * 64), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    # counter k stands for bit k: lane k // 16, group k % 16
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    made = F.aggregate(total, F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("tied"), F.lit(0).alias("k")), lambda s, c: F.struct(
        F.when(2 * c > n, s["bits"].bitwiseOR(one(s["k"]))).otherwise(s["bits"]).alias("bits"),
        F.when(2 * c == n, s["tied"].bitwiseOR(one(s["k"]))).otherwise(s["tied"]).alias("tied"), (s["k"] + 1).alias("k")),
        lambda s: F.struct(s["bits"].alias("bits"), s["tied"].alias("tied")))
    return F.transform(F.array(made), lambda s: s["bits"].bitwiseOR(s["tied"].bitwiseAND(F.coalesce(F.array_min(hashes), F.lit(0)))))[0]


def _under(hashes: Column, k: int) -> Column:
    """The array under another hash."""
    return F.transform(hashes, lambda x: F.xxhash64(x, F.lit(k)))


def fingerprint_column(hashes: Column) -> Column:
    """LONGS words, each the SimHash of the array under a hash of its own."""
    return F.array(simhash_column(hashes), *[simhash_column(_under(hashes, k)) for k in range(1, LONGS)])


def blocks_column(fingerprint: Column) -> Column:
    """(block, bits) of every byte."""
    each = [F.shiftrightunsigned(F.get(fingerprint, k), 8 * i).bitwiseAND(F.lit(255)).cast("int") for k in range(LONGS) for i in range(8)]
    return F.array(*[F.struct(F.lit(i).alias("block"), bits.alias("bits")) for i, bits in enumerate(each)])


def distance_column(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    each = [F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(LONGS)]
    return sum(each[1:], each[0])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its array s as a set: hashes that tell the first, second ... occurrence apart, so that the size of
    an intersection sums the lesser weights. Occurrences are numbered within the runs of the sorted array."""
    last = F.size("o") - 1
    out = df.withColumn("o", F.array_sort("s"))
    # where runs begin, and one past the end
    out = out.withColumn("p", F.concat(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i == 0) | (F.get("o", i) != F.get("o", i - 1))), F.array(F.size("o"))))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda k: F.transform(
        F.sequence(F.lit(1), F.get("p", k + 1) - F.get("p", k)), lambda n: F.xxhash64(F.get("o", F.get("p", k)), n))))
    return out.withColumn("s", F.when(F.size("o") > 0, runs).otherwise(F.col("o"))).drop("o", "p")


def described(df: DataFrame) -> DataFrame:
    """``numbered`` with f, the fingerprint of that set, in which no repeated shingle prevails."""
    return numbered(df).withColumn("f", fingerprint_column(F.col("s")))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = words_column(F.lower(F.col(text_col)))
    listed = benchmark.select(F.col(id_col).alias("item_id"), words.alias("w")).where(F.size("w") >= WORDS)
    hashed = stage(listed.select("item_id", F.size("w").alias("n_words"), shingles_column(F.col("w")).alias("s")), "items")
    return hashed.withColumn("m", F.size("s"))


def _hashed(read: DataFrame) -> DataFrame:
    """``read`` with its text as an array s of shingle hashes."""
    words = read.withColumn("w", words_column(F.lower(F.col("text"))))
    return words.withColumn("s", shingles_column(F.col("w"))).drop("text", "w")


def needed_column(a: Column, m: Column) -> Column:
    """The least intersection of sets of a and m elements that are similar enough."""
    return F.ceil((a + m) * NUMERATOR / (NUMERATOR + DENOMINATOR)).cast("int")


def _rarest(marked: DataFrame) -> DataFrame:
    """(item_id, m, k, h): as many of each item's shingles as a window may have to be looked up by, k from 0 for the rarest."""
    each = marked.select("item_id", "m", F.xxhash64("s").alias("item"), F.explode("s").alias("h"))
    often = each.groupBy("m", "h").agg(F.count(F.lit(1)).alias("often"))
    listed = each.join(often, ["m", "h"]).groupBy("item_id", "m", "item").agg(F.array_sort(F.collect_set(F.struct("often", "h"))).alias("s"))
    most = F.col("m") - F.ceil(F.col("m") * NUMERATOR / DENOMINATOR).cast("int") + 1
    return listed.select("item_id", "m", F.posexplode(F.slice("s", F.lit(1), most)).alias("k", "s")).select("item_id", "m", "k", F.col("s.h").alias("h"))


def _broadcast(df: DataFrame, bound: int, elements: Column | None = None) -> DataFrame:
    """``df`` broadcast if it has ``bound`` rows, or elements in all, at most."""
    size = df.limit(bound + 1).count() if elements is None else (df.agg(F.sum(elements)).first()[0] or 0)
    return F.broadcast(df) if size <= bound else df


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_id, start_word, n_words, n_common, similarity) of every contaminated document and item.

    The window shown is the one of greatest overlap, of those the last; start_word counts from 0.
    """
    items = _items(benchmark, item_id_col, item_text_col)
    index = stage(items.select(F.explode("s").alias("h"), "m").distinct(), "index")
    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # outer, because the size test that an inner explode gets would be pushed into the scan and hash every text once more a word
    each = _hashed(read).select("id", F.size("s").alias("size"), F.posexplode_outer("s").alias("pos", "h"))
    hits = each.join(_broadcast(index, MAX_BROADCAST_ROWS), "h").groupBy("id", "size", "m").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    need = F.ceil(F.col("m") * NUMERATOR / DENOMINATOR).cast("int")
    last = F.greatest(F.col("size") - F.col("m"), F.lit(0))
    full = F.filter("p", lambda x, i: (x <= last) & (F.get("p", i + need - 1) < x + F.col("m")))
    tail = F.when(F.size(F.filter("p", lambda x: x >= last)) >= F.least(need, F.ceil(F.col("size") * NUMERATOR / DENOMINATOR).cast("int")), F.array(last)).otherwise(F.array().cast("array<int>"))
    starts = (hits.select("id", "m", F.explode(F.array_distinct(F.concat(full, tail))).alias("start"))
              .groupBy("id").agg(F.collect_set(F.struct("m", "start")).alias("windows")))
    starts = stage(starts, "starts")

    met = read.join(_broadcast(starts, MAX_BROADCAST_ELEMENTS, F.size("windows") + 1), "id").select("id", "text", "windows")
    again = _hashed(met).select("id", "s", F.explode("windows").alias("win"))
    windows = again.select("id", F.col("win.m").alias("m"), F.col("win.start").alias("start"), F.slice("s", F.col("win.start") + 1, F.col("win.m")).alias("s"))
    windows = stage(described(windows), "windows")
    marked = stage(described(items), "fingerprints")
    left = windows.select("id", "m", "start", "f", F.explode(blocks_column(F.col("f"))).alias("b")).alias("w")
    right = _broadcast(marked.select("item_id", "m", "f", F.explode(blocks_column(F.col("f"))).alias("b")), MAX_BROADCAST_ROWS).alias("i")
    near = left.join(right, (F.col("w.m") == F.col("i.m")) & (F.col("w.b") == F.col("i.b")) & (distance_column(F.col("w.f"), F.col("i.f")) <= RADIUS))
    held = windows.select("id", "m", "start", F.size("s").alias("a"), F.explode("s").alias("h")).alias("w")
    keys = _broadcast(stage(_rarest(marked), "keys"), MAX_BROADCAST_ROWS).alias("i")
    rest = held.join(keys, (F.col("w.m") == F.col("i.m")) & (F.col("w.h") == F.col("i.h")) & (F.col("i.k") <= F.col("w.m") - needed_column(F.col("w.a"), F.col("w.m"))))
    found = near.select("w.id", "w.m", "w.start", "i.item_id").union(rest.select("w.id", "w.m", "w.start", "i.item_id"))
    pairs = stage(found.distinct(), "pairs")
    asked = windows.select("id", "m", "start", "s").join(pairs, ["id", "m", "start"])
    known = marked.select("item_id", "n_words", F.col("s").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    scored = asked.join(_broadcast(known, MAX_BROADCAST_ELEMENTS, F.size("t") + 1), "item_id").select("id", "item_id", "start", "n_words", F.size("s").alias("a"), F.size("t").alias("c"), common.alias("n"))
    union = F.col("a") + F.col("c") - F.col("n")
    good = scored.where(DENOMINATOR * F.col("n") >= NUMERATOR * union).withColumn("similarity", F.col("n") / union)
    best = good.groupBy("id", "item_id").agg(F.max(F.struct("n", "start", "n_words", "similarity")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("b.start").cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"),
                       F.col("b.n").cast("long").alias("n_common"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; rows with a null id are not judged and stay."""
    bad = stage(find(docs, benchmark, id_col, text_col).select(id_col).distinct(), "contaminated")
    return docs.join(_broadcast(bad, MAX_BROADCAST_DOCS), id_col, "left_anti").select(*docs.columns)
