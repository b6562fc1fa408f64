"""Token-id files: static range asymmetric numeral systems over independent blocks.

One frequency table, from the counts of all ids, serves every block. A block holds
the ids of consecutive whole documents, dealt to LANES interleaved coders that run
as numpy vectors; lane states of 64 bits renew 32 bits at a time. A block carries its
documents' ids and lengths, a checkpoint (lane states and word offset) every
CHECK_STEPS steps, so that parts of it can be decoded in parallel, and CRC-32 sums
of its coded bytes and of its ids; reading checks both.

Layout of a dataset: ``<path>/table`` has (symbol, freq), ``<path>/blocks`` has
(first, n_docs, n_ids, payload), both Parquet, written by Spark's committer so that
lost executors repeat whole tasks. ``first`` orders the blocks. Payload, all
little-endian: magic, then unsigned 32-bit n_docs, n_ids, lanes, scale bits, words,
checkpoints, CRC-32 of what follows the header, CRC-32 of the ids; then per document
id (signed 64), id-is-null (8 bits) and length (unsigned 32), then initial states
(unsigned 64 a lane), checkpoints (step and word offset, unsigned 32, and states),
then the words (unsigned 32).

Defined cases: a document without ids has length zero; a null id is kept as null and
sorts first; ids of any value below 2**32 are coded; an empty table gives an empty
dataset. A document is never cut, so a block is as long as its longest document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.arrow import bound_batches
from sluice.staging import stage

LANES = 2048
SCALE = 20
BLOCK_IDS = 1 << 19
CHECK_STEPS = 128
#: Up to so many blocks' starting points are broadcast; more are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 500_000
MAGIC = b"SRA1"
_HEAD = struct.Struct("<4s8I")
_LOW = np.uint64(1 << 31)
_U32, _U64 = np.uint64(32), np.uint64


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each of the (positive) counts."""
    total, size = int(counts.sum()), 1 << scale
    if len(counts) > size:
        raise ValueError(f"{len(counts)} symbols need a scale over {scale} bits")
    freq = np.maximum(1, counts.astype(object) * size // total).astype(np.int64)
    over = int(freq.sum()) - size
    while over:  # the largest give or take, ties by place
        order = np.argsort(-freq, kind="stable")
        give = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * abs(over) // size)) if over > 0 else np.ones(len(order), np.int64)
        many = int(np.searchsorted(np.cumsum(give), abs(over), side="right"))
        many = max(1, many)
        step = give[:many]
        if step.sum() > abs(over):
            step[0] = abs(over)
        freq[order[:many]] -= np.sign(over) * step
        over = int(freq.sum()) - size
    return freq


class Coder:
    """Encoder and decoder for one table of (symbol, freq)."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.symbols, self.freq = scale, symbols.astype(np.uint32), freq.astype(_U64)
        self.cum = np.concatenate((np.zeros(1, _U64), np.cumsum(self.freq)[:-1].astype(_U64)))
        self.most = ((_LOW >> _U64(scale)) << _U32) * self.freq
        self.slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
        dense = int(self.symbols.max()) + 1 if len(symbols) else 0
        if dense <= 1 << 24:
            self._dense = np.full(dense, -1, np.int32)
            self._dense[self.symbols] = np.arange(len(symbols), dtype=np.int32)
        else:
            self._dense = None

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        if self._dense is not None:
            return self._dense[ids]
        return np.searchsorted(self.symbols, ids).astype(np.int32)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECK_STEPS) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray]:
        """Initial states for a decoder, its checkpoints (step, word offset, states) and the words."""
        rank, steps = self._ranks(ids), -(-len(ids) // lanes)
        state = np.full(lanes, _LOW, _U64)
        chunks, marks = [], []
        shift = _U64(self.scale)
        for t in range(steps - 1, -1, -1):
            r = rank[t * lanes:(t + 1) * lanes]
            x, f = state[:len(r)], self.freq[r]
            full = x >= self.most[r]
            chunks.append((x[full] & _U64(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(full, x >> _U32, x)
            q = x // f
            state[:len(r)] = (q << shift) + (x - q * f) + self.cum[r]
            if t and t % every == 0:
                marks.append((t, len(chunks), state.copy()))
        chunks.reverse()
        offsets = np.cumsum([0, *map(len, chunks)])
        marks = [(t, int(offsets[steps - done]), s) for t, done, s in reversed(marks)]
        return state, marks, np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)

    def decode(self, n: int, state: np.ndarray, words: np.ndarray, first: int = 0, last: int | None = None, at: int = 0) -> np.ndarray:
        """The ids of steps ``first`` to ``last``, from the states and word offset that stand at ``first``."""
        lanes, state = len(state), state.copy()
        steps = -(-n // lanes) if last is None else last
        out = np.empty(min(n, steps * lanes) - first * lanes, np.int32)
        mask, shift = _U64((1 << self.scale) - 1), _U64(self.scale)
        words = words.astype(_U64)
        for t in range(first, steps):
            live = min(lanes, n - t * lanes)
            x = state[:live]
            slot = x & mask
            r = self.slots[slot]
            out[(t - first) * lanes:(t - first) * lanes + live] = r
            x = self.freq[r] * (x >> shift) + slot - self.cum[r]
            need = np.flatnonzero(x < _LOW)
            x[need] = x[need] << _U32 | words[at:at + len(need)]
            at += len(need)
            state[:live] = x
        return self.symbols[out]


def pack(coder: Coder, doc_ids: list[int | None], ids: list[bytes], lanes: int = LANES) -> bytes:
    """One block of documents; ``ids`` are little-endian unsigned 32-bit integers."""
    raw = b"".join(ids)
    flat = np.frombuffer(raw, "<u4")
    lanes = max(1, min(lanes, len(flat) // 64))
    state, marks, words = coder.encode(flat, lanes)
    body = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array([len(b) // 4 for b in ids], "<u4").tobytes(), state.astype("<u8").tobytes(),
        *[struct.pack("<2I", t, o) + s.astype("<u8").tobytes() for t, o, s in marks], words.astype("<u4").tobytes()])
    return _HEAD.pack(MAGIC, len(ids), len(flat), lanes, coder.scale, len(words), len(marks), zlib.crc32(body), zlib.crc32(raw)) + body


def unpack(coder: Coder, block: bytes) -> tuple[list[int | None], list[bytes]]:
    """The documents of a block; raises if a checksum is wrong."""
    magic, docs, n, lanes, scale, words, marks, body_sum, ids_sum = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size:]
    if magic != MAGIC or scale != coder.scale or zlib.crc32(body) != body_sum:
        raise ValueError("a damaged block, or one of another table")
    at = 0

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(body, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, null, lengths, state = take(docs, "<i8"), take(docs, "u1"), take(docs, "<u4"), take(lanes, "<u8")
    for _ in range(marks):
        take(2, "<u4"), take(lanes, "<u8")
    flat = coder.decode(n, state.astype(_U64), take(words, "<u4")).astype("<u4").tobytes()
    if zlib.crc32(flat) != ids_sum:
        raise ValueError("decoded ids differ from those encoded")
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))) * 4
    return ([None if z else int(d) for d, z in zip(doc_ids, null)], [flat[a:b] for a, b in zip(ends[:-1], ends[1:])])


def checkpoints(block: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(step, word offset, states) of a block, from step 0, for decoding its parts apart with ``Coder.decode``."""
    _, docs, _, lanes, _, _, marks, _, _ = _HEAD.unpack_from(block)
    at = _HEAD.size + docs * 13
    out = [(0, 0, np.frombuffer(block, "<u8", lanes, at))]
    at += lanes * 8
    for _ in range(marks):
        t, o = struct.unpack_from("<2I", block, at)
        out.append((t, o, np.frombuffer(block, "<u8", lanes, at + 8)))
        at += 8 + lanes * 8
    return out


def _counts(ordered: DataFrame, width: int) -> DataFrame:
    """(symbol, count) of all ids: from the column counts if there is one, else from the ids."""
    given = "counts" in ordered.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if not raw:
                    continue
                if given:
                    symbols, many = np.frombuffer(raw, "<u4").reshape(-1, 2).T
                else:
                    symbols, many = np.unique(np.frombuffer(raw, f"<u{width}"), return_counts=True)
                for s, k in zip(symbols.tolist(), many.tolist()):
                    total[s] = total.get(s, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["symbol", "count"])

    held = ordered.where("counts IS NOT NULL").select("counts") if given else ordered.select("ids")
    return held.mapInArrow(work, "symbol long, count long").groupBy("symbol").agg(F.sum("count").alias("count"))


def _coder(table: list[tuple[int, int]]) -> Coder:
    return Coder(np.array([s for s, _ in table], np.uint32), np.array([f for _, f in table], np.int64))


def write(ordered: DataFrame, path: str, width: int = 4) -> None:
    """Write ``ordered`` (place, id, ids of ``width`` bytes): blocks of rows with consecutive places, in their order.

    ``place`` is a bigint that rises by one from row to row within each of any number of runs.
    """
    spark = ordered.sparkSession
    bound_batches(spark)
    counted = sorted((r["symbol"], r["count"]) for r in _counts(ordered, width).collect())  # at most one row a symbol of the vocabulary
    freq = quantise(np.array([c for _, c in counted], np.int64)) if counted else np.zeros(0, np.int64)
    table = [(s, int(f)) for (s, _), f in zip(counted, freq)]
    spark.createDataFrame(table, "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        first, doc_ids, ids, held = -1, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "first": pa.array([first], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()),
                "n_ids": pa.array([held], pa.int64()), "payload": pa.array([pack(coder, doc_ids, ids)], pa.binary())})

        for batch in batches:
            for place, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("place", "id", "ids"))):
                raw = np.frombuffer(raw or b"", f"<u{width}").astype("<u4").tobytes()
                if ids and (place != first + len(ids) or held + len(raw) // 4 > BLOCK_IDS):
                    yield close()
                    doc_ids, ids, held = [], [], 0
                if not ids:
                    first = place
                doc_ids.append(doc)
                ids.append(raw)
                held += len(raw) // 4
        if ids:
            yield close()

    (ordered.select("place", "id", "ids").mapInArrow(work, "first long, n_docs long, n_ids long, payload binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids) of every document in a dataset; start counts the ids of all documents before it."""
    table = [(r["symbol"], r["freq"]) for r in spark.read.parquet(f"{path}/table").orderBy("symbol").collect()]
    shared = spark.sparkContext.broadcast(table)
    bound_batches(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    run = F.shiftright("first", 33)  # runs are few: one a writing partition
    sizes = blocks.select(run.alias("run"), "n_ids").groupBy("run").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_start"))
    within = Window.partitionBy("run").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("first", run.alias("run"), "n_ids").withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    starts = placed.join(before, "run").select("first", (F.col("run_start") + F.col("own")).alias("start"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload").to_pylist()):
                doc_ids, ids = unpack(coder, payload)
                begins = start + np.concatenate(([0], np.cumsum([len(b) // 4 for b in ids])))[:-1]
                yield pa.RecordBatch.from_pydict({"id": pa.array(doc_ids, pa.int64()), "start": pa.array(begins, pa.int64()), "ids": pa.array(ids, pa.binary())})

    few = blocks.limit(MAX_BROADCAST_BLOCKS + 1).count() <= MAX_BROADCAST_BLOCKS
    return blocks.select("first", "payload").join(F.broadcast(starts) if few else starts, "first").select("start", "payload").mapInArrow(work, "id long, start long, ids binary")


def in_id_order(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """``df`` range-partitioned and sorted by id (ties by a hash of the value, so that equal ids still split), nulls first."""
    keyed = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("value")).withColumn("__tie", F.xxhash64("value"))
    order = [F.col("id").asc_nulls_first(), F.col("__tie").asc()]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")


def placed(df: DataFrame, label: str = "ids") -> DataFrame:
    """``df`` with ``place``, staged: consecutive within each partition and rising over the partitions in order."""
    return stage(df.withColumn("place", F.monotonically_increasing_id()), label, sweep=True)
