"""Removal of byte strings that already occur in an earlier document.

Every byte covered by a LENGTH-byte string that also starts in a document of
smaller id is removed; strings are judged on the input and never cross documents.

The index is a logarithmic family of suffix arrays, kept for each shard of the
string space. Documents come in batches, ranges of ascending id. A batch's suffixes
are sorted by their first LENGTH bytes, merge-scanned against the levels of earlier
batches for matches that long, and become a level; two levels of about equal size
merge, so each suffix is merged a logarithmic number of times (``Levels``).

Suffixes are sharded, and thinned without loss, by minimizer anchors (see
``anchors``): equal strings have equal anchors, so

1. every document's anchor hashes go, packed, to the shards, which report the ones
   that more than one document has back to the batches that hold them;
2. batches send the distinct contexts (the strings that pick one anchor, as one
   piece of text) of those anchors to the shards with the least and greatest id
   that has them. A context that came before matches as a whole; only contexts
   that share an anchor with a different context have their suffixes indexed;
3. batches mark the matches of their contexts and cut the texts.

Texts are shuffled twice, zstd-compressed. All matches are confirmed on bytes. The
driver holds KNOTS quantiles of the ids at most, between which batches are equal
ranges of ids; the number of batches and of shards has no bound. The levels live as
long as a call: a later run over new documents is given the earlier ones again.

Defined cases: null text is empty; rows with a null id neither lose bytes nor count
as earlier; rows with equal ids do not affect each other; a text longer than a batch
is a batch of its own or part of a larger one, read whole; kept bytes may end or
start inside a character, so they are binary; the result has the four columns named
below only, whatever else the input has; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.anchors import LENGTH, anchors
from sluice.llm.arrow import bound_batches
from sluice.staging import stage

#: Bytes of text of a batch, and times that whose anchors a shard holds.
BATCH_BYTES, SHARD = 6 << 20, 2
#: Bytes hashed together, and anchors gathered before they are sent.
CHUNK_BYTES, GATHER = 1 << 19, 1 << 19
#: Quantiles of the ids that the driver holds at most.
KNOTS = 4096
EARLIER = np.iinfo(np.int64).min
_KEY_BITS = np.uint64(44)

SPANS = "array<struct<start:bigint,end:bigint>>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; the first is ascending and stored as differences."""
    first, *rest = arrays
    parts = [np.diff(first, prepend=first[:1] * 0), *rest]
    head = np.array([len(first), *[p.dtype.itemsize for p in parts]], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T).tobytes() for p in parts)
    return zstandard.ZstdCompressor(1).compress(len(parts).to_bytes(1, "little") + head + planes)


def unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    count = raw[0]
    n, *widths = np.frombuffer(raw, "<i8", 1 + count, 1).tolist()
    at, out = 1 + 8 * (1 + count), []
    for width, kind in zip(widths, kinds):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


class Levels:
    """Sorted arrays of distinct LENGTH-byte suffix prefixes; sizes fall geometrically."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted ``keys`` some level has."""
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.searchsorted(level, keys)
            at[at == len(level)] = 0
            found |= level[at] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        """Take in sorted distinct ``keys`` that no level has."""
        while self.levels and len(self.levels[-1]) < 2 * len(keys):
            other = self.levels.pop()
            keys = np.concatenate((other, keys))
            keys.sort(kind="stable")
        if len(keys):
            self.levels.append(keys)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, buffer, begins) of texts joined up to CHUNK_BYTES."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK_BYTES or k + 1 == len(texts):
            part = texts[first:k + 1]
            yield first, np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])
            first, held = k + 1, 0


class Ranges:
    """Batches as ranges of ascending id: ``per`` equal ones between two knots."""

    def __init__(self, knots: list[int], per: int, least: int, most: int):
        self._knots, self._per = knots, per
        self._edges = [least, *knots, most + 1]

    def of(self, id_: int) -> int:
        at = bisect_right(self._knots, id_)
        low, high = self._edges[at], self._edges[at + 1]
        return at * self._per + (min(self._per - 1, max(0, id_ - low) * self._per // max(1, high - low)) if self._per > 1 else 0)


def ranges_of(docs: DataFrame, batches: int, knots: int = KNOTS) -> Ranges:
    """``batches`` ranges of about equal numbers of rows (more, if that is needed to have as many between all knots)."""
    n = min(batches, knots)
    cuts = [F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("cuts")] if n > 1 else []
    found = docs.agg(F.min("id").alias("least"), F.max("id").alias("most"), *cuts).first()
    return Ranges(sorted(set(found["cuts"] or [])) if n > 1 else [], -(-batches // n), found["least"] or 0, found["most"] or 0)


def _shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each hash, by its top 32 bits, and a key of its lowest 44."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64), hashes & ((np.uint64(1) << _KEY_BITS) - np.uint64(1))


def _by_shard(shard: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    sorted_ = shard[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        if b > a:
            yield int(sorted_[a]), order[a:b]


def _send_anchors(docs: DataFrame, ranges: Ranges, shards: int) -> DataFrame:
    """(shard, blob): the distinct (key, batch) of the anchors, and whether several documents have one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held = 0

        def send() -> pa.RecordBatch:
            hashes, batch, many = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((batch, hashes))
            hashes, batch, many = hashes[order], batch[order], many[order]
            new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (batch[1:] != batch[:-1]))))
            several = np.maximum.reduceat(many, new) | (np.diff(np.append(new, len(hashes))) > 1)
            hashes, batch = hashes[new], batch[new]
            shard, key = _shard(hashes, shards)
            rows = [(s, pack(key[i], batch[i].astype(np.uint32), several[i].astype(np.uint8))) for s, i in _by_shard(shard, np.arange(len(key)))]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])

        for rows in batches:
            ids = rows.column("id").to_pylist()
            texts = [t.encode() if t else b"" for t in rows.column("text").to_pylist()]
            for first, buffer, begins in _chunks(texts):
                doc, _, _, _, hashes = anchors(buffer, begins)
                if not len(doc):
                    continue
                of = np.array([ranges.of(i) for i in ids[first:first + len(begins) - 1]], np.int64)
                order = np.lexsort((doc, hashes))
                doc, hashes = doc[order], hashes[order]
                once = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))))
                kept.append((hashes[once], of[doc[once]], np.zeros(len(once), bool)))
                held += len(once)
            if held >= GATHER:
                yield send()
                kept, held = [], 0
        if held:
            yield send()

    return docs.mapInArrow(work, "shard long, blob binary")


def _shared(table: pa.Table) -> pa.Table:
    """Of one shard: (batch, blob) with the keys that more than one document has, for the batches that hold them."""
    shard = table.column("shard")[0].as_py()
    keys, batches, many = (np.concatenate(x) for x in zip(*(unpack(b, "<u8", "<u4", "u1") for b in table.column("blob").to_pylist())))
    order = np.lexsort((batches, keys))
    keys, batches, many = keys[order], batches[order], many[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(new, len(keys)))
    several = (size > 1) | (np.maximum.reduceat(many, new) > 0)
    at = np.flatnonzero(np.repeat(several, size))
    at = at[np.lexsort((keys[at], batches[at]))]
    at = at[np.concatenate(([True], (keys[at][1:] != keys[at][:-1]) | (batches[at][1:] != batches[at][:-1])))] if len(at) else at
    rows = [(b, pack(keys[i])) for b, i in _by_shard(batches.astype(np.int64), at)]
    return pa.table({"batch": pa.array([b for b, _ in rows], pa.int64()), "shard": pa.array([shard] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})


def _zipped(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """(batch, id, z) with the texts' bytes compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for rows in batches:
            ids = rows.column("id")
            of = [ranges.of(i) for i in ids.to_pylist()]
            z = [squeeze(t.encode() if t else b"") for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), ids, pa.array(z, pa.binary())], ["batch", "id", "z"])

    return docs.mapInArrow(work, "batch long, id long, z binary")


def _texts(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """A batch's ids and texts by (id, z): occurrences name their row, and each shuffle brings the rows in an order of its own."""
    table = table.select(["id", "z"]).sort_by([("id", "ascending"), ("z", "ascending")])
    expand = zstandard.ZstdDecompressor().decompress
    return table.column("id").to_pylist(), [expand(z) for z in table.column("z").to_pylist()]


def _contexts(shards: int):
    """Of one batch: a row for each shard with the distinct contexts of its shared anchors, and one with their occurrences."""

    def work(docs: pa.Table, shared: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes, bytes]] = []
        if docs.num_rows and shared.num_rows:
            batch = docs.column("batch")[0].as_py()
            ids, texts = _texts(docs)
            known = {s: unpack(b, "<u8")[0] for s, b in zip(shared.column("shard").to_pylist(), shared.column("blob").to_pylist())}
            # what is shared, as whole hashes: shard and key together, sorted
            keys = np.concatenate([k for _, k in sorted(known.items())])
            found: dict[tuple[int, int, bytes], int] = {}
            least, most, who, where, which = [], [], [], [], []
            starts = np.concatenate(([0], np.cumsum([len(known.get(s, ())) for s in range(shards)])))
            for first, buffer, begins in _chunks(texts):
                doc, low, high, at, hashes = anchors(buffer, begins)
                shard, key = _shard(hashes, shards)
                pick = []
                order = np.argsort(shard, kind="stable")
                for s, i in _by_shard(shard, order):
                    a, b = int(starts[s]), int(starts[s + 1])
                    if b > a:
                        spot = np.searchsorted(keys[a:b], key[i])
                        spot[spot == b - a] = 0
                        pick.append(i[keys[a:b][spot] == key[i]])
                if not pick:
                    continue
                pick = np.sort(np.concatenate(pick))
                raw = buffer.tobytes()
                doc, low, high, at, hashes = doc[pick], low[pick], high[pick], at[pick], hashes[pick]
                inner = (low - begins[doc]).tolist()
                for d, lo, hi, a, h, place in zip(doc.tolist(), low.tolist(), high.tolist(), at.tolist(), hashes.tolist(), inner):
                    name = (h, a - lo, raw[lo:hi + LENGTH])
                    c = found.get(name)
                    id_ = ids[first + d]
                    if c is None:
                        c = found[name] = len(least)
                        least.append(id_)
                        most.append(id_)
                    elif id_ < least[c]:
                        least[c] = id_
                    elif id_ > most[c]:
                        most[c] = id_
                    who.append(first + d)
                    where.append(place)
                    which.append(c)
            if least:
                hashes = np.array([n[0] for n in found], np.uint64)
                lead = np.array([n[1] for n in found], np.uint8)
                pieces = [n[2] for n in found]
                size = np.array([len(p) for p in pieces], np.uint8)
                shard, _ = _shard(hashes, shards)
                number, lo, hi = np.arange(len(pieces), dtype=np.int64), np.array(least, np.int64), np.array(most, np.int64)
                for s, i in _by_shard(shard, np.argsort(shard, kind="stable")):
                    text = zstandard.ZstdCompressor(3).compress(b"".join(pieces[k] for k in i.tolist()))
                    out.append((s, batch, pack(number[i], hashes[i], lead[i], size[i], lo[i], hi[i] - lo[i]), text))
                order = np.lexsort((np.array(where), np.array(which)))
                ids_of = np.array(ids, np.int64)
                out.append((-1, batch, pack(np.array(which, np.int64)[order], ids_of[np.array(who)][order], np.array(who, np.int64)[order].astype(np.uint32), np.array(where, np.int64)[order]), b""))
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int64()), "batch": pa.array([o[1] for o in out], pa.int64()),
                         "blob": pa.array([o[2] for o in out], pa.binary()), "text": pa.array([o[3] for o in out], pa.binary())})

    return work


def _match(table: pa.Table) -> pa.Table:
    """Of one shard: for each batch, the ranges of windows of its contexts that a document of smaller id has."""
    runs = sorted(zip(table.column("batch").to_pylist(), table.column("blob").to_pylist(), table.column("text").to_pylist()))
    several: dict[int, tuple | None] = {}  # an anchor's only context, or None if it has several
    parsed = []
    for batch, blob, text in runs:
        number, hashes, lead, size, least, more = unpack(blob, "<i8", "<u8", "u1", "u1", "<i8", "<i8")
        raw = zstandard.ZstdDecompressor().decompress(text)
        ends = np.cumsum(size, dtype=np.int64)
        names = [(h, a, raw[e - n:e]) for h, a, n, e in zip(hashes.tolist(), lead.tolist(), size.tolist(), ends.tolist())]
        for name in names:
            if several.setdefault(name[0], name) not in (None, name):
                several[name[0]] = None
        parsed.append((batch, number, names, size, least, least + more))
    seen: set[tuple] = set()
    levels, out = Levels(), []
    for batch, number, names, size, least, most in parsed:
        got: list[tuple[int, int, int, int]] = []
        fresh = []
        for k, name in enumerate(names):
            if name in seen:
                got.append((int(number[k]), 0, int(size[k]) - LENGTH, EARLIER))
                continue
            if most[k] > least[k]:
                got.append((int(number[k]), 0, int(size[k]) - LENGTH, int(least[k])))
            if several[name[0]] is None:
                fresh.append(k)
        seen.update(names)
        if fresh:
            text = np.frombuffer(b"".join(names[k][2] for k in fresh), np.uint8)
            sizes = size[fresh].astype(np.int64)
            count = sizes - LENGTH + 1
            of = np.repeat(np.arange(len(fresh)), count)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.repeat(np.cumsum(sizes) - sizes, count) + inner
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, LENGTH)[begin]).view(f"S{LENGTH}").ravel()
            order = np.argsort(suffixes, kind="stable")  # the batch's suffix array, as far as it needs sorting
            sorted_ = suffixes[order]
            new = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            keys = sorted_[new]
            before = levels.scan(keys)
            first = np.minimum.reduceat(least[fresh][of[order]], new)
            first[before] = EARLIER
            levels.add(keys[~before])
            each = np.repeat(first, np.diff(np.append(new, len(order))))
            owner = np.empty(len(order), np.int64)
            owner[order] = each
            hit = np.flatnonzero(owner < most[fresh][of])
            # neighbouring windows of one context with one least id are one range
            if len(hit):
                cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(of[hit]) != 0) | (np.diff(owner[hit]) != 0)) + 1
                a, b = hit[np.concatenate(([0], cut))], hit[np.append(cut, len(hit)) - 1]
                got += zip(number[np.array(fresh)[of[a]]].tolist(), inner[a].tolist(), inner[b].tolist(), owner[a].tolist())
        if got:
            got.sort()
            c, lo, hi, id_ = (np.array(x, np.int64) for x in zip(*got))
            out.append((batch, pack(c, lo.astype(np.uint8), hi.astype(np.uint8), id_)))
    return pa.table({"batch": pa.array([b for b, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})


def _cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Of one batch: (id, n_bytes, spans, kept); ``marks`` has a row of occurrences and rows of matches."""
    ids, texts = _texts(docs)
    hits: list[np.ndarray] = []
    places = [b for s, b in zip(marks.column("shard").to_pylist(), marks.column("blob").to_pylist()) if s < 0]
    if places:
        which, id_, who, where = (np.concatenate(x) for x in zip(*(unpack(b, "<i8", "<i8", "<u4", "<i8") for b in places)))
        for s, b in zip(marks.column("shard").to_pylist(), marks.column("blob").to_pylist()):
            if s >= 0:
                c, lo, hi, least = unpack(b, "<i8", "u1", "u1", "<i8")
                a, z = np.searchsorted(which, c), np.searchsorted(which, c, side="right")
                each = np.repeat(np.arange(len(c)), z - a)
                at = np.arange(len(each)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + a[each]
                later = least[each] < id_[at]
                at, each = at[later], each[later]
                hits.append(np.stack((who[at].astype(np.int64), where[at] + lo[each], where[at] + hi[each] + LENGTH)))
    spans: list[list[dict]] = [[] for _ in ids]
    kept = list(texts)
    if hits:
        doc, start, end = np.concatenate(hits, axis=1)
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)]):
            if a == b:
                continue
            reach = np.maximum.accumulate(end[a:b])
            new = np.flatnonzero(np.concatenate(([True], start[a + 1:b] > reach[:-1])))
            starts, ends = start[a:b][new].tolist(), reach[np.append(new[1:], b - a) - 1].tolist()
            d = int(doc[a])
            spans[d] = [{"start": s, "end": e} for s, e in zip(starts, ends)]
            kept[d] = b"".join(texts[d][s:e] for s, e in zip([0, *ends], [*starts, len(texts[d])]))
    return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                     "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, knots: int = KNOTS) -> DataFrame:
    """(id_col, n_bytes, spans, kept): each row's size, removed byte ranges (maximal) and remaining bytes."""
    bound_batches(df.sparkSession)
    every = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = every.where("id IS NOT NULL")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    shards = -(-batches // SHARD)
    ranges = ranges_of(docs, batches, knots)
    anchored = _send_anchors(docs, ranges, shards)
    common = stage(anchored.groupBy("shard").applyInArrow(_shared, "batch long, shard long, blob binary"), "common", sweep=True)
    zipped = _zipped(docs, ranges)
    contexts = stage(zipped.groupBy("batch").cogroup(common.groupBy("batch")).applyInArrow(_contexts(shards), "shard long, batch long, blob binary, text binary"), "contexts", sweep=True)
    matches = contexts.where("shard >= 0").groupBy("shard").applyInArrow(_match, "batch long, blob binary")
    marks = stage(matches.select("batch", F.lit(0).cast("long").alias("shard"), "blob").union(contexts.where("shard < 0").select("batch", "shard", "blob")), "marks", sweep=True)
    cut = zipped.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(_cut, f"id long, n_bytes long, spans {SPANS}, kept binary")
    unnamed = every.where("id IS NULL").select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                                               F.array().cast(SPANS).alias("spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"))
    return cut.union(unnamed).withColumnRenamed("id", id_col)
