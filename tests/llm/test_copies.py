"""Near copies, repeated strings, contamination and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import components, decon, neardup, shingles, suffix

SF = "/root/testdata/sf0.001"


def family(rng, words, n, most):
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def corpus(seed, big=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = family(rng, words, big, 5) + family(rng, words, 8, 2) + [" ".join(rng.choice(words) for _ in range(50)) for _ in range(20)]
    rows += [None, "", "   ", "one two", "One\ttwo", "one two three", rows[0], rows[0].upper(), "x" * 3000, "a b " * 4000]
    rng.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def groups(rows):
    s = sets_of(rows)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 4 * len(s[a] & s[b]) >= 3 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i), i == find(i)) for i in ids}


@pytest.mark.parametrize(("seed", "bound", "hot", "block"), [(1, 10**6, 2000, 1024), (2, 0, 1, 2), (3, 10**6, 5, 7)])
def test_near_duplicates(spark, seed, bound, hot, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.group(df, max_broadcast=bound, hot=hot, block=block).collect()}
    assert got == groups(rows)


def test_deduplicate_and_repeats(spark):
    rows = corpus(4, 10)
    df = spark.createDataFrame(rows + rows[:5] + [(None, rows[0][1])], "doc_id long, text string")
    want = {i for i, (_, _, kept) in groups(rows).items() if kept}
    got = [r.doc_id for r in neardup.deduplicate(df).collect()]
    assert Counter(x for x in got if x is not None) == Counter(want) and None in got
    assert neardup.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_by_tiles(monkeypatch):
    some = ["a b c d e f", "x" * 5000 + " y z w v u", None, "é 😀 A a"]
    whole = [s.tolist() for s in shingles.shingle_sets(some)]
    monkeypatch.setattr(shingles, "TILE", 64)
    assert [s.tolist() for s in shingles.shingle_sets(some)] == whole
    assert [len(s) for s in whole] == [2, 2, 0, 1]


def test_sketches_estimate():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for kept in (1000, 950, 900):
        b = np.concatenate((a[:kept], rng.integers(0, 2**63, 1000 - kept).astype(np.uint64)))
        j = kept / (2000 - kept)
        x, y = neardup.odd_sketches(neardup.minhashes([np.unique(a), np.unique(b)]))
        assert abs(neardup.estimate(x, y) - j) < 0.15
        difference = int(np.bitwise_count((neardup.parities(a) ^ neardup.parities(b)).view(np.uint64)).sum())
        assert difference <= 2 * (1000 - kept)  # never over the symmetric difference


def test_recall_at_the_threshold():
    """Pairs at a similarity of exactly 0.75: all share a band, and no sketch or parity rule parts them."""
    rng = np.random.default_rng(16)
    xs, ys = [], []
    for _ in range(4000):
        u = int(rng.choice([2, 5, 25, 100, 400]))
        some = rng.integers(0, 2**63, 4 * u).astype(np.uint64)
        cut = 3 * u + int(rng.integers(0, u + 1))
        xs.append(np.unique(some[:cut]))
        ys.append(np.unique(np.concatenate((some[:3 * u], some[cut:]))))
    a, b = neardup.minhashes(xs), neardup.minhashes(ys)
    assert (neardup.bands(a) == neardup.bands(b)).any(1).all()
    differ = np.bitwise_count(neardup.odd_sketches(a) ^ neardup.odd_sketches(b)).sum(1)
    assert differ.max() <= neardup.FAR and 35 < differ.mean() < 45
    for x, y in zip(xs[:300], ys[:300]):
        off = int(np.bitwise_count((neardup.parities(x) ^ neardup.parities(y)).view(np.uint64)).sum())
        assert 7 * off <= len(x) + len(y)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, long, "c", True), (2, long + " tail", "c", True), (None, long, "c", True), (3, None, "c", True), (4, "", "c", True), (5, "a b", "c", True), (6, "A  b", "c", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept boolean")
    got = neardup.group(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {
        1: (59_996, 1, True), 2: (59_997, 1, False), None: (59_996, None, True), 3: (0, 3, True), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False)}
    assert neardup.deduplicate(df).columns == df.columns


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark, mine = bytearray(len(b)), set()
        for p in range(len(b) - 49):
            g = b[p:p + 50]
            if g in first:
                mark[p:p + 50] = b"\1" * 50
            else:
                mine.add(g)
        first.update(dict.fromkeys(mine, i))
        out[i] = bytes(c for c, m in zip(b, mark) if not m)
    return out


@pytest.mark.parametrize(("batch", "knots"), [(2_000, 4096), (500, 3), (1 << 20, 4096)])
def test_repeated_strings(spark, batch, knots):
    rng = random.Random(7)
    passage = "".join(rng.choice("abé ") for _ in range(180))
    rows = []
    for k in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300)))
        a = rng.randrange(100)
        rows.append((k * 2 - 20, own + passage[a:a + rng.randint(30, 80)] + own[:40] if k % 3 else passage))
    rows += [(500, "z" * 4000), (501, "z" * 200), (502, None), (503, "\0" * 60), (504, "\0" * 120)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.remove_repeats(df, batch_bytes=batch, knots=knots).collect()}
    want = repeats(rows)
    assert {i: bytes(r.kept) for i, r in got.items()} == want
    for i, t in rows:
        b = (t or "").encode()
        assert sum(s.end - s.start for s in got[i].spans) == len(b) - len(want[i]) and got[i].n_bytes == len(b)


def test_ranges_ascend():
    rng = random.Random(18)
    ids = sorted(rng.randint(-10**9, 10**12) for _ in range(500))
    for per in (1, 7):
        ranges = suffix.Ranges(ids[50:-50:100], per, ids[0], ids[-1])
        of = [ranges.of(i) for i in ids]
        assert of == sorted(of) and of[0] == 0 and max(of) < 5 * per


def test_repeated_strings_clashing_columns_and_long_texts(spark):
    rng = random.Random(19)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(7 << 20))
    rows = [(1, long, "s", b"k"), (2, "x" + long[100:400] + "y", "s", b"k"), (3, None, "s", b"k")]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans string, kept binary"))
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in got.collect()} == {1: (7 << 20, long.encode()), 2: (302, b"xy"), 3: (0, b"")}


def test_repeated_strings_odd_rows(spark):
    long = "q" * 30 + "0123456789" * 9
    df = spark.createDataFrame([(None, long), (None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    got = Counter((r.doc_id, len(r.kept)) for r in suffix.remove_repeats(df).collect())
    assert got == {(None, 120): 2, (1, 120): 2, (2, 0): 1}
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_repeated_strings_in_any_row_order(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(120)
    rows = [(k, text(40 + 7 * k) + (passage if k % 2 else "") + text(30)) for k in range(24)] + [(30, text(90) + passage), (30, passage)]
    want = repeats(rows[:24])
    last = Counter(repeats([*rows[:24], row])[30] for row in rows[24:])
    first, cut = suffix._contexts, suffix._cut

    def permuted(docs, by):
        return docs.take(np.random.default_rng(by).permutation(docs.num_rows))

    def contexts(shards):
        work = first(shards)
        return lambda docs, shared: work(permuted(docs, 1), shared)

    monkeypatch.setattr(suffix, "_contexts", contexts)
    monkeypatch.setattr(suffix, "_cut", lambda docs, marks: cut(permuted(docs, 2), marks))
    for batch in (1_500, 1 << 20):
        got = [(r.doc_id, bytes(r.kept)) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=batch).collect()]
        assert {i: kept for i, kept in got if i < 30} == want
        assert Counter(kept for i, kept in got if i == 30) == last


def test_levels_merge_geometrically():
    levels, seen = suffix.Levels(), set()
    rng = random.Random(8)
    for _ in range(60):
        keys = np.unique(np.array([f"{rng.randrange(5000):050d}".encode() for _ in range(rng.randint(1, 40))], "S50"))
        found = levels.scan(keys)
        assert found.tolist() == [k in seen for k in keys.tolist()]
        levels.add(keys[~found])
        seen.update(keys.tolist())
    sizes = [len(x) for x in levels.levels]
    assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) < 12


def contaminated(docs, items):
    def grams(t):
        w = [x for x in (t or "").lower().split()]
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    out = {}
    for d, t in docs:
        s = grams(t)
        for i, x in items:
            g = grams(x)
            if not g or not s:
                continue
            m, best = Counter(g), None
            for p in range(max(0, len(s) - len(g)) + 1):
                w = Counter(s[p:p + len(g)])
                n = sum((w & m).values())
                u = sum((w | m).values())
                if 4 * n >= 3 * u and (best is None or (n, p) >= best[:2]):
                    best = (n, p, n / u)
            if best:
                out[(d, i)] = best
    return out


def test_contamination(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(200)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 40])))) for k in range(12)] + [(50, "too short"), (51, None), (52, "x y x y x y x y x y")]
    docs = []
    for k in range(60):
        fill = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(fill))
        leak = items[rng.randrange(12)][1].split() if k % 2 else []
        for _ in range(rng.randint(0, 3)):
            if leak:
                leak[rng.randrange(len(leak))] = "zz"
        if leak and k % 5 == 0:
            leak.insert(len(leak) // 2, "inserted")
        docs.append((k, " ".join(fill[:at] + leak + fill[at:])))
    docs += [(100, None), (101, ""), (102, "X y x y x y x y x y x y x y x y")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_common, r.start_word, r.similarity) for r in decon.find(d, b).collect()}
    assert got == contaminated(docs, items)
    left = {r.doc_id for r in decon.decontaminate(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}
    assert decon.find(d.limit(0), b).count() == 0 and decon.find(d, b.limit(0)).count() == 0


def test_contamination_with_repeated_shingles(spark):
    rng = random.Random(13)
    items, docs = [], []
    for k in range(12):
        own = [f"a{k}_{rng.randrange(10**6)}" for _ in range(53)]
        items.append((k, " ".join([f"x{k}"] * 14 + own)))
        docs.append((k, " ".join([f"x{k}"] * 5 + own + [f"b{k}_{j}" for j in range(20)])))
    want = contaminated(docs, items)
    assert len(want) == 12
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.n_common, r.start_word, r.similarity) for r in decon.find(d, b).collect()} == want


def test_contamination_of_short_texts_at_the_threshold(spark):
    """Sets of three of four shingles, and of six of eight, whose fingerprints may differ in more bits than RADIUS."""
    items = [(k, " ".join(f"s{k}_{j}" for j in range(8 if k % 4 else 12))) for k in range(400)]
    docs = [(k, text.rpartition(" ")[0] if k % 4 else text.rsplit(" ", 2)[0]) for k, text in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_common, r.start_word, r.similarity) for r in decon.find(d, b).collect()}
    assert got == {(k, k): (3 if k % 4 else 6, 0, 0.75) for k in range(400)}


def test_hamming_blocks_cover_the_radius(spark):
    rng = random.Random(10)
    rows = []
    for k in range(200):
        x = [rng.getrandbits(64) for _ in range(decon.LONGS)]
        y = list(x)
        for bit in rng.sample(range(64 * decon.LONGS), decon.BLOCKS - 1):
            y[bit // 64] ^= 1 << bit % 64
        rows.append((k, [v - 2**64 * (v >> 63) for v in x], [v - 2**64 * (v >> 63) for v in y]))
    df = spark.createDataFrame(rows, "k int, x array<long>, y array<long>")
    same = F.arrays_overlap(decon.blocks_column(F.col("x")), decon.blocks_column(F.col("y")))
    assert df.where(same & (decon.distance_column(F.col("x"), F.col("y")) == decon.BLOCKS - 1)).count() == 200


def test_fingerprints_at_the_threshold_and_of_strangers(spark):
    """Recall at a similarity of exactly 0.75, and how many unrelated pairs the blocks and the radius leave."""
    rng = random.Random(14)
    fresh = lambda n: [rng.getrandbits(64) - 2**63 for _ in range(n)]
    rows = []
    for k in range(3000):
        u = rng.choice([4, 8, 12, 20])
        common, rest = fresh(3 * u), fresh(u)
        cut = rng.randint(0, u)
        rows.append((k, common + rest[:cut], common + rest[cut:], fresh(4 * u)))
    df = spark.createDataFrame(rows, "k int, x array<long>, y array<long>, z array<long>").select(*[decon.fingerprint_column(F.col(c)).alias(c) for c in "xyz"])
    meet = lambda a, b: F.arrays_overlap(decon.blocks_column(F.col(a)), decon.blocks_column(F.col(b)))
    near = lambda a, b: decon.distance_column(F.col(a), F.col(b)) <= decon.RADIUS
    r = df.agg(F.count_if(meet("x", "y")).alias("met"), F.count_if(near("x", "y")).alias("near"), F.count_if(meet("x", "z")).alias("chance"), F.count_if(near("x", "z")).alias("far")).first()
    assert r.met >= 2999 and r.near >= 2999
    assert r.chance < 0.25 * 3000 and r.far == 0


def test_numbered_sets(spark):
    rng = random.Random(15)
    rows = [(k, [rng.randrange(6) for _ in range(rng.randint(0, 30))], [rng.randrange(6) for _ in range(rng.randint(0, 30))]) for k in range(200)] + [(200, [], []), (201, [7] * 50, [7] * 20)]
    df = spark.createDataFrame(rows, "k int, x array<long>, y array<long>")
    x = decon.numbered(df.select("k", F.col("x").alias("s"))).withColumnRenamed("s", "x")
    y = decon.numbered(df.select("k", F.col("y").alias("s"))).withColumnRenamed("s", "y")
    got = {r.k: (r.n, r.a) for r in x.join(y, "k").select("k", F.size(F.array_intersect("x", "y")).alias("n"), F.size("x").alias("a")).collect()}
    assert got == {k: (sum((Counter(a) & Counter(b)).values()), len(a)) for k, a, b in rows}


def test_contamination_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {item} y", 9), (1, f"x {item} y", 9), (None, item, 9), (2, None, 9), (3, "q " * 30_000 + item, 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(5, item), (6, item), (7, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in decon.find(d, b).collect()) == [(1, 5, 1.0), (1, 6, 1.0), (3, 5, 1.0), (3, 6, 1.0)]
    left = decon.decontaminate(d, b)
    assert left.columns == d.columns and [r.doc_id for r in left.collect()] == [None, 2] or sorted(str(r.doc_id) for r in left.collect()) == ["2", "None"]


def test_simhash(spark):
    rng = random.Random(11)
    some = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 7, 40)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(some)], "k int, v array<long>")
    got = {r.k: r.f for r in df.select("k", decon.simhash_column(F.col("v")).alias("f")).collect()}
    for k, v in enumerate(some):
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in v) + (min(v) >> b & 1) > len(v))
        assert got[k] % 2**64 == want


def test_pipeline_keeps_and_drops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (_, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = kept
        docs = function(spark, docs, SF).cache()
        kept = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and kept <= before and (k != 3 or kept == before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    import hashlib

    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in last.collect()} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept
