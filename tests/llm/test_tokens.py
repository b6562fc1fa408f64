"""Encoders against the public libraries, counts against a lattice, files against their input."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from sluice.llm import bpe, rans, tokens, unigram

ALPHABET = "abc d'sllre \n\t  éè中文１２\x1c\xa0😀.,!?#$%_"


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", " ", "  ", "x ", " x", "it's we'll <|endoftext|> 12345"]


@pytest.fixture(scope="module")
def coder():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.ByteBPE(bpe.parse_ranks(f.read()), P.PATTERN)


def test_bpe_equals_tiktoken(coder):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(2)
    some = texts(1500) + ["a" * 3000, "".join(rng.choice("abcdefgh") for _ in range(4000))]
    for t, ids in zip(some, coder.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t or "")
        assert coder.decode(ids) == (t or "").encode()


def test_bpe_frames(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts(50))], "k int, text string, ids string")
    vocabulary = P.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decode(bpe.encode(df, vocabulary, P.PATTERN), vocabulary, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    both = {r.k: bytes(r.ids) for r in bpe.round_trip(df, vocabulary, P.PATTERN).collect()}
    assert both == {r.k: bytes(r.ids) for r in back.collect()}
    assert bpe.encode(df.limit(0), vocabulary, P.PATTERN).count() == 0


def test_pair_table_finds_all():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 500, 4000).astype(np.int32), rng.integers(0, 500, 4000).astype(np.int32)
    pairs = np.unique(np.stack((left, right), 1), axis=0)
    table = bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert (table(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (table(np.array([501, -1], np.int32), np.array([1, 1], np.int32)) == 2**31 - 1).all()


def test_library_tokens_by_pieces():
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    ref = Tokenizer.from_str(definition)
    ref.encode_special_tokens = True
    some = texts(1500, 5)
    for kind in ("<u2", "<u4"):
        got = tokens._cache(definition, kind).encode(some)
        assert all(np.frombuffer(g, kind).tolist() == ref.encode(t or "", add_special_tokens=False).ids for g, t in zip(got, some))


def test_cache_generations():
    from sluice.llm.segments import SegmentCache

    cache = SegmentCache(lambda pieces: [p.encode() for p in pieces], bound=50, parts=True)
    some = texts(400, 6)
    for i in range(0, len(some), 20):
        assert cache.encode(some[i:i + 20]) == [(t or "").encode() for t in some[i:i + 20]]


def test_unigram_equals_library():
    from tokenizers import Tokenizer, models

    vocabulary = unigram.vocabulary_of(P.path("piece_bpe_32k.model"))
    ref, own = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, False)), unigram.Counter(vocabulary)
    for t in texts(1500, 7):
        marked = unigram.MARK + (t or "").replace(" ", unigram.MARK)
        e = ref.encode(marked)
        want = sum(len(marked[a:b].encode()) if i == 0 else 1 for i, (a, b) in zip(e.ids, e.offsets)) if t else 0
        assert own.count(t) == want, t


def test_unigram_ties_and_frames(spark):
    own = unigram.Counter([("ab", -2.0), ("a", -1.0), ("b", -1.0), ("▁", 0.0)])
    assert own.viterbi("ab") == (-2.0, 1) and own.count("ab") == 2  # the mark and the longer piece
    df = spark.createDataFrame([(1, "ab ab"), (2, None)], "k int, text string")
    assert {r.k: r.n_tokens for r in unigram.count_tokens(df, [("ab", -2.0), ("▁", 0.0)]).collect()} == {1: 4, 2: 0}
    with pytest.raises(ValueError):
        unigram.Counter([("a▁b", -1.0)])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 3000, 70000])
def test_rans_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50000).astype("<u4") if n else np.zeros(0, "<u4")
    symbols, counts = np.unique(np.append(ids, np.uint32(7)), return_counts=True)
    coder = rans.Coder(symbols, rans.quantise(counts))
    block = rans.pack(coder, [5, None, 6], [ids[:n // 3].tobytes(), b"", ids[n // 3:].tobytes()], lanes=16)
    docs, back = rans.unpack(coder, block)
    assert docs == [5, None, 6] and b"".join(back) == ids.tobytes()
    if n:
        marks, head = rans.checkpoints(block), rans._HEAD.unpack_from(block)
        words = np.frombuffer(block, "<u4", head[5], len(block) - 4 * head[5])
        parts = [coder.decode(n, s.astype(np.uint64), words, t, marks[i + 1][0] if i + 1 < len(marks) else None, o) for i, (t, o, s) in enumerate(marks)]
        assert (np.concatenate(parts) == ids).all() and (len(marks) > 1) == (n >= 3000)
        with pytest.raises(ValueError):
            rans.unpack(coder, block[:-1] + bytes([block[-1] ^ 1]))


def test_quantise_sums():
    for counts in ([1], [1, 10**12], [1] * 5000, list(range(1, 3000))):
        f = rans.quantise(np.array(counts), 14)
        assert f.sum() == 1 << 14 and f.min() >= 1


def test_token_files(spark, tmp_path):
    rows = [(k, [1, 2, 70000 + k][: k % 4]) for k in range(40)] + [(None, [9])]
    df = spark.createDataFrame([(k, bytes(np.array(v, "<u4").tobytes())) for k, v in rows], "id long, ids binary").repartition(5)
    rans.write(rans.placed(rans.in_id_order(df, "id", "ids").withColumnRenamed("value", "ids")), str(tmp_path / "t"))
    got = {r.id: (r.start, zlib.crc32(bytes(r.ids)), np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rans.read(spark, str(tmp_path / "t")).collect()}
    at = 0
    for k, v in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
        assert got[k] == (at, zlib.crc32(np.array(v, "<u4").tobytes()), v)
        at += len(v)


def test_token_files_empty(spark, tmp_path):
    rans.write(rans.placed(rans.in_id_order(spark.createDataFrame([], "id long, ids binary"), "id", "ids").withColumnRenamed("value", "ids")), str(tmp_path / "t"))
    assert rans.read(spark, str(tmp_path / "t")).count() == 0
