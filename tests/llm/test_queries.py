"""The registered queries whole, against the libraries and brute force, and the pipeline stage by stage."""

import hashlib
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import test_copies
import test_pii
import test_urls_chat_quality as quality_tests
from sluice.llm import bpe, pii, quality, queries, unigram

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_op4(spark, docs):
    want = test_copies.repeats([(i, r.text) for i, r in docs.items()])
    got = rows(queries.op4_suffix_array_dedup(spark, SF))
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(b).hexdigest() for i, b in want.items()}
    for i, r in got.items():
        size = len((docs[i].text or "").encode())
        assert r.n_bytes == size and r.n_removed == size - len(want[i]) and (r.n_spans > 0) == (r.n_removed > 0)


def test_op5(spark, docs):
    counter = unigram.Counter(unigram.vocabulary_of(queries.PIECES))
    got = rows(queries.op5_token_counts(spark, SF))
    assert {i: r.n_tokens for i, r in got.items()} == {i: counter.viterbi("▁" + r.text.replace(" ", "▁"))[1] if r.text else 0 for i, r in docs.items()}


def test_op6(spark, docs):
    got = rows(queries.op6_minhash_near_dedup(spark, SF))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == test_copies.groups([(i, r.text) for i, r in docs.items()])


def encoding():
    import tiktoken

    with open(queries.VOCABULARY, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_op7(spark, docs):
    enc = encoding()
    for i, r in rows(queries.op7_byte_bpe(spark, SF)).items():
        ids = enc.encode_ordinary(docs[i].text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(ids), hashlib.sha256((docs[i].text or "").encode()).hexdigest())


def test_op8(spark, docs):
    """Ids, offsets and sums read back from the files are the library's, in ascending id order."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.TOKENIZER)
    library.encode_special_tokens = True
    at, want = 0, {}
    for i in sorted(docs):
        ids = [*library.encode(docs[i].text or "", add_special_tokens=False).ids, queries.END_ID]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in rows(queries.op8_token_files(spark, SF)).items()} == want


def test_queries_of_empty_and_odd_tables(spark, tmp_path):
    """Every query over documents: no rows; and null, empty, repeated and very long texts."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x" * 200_000, "en", "s", 200_000), (4, "one two three four five six", "en", "s", 27), (5, "one two three four five six", "en", "s", 27)]
    benchmark = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    for name, some in (("none", []), ("odd", odd)):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        benchmark.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        for query in (queries.op2_pii, queries.op3_quality_rules, queries.op4_suffix_array_dedup, queries.op5_token_counts, queries.op6_minhash_near_dedup, queries.op7_byte_bpe, queries.op8_token_files):
            assert sorted(r.doc_id for r in query(spark, str(tmp_path / name)).collect()) == [x[0] for x in some], query.__name__
        assert sorted(r.doc_id for r in queries.op9_benchmark_decontamination(spark, str(tmp_path / name)).collect()) == ([4, 5] if some else [])
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0  # every odd text fails the quality rules


def redacted(text, spans):
    """The text with tags for (start, end, kind) spans, the first of overlapping ones."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1], f"[{s[2].upper()}]")):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_against_brute_force(spark, docs, items):
    """run() against each stage in plain Python on what the stage before kept."""
    measures = {i: quality_tests.measured(r.text) for i, r in docs.items()}
    base = {i: m[0] < 20 or 100 * m[4] > 30 * m[0] for i, m in measures.items()}
    soft = {i: bool(m[0]) and (m[2] > 0.5 * m[0] or m[3] > 0.1 * m[0] or not 2 <= m[1] / m[0] <= 12) or (not m[0] and m[2] > 0) for i, m in measures.items()}
    bad = quality_tests.verdicts([(r.source, base[i] or soft[i]) for i, r in docs.items()])
    left = [i for i, r in docs.items() if not base[i] and not (soft[i] and r.source in bad)]
    kept = [i for i, (_, _, first) in test_copies.groups([(i, docs[i].text) for i in left]).items() if first]
    leaked = {d for d, _ in test_copies.contaminated([(i, docs[i].text) for i in kept], items)}
    clean = [i for i in kept if i not in leaked]
    counts, found = {}, {i: test_pii.every(docs[i].text) for i in clean}
    for some in found.values():
        for k, _, _, _, c in some:
            counts.setdefault(k, Counter())[c] += 1
    model, enc = pii.model(counts), encoding()
    want = {}
    for i in clean:
        text = redacted(docs[i].text, [(a, b, k) for k, a, b, first, c in found[i] if first or c in model[k]])
        ids = enc.encode_ordinary(text)
        want[i] = (len(ids), digest(ids), hashlib.sha256(text.encode()).hexdigest())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
    assert all(hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 for r in got)


def test_quality_bounds_are_those_tested():
    assert (quality.MIN_WORDS, quality.MAX_REPEAT_PERCENT, quality.MAX_SYMBOLS_A_WORD, quality.MAX_DUP_LINES_A_WORD, quality.WORD_LENGTHS) == (20, 30, 0.5, 0.1, (2.0, 12.0))
