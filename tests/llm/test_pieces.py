"""The table of pieces against the library, on white space, marks and letters of many kinds."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from sluice.llm import tokens

PARTS = [*"abZéÖ×÷ÿɏɿʰЖعאあー中한😀", "the", "\u1680", "\u180e", "\u0301", "\u200b", "\u2028", "\u2009", "\u205f", "\u3000", "\xa0", "\x85", "\xad",
         "\x00", "\x1c", "\x1f", "\x7f", "\ufeff", "²", "½", "٣", "1", "99", "'", "'s", "'ll", "'T", '"', "$", "$$", "!", "?", ".", ",", "_",
         "<|endoftext|>", *[" "] * 12, *["\n"] * 8, "  ", "\t", "\r\n", "\v", "\f"]


@pytest.fixture(scope="module")
def definition():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("kind, bound", [("<u2", 200), ("<u4", 100_000)])
def test_ids_of_pieces(definition, monkeypatch, kind, bound):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_str(definition)
    ref.encode_special_tokens = True
    table, rng = tokens._cache(definition, kind), random.Random(11)
    monkeypatch.setattr(table, "_bound", bound)
    for _ in range(60):
        some = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(rng.choice((1, 40)))] + rng.choices(("", None, "\n", "\nthe", "the\n", " ", "a" * 300), k=2)
        for t, ids in zip(some, table.encode(some), strict=True):
            assert np.frombuffer(ids, kind).tolist() == ref.encode(t or "", add_special_tokens=False).ids, t
        assert len(table._pieces) <= bound + 2000
    assert table.encode([]) == [] and table.encode([None, ""]) == [b"", b""]


def test_known_words_are_not_encoded_again(definition, monkeypatch):
    table, sent = tokens._cache(definition, "<u2"), []
    table.encode(["x thionwh ofonstbly éaieux", "Er\nThat"])
    inner = table._encode
    monkeypatch.setattr(table, "_encode", lambda pieces: sent.extend(pieces) or inner(pieces))
    table.encode(["x thionwh$$$ ofonstbly!!\nThat éaieux%%% thionwh.", "Er ofonstbly,***\nThat? éaieux.\nThat"])
    assert not [p for p in sent if any(c.isalpha() for c in p)]


def test_full_table_keeps_what_was_used_last(definition, monkeypatch):
    table = tokens._cache(definition, "<u4")
    monkeypatch.setattr(table, "_bound", 100)
    for k in range(20):
        table.encode([f"x kept q{'abcdefghijklmnopqrst'[k]}" + "".join(f" w{k}v{i}" for i in range(30))])
        assert len(table._pieces) <= 200
    assert b" kept" in table._pieces.to_pylist()
