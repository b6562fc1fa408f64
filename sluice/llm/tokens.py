"""Token ids by the tokenizers library, with a bounded table of pieces that are encoded once.

Defined cases: null text counts as empty; special tokens' strings in a text are ordinary
text; a text of any length is encoded whole; rows are encoded one by one, repeated or not;
input columns named like the output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm.arrow import with_columns
from sluice.llm.pieces import LONGEST, PieceTable

#: Pieces, of LONGEST characters at most, encoded as one text, and others encoded in one call.
JOINED, ALONE = 2048, 64

_known: dict[int, PieceTable] = {}


def _cache(definition: str, kind: str = "<u4") -> PieceTable:
    key = hash((definition, kind))
    if key not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.encode_special_tokens = True

        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            sizes[i] = len(token)  # a byte-level token has a character for each byte

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            # pieces that begin and end at breaks of their own are encoded as one text and told apart by their sizes;
            # those without a space before them have a line break between them
            led, bare, alone = [], [], []
            for k, p in enumerate(pieces):
                if len(p) > LONGEST or p[-1].isspace() or p[:2].isspace():
                    alone.append(k)
                elif p[0] == " ":
                    led.append(k)
                else:
                    (alone if p[0].isspace() else bare).append(k)
            starts, counts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
            flat, held = [np.zeros(0, kind)], 0
            for group, between in ((led, ""), (bare, "\n")):
                for i in range(0, len(group), JOINED):
                    some = group[i:i + JOINED]
                    ids = np.array(tokenizer.encode_batch_fast([between.join([pieces[k] for k in some])], add_special_tokens=False)[0].ids)
                    lengths = np.array([len(pieces[k].encode()) for k in some])
                    ends = np.cumsum(lengths + len(between)) - len(between)
                    before = np.cumsum(sizes[ids]) - sizes[ids]  # bytes before each id
                    first = np.searchsorted(before, ends - lengths)
                    starts[some], counts[some] = held + first, np.searchsorted(before, ends) - first
                    flat.append(ids.astype(kind))
                    held += len(ids)
            for i in range(0, len(alone), ALONE):
                some = alone[i:i + ALONE]
                for k, m in zip(some, tokenizer.encode_batch_fast([pieces[k] for k in some], add_special_tokens=False)):
                    starts[k], counts[k] = held, len(m.ids)
                    flat.append(np.array(m.ids, kind))
                    held += len(m.ids)
            return np.concatenate(flat), starts, counts

        _known.clear()
        _known[key] = PieceTable(encode, kind)
    return _known[key]


def encode(df: DataFrame, tokenizer_file: str, text_col: str = "text", ids_col: str = "ids", end_id: int | None = None,
           width: int = 4, counts_col: str | None = None) -> DataFrame:
    """``df`` with ``ids_col``: little-endian unsigned ids of the text (of ``width`` bytes, 2 or 4), ``end_id`` appended if given.

    With ``counts_col`` some rows hold in it the counts of the ids of several rows, as
    little-endian unsigned 32-bit pairs of id and count; together they count all ids.
    The tokenizer must be byte-level with the public split pattern and no normaliser,
    for which the ids of a text are those of its pieces.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    end, kind = b"" if end_id is None else end_id.to_bytes(width, "little"), f"<u{width}"
    targets = {ids_col: T.BinaryType()} | ({counts_col: T.BinaryType()} if counts_col else {})

    def make():
        cache = _cache(shared.value, kind)

        def run(texts):
            ids = [i + end for i in cache.encode(texts)]
            if not counts_col:
                return [ids]
            many = np.bincount(np.frombuffer(b"".join(ids), kind)).astype("<u4")
            used = np.flatnonzero(many).astype("<u4")
            return [ids, [np.stack((used, many[used]), 1).tobytes(), *[None] * (len(ids) - 1)]]

        return run

    return with_columns(df, [text_col], targets, make, step=1000)
