"""Token counts with a whole-token shortcut.

For a piece model whose vocabulary holds no piece with a space mark after another
character, a text falls into units (a run of spaces and the characters up to the next
space) that never merge with each other. Each vocabulary string of one mark and a word is
encoded alone beforehand; those that come out as the single token are proven whole and
counted by a table lookup. Only the remaining units are merged by the library, each
distinct one once per worker while the bounded memo lasts.

Nulls, empty texts: 0 tokens, 0 bytes. Repeated rows: one result row each. Long texts are
taken whole; a unit of over `MEMO_UNIT` characters is encoded without being remembered.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, quoted, spread

MEMO_UNITS, MEMO_UNIT, SLICE = 700_000, 64, 500
_MARK = "▁"
_UNIT = re.compile(" +[^ ]*")


def prove_whole(processor) -> dict[str, int]:
    """{word: 1} for each vocabulary string that the library encodes alone as its own single token."""
    out = {}
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if piece[:1] == _MARK and _MARK not in piece[1:] and processor.encode(piece[1:]) == [i]:
            out[piece[1:]] = 1
    return out


def units_are_independent(processor) -> bool:
    """True if no piece has a space mark after another character or holds a line feed, and a space is put in front."""
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    inner = any(_MARK in x.lstrip(_MARK) or "\n" in x for x in names)
    return not inner and processor.encode(" ", out_type=str) == [_MARK * 2] and processor.encode("") == []


class PieceCounter:
    """Counts tokens as sentencepiece gives them.

    Keys of the memo are units without their first space, which the library puts in front. A
    key that starts with a line feed stands for the unit's rest after a line feed (no piece
    spans one), so its count leaves out the mark."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.split = units_are_independent(self.sp)
        self.whole = prove_whole(self.sp) if self.split else {}
        self.whole[""] = 1  # a last space alone
        self.memo = dict(self.whole)

    def _lengths(self, keys: list[str]) -> list[int]:
        return [len(ids) for ids in self.sp.encode(keys, num_threads=1)]

    def _exact(self, text: str) -> int:
        """Unit by unit without the memo, for texts with runs of spaces."""
        keys = [u[1:] for u in _UNIT.findall(" " + text)]
        return sum(n if k else 1 for k, n in zip(keys, self._lengths(keys), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self._lengths(texts)
        out: list[int] = []
        rows: list[list[str] | None] = []
        for t in texts:
            t = t.replace(_MARK, " ") if _MARK in t else t
            plain = t and "  " not in t and " \n" not in t and t[0] not in " \n"
            rows.append(t.replace("\n", " \n").split(" ") if plain else None)
        memo = self.memo
        if len(memo) > MEMO_UNITS:
            memo.clear()
            memo.update(self.whole)
        new: set[str] = set()
        for keys in rows:
            if keys:
                new.update(keys)
        new = [k for k in new if k not in memo]
        for k, n in zip(new, self._lengths(new), strict=True):
            memo[k] = n - (k[0] == "\n")
        over = [k for k in new if len(k) > MEMO_UNIT]
        for t, keys in zip(texts, rows, strict=True):
            out.append(sum(map(memo.__getitem__, keys)) if keys else self._exact(t.replace(_MARK, " ")) if t else 0)
        for k in over:
            del memo[k]
        return out


class JsonCounter:
    """Counts tokens as the tokenizers library gives them, whole text by whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(self.tok.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


@lru_cache(2)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle."""
    src = spread(docs.select(quoted(key).alias("k"), quoted(text).alias("x")))
    src = src.select("k", F.coalesce("x", F.lit("")).alias("t"), F.coalesce(F.octet_length("x"), F.lit(0)).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for b in lean(batches):
            n = []
            for i in range(0, b.num_rows, SLICE):
                n += c(b.column("t").slice(i, SLICE).to_pylist())
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n_bytes"), n], names=["k", "n_bytes", "n_tokens"])

    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
