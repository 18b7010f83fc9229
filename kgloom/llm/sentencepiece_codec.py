"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece has a white-space marker after another character (checked when the model is loaded), no
merge crosses the start of a marked word, so a text's ids are the concatenation of its marked words' ids. Each task
keeps a table of the distinct marked words it has met, segments each of them once, and joins the ids back by
position with array takes. Nothing is shuffled. A model that breaks the condition, and a text that holds the marker
itself, is encoded whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CUT = "\ue0f7"  # stands for a cut; texts that hold it, or the marker, are encoded whole
SLICE = 8_000_000  # bytes of text encoded at once
TABLE_SIZE = 200_000  # distinct words a task keeps; beyond it the table starts anew (results are the same)


class Codec:
    """One model, with the table of distinct chunks met so far."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._plain()
        self.raw = pa.array([self._bytes(i, p) for i, p in enumerate(pieces)], pa.binary())
        self._reset()

    def _plain(self) -> bool:
        """The normaliser changes nothing but spaces and puts one marker before a text."""
        probe = "a  b ÉﬁＡ\n c"
        first = self.sp.encode("a", out_type=str)
        return first[0].startswith(MARK) and self.sp.decode(self.sp.encode(probe)) == probe

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.sp.is_control(i):
            return b""
        if self.sp.is_unknown(i):
            return " ⁇ ".encode()
        if self.sp.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(MARK, " ").encode()

    def _reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _look_up(self, keys: pa.Array) -> np.ndarray:
        """Table rows of the chunks, by position; adds what is new. A chunk's key is the chunk without its first marker."""
        coded = pc.dictionary_encode(keys)
        words = coded.dictionary.to_pylist()
        if len(self.seen) > TABLE_SIZE:
            self._reset()
        seen = self.seen
        new = [w for w in words if w not in seen] if seen else words
        if new:
            # The marker that the model puts before a text is the chunk's own first marker.
            got = self.sp.encode(new, num_threads=1)
            if "" in new:  # a space that ends a text: a marker alone
                got[new.index("")] = [self.sp.piece_to_id(MARK)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            base = self.at[-1] + self.n[-1] if len(self.at) else 0
            self.at = np.concatenate([self.at, base + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.ids.append(np.fromiter(chain.from_iterable(got), np.int32, int(n.sum())))
            seen.update(zip(new, range(len(seen), len(seen) + len(new))))
        rows = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        return rows[coded.indices.to_numpy(zero_copy_only=False)]

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        """Keys of each text's chunks. A chunk is a run of spaces with what follows, up to the next run; a space goes before each text."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " ")
        runs = pc.replace_substring_regex(pc.binary_join_element_wise("", texts, " "), " ( *)", f"{_CUT}\\1")
        return pc.list_slice(pc.split_pattern(runs, _CUT), 1)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return self._run(texts, False)[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, all ids in turn)."""
        return self._run(texts, True)

    def _run(self, texts: pa.Array, want: bool) -> tuple[np.ndarray, np.ndarray | None]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.splits:
            return self._whole(texts)
        odd = pc.or_(pc.match_substring(texts, _CUT), pc.match_substring(texts, MARK))  # a marker of the text's own may join what precedes it
        if pc.any(odd).as_py():
            odd = odd.to_numpy(zero_copy_only=False)
            n, flat = np.zeros(len(texts), np.int64), []
            parts = [self._run(texts.filter(pa.array(~odd)), True), self._whole(texts.filter(pa.array(odd)))]
            for mask, (k, ids) in zip((~odd, odd), parts):
                n[mask] = k
                flat.append(np.split(ids, np.cumsum(k)[:-1]) if len(k) else [])
            normal, whole = map(iter, flat)
            return n, np.concatenate([next(whole) if o else next(normal) for o in odd])
        chunks = self._chunks(texts)
        rows = self._look_up(chunks.flatten())
        ends = chunks.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        n = self.n[rows]
        n[ends[:-1][pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)]] = 0  # an empty text has no chunk
        upto = np.concatenate(([0], np.cumsum(n)))
        total = upto[ends[1:]] - upto[ends[:-1]]
        if not want:
            return total, None
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        take = np.repeat(self.at[rows] - upto[:-1], n) + np.arange(upto[-1])
        return total, self.ids[0][take] if len(take) else np.zeros(0, np.int32)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = self.sp.encode(texts.to_pylist(), num_threads=1)
        n = np.fromiter(map(len, got), np.int64, len(got))
        return n, np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of id lists: pieces joined, the first marker taken off, bytes that are no UTF-8 as U+FFFD."""
        flat = ids.flatten()
        parts = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), self.raw.take(flat))
        joined = pc.binary_join(parts, pa.scalar(b"", pa.binary())).to_pylist()
        joined = [None if gone else b for gone, b in zip(ids.is_null().to_pylist(), joined)]
        return pa.array([None if b is None else b[1:].decode("utf-8", "replace") if b[:1] == b" " else b.decode("utf-8", "replace") for b in joined], pa.string())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(batches, model: str, ids: bool):
    c = codec(model)
    for batch in batches:
        for lo, hi in C.byte_ranges(batch.column(1), SLICE):
            part = batch.column(1).slice(lo, hi - lo)
            none = part.is_null().to_numpy(zero_copy_only=False)
            n, flat = c.encode(part) if ids else (c.counts(part), None)
            cols = [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int32), mask=none)]
            if ids:
                off = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32), mask=np.append(none, False))
                cols.append(pa.ListArray.from_arrays(off, pa.array(flat)))
            yield pa.record_batch(cols, names=["id", "n_tokens", "ids"][: len(cols)])


def with_token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens); see encode()."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _encode(it, model, False), "id long, n_tokens int").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of whole texts, equal to the library's own encoding, one row for each row of docs.

    A null text has null n_tokens and ids, an empty one 0 and []; null and repeated ids and repeated rows are kept as they
    are; other columns are not looked at, whatever their names; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _encode(it, model, True), "id long, n_tokens int, ids array<int>").withColumnRenamed("id", id_col)


def _decode(batches, model: str):
    c = codec(model)
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            yield pa.record_batch([*part.columns, c.decode(part.column(part.num_columns - 1))], names=[*part.schema.names, "text"])


def decode(tokens: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the inverse of encode(), one row for each row of tokens.

    A null list gives a null text, an empty one an empty text; null and repeated ids and repeated rows are kept as they are; lists of any
    length are read whole; other columns are not looked at, whatever their names; an empty table gives no rows.
    """
    src = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(lambda it: _decode(it, model), "id long, ids array<int>, text string").withColumnRenamed("id", id_col)


def _encode_and_decode(batches, model: str):
    c = codec(model)
    for batch in batches:
        at = 0
        for out in _encode([batch], model, True):
            same = pc.equal(c.decode(out.column(2)), batch.column(1).slice(at, out.num_rows))
            at += out.num_rows
            yield pa.record_batch([*out.columns, same], names=[*out.schema.names, "round_trip"])


def encode_checked(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() plus `round_trip`: whether decoding the ids gives the text back exactly (null for a null text)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _encode_and_decode(it, model), "id long, n_tokens int, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)
