"""Encoding with a public byte-level BPE tokenizer (problem 7).

Texts are cut at spaces that always begin a token; each different piece is encoded once per worker.
New pieces are encoded together: the symbols of all their words lie in one flat array, and in each
round every word merges its pair of lowest rank, found by binary search over the sorted pair keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
KEPT_PIECES = 400_000
NONE = np.int64(2**62)
# The pattern that cuts texts into words, with white space spelled out as in Unicode.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_IRREGULAR = re.compile(r" (?:\s|$)")
_CUT = re.compile(r"(?= \S)")


def _byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_merges(path: str = DEFAULT_VOCABULARY) -> dict[str, np.ndarray]:
    """Merge table of a vocabulary file: ids of the bytes, sorted pair keys, their ranks and merged ids."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, letters = model["vocab"], _byte_letters()
    size = max(vocab.values()) + 1
    bytes_ = np.zeros(256, np.int64)
    for letter, b in letters.items():
        bytes_[b] = vocab[letter]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    return {"bytes": bytes_, "keys": keys[order], "ranks": order.astype(np.int64), "merged": merged[order], "size": np.int64(size)}


def merge_rounds(words: list[bytes], table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, offsets)`` of the words, all encoded together; an empty word has no ids."""
    keys, ranks, merged, size = table["keys"], table["ranks"], table["merged"], table["size"]
    lengths = np.array([len(w) for w in words], np.int64)
    sym = table["bytes"][np.frombuffer(b"".join(words), np.uint8)]
    wid = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        key = sym[:-1] * size + sym[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.full(len(sym), NONE)
        hit = (keys[at] == key) & (wid[:-1] == wid[1:])
        rank[:-1][hit] = ranks[at[hit]]
        starts = np.flatnonzero(np.concatenate([[True], wid[1:] != wid[:-1]]))
        least = np.minimum.reduceat(rank, starts)
        each = np.repeat(least, np.diff(np.append(starts, len(sym))))
        over = each == NONE
        if over.any():
            done.append((wid[over], sym[over]))
        left = np.flatnonzero((rank == each) & ~over)
        if not len(left):
            break
        # of overlapping places of one pair, as in "aaa", every second one counts from the left
        first = np.concatenate([[True], np.diff(left) != 1])
        run = np.arange(len(left)) - np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))
        left = left[run % 2 == 0]
        sym[left] = merged[at[left]]
        keep = ~over
        keep[left + 1] = False
        sym, wid = sym[keep], wid[keep]
    counts = np.zeros(len(words), np.int64)
    if done:
        w = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])[np.argsort(w, kind="stable")]
        counts = np.bincount(w, minlength=len(words))
    else:
        ids = np.zeros(0, np.int64)
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def _gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``which`` of (flat, offsets), one after another, and their lengths."""
    lengths = offsets[which + 1] - offsets[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(offsets[which] - (ends - lengths), lengths)
    return flat[index], lengths


class _Codes(dict):
    """Numbers the pieces it is asked for, in order of first sight."""

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.fresh.append(piece)
        return code


class Encoder:
    """Encodes lists of texts; keeps the ids of the pieces it has seen, up to KEPT_PIECES of them."""

    def __init__(self, table: dict[str, np.ndarray]):
        import regex

        self.table, self.words_of = table, regex.compile(PATTERN).findall
        self.reset()

    def reset(self) -> None:
        self.codes = _Codes()
        self.codes.fresh = []
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        fresh, self.codes.fresh = self.codes.fresh, []
        if not fresh:
            return
        words = _Codes()
        words.fresh = []
        pieces = [[words[w] for w in self.words_of(piece)] for piece in fresh]
        ids, offsets = merge_rounds([w.encode("utf-8", "replace") for w in words], self.table)
        which = np.fromiter((w for p in pieces for w in p), np.int64)
        flat, lengths = _gather(ids, offsets, which)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        total = np.concatenate([[0], np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, flat])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + total[ends[1:]]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``; null and empty texts have no ids."""
        if len(self.codes) > KEPT_PIECES:
            self.reset()
        code = self.codes.__getitem__
        found, counts = [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            if _IRREGULAR.search(text) or text[0] == " ":
                pieces = [p for p in _CUT.split(text) if p]
            else:
                pieces = (" " + text.replace(" ", "\0 ")).split("\0") if "\0" not in text else [p for p in _CUT.split(text) if p]
                if pieces[0][0] == " ":
                    pieces[0] = pieces[0][1:]
            found.extend(map(code, pieces))
            counts.append(len(pieces))
        self._learn()
        ids, lengths = _gather(self.flat, self.offsets, np.array(found, np.int64))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]


def _batches(batch: pa.RecordBatch, at: int, rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = DEFAULT_VOCABULARY, count_only: bool = False) -> DataFrame:
    """``df`` without ``text`` and with ``out``: its ids ARRAY<INT> by the vocabulary file at ``path``, without special tokens.

    null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
    Lone surrogates, which no UTF-8 text has, count as '?'. With ``count_only``, ``out`` is the number
    of ids (INT). Other columns pass through; an existing column ``out`` is replaced. The merge table,
    under 2 MB whatever the data, is the only thing broadcast.
    """
    df = df.drop(out) if out != text else df
    at = df.schema.names.index(text)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(out, T.IntegerType() if count_only else T.ArrayType(T.IntegerType(), False))])
    table = df.sparkSession.sparkContext.broadcast(load_merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(path, table.value)
        for whole in batches:
            for batch in _batches(whole, at):
                ids, offsets = encoder.encode(batch.column(at).to_pylist())
                made = pa.array(np.diff(offsets).astype(np.int32)) if count_only else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], made], names=schema.names)

    return df.mapInArrow(run, schema)


_ENCODERS: dict[str, Encoder] = {}


def _worker_encoder(path: str, table: dict[str, np.ndarray]) -> Encoder:
    """The worker's encoder of a vocabulary, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(table)
    return _ENCODERS[path]
