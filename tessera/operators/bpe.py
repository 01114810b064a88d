"""Training of byte-pair merges on counted pieces, encoding, decoding, and the text form of a model."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.shared import discard, materialize

Pair = tuple[int, int]
# The first line of a model file and the words that begin its parts.
HEADER, PATTERN, SPECIALS, MERGES = "bpe_tokenizer v1", "pattern", "special_tokens_count", "merges_count"


def pair_stats(df: DataFrame, ids: str) -> DataFrame:
    """``p0, p1, cnt``: how often each pair of neighbours occurs, overlapping ones included, over all rows."""
    a = F.col(ids)
    pairs = F.when(F.size(a) > 1, F.arrays_zip(F.slice(a, F.lit(1), F.size(a) - 1).alias("p0"), F.slice(a, F.lit(2), F.size(a) - 1).alias("p1")))
    return df.select(F.explode(pairs).alias("p")).select(F.col("p.p0").alias("p0"), F.col("p.p1").alias("p1")).groupBy("p0", "p1").agg(F.count("*").alias("cnt"))


def best_pair(stats: DataFrame) -> DataFrame:
    """The most frequent pair, of equal counts the smallest."""
    return stats.orderBy(F.desc("cnt"), "p0", "p1").limit(1)


def merge_pair(ids: Column, p0: int, p1: int, new: int) -> Column:
    """``ids`` with the pair replaced, from the left and without overlaps."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("int").alias("held"))

    def step(s: Column, x: Column) -> Column:
        joins = (s["held"] == p0) & (x == p1)
        out = F.when(joins, F.concat(s["out"], F.array(F.lit(new)))).when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"])))
        return F.struct(out.alias("out"), F.when(F.coalesce(joins, F.lit(False)), F.lit(None).cast("int")).otherwise(x).alias("held"))

    return F.aggregate(ids, start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))


def piece_counts(df: DataFrame, text: str, pattern: str | None) -> DataFrame:
    """``piece, freq``: the texts cut by ``pattern`` (whole texts without one), counted."""
    pieces = df.select(F.explode(tx.split_pattern(F.col(text), pattern)).alias("piece")) if pattern else df.select(F.col(text).alias("piece"))
    return pieces.where(F.length("piece") > 0).groupBy("piece").agg(F.count("*").alias("freq"))


def learn_merges(pieces: list[tuple[str, int]], size: int) -> dict[Pair, int]:
    """Merges up to ``size`` ids from counted pieces; counts are kept up to date where a merge changes them.

    The best pair comes from a heap of counts as they were when they last changed; those that have
    changed since are passed over.
    """
    seqs = [list(p.encode()) for p, _ in pieces]
    freq = [n for _, n in pieces]
    counts: Counter[Pair] = Counter()
    where: defaultdict[Pair, set[int]] = defaultdict(set)
    for i, s in enumerate(seqs):
        for p in zip(s, s[1:], strict=False):
            counts[p] += freq[i]
            where[p].add(i)
    heap = [(-n, p) for p, n in counts.items()]
    heapify(heap)
    merges: dict[Pair, int] = {}
    while len(merges) < size - 256 and heap:
        n, best = heappop(heap)
        if counts[best] != -n or not n:
            continue
        new = 256 + len(merges)
        merges[best] = new
        changed: set[Pair] = set()
        for i in where.pop(best):
            before = seqs[i]
            after = _merged(before, {best: new})
            for pairs, sign in ((zip(before, before[1:], strict=False), -freq[i]), (zip(after, after[1:], strict=False), freq[i])):
                for p in pairs:
                    counts[p] += sign
                    changed.add(p)
            for p in zip(after, after[1:], strict=False):
                where[p].add(i)
            seqs[i] = after
        for p in changed:
            if counts[p] > 0:
                heappush(heap, (-counts[p], p))
            else:
                del counts[p]
    return merges


def learn_counts(pieces: pa.Array, freq: np.ndarray, size: int) -> dict[Pair, int]:
    """The pairs of ``learn_merges`` in their order, with their counts, for many short pieces as bytes.

    The ids of all pieces lie in one array. A merge looks for its pair everywhere there, and counts anew
    only the pairs beside its places.
    """
    lengths = pc.binary_length(pieces).to_numpy()
    ids = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8).astype(np.int32)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    counts: Counter[int] = Counter()

    def tally(at: np.ndarray, sign: int) -> set[int]:
        changed: set[int] = set()
        at = at[(at >= 0) & (at < len(ids) - 1)]
        for part in np.array_split(at, len(at) // 1_000_000 + 1):
            part = part[owner[part] == owner[part + 1]]
            keys, place = np.unique(ids[part].astype(np.int64) << 32 | ids[part + 1], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, freq[owner[part]])
            for k, n in zip(keys.tolist(), sums.tolist(), strict=True):
                counts[k] += sign * n
                changed.add(k)
        return changed

    heap = [(-counts[k], k) for k in tally(np.arange(len(ids) - 1), 1)]
    heapify(heap)
    learned: dict[Pair, int] = {}
    while len(learned) < size - 256 and heap:
        n, key = heappop(heap)
        if counts[key] != -n or not n:
            continue
        a, b = pair = key >> 32, key & 0xFFFFFFFF
        hits = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b) & (owner[:-1] == owner[1:]))
        if a == b:  # of overlapping places, as in "aaa", every second one counts from the left
            each = np.arange(len(hits))
            hits = hits[(each - np.maximum.accumulate(np.where(np.diff(hits, prepend=-2) != 1, each, 0))) % 2 == 0]
        changed = tally(np.unique(np.concatenate([hits - 1, hits, hits + 1])), -1)
        ids[hits] = 256 + len(learned)
        kept = np.ones(len(ids), bool)
        kept[hits + 1] = False
        ids, owner = ids[kept], owner[kept]
        hits -= np.arange(len(hits))
        changed |= tally(np.unique(np.concatenate([hits - 1, hits])), 1)
        learned[pair] = -n
        for k in changed:
            if counts[k] > 0:
                heappush(heap, (-counts[k], k))
            else:
                del counts[k]
    return learned


def _merged(ids: list[int], merges: dict[Pair, int]) -> list[int]:
    """``ids`` with the pairs of ``merges`` replaced, from the left and without overlaps."""
    out: list[int] = []
    at, last = 0, len(ids) - 1
    while at <= last:
        new = merges.get((ids[at], ids[at + 1])) if at < last else None
        out.append(ids[at] if new is None else new)
        at += 1 if new is None else 2
    return out


def independent(ranked: list[tuple[Pair, int]]) -> list[Pair]:
    """The first pairs of a ranking (largest count first) that can be merged in one round with the result of merging one by one.

    Their ids are all different, so no merge changes another's count; and a pair that a merge makes
    occurs at most as often as the ranked pair it takes an id from, so nothing new can come before them
    while the first pair that shares an id with them is rarer. The first pair can always be merged.
    """
    used: set[int] = set()
    chosen: list[tuple[Pair, int]] = []
    for pair, n in ranked:
        if used & set(pair):
            rarer = [p for p, m in chosen if m > n]
            return rarer or [chosen[0][0]]
        used |= set(pair)
        chosen.append((pair, n))
    return [p for p, n in chosen if n > ranked[-1][1]] or [p for p, _ in chosen[:1]]


def _numbered(counts: dict[Pair, int]) -> dict[Pair, int]:
    return {p: 256 + i for i, p in enumerate(counts)}


def learn_merges_on_cluster(pieces: DataFrame, size: int, looked_at: int = 2_000) -> dict[Pair, int]:
    """The same merges as ``learn_merges``, from a table ``piece, freq`` of any size."""
    return _numbered(learn_counts_on_cluster(pieces, size, looked_at))


def learn_counts_on_cluster(pieces: DataFrame, size: int, looked_at: int = 2_000) -> dict[Pair, int]:
    """The pairs of ``learn_merges`` in their order, with their counts, from a table ``piece, freq`` of any size; pieces are texts or bytes.

    A round counts the pairs of all pieces on the cluster, brings the ``looked_at`` most frequent to the
    driver, and merges as many of them as are independent. Pieces never leave the cluster.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([list(p) for p in b.column(0).cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, b.column(1)], names=["ids", "freq"])

    seqs = materialize(pieces.mapInArrow(split, "ids array<int>, freq bigint"), "pieces")
    learned: dict[Pair, int] = {}
    while len(learned) < size - 256:

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).flatten().to_numpy().astype(np.int64)
                ends = np.cumsum(pc.list_value_length(b.column(0)).to_numpy())
                if len(ids) < 2:
                    continue
                inside = np.ones(len(ids) - 1, bool)
                inside[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(ids))] - 1] = False
                owner = np.searchsorted(ends, np.arange(len(ids) - 1), "right")
                keys, place = np.unique((ids[:-1] << 32 | ids[1:])[inside], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, b.column(1).to_numpy()[owner[inside]])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

        top = seqs.mapInArrow(counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(looked_at).collect()
        if not top:
            break
        ranked = {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.n for r in top}
        round_ = independent(list(ranked.items()))[: size - 256 - len(learned)]
        made = {p: 256 + len(learned) + i for i, p in enumerate(round_)}
        learned |= {p: ranked[p] for p in round_}

        def merged(batches: Iterator[pa.RecordBatch], made: dict[Pair, int] = made) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = pa.array([_merged(s, made) for s in b.column(0).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, b.column(1)], names=["ids", "freq"])

        before, seqs = seqs, materialize(seqs.mapInArrow(merged, "ids array<int>, freq bigint"), "pieces")
        discard(before)
    discard(seqs)
    return learned


def _runs(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts of at most about ``size`` bytes: their bytes, one after another, and where each text begins and the last ends. Null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets, held = texts.buffers()[1:]
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def _neighbours(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each two neighbours of a run their number, 256 times the first byte plus the second, and whether they are of one text."""
    inside = np.ones(max(0, len(data) - 1), bool)
    inside[ends[(ends > 0) & (ends < len(data))] - 1] = False
    return data[:-1].astype(np.uint16) << 8 | data[1:], inside


def _segments(data: np.ndarray, ends: np.ndarray, joined: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The texts of a run cut between all neighbours but those that ``joined`` has by number; where each segment begins and the last ends."""
    begins = np.ones(len(data) + 1, bool)
    pairs, inside = _neighbours(data, ends)
    begins[1:-1] = ~(joined[pairs] & inside)
    starts = np.flatnonzero(begins).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))]), starts


def neighbour_counts(texts: DataFrame) -> np.ndarray:
    """How often each two bytes are neighbours, at 256 times the first plus the second; overlapping ones included, as in ``pair_stats``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(65_536, np.int64)
        for b in batches:
            for run in _runs(b.column(0)):
                pairs, inside = _neighbours(*run)
                sums += np.bincount(pairs[inside], minlength=65_536)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(sums[there])], names=["pair", "n"])

    counts = np.zeros(65_536, np.int64)
    for r in texts.mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    return counts


def segment_counts(texts: DataFrame, joined: np.ndarray, most: int = 200_000) -> DataFrame:
    """``piece, freq``: the texts cut between all neighbours but those that ``joined`` has, counted; segments of one byte, which have no pairs, are left out.

    A task adds up its segments, and sends on what it has when these are more than ``most`` different ones.
    """

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("piece", use_threads=False).aggregate([("freq", "sum")]).select(["piece", "freq_sum"]).rename_columns(["piece", "freq"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            for run in _runs(b.column(0)):
                found = pc.value_counts(_segments(*run, joined)[0])
                one = pa.table({"piece": found.field(0), "freq": found.field(1)})
                held.append(one.filter(pc.greater(pc.binary_length(one["piece"]), 1)))
                if sum(map(len, held)) > most:
                    held = [summed(held)]
                    if len(held[0]) > most // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    return texts.mapInArrow(count, "piece binary, freq bigint").groupBy("piece").agg(F.sum("freq").alias("freq"))


def learn_merges_of_wholes(texts: DataFrame, size: int, most_pieces: int = 2_000_000, most_bytes: int = 8 << 20) -> dict[Pair, int]:
    """The same merges as ``learn_merges`` of whole texts (the only column), which are read but neither kept nor sent.

    Texts are cut between bytes that are neighbours fewer than ``least`` times, and the segments counted.
    All places of two bytes are cut or none, so a pair of ids is across cuts everywhere or nowhere: its
    count is that of the whole texts, or it is below ``least``. So the merges are those of the whole texts
    if none of them is rarer than ``least``; else that is lowered and the texts are cut again, in the end
    nowhere. Segments of more than ``most_pieces`` kinds or ``most_bytes`` bytes stay on the cluster.
    """
    counts = neighbour_counts(texts)
    wanted = size - 256
    if not wanted or not counts.any():
        return {}
    least = max(1, int(counts.sum()) // (10 * wanted))  # a first guess; in running text the last merge is a little less rare
    while True:
        pieces = materialize(segment_counts(texts, counts >= least), "segments")
        kinds, held = pieces.agg(F.count("*"), F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()
        if kinds > most_pieces or held > most_bytes:
            learned = learn_counts_on_cluster(pieces, size)
        else:
            found = pieces.toArrow()
            learned = learn_counts(found["piece"], found["freq"].to_numpy(), size)
        discard(pieces)
        rarest = min(learned.values()) if len(learned) == wanted else 0
        if rarest >= least or least <= counts[counts > 0].min():
            return _numbered(learned)
        least = max(1, min(rarest, least * 3 // 4) if rarest else least // 4)


@dataclass
class BpeModel:
    """Merges, split pattern and special tokens; everything else follows from them."""

    merges: dict[Pair, int] = field(default_factory=dict)
    pattern: str | None = None
    specials: dict[str, int] = field(default_factory=dict)

    @classmethod
    def train(cls, df: DataFrame, text: str, size: int, pattern: str | None = tx.GPT4_SPLIT, most_pieces: int = 2_000_000) -> BpeModel:
        """A model of ``size`` ids, from the different pieces and their counts.

        Up to ``most_pieces`` different pieces the merge loop runs on the driver; beyond, on the cluster
        (``learn_merges_on_cluster``), with the same result. Without a pattern see ``learn_merges_of_wholes``.
        """
        if size < 256:
            raise ValueError("size must be at least 256")
        checked = df.select(tx.checked_bytes(F.col(text)).alias("text"))
        if not pattern:
            return cls(learn_merges_of_wholes(checked, size, most_pieces), pattern)
        counted = materialize(piece_counts(checked, "text", pattern), "counts")
        if counted.count() > most_pieces:
            return cls(learn_merges_on_cluster(counted, size), pattern)
        return cls(learn_merges([(r.piece, r.freq) for r in counted.toLocalIterator()], size), pattern)

    def with_specials(self, specials: dict[str, int]) -> BpeModel:
        """The model with these special tokens added. A token that it has already gets the new id.

        Empty tokens, ids that are negative or no whole numbers, and ids that another token has, raise. A
        special id hides a merge of the same id.
        """
        for token, id in specials.items():
            if not isinstance(token, str) or not token:
                raise ValueError("a special token must be a text that is not empty")
            if isinstance(id, bool) or not isinstance(id, int) or id < 0:
                raise ValueError(f"the id of {token!r} must be a whole number that is not negative")
        taken = {i: t for t, i in self.specials.items()}
        for token, id in specials.items():
            if taken.setdefault(id, token) != token:
                raise ValueError(f"id {id} belongs to {taken[id]!r}")
        return BpeModel(self.merges, self.pattern, self.specials | specials)

    @cached_property
    def vocabulary(self) -> dict[int, bytes]:
        words = {i: bytes([i]) for i in range(256)}
        for (a, b), i in sorted(self.merges.items(), key=lambda m: m[1]):
            if a not in words or b not in words:
                raise ValueError(f"merge {i} needs an id that comes later")
            words[i] = words[a] + words[b]
        return words | {i: s.encode() for s, i in self.specials.items()}

    @cached_property
    def joined(self) -> np.ndarray:
        """By 256 times the first byte plus the second: whether a merge may join two neighbours of these bytes.

        All may be joined where two merges have one id: which comes first depends on the whole text then.
        """
        if len(set(self.merges.values())) < len(self.merges):
            return np.ones(65_536, bool)
        first, last = ({i: {i} for i in range(256)} for _ in range(2))
        grown = True
        while grown:  # once for merges in the order of their ids, and once to see that
            grown = False
            for (a, b), i in sorted(self.merges.items(), key=lambda m: m[1]):
                for ends, new in ((first, first.get(a, set())), (last, last.get(b, set()))):
                    if not new <= ends.get(i, set()):
                        ends[i], grown = ends.get(i, set()) | new, True
        made = np.zeros(65_536, bool)
        for a, b in self.merges:
            made[[256 * x + y for x in last.get(a, ()) for y in first.get(b, ())]] = True
        return made

    def whole_encoder(self) -> Callable[[pa.Array], pa.ListArray]:
        """A function that encodes whole texts without special tokens; null gives null.

        A text is cut where no merge can join its bytes, which changes no id, and each different segment encoded once.
        """
        store: dict[bytes, list[int]] = {}

        def known(piece: bytes) -> list[int]:
            if (ids := store.get(piece)) is None:
                if len(store) > 200_000:
                    store.clear()
                ids = store[piece] = self.encode_piece(piece)
            return ids

        def run(texts: pa.Array) -> pa.ListArray:
            if (pc.max(pc.binary_length(texts)).as_py() or 0) > tx.MAX_TEXT_BYTES:
                raise ValueError("text exceeds the limit of bytes")
            values, ends, total = [], [np.zeros(1, np.int64)], 0
            for data, bounds in _runs(texts):
                segments, starts = _segments(data, bounds, self.joined)
                coded = segments.dictionary_encode()
                ids = pa.array([known(p) for p in coded.dictionary.to_pylist()], pa.list_(pa.int32())).take(coded.indices)
                values.append(ids.values)
                ends.append(total + ids.offsets.to_numpy()[np.searchsorted(starts, bounds)][1:])
                total += len(ids.values)
            flat = pa.concat_arrays(values) if values else pa.array([], pa.int32())
            return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), flat, mask=texts.is_null())

        return run

    def encode_piece(self, piece: str | bytes) -> list[int]:
        """Ids of one piece: the merge of lowest id first, until none fits."""
        s = list(piece.encode() if isinstance(piece, str) else piece)
        while len(s) > 1:
            first = min(zip(s, s[1:], strict=False), key=lambda p: self.merges.get(p, 2**62))
            if first not in self.merges:
                break
            s = _merged(s, {first: self.merges[first]})
        return s

    def encoder(self, allowed: str | set[str] = "none_raise") -> Callable[[str], list[int]]:
        """A function that encodes texts. ``allowed``: which special tokens become their ids.

        'none_raise' raises at a special token in a text, 'none' takes it as ordinary text, 'all'
        allows each, a set allows its members and raises at others.
        """
        import regex

        if not (allowed in ("none_raise", "none", "all") if isinstance(allowed, str) else isinstance(allowed, set)):
            raise ValueError(f"bad value {allowed!r}")
        use = set(self.specials) if allowed == "all" else set(self.specials) & allowed if isinstance(allowed, set) else set()
        banned = set() if allowed in ("none", "all") else set(self.specials) - use
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(use, key=len, reverse=True))) + ")") if use else None
        find = regex.compile(self.pattern.replace("(?U)", "")).findall if self.pattern else None
        whole = self.whole_encoder()
        store: dict[str, list[int]] = {}

        def run(text: str) -> list[int]:
            if len(text.encode()) > tx.MAX_TEXT_BYTES:
                raise ValueError("text exceeds the limit of bytes")
            for s in banned:
                if s in text:
                    raise ValueError(f"special token {s!r} in the text is not allowed")
            ids: list[int] = []
            for part in cut.split(text) if cut else [text]:
                if part in use:
                    ids.append(self.specials[part])
                    continue
                if not find:
                    ids += whole(pa.array([part])).values.to_pylist()
                    continue
                for piece in find(part) if part else ():
                    if (known := store.get(piece)) is None:
                        if len(store) > 200_000:
                            store.clear()
                        known = store[piece] = self.encode_piece(piece)
                    ids += known
            return ids

        return run

    def encode(self, c: Column, allowed: str | set[str] = "none_raise") -> Column:
        """Ids ARRAY<INT> of texts; null gives null."""
        self.encoder(allowed)
        if not self.pattern and (not self.specials or allowed == "none"):

            @F.arrow_udf(T.ArrayType(T.IntegerType()))
            def wholes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                yield from map(self.whole_encoder(), batches)

            return wholes(c)

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def run(s: pd.Series) -> pd.Series:
            encode = self.encoder(allowed)
            return s.map(lambda t: None if t is None else encode(t))

        return run(c)

    def decode_ids(self, ids: list[int]) -> str:
        words = self.vocabulary
        if any(int(i) not in words for i in ids):
            raise ValueError("unknown or negative id")
        return b"".join(words[int(i)] for i in ids).decode("utf-8", "replace")

    def decode(self, c: Column) -> Column:
        """Texts of ids; bytes that are not UTF-8 become U+FFFD; null gives null; an unknown id raises."""

        @F.pandas_udf(T.StringType())
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda ids: None if ids is None else self.decode_ids(ids))

        return run(c)

    def dumps(self) -> str:
        """The model as text."""
        lines = [HEADER, f"{PATTERN} {json.dumps((self.pattern or '').replace('(?U)', ''))}", f"{SPECIALS} {len(self.specials)}"]
        lines += [f"{json.dumps(s)} {i}" for s, i in sorted(self.specials.items(), key=lambda x: x[1])]
        lines += [f"{MERGES} {len(self.merges)}", *[f"{a} {b} {i}" for (a, b), i in sorted(self.merges.items(), key=lambda x: x[1])]]
        return "\n".join(lines) + "\n"

    @classmethod
    def loads(cls, text: str) -> BpeModel:
        """The model of a text that dumps() wrote; anything else raises ValueError."""
        lines = iter(text.splitlines())

        def tail(head: str) -> str:
            line = next(lines, "")
            if not line.startswith(head + " "):
                raise ValueError(f"expected a line '{head} ...'")
            return line[len(head) + 1 :]

        if next(lines, "") != HEADER:
            raise ValueError("unknown header")
        try:
            pattern = json.loads(tail(PATTERN))
            specials = {json.loads(s): int(i) for s, i in (next(lines).rsplit(" ", 1) for _ in range(int(tail(SPECIALS))))}
            merges = {(a, b): i for a, b, i in (map(int, next(lines).split()) for _ in range(int(tail(MERGES))))}
        except (StopIteration, RuntimeError) as e:
            raise ValueError("the model ends early") from e
        model = cls(merges, f"(?U){pattern}" if pattern else None, specials)
        _ = model.vocabulary
        return model

    def save(self, prefix: str) -> None:
        """Write ``prefix``.model and a readable ``prefix``.vocab."""
        with open(f"{prefix}.model", "w", encoding="utf-8") as f:
            f.write(self.dumps())
        with open(f"{prefix}.vocab", "w", encoding="utf-8") as f:
            for i, b in sorted(self.vocabulary.items()):
                f.write(f"[{i}] {b!r} -> {rendered(b)}{' (special)' if i in self.specials.values() else ''}\n")

    @classmethod
    def load(cls, path: str) -> BpeModel:
        with open(path if path.endswith(".model") else f"{path}.model", encoding="utf-8") as f:
            return cls.loads(f.read())


def rendered(token: bytes) -> str:
    """A token's bytes as printable text."""
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    show = lambda c: named.get(c) or (c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}")
    return "".join(map(show, token.decode("utf-8", "replace")))
