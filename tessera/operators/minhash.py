"""Min-hash signatures, bands of locality-sensitive hashing and verified edges."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.operators.pairing import MOST_ROWS, pairs_of_equal_keys

PRIME = (1 << 61) - 1
_WORD = re.compile(r"\w+")
BUCKET_CAP = 5000  # fixed value: ids of a bucket that can be found, where a cap is wanted


@cache
def coefficients(num_perm: int = 128, seed: int = 42) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Factors and offsets of the universal hashes: all factors are drawn before the offsets."""
    if num_perm < 1:
        raise ValueError("num_perm must be at least 1")
    rng = np.random.default_rng(seed)
    a = rng.integers(1, PRIME, size=num_perm, dtype=np.uint64)
    b = rng.integers(0, PRIME, size=num_perm, dtype=np.uint64)
    return tuple(map(int, a)), tuple(map(int, b))


def affine61(a: int, b: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(a·x + b) mod 2^61-1 for x = high·2^31 + low, exactly, in 64-bit lanes.

    The product is split at 31 bits; since 2^61 ≡ 1, its parts fold back below 64 bits before adding.
    """
    a1, a0 = np.uint64(a >> 31), np.uint64(a & 0x7FFFFFFF)
    middle = a1 * low + a0 * high
    total = np.uint64(2) * (a1 * high) + (middle >> np.uint64(30)) + ((middle & np.uint64(0x3FFFFFFF)) << np.uint64(31))
    total = (total & np.uint64(PRIME)) + (total >> np.uint64(61)) + a0 * low
    total = (total & np.uint64(PRIME)) + (total >> np.uint64(61)) + np.uint64(b)
    total = (total & np.uint64(PRIME)) + (total >> np.uint64(61))
    return np.where(total >= np.uint64(PRIME), total - np.uint64(PRIME), total)


def shingle_hash(shingle: str, base: str = "blake2b") -> int:
    """Base hash of a shingle below 2^61-1: 64 bits of BLAKE2b, or the portable first 60 bits of MD5."""
    if base == "md5":
        return int(hashlib.md5(shingle.encode()).hexdigest()[:15], 16)
    return int.from_bytes(hashlib.blake2b(shingle.encode(), digest_size=8).digest(), "little") % PRIME


def signatures(hashes: np.ndarray, offsets: np.ndarray, num_perm: int, seed: int) -> np.ndarray:
    """Signature rows of the sets hashes[offsets[i]:offsets[i+1]]; an empty set has all bits set (-1)."""
    out = np.full((len(offsets) - 1, num_perm), -1, np.int64)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if not len(filled):
        return out
    high, low = hashes >> np.uint64(31), hashes & np.uint64(0x7FFFFFFF)
    a, b = coefficients(num_perm, seed)
    # Sets without members don't interrupt the flat array, so the filled ones lie side by side in it.
    starts = offsets[:-1][filled]
    for j in range(num_perm):
        out[filled, j] = np.minimum.reduceat(affine61(a[j], b[j], high, low), starts).astype(np.int64)
    return out


def text_shingles(text: str, k: int, mode: str) -> set[str]:
    """The different shingles of a normalised text, as ``functions.text.shingles`` makes them."""
    if mode == "char":
        return {text[i : i + k] for i in range(max(1, len(text) - k + 1))} if text else set()
    words = _WORD.findall(text)
    if len(words) < k:
        return {" ".join(words)} if words else set()
    return set(map(" ".join, zip(*[words[i:] for i in range(k)], strict=False)))


def _signed(df: DataFrame, column: str, members: Callable[[Any], Iterable[str]], out: str, num_perm: int, seed: int, base: str) -> DataFrame:
    coefficients(num_perm, seed)
    at = df.schema.names.index(column)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != column], T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Hashes(dict):
            def __missing__(self, s: str) -> int:
                self[s] = h = shingle_hash(s, base)
                return h

        known = Hashes()
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                sets = [list(map(known.__getitem__, members(row))) if row else [] for row in part.column(at).to_pylist()]
                if len(known) > 500_000:
                    known.clear()
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
                sig = signatures(np.array([h for x in sets for h in x], np.uint64), offsets, num_perm, seed)
                column_ = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * num_perm), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != at], column_], names=schema.names)

    return df.mapInArrow(run, schema)


def with_signature(df: DataFrame, shingles: str, out: str = "sig", num_perm: int = 128, seed: int = 42, base: str = "blake2b") -> DataFrame:
    """``df`` with the signature ARRAY<BIGINT> of the shingle array in place of it. Repeats don't matter; null and empty arrays give all -1.

    One pass in Arrow batches: each different shingle is hashed once a batch, and the permutations run
    over the shingles of many rows at once, in blocks that stay in the cache.
    """
    return _signed(df, shingles, set, out, num_perm, seed, base)


def with_text_signature(df: DataFrame, text: str, k: int = 5, mode: str = "word", out: str = "sig", num_perm: int = 128, seed: int = 42, base: str = "blake2b") -> DataFrame:
    """The same from a normalised text, which is cut into shingles in the same pass, so that they are never rows or columns."""
    if k < 1 or mode not in ("word", "char"):
        raise ValueError("k must be at least 1 and mode 'word' or 'char'")
    return _signed(df, text, lambda t: text_shingles(t, k, mode), out, num_perm, seed, base)


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures; signatures of different or no length raise."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t))
    wrong = F.raise_error(F.lit("signatures must have the same, non-zero length")).cast("double")
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(wrong)


@cache
def lsh_params(threshold: float, num_perm: int, weights: tuple[float, float] = (0.5, 0.5)) -> tuple[int, int]:
    """Bands and rows of the least weighted area of false positives below and false negatives above ``threshold``.

    Areas are trapezoids over 1,001 similarities from 0 to 1, each side for itself. Of losses within
    1e-9 the one that uses more permutations wins.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be inside (0, 1)")
    if num_perm < 1:
        raise ValueError("num_perm must be at least 1")
    if min(weights) < 0 or sum(weights) == 0:
        raise ValueError("weights must not be negative nor both zero")
    s = np.linspace(0, 1, 1001)
    below = int((s < threshold).sum())
    best, least = (1, num_perm), math.inf
    for b in range(1, num_perm + 1):
        r = np.arange(1, num_perm // b + 1)
        hit = 1 - (1 - s[None, :] ** r[:, None]) ** b
        area = lambda y, x: np.trapezoid(y, x, axis=1) if len(x) > 1 else np.zeros(len(r))
        losses = weights[0] * area(hit[:, :below], s[:below]) + weights[1] * area(1 - hit[:, below:], s[below:])
        for rows, loss in zip(r.tolist(), losses.tolist(), strict=True):
            if loss < least:
                best, least = (b, rows), loss
            elif abs(loss - least) < 1e-9 and b * rows > best[0] * best[1]:
                best = (b, rows)
    return best


def checked_params(threshold: float, num_perm: int, b: int | None, r: int | None) -> tuple[int, int]:
    """Given bands and rows if they fit, else the best ones."""
    if (b is None) != (r is None):
        raise ValueError("give both b and r or neither")
    if b is None:
        return lsh_params(threshold, num_perm)
    if not 0 < threshold < 1:
        raise ValueError("threshold must be inside (0, 1)")
    if b < 1 or r < 1 or b * r > num_perm:
        raise ValueError("b and r must be at least 1 and b * r at most num_perm")
    return b, r


def lsh_threshold(b: int, r: int) -> float:
    """Similarity at which the chance of a common band rises most steeply."""
    return (1 / b) ** (1 / r)


def lsh_bands(df: DataFrame, id: str, signature: str, b: int, r: int) -> DataFrame:
    """``id, band, key`` for each of the ``b`` bands of a signature; the key is a 64-bit hash of its ``r`` slots.

    Equal slots have equal keys; a chance collision only adds a candidate, which verification removes.
    """
    slices = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.xxhash64(F.slice(F.col(signature), i * r + 1, F.lit(r))))
    return df.select(F.col(id).alias("id"), F.posexplode(slices).alias("band", "key"))


def bucket_stats(bands: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """One row: number of buckets, of buckets beyond ``cap`` members, and the largest bucket's size."""
    sizes = bands.groupBy("band", "key").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("buckets"), F.count(F.when(F.col("n") > cap, 1)).alias("saturated"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def lsh_candidates(bands: DataFrame, cap: int | None = None) -> DataFrame:
    """Different pairs ``(id_a, id_b)``, id_a < id_b, with a bucket in common.

    Without ``cap`` every pair is found. Ids are ordered as the rows were inserted; with a ``cap``, only
    the first ``cap`` ids of a bucket can be found by others; later ones still look. Buckets of one id
    never reach the join with a cap, and hot buckets are split over tasks in either way.
    """
    if cap is None:
        keyed = bands.select(F.xxhash64("band", "key").alias("key"), "id")
        return pairs_of_equal_keys(keyed, "key", "id").select("id_a", "id_b").distinct()
    sizes = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = bands.join(sizes, ["band", "key"]).withColumn("parts", F.ceil(F.col("n") / MOST_ROWS).cast("int"))

    def first(ids: DataFrame, *within: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("band", "key", *within).orderBy("id"))
        return ids.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")

    large = rows.where(F.col("n") > cap).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    stored = rows.where(F.col("n") <= cap).unionByName(first(first(large, "salt").drop("salt")))
    stored = stored.select("band", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_a"))
    probe = rows.select("band", "key", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("id_b"))
    return stored.join(probe, ["band", "key", "part"]).where("id_a < id_b").select("id_a", "id_b").distinct()


def verified_edges(candidates: DataFrame, signed: DataFrame, id: str, signature: str, threshold: float) -> DataFrame:
    """``id_a, id_b, similarity`` of the candidates whose signatures agree in at least ``threshold`` of all slots."""
    a = signed.select(F.col(id).alias("id_a"), F.col(signature).alias("_a"))
    b = signed.select(F.col(id).alias("id_b"), F.col(signature).alias("_b"))
    return candidates.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", signature_similarity(F.col("_a"), F.col("_b")).alias("similarity")).where(F.col("similarity") >= threshold)
