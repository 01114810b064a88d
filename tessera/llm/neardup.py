"""Near-duplicate records by pigeonhole blocks over fingerprints (problem 2).

A text's fingerprint is a row of min-hash symbols of its word runs: two texts of similarity s differ
in a share 1 - s of the symbols. The symbols are split into blocks; a pair whose symbols differ in
fewer places than there are blocks has a block in common by the pigeonhole principle, and a pair at
larger distance shares one with probability 1 - (1 - s^r)^blocks. Pairs that share a block are
verified by the Hamming distance of one-bit symbols (XOR and bit count, inside generated code), and
what is left by the exact similarity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textform import key128, with_form
from tessera.operators.graph import connected_components
from tessera.operators.pairing import hot_keys, pairs_of_equal_keys
from tessera.shared import materialize

BITS = 192
BLOCKS, ROWS = 32, 3
_WORD = re.compile(r"[^\W_]+")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit keys of the runs of ``k`` consecutive word hashes of each text, and how many each text has.

    ``words`` are the hashes of all texts one after another, ``counts`` of them for each. A text of fewer
    than ``k`` words is one run of its words; without any it is the run of none.
    """
    ends = np.cumsum(counts)
    made, owners = [], []
    with np.errstate(over="ignore"):
        for n in range(min(k, int(counts.min(initial=k))), k + 1):  # lengths of runs: k, and those of shorter texts
            which = np.flatnonzero(counts == n) if n < k else np.flatnonzero(counts >= k)
            each = np.maximum(counts[which] - n + 1, 1)
            owner = np.repeat(which, each)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(ends[which] - counts[which], each)
            h = np.full(len(owner), max(n, 1), np.uint64)
            for i in range(n):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[start + i])
            made.append(h)
            owners.append(owner)
    h, owner = np.concatenate(made), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(owner[new], minlength=len(counts))


def fingerprint_column(df: DataFrame, words: str, k: int, blocks: int, rows: int, seed: int) -> DataFrame:
    """Adds runs ARRAY<BIGINT>, blocks ARRAY<BIGINT> and bits f0, f1, ... of the text in the column ``words``."""
    at = df.schema.names.index(words)
    kept = [f for f in df.schema.fields if f.name != words]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*kept, T.StructField("runs", longs), T.StructField("blocks", longs), *[T.StructField(f"f{i}", T.LongType()) for i in range(BITS // 64)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, BITS, dtype=np.uint64)

        class Hashes(dict):
            def __missing__(self, w: str) -> int:
                self[w] = h = xxhash.xxh64_intdigest(w)
                return h

        known = Hashes()
        for whole in batches:
            for start in range(0, len(whole), 300):
                batch = whole.slice(start, 300)
                if len(known) > 1_000_000:  # a store of hashes only; emptying it changes no value
                    known.clear()
                ids = [list(map(known.__getitem__, _WORD.findall(text or ""))) for text in batch.column(at).to_pylist()]
                counts = np.array([len(x) for x in ids], np.int64)
                flat, sizes = runs(np.array([h for x in ids for h in x], np.uint64), counts, k)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                low = np.empty((len(ids), BITS), np.uint64)
                moved = np.empty_like(flat)
                with np.errstate(over="ignore"):
                    for j in range(BITS):
                        np.multiply(flat, a[j], out=moved)
                        np.add(moved, b[j], out=moved)
                        low[:, j] = np.minimum.reduceat(moved, offsets[:-1])
                    low >>= np.uint64(16)
                    part = low[:, : blocks * rows].reshape(len(ids), blocks, rows)
                    keys = np.tile(np.arange(1, blocks + 1, dtype=np.uint64), (len(ids), 1))
                    for j in range(rows):
                        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + part[:, :, j])
                bits = np.packbits((low & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))))
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * blocks, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))))
                columns += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(bits.shape[1])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def most_distant(similarity: float, sigmas: float = 5.0) -> int:
    """Hamming distance that pairs of at least this similarity stay within, but for ``sigmas`` deviations."""
    p = (1 - similarity) / 2
    return math.ceil(BITS * p + sigmas * math.sqrt(BITS * p * (1 - p)))


def text_classes(df: DataFrame, order: str, text: str) -> DataFrame:
    """``(ord, k, words)``: each visible text with its word sequence in lower case and the key of its class.

    Records of one class have the same words in the same order, or, without any word, read the same.
    """
    rows = with_form(df.select(F.col(order).alias("ord"), F.col(text).alias("text")).where("ord IS NOT NULL AND text IS NOT NULL"))
    words = F.trim(F.regexp_replace(F.lower("form"), r"[^\p{L}\p{N}]+", " "))
    rows = rows.where("form <> ''").select("ord", "form", words.alias("words"))
    return rows.select("ord", key128(F.when(F.col("words") == "", F.concat(F.lit("\u0000"), F.col("form"))).otherwise(F.col("words"))).alias("k"), "words").dropDuplicates(["ord"])


def similar_classes(members: DataFrame, threshold: float, k: int, blocks: int, rows: int, seed: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of classes whose similarity is at least ``threshold``; a class is named by its least ord."""
    if blocks * rows > BITS:
        raise ValueError(f"blocks * rows must be at most {BITS}")
    reps = members.where("words <> ''").groupBy("k").agg(F.min_by("words", "ord").alias("words"), F.min("ord").alias("rep")).select("rep", "words")
    prints = materialize(fingerprint_column(reps, "words", k, blocks, rows, seed), "prints")
    shared = pairs_of_equal_keys(prints.select("rep", F.explode("blocks").alias("key")), "key", "rep")
    pairs = shared.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    bits = [f"f{i}" for i in range(BITS // 64)]
    sides = [prints.select(F.col("rep").alias(s), *[F.col(f).alias(f"{s}_{f}") for f in bits]) for s in "ab"]
    apart = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in bits), F.lit(0))
    close = pairs.join(sides[0], "a").join(sides[1], "b").where(apart <= most_distant(threshold)).select("a", "b")
    sets = [prints.select(F.col("rep").alias(s), F.col("runs").alias(f"{s}_runs")) for s in "ab"]
    both = F.size(F.array_intersect("a_runs", "b_runs"))
    similarity = both / (F.size("a_runs") + F.size("b_runs") - both)
    return close.join(sets[0], "a").join(sets[1], "b").select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_pairs(
    df: DataFrame, order: str = "ord", text: str = "text", threshold: float = 0.8, k: int = 5, blocks: int = BLOCKS, rows: int = ROWS, seed: int = 7
) -> DataFrame:
    """All pairs ``(ord_a, ord_b)``, ord_a < ord_b, of records whose similarity is at least ``threshold``.

    The similarity is the Jaccard coefficient of the sets of runs of ``k`` words, the words taken from
    the text as it reads, in lower case; a text of fewer words is one run. Records with the same words
    are always a pair, as are texts without any word that read the same. Null and blank texts and a
    null ``order`` are in no pair; an ``order`` delivered again counts once. With 32 blocks of 3
    symbols a pair of similarity 0.6 is missed with probability 0.0004, one of 0.7 with 2e-6. Common
    blocks and classes of many copies are split over tasks.
    """
    members = materialize(text_classes(df, order, text), "classes")
    named = members.groupBy("k").agg(F.min("ord").alias("rep"))
    ids = materialize(members.select("ord", "k").join(named, "k").select("ord", "rep"), "members")
    found = similar_classes(members, threshold, k, blocks, rows, seed).select("a", "b")
    inside = pairs_of_equal_keys(ids, "rep", "ord").select("ord_a", "ord_b")
    hot = hot_keys(ids, "rep")
    if hot is None:
        part = ids.withColumn("part", F.lit(0))
    else:
        part = ids.join(hot, "rep", "left").withColumn("part", F.pmod(F.xxhash64("ord"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        for s in "ab":
            found = found.join(hot.select(F.col("rep").alias(s), "parts"), s, "left").withColumn(f"part_{s}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    at = {s: [s] if hot is None else [s, f"part_{s}"] for s in "ab"}
    x, y = (part.select(F.col("ord").alias(o), F.col("rep").alias(s), *([F.col("part").alias(f"part_{s}")] if hot is not None else [])) for s, o in (("a", "x"), ("b", "y")))
    across = found.join(x, at["a"]).join(y, at["b"]).select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"))
    return across.union(inside)


def near_duplicate_groups(
    df: DataFrame, order: str = "ord", text: str = "text", threshold: float = 0.8, k: int = 5, blocks: int = BLOCKS, rows: int = ROWS, seed: int = 7
) -> DataFrame:
    """One row per visible record: ``ord``, ``class_id`` (least ord of its class of equal words), ``links`` (similar
    other classes) and ``group_id`` (least ord reached over links). Copies are never paired with each other."""
    members = materialize(text_classes(df, order, text), "classes")
    named = members.groupBy("k").agg(F.min("ord").alias("class_id"))
    ids = members.select("ord", "k").join(named, "k").select("ord", "class_id")
    found = materialize(similar_classes(members, threshold, k, blocks, rows, seed), "links")
    links = found.select(F.col("a").alias("class_id")).union(found.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    groups = connected_components(found, "a", "b").select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    return (
        ids.join(links, "class_id", "left")
        .join(groups, "class_id", "left")
        .select("ord", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))
    )
