"""Most similar vectors (problem 5) and clusters of similar vectors by density peaks (problem 6).

Unit vectors are hashed by cross polytopes: a fast pseudo-rotation (three rounds of random signs and a
Hadamard transform) and the nearest signed axis name a cell. Every vector is stored in one cell of each
table and looks into the cells of its nearest axes (multiprobe). What meets in a cell is compared by one
matrix product and exactly ranked in double precision; of several meetings only the first counts.
Clusters are found in rounds of some tables or of a part of the cells of one, so that the disk holds
the vectors sent in one round, not in all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.graph import connected_components
from tessera.shared import broadcast_small, discard, materialize, materialize_each

HIT = 0.58  # measured share of pairs of cosine 0.8 that meet in one table of one rotation with two probes (64 dimensions)
CELL_ROWS, BUCKET_ROWS, CHUNK = 16_384, 200_000, 2_000_000
PACK_ROWS = 5_000  # vectors that are packed at once
EXACT_ROWS = 100_000  # products in double precision at once
ROUND_BYTES, ROUND_SHARE = 300_000_000, 3  # what a round sends at most: this, or so many times the bytes of all vectors


@dataclass(frozen=True)
class Tables:
    """``count`` hash tables of ``depth`` rotations each, ``probes`` axes looked at in each rotation."""

    count: int
    depth: int
    probes: int = 2
    seed: int = 11

    @property
    def looks(self) -> int:
        return self.probes**self.depth


def tables_for(rows: int, dim: int, miss: float = 0.001) -> Tables:
    """As many rotations as keep cells near CELL_ROWS rows, and tables that miss a pair of cosine 0.8 with probability ``miss``."""
    axes = 2 << (dim - 1).bit_length()
    depth = max(1, math.ceil(math.log(max(1, rows / CELL_ROWS)) / math.log(axes)))
    return Tables(math.ceil(math.log(miss) / math.log(1 - HIT**depth)), depth)


@dataclass(frozen=True)
class Rounds:
    """Rounds of ``tables`` tables each, or of one part in ``parts`` of the cells of a table, with ``buckets`` buckets each.

    With ``under`` above 1, the number of cells of a first axis, the cells of a first axis of a table are
    dealt to ``split`` buckets, so that a vector is sent for its first axes and not for each of its cells.
    """

    tables: int
    parts: int
    buckets: int
    under: int = 1
    split: int = 1

    def count(self, t: Tables) -> int:
        return -(-t.count // self.tables) * self.parts

    def tables_of(self, number: int, t: Tables) -> tuple[int, int]:
        """The first table of round ``number`` and the one after its last."""
        first = number // self.parts * self.tables
        return first, min(t.count, first + self.tables)

    def bucket(self, cell: np.ndarray, t: Tables) -> np.ndarray:
        """Numbers of the buckets of cells; those of round n are n * buckets and following."""
        x = cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        table = cell % t.count
        if self.under > 1:
            x = (cell // t.count // self.under * self.tables + table % self.tables).astype(np.uint64) * np.uint64(self.split) + x % np.uint64(self.split)
        inside = (x // np.uint64(self.parts) % np.uint64(self.buckets)).astype(np.int64)
        number = table // self.tables * self.parts + (x % np.uint64(self.parts)).astype(np.int64)
        return (number * self.buckets + inside).astype(np.int32)


def one_round(rows: int, t: Tables, cores: int) -> Rounds:
    """All at once, with about BUCKET_ROWS looks to each bucket."""
    return Rounds(t.count, 1, max(2 * cores, rows * t.count * t.looks // BUCKET_ROWS))


def rounds_for(rows: int, t: Tables, dim: int, cores: int) -> Rounds:
    """As few rounds as keep what one sends within ROUND_BYTES or ROUND_SHARE times the bytes of the vectors."""
    once = one_round(rows, t, cores)
    axes = 2 << (dim - 1).bit_length()
    each = dim * 4 + t.count * t.depth * t.probes * (1 if axes <= 256 else 4) + 24  # bytes of a vector sent, its id in 15
    most = max(ROUND_BYTES, ROUND_SHARE * rows * dim * 4)

    def apart(looks: int, places: int) -> float:
        return places * -math.expm1(looks * math.log1p(-1 / places)) if places > 1 else 1.0  # of looks that share a place one is sent

    if rows * each * apart(t.count * t.looks, once.buckets) <= most:
        return once
    under, split = axes ** (t.depth - 1), max(1, math.ceil(rows * t.probes / axes / BUCKET_ROWS))
    sends = rows * (t.looks if under == 1 else t.probes * apart(t.looks // t.probes, split))
    tables = min(t.count, int(most / (sends * each)))
    parts = 1 if tables else math.ceil(sends * each / most)
    tables = -(-t.count // -(-t.count // tables)) if tables else 1  # rounds of about equal size
    if under > 1:
        return Rounds(tables, parts, -(-axes * tables * split // parts), under, split)
    return Rounds(tables, parts, max(8 * cores, int(sends) * tables // parts // BUCKET_ROWS))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(math.sqrt(d))


def axes(unit: np.ndarray, t: Tables) -> np.ndarray:
    """The nearest signed axes of unit rows, nearest first: shape (rows, tables, depth, probes), of the smallest type that holds them."""
    n, dim = unit.shape
    d = 1 << (dim - 1).bit_length()
    x0 = np.zeros((n, d), np.float32)
    x0[:, :dim] = unit
    rng = np.random.default_rng(t.seed)
    out = np.zeros((n, t.count, t.depth, t.probes), np.uint8 if 2 * d <= 256 else np.int32)
    rows = np.arange(n)
    for i in range(t.count):
        for j in range(t.depth):
            turn = np.eye(d, dtype=np.float32)
            for _ in range(3):
                turn = _hadamard(turn * rng.choice(np.array([-1, 1], np.float32), d))
            x = x0 @ turn
            size = np.abs(x)
            for k in range(t.probes):
                best = size.argmax(axis=1)
                out[:, i, j, k] = best * 2 + (x[rows, best] < 0)
                size[rows, best] = -1
    return out


def cells(near: np.ndarray, t: Tables, dim: int, first: int = 0) -> np.ndarray:
    """Numbers of the cells that rows of ``axes``, of the tables from number ``first`` on, look into.

    Their shape is (rows, tables, looks); in the first of a table the row is stored.
    """
    d = 1 << (dim - 1).bit_length()
    out = np.zeros((len(near), near.shape[1], 1), np.int64)
    for j in range(t.depth):
        out = (out[:, :, :, None] * (2 * d) + near[:, :, j, None, :]).reshape(len(near), near.shape[1], -1)
    return out * t.count + np.arange(first, first + near.shape[1])[None, :, None]


def usable_vectors(df: DataFrame, id: str = "id", vector: str = "vector", seq: str = "seq", dim: int = 64) -> DataFrame:
    """``(id, vec)``: the usable vector of largest ``seq`` of each id, as the bytes of its float32 components.

    Usable are vectors of exactly ``dim`` finite components that are not all zero; null ids are dropped.
    """
    v = F.col(vector)
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id).alias("id"), F.col(seq).alias("seq"), v.cast("array<float>").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(b), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vec], names=["id", "seq", "vec"])

    return rows.mapInArrow(packed, "id string, seq bigint, vec binary").groupBy("id").agg(F.max_by("vec", "seq").alias("vec"))


def _packed(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    """The bytes of a binary column without nulls, all of one length, as rows of numbers."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(one):
        return np.zeros((0, 1), kind)
    ends = np.frombuffer(one.buffers()[1], np.int32)[one.offset : one.offset + len(one) + 1]
    return np.frombuffer(one.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(one), -1)


def _floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return _packed(column, np.float32)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _strings(packs: list[bytes], counts: list[int]) -> pa.Array:
    """One string array of packs that hold the ends of their strings and then the bytes of them."""
    ends, data, start = [np.zeros(1, np.int64)], [], 0
    for pack, n in zip(packs, counts, strict=True):
        ends.append(np.frombuffer(pack, np.int32, n).astype(np.int64) + start)
        data.append(pack[4 * n :])
        start += len(data[-1])
    return pa.LargeStringArray.from_buffers(sum(counts), pa.py_buffer(np.concatenate(ends).tobytes()), pa.py_buffer(b"".join(data))).cast(pa.string())


def _pack_strings(ids: pa.Array, order: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    taken = ids.take(pa.array(order))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    data = memoryview(taken.buffers()[2] or b"")
    return [(ends[a + 1 : b + 1] - ends[a]).astype(np.int32).tobytes() + bytes(data[ends[a] : ends[b]]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _hashed(vectors: DataFrame, t: Tables, weight: str, asks: str | None = None) -> DataFrame:
    """``(id, vec, weight, asks, axes)``, written: vectors with the nearest axes of all tables, in a byte each."""
    fields = "id string, vec binary, weight bigint, asks boolean"
    rows = vectors.select("id", "vec", F.col(weight).cast("long").alias("weight"), (F.col(asks) if asks else F.lit(True)).alias("asks"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = axes(_unit(_floats(b.column(1))).astype(np.float32), t)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(near[0].nbytes), len(b), [None, pa.py_buffer(near.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, raw], names=[*b.schema.names, "axes"])

    return materialize_each([rows.mapInArrow(hashed, f"{fields}, axes binary")], "hashed")


def _meetings(rows: DataFrame, t: Tables, rounds: Rounds) -> Iterator[DataFrame]:
    """For each round the packs ``(bucket, split, stored, looks, n, id, vec, axes, weight, asks)`` of ``_hashed`` rows for the cells they look into.

    Cells are dealt to buckets by a hash, and a vector is sent to a bucket once, for all its cells there:
    they follow from ``axes``, those of the tables up to the round's last. A pack holds those of one Arrow
    batch, each column as bytes one after another. Only rows with ``asks`` true look. A bucket of more
    than twice BUCKET_ROWS, as a hot cell makes it, is split on both sides: its packs are spread by a hash
    over p parts as stored and p as looking, and a task holds one part of either, so no task holds an
    unbounded cell; a pack goes to 2p - 1 tasks.
    """

    def sent(b: pa.RecordBatch, number: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors and axes of a batch, and its different (bucket, row) in a round or in all, by bucket."""
        vec = _packed(b.column(1), np.uint8)
        near = _near(b.column(4), t, vec.shape[1] // 4)
        first, end = (0, t.count) if number is None else rounds.tables_of(number, t)
        cell = cells(near[:, first:end], t, vec.shape[1] // 4, first)
        asking = b.column(3).to_numpy(zero_copy_only=False)
        use = np.zeros(cell.shape, bool)
        use[:, :, 0] = True  # where it is stored
        use[asking] = True
        row, bucket = np.nonzero(use.reshape(len(b), -1))[0], rounds.bucket(cell[use], t).astype(np.int64)
        if number is not None and rounds.parts > 1:
            mine = bucket // rounds.buckets == number
            row, bucket = row[mine], bucket[mine]
        both = np.unique(bucket * len(b) + row)
        return vec, near[:, :end].reshape(len(b), -1), both // len(b), both % len(b)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                bucket, n = np.unique(sent(b)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    def packed(number: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), PACK_ROWS):
                b = whole.slice(at, PACK_ROWS)
                vec, near, bucket, row = sent(b, number)
                if not len(row):
                    continue
                bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                weights, asking = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())  # noqa: B023, E731
                columns = [pa.array(_pack_strings(b.column(0), row, bounds), pa.binary()), cut(vec[row]), cut(near[row]), cut(weights[row]), cut(asking[row])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]].astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)), *columns], names=["bucket", "n", "id", "vec", "axes", "weight", "asks"])

    sizes = rows.mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * BUCKET_ROWS)
    hot = broadcast_small(sizes.select("bucket", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts")))
    none = hot.isEmpty()
    here = lambda i, j, stored, looks: F.struct((i * F.col("parts") + j).alias("split"), stored.alias("stored"), looks.alias("looks"))
    mine, other = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    as_stored = F.transform(other, lambda j: here(mine, j, F.lit(True), j == mine))
    as_looking = F.transform(F.filter(other, lambda i: i != mine), lambda i: here(i, mine, F.lit(False), F.lit(True)))
    for number in range(rounds.count(t)):
        packs = rows.mapInArrow(partial(packed, number), "bucket int, n int, id binary, vec binary, axes binary, weight binary, asks binary")
        if none:
            yield packs.withColumns({"split": F.lit(0), "stored": F.lit(True), "looks": F.lit(True)})
            continue
        joined = packs.join(hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        yield joined.withColumn("at", F.explode(F.concat(as_stored, as_looking))).select(*packs.columns, "at.*")


def _near(column: pa.ChunkedArray | pa.Array, t: Tables, dim: int) -> np.ndarray:
    d = 1 << (dim - 1).bit_length()
    return _packed(column, np.uint8 if 2 * d <= 256 else np.int32).reshape(len(column), t.count, t.depth, t.probes)


def _met(near_q: np.ndarray, near_x: np.ndarray, before: int) -> np.ndarray:
    """Whether rows q met x in a table before number ``before``: x's nearest axis is among q's in every rotation."""
    seen = np.zeros(len(near_q), bool)
    for i in range(before):
        seen |= (near_q[:, i] == near_x[:, i, :, :1]).any(axis=2).all(axis=1)
    return seen


class Bucket:
    """What one task holds of a bucket: unit rows, and for each of its cells who is stored and who looks."""

    def __init__(self, t: Tables, rounds: Rounds, table: pa.Table):
        self.t = t
        bucket = int(table.column("bucket")[0].as_py())
        first, end = rounds.tables_of(bucket // rounds.buckets, t)
        counts = table.column("n").to_pylist()
        joined = {c: b"".join(table.column(c).to_pylist()) for c in ("vec", "axes", "weight", "asks")}
        self.ids = _strings(table.column("id").to_pylist(), counts)
        self.unit = _unit(np.frombuffer(joined["vec"], np.float32).reshape(len(self.ids), -1))
        self.u32 = self.unit.astype(np.float32)
        dim = self.unit.shape[1]
        d = 1 << (dim - 1).bit_length()
        self.near = np.frombuffer(joined["axes"], np.uint8 if 2 * d <= 256 else np.int32).reshape(len(self.ids), end, t.depth, t.probes)
        self.weight = np.frombuffer(joined["weight"], np.int64)
        stored = np.repeat(table.column("stored").to_numpy(), counts)
        looks = np.repeat(table.column("looks").to_numpy(), counts) & np.frombuffer(joined["asks"], bool)
        cell = cells(self.near[:, first:], t, dim, first).reshape(len(self.ids), -1)
        row, look = np.nonzero(rounds.bucket(cell, t) == bucket)
        cell, home = cell[row, look], look % t.looks == 0
        order = np.argsort(cell, kind="stable")
        self.cell, self.row = cell[order], row[order]
        self.stored, self.looking = (home & stored[row])[order], looks[row][order]

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For chunks of those who look into a cell: its table, their numbers, the stored ones', and all products in single precision."""
        bounds = np.append(np.flatnonzero(np.append(True, self.cell[1:] != self.cell[:-1])), len(self.cell)) if len(self.cell) else [0]
        for a, b in zip(bounds, bounds[1:], strict=False):
            xs, looking = self.row[a:b][self.stored[a:b]], self.row[a:b][self.looking[a:b]]
            if not len(xs):
                continue
            step = max(1, CHUNK // len(xs))
            stored = np.ascontiguousarray(self.u32[xs].T)
            for start in range(0, len(looking), step):
                qs = looking[start : start + step]
                yield int(self.cell[a] % self.t.count), qs, xs, self.u32[qs] @ stored

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.clip((self.unit[q] * self.unit[x]).sum(axis=1), -1.0, 1.0)

    def first_time(self, q: np.ndarray, x: np.ndarray, table: int) -> np.ndarray:
        return ~_met(self.near[q], self.near[x], table)


def nearest(df_vectors: DataFrame, k: int = 10, least: float | None = None, tables: Tables | None = None, dim: int = 64, miss: float = 0.001) -> DataFrame:
    """``(id, rank, other, cosine)``: for every id of ``(id, vec)`` its ``k`` most similar others, as far as they meet.

    Equal cosines are ordered by the smaller other id. With ``least``, only others of at least this
    cosine count. A pair of cosine 0.8 meets with probability 1 - ``miss``, closer pairs with more. An empty
    table, or one vector alone, gives no rows.

    Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so only those are
    stored, and the smallest looks for all of them: its k + 1 nearest, itself included, hold the k
    nearest others of each.
    """
    vectors = materialize(df_vectors, "vectors")
    t = tables or tables_for(vectors.count(), dim, miss)
    most = k + 1
    margin = np.float32((dim + 4) * np.finfo(np.float32).eps)  # twice the error of a product in single precision

    def best(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        cell = Bucket(t, rounds, table)
        ids = cell.ids
        by_id = np.empty(len(ids), np.int64)
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for number, qs, xs, s in cell.blocks():
            if least is None:
                kth = np.partition(s, len(xs) - most, axis=1)[:, len(xs) - most, None] if len(xs) > most else np.float32(-3)
                flat = np.flatnonzero((s >= kth - margin).reshape(-1))
                r, c = np.divmod(flat, len(xs))
            else:
                flat = np.flatnonzero(s.reshape(-1) >= np.float32(least) - margin)
                r, c = np.divmod(flat, len(xs))
                many = np.bincount(r, minlength=len(qs)) > most
                if many.any():
                    thick = np.flatnonzero(many)
                    kth = np.full(len(qs), np.float32(-3))
                    kth[thick] = np.partition(s[thick], len(xs) - most, axis=1)[:, len(xs) - most]
                    ok = s.reshape(-1)[flat] >= kth[r] - margin
                    r, c = r[ok], c[ok]
            start = 0
            while start < len(r):  # whole rows of those who look, near EXACT_ROWS products at a time
                end = np.searchsorted(r, r[min(start + EXACT_ROWS, len(r)) - 1], "right")
                q, x = qs[r[start:end]], xs[c[start:end]]
                start = end
                cos = cell.exact(q, x)
                if least is not None:
                    ok = cos >= least
                    q, x, cos = q[ok], x[ok], cos[ok]
                order = np.lexsort((by_id[x], -cos, q))
                q, x, cos = q[order], x[order], cos[order]
                ok = np.arange(len(q)) - np.searchsorted(q, q, "left") < most
                q, x, cos = q[ok], x[ok], cos[ok]
                ok = cell.first_time(q, x, number)
                out.append((q[ok], x[ok], cos[ok]))
        q = np.concatenate([o[0] for o in out]) if out else np.zeros(0, int)
        x = np.concatenate([o[1] for o in out]) if out else np.zeros(0, int)
        cos = np.concatenate([o[2] for o in out]) if out else np.zeros(0)
        return pa.table({"first": ids.take(pa.array(q)), "other": ids.take(pa.array(x)), "cosine": pa.array(cos, pa.float64())})

    place = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= most).select("id", "vec", "place", (F.col("place") == 1).alias("asks"))
    rows = _hashed(few, t, "place", "asks")
    rounds = one_round(rows.count(), t, rows.sparkSession.sparkContext.defaultParallelism)
    met = next(_meetings(rows, t, rounds)).groupBy("bucket", "split").applyInArrow(best, "first string, other string, cosine double")
    rank = F.row_number().over(W.partitionBy("first").orderBy(F.desc("cosine"), "other"))
    top = met.withColumn("rank", rank).where(F.col("rank") <= most)
    lists = top.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "cosine"))).alias("near"))
    copied = vectors.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    owners = vectors.join(copied, "vec", "left").select("id", F.coalesce("first", "id").alias("first"))
    others = F.slice(F.filter("near", lambda o: o["other"] != F.col("id")), 1, k)
    return owners.join(lists, "first").select("id", F.posexplode(others).alias("p", "o")).select("id", (F.col("p") + 1).alias("rank"), "o.other", "o.cosine")


def nearest_pairs(df_vectors: DataFrame, k: int = 10, least: float = 0.8, dim: int = 64) -> DataFrame:
    """Pairs ``(id_a, id_b)``, id_a < id_b, of cosine at least ``least`` of which one is among the ``k`` nearest of the other."""
    near = nearest(df_vectors, k, least, dim=dim)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def neighbourhoods(rows: DataFrame, t: Tables, least: float, most: int = 32, dim: int = 64) -> DataFrame:
    """Rows ``(id, n, other, cosine, link)`` about the neighbours of cosine at least ``least``, written, from one pass over the meetings.

    ``rows`` are those of ``_hashed``, different vectors only. A row with ``n`` says that in one bucket
    the neighbours that ``id`` meets for the first time have that weight; one with ``other`` and
    ``cosine`` is one of the two nearest that are no less dense there, of the ``most`` nearest of a cell;
    one with ``other`` and ``link`` says that a chain of neighbours joins both. So a bucket gives at most
    four rows for each vector, not its pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        cell = Bucket(t, rounds, table)
        ids, weight = cell.ids, cell.weight
        total = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for number, qs, xs, s in cell.blocks():
            flat = np.flatnonzero(s.reshape(-1) >= np.float32(least - 1e-5))
            v = s.reshape(-1)[flat]
            r, c = np.divmod(flat, len(xs))
            q, x = qs[r], xs[c]
            ok = q != x
            doubt = np.flatnonzero(ok & (v < np.float32(least + 1e-5)))  # only at the threshold is double precision needed
            ok[doubt] = cell.exact(q[doubt], x[doubt]) >= least
            q, x, v = q[ok], x[ok], v[ok]
            ok = cell.first_time(q, x, number)
            q, x, v = q[ok], x[ok], v[ok]
            if not len(q):
                continue
            edges.append((q, x))
            held += len(q)
            if held > 4_000_000:
                _settle(label, edges)
                edges.clear()
                held = 0
            np.add.at(total, q, weight[x])
            order = np.lexsort((-v, q))
            q, x, v = q[order], x[order], v[order]
            ok = np.arange(len(q)) - np.searchsorted(q, q, "left") < most
            near.append((q[ok], x[ok], v[ok]))
        _settle(label, edges)
        a, b, w = (np.concatenate([n[i] for n in near]) if near else np.zeros(0, kind) for i, kind in ((0, int), (1, int), (2, np.float32)))
        heavy = total + weight  # of those that are denser here, the two nearest are named
        ok = heavy[b] >= heavy[a]
        a, b, w = a[ok], b[ok], w[ok]
        order = np.lexsort((-w, a))
        a, b, w = a[order], b[order], w[order]
        ok = np.arange(len(a)) - np.searchsorted(a, a, "left") < 2
        a, b, w = a[ok], b[ok], w[ok]
        at = np.flatnonzero(total)
        star = np.flatnonzero(label != np.arange(len(ids)))
        left, right = np.concatenate([at, a, star]), np.concatenate([at, b, label[star]])
        place = np.arange(len(left))
        return pa.table(
            {
                "id": ids.take(pa.array(left)),
                "n": pa.array(total[left], mask=place >= len(at)),
                "other": pa.array(ids.take(pa.array(right)).to_pylist(), pa.string(), mask=place < len(at)),
                "cosine": pa.array(np.concatenate([np.zeros(len(at), np.float32), w, np.zeros(len(star), np.float32)]).astype(np.float64), mask=(place < len(at)) | (place >= len(at) + len(a))),
                "link": pa.array(place >= len(at) + len(a)),
            }
        )

    rounds = rounds_for(rows.count(), t, dim, rows.sparkSession.sparkContext.defaultParallelism)
    fields = "id string, n bigint, other string, cosine double, link boolean"
    return materialize_each((packs.groupBy("bucket", "split").applyInArrow(run, fields) for packs in _meetings(rows, t, rounds)), "neighbours")


def density_peaks(df_vectors: DataFrame, least: float = 0.8, dim: int = 64, tables: Tables | None = None, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """Density peaks over the neighbours of cosine at least ``least``.

    Returns ``(id, density, parent, peak)`` of every vector that has a neighbour, and ``(a, b)``: pairs
    of ids that belong together because a chain of neighbours inside one cell joins them. The density is
    the number of neighbours, copies included; the parent is the most similar of the neighbours that
    ``neighbourhoods`` names and that is denser over all (equal densities: the smaller id is denser); one
    without such a neighbour is a peak; following parents ends at it. Of equal vectors the smallest id
    is compared, the others have it as parent.
    """
    vectors = materialize_each([df_vectors], "vectors")
    t = tables or tables_for(vectors.count(), dim, 0.0002)
    rows = _hashed(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")), t, "weight")
    copied = rows.where("weight > 1").select("vec", F.col("id").alias("first"))
    copies = materialize_each([vectors.join(copied, "vec").where("id <> first").select("id", "first")], "copies")
    discard(vectors)
    found = neighbourhoods(rows, t, least, most, dim)
    others = found.where("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("others"))
    dense = rows.select("id", "weight").join(others, "id", "left").select("id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("density"), "weight")
    dense = materialize_each([dense.where("density > 0")], "density")
    discard(rows)
    near = found.where("cosine IS NOT NULL").select("id", "other", "cosine")
    near = near.join(dense.select("id", "density"), "id").join(dense.select(F.col("id").alias("other"), F.col("density").alias("above")), "other")
    near = near.where((F.col("above") > F.col("density")) | (F.col("above") == F.col("density")) & (F.col("other") < F.col("id")))
    parent = near.groupBy("id").agg(F.max_by("other", F.struct("cosine", "above", "other")).alias("parent"))
    start = materialize_each([dense.join(parent, "id", "left").select("id", "density", "parent", "weight")], "parents")
    peaks = materialize(start.select("id", F.coalesce("parent", "id").alias("peak")), "peaks")
    while True:
        above = peaks.select(F.col("id").alias("peak"), F.col("peak").alias("higher"))
        after = materialize(peaks.join(above, "peak").select("id", F.col("higher").alias("peak"), (F.col("higher") != F.col("peak")).alias("moved")), "peaks")
        discard(peaks)
        peaks = after
        if after.where("moved").isEmpty():
            break
    firsts = start.join(peaks.select("id", "peak"), "id")
    copies = copies.join(firsts.select(F.col("id").alias("first"), "density", "peak"), "first").select("id", "density", F.col("first").alias("parent"), "peak")
    links = found.where("link").select(F.col("id").alias("a"), F.col("other").alias("b"))
    return firsts.select("id", "density", "parent", "peak").union(copies), links


def _settle(label: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Give joined numbers one label, by hooking larger roots to smaller ones until nothing moves."""
    if not edges:
        return
    a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    while True:
        while (label[label] != label).any():
            label[:] = label[label]
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))


def similarity_clusters(df_vectors: DataFrame, least: float = 0.8, dim: int = 64) -> DataFrame:
    """``(id, cluster_id, density, peak)`` of every vector with company.

    The density-peak groups whose members are neighbours of each other are joined, so that vectors
    within ``least`` are together, directly or through others; cluster_id is the smallest id.
    """
    labels, links = density_peaks(df_vectors, least, dim)
    labels = materialize_each([labels], "labels")
    peak_of = labels.select("id", "peak")
    between = (
        links.join(peak_of.select(F.col("id").alias("a"), F.col("peak").alias("pa")), "a")
        .join(peak_of.select(F.col("id").alias("b"), F.col("peak").alias("pb")), "b")
        .where("pa <> pb")
        .select(F.least("pa", "pb").alias("src"), F.greatest("pa", "pb").alias("dst"))
        .distinct()
    )
    merged = connected_components(between).select(F.col("id").alias("peak"), "component")
    grouped = labels.join(merged, "peak", "left").withColumn("component", F.coalesce("component", "peak"))
    names = grouped.groupBy("component").agg(F.min("id").alias("cluster_id"))
    return grouped.join(names, "component").select("id", "cluster_id", "density", "peak")


def describe_clusters(clusters: DataFrame, rows: DataFrame, typical: int = 3, id: str = "id", about: str = "metadata", seq: str = "seq") -> DataFrame:
    """``cluster_id, size, rank, id, density, metadata``: size and the ``typical`` densest members of each cluster.

    Equal densities are ordered by id; the metadata are those of the row of largest ``seq`` of the id.
    """
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("density"), "id"))
    top = clusters.withColumn("rank", rank).where(F.col("rank") <= typical)
    last = rows.select(F.col(id).alias("id"), F.col(seq).alias("seq"), F.col(about).alias("about")).groupBy("id").agg(F.max_by("about", "seq").alias(about))
    return top.join(sizes, "cluster_id").join(last, "id", "left").select("cluster_id", "size", "rank", "id", "density", about)
