"""Filling containers of one capacity with items of varying size (problem 8).

Only the histogram of sizes, of at most ``capacity`` entries whatever the data, reaches the driver.
There a configuration linear program over size classes is solved by multiplicative weights, whose
pricing step is a knapsack by dynamic programming; its solution is rounded to runs of equal
containers, and their room is filled with what is left. The plan is a table of intervals of ranks
within a size; every item looks its rank up in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.shared import materialize

BUCKETS, BUCKET_ROWS = 256, 100_000  # at least so many hash buckets, and of about so many items


def _knapsack(worth: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and counts of items of these weights, each as often as wanted, within ``capacity``."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        m = np.searchsorted(weights, c, "right")
        best[c], pick[c] = best[c - 1], -1
        if m:
            v = best[c - weights[:m]] + worth[:m]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], pick[c] = v[j], j
    counts, c = np.zeros(len(weights), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= weights[pick[c]]
    return float(best[capacity]), counts


def configuration_lp(demand: np.ndarray, weights: np.ndarray, capacity: int, eps: float = 0.3, gap: float = 0.02, most: int = 2500) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Patterns with fractional multiplicities that cover ``demand``, and a lower bound on their sum.

    Multiplicative weights for covering: the weight of a class falls as its demand is covered, each
    round adds the pattern of most weight. Stops when the sum is within ``gap`` of the dual bound.
    """
    y, cover, used = 1.0 / demand, np.zeros(len(demand)), {}
    bound = 0.0
    for i in range(most):
        value, a = _knapsack(y, weights, capacity)
        bound = max(bound, float((y * demand).sum()) / value)
        step = float((demand[a > 0] / a[a > 0]).min())
        key = a.tobytes()
        used[key] = used.get(key, 0.0) + step
        cover += step * a / demand
        y *= (1 - eps) ** (step * a / demand)
        y /= y.max()
        if i % 50 == 49 and cover.min() > 0 and sum(used.values()) / cover.min() <= (1 + gap) * bound:
            break
    scale = max(cover.min(), 1e-9) if cover.min() > 0 else 1.0
    return [(np.frombuffer(k, np.int64), v / scale) for k, v in used.items()], bound


@dataclass
class Plan:
    """Runs of equal containers, as intervals of ranks within each size."""

    capacity: int
    containers: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # size, first rank, base container, copies, first place

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return {"key": (rows[:, 0] << 44) + rows[:, 1], "first": rows[:, 1], "base": rows[:, 2], "copies": rows[:, 3], "place": rows[:, 4]}


def plan(histogram: dict[int, int], capacity: int, grain: int = 16, sand: int = 8) -> Plan:
    """Plan for ``histogram`` (size -> count, 1 <= size <= capacity).

    Sizes above ``sand`` grains form classes, rounded up to whole grains, over which the linear
    program runs; the room that rounding leaves is filled with the largest sizes that fit.
    """
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        left[s] = n
    taken = np.zeros(capacity + 1, np.int64)
    result = Plan(capacity)
    grain = max(1, min(grain, capacity // 64 or 1))
    klass = -(-np.arange(capacity + 1) // grain)

    def emit(contents: list[tuple[int, int]], times: int) -> None:
        """``times`` containers holding (size, copies) each."""
        base, place = result.containers, 0
        for s, copies in contents:
            result.rows.append((s, int(taken[s]), base, copies, place))
            taken[s] += copies * times
            left[s] -= copies * times
            place += copies
        result.containers += times

    def fill(contents: list[tuple[int, int]], times: int) -> None:
        """Emit ``times`` containers that begin with ``contents``, filled up with the largest sizes that fit."""
        while times > 0:
            now, run = dict(contents), times
            room = capacity - sum(s * c for s, c in contents)
            for s in np.flatnonzero(left[: room + 1] > 0)[::-1].tolist():
                spare = int(left[s]) - now.get(s, 0) * run
                if not s or s > room or spare <= 0:
                    continue
                run = min(run, spare)
                copies = min(room // s, spare // run)
                now[s] = now.get(s, 0) + copies
                room -= copies * s
            emit(sorted(now.items(), reverse=True), run)
            times -= run

    large = np.flatnonzero((left > 0) & (klass > sand))
    if len(large):
        weights = np.unique(klass[large])
        demand = np.array([left[(klass == w)].sum() for w in weights], float)
        patterns, _ = configuration_lp(demand, weights, capacity // grain)
        for a, times in sorted(patterns, key=lambda p: -p[1]):
            whole = int(times)
            while whole > 0:
                contents: dict[int, int] = {}
                for k in np.flatnonzero(a)[::-1]:
                    need = int(a[k])
                    for s in np.flatnonzero((klass == weights[k]) & (left > 0))[::-1]:
                        take = min(need, int(left[s]))
                        contents[int(s)] = take
                        need -= take
                        if not need:
                            break
                    if need:
                        contents = {}
                        break
                if not contents:
                    break
                run = min(whole, *(int(left[s]) // c for s, c in contents.items()))
                fill(sorted(contents.items(), reverse=True), run)
                whole -= run
    while (left > 0).any():  # what rounding left: the largest first
        s = int(np.flatnonzero(left > 0)[-1])
        copies = min(capacity // s, int(left[s]))
        fill([(s, copies)], int(left[s]) // copies)
    return result


def pack(items: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """``key, part, size, container, place`` for every item: the container it goes to and its place there.

    ``size`` is a whole number; null and negative sizes count as 0. An item larger than ``capacity``
    is split into full parts and a rest (part 0, 1, ...); no other item is split. Items of size 0 take
    no room: they all go to container 0, behind the items there. ``key`` must be unique; repeated or
    null keys are packed as rows of their own. An empty table gives an empty result. Ranks within a
    size are counted per hash bucket, so a size that a third of all items have is not sorted in one task.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    whole = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    parts = whole.select("key", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("total") - 1) / capacity)).cast("int"))).alias("part"))
    rows = parts.select("key", "part", F.least(F.lit(capacity), F.col("total") - F.col("part") * capacity).cast("int").alias("size"))
    rows = materialize(rows, "items")
    buckets = max(BUCKETS, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("b", "size").agg(F.count("*").alias("n"))
    before = counts.select("b", "size", (F.sum("n").over(W.partitionBy("size").orderBy("b")) - F.col("n")).alias("before"))
    histogram = {r["size"]: r.n for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    zeros = histogram.pop(0, 0)
    made = plan(histogram, capacity)
    zero_place = max([p + c for s, r, b, c, p in made.rows if b == 0], default=0)
    if zeros:
        made.rows.append((0, 0, 0, zeros, zero_place))
    table = rows.sparkSession.sparkContext.broadcast(made.arrays())
    ranked = rows.join(before, ["b", "size"]).select(
        "key", "part", "size", (F.col("before") + F.row_number().over(W.partitionBy("b", "size").orderBy("key", "part")) - 1).alias("rank")
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            s, r = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            at = np.searchsorted(t["key"], (s << 44) + r, "right") - 1
            k = r - t["first"][at]
            container = t["base"][at] + k // t["copies"][at]
            place = t["place"][at] + k % t["copies"][at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container), pa.array(place)], names=["key", "part", "size", "container", "place"])

    kind = rows.schema["key"].dataType.simpleString()
    return ranked.mapInArrow(look_up, f"key {kind}, part int, size int, container bigint, place bigint").withColumnRenamed("key", key)
