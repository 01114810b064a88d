"""Pairs of rows with an equal key, the rows of hot keys split on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import materialize

MOST_ROWS = 20_000  # rows of one key that a task may hold
BUCKETS = 1 << 20
BROADCAST_ROWS = 100_000  # hot keys up to this number are broadcast: a few MB


def hot_keys(rows: DataFrame, key: str, most: int = MOST_ROWS) -> DataFrame | None:
    """``(key, parts)``: the keys of more than ``most`` rows and into how many parts to split each; None if there are none.

    The first count is by buckets of the key's hash and is pre-aggregated to a row a bucket at most; only
    the keys of full buckets are counted one by one. A null key is no key.
    """
    keyed = rows.select(key, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")).where(F.col(key).isNotNull())
    full = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket")
    full = materialize(full.coalesce(1), "buckets")
    if full.isEmpty():
        return None
    sizes = keyed.join(full, "bucket", "left_semi").groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = materialize(sizes.select(key, F.ceil(F.col("n") / most).cast("int").alias("parts")), "hot")
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= BROADCAST_ROWS else hot


def pairs_of_equal_keys(rows: DataFrame, key: str, id: str, carried: tuple[str, ...] = (), most: int = MOST_ROWS) -> DataFrame:
    """Pairs ``<id>_a < <id>_b`` of rows with equal ``key``, with the ``carried`` columns of both as ``<c>_a``, ``<c>_b``.

    The rows of a hot key are spread by their id over p parts, and a task joins two parts: no task holds
    more than about 2 * ``most`` rows of one key, whatever share of the rows it has. A pair comes once
    for each key it shares; null keys and ids have none.
    """
    names = [id, *[c for c in carried if c != id]]
    each = rows.select(key, *names).where(F.col(key).isNotNull() & F.col(id).isNotNull())
    hot = hot_keys(each, key, most)
    at: list[str] = [key]
    if hot is not None:
        parts = F.coalesce("parts", F.lit(1))
        each = each.join(hot, key, "left").withColumn("_mine", F.pmod(F.xxhash64(id), parts).cast("int"))
        each = each.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        each = each.select(key, *names, "_mine", F.least("_mine", "_other").alias("_low"), F.greatest("_mine", "_other").alias("_high"))
        at += ["_low", "_high"]
    sides = [each.select(*[F.col(k).alias(f"{k}_{s}") for k in dict.fromkeys([*at, *names, *(["_mine"] if hot is not None else [])])]) for s in "ab"]
    on = F.col(f"{id}_a") < F.col(f"{id}_b")
    for k in at:
        on &= F.col(f"{k}_a") == F.col(f"{k}_b")
    if hot is not None:
        on &= (F.col("_low_a") == F.col("_high_a")) | (F.col("_mine_a") != F.col("_mine_b"))
    return sides[0].join(sides[1], on).select(*[f"{n}_{s}" for n in dict.fromkeys([*names, key]) for s in "ab"])
