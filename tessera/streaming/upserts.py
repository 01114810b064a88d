"""Streams of changes applied to a vector collection: a delta a micro-batch, merged now and then."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import vectors as vx
from tessera.sources import files


def _parts(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete deltas ('d') or bases ('b') under ``path``."""
    found = [n for n in files.names(spark, path) if re.fullmatch(rf"{kind}\d{{12}}", n)]
    return [int(n[1:]) for n in found if files.exists(spark, f"{path}/{n}/_SUCCESS")]


def _merged(spark: SparkSession, path: str, id: str, seq: str, upto: int) -> DataFrame | None:
    """The row of largest ``seq`` of each id (of equal ones that of the later batch) in the newest base below ``upto`` and the deltas after it, up to ``upto``."""
    base = max((n for n in _parts(spark, path, "b") if n < upto), default=-1)
    names = ([f"b{base:012d}"] if base >= 0 else []) + [f"d{n:012d}" for n in _parts(spark, path, "d") if base < n <= upto]
    if not names:
        return None
    rows = spark.read.parquet(*[f"{path}/{n}" for n in names])
    last = rows.groupBy(id).agg(F.max_by(F.struct(*[c for c in rows.columns if c != id]), F.struct(seq, "_batch")).alias("_row"))
    return last.select(id, "_row.*").select(*rows.columns)


def latest(spark: SparkSession, path: str, id: str = "id", seq: str = "seq") -> DataFrame | None:
    """The collection under ``path`` as of the newest complete batch; None if there is none."""
    now = _merged(spark, path, id, seq, 2**62)
    return None if now is None else now.drop(seq, "_batch")


def apply_changes(changes: DataFrame, path: str, checkpoint: str, id: str = "id", seq: str = "seq", vector: str = "vector", dim: int | None = None, merge_every: int = 20) -> StreamingQuery:
    """Start a query that upserts each micro-batch of ``changes`` into the collection under ``path``.

    A batch writes only its own changes, with their ``seq``: a change with a smaller ``seq`` than the
    stored one never wins, however late it arrives. A batch that is replayed after a failure writes its
    own folder again and reads none of it, so every change counts once. Every ``merge_every`` batches the
    deltas are merged into a new base; the last two bases and the deltas after the older one are kept.
    Blank ids and vectors that can't be stored fail the batch before it is complete.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        refused = F.when(~vx.valid_id(F.col(id).cast("string")), F.lit("id must not be blank"))
        if vector in batch.columns:
            refused = F.coalesce(refused, F.concat(F.lit("vector can't be stored: "), vx.reject_reason(F.col(vector), dim)))
        checked = F.when(refused.isNotNull(), F.raise_error(refused).cast(batch.schema[id].dataType)).otherwise(F.col(id))
        rest = F.struct(*[c for c in batch.columns if c != id])
        delta = batch.withColumn(id, checked).groupBy(id).agg(F.max_by(rest, seq).alias("_row")).select(id, "_row.*").select(*batch.columns, F.lit(number).cast("long").alias("_batch"))
        delta.write.mode("overwrite").parquet(f"{path}/d{number:012d}")
        if number % merge_every != merge_every - 1:
            return
        _merged(spark, path, id, seq, number).write.mode("overwrite").parquet(f"{path}/b{number:012d}")
        bases = sorted(_parts(spark, path, "b"))
        if len(bases) < 2:
            return
        oldest = bases[-2]  # it and the deltas after it make the newest base again, should this batch be replayed
        for kind, gone in (("b", oldest - 1), ("d", oldest)):
            for n in _parts(spark, path, kind):
                if n <= gone:
                    files.delete(spark, f"{path}/{kind}{n:012d}")

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
