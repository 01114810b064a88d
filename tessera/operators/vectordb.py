"""Exact similarity search and maintenance of vector collections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import vectors as vx
from tessera.shared import materialize

QUERY_BLOCK_BYTES = 32 << 20


def checked_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive whole number")
    return k


def topk(df: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", id: str = "id", vector: str = "vector", where: Column | Callable[[dict[str, Any]], bool] | None = None, include_vector: bool = False) -> DataFrame:
    """The ``k`` best rows for one query: all columns but the vector, with ``score`` and ``rank``.

    ``where`` filters before scoring, so k hits come back if so many rows match: a Column, or a Python
    function of a row's other columns as a dict, which leaves the JVM in Arrow batches. Equal scores are
    ordered by id. A query that could not be stored is refused; null vectors never match.
    """
    checked_k(k)
    q = np.asarray(query, np.float64)
    if q.ndim != 1 or not len(q) or not np.isfinite(q).all() or np.linalg.norm(q) < vx.MIN_NORM:
        raise ValueError("the query must be a finite vector that is not zero")
    rows = df if where is None else df.where(where if isinstance(where, Column) else _accepted(df.drop(vector).columns, where))
    rows = rows.where(F.col(vector).isNotNull()).withColumn("score", vx.score(metric, F.col(vector), F.array(*map(F.lit, q.tolist()))))
    order = [F.asc("score") if vx.metric_of(metric) == "euclidean" else F.desc("score"), F.asc(id)]
    best = rows.orderBy(*order).limit(k)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    return best if include_vector else best.drop(vector)


def _accepted(columns: list[str], accepts: Callable[[dict[str, Any]], bool]) -> Column:
    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(accepts(r)) for r in rows.to_dict("records")], dtype=bool)

    return run(F.struct(*[F.col(f"`{c}`") for c in columns]))


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of all queries against all rows; for the distance its negative square, so that larger is better."""
    if metric == "cosine":
        q, x = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    s = q @ x.T
    if metric == "euclidean":
        s = 2 * s - (q * q).sum(1)[:, None] - (x * x).sum(1)[None, :]
    return s


def topk_batch(df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", exclude_self: bool = False, include: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, rank, id, score`` and the ``include`` columns of the ``k`` best rows for every query, against all rows.

    The queries go out in blocks of at most QUERY_BLOCK_BYTES, each block a pass over the rows with one
    matrix product an Arrow batch; a batch gives at most k hits a query, so what is shuffled doesn't
    depend on the number of rows in it. With several blocks each one's hits are written before the next
    block is broadcast, so the driver holds one. The columns of ``include`` are joined to the hits alone.
    Equal scores are ordered by id.
    """
    checked_k(k)
    metric = vx.metric_of(metric)
    spark = df.sparkSession
    wanted = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    stats = wanted.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    q_type = to_arrow_type(wanted.schema["q"].dataType)
    kind, id_kind = wanted.schema["q"].dataType.simpleString(), df.schema[id].dataType.simpleString()
    schema = f"query_id {kind}, id {id_kind}, score double"
    if not stats.n:
        none = spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "id", "score")
        return none.join(df.select(F.col(id).alias("id"), *include), "id").select(*none.columns, *include) if include else none
    blocks = -(-stats.n * stats.dim * 8 // QUERY_BLOCK_BYTES)
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) = " + str(stats.dim))

    def one(block: int) -> DataFrame:
        part = wanted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toPandas()
        held = spark.sparkContext.broadcast((part["q"].tolist(), np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, stats.dim))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            for b in batches:
                if not len(b) or not len(names):
                    continue
                ids = b.column(0).to_pylist()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                s = _scores(metric, q, x)
                n = min(k + exclude_self, len(b))
                kth = np.partition(s, len(b) - n, axis=1)[:, len(b) - n]
                r, c = np.nonzero(s >= kth[:, None] - 1e-9)
                best = s[r, c] if metric != "euclidean" else np.sqrt(((q[r] - x[c]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in r], q_type), pa.array([ids[i] for i in c], b.schema.field(0).type), pa.array(np.clip(best, -1, 1) if metric == "cosine" else best)], names=["query_id", "id", "score"])

        found = rows.mapInArrow(run, schema)
        if blocks > 1:
            found = materialize(found, "hits")
            held.unpersist()
        return found

    hits = one(0)
    for block in range(1, blocks):
        hits = hits.union(one(block))
    if exclude_self:
        hits = hits.where("query_id <> id")
    order = F.asc("score") if metric == "euclidean" else F.desc("score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "id"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    if not include:
        return best
    return best.join(df.select(F.col(id).alias("id"), *include), "id").select(*best.columns, *include)


def upsert(df: DataFrame, changes: DataFrame, id: str = "id", seq: str = "seq", vector: str = "vector", dim: int | None = None) -> DataFrame:
    """``df`` with each changed row replaced or added; of changes of one id that of largest ``seq`` counts.

    Rows are replaced whole. A change with a blank or null id, or with a vector that can't be stored
    (``vectors.reject_reason``; of ``dim`` components, if given), refuses the whole batch: the result
    raises when read. Tables without the column ``vector`` have only their ids checked.
    """
    if vector in changes.columns and isinstance(changes.schema[vector].dataType, T.ArrayType):
        reason = vx.reject_reason(F.col(vector), dim)
        refused = F.raise_error(F.concat(F.lit("vector can't be stored: "), reason)).cast(changes.schema[vector].dataType)
        changes = changes.withColumn(vector, F.when(reason.isNotNull(), refused).otherwise(F.col(vector)))
    blank = F.raise_error(F.lit("id must not be blank")).cast(changes.schema[id].dataType)
    last = changes.groupBy(id).agg(F.max_by(F.struct(*[c for c in df.columns if c != id]), seq).alias("_row"))
    last = last.select(F.when(vx.valid_id(F.col(id).cast("string")), F.col(id)).otherwise(blank).alias(id), "_row.*").select(*df.columns)
    return df.join(changes.select(id).distinct(), id, "left_anti").select(*df.columns).unionByName(last)


def delete(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """``df`` without the rows of the given ids."""
    return df.join(ids.select(id).distinct(), id, "left_anti").select(*df.columns)


def deleted(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """``id, existed`` for each given id, once: whether ``delete`` finds a row of it."""
    have = df.select(id).distinct().withColumn("existed", F.lit(True))
    return ids.select(id).distinct().join(have, id, "left").select(id, F.coalesce("existed", F.lit(False)).alias("existed"))


def get(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """The rows of the given ids, each once."""
    return df.join(ids.select(id).distinct(), id, "left_semi").select(*df.columns)


def within_capacity(df: DataFrame, most: int) -> DataFrame:
    """``df`` itself; more than ``most`` rows raise."""
    if df.count() > most:
        raise ValueError(f"collection exceeds {most} vectors")
    return df
