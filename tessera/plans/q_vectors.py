"""Queries over embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import vectors as vx
from tessera.operators import vectordb as db
from tessera.shared import shared_dir, table
from tessera.sources import collections as col

QUERY = [round(0.1 * ((i * 7) % 11 - 5), 1) for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_V = "embedding::DOUBLE[]"
_SCORES = {"cosine": f"list_cosine_similarity({_V}, {_Q})", "euclidean": f"list_distance({_V}, {_Q})", "dot": f"list_dot_product({_V}, {_Q})"}


def _e(spark, d):
    return table(spark, d, "embeddings")


def _topk(spark, d, metric, where=None):
    return db.topk(_e(spark, d), QUERY, 10, metric, "vec_id", "embedding", where).select("rank", "vec_id", "label", F.round("score", 6).alias("score"))


def cosine_topk(spark, d):
    return _topk(spark, d, "cosine")


def l2_topk(spark, d):
    return _topk(spark, d, "l2")


def dot_topk(spark, d):
    return _topk(spark, d, "ip")


def filtered_topk(spark, d):
    return _topk(spark, d, "cosine", F.col("label") == 3)


def callable_filter_topk(spark, d):
    return db.topk(_e(spark, d), QUERY, 10, "cosine", "vec_id", "embedding", lambda row: row["label"] == 3).select("rank", "vec_id", "label", F.round("score", 6).alias("score"))


def multi_query_topk(spark, d):
    queries = _e(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return db.topk_batch(_e(spark, d), queries, 10, "cosine", "vec_id", "embedding", exclude_self=True, include=("label",)).select("query_id", "rank", F.col("id").alias("vec_id"), "label", F.round("score", 6).alias("score"))


def vec_metrics(spark, d):
    q = F.array(*map(F.lit, QUERY))
    v = F.col("embedding")
    return _e(spark, d).select("vec_id", F.round(vx.norm(v), 6).alias("norm"), F.round(vx.cosine(v, q), 6).alias("cosine"), F.round(vx.euclidean(v, q), 6).alias("distance"), F.round(vx.dot(v, q), 6).alias("product"))


def vec_unit(spark, d):
    return _e(spark, d).select("vec_id", F.posexplode(F.transform(vx.unit(F.col("embedding")), lambda x: F.round(x, 6))).alias("place", "x"))


def vec_validate(spark, d):
    return table(spark, d, "vector_store").select("seq", F.coalesce(vx.reject_reason(F.col("vector"), 64), F.lit("ok")).alias("reason"))


def vec_get(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("vec_id"))
    return db.get(_e(spark, d), ids, "vec_id").select("vec_id", "label")


def vec_delete(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("vec_id"))
    return db.delete(_e(spark, d), ids, "vec_id").select("vec_id", "label")


def vec_upsert_lww(spark, d):
    """The first half of the changes makes the collection, the second is upserted into it."""
    rows = table(spark, d, "vector_store").select("id", "seq", "metadata.category")
    half = rows.agg(F.expr("percentile_approx(seq, 0.5)").alias("h")).first().h or 0
    filled = db.upsert(rows.where("false"), rows.where(F.col("seq") <= half))
    return db.upsert(filled, rows.where(F.col("seq") > half))


def vec_upsert_checked(spark, d):
    """Upserts of vectors that can be stored into a filled collection."""
    rows = table(spark, d, "vector_store").where(vx.reject_reason(F.col("vector"), 64).isNull()).select("id", "vector", "seq", F.size("vector").alias("dim"))
    held = db.upsert(rows.where("false"), rows.where("seq % 2 = 0"), dim=64)
    newer = rows.where("seq % 2 = 1").join(held.select("id", F.col("seq").alias("have")), "id", "left").where("have IS NULL OR seq > have").drop("have")
    return db.upsert(held, newer, dim=64).select("id", "seq", "dim", F.round(vx.norm(F.col("vector")), 4).alias("norm"))


def vec_deleted(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("vec_id"))
    return db.deleted(_e(spark, d), ids, "vec_id")


def vec_ids(spark, d):
    return table(spark, d, "vector_store").select("seq", vx.valid_id(F.col("id")).alias("id_ok"), vx.valid_name(F.col("id")).alias("name_ok"))


def vec_count(spark, d):
    return _e(spark, d).groupBy("label").agg(F.count("*").alias("n"))


def collection_roundtrip(spark, d):
    base = f"{shared_dir(spark)}/tessera/collections-{uuid.uuid4().hex}"
    col.save_collection(_e(spark, d), base, "embeddings", 64, "cos", "vec_id", "embedding")
    rows, meta = col.load_collection(spark, base, "embeddings", 64, "vec_id", "embedding")
    return rows.select("vec_id", "label", F.round(vx.norm(F.col("embedding")), 6).alias("norm"), F.lit(meta["metric"]).alias("metric"))


def sql():
    def best(metric, where="true"):
        direction = "ASC" if metric == "euclidean" else "DESC"
        return f"SELECT row_number() OVER (ORDER BY s {direction}, vec_id)::INT AS rank, vec_id, label, round(s, 6) AS score FROM (SELECT *, {_SCORES[metric]} AS s FROM embeddings WHERE {where}) ORDER BY 1 LIMIT 10"

    n = f"sqrt(list_dot_product({_V}, {_V}))"
    return {
        "cosine_topk": best("cosine"),
        "l2_topk": best("euclidean"),
        "dot_topk": best("dot"),
        "filtered_topk": best("cosine", "label = 3"),
        "multi_query_topk": "SELECT * FROM (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 10",
        "vec_metrics": f"SELECT vec_id, round({n}, 6) AS norm, round({_SCORES['cosine']}, 6) AS cosine, round({_SCORES['euclidean']}, 6) AS distance, round({_SCORES['dot']}, 6) AS product FROM embeddings",
        "vec_unit": f"SELECT vec_id, (i - 1)::INT AS place, round(v[i] / n, 6) AS x FROM (SELECT vec_id, {_V} AS v, {n} AS n FROM embeddings), range(1, 65) t(i)",
        "vec_validate": "SELECT seq, CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) = 0 THEN 'empty' WHEN len(vector) <> 64 THEN 'wrong_dim' WHEN len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite' WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 'zero_norm' ELSE 'ok' END AS reason FROM vector_store",
        "vec_get": "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT l_linenumber FROM lineitem)",
        "vec_delete": "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT l_linenumber FROM lineitem)",
        "vec_upsert_lww": "SELECT id, seq, metadata.category AS category FROM vector_store QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1",
        "callable_filter_topk": best("cosine", "label = 3"),
        "vec_upsert_checked": "SELECT id, seq, len(vector)::INT AS dim, round(sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])), 4) AS norm FROM vector_store WHERE vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1",
        "vec_deleted": "SELECT DISTINCT c_custkey AS vec_id, c_custkey IN (SELECT vec_id FROM embeddings) AS existed FROM customer",
        "vec_ids": r"SELECT seq, coalesce(regexp_matches(id, '\S'), false) AS id_ok, coalesce(regexp_full_match(id, '[a-zA-Z0-9_-]+'), false) AS name_ok FROM vector_store",
        "vec_count": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
        "collection_roundtrip": f"SELECT vec_id, label, round({n}, 6) AS norm, 'cosine' AS metric FROM embeddings",
    }


NAMES = ["cosine_topk", "l2_topk", "dot_topk", "filtered_topk", "callable_filter_topk", "multi_query_topk", "vec_metrics", "vec_unit", "vec_validate", "vec_get", "vec_delete", "vec_upsert_lww", "vec_upsert_checked", "vec_deleted", "vec_ids", "vec_count", "collection_roundtrip"]
