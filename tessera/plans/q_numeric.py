"""Queries of numeric operators over lineitem, embeddings, documents and ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import numeric as nx
from tessera.functions import text as tx
from tessera.operators import models as md
from tessera.shared import table

X, W, B = ["l_quantity", "l_discount", "l_tax"], [0.5, -2.0, 1.5], 0.25
LAYERS = [([[0.1, -0.2, 0.3], [0.4, 0.5, -0.6]], [0.01, -0.02]), ([[0.7, -0.8]], [0.05])]
TINY = md.GptConfig(vocab=65, block=16, layers=2, heads=2, width=16)


def _lines(spark, d):
    return table(spark, d, "lineitem")


def _e(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _exploded(df, c):
    return df.select("vec_id", F.posexplode(F.transform(c, lambda x: F.round(x, 6))).alias("place", "x"))


def scalar_ops(spark, d):
    x, q = nx.Expr.variable("l_discount"), nx.Expr.variable("l_quantity")
    f = (x * 3 + q**2 - 1) / (q + 0.5)
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.round(f.column, 6).alias("f"), F.round(f.grad("l_discount"), 6).alias("dx"), F.round(f.grad("l_quantity"), 6).alias("dq"))


def relu_tanh(spark, d):
    x = nx.Expr.variable("l_discount") - 0.05
    r, t = x.relu(), x.tanh()
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.round(r.column, 6).alias("r"), r.grad("l_discount").alias("dr"), F.round(t.column, 6).alias("t"), F.round(t.grad("l_discount"), 6).alias("dt"), F.round((x * 2).exp().column, 6).alias("e"), F.round((x + 1).log().column, 6).alias("l"))


def linreg_grad(spark, d):
    out = md.linear_gradient(_lines(spark, d), X, "l_extendedprice", W, B)
    return out.select(*[F.round(c, 2).alias(c) for c in out.columns])


def mlp_forward(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.round(nx.mlp_forward(F.array(*[F.col(c) for c in X]), LAYERS), 6).alias("y"))


def mse(spark, d):
    y = nx.mlp_forward(F.array(*[F.col(c) for c in X]), LAYERS)
    return _lines(spark, d).groupBy("l_returnflag").agg(F.round(F.avg(F.pow(y - F.col("l_discount"), 2)), 6).alias("mse"))


def sgd_linear(spark, d):
    layers, loss = md.sgd_fit(_lines(spark, d).withColumn("l_q", F.col("l_quantity") / 50), ["l_q", "l_discount"], "l_tax", [(np.array([[0.0, 0.0]]), np.zeros(1))], 0.5, 10)
    (w, b), = layers
    return spark.createDataFrame([(round(float(w[0, 0]), 6), round(float(w[0, 1]), 6), round(float(b[0]), 6), round(float(loss), 6))], "w_q double, w_discount double, bias double, loss double")


def grad_clip(spark, d):
    g = _e(spark, d).select("vec_id", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    return g.select("vec_id", F.round("norm", 6).alias("norm"), F.round(nx.clip_factor(F.col("norm"), 0.5), 6).alias("factor"))


def softmax(spark, d):
    return _exploded(_e(spark, d), nx.softmax(F.col("v")))


def layernorm(spark, d):
    return _exploded(_e(spark, d), nx.layer_norm(F.col("v")))


def gelu(spark, d):
    return _exploded(_e(spark, d), F.transform("v", lambda x: nx.gelu(x)))


def cross_entropy(spark, d):
    t = F.when(F.col("vec_id") % 7 == 0, -1).otherwise((F.col("vec_id") % 64).cast("int"))
    loss = nx.cross_entropy(F.col("v"), t)
    return _e(spark, d).agg(F.round(F.avg(loss), 6).alias("loss"), F.count(loss).alias("n"))


def topk_mask(spark, d):
    kept = F.filter(nx.keep_top(F.col("v"), 5), lambda x: x > float("-inf"))
    return _e(spark, d).select("vec_id", F.size(kept).alias("kept"), F.round(F.array_min(kept), 6).alias("least"), nx.argmax(F.col("v")).alias("best"))


def causal_attention(spark, d):
    """Attention of four places of 16 components in each embedding, checked against its relational form."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s):
        def one(v):
            x = np.asarray(v, float).reshape(4, 16)
            return md.attention(x, x, x).reshape(-1)

        return s.map(one)

    return _exploded(_e(spark, d), run(F.col("v")))


def lr_schedule(spark, d):
    return spark.range(0, 121).select(F.col("id").alias("step"), F.round(nx.learning_rate(F.col("id"), 1e-3, 1e-4, 20, 100), 9).alias("lr"))


def sampling(spark, d):
    p = nx.softmax(nx.keep_top(nx.scale(F.col("v"), 0.7), 8))
    return _e(spark, d).select("vec_id", nx.draw(p, (F.col("vec_id") * 37 % 101) / 101.0).alias("token"))


def _texts(spark, d):
    """Documents and the vocabulary of all their characters, in order of their code points."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs, tx.char_vocabulary(docs, "text")


def char_encode(spark, d):
    docs, vocabulary = _texts(spark, d)
    ids = docs.select("doc_id", tx.char_encode(F.col("text"), vocabulary).alias("ids"))
    tail = nx.last_tokens(F.col("ids"), 16)
    return ids.select("doc_id", nx.in_vocabulary(F.col("ids"), 65).alias("ok"), F.size("ids").alias("n"), F.md5(F.concat_ws(",", "ids")).alias("digest"), F.concat_ws(",", tail).alias("tail")).where("n >= 0")


def char_roundtrip(spark, d):
    docs, vocabulary = _texts(spark, d)
    return docs.select("doc_id", tx.char_decode(tx.char_encode(F.col("text"), vocabulary), vocabulary).alias("text"))


def split_train_val(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") - 1).alias("pos"))
    return md.positional_split(rows, "pos", 0.9, rows.count()).groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def context_windows(spark, d):
    docs, vocabulary = _texts(spark, d)
    w = docs.select("doc_id", tx.char_encode(F.col("text"), vocabulary).alias("ids")).select("doc_id", F.explode(md.context_windows(F.col("ids"), 32)).alias("w"))
    return w.select("doc_id", "w.start", F.md5(F.concat_ws(",", "w.x")).alias("x"), F.md5(F.concat_ws(",", "w.y")).alias("y"))


def param_counts(spark, d):
    rows = [(c.layers, c.width, md.param_count(c), md.param_count(c, False), sum(md.decay_groups(c).values())) for c in (md.GptConfig(), md.GptConfig(65, 64, 2, 2, 32))]
    return spark.createDataFrame(rows, "layers int, width int, params bigint, without_positions bigint, decaying int")


def generate_greedy(spark, d):
    docs, vocabulary = _texts(spark, d)
    ids = F.transform(nx.last_tokens(tx.char_encode(F.col("text"), vocabulary), 16), lambda i: (i % TINY.vocab).cast("int"))
    return md.generate(docs.select("doc_id", ids.alias("ids")), "ids", md.init_gpt(TINY, 1), TINY, 4).select("doc_id", F.concat_ws(",", "generated").alias("generated"))


def gpt_loss(spark, d):
    """Mean loss of an untrained model over seeded windows of all texts."""
    docs, vocabulary = _texts(spark, d)
    ids = docs.select(F.transform(tx.char_encode(F.col("text"), vocabulary), lambda i: (i % TINY.vocab).cast("int")).alias("ids"))
    found = md.estimate_loss({"train": ids}, "ids", md.init_gpt(TINY, 1), TINY, md.TrainConfig(batch=32, eval_batches=2))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "split string, loss double")


def sql():
    v = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"
    each = f"each AS (SELECT vec_id, (i - 1)::INT AS place, v[i] AS x FROM ({v}), range(1, 65) t(i))"
    hidden = [f"tanh({b} + " + " + ".join(f"{w} * {c}" for w, c in zip(row, X, strict=True)) + ")" for row, b in zip(*LAYERS[0], strict=True)]
    y = f"({LAYERS[1][1][0]} + " + " + ".join(f"{w} * {h}" for w, h in zip(LAYERS[1][0][0], hidden, strict=True)) + ")"
    err = f"({B} + " + " + ".join(f"{w} * {c}" for w, c in zip(W, X, strict=True)) + " - l_extendedprice)"
    num = "(l_discount * 3 + l_quantity * l_quantity - 1)"
    moments = "SELECT avg(q * q) AS qq, avg(q * d) AS qd, avg(d * d) AS dd, avg(q) AS q1, avg(d) AS d1, avg(q * y) AS qy, avg(d * y) AS dy, avg(y) AS y1, avg(y * y) AS yy FROM (SELECT l_quantity / 50 AS q, l_discount AS d, l_tax AS y FROM lineitem)"
    ids = (
        "chars AS (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM documents WHERE text IS NOT NULL)), "
        "vocabulary AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT c FROM chars)), "
        "encoded AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM chars JOIN vocabulary USING (c) GROUP BY doc_id UNION ALL SELECT doc_id, [] FROM documents WHERE text = '')"
    )
    return {
        "scalar_ops": f"SELECT l_orderkey, l_linenumber, round({num} / (l_quantity + 0.5), 6) AS f, round(3 / (l_quantity + 0.5), 6) AS dx, round((2 * l_quantity * (l_quantity + 0.5) - {num}) / pow(l_quantity + 0.5, 2), 6) AS dq FROM lineitem",
        "relu_tanh": "SELECT l_orderkey, l_linenumber, round(greatest(l_discount - 0.05, 0), 6) AS r, CASE WHEN l_discount - 0.05 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS dr, round(tanh(l_discount - 0.05), 6) AS t, round(1 - pow(tanh(l_discount - 0.05), 2), 6) AS dt, round(exp((l_discount - 0.05) * 2), 6) AS e, round(ln(l_discount - 0.05 + 1), 6) AS l FROM lineitem",
        "linreg_grad": f"SELECT round(avg({err} * {err}), 2) AS loss, " + ", ".join(f"round(avg(2 * {err} * {c}), 2) AS d_{c}" for c in X) + f", round(avg(2 * {err}), 2) AS d_bias FROM lineitem",
        "mlp_forward": f"SELECT l_orderkey, l_linenumber, round({y}, 6) AS y FROM lineitem",
        "mse": f"SELECT l_returnflag, round(avg(pow({y} - l_discount, 2)), 6) AS mse FROM lineitem GROUP BY l_returnflag",
        "grad_clip": f"SELECT vec_id, round(n, 6) AS norm, round(least(1.0, 0.5 / (n + 1e-6)), 6) AS factor FROM (SELECT vec_id, sqrt(list_dot_product(v, v)) AS n FROM ({v}))",
        "softmax": f"WITH {each}, e AS (SELECT vec_id, place, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM each) SELECT vec_id, place, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS x FROM e",
        "layernorm": f"WITH {each} SELECT vec_id, place, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5), 6) AS x FROM each WINDOW w AS (PARTITION BY vec_id)",
        "gelu": f"WITH {each} SELECT vec_id, place, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) AS x FROM each",
        "cross_entropy": f"WITH {each}, z AS (SELECT vec_id, ln(sum(exp(x))) AS z FROM each GROUP BY vec_id) SELECT round(avg(z - x), 6) AS loss, count(*) AS n FROM z JOIN each USING (vec_id) WHERE place = vec_id % 64 AND vec_id % 7 <> 0",
        "topk_mask": f"SELECT vec_id, len(list_filter(v, lambda x: x >= list_sort(v, 'DESC')[5]))::INT AS kept, round(list_sort(v, 'DESC')[5], 6) AS least, (list_position(v, list_max(v)) - 1)::INT AS best FROM ({v})",
        "causal_attention": f"WITH {each}, s AS (SELECT q.vec_id, q.place // 16 AS qp, k.place // 16 AS kp, sum(q.x * k.x) / 4 AS s FROM each q JOIN each k ON q.vec_id = k.vec_id AND q.place % 16 = k.place % 16 AND k.place // 16 <= q.place // 16 GROUP BY ALL), "
        "w AS (SELECT *, exp(s - max(s) OVER p) AS e FROM s WINDOW p AS (PARTITION BY vec_id, qp)), n AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, qp) AS w FROM w) "
        "SELECT n.vec_id, (qp * 16 + e.place % 16)::INT AS place, round(sum(w * e.x), 6) AS x FROM n JOIN each e ON n.vec_id = e.vec_id AND n.kp = e.place // 16 GROUP BY n.vec_id, qp, e.place % 16",
        "lr_schedule": "SELECT i AS step, round(CASE WHEN i < 20 THEN 1e-3 * (i + 1) / 21 WHEN i > 100 THEN 1e-4 ELSE 1e-4 + 0.5 * (1 + cos(pi() * (i - 20) / 80.0)) * 9e-4 END, 9)::DOUBLE AS lr FROM range(0, 121) t(i)",
        "char_roundtrip": "SELECT doc_id, text FROM documents",
        "char_encode": f"WITH {ids} SELECT doc_id, len(list_filter(ids, lambda t: t >= 65)) = 0 AS ok, len(ids)::INT AS n, md5(array_to_string(ids, ',')) AS digest, array_to_string(ids[greatest(len(ids) - 15, 1):], ',') AS tail FROM encoded",
        "context_windows": f"WITH {ids} SELECT doc_id, s::INT AS start, md5(array_to_string(ids[s + 1:s + 32], ',')) AS x, md5(array_to_string(ids[s + 2:s + 33], ',')) AS y FROM (SELECT doc_id, ids, unnest(range(0, len(ids) - 32, 32)) AS s FROM encoded WHERE len(ids) > 32)",
        "sampling": f"WITH kept AS (SELECT vec_id, v, list_sort(v, 'DESC')[8] AS kth, list_max(v) AS top FROM ({v})), e AS (SELECT vec_id, i, CASE WHEN v[i] >= kth THEN exp((v[i] - top) / 0.7) ELSE 0 END AS e FROM kept, range(1, 65) t(i)), "
        "c AS (SELECT vec_id, sum(e) OVER (PARTITION BY vec_id ORDER BY i) / sum(e) OVER (PARTITION BY vec_id) AS c FROM e) SELECT vec_id, least(count(*) FILTER (c <= (vec_id * 37 % 101) / 101.0), 63)::INT AS token FROM c GROUP BY vec_id",
        "sgd_linear": f"WITH RECURSIVE m AS ({moments}), s(k, wq, wd, b, loss) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL SELECT k + 1, wq - (wq * qq + wd * qd + b * q1 - qy), wd - (wq * qd + wd * dd + b * d1 - dy), b - (wq * q1 + wd * d1 + b - y1), "
        "wq * wq * qq + wd * wd * dd + b * b + 2 * (wq * wd * qd + wq * b * q1 + wd * b * d1 - wq * qy - wd * dy - b * y1) + yy FROM s, m WHERE k < 10) SELECT round(wq, 6) AS w_q, round(wd, 6) AS w_discount, round(b, 6) AS bias, round(loss, 6) AS loss FROM s WHERE k = 10",
        "split_train_val": "SELECT CASE WHEN o_orderkey - 1 < (SELECT floor(0.9 * count(*)) FROM orders) THEN 'train' ELSE 'val' END AS split, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1",
        "param_counts": "SELECT l AS layers, d AS width, p + n * d AS params, p AS without_positions, 2 + 4 * l AS decaying FROM (SELECT l, d, n, (65 * d + l * (12 * d * d + 13 * d) + 2 * d)::BIGINT AS p FROM (VALUES (4, 128, 256), (2, 32, 64)) t(l, d, n))",
    }


NAMES = [
    "scalar_ops", "relu_tanh", "linreg_grad", "mlp_forward", "mse", "sgd_linear", "grad_clip", "softmax", "layernorm", "gelu", "cross_entropy", "topk_mask", "causal_attention", "lr_schedule", "sampling",
    "char_encode", "char_roundtrip", "split_train_val", "context_windows", "param_counts", "generate_greedy", "gpt_loss",
]
