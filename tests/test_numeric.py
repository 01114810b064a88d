import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as nx
from tessera.operators import models as md


def test_derivatives_match_differences(spark):
    x, y = nx.Expr.variable("x"), nx.Expr.variable("y")
    f = ((x * y + 1).tanh() * x.exp() + (y**3) / (x**2 + 1) + (x * x + 2).log() - (x - y).relu()) * 0.5
    eps = 1e-6
    points = [(0.3, -0.7), (1.2, 0.4), (-0.5, 2.0)]
    near = [(a + da, b + db) for a, b in points for da, db in ((0, 0), (eps, 0), (-eps, 0), (0, eps), (0, -eps))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(near)], "i int, x double, y double")
    rows = df.select("i", f.column.alias("f"), f.grad("x").alias("dx"), f.grad("y").alias("dy"), f.grad("z").alias("dz")).orderBy("i").collect()
    for k in range(0, len(rows), 5):
        assert abs((rows[k + 1].f - rows[k + 2].f) / (2 * eps) - rows[k].dx) < 1e-5
        assert abs((rows[k + 3].f - rows[k + 4].f) / (2 * eps) - rows[k].dy) < 1e-5
        assert rows[k].dz == 0


def test_guards(spark):
    df = spark.createDataFrame([(-1.0, 0.0, 1000.0, float("nan"))], "a double, z double, big double, n double")
    for bad in (nx.safe_log(F.col("a")), nx.safe_pow(F.col("z"), -1), nx.safe_pow(F.col("a"), 0.5), nx.safe_exp(F.col("big"))):
        with pytest.raises(Exception):  # noqa: B017
            df.select(bad).collect()
    assert df.select(nx.relu(F.col("n")).alias("x")).first().x == 0


def test_array_functions(spark):
    v = [0.5, -1.0, 2.0, 2.0]
    df = spark.createDataFrame([(v,)], "v array<double>")
    a = np.array(v)
    get = lambda c: df.select(c.alias("x")).first().x
    e = np.exp(a - a.max())
    assert np.allclose(get(nx.softmax(F.col("v"))), e / e.sum())
    assert np.allclose(get(nx.layer_norm(F.col("v"))), (a - a.mean()) / np.sqrt(a.var() + 1e-5))
    assert get(nx.keep_top(F.col("v"), 1)) == [float("-inf"), float("-inf"), 2.0, 2.0] and get(nx.keep_top(F.col("v"), 0)) == v
    assert get(nx.argmax(F.col("v"))) == 2
    assert get(nx.cross_entropy(F.col("v"), F.lit(-1))) is None
    assert abs(get(nx.cross_entropy(F.col("v"), F.lit(0))) - (np.log(np.exp(a).sum()) - 0.5)) < 1e-12
    assert get(nx.draw(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)), F.lit(0.5))) == 2
    assert get(nx.last_tokens(F.array(F.lit(1), F.lit(2), F.lit(3)), 2)) == [2, 3]
    w = md.context_windows(F.array(*map(F.lit, range(6))), 2)
    assert [(r.start, r.x, r.y) for r in get(w)] == [(0, [0, 1], [1, 2]), (2, [2, 3], [3, 4])]


def test_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), float(2 * a - 3 * b + 0.5)) for a, b in x], "a double, b double, y double")
    layers, loss = md.sgd_fit(df, ["a", "b"], "y", [(np.zeros((1, 2)), np.zeros(1))], 0.3, 15)
    assert loss < 0.01 and np.allclose(layers[0][0], [[2, -3]], atol=0.1)
    assert md.sgd_fit(df.limit(0), ["a", "b"], "y", layers, 0.1, 2)[0] is layers


def test_gradient_of_network():
    layers = md.init_layers([2, 4, 4, 1], 3)
    x, y = np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]]), np.array([[0], [1], [1], [0.0]])
    _, grads = md.gradient(x, y, layers)
    for n, (w, _) in enumerate(layers):
        w[0, 0] += 1e-6
        up = md.gradient(x, y, layers)[0]
        w[0, 0] -= 2e-6
        down = md.gradient(x, y, layers)[0]
        w[0, 0] += 1e-6
        assert abs((up - down) / 2e-6 - grads[n][0][0, 0]) < 1e-5
    for _ in range(800):
        loss, grads = md.gradient(x, y, layers)
        layers = [(w - 0.05 * a, b - 0.05 * c) for (w, b), (a, c) in zip(layers, grads, strict=True)]
    assert loss < 0.1


def test_language_model(spark):
    c = md.GptConfig(vocab=11, block=6, layers=2, heads=2, width=8)
    p = md.init_gpt(c, 1)
    assert md.param_count(md.GptConfig()) == 834_432
    assert sum(a.size for a in p.values()) == md.param_count(c)
    a, b = np.array([[1, 2, 3, 4]]), np.array([[1, 2, 9, 9]])
    assert np.allclose(md.gpt_logits(a, p, c)[:, :2], md.gpt_logits(b, p, c)[:, :2])
    with pytest.raises(ValueError):
        md.gpt_logits(np.array([[11]]), p, c)
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "i int, ids array<int>")
    for t in (0.0, 0.8):
        one, two = ([r.generated for r in md.generate(df, "ids", p, c, 4, t, 3).orderBy("i").collect()] for _ in range(2))
        assert one == two and len(one[0]) == 7 and one[1:] == [None, None]
    with pytest.raises(ValueError):
        md.generate(df, "ids", p, c, 1, -1.0)
