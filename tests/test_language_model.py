import numpy as np
import pytest

from tessera.operators import models as md

C = md.GptConfig(vocab=7, block=6, layers=2, heads=2, width=8)


def params(c=C, seed=3):
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(0, 0.1, v.shape) for k, v in md.init_gpt(c, seed).items()}


@pytest.mark.parametrize("bias", [True, False])
def test_gradients_match_finite_differences(bias):
    c = md.GptConfig(7, 6, 2, 2, 8, bias)
    p, rng = params(c), np.random.default_rng(0)
    x, y = rng.integers(0, 7, (3, 5)), rng.integers(-1, 7, (3, 5))
    _, n, grads = md.gpt_loss(x, y, p, c, True)
    assert n == (y != -1).sum() and set(grads) == set(p)
    for k, w in p.items():
        for at in rng.integers(0, w.size, 4):
            moved = [md.gpt_loss(x, y, p | {k: (w.reshape(-1) + d * np.eye(1, w.size, at)[0]).reshape(w.shape)}, c)[0] for d in (1e-5, -1e-5)]
            assert abs((moved[0] - moved[1]) / 2e-5 - grads[k].reshape(-1)[at]) < 1e-5


def test_loss_checks():
    p = params()
    assert md.gpt_loss(np.array([[1, 2]]), np.array([[-1, -1]]), p, C)[:2] == (0.0, 0)
    for x, y in (([[7]], [[1]]), ([[1]], [[7]]), ([[1]], [[-2]]), ([[1, 2]], [[1]])):
        with pytest.raises(ValueError):
            md.gpt_loss(np.array(x), np.array(y), p, C)
    with pytest.raises(FloatingPointError):
        md.gpt_loss(np.array([[1]]), np.array([[1]]), p | {"wpe": p["wpe"] * np.nan}, C)


def test_windows_are_seeded_and_whole(spark):
    df = spark.createDataFrame([(list(range(20)),), (list(range(100, 107)),), ([1, 2],), (None,)], "ids array<int>")
    a = [(r.x, r.y) for r in md.sample_windows(df, "ids", 5, 8, 1).collect()]
    assert a == [(r.x, r.y) for r in md.sample_windows(df.repartition(3), "ids", 5, 8, 1).collect()] and len(a) == 8
    assert a != [(r.x, r.y) for r in md.sample_windows(df, "ids", 5, 8, 2).collect()]
    assert all(len(x) == len(y) == 5 and x[1:] == y[:-1] and y[-1] == x[-1] + 1 for x, y in a)
    assert md.sample_windows(df, "ids", 5, 500, 1).count() == 17
    with pytest.raises(ValueError):
        md.sample_windows(df, "ids", 50, 1, 1)


def test_training_learns_a_cycle(spark):
    df = spark.createDataFrame([([i % 7 for i in range(k, k + 40)],) for k in range(7)], "ids array<int>").repartition(3)
    t = md.TrainConfig(batch=8, steps=25, lr=3e-2, warmup=2, decay_steps=25, eval_every=24, eval_batches=1)
    seen = []
    p, losses = md.train_gpt(df, "ids", md.init_gpt(C, 1), C, t, df, lambda *a: seen.append(a))
    assert losses[0] > 1.7 and losses[-1] < 0.6 * losses[0] and len(losses) == 25
    assert [s[0] for s in seen] == [0, 24] and set(seen[-1][2]) == {"train", "val"} and seen[-1][2]["val"] < losses[0]
    again = md.generate(spark.createDataFrame([([1, 2, 3],), ([5, 6],), (None,)], "ids array<int>"), "ids", p, C, 3).collect()
    assert [len(r.generated) if r.generated else None for r in again] == [6, 5, None]


def test_rates():
    t = md.TrainConfig(lr=1e-3, least_lr=1e-4, warmup=20, decay_steps=100)
    assert t.rate(0) == 1e-3 / 21 and abs(t.rate(20) - 1e-3) < 1e-12 and abs(t.rate(100) - 1e-4) < 1e-12 and t.rate(101) == 1e-4
