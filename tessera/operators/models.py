"""Training of small networks and a character language model, with gradients summed over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import let

Layers = list[tuple[np.ndarray, np.ndarray]]


def init_layers(sizes: list[int], seed: int = 0) -> Layers:
    """Weights uniform in [-1, 1), biases 0."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (m, n)), np.zeros(m)) for n, m in zip(sizes, sizes[1:], strict=False)]


def forward(x: np.ndarray, layers: Layers, activation: str = "tanh") -> list[np.ndarray]:
    """Outputs of every layer, the input first; the last layer is linear."""
    outs = [x]
    for n, (w, b) in enumerate(layers):
        z = outs[-1] @ w.T + b
        outs.append(z if n == len(layers) - 1 else np.tanh(z) if activation == "tanh" else np.maximum(z, 0))
    return outs


def gradient(x: np.ndarray, y: np.ndarray, layers: Layers, activation: str = "tanh") -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
    """Sum of squared errors and its gradients, over all rows of ``x``."""
    outs = forward(x, layers, activation)
    error = outs[-1] - y
    loss, grads, delta = float((error**2).sum()), [], 2 * error
    for n in range(len(layers) - 1, -1, -1):
        grads.append((delta.T @ outs[n], delta.sum(0)))
        if n:
            delta = delta @ layers[n][0]
            delta *= 1 - outs[n] ** 2 if activation == "tanh" else outs[n] > 0
    return loss, grads[::-1]


def sgd_fit(df: DataFrame, x: list[str], y: str, layers: Layers, lr: float, steps: int, activation: str = "tanh", callback: Callable[[int, float], None] | None = None) -> tuple[Layers, float]:
    """Layers after ``steps`` full-batch steps on the mean squared error, and the last loss.

    A step broadcasts the weights, sums each partition's gradients in Arrow batches and reduces them to
    one row; what moves is of the size of the weights, whatever the number of rows. Rows with a null
    are left out; an empty table leaves the layers as they are.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in [*x, y]]).dropna().persist()
    sizes = [a.size for w, b in layers for a in (w, b)]
    loss = 0.0
    try:
        for step in range(steps):
            held = rows.sparkSession.sparkContext.broadcast(layers)

            def part(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                flat, n = np.zeros(sum(sizes) + 1), 0
                for b in batches:
                    data = np.stack([c.to_numpy() for c in b.columns], axis=1) if len(b) else np.zeros((0, len(x) + 1))
                    error, grads = gradient(data[:, :-1], data[:, -1:], held.value, activation)
                    flat += np.concatenate([[error], *[a.reshape(-1) for g in grads for a in g]])
                    n += len(b)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["n", "g"])

            sums = rows.mapInArrow(part, "n bigint, g array<double>").select("n", F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("at").collect()
            held.unpersist()
            if not sums:
                break
            n, flat = sums[0].n, np.array([r.v for r in sums])
            loss, at, moved = flat[0] / n, 1, []
            for w, b in layers:
                dw, db = flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]
                at += w.size + b.size
                moved.append((w - lr * dw / n, b - lr * db / n))
            layers = moved
            if callback:
                callback(step, loss)
    finally:
        rows.unpersist()
    return layers, loss


def linear_gradient(df: DataFrame, x: list[str], y: str, weights: list[float], bias: float) -> DataFrame:
    """One row: mean squared error of a linear neuron and its derivatives ``d_<x>`` and ``d_bias``, as plain sums."""
    error = sum((F.col(c) * float(w) for c, w in zip(x, weights, strict=True)), F.lit(float(bias))) - F.col(y)
    return df.agg(F.avg(error * error).alias("loss"), *[F.avg(2 * error * F.col(c)).alias(f"d_{c}") for c in x], F.avg(2 * error).alias("d_bias"))


@dataclass(frozen=True)
class GptConfig:
    vocab: int = 65
    block: int = 256
    layers: int = 4
    heads: int = 4
    width: int = 128
    bias: bool = True


def param_shapes(c: GptConfig) -> dict[str, tuple[int, ...]]:
    """Names and shapes of a model's parameters; the head shares the token embedding."""
    d = c.width
    out: dict[str, tuple[int, ...]] = {"wte": (c.vocab, d), "wpe": (c.block, d)}

    def add(name: str, *shape: int, scale_only: bool = False) -> None:
        out[f"{name}.w"] = shape
        if c.bias:
            out[f"{name}.b"] = (shape[0],)

    for i in range(c.layers):
        add(f"h{i}.ln1", d)
        add(f"h{i}.qkv", 3 * d, d)
        add(f"h{i}.proj", d, d)
        add(f"h{i}.ln2", d)
        add(f"h{i}.up", 4 * d, d)
        add(f"h{i}.down", d, 4 * d)
    add("ln_f", d)
    return out


def param_count(c: GptConfig, positions: bool = True) -> int:
    return sum(int(np.prod(s)) for n, s in param_shapes(c).items() if positions or n != "wpe")


def decay_groups(c: GptConfig) -> dict[str, bool]:
    """Whether a parameter decays: those of two or more dimensions do."""
    return {n: len(s) >= 2 for n, s in param_shapes(c).items()}


def init_gpt(c: GptConfig, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    one = lambda n, s: np.ones(s) if ".ln" in n and n.endswith(".w") or n == "ln_f.w" else np.zeros(s) if n.endswith(".b") else rng.normal(0, 0.02, s)
    return {n: one(n, s) for n, s in param_shapes(c).items()}


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Causal attention over (..., places, width): each place sees itself and those before."""
    s = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    s = np.where(np.tril(np.ones(s.shape[-2:], bool)), s, -np.inf)
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True) @ v


EPS, GELU_SCALE, GELU_CUBE = 1e-5, float(np.sqrt(2 / np.pi)), 0.044715  # fixed values of layer norm and GELU


class _Pass:
    """A forward pass of the language model that remembers what its backward pass needs."""

    def __init__(self, p: dict[str, np.ndarray], c: GptConfig):
        self.p, self.c = p, c
        self.kept: dict[str, tuple[np.ndarray, ...]] = {}
        self.grads: dict[str, np.ndarray] = {}

    def norm(self, x: np.ndarray, name: str) -> np.ndarray:
        middle = x - x.mean(-1, keepdims=True)
        scale = 1 / np.sqrt((middle**2).mean(-1, keepdims=True) + EPS)
        self.kept[name] = (middle * scale, scale)
        return middle * scale * self.p[f"{name}.w"] + self.p.get(f"{name}.b", 0)

    def norm_back(self, dy: np.ndarray, name: str) -> np.ndarray:
        hat, scale = self.kept[name]
        self.add(f"{name}.w", (dy * hat).reshape(-1, dy.shape[-1]).sum(0))
        self.add(f"{name}.b", dy.reshape(-1, dy.shape[-1]).sum(0))
        d = dy * self.p[f"{name}.w"]
        return scale * (d - d.mean(-1, keepdims=True) - hat * (d * hat).mean(-1, keepdims=True))

    def lin(self, x: np.ndarray, name: str) -> np.ndarray:
        self.kept[name] = (x,)
        return x @ self.p[f"{name}.w"].T + self.p.get(f"{name}.b", 0)

    def lin_back(self, dy: np.ndarray, name: str) -> np.ndarray:
        (x,) = self.kept[name]
        flat = dy.reshape(-1, dy.shape[-1])
        self.add(f"{name}.w", flat.T @ x.reshape(-1, x.shape[-1]))
        self.add(f"{name}.b", flat.sum(0))
        return dy @ self.p[f"{name}.w"]

    def add(self, name: str, g: np.ndarray) -> None:
        if name in self.p:
            self.grads[name] = self.grads.get(name, 0) + g

    def forward(self, ids: np.ndarray) -> np.ndarray:
        c, (rows, n) = self.c, ids.shape
        x = self.p["wte"][ids] + self.p["wpe"][:n]
        for i in range(c.layers):
            qkv = self.lin(self.norm(x, f"h{i}.ln1"), f"h{i}.qkv").reshape(rows, n, 3, c.heads, -1).transpose(2, 0, 3, 1, 4)
            self.kept[f"h{i}.att"] = tuple(qkv)
            x = x + self.lin(attention(*qkv).transpose(0, 2, 1, 3).reshape(rows, n, -1), f"h{i}.proj")
            u = self.lin(self.norm(x, f"h{i}.ln2"), f"h{i}.up")
            t = np.tanh(GELU_SCALE * (u + GELU_CUBE * u**3))
            self.kept[f"h{i}.gelu"] = (u, t)
            x = x + self.lin(0.5 * u * (1 + t), f"h{i}.down")
        self.kept["top"] = (self.norm(x, "ln_f"), ids)
        return self.kept["top"][0] @ self.p["wte"].T

    def backward(self, dz: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all parameters for the gradient of the logits."""
        c = self.c
        top, ids = self.kept["top"]
        rows, n = ids.shape
        self.add("wte", dz.reshape(-1, c.vocab).T @ top.reshape(-1, c.width))
        dx = self.norm_back(dz @ self.p["wte"], "ln_f")
        for i in reversed(range(c.layers)):
            u, t = self.kept[f"h{i}.gelu"]
            du = self.lin_back(dx, f"h{i}.down") * (0.5 * (1 + t) + 0.5 * u * (1 - t**2) * GELU_SCALE * (1 + 3 * GELU_CUBE * u**2))
            dx = dx + self.norm_back(self.lin_back(du, f"h{i}.up"), f"h{i}.ln2")
            dy = self.lin_back(dx, f"h{i}.proj").reshape(rows, n, c.heads, -1).transpose(0, 2, 1, 3)
            dqkv = np.stack(attention_back(*self.kept[f"h{i}.att"], dy)).transpose(1, 3, 0, 2, 4).reshape(rows, n, -1)
            dx = dx + self.norm_back(self.lin_back(dqkv, f"h{i}.qkv"), f"h{i}.ln1")
        each = np.zeros_like(self.p["wte"])
        np.add.at(each, ids.reshape(-1), dx.reshape(-1, c.width))
        self.add("wte", each)
        places = np.zeros_like(self.p["wpe"])
        places[:n] = dx.sum(0)
        self.add("wpe", places)
        return self.grads


def attention_back(q: np.ndarray, k: np.ndarray, v: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of causal attention's three inputs."""
    share = np.sqrt(q.shape[-1])
    s = np.where(np.tril(np.ones((q.shape[-2], q.shape[-2]), bool)), q @ np.swapaxes(k, -1, -2) / share, -np.inf)
    w = np.exp(s - s.max(-1, keepdims=True))
    w /= w.sum(-1, keepdims=True)
    dw = dy @ np.swapaxes(v, -1, -2)
    ds = w * (dw - (dw * w).sum(-1, keepdims=True)) / share
    return ds @ k, np.swapaxes(ds, -1, -2) @ q, np.swapaxes(w, -1, -2) @ dy


def _checked_ids(ids: np.ndarray, c: GptConfig, ignored: int | None = None) -> np.ndarray:
    if ids.ndim != 2 or ids.size and (((ids < 0) | (ids >= c.vocab)) & (ids != ignored if ignored is not None else True)).any():
        raise ValueError("ids must be rows of numbers within the vocabulary")
    return ids[:, -c.block :]


def gpt_logits(ids: np.ndarray, p: dict[str, np.ndarray], c: GptConfig) -> np.ndarray:
    """Logits (rows, places, vocab) of id rows of one length; only the last ``block`` ids count; bad ids raise."""
    return _Pass(p, c).forward(_checked_ids(ids, c))


def gpt_loss(ids: np.ndarray, targets: np.ndarray, p: dict[str, np.ndarray], c: GptConfig, with_gradient: bool = False) -> tuple[float, int, dict[str, np.ndarray]]:
    """Summed cross-entropy over the targets, how many count (those of -1 don't), and the sum's gradients if wanted.

    A loss that is not finite raises. Without a target that counts the sum is 0.
    """
    ids, targets = _checked_ids(ids, c), _checked_ids(targets, c, -1)
    if ids.shape != targets.shape:
        raise ValueError("there must be a target for every id")
    run = _Pass(p, c)
    z = run.forward(ids)
    z = z - z.max(-1, keepdims=True)
    total = np.exp(z).sum(-1, keepdims=True)
    counts = targets != -1
    at = np.where(counts, targets, 0)[..., None]
    loss = float(((np.log(total) - np.take_along_axis(z, at, -1))[..., 0] * counts).sum())
    if not np.isfinite(loss):
        raise FloatingPointError("the loss is not finite")
    if not with_gradient:
        return loss, int(counts.sum()), {}
    dz = np.exp(z) / total
    np.put_along_axis(dz, at, np.take_along_axis(dz, at, -1) - 1, -1)
    return loss, int(counts.sum()), run.backward(dz * counts[..., None])


def sample_windows(df: DataFrame, ids: str, block: int, size: int, seed: int) -> DataFrame:
    """``x, y`` ARRAY<INT>: ``size`` random windows of ``block`` ids and the ids one place later, the same for the same seed.

    Every start of every row of ids that is longer than ``block`` has the same chance; a start is drawn
    once. With fewer starts than ``size`` all are drawn, with none it raises. Starts are compared by a
    hash of the seed, the row's ids and the start: those below a bound that leaves enough are sorted.
    """
    if size < 1:
        raise ValueError("size must be positive")
    rows = df.select(F.col(ids).cast("array<int>").alias("ids")).where(F.size(ids) > block)
    starts = rows.agg(F.sum(F.size("ids") - block)).first()[0]
    if not starts:
        raise ValueError(f"no row has more than {block} ids")
    place = lambda i: F.xxhash64(F.lit(seed), F.col("row"), i).bitwiseAND(F.lit(2**53 - 1)) / float(2**53)
    bound = min(1.0, (size + 10 * size**0.5 + 50) / starts)
    keyed = rows.withColumn("row", F.xxhash64("ids"))
    drawn = keyed.select("ids", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.size("ids") - block - 1), lambda i: F.struct(place(i).alias("h"), i.alias("i"))), lambda s: s["h"] < bound)).alias("s"))
    best = drawn.orderBy("s.h", "s.i").limit(size)
    return best.select(F.slice("ids", F.col("s.i") + 1, block).alias("x"), F.slice("ids", F.col("s.i") + 2, block).alias("y"))


def _summed(windows: DataFrame, p: dict[str, np.ndarray], c: GptConfig, with_gradient: bool) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss, count and gradients summed over windows: in each partition, then in about the square root of their number of tasks."""
    names = list(p)
    spark = windows.sparkSession
    held = spark.sparkContext.broadcast(p)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, flat = 0.0, 0, np.zeros(sum(p[k].size for k in names) if with_gradient else 0)
        for b in batches:
            if len(b):
                x, y = (np.stack(col.to_numpy(zero_copy_only=False)) for col in b.columns)
                here, seen, grads = gpt_loss(x, y, held.value, c, with_gradient)
                loss, n = loss + here, n + seen
                if with_gradient:
                    flat += np.concatenate([grads[k].reshape(-1) for k in names])
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["loss", "n", "g"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            flat = sum(np.frombuffer(r["g"]) for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array([sum(r["loss"] for r in rows)]), pa.array([sum(r["n"] for r in rows)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["loss", "n", "g"])

    kinds = "loss double, n bigint, g binary"
    sums = windows.mapInArrow(part, kinds)
    width = int(windows.rdd.getNumPartitions() ** 0.5)
    if width > 2:
        sums = sums.repartition(width).mapInArrow(merged, kinds)
    rows = sums.collect()
    held.unpersist()
    flat, grads, at = sum(np.frombuffer(r.g) for r in rows), {}, 0
    for k in names if with_gradient else ():
        grads[k] = flat[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    return sum(r.loss for r in rows), sum(r.n for r in rows), grads


@dataclass(frozen=True)
class TrainConfig:
    """Batch, schedule and AdamW settings of ``train_gpt``."""

    batch: int = 12
    steps: int = 100
    lr: float = 1e-3
    least_lr: float = 1e-4
    warmup: int = 10
    decay_steps: int = 100
    weight_decay: float = 0.1
    betas: tuple[float, float] = (0.9, 0.99)
    clip: float = 1.0
    eval_every: int = 50
    eval_batches: int = 2
    seed: int = 0

    def rate(self, step: int) -> float:
        """Linear warm-up, cosine decay, then the least rate; as ``numeric.learning_rate``."""
        if step < self.warmup:
            return self.lr * (step + 1) / (self.warmup + 1)
        if step > self.decay_steps:
            return self.least_lr
        ratio = (step - self.warmup) / (self.decay_steps - self.warmup)
        return self.least_lr + 0.5 * (1 + np.cos(np.pi * ratio)) * (self.lr - self.least_lr)


def adamw(p: dict[str, np.ndarray], grads: dict[str, np.ndarray], state: dict[str, tuple[np.ndarray, np.ndarray]], step: int, lr: float, t: TrainConfig) -> dict[str, np.ndarray]:
    """Parameters after step number ``step`` (from 1); those of two or more dimensions decay. ``state`` is kept up to date."""
    out = {}
    for k, w in p.items():
        m, v = state.get(k, (np.zeros_like(w), np.zeros_like(w)))
        m, v = t.betas[0] * m + (1 - t.betas[0]) * grads[k], t.betas[1] * v + (1 - t.betas[1]) * grads[k] ** 2
        state[k] = (m, v)
        moved = m / (1 - t.betas[0] ** step) / (np.sqrt(v / (1 - t.betas[1] ** step)) + 1e-8)
        out[k] = w * (1 - lr * t.weight_decay * (w.ndim >= 2)) - lr * moved
    return out


def estimate_loss(splits: dict[str, DataFrame], ids: str, p: dict[str, np.ndarray], c: GptConfig, t: TrainConfig, seed: int = 0) -> dict[str, float]:
    """Mean loss of ``eval_batches`` random batches of each split."""
    out = {}
    for name, df in splits.items():
        loss, n, _ = _summed(sample_windows(df, ids, c.block, t.batch * t.eval_batches, seed), p, c, False)
        out[name] = loss / n
    return out


def train_gpt(train: DataFrame, ids: str, p: dict[str, np.ndarray], c: GptConfig, t: TrainConfig, val: DataFrame | None = None, callback: Callable[[int, float, dict[str, float]], None] | None = None) -> tuple[dict[str, np.ndarray], list[float]]:
    """Parameters after ``steps`` steps of AdamW and each step's loss before it.

    A step draws a batch of windows, sums their gradients over the cluster, clips the mean by its norm
    and moves the parameters on the driver, where a model of this kind fits. A loss or gradient that is
    not finite raises. Every ``eval_every`` steps, and at the last, ``callback`` gets the losses of the splits.
    """
    splits = {"train": train} | ({"val": val} if val is not None else {})
    state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    losses: list[float] = []
    for step in range(t.steps):
        loss, n, grads = _summed(sample_windows(train, ids, c.block, t.batch, t.seed * 1_000_003 + step), p, c, True)
        if not all(np.isfinite(g).all() for g in grads.values()):
            raise FloatingPointError("a gradient is not finite")
        norm = np.sqrt(sum(((g / n) ** 2).sum() for g in grads.values()))
        grads = {k: g / n * min(1.0, t.clip / (norm + 1e-6)) for k, g in grads.items()}
        losses.append(loss / n)
        p = adamw(p, grads, state, step + 1, t.rate(step), t)
        if callback and (step % t.eval_every == 0 or step == t.steps - 1):
            callback(step, losses[-1], estimate_loss(splits, ids, p, c, t, step + 1))
    return p, losses


def generate(df: DataFrame, ids: str, params: dict[str, np.ndarray], c: GptConfig, new: int, temperature: float = 0.0, top_k: int | None = None, eos: int | None = None, seed: int = 0, out: str = "generated") -> DataFrame:
    """``df`` with ``out``: the ids continued by ``new`` tokens, ending early at ``eos``.

    Temperature 0 takes the most likely token. Otherwise tokens are drawn from a generator seeded by
    ``seed`` and the row's ids, so that a lost task draws the same again. Null and empty ids give null.
    """
    if temperature < 0:
        raise ValueError("temperature must not be negative")
    held = df.sparkSession.sparkContext.broadcast(params)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        def drawn(z: np.ndarray, rng: np.random.Generator) -> int:
            z = z / temperature
            if top_k and top_k > 0:
                z = np.where(z < np.sort(z)[-min(top_k, len(z))], -np.inf, z)
            e = np.exp(z - z.max())
            return int(rng.choice(len(e), p=e / e.sum()))

        seqs = [None if row is None or not len(row) else [int(i) for i in row] for row in s]
        rngs = [None if q is None or temperature == 0 else np.random.default_rng([seed, *[i + 1 for i in q]]) for q in seqs]
        going = [i for i, q in enumerate(seqs) if q is not None]
        for _ in range(new):
            by_length: dict[int, list[int]] = {}
            for i in going:
                by_length.setdefault(min(len(seqs[i]), c.block), []).append(i)
            for n, rows in by_length.items():  # rows of one length go through the model together
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    z = gpt_logits(np.array([seqs[i][-n:] for i in some]), held.value, c)[:, -1]
                    for i, logits in zip(some, z, strict=True):
                        seqs[i].append(int(logits.argmax()) if temperature == 0 else drawn(logits, rngs[i]))
            going = [i for i in going if seqs[i][-1] != eos]
        return pd.Series(seqs, index=s.index)

    return df.withColumn(out, run(F.col(ids)))


def positional_split(df: DataFrame, position: str, ratio: float, rows: int) -> DataFrame:
    """``df`` with ``split``: 'train' for the first int(ratio * rows) positions (from 0), else 'val'."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must be inside (0, 1)")
    return df.withColumn("split", F.when(F.col(position) < int(ratio * rows), "train").otherwise("val"))


def context_windows(ids: Column, block: int, stride: int | None = None) -> Column:
    """ARRAY<STRUCT<start, x, y>>: windows of ``block`` ids and the ids one place later; null if there are too few."""

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - block - 1, F.lit(stride or block))
        window = lambda i: F.struct(i.alias("start"), F.slice(v, i + 1, F.lit(block)).alias("x"), F.slice(v, i + 2, F.lit(block)).alias("y"))
        return F.when(F.size(v) > block, F.transform(starts, window))

    return let(ids, cut)
