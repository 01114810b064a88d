"""Numeric layers, losses, schedules and derivatives as Column expressions over doubles and arrays of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.functions.vectors import total


def relu(x: Column) -> Column:
    """max(x, 0); NaN gives 0, as a comparison with NaN fails."""
    return F.when(F.isnan(x) | (x <= 0), F.lit(0.0)).otherwise(x)


def safe_log(x: Column) -> Column:
    """Natural logarithm; a value that isn't positive raises."""
    return F.when(x <= 0, F.raise_error(F.lit("logarithm of a value that is not positive")).cast("double")).otherwise(F.log(x))


def safe_exp(x: Column) -> Column:
    """Exponential; an overflow raises."""
    return F.when(x > math.log(1.7976931348623157e308), F.raise_error(F.lit("overflow")).cast("double")).otherwise(F.exp(x))


def safe_pow(x: Column, n: float) -> Column:
    """Power with a constant exponent; 0 to a negative power, and a negative base with a fraction, raise."""
    bad = (x == 0) & F.lit(n < 0) | (x < 0) & F.lit(n != int(n))
    return F.when(bad, F.raise_error(F.lit("power is not defined")).cast("double")).otherwise(F.pow(x, F.lit(float(n))))


def softmax(v: Column) -> Column:
    """Shares proportional to exp, shifted by the maximum; masked places are -inf."""

    def shares(m: Column) -> Column:
        return let(F.transform(v, lambda x: F.exp(x - m)), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(F.array_max(v), shares)


def log_sum_exp(v: Column) -> Column:
    return let(F.array_max(v), lambda m: m + F.log(total(F.transform(v, lambda x: F.exp(x - m)))))


def cross_entropy(logits: Column, target: Column, ignore: int = -1) -> Column:
    """Loss of one position; null where the target is to be ignored, so that avg() is the mean over the others."""
    return F.when(target != ignore, log_sum_exp(logits) - F.element_at(logits, (target + 1).cast("int")))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Mean 0 and variance 1 over the array, without scale and shift."""

    def scaled(m: Column) -> Column:
        return let(F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v) + eps), lambda s: F.transform(v, lambda x: (x - m) / s))

    return let(total(v) / F.size(v), scaled)


def gelu(x: Column) -> Column:
    """Gaussian error unit in its tanh form."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def linear(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """weights · v + bias, an array with one value a row of weights."""
    return F.array(*[sum((v[j] * float(w) for j, w in enumerate(row)), F.lit(float(b))) for row, b in zip(weights, bias, strict=True)])


def mlp_forward(v: Column, layers: list[tuple[list[list[float]], list[float]]], activation: str = "tanh") -> Column:
    """Layers one after another, each but the last with ``activation``; a last layer of width 1 gives its value."""
    act = {"tanh": F.tanh, "relu": relu}[activation]
    for n, (w, b) in enumerate(layers):
        v = linear(v, w, b)
        if n < len(layers) - 1:
            v = let(v, lambda y: F.transform(y, lambda x: act(x)))
    return v[0] if len(layers[-1][1]) == 1 else v


def keep_top(v: Column, k: int | None) -> Column:
    """Logits with all below the k-th largest set to -inf; equals of the k-th stay; no or no positive ``k`` keeps all."""
    if not k or k < 0:
        return v
    kth = F.element_at(F.sort_array(v, asc=False), F.least(F.lit(k), F.size(v)))
    return let(kth, lambda t: F.transform(v, lambda x: F.when(x < t, F.lit(float("-inf"))).otherwise(x)))


def argmax(v: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def scale(v: Column, temperature: float) -> Column:
    return F.transform(v, lambda x: x / temperature)


def draw(probabilities: Column, uniform: Column) -> Column:
    """0-based place at which the running sum of the probabilities passes ``uniform`` in [0, 1)."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((a["s"] + p).alias("s"), (a["n"] + F.when(a["s"] + p <= uniform, 1).otherwise(0)).alias("n"))
    return F.least(F.aggregate(probabilities, start, step)["n"], F.size(probabilities) - 1)


def learning_rate(step: Column, lr: float, least: float, warmup: int, decay: int) -> Column:
    """Linear warm-up, cosine decay, then the least rate."""
    ratio = (step - warmup) / float(decay - warmup)
    return F.when(step < warmup, lr * (step + 1) / (warmup + 1)).when(step > decay, F.lit(least)).otherwise(least + 0.5 * (1 + F.cos(math.pi * ratio)) * (lr - least))


def clip_factor(norm: Column, most: float) -> Column:
    """Factor that brings a gradient of this norm to at most ``most``."""
    return F.least(F.lit(1.0), most / (norm + 1e-6))


def last_tokens(ids: Column, block: int) -> Column:
    """The last ``block`` ids."""
    return F.slice(ids, F.greatest(F.size(ids) - block, F.lit(0)) + 1, F.lit(block))


def in_vocabulary(ids: Column, size: int, ignore: int | None = None) -> Column:
    """Whether all ids are within [0, size), or the ignored one."""
    return F.forall(ids, lambda t: (t >= 0) & (t < size) | (F.lit(False) if ignore is None else t == ignore))


class Expr:
    """An expression of named variables with its value and exact derivatives as Columns."""

    def __init__(self, column: Column, slopes: dict[str, Column] | None = None):
        self.column, self.slopes = column, slopes or {}

    @classmethod
    def variable(cls, name: str) -> Expr:
        return cls(F.col(name).cast("double"), {name: F.lit(1.0)})

    @staticmethod
    def _of(x: Expr | float) -> Expr:
        return x if isinstance(x, Expr) else Expr(F.lit(float(x)))

    def _chain(self, value: Column, local: Column) -> Expr:
        return Expr(value, {n: local * s for n, s in self.slopes.items()})

    def _both(self, other: Expr, value: Column, here: Column, there: Column) -> Expr:
        a, b = self._chain(value, here).slopes, other._chain(value, there).slopes
        return Expr(value, {n: a[n] + b[n] if n in a and n in b else a.get(n, b.get(n)) for n in a | b})

    def __add__(self, o: Expr | float) -> Expr:
        o = self._of(o)
        return self._both(o, self.column + o.column, F.lit(1.0), F.lit(1.0))

    def __mul__(self, o: Expr | float) -> Expr:
        o = self._of(o)
        return self._both(o, self.column * o.column, o.column, self.column)

    def __pow__(self, n: float) -> Expr:
        slope = F.lit(0.0) if n == 0 else F.lit(float(n)) * (F.lit(1.0) if n == 1 else safe_pow(self.column, n - 1))
        return self._chain(safe_pow(self.column, n), slope)

    def __neg__(self) -> Expr:
        return self * -1.0

    def __sub__(self, o: Expr | float) -> Expr:
        return self + -self._of(o)

    def __truediv__(self, o: Expr | float) -> Expr:
        return self * self._of(o) ** -1

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o: float) -> Expr:
        return self._of(o) - self

    def __rtruediv__(self, o: float) -> Expr:
        return self._of(o) / self

    def relu(self) -> Expr:
        return self._chain(relu(self.column), F.when(self.column > 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def tanh(self) -> Expr:
        t = F.tanh(self.column)
        return self._chain(t, 1 - t * t)

    def exp(self) -> Expr:
        e = safe_exp(self.column)
        return self._chain(e, e)

    def log(self) -> Expr:
        return self._chain(safe_log(self.column), 1 / self.column)

    def grad(self, name: str) -> Column:
        """Derivative by a variable; 0 if the expression doesn't have it."""
        return self.slopes.get(name, F.lit(0.0))
