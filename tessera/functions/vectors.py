"""Vector arithmetic and checks as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_NORM, MAX_DIM = 1e-12, 65_536
# Names of the metrics and their aliases.
METRICS = {"cosine": "cosine", "cos": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot": "dot", "ip": "dot", "inner_product": "dot"}


def metric_of(name: str) -> str:
    """The metric that a name or alias stands for, in any case."""
    try:
        return METRICS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}") from None


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product of vectors of one length."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; one shorter than 1e-12 raises."""
    short = F.raise_error(F.lit("vector norm is too small")).cast("array<double>")
    return F.when(norm(v) < MIN_NORM, short).otherwise(F.transform(v, lambda x: x.cast("double") / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; smaller is closer."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def score(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine, "euclidean": euclidean, "dot": dot}[metric_of(metric)](a, b)


def reject_reason(v: Column, dim: int | None = None) -> Column:
    """Why a vector can't be stored, or null: null, empty, too_long, wrong_dim, not_finite, zero_norm; the first that holds."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.when(v.isNull(), "null").when(F.size(v) == 0, "empty").when(F.size(v) > MAX_DIM, "too_long")
    if dim is not None:
        out = out.when(F.size(v) != dim, "wrong_dim")
    return out.when(bad, "not_finite").when(norm(v) < MIN_NORM, "zero_norm")


def valid_id(c: Column) -> Column:
    """Whether an id has something but white space; the id itself is stored as it is."""
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)\s", "")) > 0, F.lit(False))


def valid_name(c: Column) -> Column:
    """Whether a collection name consists of ASCII letters, digits, '_' and '-'."""
    return F.coalesce(c.rlike(r"\A[a-zA-Z0-9_-]+\z"), F.lit(False))
