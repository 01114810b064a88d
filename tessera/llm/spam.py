"""Pages of repeated keywords, links, tags or menu entries instead of sentences (problem 9).

Content and link features of every page are computed in one pass. Several weak labellers vote on each
page, none of which decides alone: a label model learned from how often they agree, over all pages,
gives a probability. Bagged decision trees are trained on a bounded sample of those labels and of
ratings, which replace them, and score every page; the scores are smoothed by the share of spam on the
page's host, as far as hosts differ by more than chance.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import broadcast_small, materialize

SPAM_ROWS, ORDINARY_ROWS, RATED_ROWS = 4_000, 12_000, 8_000  # about so many rows the trees are fitted on, however many pages there are
FEATURES = ["prose", "junk", "links", "tags", "types", "top", "pairs", "short", "breaks", "ends", "caps", "stuffed", "words", "common", "packed", "letters", "span", "capital"]

_MARKUP = re.compile(r"<a\b[^>]*>|</a>|\[[^\]\n]*\]\([^)\n]*\)|\(?https?://\S+|\bwww\.\S+|#\w+", re.I)
_HINT = re.compile(r"[^\W\d_]\.[^\W\d_]|\bdot\b", re.I)
_DOMAIN = re.compile(r"(?<![\w.-])[\w-]+(?:(?:\.| dot | \[dot\] | \(dot\) )[^\W\d_][\w-]*)+(?:/\S*)?", re.I)
_SEGMENT = re.compile(r"\n+|(?<=[.!?;])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W_]+")
_CAPITAL = re.compile(r"\b[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_BREAK = re.compile(r"[|>·•»/,]| [-–] ")
_ENDING = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")


def _content(words: list[str]) -> list[str]:
    return [w for w in words if len(w) > 3 and not w.isdigit()]


def _sentence(segment: str, words: list[str], often: set[str]) -> bool:
    """Whether a segment says something: words enough, few breaks, little repetition, a sentence's form or short words."""
    n = len(words)
    if not segment.isascii() and len(_WIDE.findall(segment)) >= 6:
        return True
    if n < 4:
        return False
    if len(_BREAK.findall(segment)) > 0.34 * n:
        return False
    content = _content(words)
    m = len(content)
    if len(set(content)) < m:
        counts = Counter(content)
        if max(counts.values()) >= 3 or m >= 5 and sum(c for c in counts.values() if c > 1) > 0.4 * m:
            return False
        if often and sum(1 for w in content if w in often) > 0.3 * m:
            return False
    short = n - m - sum(1 for w in words if w.isdigit())
    starts, ends = segment[0].isupper() or segment[0] in "¿¡0123456789[(", _ENDING.search(segment) is not None
    return (starts or ends) and short >= 0.1 * n or n >= 5 and starts and ends


def page_features(text: str) -> list[float]:
    """FEATURES of a whole text; a text without letters and digits has all zeros."""
    size = len(text) - text.count(" ") - text.count("\n") or 1
    found: list[str] = []
    rest = text
    if "://" in text or "#" in text or "](" in text or "www." in text or "<a" in text:
        found = _MARKUP.findall(text)
        rest = _MARKUP.sub(" ", text)
    tags = sum(len(j) for j in found if j[0] == "#")
    links = sum(map(len, found)) - tags
    if _HINT.search(rest):
        domains = [d.replace(" ", "") for d in _DOMAIN.findall(rest)]
        links += sum(map(len, domains))
        rest = _DOMAIN.sub(" ", rest)
    segments = [x for x in map(str.strip, _SEGMENT.split(rest)) if x]
    worded = [_WORD.findall(x.lower()) for x in segments]
    low = [w for ws in worded for w in ws]
    n = len(low)
    if not n and not links + tags:
        return [0.0] * len(FEATURES)
    content = Counter(_content(low))
    total = content.total()
    least = max(4, 0.06 * total)
    often = {w for w, c in content.most_common(16) if c >= least}
    prose = caps = ends = stuffed = breaks = 0
    for s, ws in zip(segments, worded, strict=True):
        m = len(s) - s.count(" ")
        if s[0].isupper() or s[0] in "¿¡0123456789[":
            caps += m
        if s[-1] in ".!?;。！？…" or _ENDING.search(s):
            ends += m
        breaks += len(_BREAK.findall(s))
        if _sentence(s, ws, often):
            prose += m
        elif often and sum(1 for w in ws if w in often) >= 2:
            stuffed += m
    pairs = Counter(zip(low, low[1:], strict=False))
    return [
        prose / size,
        (links + tags) / size,
        links / size,
        tags / size,
        len(set(low)) / n if n else 0.0,
        (max(content.values()) - 1) / total if total else 0.0,
        sum(c for c in pairs.values() if c > 2) / max(1, n - 1),
        sum(1 for w in low if len(w) <= 3 and not w.isdigit()) / max(1, n),
        breaks / max(1, n),
        ends / size,
        caps / size,
        stuffed / size,
        math.log1p(n),
        max(Counter(segments).values()) / len(segments) if segments else 0.0,
        len(zlib.compress(raw, 1)) / len(raw) if len(raw := text.encode(errors="replace")) > 200 else 0.6,
        sum(map(len, low)) / max(1, n),
        n / max(1, len(segments)),
        len(_CAPITAL.findall(text)) / max(1, n),
    ]


def with_features(df: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """``doc_id, host`` and the FEATURES of every non-blank text, each id once."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([page_features(x) for x in b.column(2).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(made[:, i]) for i in range(made.shape[1])]], names=["doc_id", "host", *FEATURES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{f} double" for f in FEATURES)).where("words > 0 OR junk > 0").dropDuplicates(["doc_id"])


def labellers() -> dict[str, tuple[Column, Column]]:
    """Weak labellers, each with when it takes a page for spam and when for ordinary; at both or neither it has no opinion.

    Each looks at another side of a page: links, function words, repetition, ends of sentences, the form
    of sentences, breaks and stuffing.
    """
    c = F.col
    worded = lambda n: c("words") > math.log1p(n)
    return {
        "links": (c("junk") > 0.5, (c("junk") < 0.02) & worded(25)),
        "function_words": ((c("short") < 0.12) & worded(6), c("short") > 0.2),
        "repetition": (((c("top") > 0.12) | (c("types") < 0.25)) & worded(20), (c("top") < 0.08) & (c("types") > 0.3)),
        "ends": ((c("ends") < 0.3) & worded(6), c("ends") > 0.6),
        "sentences": (c("prose") < 0.3, c("prose") > 0.7),
        "breaks": ((c("breaks") > 0.25) | (c("stuffed") > 0.4), (c("breaks") < 0.12) & (c("stuffed") < 0.1)),
    }


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Log odds of spam: a constant, and one number for each labeller and vote (-1, 0, 1), shape (labellers, 3).

    ``votes`` are the different rows of votes and ``counts`` how many pages have each. The labellers'
    accuracies are unknown: expectation-maximisation from the majority, votes independent given the truth.
    """
    weights = np.zeros((votes.shape[1], 3))
    if not len(votes):
        return 0.0, weights
    total = votes.sum(axis=1)
    p = np.where(total > 0, 0.9, 0.05)
    for _ in range(rounds):
        spam, rest = counts * p, counts * (1 - p)
        base = math.log((spam.sum() + 0.5) / (rest.sum() + 0.5))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                here = votes[:, j] == v
                weights[j, v + 1] = math.log((spam[here].sum() + 0.5) / (spam.sum() + 1.5)) - math.log((rest[here].sum() + 0.5) / (rest.sum() + 1.5))
        odds = base + sum(weights[j][votes[:, j] + 1] for j in range(votes.shape[1]))
        p = 1 / (1 + np.exp(-odds))
    return base, weights


Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # feature (-1: leaf), threshold, left child, value


def fit_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 7, leaf: int = 4, tried: int = 7) -> Tree:
    """A decision tree by the Gini index; each split looks at ``tried`` random features."""
    feature, threshold, left, value = [], [], [], []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        p = float(y[rows].mean())
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(p)
        if level == depth or len(rows) < 2 * leaf or p in (0.0, 1.0):
            return at
        best = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.permutation(x.shape[1])[:tried]:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, s = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(rows))
            a, b = s[:-1] / n, (s[-1] - s[:-1]) / (len(rows) - n)
            cost = a * (1 - a) * n + b * (1 - b) * (len(rows) - n)
            cost[(v[1:] == v[:-1]) | (n < leaf) | (len(rows) - n < leaf)] = np.inf
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (float(cost[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] < 0:
            return at
        feature[at], threshold[at] = best[1], best[2]
        below = x[rows, best[1]] <= best[2]
        grow(rows[below], level + 1)
        left[at] = grow(rows[~below], level + 1)  # the child of smaller values follows its parent
        return at

    grow(np.arange(len(y)), 0)
    return np.array(feature), np.array(threshold), np.array(left), np.array(value)


def fit_bag(x: np.ndarray, y: np.ndarray, trees: int = 25, seed: int = 5) -> list[Tree]:
    """Trees on bootstrap samples; without rows of both classes, a tree that knows the share only."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return [(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1))]
    return [fit_tree(x[s], y[s], rng) for s in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def score(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean value of the trees' leaves for the rows of ``x``."""
    total = np.zeros(len(x))
    for feature, threshold, other, value in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
            at = np.where(inner, np.where(low, at + 1, other[at]), at)
        total += value[at]
    return total / len(trees)


def labelled(features: DataFrame) -> DataFrame:
    """``features`` with ``label``, the label model's probability of spam. To the driver comes one row a pattern of votes, 3^6 at most."""
    rules = labellers()
    votes = {f"v_{n}": F.when(spam & ~good, 1).when(good & ~spam, -1).otherwise(0) for n, (spam, good) in rules.items()}
    voted = features.withColumns(votes)
    rows = voted.groupBy(*votes).agg(F.count("*").alias("n")).collect()
    base, weights = label_model(np.array([[r[v] for v in votes] for r in rows], int).reshape(-1, len(votes)), np.array([r.n for r in rows], float))
    odds = F.lit(float(base))
    for v, w in zip(votes, weights.tolist(), strict=True):
        odds = odds + F.element_at(F.array(*map(F.lit, w)), F.col(v) + 2)
    return voted.withColumn("label", 1 / (1 + F.exp(-odds))).drop(*votes)


def training_rows(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a sample of rated pages and of pages labelled spam and ordinary, by thresholds of the id's hash.

    The thresholds follow from the counts, so that about RATED_ROWS, SPAM_ROWS and ORDINARY_ROWS rows at
    most reach the driver, whatever the number of pages and partitions. A rating is the label of its page.
    """
    kind = F.when(F.col("rating").isNotNull(), "rated").when(F.col("label") > 0.5, "spam").otherwise("ordinary")
    known = known.withColumn("kind", kind)
    most = {"rated": RATED_ROWS, "spam": SPAM_ROWS, "ordinary": ORDINARY_ROWS}
    n = {r.kind: r.n for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, rows in most.items():
        share = F.when(F.col("kind") == name, min(1.0, rows / n.get(name, 1))).otherwise(share)
    place = F.xxhash64("doc_id", F.lit(5)).bitwiseAND(F.lit(2**53 - 1)) / float(2**53)
    rows = known.where(place < share).select(F.coalesce("rating", "label").alias("y"), F.xxhash64("doc_id").alias("h"), *FEATURES).collect()
    rows.sort(key=lambda r: (r.h, *r[2:]))  # the same trees whatever the order of arrival
    return np.array([r[2:] for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], np.float64)


def host_rates(scored: DataFrame) -> DataFrame:
    """``host, spam, n, rate, strength``: each host's spam and pages, the share over all, and how many pages of that share to add.

    The strength is estimated by moments from how much hosts differ: if they differ no more than chance
    does it is very large and no host moves a page; if they differ much it is small.
    """
    one = F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)
    hosts = scored.where("host IS NOT NULL").groupBy("host").agg(F.sum(one).alias("spam"), F.count("*").alias("n"))
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("spam").alias("spam"), F.sum(F.col("n") * F.col("n")).alias("square"), F.sum(F.col("spam") * F.col("spam") / F.col("n")).alias("within")).first()
    if not sums.hosts:
        return hosts.withColumns({"rate": F.lit(0.0), "strength": F.lit(1.0)})
    rate = (sums.spam + 0.5) / (sums.n + 1)
    spread = sums.within - sums.spam**2 / sums.n - (sums.hosts - 1) * rate * (1 - rate)
    room = sums.n - sums.square / sums.n
    between = spread / room if room > 0 and spread > 0 else 0.0
    strength = min(1e9, max(1.0, rate * (1 - rate) / between - 1)) if between > 0 else 1e9
    return hosts.withColumns({"rate": F.lit(float(rate)), "strength": F.lit(float(strength))})


def spam_scores(pages: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rated: str = "is_spam", smoothing: float = 0.5) -> DataFrame:
    """``doc_id, host, label, score, host_rate, smoothed, is_spam`` of every page with something visible in its text.

    ``ratings`` may repeat, contradict or be null or empty; of contradicting ones the majority counts,
    a tie is none. ``label`` is the label model's probability, ``score`` the share of the trees. Pages of
    a null host are not smoothed; ``host_rate`` leaves the page itself out. The trees are fitted on a
    bounded sample (see ``training_rows``); features, labels, scores and host rates cover all pages. An
    empty table gives an empty result.
    """
    features = materialize(with_features(pages, doc_id, text, host), "features")
    rating = F.sum(F.col(rated) * 2 - 1)
    votes = ratings.where(F.col(rated).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.when(rating != 0, (rating > 0).cast("double")).alias("rating"))
    known = labelled(features)
    x, y = training_rows(known.join(votes, "doc_id", "left"))
    trees = features.sparkSession.sparkContext.broadcast(fit_bag(x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(3 + i).to_numpy() for i in range(len(FEATURES))], axis=1) if len(b) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(score(trees.value, x))], names=["doc_id", "host", "label", "score"])

    kind = features.schema["doc_id"].dataType.simpleString()
    scored = known.select("doc_id", "host", "label", *FEATURES).mapInArrow(run, f"doc_id {kind}, host string, label double, score double")
    scored = materialize(scored, "scores")

    def logit(p: Column) -> Column:
        q = F.greatest(F.lit(0.002), F.least(F.lit(0.998), p))
        return F.log(q / (1 - q))

    own = F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)
    joined = scored.join(broadcast_small(host_rates(scored)), "host", "left")
    others = (F.col("spam") - own + F.col("strength") * F.col("rate")) / (F.col("n") - 1 + F.col("strength"))
    joined = joined.withColumn("host_rate", others)
    moved = logit(F.col("score")) + smoothing * F.coalesce(logit(F.col("host_rate")) - logit(F.col("rate")), F.lit(0.0))
    return joined.select("doc_id", "host", "label", "score", "host_rate", (1 / (1 + F.exp(-moved))).alias("smoothed")).withColumn("is_spam", F.col("smoothed") > 0.5)
