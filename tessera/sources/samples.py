"""Made-up inputs to try operators on, the same for the same seed on any number of partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPEAKERS = ("MILLER", "WEAVER", "GUARD", "PILOT")
OPENINGS = ("Who goes there", "The tide is late", "I carried the lamp", "No bell was heard", "We counted the sails", "The gate is barred")
ENDINGS = ("and none came home.", "before the frost set in.", "though the night was clear.", "as my father told me.", "while the harbour slept.")


def _share(*keys: Column) -> Column:
    """A number in [0, 1) that follows from the keys alone."""
    return F.xxhash64(*keys).bitwiseAND(F.lit(2**53 - 1)) / float(2**53)


def sample_corpus(spark: SparkSession, lines: int = 1_000, seed: int = 0) -> DataFrame:
    """``ord, text``: lines of an invented play, to train small language models on."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.floor(_share(F.lit(seed), F.lit(n), F.col("ord")) * len(words)) + 1).cast("int"))
    text = F.concat(pick(SPEAKERS, 1), F.lit(":\n"), pick(OPENINGS, 2), F.lit(", "), pick(ENDINGS, 3), F.lit("\n"))
    return spark.range(lines).select(F.col("id").alias("ord")).withColumn("text", text)


def random_vectors(spark: SparkSession, rows: int, dim: int, seed: int = 0) -> DataFrame:
    """``id, vector``: vectors of independent normal components."""
    normal = lambda i: F.sqrt(-2 * F.log(1 - _share(F.lit(seed), F.col("n"), i, F.lit(0)))) * F.cos(2 * math.pi * _share(F.lit(seed), F.col("n"), i, F.lit(1)))
    made = spark.range(rows).select(F.col("id").alias("n"))
    return made.select(F.concat(F.lit("v"), F.col("n").cast("string")).alias("id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), normal).alias("vector"))
