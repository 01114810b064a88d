"""Near-duplicate removal: normalise, shingle, sign, band, verify, join up, pick one of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import minhash as mh
from tessera.operators.graph import connected_components
from tessera.operators.pairing import pairs_of_equal_keys
from tessera.shared import materialize

POLICIES = ("first", "longest", "shortest")


def exact_groups(df: DataFrame, id: str, text: str, compatibility: bool = False) -> DataFrame:
    """``copies, least_id`` of each group of at least two rows whose normalised texts are equal."""
    key = F.md5(tx.normalize(F.col(text), compatibility))
    return df.where(F.col(text).isNotNull()).groupBy(key.alias("k")).agg(F.count("*").alias("copies"), F.min(id).alias("least_id")).where("copies > 1").select("least_id", "copies")


def sign(df: DataFrame, order: str, text: str, k: int, num_perm: int, mode: str, seed: int, base: str, compatibility: bool) -> tuple[DataFrame, DataFrame]:
    """Members ``(ord, rep)`` and representatives ``(rep, sig)``: one for each different signature, named by its first row.

    Equal normalised texts are signed once; texts whose signatures are equal share all bands and are
    one vertex, so copies and blank texts cost nothing in the joins that follow.
    """
    rows = df.select(F.col(order).alias("ord"), tx.normalize(F.col(text), compatibility).alias("norm")).where("ord IS NOT NULL")
    rows = materialize(rows.withColumn("nk", F.unhex(F.md5("norm"))), "normal")
    texts = rows.groupBy("nk").agg(F.min_by("norm", "ord").alias("norm"))
    # hashing is heavy for its size: keep every core busy where coalescing by bytes would leave one task
    width = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = mh.with_text_signature(texts.repartition(width, "nk").select("nk", "norm"), "norm", k, mode, "sig", num_perm, seed, base)
    signed = materialize(signed.withColumn("sk", F.unhex(F.md5(F.concat_ws(",", "sig")))), "signed")
    keyed = rows.select("ord", "nk").join(signed.select("nk", "sk"), "nk").select("ord", "sk")
    named = keyed.groupBy("sk").agg(F.min("ord").alias("rep"))
    members = materialize(keyed.join(named, "sk").select("ord", "rep"), "members")
    reps = materialize(signed.groupBy("sk").agg(F.any_value("sig").alias("sig")).join(named, "sk").select("rep", "sig"), "reps")
    return members, reps


def clusters(df: DataFrame, order: str, text: str, threshold: float = 0.75, k: int = 5, num_perm: int = 128, mode: str = "word", b: int | None = None, r: int | None = None, seed: int = 42, base: str = "blake2b", compatibility: bool = True, cap: int | None = None) -> DataFrame:
    """``(ord, component)`` of every row: the least ``order`` of its cluster of transitively similar texts."""
    b, r = mh.checked_params(threshold, num_perm, b, r)
    members, reps = sign(df, order, text, k, num_perm, mode, seed, base, compatibility)
    edges = mh.verified_edges(mh.lsh_candidates(mh.lsh_bands(reps, "rep", "sig", b, r), cap), reps, "rep", "sig", threshold)
    found = connected_components(edges, "id_a", "id_b").select(F.col("id").alias("rep"), "component")
    return members.join(found, "rep", "left").select("ord", F.coalesce("component", "rep").alias("component"))


def deduplicate(df: DataFrame, id: str, text: str, order: str | None = None, threshold: float = 0.75, k: int = 5, num_perm: int = 128, mode: str = "word", b: int | None = None, r: int | None = None, policy: str = "first", seed: int = 42, base: str = "blake2b", compatibility: bool = True, cap: int | None = None, most_rows: int | None = None) -> DataFrame:
    """``id, ord, component, is_kept`` for every row of the corpus; ``order`` must be unique and defaults to ``id``.

    ``policy`` keeps the ``first``, the ``longest`` or the ``shortest`` raw text of each cluster, of
    equal lengths the earlier one. Null texts count as empty; all texts without a shingle form one
    cluster. An empty corpus gives an empty result. Similarity is estimated over all ``num_perm``
    slots and compared with >=. The pick is an aggregate, so a cluster may hold any share of the rows.
    ``cap`` limits who can be found in a bucket, see ``minhash.lsh_candidates``; without it none is missed.
    ``most_rows`` refuses a larger corpus; by default any size is taken.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if most_rows is not None and df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"the corpus exceeds {most_rows} rows")
    order = order or id
    labels = materialize(clusters(df, order, text, threshold, k, num_perm, mode, b, r, seed, base, compatibility, cap), "labels")
    rows = df.select(F.col(id).alias("id"), F.col(order).alias("ord"), F.coalesce(F.length(text), F.lit(0)).alias("n")).where("ord IS NOT NULL").join(labels, "ord")
    rank = {"first": F.struct("ord"), "longest": F.struct(-F.col("n"), "ord"), "shortest": F.struct("n", "ord")}[policy]
    kept = rows.groupBy("component").agg(F.min_by("ord", rank).alias("keep"))
    return rows.join(kept, "component").select("id", "ord", "component", (F.col("ord") == F.col("keep")).alias("is_kept"))


def _by_rarity(classes: DataFrame, buckets: int = 1 << 16) -> DataFrame:
    """``classes`` with ``o``: the set ``s`` in one order for all rows, shingles of rare buckets first.

    How often shingles occur is counted by buckets of their hash, so that one row of ``buckets`` numbers
    is broadcast, whatever the number of shingles, and no shingle is a join key.
    """
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    counts = classes.select(F.explode("s").alias("h")).groupBy(bucket(F.col("h")).alias("b")).agg(F.count("*").alias("c"))
    every = classes.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("c", F.lit(0)).alias("c")))).alias("all")).select(F.lit(0).alias("one"), F.col("all.c").alias("seen"))
    joined = classes.withColumn("one", F.lit(0)).join(F.broadcast(row), "one")
    ranked = F.array_sort(F.transform("s", lambda h: F.struct(F.element_at("seen", bucket(h) + 1).alias("c"), h.alias("h"))))
    return joined.select(*classes.columns, F.transform(ranked, lambda x: x["h"]).alias("o"))


def jaccard_edges(df: DataFrame, id: str, text: str, threshold: float, k: int = 5, compatibility: bool = False) -> DataFrame:
    """Exact Jaccard similarity of shingle sets between class representatives: ``id_a, id_b, similarity``.

    Rows of equal shingle sets are one class, named by its least id. A prefix filter finds the pairs
    without comparing all: with shingles in order of rarity, two sets of similarity s must share one
    of the first |A| - ceil(s·|A|) + 1 shingles of each, and |A| >= s·|B|. Empty sets are in no pair.
    A shingle of many sets is split over tasks.
    """
    sets = df.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.array_sort(F.array_distinct(F.transform(tx.shingles(tx.normalize(F.col(text), compatibility), k), lambda g: F.xxhash64(g)))).alias("s"))
    classes = materialize(sets.where(F.size("s") > 0).groupBy(F.md5(F.concat_ws(",", "s")).alias("k")).agg(F.min("id").alias("id"), F.any_value("s").alias("s")).select("id", "s"), "sets")
    keep = F.size("s") - F.ceil(F.size("s") * threshold).cast("int") + 1
    prefix = _by_rarity(classes).select("id", F.size("s").alias("n"), F.explode(F.slice("o", F.lit(1), keep)).alias("h"))
    near = (F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold)
    pairs = pairs_of_equal_keys(prefix, "h", "id", ("n",)).where(near).select("id_a", "id_b").distinct()
    sa, sb = (classes.select(F.col("id").alias(f"id_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    similarity = both / (F.size("s_a") + F.size("s_b") - both)
    return pairs.join(sa, "id_a").join(sb, "id_b").select("id_a", "id_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
