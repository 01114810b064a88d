"""Queries over documents: normalisation, shingles, near-duplicates; each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import dedup
from tessera.operators import minhash as mh
from tessera.shared import spread, table

K = 32
THRESHOLD = 0.7


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def norm_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.normalize(F.col("text"), False).alias("norm"))


def norm_text_compatibility(spark, d):
    return _docs(spark, d).select("doc_id", tx.normalize(F.col("text")).alias("norm"))


def word_shingles(spark, d):
    s = tx.shingles(tx.normalize(F.col("text"), False), 5)
    return _docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.size(F.array_distinct("s")).alias("n_distinct"), F.md5(F.array_join("s", "|")).alias("digest"))


def char_shingles(spark, d):
    s = tx.shingles(tx.normalize(F.col("text"), False), 7, "char")
    return _docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def exact_dups(spark, d):
    return dedup.exact_groups(_docs(spark, d), "doc_id", "text")


def exact_jaccard_pairs(spark, d):
    return dedup.jaccard_edges(_docs(spark, d), "doc_id", "text", 0.8).withColumn("similarity", F.round("similarity", 6))


def _signed(spark, d):
    s = tx.shingles(tx.normalize(F.col("text"), False), 5)
    return mh.with_signature(_docs(spark, d).select("doc_id", s.alias("s")), "s", "sig", K, 42, "md5")


def minhash_sig_md5(spark, d):
    return _signed(spark, d).select("doc_id", F.posexplode("sig").alias("slot", "value"))


def minhash_reference_hash(spark, d):
    s = tx.shingles(tx.normalize(F.col("text")), 5)
    return mh.with_signature(_docs(spark, d).select("doc_id", s.alias("s")), "s").select("doc_id", F.md5(F.concat_ws(",", "sig")).alias("digest"))


def _reps(spark, d):
    return dedup.sign(_docs(spark, d), "doc_id", "text", 5, K, "word", 42, "md5", False)


def _bands(spark, d):
    b, r = mh.lsh_params(THRESHOLD, K)
    return mh.lsh_bands(_reps(spark, d)[1], "rep", "sig", b, r)


def lsh_bands(spark, d):
    return _bands(spark, d).groupBy("id").agg(F.count("*").alias("bands"), F.countDistinct("band").alias("n_distinct"))


def lsh_bucket_stats(spark, d):
    return mh.bucket_stats(_bands(spark, d))


def lsh_candidates(spark, d):
    return mh.lsh_candidates(_bands(spark, d), None)


def lsh_capped_candidates(spark, d):
    """Buckets beyond their cap: the orders of a customer as ids of one bucket."""
    bands = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("band"), F.col("o_custkey").alias("key"))
    return mh.lsh_candidates(bands, 5)


def lsh_verified_edges(spark, d):
    b, r = mh.lsh_params(THRESHOLD, K)
    reps = _reps(spark, d)[1]
    return mh.verified_edges(mh.lsh_candidates(mh.lsh_bands(reps, "rep", "sig", b, r), None), reps, "rep", "sig", THRESHOLD)


def dedup_components(spark, d):
    return dedup.clusters(_docs(spark, d), "doc_id", "text", THRESHOLD, 5, K, base="md5", compatibility=False, cap=None).groupBy("component").agg(F.count("*").alias("members"))


def _dedup(spark, d, policy):
    return dedup.deduplicate(_docs(spark, d), "doc_id", "text", threshold=THRESHOLD, num_perm=K, base="md5", compatibility=False, policy=policy, cap=None).select(F.col("id").alias("doc_id"), "component", "is_kept")


def dedup_first(spark, d):
    return _dedup(spark, d, "first")


def dedup_longest(spark, d):
    return _dedup(spark, d, "longest")


def dedup_shortest(spark, d):
    return _dedup(spark, d, "shortest")


def dedup_k128(spark, d):
    """The production parameters, with a base hash that SQL has."""
    return dedup.deduplicate(_docs(spark, d), "doc_id", "text", base="md5", compatibility=False).select(F.col("id").alias("doc_id"), "component", "is_kept")


def dedup_reference_hash(spark, d):
    """The flagship: the whole pipeline with its production parameters."""
    return dedup.deduplicate(_docs(spark, d), "doc_id", "text", cap=mh.BUCKET_CAP).select(F.col("id").alias("doc_id"), "component", "is_kept")


def lsh_params_curve(spark, d):
    cases = [(t, k, *mh.lsh_params(t, k)) for t, k in ((0.5, 128), (0.6, 128), (0.7, 128), (0.75, 128), (0.8, 128), (0.75, 64))]
    rows = spark.createDataFrame([(t, k, b, r, b * r) for t, k, b, r in cases], "threshold double, num_perm int, b int, r int, used int")
    return rows.withColumn("steepest", F.round(F.pow(1 / F.col("b"), 1 / F.col("r")), 6))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '(\p{L})Σ(\P{L}|$)', '\1ς\2', 'g')), '[\r\n\t\x{0B}\f]', ' ', 'g'), '\p{C}', '', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"


def _grams(k: int) -> str:
    return f"CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END"


_SHINGLED = rf"docs AS (SELECT doc_id, text, {_NORM} AS norm FROM documents), worded AS (SELECT *, regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+') AS w FROM docs), shingled AS (SELECT *, {_grams(5)} AS s FROM worded)"


def _signed_sql(k: int = K) -> str:
    a, b = mh.coefficients(k, 42)
    numbers = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a, b, strict=True)))
    return (
        f"{_SHINGLED}, perms(slot, a, b) AS (VALUES {numbers}), "
        "hashed AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(g), 1, 15))::BIGINT AS h FROM (SELECT doc_id, unnest(s) AS g FROM shingled)), "
        f"slots AS (SELECT doc_id, slot, min((a::HUGEINT * h + b) % {mh.PRIME})::BIGINT AS value FROM hashed, perms GROUP BY ALL "
        "UNION ALL SELECT doc_id, slot, -1 FROM shingled, perms WHERE len(s) = 0), "
        "sigs AS (SELECT doc_id, list(value ORDER BY slot) AS sig FROM slots GROUP BY doc_id)"
    )


def _edges_sql(k: int = K, threshold: float = THRESHOLD) -> str:
    b, r = mh.lsh_params(threshold, k)
    return (
        f"{_signed_sql(k)}, named AS (SELECT sig, min(doc_id) AS rep FROM sigs GROUP BY sig), members AS (SELECT doc_id, rep FROM sigs JOIN named USING (sig)), "
        f"bands AS (SELECT rep, band, sig[band * {r} + 1:band * {r} + {r}] AS k FROM named, range({b}) t(band)), "
        "pairs AS (SELECT DISTINCT x.rep AS id_a, y.rep AS id_b FROM bands x JOIN bands y ON x.band = y.band AND x.k = y.k AND x.rep < y.rep), "
        f"edges AS (SELECT id_a, id_b, len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) / {k} AS similarity FROM pairs JOIN named p ON id_a = p.rep JOIN named q ON id_b = q.rep), "
        f"links AS (SELECT * FROM edges WHERE similarity >= {threshold})"
    )


def _component_sql(k: int = K, threshold: float = THRESHOLD) -> str:
    return (
        "WITH RECURSIVE " + _edges_sql(k, threshold) + ", both_ways AS (SELECT id_a AS x, id_b AS y FROM links UNION SELECT id_b, id_a FROM links), "
        "reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x), "
        "labels AS (SELECT doc_id, least(rep, coalesce((SELECT min(y) FROM reach WHERE x = rep), rep)) AS component FROM members)"
    )


def _kept_sql(order: str, k: int = K, threshold: float = THRESHOLD) -> str:
    return (
        _component_sql(k, threshold)
        + f" SELECT doc_id, component, row_number() OVER (PARTITION BY component ORDER BY {order}) = 1 AS is_kept FROM labels JOIN (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents) USING (doc_id)"
    )


def sql() -> dict[str, str]:
    curve_sql = (
        "WITH cases(threshold, num_perm) AS (VALUES (0.5::DOUBLE, 128), (0.6, 128), (0.7, 128), (0.75, 128), (0.8, 128), (0.75, 64)), "
        "grid AS (SELECT threshold, num_perm, b::INT AS b, r::INT AS r FROM cases, range(1, 129) t(b), range(1, 129) u(r) WHERE b * r <= num_perm), "
        "pts AS (SELECT threshold, num_perm, b, r, i, i / 1000.0::DOUBLE AS s FROM grid, range(0, 1001) v(i)), "
        "hit AS (SELECT *, 1 - pow(1 - pow(s, r), b) AS p, s < threshold AS low FROM pts), "
        "steps AS (SELECT *, lead(p) OVER w AS p2, lead(low) OVER w AS low2 FROM hit WINDOW w AS (PARTITION BY threshold, num_perm, b, r ORDER BY i)), "
        "loss AS (SELECT threshold, num_perm, b, r, sum(CASE WHEN low AND low2 THEN (p + p2) / 2 WHEN NOT low AND NOT low2 THEN 1 - (p + p2) / 2 ELSE 0 END) * 0.0005 AS l FROM steps WHERE p2 IS NOT NULL GROUP BY ALL), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY threshold, num_perm ORDER BY round(l, 9), b * r DESC) AS n FROM loss) "
        "SELECT threshold, num_perm, b, r, b * r AS used, round(pow(1 / b, 1 / r), 6) AS steepest FROM ranked WHERE n = 1"
    )
    return {
        "norm_text": f"SELECT doc_id, {_NORM} AS norm FROM documents",
        "word_shingles": f"WITH {_SHINGLED} SELECT doc_id, len(s)::INT AS n, len(list_distinct(s))::INT AS n_distinct, md5(array_to_string(s, '|')) AS digest FROM shingled",
        "char_shingles": f"WITH docs AS (SELECT doc_id, {_NORM} AS norm FROM documents), g AS (SELECT doc_id, CASE WHEN norm = '' THEN []::VARCHAR[] WHEN length(norm) < 7 THEN [norm] ELSE list_transform(range(1, length(norm) - 5), lambda i: array_to_string(string_split(norm, '')[i:i + 6], '')) END AS s FROM docs) SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS digest FROM g".replace(
            "lambda i: array_to_string(string_split(norm, '')[i:i + 6], '')", "lambda i: substr(norm, i, 7)"
        ),
        "exact_dups": f"SELECT min(doc_id) AS least_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY {_NORM} HAVING count(*) > 1",
        "exact_jaccard_pairs": f"WITH {_SHINGLED}, sets AS (SELECT doc_id, list_sort(list_distinct(s)) AS g FROM shingled WHERE text IS NOT NULL AND len(s) > 0), classes AS (SELECT min(doc_id) AS id, g FROM sets GROUP BY g), "
        "each AS (SELECT id, len(g) AS n, unnest(g) AS h FROM classes), shared AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c, any_value(x.n) AS n, any_value(y.n) AS m FROM each x JOIN each y ON x.h = y.h AND x.id < y.id GROUP BY ALL) "
        "SELECT id_a, id_b, round(c / (n + m - c), 6) AS similarity FROM shared WHERE c / (n + m - c) >= 0.8",
        "minhash_sig_md5": f"WITH {_signed_sql()} SELECT doc_id, slot::INT AS slot, value FROM slots",
        "lsh_bands": f"WITH {_edges_sql()} SELECT rep AS id, count(*) AS bands, count(DISTINCT band) AS n_distinct FROM bands GROUP BY rep",
        "lsh_bucket_stats": f"WITH {_edges_sql()}, sizes AS (SELECT band, k, count(*) AS n FROM bands GROUP BY ALL) SELECT count(*) AS buckets, count(*) FILTER (n > {mh.BUCKET_CAP}) AS saturated, coalesce(max(n), 0) AS largest FROM sizes",
        "lsh_candidates": f"WITH {_edges_sql()} SELECT id_a, id_b FROM pairs",
        "lsh_capped_candidates": "WITH r AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT x.id AS id_a, y.id AS id_b FROM r x JOIN r y ON x.k = y.k AND x.id < y.id AND x.n <= 5",
        "dedup_k128": _kept_sql("doc_id", 128, 0.75),
        "lsh_verified_edges": f"WITH {_edges_sql()} SELECT id_a, id_b, similarity FROM links",
        "dedup_components": _component_sql() + " SELECT component, count(*) AS members FROM labels GROUP BY component",
        "dedup_first": _kept_sql("doc_id"),
        "dedup_longest": _kept_sql("n DESC, doc_id"),
        "dedup_shortest": _kept_sql("n, doc_id"),
        "lsh_params_curve": curve_sql,
    }


NAMES = [
    "norm_text", "norm_text_compatibility", "word_shingles", "char_shingles", "exact_dups", "exact_jaccard_pairs", "minhash_sig_md5", "minhash_reference_hash", "lsh_bands", "lsh_bucket_stats",
    "lsh_candidates", "lsh_capped_candidates", "lsh_verified_edges", "dedup_components", "dedup_first", "dedup_longest", "dedup_shortest", "dedup_k128", "dedup_reference_hash", "lsh_params_curve",
]
