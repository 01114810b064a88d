import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import dedup
from tessera.operators import minhash as mh
from tessera.operators.graph import connected_components


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_normalize(spark):
    n = tx.normalize(F.col("t"))
    assert one(spark, "ﬁle ＡＢ\r\n\tc​d\x07e", n) == "file ab cde"
    assert one(spark, None, n) == "" and one(spark, "", n) == ""


def test_shingles(spark):
    s = lambda k, m="word": tx.shingles(F.col("t"), k, m)
    assert one(spark, "a b c a b", s(2)) == ["a b", "b c", "c a", "a b"]
    assert one(spark, "a b", s(5)) == ["a b"] and one(spark, "?!", s(5)) == [] and one(spark, None, s(5)) is None
    assert one(spark, "añ😀o", s(2, "char")) == ["añ", "ñ😀", "😀o"]
    assert one(spark, "ab", s(3, "char")) == ["ab"] and one(spark, "", s(3, "char")) == []
    with pytest.raises(ValueError):
        tx.shingles(F.col("t"), 0)


def test_scalars(spark):
    assert one(spark, "é", tx.utf8_bytes(F.col("t"))) == [195, 169]
    assert one(spark, "", tx.utf8_bytes(F.col("t"))) == []
    assert one(spark, "k sk-ant-" + "a" * 24 + " Bearer " + "x" * 25 + " key=1&b", tx.redact(F.col("t"))) == "k [REDACTED_ANTHROPIC_KEY] Bearer [REDACTED] key=[REDACTED]&b"
    assert "&lt;/x&gt;" in one(spark, "</x>", tx.wrap_untrusted(F.col("t")))
    assert one(spark, "  ", tx.clamp_prompt(F.col("t"))) is None
    assert one(spark, "abc", tx.char_encode(F.col("t"), "abc")) == [0, 1, 2] and one(spark, "abd", tx.char_encode(F.col("t"), "abc")) is None
    assert one(spark, "99", tx.retry_after(F.col("t"), F.lit(1.0))) == 60.0 and one(spark, "soon", tx.retry_after(F.col("t"), F.lit(1.5))) == 1.5


def test_gpt_splits(spark):
    import regex

    for text in ["it's 12345 words\n\n  and  more", "Ünïcode—test’s 123,456", "日本 語 ab", ""]:
        for p in (tx.GPT2_SPLIT, tx.GPT4_SPLIT):
            assert one(spark, text, tx.split_pattern(F.col("t"), p)) == regex.findall(p.replace("(?U)", ""), text)


def test_affine61_is_exact():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, mh.PRIME, 2000, dtype=np.uint64), np.array([0, 1, mh.PRIME - 1], np.uint64)])
    for a, b in [(mh.PRIME - 1, mh.PRIME - 1), (1, 0), *zip(*mh.coefficients(5, 3), strict=True)]:
        got = mh.affine61(a, b, x >> np.uint64(31), x & np.uint64(0x7FFFFFFF))
        assert [int(v) for v in got] == [(a * int(v) + b) % mh.PRIME for v in x]


def test_coefficients_and_params():
    assert list(mh.coefficients(4, 42)[0]) == [1784621144001422544, 1011984782196883448, 1979792011353080515, 1608021194655666449]
    assert [mh.lsh_params(t, k) for t, k in ((0.5, 128), (0.6, 128), (0.7, 128), (0.75, 128), (0.8, 128), (0.75, 64))] == [(25, 5), (18, 7), (14, 9), (11, 11), (9, 13), (7, 9)]
    for bad in (0, 1):
        with pytest.raises(ValueError):
            mh.lsh_params(bad, 128)
    with pytest.raises(ValueError):
        mh.checked_params(0.5, 16, 4, None)
    with pytest.raises(ValueError):
        mh.checked_params(0.5, 16, 5, 4)


def test_signatures(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["b", "a"],), ([],), (None,)], "s array<string>")
    sig = [list(r.sig) for r in mh.with_signature(df, "s", num_perm=16).collect()]
    assert sig[0] == sig[1] and sig[2] == sig[3] == [-1] * 16
    a, b = mh.coefficients(16, 42)
    want = [min((x * mh.shingle_hash(s) + y) % mh.PRIME for s in "ab") for x, y in zip(a, b, strict=True)]
    assert sig[0] == want


def test_similarity_raises_on_other_length(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 0, 0], [1])], "a array<long>, b array<long>, c array<long>")
    assert df.select(mh.signature_similarity(F.col("a"), F.col("b")).alias("x")).first().x == 0.5
    with pytest.raises(Exception, match="same, non-zero length"):
        df.select(mh.signature_similarity(F.col("a"), F.col("c"))).collect()


def test_bucket_cap(spark):
    bands = spark.range(10).select("id", F.lit(0).alias("band"), F.lit(7).cast("long").alias("key"))
    assert mh.lsh_candidates(bands, 3).count() == 9 + 8 + 7
    assert mh.lsh_candidates(bands, None).count() == 45
    assert mh.bucket_stats(bands, 3).first().asDict() == {"buckets": 1, "saturated": 1, "largest": 10}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (None, 5), (50, 51), (51, 52)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 50: 50, 51: 50, 52: 50}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


CORPUS = [
    (0, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today!"),
    (2, "an entirely different sentence about trains and stations in the north"),
    (3, "the quick brown fox jumps over the lazy dog near the river bank"),
    (4, ""), (5, None), (6, " ​ "),
]


def test_deduplicate_policies(spark):
    df = spark.createDataFrame(CORPUS, "id long, text string")
    kept = lambda **k: sorted(r.id for r in dedup.deduplicate(df.repartition(3), "id", "text", k=2, **k).where("is_kept").collect())
    assert kept() == [0, 2, 4]
    assert kept(policy="longest") == [1, 2, 6]
    assert kept(policy="shortest") == [2, 3, 4]
    out = dedup.deduplicate(df, "id", "text", k=2)
    assert out.count() == 7 and dedup.deduplicate(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        dedup.deduplicate(df, "id", "text", policy="best")
    with pytest.raises(ValueError):
        dedup.deduplicate(df, "id", "text", threshold=1.0)


def test_jaccard_edges(spark):
    df = spark.createDataFrame(CORPUS, "id long, text string")
    got = [(r.id_a, r.id_b, round(r.similarity, 4)) for r in dedup.jaccard_edges(df, "id", "text", 0.6, 3).collect()]
    assert got == [(0, 3, round(11 / 12, 4))]


def test_queries_have_no_bucket_cap(spark, tmp_path, monkeypatch):
    from tessera.plans import q_text

    words = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(i, f"{words} end{i}") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    real, caps = mh.lsh_candidates, []

    def tight(bands, cap=mh.BUCKET_CAP):
        caps.append(cap)
        return real(bands, None if cap is None else 1)

    monkeypatch.setattr(mh, "lsh_candidates", tight)
    assert q_text.lsh_candidates(spark, str(tmp_path)).count() == 6
    assert q_text.lsh_verified_edges(spark, str(tmp_path)).count() == 6
    assert [r.members for r in q_text.dedup_components(spark, str(tmp_path)).collect()] == [4]
    assert q_text.dedup_first(spark, str(tmp_path)).where("is_kept").count() == 1
    assert caps == [None] * 4
