from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera import shared
from tessera.operators import dedup
from tessera.operators import minhash as mh
from tessera.operators.pairing import hot_keys, pairs_of_equal_keys


@pytest.mark.parametrize("most", [7, 20_000])
def test_hot_keys_are_split_and_no_pair_is_lost(spark, most):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{i % 11}", -i) for i in range(200)]
    df = spark.createDataFrame(rows, "n int, k string, extra int")
    got = [(r.n_a, r.n_b, r.extra_a) for r in pairs_of_equal_keys(df, "k", "n", ("extra",), most).collect()]
    want = {(a[0], b[0], a[2]) for a, b in combinations(rows, 2) if a[1] is not None and a[1] == b[1]}
    assert len(got) == len(set(got)) and set(got) == want
    hot = hot_keys(df, "k", most)
    assert hot is None if most > 200 else {r.k for r in hot.collect()} >= {"hot"}
    assert pairs_of_equal_keys(df.limit(0), "k", "n").count() == 0


def test_bucket_cap_and_without(spark, monkeypatch):
    monkeypatch.setattr(mh, "MOST_ROWS", 9)
    bands = spark.createDataFrame([(i, 0, 5) for i in range(40)] + [(1, 1, 7), (2, 1, 7), (3, 1, 8)], "id int, band int, key long")
    every = {tuple(r) for r in mh.lsh_candidates(bands).collect()}
    assert every == set(combinations(range(40), 2))
    assert {tuple(r) for r in mh.lsh_candidates(bands, 10).collect()} == {p for p in every if p[0] < 10}


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://far:7077", "app"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Context(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


def test_steps_are_discarded(spark, tmp_path):
    import os

    made = shared.materialize(spark.range(3), "kept")
    path = made._tessera_step.removeprefix("file://")
    assert made.count() == 3 and os.path.exists(path)
    shared.discard(made)
    shared.discard(spark.range(1))
    assert not os.path.exists(path)


def test_jaccard_edges_with_a_common_shingle(spark, monkeypatch):
    from tessera.operators import pairing

    head = "all pages of this site begin with these words and go on"
    rows = [(i, f"{head} {i} {i * 7}" if i < 30 else f"text {i} of its own words number {i // 2} and so on {i // 2} until here it ends for good {i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string")

    def grams(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: grams(t) for i, t in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {(r.id_a, r.id_b) for r in dedup.jaccard_edges(df, "id", "text", 0.7).collect()} == want and want
    monkeypatch.setattr(pairing, "MOST_ROWS", 5)
    assert df.where(F.col("id") < 0).count() == dedup.jaccard_edges(df.limit(0), "id", "text", 0.7).count() == 0


def test_shingles_of_both_kinds_agree(spark):
    from tessera.functions import text as tx

    texts = ["", "one", "one two three", "la niña_2 comió ½ kg à 3,5 €", "слово два три четыре пять шесть", "数据 清洗 和 去重", "a b c d e f g", "x" * 9, "e\u0301t\u00e9 ①②", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for k, mode in ((3, "word"), (5, "word"), (4, "char"), (1, "char")):
        a = {r.i: r.sig for r in mh.with_signature(df.select("i", tx.shingles(F.col("t"), k, mode).alias("s")), "s", num_perm=16).collect()}
        assert a == {r.i: r.sig for r in mh.with_text_signature(df, "t", k, mode, num_perm=16).collect()}
