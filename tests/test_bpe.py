import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import bpe


def by_hand(pieces, size):
    seqs = [(list(p.encode()), n) for p, n in pieces]
    merges = {}
    while len(merges) < size - 256:
        counts = Counter()
        for s, n in seqs:
            for p in zip(s, s[1:]):
                counts[p] += n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        merges[best] = 256 + len(merges)
        seqs = [(bpe._merged(s, {best: merges[best]}), n) for s, n in seqs]
    return merges


def pieces(seed):
    rng = random.Random(seed)
    return [("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 9))), rng.randint(1, 5)) for _ in range(120)]


@pytest.mark.parametrize("seed", range(4))
def test_heap_learns_the_same_merges(seed):
    p = list(dict(pieces(seed)).items())
    assert bpe.learn_merges(p, 300) == by_hand(p, 300)


def test_cluster_learns_the_same_merges(spark):
    p = [(a, n) for a, n in dict(pieces(9)).items() if a]
    df = spark.createDataFrame(p, "piece string, freq long").repartition(3)
    assert bpe.learn_merges_on_cluster(df, 276) == by_hand(p, 276)
    assert bpe.learn_merges_on_cluster(df.limit(0), 300) == {}
    text = spark.createDataFrame([("the cat sat on the mat, the cat ran",), (None,), ("",)], "t string")
    assert bpe.BpeModel.train(text, "t", 262, most_pieces=1).merges == bpe.BpeModel.train(text, "t", 262).merges


def test_specials_are_added_and_checked():
    m = bpe.BpeModel().with_specials({"<a>": 1000}).with_specials({"<b>": 1001})
    assert m.specials == {"<a>": 1000, "<b>": 1001} and m.with_specials({"<a>": 5}).specials["<a>"] == 5
    for bad in ({"": 7}, {"x": -1}, {"x": 1.5}, {"x": 1000}, {"x": 3, "y": 3}, {"x": True}):
        with pytest.raises(ValueError):
            m.with_specials(bad)


def test_long_pieces_without_a_pattern():
    m = bpe.BpeModel(bpe.learn_merges([("the cat sat on the mat " * 20, 1)], 300))
    text = "the mat sat on the cat, ünï"
    assert m.decode_ids(m.encoder("none")(text)) == text and len(m.encoder("none")(text)) < len(text.encode())


def whole_texts(seed):
    rng = random.Random(seed)
    words = ["the cat", "aaaa", "aaa", "baab", "日本", "é", " ", "the mat, "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 12))) + "".join(rng.choice("abcdxyz") for _ in range(rng.randint(0, 4))) for _ in range(80)]
    return [*texts, None, "", "a", "aa", texts[0], "tail"]


@pytest.mark.parametrize(("seed", "size", "most_bytes"), [(1, 256, 10**6), (2, 257, 10**6), (3, 275, 10**6), (4, 275, 0), (5, 700, 10**6)])
def test_whole_texts_learn_and_encode_as_by_hand(spark, seed, size, most_bytes):
    texts = whole_texts(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(3)
    merges = by_hand(list(Counter(t for t in texts if t).items()), size)
    assert list(bpe.learn_merges_of_wholes(df.select("t"), size, most_bytes=most_bytes).items()) == list(merges.items())
    m = bpe.BpeModel(merges)
    ids = {r.i: r.ids for r in df.select("i", m.encode(F.col("t")).alias("ids")).collect()}
    assert ids == {i: None if t is None else m.encode_piece(t) for i, t in enumerate(texts)}
    for specials, allowed in (({"cat": 1000}, "all"), ({"cat": 1000}, "none")):
        special = m.with_specials(specials)
        ids = {r.i: r.ids for r in df.select("i", special.encode(F.col("t"), allowed).alias("ids")).collect()}
        assert ids == {i: None if t is None else special.encoder(allowed)(t) for i, t in enumerate(texts)}


def test_empty_tables_of_whole_texts(spark):
    for rows in ([], [(None,)], [("",), ("a",)]):
        df = spark.createDataFrame(rows, "t string")
        m = bpe.BpeModel.train(df, "t", 300, None)
        assert m.merges == {} and [r[0] for r in df.select(m.encode(F.col("t"))).collect()] == [None if t is None else list(t.encode()) for (t,) in rows]


def test_whole_texts_stay_on_the_cluster_and_segments_are_encoded_once(spark, monkeypatch):
    held, looked_at = [], []
    learn, merged = bpe.learn_merges, bpe._merged
    monkeypatch.setattr(bpe, "learn_merges", lambda pieces, size: held.append(sum(len(p) for p, _ in pieces)) or learn(pieces, size))
    monkeypatch.setattr(bpe, "_merged", lambda ids, merges: looked_at.append(len(ids)) or merged(ids, merges))
    rng = random.Random(7)
    text = "".join(rng.choice(["the cat ", "sat on ", "the mat, ", "xyz "]) for _ in range(4_000))
    m = bpe.BpeModel.train(spark.createDataFrame([(text,), (text[1:],)], "t string"), "t", 270, None)
    assert len(m.merges) == 14 and sum(held) < len(text)
    ids = m.encoder("none")(text)
    assert sum(looked_at) < len(text) and m.decode_ids(ids) == text and ids == m.encode_piece(text)


def test_merges_of_any_order_encode_as_the_loop_over_the_whole_text():
    rng = random.Random(3)
    for _ in range(200):
        merges = {}
        for _ in range(rng.randint(1, 6)):
            merges[rng.choice([*b"abc", 300, 301, 302]), rng.choice([*b"abc", 300, 301, 303])] = rng.choice([300, 301, 302, 303, 98])
        m = bpe.BpeModel(merges)
        text = "".join(rng.choice("abc") for _ in range(30))
        assert m.encoder("none")(text) == m.encode_piece(text)
