import bisect

import numpy as np
import pytest

from tessera.llm import binpack, encode

HARD = ["", None, " ", "  ", "a  b", " a", "a ", "\n\n a", "a\n b \n c", "aaaaaaa aaaa", "<|endoftext|> x", "it's I'll '", "\x1c a\x1cb", "日本語 テスト  x", "é ½ Ⅳ ①", "\0 a\0b", "ab" * 2000, "　a 　b", "👩‍👩‍👧 ok"]


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    want = [x.ids for x in t.encode_batch([x or "" for x in HARD], add_special_tokens=False)]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(HARD)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encode.encode(df).collect()}
    assert [got[i] for i in range(len(HARD))] == want
    counts = {r.doc_id: r.ids for r in encode.encode(df, count_only=True).collect()}
    assert [counts[i] for i in range(len(HARD))] == [len(x) for x in want]
    assert encode.encode(df.limit(0)).count() == 0


def test_store_can_be_emptied(monkeypatch):
    table = encode.load_merges()
    texts = [f"one{i} two three{i}" for i in range(50)]
    a = encode.Encoder(table)
    monkeypatch.setattr(encode, "KEPT_PIECES", 5)
    b = encode.Encoder(table)
    whole = a.encode(texts)[0].tolist()
    assert sum((b.encode([t])[0].tolist() for t in texts), []) == whole


def best_fit(sizes, capacity):
    """Containers that best fit needs, the largest items first."""
    free = []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(free, s)
        bisect.insort(free, (free.pop(i) if i < len(free) else capacity) - s)
    return len(free)


def test_packing(spark):
    rng = np.random.default_rng(0)
    sizes = [*np.minimum(5000, rng.lognormal(5, 1.2, 3000)).astype(int).tolist(), 0, 0, None, -3, *[700] * 1500]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)], "k long, n int, size int")
    rows = binpack.pack(df, "k", "n", 2048).collect()
    used, places, whole = {}, set(), {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r["size"]
        places.add((r.container, r.place))
        whole[r.k] = whole.get(r.k, 0) + r["size"]
    assert len(places) == len(rows) and max(used.values()) <= 2048
    assert whole == {i: max(0, n or 0) for i, n in enumerate(sizes)}
    assert all(r.part == 0 for r in rows if max(0, sizes[r.k] or 0) <= 2048)
    assert len(used) <= 1.01 * best_fit([r['size'] for r in rows], 2048)
    assert binpack.pack(df.limit(0), "k", "n").count() == 0
    with pytest.raises(ValueError):
        binpack.pack(df, "k", "n", 0)


def test_linear_program_bound():
    demand, weights = np.array([30.0, 20.0, 25.0]), np.array([3, 5, 7])
    patterns, bound = binpack.configuration_lp(demand, weights, 10)
    cover = sum(a * x for a, x in patterns)
    assert (cover >= demand - 1e-6).all()
    assert bound <= sum(x for _, x in patterns) <= 1.1 * bound
