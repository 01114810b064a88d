import pytest

from tessera.llm import neardup, textform

WIDE = "ｃａｆｅ ﬁne"
ROWS = [
    (1, "café fine  text"), (2, "café ﬁne text"), (3, "cаfé fine te​xt "), (4, "Café fine text"), (5, "cafe fine text"), (6, None), (7, ""), (8, "​ 　"),
    (9, "café fine  text"), (10, "x² + ①"), (11, "x2 + 1"), (12, "Точный словарь"), (13, "Точный словарь"), (14, "​"), (15, "ＡＢ＋ｃ"), (16, "AB+c"),
]


def test_same_reading(spark):
    df = spark.createDataFrame(ROWS, "ord long, text string")
    got = {tuple(r) for r in textform.same_reading_pairs(df.union(df.where("ord = 2"))).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 9), (3, 9), (12, 13), (15, 16)}


def test_every_listed_look_alike_comes_out_as_listed(spark):
    listed = [(a, b) for one, other in textform.LOOK_ALIKES.items() for a, b in zip(one, other, strict=True)]
    df = spark.createDataFrame([(i, f"x{a}y", f"x{b}y") for i, (a, b) in enumerate(listed)], "i int, text string, want string")
    assert [(r.text, r.form) for r in textform.with_form(df).collect() if r.form != r.want] == []


def test_groups_of_one_reading(spark):
    df = spark.createDataFrame(ROWS, "ord long, text string")
    got = {r.ord: (r.class_id, r.writings, r.links) for r in textform.same_reading_groups(df.union(df.where("ord = 2"))).collect()}
    assert got[1] == got[9] == (1, 3, 2) and got[2] == got[3] == (1, 3, 3) and got[12] == (12, 2, 1) and got[4] == (4, 1, 0)
    assert set(got) == {o for o, t in ROWS if o not in (6, 7, 8, 14)}


def test_hot_writings_are_split(spark, monkeypatch):
    from tessera.operators import pairing

    rows = [(i, ["same text", "ｓame text", "same  text", "other"][i % 4]) for i in range(60)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and "other" not in (x, y)}
    for most in (4, 20_000):
        monkeypatch.setattr(textform, "hot_keys", lambda df, key, most=most: pairing.hot_keys(df, key, most))
        monkeypatch.setattr(textform, "pairs_of_equal_keys", lambda df, key, id, most=most: pairing.pairs_of_equal_keys(df, key, id, (), most))
        got = [tuple(r) for r in textform.same_reading_pairs(spark.createDataFrame(rows, "ord long, text string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_form_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(None, "a  b", "x"), (2, None, "y"), (3, " ", "z")], "i long, text string, form string")
    got = textform.with_form(df)
    assert got.columns == ["i", "text", "form"]
    assert [r.form for r in got.collect()] == ["a b", None, ""]
    assert textform.with_form(df.limit(0)).count() == 0
    long = spark.createDataFrame([("é ﬁ " * 50_000,)], "text string")
    assert len(textform.with_form(long).first().form) == 50_000 * 5 - 1


def brute(rows, threshold, k):
    sets = {}
    for o, t in rows:
        w = t.lower().split()
        sets[o] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def corpus():
    import random

    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(60)]
        rows.append((len(rows), " ".join(base)))
        for edits in (0, 1, 3, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(o, t, 1) for o, t in rows], "ord long, text string, rep int").repartition(5)
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, threshold=0.6, k=3).collect()}
    want = brute(rows, 0.6, 3)
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_near_duplicate_groups_and_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, None), (4, " "), (5, "!!"), (6, "!!"), (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z z")], "ord long, text string")
    got = {r.ord: (r.class_id, r.links, r.group_id) for r in neardup.near_duplicate_groups(df).collect()}
    assert got == {1: (1, 0, 1), 2: (1, 0, 1), 5: (5, 0, 5), 6: (5, 0, 5), 7: (7, 1, 7), 8: (8, 1, 7)}
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicate_pairs(df, blocks=100, rows=4)
