import random

from tessera.llm import spam

GOOD = "The team at Trahur restored the archive after the storm. Nobody expected that the old index would survive {}. At noon the patrol searched the harbour, and {} people signed the report."


def pages():
    rng = random.Random(1)
    goods = ["lamp", "sofa", "garden hose", "watch", "drill"]
    rows = []
    for i in range(120):
        rows.append((i, GOOD.format(rng.randint(2, 99), rng.randint(2, 99)) * 2, f"host{i % 7}"))
    for i in range(120, 160):
        g = rng.choice(goods)
        rows.append((i, rng.choice([" | ", ", ", "\n"]).join(f"{rng.choice(['cheap', 'best', 'buy'])} {g}" for _ in range(40)), "bad"))
    for i in range(160, 180):
        rows.append((i, "\n".join(f"- https://x{rng.randint(1, 999)}.test/item?id={rng.randint(1, 99)}" for _ in range(20)), None))
    return rows


def test_spam_is_found(spark):
    df = spark.createDataFrame([*pages(), (900, None, "h"), (901, "  ", "h"), (902, "", None), (0, pages()[0][1], "host0")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, None), (130, 1), (131, 0), (165, 1), (999, 1)], "doc_id long, is_spam int")
    out = spam.spam_scores(df, labels)
    assert out.count() == 180
    assert {r.doc_id for r in out.where("is_spam").collect()} == set(range(120, 180))
    assert spam.spam_scores(df, labels.limit(0)).where("is_spam").count() == 60
    assert spam.spam_scores(df.limit(0), labels).count() == 0


def test_features_are_defined():
    for text in ("", " ", "!", "x", "#a #b", "語" * 500, "word " * 20_000):
        values = spam.page_features(text)
        assert len(values) == len(spam.FEATURES) and all(v == v for v in values)


def test_no_labeller_decides_alone():
    import numpy as np

    votes = np.array([[1, 1, 1, 1, 1, 1], [-1, -1, -1, -1, -1, -1], [1, -1, -1, -1, -1, -1], [-1, -1, -1, -1, 1, -1]])
    base, weights = spam.label_model(votes, np.array([50.0, 900.0, 3.0, 3.0]))
    odds = [base + sum(weights[j][v + 1] for j, v in enumerate(row)) for row in votes]
    assert odds[0] > 0 and max(odds[1:]) < 0
    assert spam.label_model(np.zeros((0, 6), int), np.zeros(0))[0] == 0.0


def test_sample_is_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(spam, "ORDINARY_ROWS", 200)
    known = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(None).cast("double").alias("rating"), F.when(F.col("id") < 50, 0.9).otherwise(0.1).alias("label"), *[F.lit(1.0).alias(f) for f in spam.FEATURES])
    x, y = spam.training_rows(known.withColumn("rating", F.when(F.col("doc_id") == 7, 0.0)))
    assert (y > 0.5).sum() == 49 and 120 < (y < 0.5).sum() < 290 and x.shape[1] == len(spam.FEATURES) and (y == 0).sum() == 1


def test_hosts_move_doubtful_pages_only_if_they_differ(spark):
    rows = [(i, f"h{i % 10}", 1.0 if i % 10 < 2 else 0.0) for i in range(400)]
    rates = spam.host_rates(spark.createDataFrame(rows, "doc_id long, host string, score double")).collect()
    assert rates[0].strength < 5 and {r.host: r.spam for r in rates}["h0"] == 40
    even = [(i, f"h{i % 10}", 1.0 if i // 10 % 5 == 0 else 0.0) for i in range(400)]
    assert spam.host_rates(spark.createDataFrame(even, "doc_id long, host string, score double")).first().strength == 1e9
    assert spam.host_rates(spark.createDataFrame([], "doc_id long, host string, score double")).count() == 0
