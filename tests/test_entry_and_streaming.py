import pytest

from tessera import shared
from tessera.plans import catalog
from tessera.streaming import upserts

SMALL = "/root/testdata/sf0.001"


def test_every_core_query_runs_and_has_its_columns(spark):
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("vec_count", "lr_schedule", "token_usage", "exact_dups"):
        assert queries[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_core_query_runs_whole(spark, name):
    out = catalog.queries()[name](spark, SMALL)
    assert len(set(map(str.lower, out.columns))) == len(out.columns)
    out.write.format("noop").mode("overwrite").save()
    shared.clear(spark)


def test_command_line_knows_all_queries(capsys):
    from tessera import cli

    assert cli.main([]) == 0
    assert set(catalog.queries()) <= set(capsys.readouterr().out.split())


def test_flagship(spark):
    out = catalog.flagship(spark, SMALL)
    kept = out.where("is_kept")
    assert out.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert kept.count() == out.select("component").distinct().count() == kept.select("component").distinct().count()


def test_stream_of_upserts(spark, tmp_path):
    src, at = f"{tmp_path}/in", f"file://{tmp_path}/out"
    assert upserts.latest(spark, at) is None
    for rows in ([("a", 1, 1), ("a", 2, 2)], [("b", 5, 1), ("a", 3, 3)]):
        spark.createDataFrame(rows, "id string, n int, seq int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id string, n int, seq int").parquet(src)
        upserts.apply_changes(stream, at, f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, upserts.latest(spark, at).collect())) == [("a", 3), ("b", 5)]


def _batch(spark, tmp_path, rows, at, **kw):
    src = f"{tmp_path}/in"
    spark.createDataFrame(rows, "id string, n int, seq int").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id string, n int, seq int").parquet(src)
    upserts.apply_changes(stream, at, f"{tmp_path}/check", **kw).awaitTermination()


def test_replayed_batches_and_late_changes(spark, tmp_path):
    import os
    import shutil

    at = f"file://{tmp_path}/out"
    _batch(spark, tmp_path, [("a", 1, 5), ("b", 1, 5)], at, merge_every=2)
    _batch(spark, tmp_path, [("a", 2, 3), ("b", 2, 6)], at, merge_every=2)  # an older seq never wins; merges
    assert sorted(map(tuple, upserts.latest(spark, at).collect())) == [("a", 1), ("b", 2)]
    # the batch was written, but its commit was lost: it is replayed
    os.remove(f"{tmp_path}/check/commits/1")
    if os.path.exists(f"{tmp_path}/check/commits/.1.crc"):
        os.remove(f"{tmp_path}/check/commits/.1.crc")
    _batch(spark, tmp_path, [("c", 3, 1)], at, merge_every=2)
    assert sorted(map(tuple, upserts.latest(spark, at).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    for n in range(3):
        _batch(spark, tmp_path, [("c", 4 + n, 2 + n)], at, merge_every=2)
    assert sorted(map(tuple, upserts.latest(spark, at).collect())) == [("a", 1), ("b", 2), ("c", 6)]
    assert "d000000000000" not in os.listdir(f"{tmp_path}/out")
    shutil.rmtree(f"{tmp_path}/out")


def test_a_failed_save_keeps_the_former_collection(spark, tmp_path):
    import pytest

    from tessera.sources import collections as col

    base = f"file://{tmp_path}"
    good = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<double>")
    col.save_collection(good, base, "c", 2)
    for bad in ([("a", [0.0, 0.0])], [("a", [1.0])], [("a", [1.0, 2.0]), ("a", [1.0, 3.0])], [(" ", [1.0, 2.0])]):
        with pytest.raises(ValueError):
            col.save_collection(spark.createDataFrame(bad, good.schema), base, "c", 2)
    rows, meta = col.load_collection(spark, base, "c", 2)
    assert rows.count() == meta["count"] == 1
    col.save_collection(good.union(spark.createDataFrame([("b", [2.0, 1.0])], good.schema)), base, "c", 2, "dot")
    rows, meta = col.load_collection(spark, base, "c")
    assert rows.count() == 2 and meta["metric"] == "dot" and meta["version"] == 2


def test_vectors_are_checked_on_upsert(spark):
    import pytest

    from tessera.operators import vectordb as db

    df = spark.createDataFrame([("a", [1.0, 2.0], "x")], "id string, vector array<double>, m string")
    changes = lambda v: spark.createDataFrame([("b", v, "y", 1)], "id string, vector array<double>, m string, seq int")
    assert db.upsert(df, changes([2.0, 1.0]), dim=2).count() == 2
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [1.0], None):
        with pytest.raises(Exception, match="stored"):
            db.upsert(df, changes(bad), dim=2).collect()
    assert {r.id: r.existed for r in db.deleted(df, spark.createDataFrame([("a",), ("z",), ("a",)], "id string")).collect()} == {"a": True, "z": False}
    assert [r.id for r in db.topk(df, [1.0, 1.0], where=lambda r: r["m"] == "x").collect()] == ["a"] and db.topk(df, [1.0, 1.0], where=lambda r: False).count() == 0
    hits = db.topk_batch(df, spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, query_vector array<double>"), 1, include=("m",)).first()
    assert (hits.id, hits.m) == ("a", "x")


def test_samples_follow_from_their_seed(spark):
    import numpy as np

    from tessera.operators import dedup
    from tessera.sources import samples

    x = np.array([r.vector for r in samples.random_vectors(spark, 400, 16, 3).orderBy("id").collect()])
    again = np.array([r.vector for r in samples.random_vectors(spark, 400, 16, 3).repartition(3).orderBy("id").collect()])
    assert x.shape == (400, 16) and (x == again).all() and abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    corpus = samples.sample_corpus(spark, 50, 1)
    assert corpus.count() == 50 and corpus.select("text").distinct().count() > 20
    with pytest.raises(ValueError, match="exceeds"):
        dedup.deduplicate(corpus, "ord", "text", most_rows=49)
