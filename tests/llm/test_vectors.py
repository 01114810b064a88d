import threading
from pathlib import Path

import numpy as np

from tessera.llm import similar


def data(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        center = rng.normal(size=64)
        for _ in range(25):
            rows.append(center + 0.45 * rng.normal(size=64))
    rows += list(rng.normal(size=(100, 64)))
    return [(f"v{i:04d}", x.astype(np.float32)) for i, x in enumerate(rows)]


def frame(spark, rows):
    made = [(i, n, [float(a) for a in x]) for i, (n, x) in enumerate(rows)]
    n = len(made)
    made += [(n, "v0000", [0.0] * 64), (n + 1, "bad", None), (n + 2, "bad", []), (n + 3, "bad", [float("nan")] * 64), (n + 4, "bad", [1.0] * 63), (n + 5, None, [1.0] * 64), (n + 6, "v0001", made[1][2])]
    return spark.createDataFrame(made, "seq long, id string, vector array<float>")


def truth(rows):
    x = np.stack([r[1] for r in rows]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return s


def test_nearest_pairs_and_clusters(spark):
    rows = data()
    s = truth(rows)
    ids = [r[0] for r in rows]
    want = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i])[:10]:
            if s[i, j] >= 0.8:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    vectors = similar.usable_vectors(frame(spark, rows))
    assert vectors.count() == len(rows)
    got = {tuple(r) for r in similar.nearest_pairs(vectors).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)

    label = list(range(len(ids)))
    while True:
        new = [min([label[i], *[label[j] for j in np.flatnonzero(s[i] >= 0.8)]]) for i in range(len(ids))]
        if new == label:
            break
        label = new
    expected = {ids[i]: ids[label[i]] for i in range(len(ids)) if (s[i] >= 0.8).any()}
    clusters = similar.similarity_clusters(vectors)
    assert {r.id: r.cluster_id for r in clusters.collect()} == expected
    about = spark.createDataFrame([(0, i, "m" + i) for i in ids], "seq long, id string, metadata string")
    top = similar.describe_clusters(clusters, about).collect()
    assert all(r["rank"] <= 3 and r.metadata == "m" + r.id for r in top)


def test_recall_of_all_neighbours(spark):
    rows = data(1)
    s = truth(rows)
    near = similar.nearest(similar.usable_vectors(frame(spark, rows)), tables=similar.Tables(24, 1, 3))
    got = {}
    for r in near.collect():
        got.setdefault(r.id, set()).add(r.other)
    ids = [r[0] for r in rows]
    hit = sum(len(got.get(ids[i], set()) & {ids[j] for j in np.argsort(-s[i])[:10]}) for i in range(len(ids)))
    assert hit >= 0.9 * 10 * len(ids)


def test_copies_split_cells_and_empty(spark, monkeypatch):
    monkeypatch.setattr(similar, "BUCKET_ROWS", 8)
    one = [float(i % 5) - 1.5 for i in range(64)]
    df = spark.createDataFrame([(i, f"c{i:02d}", one) for i in range(30)], "seq long, id string, vector array<float>")
    vectors = similar.usable_vectors(df)
    near = similar.nearest(vectors, 3, 0.8)
    got = {}
    for r in near.collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    assert [o for _, o in sorted(got["c00"])] == ["c01", "c02", "c03"] and [o for _, o in sorted(got["c29"])] == ["c00", "c01", "c02"]
    assert {r.cluster_id for r in similar.similarity_clusters(vectors).collect()} == {"c00"}
    assert similar.nearest(similar.usable_vectors(df.limit(0))).count() == 0
    assert similar.similarity_clusters(similar.usable_vectors(df.limit(0))).count() == 0


def test_split_buckets_give_the_same(spark, monkeypatch):
    vectors = similar.usable_vectors(frame(spark, data(2)))
    t = similar.Tables(8, 1)
    whole = {tuple(r) for r in similar.nearest(vectors, 5, tables=t).collect()}
    clusters = {tuple(r) for r in similar.similarity_clusters(vectors).select("id", "cluster_id", "density").collect()}
    monkeypatch.setattr(similar, "PACK_ROWS", 20)
    for most in (60, 400):
        monkeypatch.setattr(similar, "BUCKET_ROWS", most)
        assert {tuple(r) for r in similar.nearest(vectors, 5, tables=t).collect()} == whole
        assert {tuple(r) for r in similar.similarity_clusters(vectors).select("id", "cluster_id", "density").collect()} == clusters


def test_many_copies_and_near_copies_keep_the_exact_ten(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64).astype(np.float32)
    rows = [(f"c{i:03d}", base) for i in range(40)]
    for i in range(40):  # closer to each other than a product in single precision can tell
        near = base.copy()
        near[i] = np.nextafter(near[i], np.float32(9))
        rows.append((f"n{i:03d}", near * np.float32(1 + i % 3)))
    rows += [(f"r{i:03d}", rng.normal(size=64).astype(np.float32)) for i in range(20)]
    order = rng.permutation(len(rows))
    vectors = similar.usable_vectors(spark.createDataFrame([(int(i), rows[i][0], [float(a) for a in rows[i][1]]) for i in order], "seq long, id string, vector array<float>"))
    unit = similar._unit(np.stack([v for _, v in rows]))
    ids = [n for n, _ in rows]
    want = {}
    for i in range(80):
        cos = np.clip((unit[i] * unit).sum(axis=1), -1.0, 1.0)
        want[ids[i]] = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-cos[j], ids[j])) if j != i][:10]
    for least in (0.8, None):
        got = {}
        for r in similar.nearest(vectors, 10, least).collect():
            got.setdefault(r.id, []).append((r["rank"], r.other))
        assert {i: [o for _, o in sorted(got[i])] for i in want} == want
        assert all([p for p, _ in sorted(g)] == list(range(1, len(g) + 1)) for g in got.values())


def test_clusters_hold_the_shuffle_of_one_round(spark, monkeypatch):
    monkeypatch.setattr(similar, "ROUND_BYTES", 0, raising=False)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(3000, 64)), 2, axis=0) + 0.2 * rng.normal(size=(6000, 64))
    vectors = similar.usable_vectors(spark.createDataFrame([(i, f"v{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)], "seq long, id string, vector array<float>"))
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())

    def held():
        total = 0
        for f in (f for folder in folders for f in Path(folder).rglob("shuffle_*")):
            try:
                total += f.stat().st_size
            except FileNotFoundError:
                pass
        return total

    spark.sparkContext._jvm.System.gc()
    floor, most, over = held(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            most[0] = max(most[0], held() - floor)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = {r.id: r.cluster_id for r in similar.similarity_clusters(vectors).collect()}
    finally:
        over.set()
        watcher.join()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.flatnonzero((unit[0::2] * unit[1::2]).sum(axis=1) >= 0.8)
    assert len(near) > 2900 and all(found[f"v{2 * i + 1:04d}"] == found[f"v{2 * i:04d}"] for i in near)
    assert most[0] < 4 * len(x) * 64 * 4


def test_rounds_give_the_same_clusters(spark, monkeypatch):
    vectors = similar.usable_vectors(frame(spark, data(3)))
    for t in (similar.Tables(3, 1), similar.Tables(2, 2)):
        got = {}
        for share, bucket in ((1e9, 200_000), (5.2, 200_000), (2.5, 200_000), (0.9, 60)):
            monkeypatch.setattr(similar, "ROUND_BYTES", 0)
            monkeypatch.setattr(similar, "ROUND_SHARE", share)
            monkeypatch.setattr(similar, "BUCKET_ROWS", bucket)
            rounds = similar.rounds_for(400, t, 64, 4)
            peaks, links = similar.density_peaks(vectors, tables=t)
            group = {}
            for a, b in [*links.collect(), *peaks.where("parent IS NOT NULL").select("id", "parent").collect()]:
                both = group.get(a, {a}) | group.get(b, {b})
                group.update(dict.fromkeys(both, both))
            got[rounds.tables, rounds.parts] = {tuple(r) for r in peaks.select("id", "density").collect()}, {frozenset(m) for m in group.values()}
        assert len(got) >= 3 and all(g == got[t.count, 1] for g in got.values())


def test_rounds_cover_every_cell_once_within_their_bytes():
    for rows, dim, t in ((10**5, 64, similar.Tables(10, 1)), (10**6, 64, similar.Tables(10, 1)), (15 * 10**6, 64, similar.Tables(21, 2)), (75 * 10**6, 64, similar.Tables(21, 2)), (10**6, 100, similar.Tables(7, 1))):
        r = similar.rounds_for(rows, t, dim, 6)
        near = similar.axes(similar._unit(np.random.default_rng(0).normal(size=(2000, dim))).astype(np.float32), t)
        bucket = r.bucket(similar.cells(near, t, dim), t)
        number = bucket // r.buckets
        assert (number >= 0).all() and (number < r.count(t)).all()
        for n in range(r.count(t)):
            first, end = r.tables_of(n, t)
            table = np.nonzero(number == n)[1]
            assert ((first <= table) & (table < end)).all()
            row = np.repeat(np.arange(2000), t.count * t.looks)
            sent = len(np.unique(bucket.reshape(-1).astype(np.int64)[number.reshape(-1) == n] * 2000 + row[number.reshape(-1) == n]))
            each = dim * 4 + near[0].nbytes + 24
            assert sent / 2000 * rows * each <= 1.15 * max(similar.ROUND_BYTES, similar.ROUND_SHARE * rows * dim * 4)
        assert rows < 15 * 10**6 or len(np.unique(bucket[0].reshape(t.count, -1)[0])) < t.looks or r.split > 1  # sent for first axes
        assert sorted({k for n in range(r.count(t)) for k in range(*r.tables_of(n, t))}) == list(range(t.count))
