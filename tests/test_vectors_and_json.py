import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import jsonx
from tessera.functions import vectors as vx
from tessera.operators import bpe, heal, nested
from tessera.operators import vectordb as db
from tessera.sources import collections as col


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i:03d}", rng.normal(size=8).tolist(), i % 3) for i in range(150)]
    return rows, spark.createDataFrame(rows, "id string, vector array<double>, label int").repartition(4)


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_topk_is_exact(spark, store, metric):
    rows, df = store
    x = np.array([r[1] for r in rows])
    q = x[7] + 0.1
    s = {"cosine": x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), "l2": -np.linalg.norm(x - q, axis=1), "dot": x @ q}[metric]
    want = [rows[i][0] for i in np.argsort(-s)[:10]]
    assert [r.id for r in db.topk(df, q.tolist(), 10, metric).orderBy("rank").collect()] == want
    queries = spark.createDataFrame([(1, q.tolist()), (2, None)], "query_id int, query_vector array<double>")
    batch = db.topk_batch(df, queries, 10, metric).orderBy("rank").collect()
    assert [r.id for r in batch] == want and np.allclose([abs(r.score) for r in batch], np.abs(np.sort(-s)[:10]))


def test_blocks_of_queries(spark, store, monkeypatch):
    _, df = store
    queries = df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    whole = {tuple(r) for r in db.topk_batch(df, queries, 3).drop("score").collect()}
    monkeypatch.setattr(db, "QUERY_BLOCK_BYTES", 3000)
    assert {tuple(r) for r in db.topk_batch(df, queries, 3).drop("score").collect()} == whole
    assert db.topk_batch(df, queries.limit(0), 3).count() == 0


def test_filter_and_checks(spark, store):
    _, df = store
    got = db.topk(df, [1.0] * 8, 5, where=F.col("label") == 1, include_vector=True)
    assert {r.label for r in got.collect()} == {1} and "vector" in got.columns
    for bad in (True, 0, 1.5):
        with pytest.raises(ValueError):
            db.topk(df, [1.0] * 8, bad)
    with pytest.raises(ValueError):
        db.topk(df, [0.0] * 8)
    with pytest.raises(ValueError):
        vx.metric_of("hamming")


def test_reject_reasons(spark):
    rows = [(None,), ([],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), ([0.0, 0.0],), ([3.0, 4.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [r.x for r in df.select(vx.reject_reason(F.col("v"), 2).alias("x")).collect()] == ["null", "empty", "wrong_dim", "not_finite", "not_finite", "not_finite", "zero_norm", None]


def test_upsert_delete_get(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    changes = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, n int, seq int")
    after = db.upsert(df, changes)
    assert sorted(map(tuple, after.collect())) == [("a", 1), ("b", 4), ("c", 5)]
    assert [r.id for r in db.delete(after, changes).collect()] == ["a"]
    assert sorted(r.id for r in db.get(after, changes).collect()) == ["b", "c"]
    with pytest.raises(Exception, match="blank"):
        db.upsert(df, spark.createDataFrame([(" ", 3, 1)], "id string, n int, seq int")).collect()
    with pytest.raises(ValueError):
        db.within_capacity(df, 1)


def test_collections(spark, store, tmp_path):
    _, df = store
    base = f"file://{tmp_path}"
    col.save_collection(df, base, "mine", 8, "L2")
    rows, meta = col.load_collection(spark, base, "mine", 8)
    assert rows.count() == meta["count"] == 150 and meta["metric"] == "euclidean"
    for name in ("../x", "a b", ""):
        with pytest.raises(ValueError):
            col.place(base, name)
    with pytest.raises(ValueError):
        col.load_collection(spark, base, "mine", 9)
    with pytest.raises(FileNotFoundError):
        col.load_collection(spark, base, "none")
    with pytest.raises(ValueError):
        col.save_collection(df, base, "bad", 7)


@pytest.mark.parametrize(
    ("text", "want", "how"),
    [
        ('{"a": 1}', {"a": 1}, "balanced"), ("[1, 2]", [1, 2], "balanced"), ('x ```json\n{"a": 1}\n``` y', {"a": 1}, "fence"), ('say {"a": "}"} end', {"a": "}"}, "balanced"),
        ('{"a": [1, 2,], }', {"a": [1, 2]}, "repair"), ("{'a': 1}", {"a": 1}, "repair"), ("none", None, None), ("", None, None), (None, None, None), ("3", None, None),
        ('{bad} then [1]', [1], "balanced"), ("{}", {}, "balanced"), ('{"a": "\\"}"}', {"a": '"}'}, "balanced"),
    ],
)
def test_extract(text, want, how):
    assert jsonx.extract(text) == (want, how)


class Client:
    supports_structured_output = True

    def __init__(self, answers):
        self.answers, self.closed = list(answers), False

    def complete(self, messages):
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return {"text": answer, "finish_reason": "STOP", "prompt_tokens": 2, "completion_tokens": 3}

    def complete_structured(self, messages, schema):
        return self.complete(messages)

    def close(self):
        self.closed = True


def model():
    from pydantic import create_model

    return create_model("User", name=(str, ...), age=(int, ...))


def test_healing():
    good, bad = '{"name": "x", "age": 3}', '{"name": "x"}'
    run = lambda *a, **k: heal.run_one("who?", model(), Client(a), **k)
    assert run(good)["attempts"] == 1
    healed = run(bad, good)
    assert healed["success"] and healed["attempts"] == 2 and healed["total_tokens"] == {"prompt_tokens": 4, "completion_tokens": 6}
    repeated = run(bad, bad, good)
    assert not repeated["success"] and repeated["error"].startswith(heal.REPEATED)
    failed = run(*[RuntimeError("key=abc")] * 3)
    assert failed["error"] is None and failed["history"][0]["raw_response"] == "key=[REDACTED]" and failed["attempts"] == 3
    assert heal.run_one("  ", model(), Client([]))["error"] == heal.EMPTY_PROMPT
    cut = Client([good])
    cut.complete = lambda m: {"text": "{", "finish_reason": "length"}
    cut.supports_structured_output = False
    assert heal.run_one("x", model(), cut)["error"] == heal.TRUNCATED_ADVICE


def test_retry():
    class R:
        def __init__(self, status, after=None):
            self.status, self.headers = status, {"Retry-After": after} if after else {}

    waits, answers = [], [R(429, "2"), R(503), R(200)]
    assert heal.with_retry(lambda: answers.pop(0), sleep=waits.append).status == 200
    assert 2 <= waits[0] <= 2.2 and 2 <= waits[1] <= 2.2
    assert heal.with_retry(lambda: R(404)).status == 404
    assert heal.wait_seconds("999", 1) == 60 and heal.wait_seconds(None, -1) == 0 and heal.wait_seconds("junk", 4) == 4


def test_bpe(spark, tmp_path):
    df = spark.createDataFrame([("the cat sat on the mat, the cat ran",), (None,), ("",)], "t string")
    m = bpe.BpeModel.train(df, "t", 270, None).with_specials({"<|end|>": 999})
    assert bpe.learn_merges([("aaaa", 1)], 258) == {(97, 97): 256, (256, 256): 257}
    for text in ["the cat", "ünï 日本 👩‍👩‍👧", "", " \n\t", "é é"]:
        assert m.decode_ids(m.encoder("none")(text)) == text
    assert m.encoder("all")("a<|end|>b") == [97, 999, 98]
    with pytest.raises(ValueError):
        m.encoder()("a<|end|>")
    with pytest.raises(ValueError):
        m.decode_ids([5000])
    assert m.decode_ids([0xC3]) == "�"
    m.save(str(tmp_path / "m"))
    again = bpe.BpeModel.load(str(tmp_path / "m"))
    assert again.merges == m.merges and again.specials == m.specials
    for bad in ("", "other v1\n", "bpe_tokenizer v1\npattern \"\"\nspecial_tokens_count 0\nmerges_count 3\n97 98 256\n"):
        with pytest.raises(ValueError):
            bpe.BpeModel.loads(bad)
    ids = spark.createDataFrame([([1, 1, 1],), ([1, 2, 3, 1, 2],), ([],), (None,)], "ids array<int>")
    assert [r.x for r in ids.select(bpe.merge_pair(F.col("ids"), 1, 1, 99).alias("x")).collect()][:3] == [[99, 1], [1, 2, 3, 1, 2], []]
    assert {(r.p0, r.p1): r.cnt for r in bpe.pair_stats(ids, "ids").collect()} == {(1, 1): 2, (1, 2): 2, (2, 3): 1, (3, 1): 1}


def test_nested_tables(spark):
    payloads = [
        (1, {"suspects": [{"n": 1}, None, {"n": 2}], "evidences": {"item": "x"}}), (2, [{"suspects": {"0": {"n": 1}, "10": {"n": 2}}}]), (3, {"data": json.dumps({"suspects": [{"n": 3}], "evidences": []})}),
        (4, {"meta": {"v": 1}, "report": {"suspects": json.dumps([{"n": 4}]), "evidences": None}}), (5, {}), (6, None), (7, {"payload": {"content": {"incident": {"evidences": [{"item": "y", "tags": [{"t": 1}]}]}}}}),
    ]
    reports = spark.createDataFrame([(i, None if p is None else json.dumps(p)) for i, p in payloads] + [(8, '{"suspects": ['), (9, ""), (1, json.dumps(payloads[0][1]))], "report_id long, payload string")
    results = spark.createDataFrame(
        [(1, ([("a",), None, ("b",)], None), [(1, "x")]), (2, None, None), (1, ([("a",), None, ("b",)], None), [(1, "x")])],
        "result_id long, data struct<suspects: array<struct<n: string>>, evidences: array<struct<item: string>>>, history array<struct<attempt_number: int, raw_response: string>>",
    )
    got = {tuple(r) for r in nested.case_children(reports, results).collect()}
    assert got == {
        ("report", 1, "suspect", 0), ("report", 1, "suspect", 2), ("report", 1, "evidence", 0), ("report", 2, "suspect", 0), ("report", 2, "suspect", 10), ("report", 3, "suspect", 0), ("report", 4, "suspect", 0),
        ("report", 7, "evidence", 0), ("result", 1, "suspect", 0), ("result", 1, "suspect", 2), ("result", 1, "attempt", 0),
    }
    assert nested.case_children(reports.limit(0), results).count() == 3
    tables = nested.flatten(spark.createDataFrame([(1, [([("z", [1, 2])], "a")])], "id long, l array<struct<m: array<struct<id: string, s: array<int>>>, id: string>>"), "id")
    assert [tuple(r) for r in tables["l.m"].collect()] == [(1, 0, 0, "z")] and [tuple(r) for r in tables["l.m.s"].collect()] == [(1, 0, 0, 0, 1), (1, 0, 0, 1, 2)]


def test_nested_tables_at_every_level(spark):
    cars = [{"tag": "A1", "parts": [{"n": 1, "sizes": [2, 3]}]}, None, {"tag": 7}]
    payloads = [
        (1, {"reports": [{"suspects": [{"n": "x", "vehicles": cars}]}, {"suspects": [None, {"n": "y", "notes": "tall"}]}]}),
        (2, [{"risk": 1, "suspects": [{"n": "a"}]}, {"risk": 2, "suspects": [{"n": "b", "notes": ["p", "q"], "at": {"x": 1.5}}]}]),
        (3, {"suspects": [{"vehicles": {"tag": "B2"}}, {"vehicles": [{"tag": "C3"}]}]}),
    ]
    reports = spark.createDataFrame([(i, json.dumps(p)) for i, p in payloads], "report_id long, payload string")
    results = spark.createDataFrame([(1, ([("z",)],), [(1, "x")])], "result_id long, data struct<suspects: array<struct<n: string>>>, history array<struct<attempt_number: int, raw_response: string>>")
    found = {tuple(r) for r in nested.case_children(reports, results).where("parent = 'report'").collect()}
    assert found == {("report", 1, "suspect", 0), ("report", 1, "suspect", 1), ("report", 2, "suspect", 0), ("report", 3, "suspect", 0), ("report", 3, "suspect", 1)}
    got = {path: {(r.parent_id, *r.places): {k: v for k, v in r.asDict().items() if k not in ("parent_id", "places") and v is not None} for r in one.collect()} for path, one in nested.json_tables(reports, "report_id", "payload").items()}
    assert got[()] == {(1, 0): {}, (2, 0): {"risk": 1}, (2, 1): {"risk": 2}, (3, 0): {}}
    assert got["reports", "suspects"] == {(1, 0, 0, 0): {"n": "x"}, (1, 0, 1, 1): {"n": "y", "notes": "tall"}}
    assert got["reports", "suspects", "vehicles"] == {(1, 0, 0, 0, 0): {"tag": "A1"}, (1, 0, 0, 0, 2): {"tag": "7"}}
    assert got["reports", "suspects", "vehicles", "parts"] == {(1, 0, 0, 0, 0, 0): {"n": 1}}
    assert got["reports", "suspects", "vehicles", "parts", "sizes"] == {(1, 0, 0, 0, 0, 0, 0): {"value": 2}, (1, 0, 0, 0, 0, 0, 1): {"value": 3}}
    assert {k: float(v["at__x"]) for k, v in got["suspects",].items() if "at__x" in v} == {(2, 1, 0): 1.5}
    assert got["suspects", "notes"] == {(2, 1, 0, 0): {"value": "p"}, (2, 1, 0, 1): {"value": "q"}}
    assert got["suspects", "vehicles"] == {(3, 0, 0, 0): {"tag": "B2"}, (3, 0, 1, 0): {"tag": "C3"}}
    one = nested.case_tables(reports, results)
    assert {(r.parent, r.list, r.n) for r in one.where("n IS NOT NULL AND list LIKE '%suspects'").collect()} >= {("report", "suspects", "b"), ("result", "data__suspects", "z")}
    assert one.count() == sum(map(len, got.values())) + 3
