from pyspark.sql import functions as F

from tessera.llm import cutoff

PROSE = "The patrol searched the warehouse near the river. Nobody found the notebook there"


def shape(text):
    return cutoff.SHAPES[cutoff.shape_of(text)]


def test_shapes():
    assert shape("  ") == "blank"
    assert shape('{"a": [1, {"b": "x"}]}\n') == "closed"
    assert shape('{"a": "Note: \\"{ open\\"."}') == "closed"
    assert shape('{"a": [1, {"b": "x') == "open"
    assert shape('```json\n{"a": 1}\n```') == "closed"
    assert shape('```json\n{"a": 1') == "open"
    assert shape(PROSE + ".") == "ended"
    assert shape(PROSE) == "unended"
    assert shape("a text [truncated]") == "marked"
    assert shape("- one\n- two") == "items"
    assert shape("283") == "short"
    assert shape('{"a": 1}\nAnd then some more pro') == "unended"


def test_cut_records(spark):
    full = [(i, "s", f"The patrol number {i} searched the warehouse near the river with a torch.", "STOP") for i in range(40)]
    rows = [*full, (100, "s", PROSE, "STOP"), (101, None, '{"a": 1', None), (102, "s", "- torch\n- wareh", ""), (103, "s", "- torch\n- warehouse", ""), (104, "s", None, "LENGTH"), (105, "s", "", "LENGTH"), (100, "s", PROSE, "STOP")]
    df = spark.createDataFrame(rows, "id long, s string, text string, reason string")
    tokens = F.when(F.col("id") < 102, F.ceil(F.length("text") / 4)).cast("int")
    got = cutoff.cut_records(df, "s", ["id"], "text", F.col("reason"), tokens)
    cut = {r.id for r in got.where("is_cut").collect()}
    assert got.count() == 44
    assert cut == {100, 101, 102}
    rates = {r.source: (r.records, r.cut) for r in cutoff.cut_rates(got, "source").collect()}
    assert rates == {"s": (43, 2), None: (1, 1)}
    assert cutoff.cut_records(df.limit(0), "s", ["id"], "text", F.col("reason"), tokens).count() == 0


def test_trie(spark):
    words = spark.createDataFrame([("ware", 1), ("warehouse", 3), ("a", 2)], "word string, cnt long")
    nodes = {r.node: r.is_word for r in cutoff.vocabulary_trie(words).collect()}
    assert nodes["wareh"] is False and nodes["warehouse"] is True and nodes["ware"] is False and nodes["a"] is True


def test_parts_of_words_decide_short_answers_and_lists(spark):
    full = [(i, f"The patrol number {i} searched the {'very ' * (i % 4)}old warehouse near the river with a torch.", None) for i in range(40)]
    whole = [(100 + i, "Medio", 2) for i in range(6)] + [(110 + i, "timeout after 30s", 0) for i in range(6)] + [(120, "robo", 1), (121, "robo", 1), (122, "robo", 1), (123, "the robots, the robots", 6), (124, "- torch\n- warehouse", 5)]
    errors = [(130, "gateway at the rive", 0), (131, "timeout after 30s", None)]
    cut = [(200, "Medi", 1), (201, "Medi", None), (202, "- torch\n- wareh", 4), (203, "- torch\n- wareh", None), (204, "near the rive", 4)]
    df = spark.createDataFrame([(i, "s", t, n) for i, t, n in full + whole + errors + cut], "id long, s string, text string, n int")
    tokens = F.when(F.col("id") < 100, F.ceil(F.length("text") / 4)).otherwise(F.col("n"))
    got = cutoff.cut_records(df, "s", ["id"], "text", F.lit("STOP"), tokens)
    assert {r.id for r in got.where("is_cut").collect()} == {i for i, _, _ in cut}


def test_the_trie_judges_the_other_evidence(spark):
    said = [(i, f"The patrol number {i} searched the warehouse near the river with a torch", "LENGTH") for i in range(60)]
    whole = [(1000 + i, f"The keeper number {i} closed the warehouse near the river with a torch.", "STOP") for i in range(60)]
    df = spark.createDataFrame(said + whole, "id long, text string, reason string").withColumn("s", F.lit("s"))
    run = lambda d: cutoff.cut_records(d, "s", ["id"], "text", F.col("reason"), F.lit(None))
    assert run(df).where("is_cut").isEmpty()  # a source that always says so and never ends inside a word: refuted
    cut = df.withColumn("text", F.when(F.col("id") % 3 == 0, F.regexp_replace("text", "orch$", "o")).otherwise(F.col("text")))
    found = run(cut).where("is_cut")
    assert {r.id for r in found.collect()} == set(range(60))
    assert {r.evidence for r in found.collect()} == {"part", "reason"}
    assert sum(r.cut for r in cutoff.cut_evidence(run(cut)).collect()) == 60


def test_deep_nesting_and_long_words(spark):
    assert shape("[" * 100_000) == "open"
    long = "z" * 60
    words = spark.createDataFrame([(long + "abc", 2), (long + "q", 1)], "word string, cnt long")
    ends = spark.createDataFrame([(long + "a", 1), (long + "b", 1), (long + "abc", 1)], "last string, ends long")
    assert [r.last for r in cutoff.word_parts(words, ends).collect()] == [long + "a"]
