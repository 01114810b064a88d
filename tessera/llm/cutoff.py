"""Texts that end before their content does (problem 4).

A trie over the words of all texts, kept as a table of its nodes, tells whether a text's last token is
an unknown proper prefix of known words. Such an end is a cut. It also judges all other evidence: more
tokens than the length explains, lengths that pile up at a limit of their source, a finish reason, an
open structure, an end in the open. A kind of evidence counts only if texts that carry it end in parts
of words far more often than texts that carry none; then it finds the cuts between words, too.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.shared import broadcast_small, materialize

# What a text's end looks like.
BLANK, SHORT, ENDED, UNENDED, ITEMS, CLOSED, OPEN, MARKED = range(8)
SHAPES = ["blank", "short", "ended", "unended", "items", "closed", "open", "marked"]

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_STRUCTURE = re.compile(r'[{\[]\s*(?:["{\[\]}]|$)')
_MARK = re.compile(r"(?:\.\.\.|…|\[truncated\]|\[…\]|\[\.\.\.\]|<truncated>|�)\s*$", re.I)
_ITEM = re.compile(r"\s*(?:[-*•–+]|\d+[.)])(?:\s|$)")
_WORD = re.compile(r"[^\W\d_]+")
_LAST = re.compile(r"[^\W\d_]+$")
_JOINED = re.compile(r"[\w'’]")  # before the unit in '30s', before the end of "isn't"
_ENDS = tuple(".!?。！？:;\"'”’»)]}>`|")
_DECODER = json.JSONDecoder()


def shape_of(text: str) -> int:
    """How ``text`` ends; see SHAPES. Linear in the text's length."""
    s = text.strip()
    if not s:
        return BLANK
    if _MARK.search(s):
        return MARKED
    if s.count("```") % 2:
        return OPEN
    tail, structured, at = s, False, 0
    while found := _STRUCTURE.search(s, at):
        try:
            _, end = _DECODER.raw_decode(s, found.start())
        except (ValueError, RecursionError):  # not JSON, or nested deeper than the parser goes
            rest = _STRING.sub("", s[found.start() :])
            if '"' in rest or rest.count("{") + rest.count("[") > rest.count("}") + rest.count("]"):
                return OPEN
            end = len(s)  # complete, though not valid
        structured, at, tail = True, end, s[end:]
    tail = tail.strip().strip("`").strip()
    if not tail:
        return CLOSED
    last = tail.rsplit("\n", 1)[-1]
    if _ITEM.match(last):
        return ITEMS
    if last.rstrip().endswith(_ENDS):
        return ENDED
    return UNENDED if structured or len(tail) >= 40 or re.search(r"[.!?]\s", tail) else SHORT


def _scanned(df: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over the texts: a row per record with its shape and last token, and rows of word counts."""
    kept = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != "text"]
    at = df.schema.names.index("text")
    added = [("n", T.IntegerType()), ("shape", T.IntegerType()), ("last", T.StringType()), ("word", T.StringType()), ("cnt", T.LongType())]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        names = schema.names
        like = None

        def counted() -> pa.RecordBatch:
            m = len(words)
            cols = [pa.nulls(m, t) for t in like] + [pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.string())]
            cols += [pa.array(list(words.keys()), pa.string()), pa.array(list(words.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            like = [c.type for c in rest]
            n, shape, last = [], [], []
            for text in batch.column(at).to_pylist():
                text = text or ""
                n.append(len(text))
                shape.append(shape_of(text))
                low = text.lower()
                found = _WORD.findall(low)
                stripped = low.rstrip()
                if shape[-1] == MARKED:
                    stripped = _MARK.sub("", stripped).rstrip()
                end = _LAST.search(stripped)
                alone = end and not (end.start() and _JOINED.match(stripped, end.start() - 1))
                last.append(end.group() if alone else None)
                words.update(found[:-1] if end else found)
            m = len(n)
            cols = [*rest, pa.array(n, pa.int32()), pa.array(shape, pa.int32()), pa.array(last, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            if len(words) > 200_000:
                yield counted()
                words.clear()
        if words:
            yield counted()

    return df.mapInArrow(run, schema)


TRUNK = 40  # depth of the trie's table; beyond it, words of the same first TRUNK characters are compared directly
# Finish reasons that say that a limit was reached.
LIMIT_REASONS = ("LENGTH", "MAX_TOKENS", "MAX_LENGTH", "TRUNCATED")
EVIDENCE = ("tokens", "reason", "limit", "open", "marked", "unended")
ROUNDING = 0.75  # tokens that counting whole tokens may add
PRIOR, LEAST_SHARE, TIMES_BASE, BASE_PRIOR = 2.0, 0.05, 2.0, 50.0


def vocabulary_trie(words: DataFrame) -> DataFrame:
    """The trie over ``(word, cnt)`` as a table ``(node, is_word, longer)`` of its nodes, down to depth TRUNK.

    A word is known from its second occurrence on. ``longer`` is the number of occurrences of the known
    words that go on after the node.
    """
    known = words.groupBy("word").agg(F.sum("cnt").alias("cnt")).where("cnt >= 2")
    depth = F.least(F.length("word"), F.lit(TRUNK))
    nodes = known.select("word", "cnt", F.explode(F.sequence(F.lit(1), depth)).alias("d"))
    nodes = nodes.select(F.substring("word", F.lit(1), F.col("d")).alias("node"), (F.col("d") == F.length("word")).alias("w"), "cnt")
    return nodes.groupBy("node").agg(F.max("w").alias("is_word"), F.sum(F.when(F.col("w"), 0).otherwise(F.col("cnt"))).alias("longer"))


def word_parts(words: DataFrame, ends: DataFrame) -> DataFrame:
    """``(last, prefix)``: the last tokens of ``(last, ends)`` that are parts of words, of any length.

    A part is a proper prefix of known words, is no known word of ``words`` (those inside texts), and
    ends fewer texts than its longer words occur, inside texts or at their ends: an answer that is
    given whole time and again is no part of a rarer word.
    """
    inside = words.groupBy("word").agg(F.sum("cnt").alias("cnt")).where("cnt >= 2").select(F.col("word").alias("last"))
    every = words.select("word", "cnt").union(ends.select("last", "ends"))
    short = ends.join(vocabulary_trie(every), F.col("last") == F.col("node")).where(F.length("last") <= TRUNK).select("last", "ends", "longer")
    known = every.where(F.length("word") > TRUNK).groupBy("word").agg(F.sum("cnt").alias("cnt")).where("cnt >= 2").withColumn("trunk", F.substring("word", 1, TRUNK))
    deep = ends.where(F.length("last") > TRUNK).withColumn("trunk", F.substring("last", 1, TRUNK)).join(known, "trunk")
    deep = deep.where((F.length("word") > F.length("last")) & F.startswith("word", "last")).groupBy("last", "ends").agg(F.sum("cnt").alias("longer"))
    return short.union(deep).where("ends < longer").join(inside, "last", "left_anti").select("last", F.lit(True).alias("prefix"))


def _token_excess(records: DataFrame) -> DataFrame:
    """``records`` with ``tokens_open`` (more tokens than the length explains) and ``written`` (not far fewer).

    Tokens are fitted as a line over the lengths of complete texts, for each source with at least 200 of
    them and over all for the others. The excess allowed is ROUNDING and the 0.98 quantile of what theirs
    is above it, growing with the square root of the length. Unknown tokens give false and true.
    """
    whole = records.where(F.col("shape").isin(CLOSED, ENDED) & (F.col("tokens") > 0) & (F.col("n") >= 40) & ~F.col("said"))
    anchor = 0.1  # share of texts of length 0 and half a token, added so that a narrow range of lengths gives no steep line
    x, y = F.avg("n") / (1 + anchor), (F.avg("tokens") + anchor / 2) / (1 + anchor)
    square, product = (F.avg(F.col("n") * F.col(c)) / (1 + anchor) for c in ("n", "tokens"))
    slope = (product - x * y) / (square - x * x)
    line = [F.count("*").alias("c"), slope.alias("slope"), (y - slope * x).alias("base")]
    overall = whole.agg(*line).first()
    if not overall.c or not overall.slope or overall.slope <= 0:
        return records.withColumns({"tokens_open": F.lit(False), "written": F.coalesce(F.col("tokens") > 0, F.lit(True))})
    own = broadcast_small(whole.groupBy("source").agg(*line).where("c >= 200 AND slope > 0").select(F.col("source").alias("ls"), "slope", "base"))
    joined = records.join(own, F.col("source").eqNullSafe(F.col("ls")), "left").drop("ls")
    joined = joined.withColumns({"slope": F.coalesce("slope", F.lit(overall.slope)), "base": F.coalesce("base", F.lit(overall.base))})
    over = (F.col("tokens") - F.col("base") - F.col("slope") * F.col("n") - ROUNDING) / F.sqrt(1 + F.col("n") / 1000)
    joined = joined.withColumn("over", over)
    spare = joined.where(F.col("shape").isin(CLOSED, ENDED) & (F.col("tokens") > 0) & (F.col("n") >= 40) & ~F.col("said")).agg(F.percentile_approx("over", 0.98, 10000).alias("s")).first().s
    far = F.col("tokens") * 2 < F.col("slope") * F.col("n")
    return joined.withColumns({"tokens_open": F.coalesce(F.col("over") > F.lit(max(0.0, float(spare))), F.lit(False)), "written": ~F.coalesce(far, F.lit(False))}).drop("over", "slope", "base")


def judged_evidence(records: DataFrame) -> dict[str, bool]:
    """Which kinds of EVIDENCE count, by how often the texts that carry one end in a part of a word.

    Of the texts with a last token, ``parts`` carry the kind and end in a part; PRIOR texts for and PRIOR
    against it are added, so that a kind counts until there are enough texts to refute it. It counts from
    a share of LEAST_SHARE on that is TIMES_BASE the share among texts without any evidence, to which
    BASE_PRIOR whole texts are added.
    """
    none = ~F.greatest(*[F.col(f"e_{e}") for e in EVIDENCE])
    worded = records.where(F.col("last").isNotNull() & F.col("written"))
    kinds = {e: F.col(f"e_{e}") for e in EVIDENCE} | {"none": none}
    seen = worded.agg(*[F.count(F.when(c, 1)).alias(e) for e, c in kinds.items()], *[F.count(F.when(c & F.col("prefix"), 1)).alias(f"{e}_parts") for e, c in kinds.items()]).first()
    least = max(LEAST_SHARE, TIMES_BASE * seen.none_parts / (seen["none"] + BASE_PRIOR))
    return {e: (seen[f"{e}_parts"] + PRIOR) / (seen[e] + 2 * PRIOR) >= least for e in EVIDENCE}


def cut_records(df: DataFrame, source: str, keys: list[str], text: str, reason: Column, tokens: Column) -> DataFrame:
    """``keys``, the source and ``is_cut``, ``evidence``, ``shape``, ``n`` of every record with a non-empty text, each key once.

    ``reason`` is the delivered finish reason (any spelling; null and '' say nothing) and ``tokens``
    the delivered number of completion tokens (nullable). A record is cut if its end is not whole and its
    last token is a part of a word (see ``word_parts``), whether or not tokens are known, as providers
    count those of the cut text; but short answers and lists of far fewer tokens than their length takes
    are not: no model wrote those, they are messages of errors. It is also cut if it carries evidence
    that ``judged_evidence`` lets count: tokens beyond what its length explains; for an end that is not
    whole, a reason that says so, or a length that is a limit of its source; a structure left open; a cut
    mark; prose that ends in the open.
    A limit is a length that at least 5 texts of the source have, at least half of those of that
    length or more, most of them ending in the open; a text that ends properly at a limit is whole.
    ``evidence`` is the first of 'part' (the trie's) and EVIDENCE that the record carries, null if it is
    not cut. A null source is a source of its own. Null and empty texts give no row.
    """
    said = F.upper(F.trim(reason)).isin(*LIMIT_REASONS)
    rows = df.select(*keys, F.col(source).alias("source"), tokens.cast("double").alias("tokens"), F.coalesce(said, F.lit(False)).alias("said"), F.col(text).alias("text"))
    scanned = materialize(_scanned(rows.where("text IS NOT NULL AND text <> ''"), keys), "ends")
    records = scanned.where("word IS NULL").drop("word", "cnt").dropDuplicates(keys)
    shape = F.col("shape")
    unfinished = shape.isin(OPEN, UNENDED, MARKED, ITEMS, SHORT)
    finals = records.where(unfinished & F.col("last").isNotNull()).groupBy("last").agg(F.count("*").alias("ends"))
    part = word_parts(scanned.where("word IS NOT NULL").select("word", "cnt"), finals).withColumnRenamed("last", "key")

    in_the_open = shape.isin(OPEN, UNENDED, MARKED).cast("int")
    lengths = records.groupBy("source", "n").agg(F.count("*").alias("here"), F.sum(in_the_open).alias("open"))
    beyond = lengths.withColumn("more", F.sum("here").over(W.partitionBy("source").orderBy(F.desc("n"))))
    caps = beyond.where((F.col("here") >= 5) & (F.col("open") * 2 > F.col("here")) & (F.col("here") * 2 >= F.col("more"))).select(F.col("source").alias("cs"), F.col("n").alias("cn"), F.lit(True).alias("cap"))

    nowhere = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*keys), F.lit(4096)))  # most texts have no last token: they must not meet in one task
    known = records.withColumn("key", F.when(unfinished & F.col("last").isNotNull(), F.col("last")).otherwise(nowhere)).join(part, "key", "left").drop("key")
    known = known.join(broadcast_small(caps), F.col("source").eqNullSafe(F.col("cs")) & (F.col("n") == F.col("cn")), "left").drop("cs", "cn")
    known = _token_excess(known)
    carried = {
        "tokens": F.col("tokens_open"), "reason": unfinished & F.col("said"), "limit": unfinished & F.coalesce("cap", F.lit(False)),
        "open": shape == OPEN, "marked": shape == MARKED, "unended": shape == UNENDED,
    }
    known = materialize(known.withColumns({"prefix": F.coalesce("prefix", F.lit(False)), **{f"e_{e}": c for e, c in carried.items()}}), "judged")
    counts = judged_evidence(known)
    evidence = F.when(F.col("prefix") & (F.col("written") | ~shape.isin(ITEMS, SHORT)), "part")
    for e in EVIDENCE:
        evidence = evidence.when(F.col(f"e_{e}") & F.lit(counts[e]), e)
    names = F.array(*[F.lit(x) for x in SHAPES])
    out = known.withColumn("evidence", evidence)
    return out.select(*keys, "source", F.col("evidence").isNotNull().alias("is_cut"), "evidence", F.element_at(names, shape + 1).alias("shape"), "n")


def responses_and_attempts(responses: DataFrame, results: DataFrame) -> DataFrame:
    """All texts of calls: ``record_kind, record_id, attempt_number, client, text, reason, tokens``."""
    direct = responses.select(
        F.lit("response").alias("record_kind"), F.col("response_id").alias("record_id"), F.lit(0).alias("attempt_number"), "client", "text",
        F.col("finish_reason").alias("reason"), F.col("usage.completion_tokens").alias("tokens"),
    )
    tries = results.select("result_id", "client", F.explode("history").alias("h")).select(
        F.lit("attempt").alias("record_kind"), F.col("result_id").alias("record_id"), F.col("h.attempt_number").alias("attempt_number"), "client", F.col("h.raw_response").alias("text"),
        F.col("h.finish_reason").alias("reason"), F.col("h.token_usage.completion_tokens").alias("tokens"),
    )
    return direct.union(tries)


def cut_calls(responses: DataFrame, results: DataFrame) -> DataFrame:
    """``record_kind, record_id, attempt_number, client, is_cut, evidence, shape, n`` of every call with a text."""
    calls = responses_and_attempts(responses, results).withColumn("origin", F.concat_ws("/", "record_kind", F.coalesce("client", F.lit(""))))
    found = cut_records(calls.withColumn("source0", F.struct("origin", "client")), "source0", ["record_kind", "record_id", "attempt_number"], "text", F.col("reason"), F.col("tokens"))
    return found.withColumn("client", F.col("source.client")).drop("source")


def cut_evidence(found: DataFrame) -> DataFrame:
    """``evidence, shape, cut``: how many records were found cut by which evidence."""
    return found.where("is_cut").groupBy("evidence", "shape").agg(F.count("*").alias("cut"))


def cut_rates(found: DataFrame, source: str = "client") -> DataFrame:
    """For each source: records, those cut, and their share rounded to 6 places. A null source keeps its row."""
    return found.groupBy(source).agg(F.count("*").alias("records"), F.sum(F.col("is_cut").cast("int")).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("records"), 6))
