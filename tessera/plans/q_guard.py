"""Queries over texts with JSON and secrets, and over byte pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import jsonx
from tessera.functions import text as tx
from tessera.operators import bpe
from tessera.operators import heal as hl
from tessera.shared import spread, table

_KEYS = [" sk-ant-" + "a1" * 12, " sk-" + "b2" * 12, " Bearer " + "c3" * 12, " ?key=abc&x=1", " AIza" + "d" * 35]
_SECRET = " ".join(_KEYS)


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "props")


def redact(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.redact(F.concat("text", F.lit(_SECRET)))).alias("digest"), F.length(tx.redact(F.concat("text", F.lit(_SECRET)))).alias("n"))


def wrap_untrusted(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.wrap_untrusted(F.col("text"))).alias("digest"))


def clamp_prompt(spark, d):
    return _docs(spark, d).select("doc_id", F.length(tx.clamp_prompt(F.col("text"), 1000)).alias("n"))


def truncated_reasons(spark, d):
    return table(spark, d, "llm_responses").groupBy("client").agg(F.sum(tx.is_truncated(F.col("finish_reason")).cast("int")).alias("truncated"), F.count("*").alias("n"))


def diagnostics(spark, d):
    return _docs(spark, d).select("doc_id", tx.diagnostic(F.col("text")).alias("shown"))


def retry_after(spark, d):
    return _events(spark, d).select("event_id", tx.retry_after(F.regexp_extract("props", r"(\d+)", 1), F.lit(1.5)).alias("seconds"))


def json_fence(spark, d):
    text = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye ```x```"))
    return _events(spark, d).select("event_id", jsonx.fenced(text).alias("inside"))


def json_extract(spark, d):
    text = F.concat(F.lit('noise } then '), "props", F.lit(" and [1, 2] more"))
    return _events(spark, d).select("event_id", jsonx.extract_json(text).alias("x")).select("event_id", "x.json", "x.strategy")


def json_cascade(spark, d):
    """Objects in fences, among noise, in need of repair, and none at all."""
    broken = F.replace(F.replace("props", F.lit('"'), F.lit("'")), F.lit("}"), F.lit(" , }"))
    text = F.element_at(F.array(F.concat(F.lit("see {x}\n```json\n"), "props", F.lit("\n``` end")), F.concat(F.lit("so "), "props", F.lit(" and }")), F.concat(F.lit("like "), broken), F.lit("{none} of [these")), (F.col("event_id") % 4 + 1).cast("int"))
    return _events(spark, d).select("event_id", jsonx.extract_json(text).alias("x")).select("event_id", "x.json", "x.strategy")


def text_checks(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", tx.within_bytes(c, 1000).alias("short"), tx.contains_special(c, ["the ", "<|end|>"]).alias("special"))


def json_extract_responses(spark, d):
    rows = table(spark, d, "llm_responses").select("response_id", "text").distinct()
    return rows.select(jsonx.extract_json(F.col("text")).alias("x")).groupBy("x.strategy").agg(F.count("*").alias("n"), F.sum(F.length("x.json")).alias("chars"))


def json_repair(spark, d):
    broken = F.replace(F.replace("props", F.lit('"'), F.lit("'")), F.lit("}"), F.lit(", }"))
    return _events(spark, d).select("event_id", jsonx.repair(broken).alias("mended"), jsonx.parses(jsonx.repair(broken)).alias("ok"))


def json_constraints(spark, d):
    value = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    checked = jsonx.check(value, {"k": ((value["k"] >= 10) & (value["k"] < 90), "fuera de rango")})
    return _events(spark, d).select("event_id", checked.alias("c")).select("event_id", "c.success", "c.error")


def token_usage(spark, d):
    tries = table(spark, d, "extraction_results").select("client", F.explode("history").alias("h"))
    return tries.groupBy("client").agg(F.sum("h.token_usage.prompt_tokens").alias("prompt"), F.sum("h.token_usage.completion_tokens").alias("completion"))


class ScriptedClient:
    """Answers without a network: wrong at first, corrected when asked, truncated for very long prompts."""

    supports_structured_output = False

    def complete(self, messages):
        ask = messages[-1]["content"]
        usage = {"prompt_tokens": len(ask) // 4 + 1, "completion_tokens": 8}
        if len(ask) > 20_000:
            return {"text": '{"n', "finish_reason": "MAX_TOKENS", **usage}
        if "untrusted_input_to_extract" in ask:
            return {"text": 'Sure: {"words": "many"}', "finish_reason": "STOP", **usage}
        return {"text": '```json\n{"words": 7}\n```', "finish_reason": "STOP", **usage}

    def complete_structured(self, messages, schema):
        return self.complete(messages)


def heal_loop(spark, d):
    from pydantic import create_model

    model = create_model("Counted", words=(int, ...))
    out = hl.heal(_docs(spark, d), "text", model, ScriptedClient)
    return out.select("doc_id", "success", "data", "attempts", F.col("total_tokens.completion_tokens").alias("completion"), F.size("history").alias("records"), "error")


def utf8_bytes(spark, d):
    return _docs(spark, d).select(F.explode(tx.utf8_bytes(F.col("text"))).alias("b")).groupBy("b").agg(F.count("*").alias("n"))


def _ids(spark, d):
    return _docs(spark, d).select("doc_id", tx.utf8_bytes(F.col("text")).alias("ids"))


def pair_stats(spark, d):
    return bpe.pair_stats(_ids(spark, d), "ids")


def first_merge(spark, d):
    return bpe.best_pair(bpe.pair_stats(_ids(spark, d), "ids"))


def chunk_freq(spark, d):
    return bpe.piece_counts(_docs(spark, d), "text", r"\p{L}+|\p{N}+|[^\p{L}\p{N}]")


def gpt2_split(spark, d):
    return bpe.piece_counts(_docs(spark, d), "text", tx.GPT2_SPLIT)


def gpt4_split(spark, d):
    return bpe.piece_counts(_docs(spark, d), "text", tx.GPT4_SPLIT)


def bpe_train(spark, d):
    model = bpe.BpeModel.train(_docs(spark, d), "text", 320)
    return spark.createDataFrame([(a, b, i) for (a, b), i in model.merges.items()], "p0 int, p1 int, idx int")


def bpe_encode(spark, d):
    model = bpe.BpeModel.train(_docs(spark, d), "text", 320)
    return _docs(spark, d).select("doc_id", model.encode(F.col("text"), "none").alias("ids")).select("doc_id", F.size("ids").alias("n"), F.md5(F.concat_ws(",", "ids")).alias("digest"))


def bpe_encode_whole(spark, d):
    """Training and encoding of whole texts, without a split pattern."""
    model = bpe.BpeModel.train(_docs(spark, d), "text", 300, None)
    return _docs(spark, d).select("doc_id", model.encode(F.col("text"), "none").alias("ids")).select("doc_id", F.size("ids").alias("n"), F.md5(F.concat_ws(",", "ids")).alias("digest"))


def bpe_roundtrip(spark, d):
    model = bpe.BpeModel.train(_docs(spark, d), "text", 320)
    return _docs(spark, d).select("doc_id", model.decode(model.encode(F.col("text"), "none")).alias("text"))


def sql():
    redacted = f"text || '{_SECRET}'"
    for pattern, put in tx.SECRETS:
        redacted = f"regexp_replace({redacted}, '{pattern}', '{put}', 'g')"
    frame = len(tx.UNTRUSTED_HEAD) + len(tx.UNTRUSTED_TAIL)
    visible = r"[^\s\x{1C}-\x{1F}\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    kind = f"CASE WHEN text IS NULL OR NOT regexp_matches(text, '{visible}') THEN 'empty' WHEN length(replace(replace(substr(text, 1, {tx.MAX_PROMPT_CHARS}), '<', '&lt;'), '>', '&gt;')) + {frame} > 20000 THEN 'long' ELSE 'healed' END"
    healed = (
        f"SELECT doc_id, kind = 'healed' AS success, CASE kind WHEN 'healed' THEN '{{\"words\":7}}' END AS data, CASE kind WHEN 'empty' THEN 0 WHEN 'long' THEN 1 ELSE 2 END::INT AS attempts, CASE kind WHEN 'empty' THEN 0 WHEN 'long' THEN 8 ELSE 16 END::INT AS completion, "
        f"CASE kind WHEN 'empty' THEN 0 WHEN 'long' THEN 1 ELSE 2 END::INT AS records, CASE kind WHEN 'empty' THEN '{hl.EMPTY_PROMPT}' WHEN 'long' THEN '{hl.TRUNCATED_ADVICE}' END AS error FROM (SELECT doc_id, {kind} AS kind FROM documents)"
    )
    bytes_ = "each AS (SELECT doc_id, i, ('0x' || substr(h, 2 * i - 1, 2))::INT AS b FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(1, strlen(text) + 1)) AS i FROM documents WHERE text <> ''))"
    pairs = f"WITH {bytes_}, pairs AS (SELECT b AS p0, lead(b) OVER (PARTITION BY doc_id ORDER BY i) AS p1 FROM each), stats AS (SELECT p0, p1, count(*) AS cnt FROM pairs WHERE p1 IS NOT NULL GROUP BY ALL)"
    return {
        "redact": f"SELECT doc_id, md5({redacted}) AS digest, length({redacted})::INT AS n FROM documents",
        "wrap_untrusted": f"SELECT doc_id, md5('{tx.UNTRUSTED_HEAD}' || replace(replace(text, '<', '&lt;'), '>', '&gt;') || '{tx.UNTRUSTED_TAIL}') AS digest FROM documents",
        "clamp_prompt": r"SELECT doc_id, CASE WHEN regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') THEN least(length(text), 1000)::INT END AS n FROM documents",
        "truncated_reasons": "SELECT client, sum(coalesce(upper(finish_reason) IN ('LENGTH', 'MAX_TOKENS'), false)::INT)::BIGINT AS truncated, count(*) AS n FROM llm_responses GROUP BY client",
        "diagnostics": "SELECT doc_id, CASE WHEN text IS NULL THEN 'None' WHEN length(text) > 40 THEN substr(text, 1, 40) || '... (longitud: ' || length(text) || ')' ELSE text END AS shown FROM documents",
        "retry_after": r"SELECT event_id, greatest(0, least(60, coalesce(try_cast(regexp_extract(props, '(\d+)', 1) AS DOUBLE), 1.5)))::DOUBLE AS seconds FROM events",
        "json_fence": "SELECT event_id, props AS inside FROM events",
        "json_extract": "SELECT event_id, replace(props, ' ', '') AS json, 'balanced' AS strategy FROM events",
        "json_cascade": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN replace(props, ' ', '') END AS json, CASE event_id % 4 WHEN 0 THEN 'fence' WHEN 1 THEN 'balanced' WHEN 2 THEN 'repair' END AS strategy FROM events",
        "text_checks": "SELECT doc_id, strlen(text) <= 1000 AS short, contains(text, 'the ') OR contains(text, '<|end|>') AS special FROM documents",
        "heal_loop": healed,
        "json_repair": "SELECT event_id, props AS mended, props IS NOT NULL AS ok FROM events",
        "json_constraints": "SELECT event_id, k BETWEEN 10 AND 89 AS success, CASE WHEN k BETWEEN 10 AND 89 THEN NULL ELSE '- Campo ''k'': fuera de rango' END AS error FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)",
        "token_usage": "SELECT client, sum(h.token_usage.prompt_tokens)::BIGINT AS prompt, sum(h.token_usage.completion_tokens)::BIGINT AS completion FROM (SELECT client, unnest(history) AS h FROM extraction_results) GROUP BY client",
        "utf8_bytes": f"WITH {bytes_} SELECT b, count(*) AS n FROM each GROUP BY b",
        "pair_stats": f"{pairs} SELECT p0, p1, cnt FROM stats",
        "first_merge": f"{pairs} SELECT p0, p1, cnt FROM stats ORDER BY cnt DESC, p0, p1 LIMIT 1",
        "chunk_freq": r"SELECT piece, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\p{L}\p{N}]')) AS piece FROM documents) GROUP BY piece",
        "bpe_roundtrip": "SELECT doc_id, text FROM documents",
    }


NAMES = [
    "redact", "wrap_untrusted", "clamp_prompt", "truncated_reasons", "diagnostics", "retry_after", "json_fence", "json_extract", "json_cascade", "text_checks", "json_extract_responses", "json_repair", "json_constraints", "token_usage", "heal_loop",
    "utf8_bytes", "pair_stats", "first_merge", "chunk_freq", "gpt2_split", "gpt4_split", "bpe_train", "bpe_encode", "bpe_encode_whole", "bpe_roundtrip",
]
