"""One consistent form for texts that read the same (problem 1).

Every Arrow partition is handed to an embedded DuckDB, whose SQL removes invisible characters, maps
compatibility forms and look-alikes with ``translate`` and composes accents with ``nfc_normalize``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.pairing import hot_keys, pairs_of_equal_keys
from tessera.shared import materialize

# Letters of other alphabets and the Latin letter that each is drawn like.
LOOK_ALIKES = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",  # Greek capitals
    "ονρϲαιγυϳκ": "ovpcaiyujk",  # Greek small letters
    "АВЕЅІЈКМНОРСТУХҮԌԚԜҺӀ": "ABESIJKMHOPCTYXYGQWhl",  # Cyrillic capitals, palochka
    "аеѕіјорсухһԁԛԝѵүӏԍ": "aesijopcyxhdqwvylg",  # Cyrillic small letters
    "օսցհոՕՍ": "oughnOU",  # Armenian
    "ɑɡɩıʏƖ": "agiiyl",  # Latin letters of phonetic alphabets
    "‐‑‒–−⁃﹘": "-------",  # dashes drawn like a hyphen
    "․։׃∶ː": ".::::",  # dots
    "‚٫": ",,",
    ";": ";",
    "‘’‛ʼʹ′＇": "'" * 7,
    "“”‟″": '"' * 4,
    "∕⁄": "//",
    "∣ǀ": "||",
    "µ": "μ",
}
# Compatibility classes that a reader sees as the plain characters. Raised, lowered and
# circled forms and fractions are seen as different, so they stay.
SEEN_ALIKE = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>"}
# Ranges of characters that show nothing.
INVISIBLE = (
    r"\x{0}-\x{8}\x{E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}"
    r"\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
)
SPACES = r"\s\x{1C}-\x{1F}\x{B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{2800}\x{3000}"


@cache
def _maps() -> tuple[str, str, dict[str, str]]:
    """Sources and targets of the one-to-one mapping, and the mapping of joined characters to several.

    Built from the character database by rule: a character is followed through its compatibility
    decomposition of a class in SEEN_ALIKE until LOOK_ALIKES knows it, and composed again.
    """
    alike = {a: b for one, other in LOOK_ALIKES.items() for a, b in zip(one, other, strict=True)}

    def seen(ch: str) -> str:
        if ch in alike:
            return alike[ch]
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0].startswith("<"):
            if parts[0] not in SEEN_ALIKE:
                return ch
            parts = parts[1:]
        if not parts:
            return ch
        return "".join(seen(chr(int(x, 16))) for x in parts)

    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0xE000 <= code <= 0xF8FF:
            continue
        ch = chr(code)
        if ch not in alike and not unicodedata.decomposition(ch) or unicodedata.category(ch) == "Zs" or ch == "ſ":
            continue
        to = unicodedata.normalize("NFC", seen(ch))
        if to == unicodedata.normalize("NFC", ch):
            continue
        if len(to) == 1:
            single[ch] = to
        elif to.strip() and not unicodedata.combining(to[0]) and " " not in to:
            several[ch] = to
    return "".join(single), "".join(single.values()), several


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(column: str = "text") -> str:
    """DuckDB expression for the consistent form of ``column``; '' where nothing is visible, null for null."""
    one, other, several = _maps()
    joined = "[" + "".join(several) + "]"
    mapped = f"nfc_normalize(regexp_replace({column}, '[{INVISIBLE}]', '', 'g'))"
    mapped = (
        f"CASE WHEN regexp_matches({mapped}, {_quoted(joined)}) THEN array_to_string(list_transform("
        f"string_split({mapped}, ''), lambda ch: coalesce(list_extract(map_extract(joined.m, ch), 1), ch)), '') ELSE {mapped} END"
    )
    mapped = f"nfc_normalize(translate({mapped}, {_quoted(one)}, {_quoted(other)}))"
    return f"trim(regexp_replace({mapped}, '[{SPACES}]+', ' ', 'g'))"


def _plain_sql(column: str) -> str:
    """The same for a text of printable ASCII, which only needs its spaces put in order."""
    return f"CASE WHEN regexp_full_match({column}, '[\\x{{21}}-\\x{{7E}}]+( [\\x{{21}}-\\x{{7E}}]+)*') THEN {column} ELSE {form_sql(column)} END"


def with_form(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``df`` with the column ``out``: the consistent form of ``text``.

    Two texts have the same form iff they read the same: width, joined letters, way of writing an
    accent, look-alike letters, invisible characters and kind, number and outer place of spaces are
    levelled; case, missing accents and raised or circled digits are kept. null gives null; empty and
    invisible texts give ''. All other columns pass through, whatever their names; an existing
    column ``out`` is replaced. Texts of any length are mapped whole; an empty table stays empty.
    """
    df = df.drop(out)
    fields = df.schema.names
    at = fields.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        con.execute("SET temp_directory = ''")
        several = _maps()[2]
        con.execute("CREATE TABLE joined AS SELECT map(?::VARCHAR[], ?::VARCHAR[]) AS m", [list(several), list(several.values())])
        sql = f"SELECT {_plain_sql('t')} AS form FROM part, joined ORDER BY i"
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            part = pa.table({"i": pa.array(range(len(texts)), pa.int64()), "t": texts})
            con.register("part", part)
            got = con.sql(sql).to_arrow_table().column(0).combine_chunks().cast(pa.string())
            con.unregister("part")
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def key128(column: Column | str) -> Column:
    """128 bits of a string as BINARY: a join key of fixed width."""
    return F.unhex(F.md5(F.col(column) if isinstance(column, str) else column))


def _writings(df: DataFrame, order: str, text: str) -> DataFrame:
    """``(ord, k, raw)``: the keys of form and writing of every visible text, each ``ord`` once (of several texts the least key)."""
    rows = with_form(df.select(F.col(order).alias("ord"), F.col(text).alias("text")).where("ord IS NOT NULL AND text IS NOT NULL"))
    rows = rows.where("form <> ''").select("ord", key128("form").alias("k"), key128("text").alias("raw"))
    return materialize(rows.groupBy("ord").agg(F.min(F.struct("k", "raw")).alias("x")).select("ord", "x.*"), "forms")


def same_reading_pairs(df: DataFrame, order: str = "ord", text: str = "text") -> DataFrame:
    """Pairs ``(ord_a, ord_b)``, ord_a < ord_b, of records whose texts read the same but differ in characters.

    Null and blank texts and a null ``order`` are never in a pair; rows delivered again count once.
    Different writings of a form are paired, not records; records are joined to the pairs at the end,
    those of a common writing in parts, so that no task holds a hot form or writing whole. Exact copies
    are never paired with each other.
    """
    rows = _writings(df, order, text)
    mixed = rows.groupBy("k").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("k")
    rows = materialize(rows.join(mixed, "k", "left_semi"), "mixed")
    hot = hot_keys(rows, "raw")
    if hot is None:
        rows = rows.withColumn("part", F.lit(0))
    else:
        rows = rows.join(hot, "raw", "left").withColumn("part", F.pmod(F.xxhash64("ord"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    units = rows.groupBy("k", "raw", "part").agg(F.lit(1).alias("one")).withColumn("unit", F.struct("raw", "part"))
    pairs = pairs_of_equal_keys(units, "k", "unit").where("unit_a.raw <> unit_b.raw")
    a, b = (rows.select(F.struct("raw", "part").alias(f"unit_{s}"), F.col("ord").alias(s)) for s in "ab")
    return pairs.join(a, "unit_a").join(b, "unit_b").select(F.least("a", "b").alias("ord_a"), F.greatest("a", "b").alias("ord_b"))


def same_reading_groups(df: DataFrame, order: str = "ord", text: str = "text") -> DataFrame:
    """One row per visible record: ``ord``, ``class_id`` (least ord of those that read the same), ``writings`` of the
    class, and ``links``: how many records read the same in other characters. No pairs are made."""
    rows = _writings(df, order, text)
    writings = rows.groupBy("k", "raw").agg(F.count("*").alias("copies"), F.min("ord").alias("least"))
    classes = writings.groupBy("k").agg(F.min("least").alias("class_id"), F.count("*").alias("writings"), F.sum("copies").alias("members"))
    known = writings.join(classes, "k").select("raw", "class_id", "writings", (F.col("members") - F.col("copies")).alias("links"))
    return rows.select("ord", "raw").join(known, "raw").select("ord", "class_id", "writings", "links")
