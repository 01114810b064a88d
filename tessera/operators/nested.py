"""Deeply nested records as related flat tables (problem 3).

For JSON text the merged schema is inferred by distributed aggregates over VARIANT values, a round for
each depth at which shapes disagree; for typed columns it is the DataFrame's schema. Every array level
becomes a child table that carries its parent's surrogate key and the place in the array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.shared import materialize


@dataclass
class Shape:
    """Part of a merged schema: its fields, or its elements, or neither for a scalar; mixed where shapes disagree."""

    fields: dict[str, Shape] = field(default_factory=dict)
    element: Shape | None = None
    mixed: bool = False
    kind: str = "VOID"

    @property
    def indexed(self) -> bool:
        """An object that is an array in disguise: all its keys are numbers."""
        return bool(self.fields) and all(k.isdigit() for k in self.fields)

    def has_objects(self) -> bool:
        return bool(self.fields) or self.mixed or (self.element is not None and self.element.has_objects())


def parse_shape(text: str | None) -> Shape:
    """The Shape that Spark's printed schema of a VARIANT describes."""
    at = 0

    def word() -> str:
        nonlocal at
        if text[at] == "`":
            end = at + 1
            while text[end] != "`" or text[end : end + 2] == "``":
                end += 2 if text[end] == "`" else 1
            name, at = text[at + 1 : end].replace("``", "`"), end + 1
            return name
        start = at
        while at < len(text) and text[at] not in "<>:,":
            at += 1
        return text[start:at].strip()

    def shape() -> Shape:
        nonlocal at
        kind = word()
        if at < len(text) and text[at] == "(":  # DECIMAL(p,s) never gets here: word() has no reason to stop at "("
            return Shape()
        if kind.startswith("DECIMAL("):
            start = at - len(kind)
            while text[at - 1] != ")":
                at += 1
            return Shape(kind=text[start:at])
        if at < len(text) and text[at] == "<":
            at += 1
            made = Shape(kind=kind)
            if kind == "ARRAY":
                made.element = shape()
            else:
                while text[at] != ">":
                    name = word()
                    at += 1  # the colon
                    while text[at] == " ":
                        at += 1
                    made.fields[name] = shape()
                    while text[at] in ", ":
                        at += 1
            at += 1
            return made
        return Shape(mixed=kind == "VARIANT", kind="STRING" if kind == "VARIANT" else kind)

    return shape() if text else Shape()


def _kind(v: Column) -> Column:
    """ARRAY, OBJECT, STRING, VOID or another scalar type's name; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def unwrapped(v: Column) -> Column:
    """A string that holds a JSON object or array as that value; anything else as it is."""
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.when((_kind(v) == "STRING") & _kind(inner).isin("OBJECT", "ARRAY"), inner).otherwise(v)


def items(v: Column) -> Column:
    """The places of a list as ARRAY<STRUCT<pos INT, value VARIANT>>, in whatever shape it was delivered.

    An array gives its places, null ones included; an object whose keys are all numbers gives the keys
    as places; any other object that isn't empty is alone at place 0; everything else gives null.
    """
    listed = F.try_variant_get(v, "$", "array<variant>")
    keyed = F.try_variant_get(v, "$", "map<string,variant>")
    numbers = (F.size(keyed) > 0) & F.forall(F.map_keys(keyed), lambda k: k.rlike("^[0-9]{1,9}$"))
    pair = lambda pos, value: F.struct(pos.cast("int").alias("pos"), value.alias("value"))
    return (
        F.when(_kind(v) == "ARRAY", F.transform(listed, lambda x, i: pair(i, x)))
        .when((_kind(v) == "OBJECT") & numbers, F.transform(F.map_entries(keyed), lambda e: pair(e["key"], e["value"])))
        .when((_kind(v) == "OBJECT") & (F.size(keyed) > 0), F.array(pair(F.lit(0), v)))
    )


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


@dataclass
class Parts:
    """What the records of a table hold: lists, by path, and scalars with their type."""

    lists: dict[tuple[str, ...], Column] = field(default_factory=dict)
    scalars: dict[tuple[str, ...], tuple[Column, str]] = field(default_factory=dict)


def infer_parts(df: DataFrame, values: list[Column], names: set[str]) -> list[Parts]:
    """The Parts of each VARIANT expression of ``values``, each with the expressions that reach them.

    The schema is merged over all rows. Where rows disagree, the values at that path are unwrapped and
    looked at again by kind: a path that is ever an array or keyed by numbers is a list, and so is an
    object of the name of a list of objects elsewhere (``names``, which grows); any other object is a
    wrapper whose fields belong to the record. A path may hold both a list and, in other rows, a
    scalar. What reaches the driver is one schema a path.
    """
    parts = [Parts() for _ in values]
    wrappers: list[dict[tuple[str, ...], Column]] = [{} for _ in values]
    pending: list[tuple[int, tuple[str, ...], Column]] = [(i, (), v) for i, v in enumerate(values)]

    def walk(i: int, path: tuple[str, ...], v: Column, shape: Shape) -> None:
        for name, sub in shape.fields.items():
            here, reach = (*path, name), _at(v, name)
            if sub.mixed:
                pending.append((i, here, unwrapped(reach)))
            elif sub.element is not None or sub.indexed:
                if sub.indexed or sub.element.kind != "VOID":
                    parts[i].lists[here] = reach
                if sub.has_objects():
                    names.add(name)
            elif sub.fields:
                wrappers[i][here] = reach
                walk(i, here, reach, sub)
            elif sub.kind not in ("OBJECT", "VOID"):
                parts[i].scalars[here] = (reach, sub.kind)
                if sub.kind == "STRING":
                    texts.append((i, here, reach))

    while pending:
        now, pending, texts = pending, [], []
        wanted = []
        for _, _, v in now:
            k = _kind(v)
            wanted += [F.schema_of_variant_agg(F.when(k == "OBJECT", v)), F.schema_of_variant_agg(F.when(k == "ARRAY", v)), F.count(F.when(k == "ARRAY", 1)), F.schema_of_variant_agg(F.when(~k.isin("OBJECT", "ARRAY"), v))]
        row = df.agg(*[w.alias(f"c{i}") for i, w in enumerate(wanted)]).first()
        for n, (i, path, v) in enumerate(now):
            obj, arr, arrays, plain = parse_shape(row[4 * n]), parse_shape(row[4 * n + 1]), row[4 * n + 2], parse_shape(row[4 * n + 3])
            if plain.kind != "VOID":
                parts[i].scalars[path] = (v, plain.kind)
            if arrays or obj.indexed:
                if obj.fields or (arr.element is not None and arr.element.kind != "VOID"):
                    parts[i].lists[path] = v
                if path and (obj.fields or arr.has_objects()):
                    names.add(path[-1])
            else:
                if path:
                    wrappers[i][path] = v
                walk(i, path, v, obj)
        if texts:  # a field that is always a string may hold JSON throughout
            row = df.agg(*[F.count(F.when(_kind(unwrapped(v)).isin("OBJECT", "ARRAY") & (_kind(v) == "STRING"), 1)).alias(f"c{n}") for n, (_, _, v) in enumerate(texts)]).first()
            pending += [(i, path, unwrapped(v)) for n, (i, path, v) in enumerate(texts) if row[n]]
    for part, objects in zip(parts, wrappers, strict=True):
        alone = {path: v for path, v in objects.items() if path[-1] in names}
        inside = lambda path: any(path[: len(a)] == a and path != a for a in alone)  # noqa: B023, E731
        outer = {path: v for path, v in alone.items() if not inside(path)}
        part.lists = {path: v for path, v in part.lists.items() if not inside(path)} | outer
        part.scalars = {path: v for path, v in part.scalars.items() if not inside(path)}
    return parts


@dataclass
class Level:
    """All lists of one depth: ``rows`` (parent_id, list, places, kind, v), of which ``list`` is a place in ``paths``."""

    rows: DataFrame
    paths: list[tuple[str, ...]]
    parts: list[Parts]


def json_levels(df: DataFrame, key: str, text: str) -> list[Level]:
    """The records of JSON text and, level by level, the places of every list inside them, however deep.

    A root that is itself a list stands for its records. Text that isn't valid JSON, null and empty
    text have no rows. ``places`` are the places at all levels, from the record's place in the root to
    the row's own; null places are counted and are no rows. A list right inside a list is called '[]'.
    Records delivered again give their rows again. Each level is written once and read by the next.
    """
    def written(listed: DataFrame, place: Column, name: str) -> DataFrame:
        value = F.col("e.value")
        rows = listed.select("parent_id", "list", place.alias("places"), _kind(value).alias("kind"), F.to_json(value).alias("j")).where("kind <> 'VOID'")
        return materialize(rows, name).withColumn("v", F.parse_json("j")).drop("j")

    parsed = df.select(F.col(key).alias("parent_id"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    root = parsed.select("parent_id", F.lit(0).alias("list"), F.explode(items(unwrapped(F.col("v")))).alias("e"))
    rows, paths, names = written(root.where(_kind(F.col("e.value")) == "OBJECT"), F.array("e.pos"), "records"), [()], set()
    levels = []
    while True:
        parts = infer_parts(rows, [F.when(F.col("list") == i, F.col("v")) for i in range(len(paths))], names)
        levels.append(Level(rows, paths, parts))
        below = [((*paths[i], *(path or ("[]",))), v) for i, part in enumerate(parts) for path, v in part.lists.items()]
        if not below:
            return levels
        each = rows.select("parent_id", "places", F.explode(F.array(*[F.struct(F.lit(n).alias("list"), v.alias("v")) for n, (_, v) in enumerate(below)])).alias("c")).where("c.v IS NOT NULL")
        child = each.select("parent_id", "places", F.col("c.list").alias("list"), F.explode(items(unwrapped(F.col("c.v")))).alias("e"))
        rows, paths = written(child, F.concat("places", F.array("e.pos")), "children"), [path for path, _ in below]


def json_tables(df: DataFrame, key: str, text: str) -> dict[tuple[str, ...], DataFrame]:
    """Related flat tables ``(parent_id, places, scalars)`` of JSON records, by the path of their list, () for the records.

    A row's surrogate key is ``parent_id`` with ``places``; its parent's is the same without the last
    place. Fields of wrappers are called ``a__b``, and a place that is itself a scalar is ``value``.
    Scalars whose type differs between rows are strings. See ``json_levels``.
    """
    return {path: _flat(level, i) for level in json_levels(df, key, text) for i, path in enumerate(level.paths)}


def _flat(level: Level, i: int) -> DataFrame:
    taken = {"parent_id", "places"}
    columns = []
    for path, (v, kind) in level.parts[i].scalars.items():
        name = wanted = "__".join(path) or "value"
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{wanted}_{n}"
        taken.add(name.lower())
        columns.append(F.when(~_kind(v).isin("OBJECT", "ARRAY", "VOID"), F.try_variant_get(v, "$", kind.lower())).alias(name))
    return level.rows.where(F.col("list") == i).select("parent_id", "places", *columns)


def flatten(df: DataFrame, key: str, prefix: str = "") -> dict[str, DataFrame]:
    """Related flat tables of a DataFrame with typed nested columns, by the path of their array ('' for the root).

    The root table has ``key`` and all scalar columns, structs flattened to ``a__b``. Each array of
    structs is a table with its parent's ``key`` columns, ``pos_<array>`` (0-based place, null elements
    counted but no rows) and the element's scalars, and so on at each level: a row's surrogate key is
    its parent's key with the place added. Arrays of scalars become tables with ``value``. Null and
    empty arrays give no rows. Names that would clash get the array's path in front.
    """
    tables: dict[str, DataFrame] = {}

    def go(now: DataFrame, keys: list[str], body: list[tuple[str, Column, T.DataType]], path: str) -> None:
        scalars: list[Column] = []
        arrays: list[tuple[str, Column, T.ArrayType]] = []

        def spread(name: str, c: Column, kind: T.DataType) -> None:
            if isinstance(kind, T.StructType):
                for f in kind.fields:
                    spread(f"{name}__{f.name}" if name else f.name, c[f.name], f.dataType)
            elif isinstance(kind, T.ArrayType):
                arrays.append((name, c, kind))
            else:
                scalars.append(c.alias(name if name not in keys else f"{path or 'root'}__{name}"))

        for name, c, kind in body:
            spread(name, c, kind)
        tables[path] = now.select(*keys, *scalars)
        for name, c, kind in arrays:
            below = f"{path}.{name}" if path else name
            place = f"pos_{below.replace('.', '_')}"
            child = now.select(*keys, F.posexplode(c).alias(place, "_element")).where(F.col("_element").isNotNull())
            inner = [("", F.col("_element"), kind.elementType)] if isinstance(kind.elementType, T.StructType) else [("value", F.col("_element"), kind.elementType)]
            go(child, [*keys, place], inner, below)

    go(df, [key], [(f.name, F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if f.name != key], prefix)
    return tables


# The lists that the reports and results hold, and what one of each is called.
CHILD_NAMES = {"suspects": "suspect", "evidences": "evidence", "history": "attempt"}


def case_children(reports: DataFrame, results: DataFrame) -> DataFrame:
    """``parent, parent_id, child, pos``: every child object of reports (JSON payload) and results (typed columns), once.

    Lists of the same name count as one whatever wrapper they arrived in, at whatever depth. Null places
    and null parents give no rows; a record delivered again adds nothing.
    """
    parts = []
    for level in json_levels(reports, "report_id", "payload"):
        named = [(i, CHILD_NAMES[path[-1]]) for i, path in enumerate(level.paths) if path and path[-1] in CHILD_NAMES]
        if named:
            child = F.element_at(F.create_map(*[F.lit(x) for pair in named for x in pair]), F.col("list"))
            rows = level.rows.where(F.col("list").isin([i for i, _ in named]) & (F.col("kind") == "OBJECT"))
            parts.append(rows.select(F.lit("report").alias("parent"), "parent_id", child.alias("child"), F.element_at("places", -1).alias("pos")))
    for path, child in flatten(results.select("result_id", "data", "history"), "result_id").items():
        name = path.rpartition("__")[2]
        if name in CHILD_NAMES:
            parts.append(child.select(F.lit("result").alias("parent"), F.col("result_id").alias("parent_id"), F.lit(CHILD_NAMES[name]).alias("child"), F.col(f"pos_{path}").alias("pos")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("parent_id IS NOT NULL").distinct()


def case_tables(reports: DataFrame, results: DataFrame) -> DataFrame:
    """All flat tables of reports and results in one: ``parent, list, parent_id, places`` and the scalars of all.

    ``list`` is the path of the list, '' for the records; a row has null in the columns of other lists.
    A column whose type differs between lists is a string. A record delivered again adds nothing.
    """
    parts = []
    for path, one in json_tables(reports, "report_id", "payload").items():
        parts.append(("report", ".".join(path), one))
    for path, one in flatten(results.select("result_id", "data", "history"), "result_id").items():
        places = [f.name for f in one.schema.fields if f.name.startswith("pos_")]
        rest = [c for c in one.columns if c not in ("result_id", *places)]
        parts.append(("result", path, one.select(F.col("result_id").alias("parent_id"), F.array(F.lit(0), *places).alias("places"), *rest)))
    keys = ("parent", "list", "parent_id", "places")
    kinds: dict[str, list[T.DataType]] = {}
    spelled: dict[str, str] = {}
    for _, _, one in parts:
        for f in one.schema.fields[2:]:
            name = spelled.setdefault(f.name.lower(), f.name if f.name.lower() not in keys else f"record__{f.name}")
            kinds.setdefault(name, []).append(f.dataType)
    out = None
    for parent, path, one in parts:
        have = {spelled[f.name.lower()]: f.name for f in one.schema.fields[2:]}
        columns = []
        for name, seen in kinds.items():
            kind = seen[0] if all(k == seen[0] for k in seen) else T.StringType()
            columns.append((F.col(f"`{have[name].replace('`', '``')}`") if name in have else F.lit(None)).cast(kind).alias(name))
        rows = one.select(F.lit(parent).alias("parent"), F.lit(path).alias("list"), F.col("parent_id"), F.col("places"), *columns)
        out = rows if out is None else out.union(rows)
    return out.where("parent_id IS NOT NULL").distinct()
