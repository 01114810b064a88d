"""Vector collections on disk: folders of Parquet rows and a one-line JSON description, put in place last as the commit mark."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as vx
from tessera.sources import files


def checked_dim(dim: int) -> int:
    if isinstance(dim, bool) or not isinstance(dim, int) or not 1 <= dim <= vx.MAX_DIM:
        raise ValueError(f"dimension must be a whole number from 1 to {vx.MAX_DIM}")
    return dim


def place(base: str, name: str) -> str:
    """Folder of a collection under ``base``; a name that could leave it is refused."""
    if not re.fullmatch(r"[a-zA-Z0-9_-]+", name or ""):
        raise ValueError(f"bad collection name {name!r}")
    path = f"{base.rstrip('/')}/{name}"
    if ".." in PurePosixPath(path.split("://", 1)[-1]).parts:
        raise ValueError("the collection must stay under its base folder")
    return path


def save_collection(df: DataFrame, base: str, name: str, dim: int, metric: str = "cosine", id: str = "id", vector: str = "vector") -> str:
    """Write a collection and return its folder.

    The rows go to a folder of their own and are checked there; only then the description that names
    it is put in place, and the former rows go. A vector or id that can't be stored, or a repeated id,
    raises and leaves the former collection as it was.
    """
    path, dim, metric = place(base, name), checked_dim(dim), vx.metric_of(metric)
    spark = df.sparkSession
    rows = f"rows-{uuid.uuid4().hex}"
    before = _descriptions(spark, path)
    df.write.parquet(f"{path}/{rows}")
    try:
        seen = _checked(spark.read.parquet(f"{path}/{rows}"), dim, id, vector)
    except Exception:
        files.delete(spark, f"{path}/{rows}")
        raise
    number = before[-1] + 1 if before else 1
    meta = {"version": number, "name": name, "dimension": dim, "metric": metric, "count": seen, "rows": rows}
    files.put(spark, f"{path}/meta/{number:09d}.json", json.dumps(meta))
    for old in before:
        known = json.loads(files.read(spark, f"{path}/meta/{old:09d}.json"))
        files.delete(spark, f"{path}/meta/{old:09d}.json")
        files.delete(spark, f"{path}/{known['rows']}")
    return path


def _descriptions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names(spark, f"{path}/meta") if re.fullmatch(r"\d{9}\.json", n))


def _checked(rows: DataFrame, dim: int, id: str, vector: str) -> int:
    bad = vx.reject_reason(F.col(vector), dim).isNotNull() | ~vx.valid_id(F.col(id).cast("string"))
    seen = rows.agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"), F.countDistinct(id).alias("ids")).first()
    if seen.bad or seen.ids != seen.n:
        raise ValueError(f"{seen.bad} vectors or ids can't be stored, {seen.n - seen.ids} ids are repeated")
    return seen.n


def load_collection(spark: SparkSession, base: str, name: str, dim: int | None = None, id: str = "id", vector: str = "vector", validate: bool = True) -> tuple[DataFrame, dict]:
    """Rows and description of a saved collection. The stored metric is adopted; another ``dim`` than the stored one raises."""
    path = place(base, name)
    try:
        meta = json.loads(files.read(spark, f"{path}/meta/{_descriptions(spark, path)[-1]:09d}.json"))
    except Exception as e:
        raise FileNotFoundError(f"no readable collection {name!r}") from e
    if dim is not None and dim != meta["dimension"]:
        raise ValueError(f"dimension {dim} differs from the stored {meta['dimension']}")
    rows = spark.read.parquet(f"{path}/{meta['rows']}")
    if validate and _checked(rows, meta["dimension"], id, vector) != meta["count"]:
        raise ValueError("the number of rows differs from the description")
    return rows, meta
