"""Tables written between the steps of a plan, in a folder that every executor can read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STEPS: list[str] = []
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Only on one machine (a master that begins with ``local``) may the setting be missing; then a
    temporary folder is used. On a cluster that would scatter a table over the workers' disks, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already: the cluster clears the folder
        pass


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, no executor holds it.

    The table outlives lost executors. It goes by ``discard`` or ``clear``, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STEPS:
        atexit.register(clear, spark)
    _STEPS.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._tessera_step = path
    return made


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go as soon as it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def materialize_each(rounds: Iterable[DataFrame], name: str = "step") -> DataFrame:
    """The union of ``rounds``, of equal columns, as ``materialize`` has it; the shuffle files of a round go before the next is run."""
    path = made = None
    for df in rounds:
        spark = df.sparkSession
        if path is None:
            path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
            if not _STEPS:
                atexit.register(clear, spark)
            _STEPS.append(path)
        with _tidied(spark):
            df.write.mode("append").parquet(path)
        made = df
    if made is None:
        raise ValueError("no rounds")
    made = made.sparkSession.read.schema(made.schema).parquet(path)
    made._tessera_step = path
    return made


def discard(step: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more, such as the last round's of a loop."""
    path = getattr(step, "_tessera_step", None)
    if path in _STEPS:
        _STEPS.remove(path)
        _drop(step.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all steps written so far; a driver that runs many queries calls it when their results are stored."""
    while _STEPS:
        _drop(spark, _STEPS.pop())


def broadcast_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` written as a step, to be broadcast if it has at most ``most`` rows, else joined as any other table."""
    made = materialize(df, "small")
    return F.broadcast(made) if made.limit(most + 1).count() <= most else made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over at least as many partitions as there are cores.

    A small file of one row group would keep a single core busy; a table that already has partitions
    enough is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    at = tempfile.mkdtemp(prefix="tessera-ship-")
    atexit.register(shutil.rmtree, at, True)
    shutil.copytree(root / "tessera", f"{at}/tree/tessera", ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/tessera", "zip", f"{at}/tree"))
    _SHIPPED.add(app)
