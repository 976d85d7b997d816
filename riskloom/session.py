"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

# Whether a query's shuffle files go when it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot user even where that costs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(cpus: int | str = "*", app: str = "riskloom", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all machines can reach.

    It is the session's checkpoint folder, or the one named in ``spark.checkpoint.dir``. Without
    either it lies below the warehouse, where tables are shared as well; on a cluster whose warehouse is
    a folder of the driver's machine, that is an error. The session's own checkpoint folder is left as it is.
    """
    current = spark.sparkContext.getCheckpointDir()
    named = current or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    own = warehouse.startswith(("file:", "/"))
    if own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster can reach")
    return f"{warehouse}/riskloom-intermediate"


@dataclass
class Scope:
    """Intermediate tables, and results remembered with them, that live and go together."""

    paths: list[str] = field(default_factory=list)
    kept: dict[Hashable, object] = field(default_factory=dict)


# The open ``temporary`` blocks, innermost last, and by application what was written outside of any.
_OPEN: list[Scope] = []
_SESSIONS: dict[str, Scope] = {}


def _scope(spark: SparkSession) -> Scope:
    return _OPEN[-1] if _OPEN else _SESSIONS.setdefault(spark.sparkContext.applicationId, Scope())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scope(spark).paths.append(path)
    return path


def remembered(spark: SparkSession, key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` returned for ``key``: it is called once in the scope that owns its tables.

    An enclosing scope's result serves the blocks within it. A result is forgotten with the tables it is made
    of, when its block ends or :func:`release` is called.
    """
    session = _SESSIONS.get(spark.sparkContext.applicationId)
    for scope in (*reversed(_OPEN), *([session] if session else [])):
        if key in scope.kept:
            return scope.kept[key]
    made = make()
    _scope(spark).kept[key] = made
    return made


def _remove(spark: SparkSession, scope: Scope) -> None:
    scope.kept.clear()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    while scope.paths:
        folder = hadoop(scope.paths.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that the block wrote when it ends.

    Frames that read them must be computed within the block.
    """
    _OPEN.append(Scope())
    try:
        yield
    finally:
        _remove(spark, _OPEN.pop())


def release(spark: SparkSession) -> None:
    """Remove what was written outside of any ``temporary`` block in this application.

    Frames that read it, such as results of registered queries, cannot be computed any more. It also happens
    when Python ends with the application still running.
    """
    _remove(spark, _SESSIONS.pop(spark.sparkContext.applicationId, Scope()))


@atexit.register
def _release_at_exit() -> None:
    context = SparkContext._active_spark_context
    spark = SparkSession.getActiveSession() if context and context._jsc else None
    if spark and spark.sparkContext.applicationId in _SESSIONS:
        release(spark)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Later uses neither recompute it nor lose it with an executor, and as a Parquet table it is
    compressed and read column by column. The shuffle files it was made with go at once.
    """
    spark = df.sparkSession
    path = new_path(spark, "stored")
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
