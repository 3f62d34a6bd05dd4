"""Intermediate tables that cut lineage and survive the loss of executors.

Tables go to the folder that the cluster names in ``spark.checkpoint.dir``; only where the
setting is absent (tests, a laptop) is a temporary folder used.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get(
        "spark.checkpoint.dir", ""
    )
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = getattr(spark.sparkContext, "_tamarack_shared_dir", None)
    if fallback is None:
        fallback = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._tamarack_shared_dir = fallback
    return fallback


_scopes: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, or below that of the innermost :func:`scratch`."""
    scopes = _scopes.get(spark.sparkContext.applicationId)
    return f"{scopes[-1] if scopes else shared_dir(spark) + '/tamarack'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go when it ends: read or write results before that.

    Results are lazy, so that operators can't tell when their tables aren't read any more; the caller can.
    """
    scopes = _scopes.setdefault(spark.sparkContext.applicationId, [])
    folder = f"{shared_dir(spark)}/tamarack/scratch-{uuid.uuid4().hex}"
    scopes.append(folder)
    try:
        yield folder
    finally:
        scopes.remove(folder)
        _delete(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark then removes the shuffle files of a query when it ends; what it wrote is all that is needed.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers = threading.Lock(), {"n": 0, "before": "false"}


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """The setting is on from the first writer's begin to the last one's end, whichever threads they run in."""
    with _lock:
        if not _writers["n"]:
            _writers["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(_CLEANUP, _writers["before"])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    with _cleaned_up(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tamarack_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "_tamarack_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def broadcast_if_small(table: DataFrame, most_rows: int, weight: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast where it is counted to hold at most ``most_rows`` rows.

    Beyond that it is left as it is, and its joins shuffle. Rows must be of a few hundred bytes at most;
    where they hold arrays, ``weight`` gives the size of these in such units, which is added.
    """
    rows = table.count() if weight is None else table.agg(F.sum(weight + 1)).first()[0] or 0
    return F.broadcast(table) if rows <= most_rows else table


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as a shuffle has, and three for each core at least.

    For work that costs much more than the reading of a row: Spark cuts files by their bytes, so that a small file of very many
    rows, or one with a single row group, is one task. Select the columns that are needed before.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
