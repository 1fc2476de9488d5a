"""Spark session helpers.

Library code never creates its own session: every operator takes the caller's
``SparkSession`` (or a DataFrame bound to it).  ``local_session`` exists for tests
and the benchmark only.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins at run time (coalescing small
# shuffle partitions, splitting skewed ones); the Arrow settings size the batches
# handed to a text generator inside mapInPandas.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a join on (thread_id, user_id) may reuse a hash partitioning on thread_id
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


# Spark's own default for the bytes of an Arrow batch, and what a generator's worker gets instead: it
# holds a batch several times (Arrow, pandas, the batch before), in wider characters than the UTF-8 that is counted
_ARROW_BYTES, _ARROW_DEFAULT, _ARROW_SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def bound_arrow_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB in this session, unless it was given a size of its own.

    Spark has no such setting per query, only the session's, read when a query runs.
    """
    if spark.conf.get(_ARROW_BYTES) == f"{_ARROW_DEFAULT}b":
        spark.conf.set(_ARROW_BYTES, f"{_ARROW_SMALL}b")


@contextmanager
def _set_to(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_end_with_the_job(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of what is written inside go when it is written.

    Else they stay until the driver happens to collect its garbage, and the shuffles of one stored table
    add to those of the next.  For writes only: what is run once more would have to be shuffled anew.
    """
    return _set_to(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def row_by_row(spark: SparkSession) -> AbstractContextManager[None]:
    """Parquet files that a write inside reads are read by the row: a batch of 4096 long texts may not fit in memory."""
    return _set_to(spark, "spark.sql.parquet.enableVectorizedReader", "false")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``threadlens`` importable in the executors' Python workers.

    The generator runs inside ``mapInPandas``; its class is pickled by
    reference, so workers must import this package.  The package is zipped
    once per application and added with ``addPyFile`` (Spark distributes it
    to every executor, including ones started later).
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="threadlens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, files in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in files:
                if f.endswith((".py", ".md")):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "threadlens",
    driver_memory: str = "8g",
) -> SparkSession:
    """Session for tests and the benchmark (``local[cores]``, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared filesystem every
    executor sees), and it must be set.  Only a local master (tests), where all tasks
    share one machine, may fall back to a folder under the system's temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="threadlens-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{os.getpid()}-{next(_COUNTER)}")


def mark_complete(spark: SparkSession, path: str) -> None:
    """Leave a marker at ``path``: what it stands for is written in full."""
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether :func:`mark_complete` was called for ``path``."""
    marker = read_if_there(spark, path, "id bigint")
    return marker is not None and not marker.isEmpty()


def read_if_there(spark: SparkSession, path: str, schema: str, **options) -> DataFrame | None:
    """The Parquet table at ``path``, read by ``schema`` (no job infers it); None without a folder."""
    try:
        return spark.read.options(**options).schema(schema).parquet(path)
    except AnalysisException:
        return None


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether any readable Parquet file is at ``path`` (it may be part of a table)."""
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def _counter():
    i = 0
    while True:
        i += 1
        yield i


_COUNTER = _counter()
