"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import checkpoint_dir, ship_package

# the white space that separates words, as a character list and as a pattern
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mark_of(df: DataFrame) -> str:
    """What names of added columns begin with: ``_``, or more of them if a column of ``df`` begins so."""
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def clear_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` for tables whose columns may have the names of its own ones.

    Columns of the input that begin with ``_`` have other names while the operator runs and
    come back as they were; the ``_name`` columns it adds begin with ``mark_of`` the input.
    """

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        mark = mark_of(docs)
        if mark == "_":
            return operator(docs, *args, **options)
        prefix = "in"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "_in"
        other = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        given = lambda v: other.get(v, v) if isinstance(v, str) else v
        got = operator(
            docs.withColumnsRenamed(other), *map(given, args), **{k: given(v) for k, v in options.items()}
        )
        back = {new: old for old, new in other.items()}
        return got.toDF(*[back.get(c) or (mark + c[1:] if c.startswith("_") else c) for c in got.columns])

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Cuts the lineage with files that every executor sees, so a lost executor
    costs only its running tasks, and what is read twice is computed once.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    _scopes()[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those with the lowest hash of ``keys``.

    The hash is cut at a share computed from the count before rows are ordered, so that all
    partitions together, not each, bring about ``n``.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    cut = min(1.0, (1.1 * n + 1000) / max(1, df.count()))
    return df.where(place < F.lit(int(cut * (1 << 30)))).orderBy(place, *keys).limit(n)


def largest(df: DataFrame, n: int, column: str, *ties: str) -> DataFrame:
    """The ``n`` rows with the largest numbers in ``column``, of equals those with the least ``ties``.

    As in ``hash_sample``, an approximate quantile leaves about ``n`` rows to be ordered.
    """
    total = df.count()
    if total > 2 * n:
        least = df.agg(F.percentile_approx(column, 1 - 1.2 * n / total, 10_000).alias("q")).first().q
        df = df.where(F.col(column) >= least)
    return df.orderBy(F.desc(column), *ties).limit(n)


_LOCAL = threading.local()


def _scopes() -> list[list[str]]:
    """Paths stored in each open ``scratch`` of this thread; the first list is what no one frees."""
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = [[]]
    return _LOCAL.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Frees at its end what is ``stored`` inside it, but for tables made by the function it gives.

    That function stores a result, which then needs none of the freed tables, for
    whoever is outside.  Only folders that ``stored`` made itself are deleted.
    """
    paths: list[str] = []
    _scopes().append(paths)

    def keep(df: DataFrame, name: str) -> DataFrame:
        got = stored(df, name)
        _scopes()[-2].append(paths.pop())
        return got

    try:
        yield keep
    finally:
        _scopes().pop()
        files = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            at = files(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ready(spark: SparkSession) -> None:
    """Checkpoint folder set and this package importable in Python workers."""
    checkpoint_dir(spark)
    ship_package(spark)


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def map_arrow(
    df: DataFrame, added: list[tuple[str, T.DataType]], columns: Callable[[pa.RecordBatch], list], size: int = 8_000_000
) -> DataFrame:
    """``df`` plus columns that ``columns`` makes from some ``size`` bytes of rows at a time.

    Rows pass through as Arrow, in slices, so that what Python holds stays small
    whatever the session's batch size.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size):
            yield pa.RecordBatch.from_arrays([*part.columns, *columns(part)], names)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, one row at least."""
    for batch in batches:
        rows = max(1, int(size * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_MADE: dict = {}


class per_worker:
    """A value broadcast to all executors, and what each worker process makes of it once.

    For values whose size is bounded by their kind (a vocabulary, a model).
    """

    def __init__(self, spark: SparkSession, value):
        self.key, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def get(self, make: Callable, *args):
        """``make(value, *args)``, made once in this process."""
        if (self.key, make, args) not in _MADE:
            # what earlier stages left in this process goes, so that memories don't add up
            for old in [k for k in _MADE if k[0] != self.key and k[1] is make] + list(_MADE)[:-2]:
                _MADE.pop(old, None)
            _MADE[self.key, make, args] = make(self.broadcast.value, *args)
        return _MADE[self.key, make, args]
