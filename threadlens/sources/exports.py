"""Utterance exports (one sheet per thread) in, canonical utterances out.

An export folder holds one layout: ``threaded`` exports have a ``Category``
column (``Msg#, Category, User ID, Reply to_ID, Message``), ``sequential``
ones do not (``Msg#, Utterance #, User ID, Message[, Reply to_ID]``).  Threads
are the ``corpus=<c>/thread_id=<t>`` sub-folders; the row order is the order
of the rows in the files, taken from Parquet's ``_metadata`` (file, row index)
— never from ``monotonically_increasing_id``.  CSV/JSON exports carry no row
index, so they must name an explicit order column and its (numeric or time) type;
text sorts ``m10`` before ``m2`` and is refused.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import canonicalise, row_ordinal

THREADED_EXPORT = ["Msg#", "Category", "User ID", "Reply to_ID", "Message"]
SEQUENTIAL_EXPORT = ["Msg#", "Utterance #", "User ID", "Message", "Reply to_ID"]
_CANON = {
    "Msg#": "msg_id",
    "Category": "category",
    "User ID": "user_id",
    "Reply to_ID": "reply_to",
    "Message": "message",
    "Utterance #": "utt_no",
}


def write_exports(utt: DataFrame, path: str) -> None:
    """Write canonical utterances as per-thread exports under ``path/<layout>``.

    ``repartitionByRange`` on (corpus, thread, row) keeps each file's rows in
    order and splits a very long thread over several files whose names follow
    the range order.  The number of ranges is set: by the rows' bytes Spark would write a
    small table's many files, one after the other, in a task or two.
    """
    ranges = int(utt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for layout, cols in (("threaded", THREADED_EXPORT), ("sequential", SEQUENTIAL_EXPORT)):
        part = utt.where(F.col("layout") == layout)
        sel = [F.col(_CANON[c]).alias(c) for c in cols]
        (
            part.repartitionByRange(ranges, "corpus", "thread_id", "row_idx")
            .sortWithinPartitions("corpus", "thread_id", "row_idx")
            .select("corpus", "thread_id", *sel)
            .write.mode("overwrite")
            .partitionBy("corpus", "thread_id")
            .parquet(os.path.join(path, layout))
        )


ORDER_TYPES = ("int", "bigint", "double", "date", "timestamp")


def read_export_folder(
    spark: SparkSession, path: str, fmt: str = "parquet", order_col: str | None = None, order_type: str = "bigint"
) -> DataFrame:
    """One export folder -> canonical utterances (layout from the columns).

    CSV and JSON: rows are ordered by ``order_col`` read as ``order_type``; a value that is
    not of that type fails the job.  Empty CSV cells are nulls.
    """
    segment = None
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        order = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
        segment = "_o0"  # each file is a segment: numbered locally, offset by earlier files
    else:
        if not order_col:
            raise ValueError(f"{fmt} exports need an explicit order column")
        if order_type not in ORDER_TYPES:
            raise ValueError(f"order column as {order_type!r}: it must be one of {', '.join(ORDER_TYPES)}")
        # every column as text: types must not depend on which rows inference sees
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "")
        raw = reader.csv(path) if fmt == "csv" else spark.read.option("primitivesAsString", True).json(path)
        value = F.col(order_col).cast("string")
        typed = F.expr(f"try_cast(`{order_col}` AS {order_type})")
        wrong = F.concat(F.lit("order column: not a valid value: "), F.coalesce(value, F.lit("null")))
        order = [F.when(typed.isNull(), F.raise_error(wrong).cast(order_type)).otherwise(typed)]
        for c in ("Msg#", "Utterance #"):
            if c in raw.columns:
                raw = raw.withColumn(c, F.col(f"`{c}`").cast("bigint"))
    raw = raw.withColumn("thread_id", F.col("thread_id").cast("long"))
    with_order = raw.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    ordered = row_ordinal(with_order, ["corpus", "thread_id"], [f"_o{i}" for i in range(len(order))], segment)
    ordered = ordered.drop(*[f"_o{i}" for i in range(len(order))])
    return canonicalise(ordered)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Both layout folders written by :func:`write_exports`, unioned."""
    thr = read_export_folder(spark, os.path.join(path, "threaded"))
    seq = read_export_folder(spark, os.path.join(path, "sequential"))
    return thr.unionByName(seq, allowMissingColumns=True)
