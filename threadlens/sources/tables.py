"""Reading the driver's parquet tables and the derived ``utterances`` view.

``utterances`` is the canonical input of every operator: one row per non-blank
line of a conversation turn.  A turn is a message, a conversation a thread.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.schema import row_ordinal
from ..constants import CAT_COMMENT, CAT_ORIGINAL_POST, LAYOUT_SEQUENTIAL, LAYOUT_THREADED, NO_TARGET

UTTERANCE_COLUMNS = [
    "corpus",
    "layout",
    "thread_id",
    "row_idx",
    "msg_id",
    "utt_no",
    "user_id",
    "message",
    "reply_to",
    "category",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def conversation_utterances(conversations: DataFrame) -> DataFrame:
    """Derive the ``utterances`` view from ``conversations(conv_id, turn, role, text)``.

    Even conversations use the threaded layout (corpus ``thr``), odd ones the
    sequential layout (``seq``).  Users are ``<role>_<(turn div 2) % 2>``; a turn
    replies to the previous turn's user, the thread starter's user, or ``N/A``.
    """
    conv = conversations.select("conv_id", "turn", "role", "text")

    # turn level: user, reply target, category (one row per turn, no text)
    by_conv = Window.partitionBy("conv_id")
    by_conv_ordered = by_conv.orderBy("turn")
    turns = (
        conv.select(
            "conv_id",
            "turn",
            F.concat(F.col("role"), F.lit("_"), F.expr("CAST((turn DIV 2) % 2 AS STRING)")).alias("uid"),
        )
        .withColumn("t0", F.min("turn").over(by_conv))
        .withColumn("prev_uid", F.lag("uid").over(by_conv_ordered))
        .withColumn("op_uid", F.first("uid").over(by_conv_ordered))
        .withColumn(
            "reply_to",
            F.when(F.col("turn") == F.col("t0"), F.lit(None).cast("string"))
            .when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.lit(NO_TARGET))
            .when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.col("op_uid"))
            .otherwise(F.col("prev_uid")),
        )
        .withColumn(
            "category",
            F.when(F.col("turn") == F.col("t0"), F.lit(CAT_ORIGINAL_POST))
            .when(F.col("reply_to") == F.col("op_uid"), F.lit(CAT_COMMENT))
            .otherwise(F.lit("Reply")),
        )
        .select("conv_id", "turn", "uid", "reply_to", "category")
    )

    lines = conv.select(
        "conv_id", "turn", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line")
    ).where(F.length(F.trim(F.col("line"))) > 0)

    # row_idx: lines numbered inside their turn, offset by the line counts of
    # the conversation's earlier turns (no window over a whole conversation)
    j = row_ordinal(lines.join(turns, ["conv_id", "turn"]), ["conv_id"], ["turn", "pos"], segment_col="turn")
    even = F.col("conv_id") % 2 == 0
    return j.select(
        F.when(even, F.lit("thr")).otherwise(F.lit("seq")).alias("corpus"),
        F.when(even, F.lit(LAYOUT_THREADED)).otherwise(F.lit(LAYOUT_SEQUENTIAL)).alias("layout"),
        F.col("conv_id").alias("thread_id"),
        "row_idx",
        (F.col("turn") + 1).cast("long").alias("msg_id"),
        F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")).cast("long").alias("utt_no"),
        F.col("uid").alias("user_id"),
        F.col("line").alias("message"),
        "reply_to",
        "category",
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``utterances`` view over ``<sf_dir>/conversations.parquet`` (lazy)."""
    return conversation_utterances(table(spark, sf_dir, "conversations"))


_STORED: dict[tuple, str] = {}


def utterances_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``utterances`` view written once per session and input folder to the
    shared checkpoint folder, then read back as a Parquet table.

    The operators reference their input many times; reading a stored table
    keeps the derivation (explode + windows over ``conversations``) from being
    re-run for every reference, and cuts the lineage the way a production
    input table would.
    """
    from ..session import scratch_path, shuffles_end_with_the_job, table_exists

    key = (id(spark), os.path.abspath(sf_dir))
    path = _STORED.get(key)
    if path is None or not table_exists(spark, path):
        path = scratch_path(spark, "utterances")
        # range partitioning gives evenly sized files in (thread, row) order and
        # splits a very long thread over several files instead of one writer
        n = spark.sparkContext.defaultParallelism
        dealt = utterances(spark, sf_dir).repartitionByRange(n, "corpus", "thread_id", "row_idx")
        with shuffles_end_with_the_job(spark):
            dealt.write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(path)
