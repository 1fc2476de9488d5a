"""Prompt assets, global context and prompt assembly."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    BACKGROUND_SEQUENTIAL,
    BACKGROUND_THREADED,
    FORMAT_BLOCK,
    LAYOUT_SEQUENTIAL,
    LAYOUT_THREADED,
    REASONING_BLOCK,
    REASONING_O3_EXTRA,
    TASK_INSTRUCTION,
    THREAD_STARTERS_HEADER,
)
from ..functions.text import py_strip
from .context import KEY, local_context
from .scan import attach
from .schema import THREAD, is_thread_starter

DEFAULT_SYSTEM_PROMPT = os.path.join(os.path.dirname(os.path.dirname(__file__)), "assets", "system_prompt.md")
DEFAULT_MODEL = "gpt-4o-2024-08-06"


# -- S3: assets ----------------------------------------------------------------------
def read_system_prompt(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The system prompt file as one row ``system_prompt`` (whole text, stripped).

    A shared-storage URI (``hdfs://``, ``s3a://``, ...) is read by Spark as one
    whole-text row; a file on the driver (the packaged default) is read by the
    driver, since executors do not have it.
    """
    path = path or DEFAULT_SYSTEM_PROMPT
    if "://" in path:
        return spark.read.text(path, wholetext=True).select(py_strip(F.col("value")).alias("system_prompt"))
    if not os.path.exists(path):
        raise ValueError(f"System prompt not specified (no file at {path}).")
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    return spark.createDataFrame([(text,)], "value string").select(py_strip(F.col("value")).alias("system_prompt"))


def system_prompt_text(spark: SparkSession, path: str | None = None) -> str:
    """The stripped system prompt as a string: a single small asset, handed to
    the generator as a parameter instead of being copied into every row."""
    return read_system_prompt(spark, path).first()["system_prompt"]


def backgrounds(spark: SparkSession) -> DataFrame:
    """Background narrative per layout (two rows, fixed values)."""
    return spark.createDataFrame(
        [(LAYOUT_SEQUENTIAL, BACKGROUND_SEQUENTIAL), (LAYOUT_THREADED, BACKGROUND_THREADED)],
        "layout string, background string",
    )


# -- A2 + J10: global context ----------------------------------------------------------
def starter_texts(utt: DataFrame) -> DataFrame:
    """Per starter message, its utterances (raw, nulls dropped) joined by a space."""
    st = utt.where(is_thread_starter() & F.col("msg_id").isNotNull())
    return st.groupBy(*THREAD, "msg_id").agg(
        F.min("row_idx").alias("first_row"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("row_idx", F.col("message").alias("s"))))),
                lambda e: e["s"],
            ),
            " ",
        ).alias("text"),
    )


def thread_contexts(utt: DataFrame, bg: DataFrame | None = None, on: str = "layout") -> DataFrame:
    """:func:`global_context` with each thread's largest row (``last_row``)."""
    lines = starter_texts(utt).groupBy(*THREAD).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_row", F.concat(F.lit("- "), F.col("text")).alias("s")))),
                lambda e: e["s"],
            ),
            "\n",
        ).alias("starter_lines")
    )
    threads = utt.groupBy(*THREAD, on).agg(F.max("row_idx").alias("last_row"))
    # the built-in table has two rows; of a caller's table the planner knows the size
    told = bg if bg is not None else F.broadcast(backgrounds(utt.sparkSession))
    j = threads.join(lines, THREAD, "left").join(told, on, "left")
    return j.select(
        *THREAD,
        "last_row",
        F.concat(
            F.coalesce(F.col("background"), F.lit("")),
            F.lit("\n\n" + THREAD_STARTERS_HEADER + "\n"),
            F.coalesce(F.col("starter_lines"), F.lit("")),
        ).alias("global_context"),
    )


def global_context(utt: DataFrame, bg: DataFrame | None = None, on: str = "layout") -> DataFrame:
    """A2: per thread, ``background ⏎⏎ Thread starter messages: ⏎ - <msg> ...`` with
    starter messages in first-appearance order.  Only starter rows are shuffled
    for the text."""
    return thread_contexts(utt, bg, on).drop("last_row")


# -- C4: prompts -----------------------------------------------------------------------
def reasoning_block(model: str) -> str:
    tag = model.split("-")[0] if "-" in model else model
    return REASONING_BLOCK + (REASONING_O3_EXTRA if tag == "o3" else "")


def user_prompts(
    utt: DataFrame,
    model: str = DEFAULT_MODEL,
    narratives: DataFrame | None = None,
    bg: DataFrame | None = None,
) -> DataFrame:
    """C4: the user message of every row: task ⏎⏎ global ⏎⏎ narrative ⏎ reasoning ⏎ format.

    A thread's context meets its rows under (thread, chunk), so a hot thread is many tasks.
    Returns key + ``user_prompt``.  The system message is the same for every row
    and is attached only where a full chat transcript is needed (X13).
    """
    narratives = narratives if narratives is not None else local_context(utt)
    j = attach(narratives, thread_contexts(utt, bg), THREAD)
    return j.select(
        *KEY,
        F.concat(
            F.lit(TASK_INSTRUCTION + "\n\n"),
            py_strip(F.coalesce(F.col("global_context"), F.lit(""))),
            F.lit("\n\n"),
            F.col("narrative"),
            F.lit("\n" + reasoning_block(model) + "\n" + FORMAT_BLOCK),
        ).alias("user_prompt"),
    )
