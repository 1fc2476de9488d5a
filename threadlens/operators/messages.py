"""Message-level aggregates: ordered concatenation, sizes, first appearance.

A message is every row of a thread sharing ``msg_id``.  All aggregates here
group on ``(corpus, thread_id, msg_id)`` — a much finer key than the thread,
so one very long thread still spreads over many reducers — and collect only
``(row_idx, text)`` pairs, never whole rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_concat, text_or_blank

MSG = ["corpus", "thread_id", "msg_id"]


def message_texts(utt: DataFrame) -> DataFrame:
    """Per message: size and the two ordered concatenations.

    * ``n_utts``      A4: rows of the message, blanks included
    * ``text_all``    A1b: stripped utterances joined by one space, blanks kept
    * ``text_nonblank`` A1a: same, blank utterances dropped
    * ``first_row``   A3: row of first appearance
    """
    s = text_or_blank("message")
    items = F.collect_list(F.struct(F.col("row_idx"), s.alias("s")))
    agg = utt.where(F.col("msg_id").isNotNull()).groupBy(*MSG).agg(
        F.count(F.lit(1)).alias("n_utts"),
        F.min("row_idx").alias("first_row"),
        items.alias("items"),
    )
    return agg.select(
        *MSG,
        "n_utts",
        "first_row",
        ordered_concat(F.col("items")).alias("text_all"),
        F.array_join(
            F.filter(F.transform(F.array_sort("items"), lambda e: e["s"]), lambda x: x != ""), " "
        ).alias("text_nonblank"),
    )


def sibling_message(utt: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Every row with its message's size and full (non-blank) text."""
    texts = texts if texts is not None else message_texts(utt)
    return utt.join(texts.select(*MSG, "n_utts", "text_nonblank", "text_all"), MSG, "left")


def distinct_messages(utt: DataFrame) -> DataFrame:
    """A3: distinct messages with their first-appearance row (order by it for
    first-appearance order; an aggregate, so no thread-wide window)."""
    return utt.where(F.col("msg_id").isNotNull()).groupBy(*MSG).agg(F.min("row_idx").alias("first_row"))
