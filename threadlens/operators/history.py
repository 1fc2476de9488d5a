"""Earlier messages by the replied-to user, from shared history pages.

A reply shows everything its target wrote before it, so the histories of a user's
replies are prefixes of one another.  Each (thread, user)'s messages are stored once, in
pages of consecutive messages (``PAGE_MSGS`` message numbers), with their rendered text and the
span of rows they cover.  A reply asks for the pages that begin before it: a page that also
ends before it gives its text as it stands; one that the reply cuts is rendered
up to the cut, from the page's rows.  Messages may interleave: any page may be cut.

No list of texts grows along a scan, and what is shuffled of a history is its pages, once, plus one copy
for each chunk of ``scan.CHUNK_ROWS`` rows of the thread that has replies to the user: the
replies meet their pages under (thread, user, chunk), so that a user to whom very many rows
reply is spread over as many tasks as their replies fill chunks.  A reply's text is put
together by one aggregate on its key, in page order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CAT_ORIGINAL_POST, NO_TARGET
from ..functions.text import text_or_blank
from . import scan
from .schema import THREAD

KEY = THREAD + ["row_idx"]
PAGE_MSGS = 256


def render_messages(items: Column) -> Column:
    """``\\n- Message #{m}: "{utterances}"`` per message of ``items``: structs (msg_id,
    row_idx, s) in this order; rows whose ``s`` is null are not shown."""
    shown = F.filter(items, lambda x: x["s"].isNotNull())
    n = F.size(shown)

    def piece(x, i):
        opens = (i == 0) | (F.get(shown, i - 1)["msg_id"] != x["msg_id"])
        closes = (i == n - 1) | (F.get(shown, i + 1)["msg_id"] != x["msg_id"])
        head = F.concat(F.lit("\n- Message #"), x["msg_id"].cast("string"), F.lit(': "'))
        return F.concat(F.when(opens, head).otherwise(F.lit(" ")), x["s"], F.when(closes, F.lit('"')).otherwise(F.lit("")))

    return F.array_join(F.transform(shown, piece), "")


def history_pages(utt: DataFrame, page_msgs: int | None = None) -> DataFrame:
    """Per (thread, user: ``key``) and ``page``: ``lo``/``hi`` (first and last row), ``n`` rows,
    the sorted ``items`` (msg_id, row_idx, s) and their rendered ``text``.

    Starter rows and rows without a message number are counted, not shown (``s`` is null).
    """
    shown = F.col("msg_id").isNotNull() & ~F.coalesce(F.col("category") == CAT_ORIGINAL_POST, F.lit(False))
    page = F.floor(F.coalesce("msg_id", "row_idx") / F.lit(page_msgs or PAGE_MSGS)).cast("long")
    rows = utt.where(F.col("user_id").isNotNull()).select(
        *THREAD, F.col("user_id").cast("string").alias("key"), page.alias("page"),
        F.struct("msg_id", "row_idx", F.when(shown, text_or_blank("message")).alias("s")).alias("item"),
    )
    held = rows.groupBy(*THREAD, "key", "page").agg(F.array_sort(F.collect_list("item")).alias("items"))
    at = F.transform("items", lambda x: x["row_idx"])
    return held.select(
        *THREAD, "key", "page", F.array_min(at).alias("lo"), F.array_max(at).alias("hi"),
        F.size("items").cast("long").alias("n"), render_messages(F.col("items")).alias("text"), "items",
    )


def referred_parts(utt: DataFrame, text_if: Column | None = None, page_msgs: int | None = None) -> DataFrame:
    """For each row with a reply target: a row for every page that begins before it, with the
    ``n`` rows of the page before it and the ``part`` of the text they show (``struct(page,
    s)``; null where ``text_if`` is false).  One row with nulls if there is no such page."""
    wanted = F.lit(True) if text_if is None else F.coalesce(text_if, F.lit(False))
    chunk = F.floor(F.col("row_idx") / F.lit(scan.CHUNK_ROWS)).cast("long")
    asks = utt.where(F.col("reply_to").isNotNull() & (F.col("reply_to") != NO_TARGET)).select(
        *KEY, F.col("reply_to").alias("key"), chunk.alias("chunk"), wanted.alias("wanted")
    )
    asked = asks.groupBy(*THREAD, "key", "chunk").agg(F.max("row_idx").alias("last"))
    # a page goes to the chunks that have a reply after it begins
    copies = history_pages(utt, page_msgs).join(asked, THREAD + ["key"]).where(F.col("lo") < F.col("last")).drop("last")
    a, p = asks.alias("a"), copies.alias("p")
    same = [F.col(f"a.{c}") == F.col(f"p.{c}") for c in (*THREAD, "key", "chunk")]
    met = a.join(p, [*same, F.col("p.lo") < F.col("a.row_idx")], "left")
    whole = F.col("p.hi") < F.col("a.row_idx")
    cut = F.filter("p.items", lambda x: x["row_idx"] < F.col("a.row_idx"))
    part = F.struct(F.col("p.page").alias("page"), F.when(whole, F.col("p.text")).otherwise(render_messages(cut)).alias("s"))
    return met.select(
        *[F.col(f"a.{c}").alias(c) for c in KEY],
        F.when(whole, F.col("p.n")).otherwise(F.size(cut)).alias("n"),
        F.when(F.col("p.lo").isNotNull() & F.col("a.wanted"), part).alias("part"),
        F.col("a.wanted").alias("wanted"),
    )


def history_text(parts: Column) -> Column:
    """The text of a reply's ``parts``, in page order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["s"]), "")


def referred_messages(utt: DataFrame, text_if: Column | None = None, page_msgs: int | None = None) -> DataFrame:
    """For each row with a reply target: how many rows the target wrote before it
    (``n_before``, starter rows included) and the text of the shown ones (``referred``; null
    for rows where ``text_if`` is false)."""
    got = referred_parts(utt, text_if, page_msgs).groupBy(*KEY).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_before"),
        F.collect_list("part").alias("parts"), F.first("wanted").alias("wanted"),
    )
    return got.select(*KEY, "n_before", F.when(F.col("wanted"), history_text(F.col("parts"))).alias("referred"))
