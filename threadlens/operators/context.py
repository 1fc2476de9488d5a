"""Per-utterance discourse context.

Every lookup the narrative needs is one of four shapes, and none of them
builds all pairs of rows inside a thread:

* neighbour rows (W2/W3): ``lag``/``lead`` as one chunked scan over the thread;
* as-of lookups (J3/J4/J6): a running ``last(.., ignorenulls)`` (of the latest two
  different values for J3/J4) over a window keyed by ``(thread, user[, target])``;
* the referred history (J2): shared pages of each user's messages (``history``);
* the first replies (J5): the next two different messages, carried by one scan in
  reverse order, so only the two messages that are printed are ever materialised.

Reverse scans use ``ORDER BY row_idx DESC`` with an *unbounded preceding*
frame: Spark evaluates such frames incrementally (an *unbounded following*
frame would be re-aggregated for every row).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CAT_COMMENT, CAT_ORIGINAL_POST, LAYOUT_THREADED
from ..functions.text import py_strip, text_or_blank
from .history import history_text, referred_parts
from .messages import MSG, message_texts
from .scan import Op, attach, chunked, scan
from .schema import THREAD, has_reply_target, threaded_flags

KEY = THREAD + ["row_idx"]


def _s(c: Column) -> Column:
    """Render a value into a narrative: cast to text, null as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def _cat_is(value: str) -> Column:
    return F.coalesce(F.col("category") == value, F.lit(False))


# ---------------------------------------------------------------------------
# Neighbouring rows
# ---------------------------------------------------------------------------
def neighbour_rows(utt: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Previous and next row of every row (same thread): ``lag``/``lead`` as one
    chunked scan over the thread (one shuffle; a thread longer than a chunk is
    split across tasks with a carry at chunk edges).

    Columns: key, ``carry`` columns, ``has_prev, prev_user, prev_message,
    has_next, next_user, next_message`` (messages raw, as stored).
    """
    carry = carry or []
    rows = utt.select(*KEY, *carry, F.struct("user_id", "message").alias("_row"))
    nb = scan(chunked(rows, THREAD), THREAD, [Op("prev", "_row", "_p"), Op("prev", "_row", "_n", reverse=True)])
    return nb.select(
        *KEY,
        *carry,
        F.col("_p").isNotNull().alias("has_prev"),
        F.col("_p.user_id").alias("prev_user"),
        F.col("_p.message").alias("prev_message"),
        F.col("_n").isNotNull().alias("has_next"),
        F.col("_n.user_id").alias("next_user"),
        F.col("_n.message").alias("next_message"),
    )


# ---------------------------------------------------------------------------
# Reply parent (as-of join, backward)
# ---------------------------------------------------------------------------
def reply_parent(utt: DataFrame) -> DataFrame:
    """Raw message of the latest earlier row written by the row's reply target.

    Build rows are keyed by their author, probe rows by their (stripped)
    target; in one ``(thread, key)`` window ordered by row the probe sorts
    before a build row of the same row (a self-reply must not find itself).
    Returns key + ``parent_found, parent_message`` for rows with a target.
    """
    build = utt.where(F.col("user_id").isNotNull()).select(
        *KEY,
        F.col("user_id").cast("string").alias("key"),
        F.lit(1).alias("is_build"),
        F.struct(F.col("message").alias("m")).alias("val"),
    )
    probe = utt.where(has_reply_target()).select(
        *KEY,
        py_strip(F.col("reply_to")).alias("key"),
        F.lit(0).alias("is_build"),
        F.lit(None).cast("struct<m:string>").alias("val"),
    )
    grp = THREAD + ["key"]
    found = scan(chunked(build.unionByName(probe), grp), grp, [Op("last", "val", "parent")], tiebreak=["is_build"])
    return found.where(F.col("is_build") == 0).select(
        *KEY,
        F.col("parent").isNotNull().alias("parent_found"),
        F.col("parent.m").alias("parent_message"),
    )


def context_pair(utt: DataFrame) -> DataFrame:
    """``(prev_msg, next_msg)`` per row.

    Threads with any non-blank reply target use the reply parent and an empty
    next; other threads use the neighbouring rows.  Null renders as ''.
    """
    flags = threaded_flags(utt)
    parent = reply_parent(utt)
    nb = neighbour_rows(utt)
    j = attach(nb, flags, THREAD).join(parent, KEY, "left")
    threaded = F.coalesce(F.col("threaded"), F.lit(False))
    return j.select(
        *KEY,
        F.when(threaded, _s(F.col("parent_message"))).otherwise(_s(F.col("prev_message"))).alias("prev_msg"),
        F.when(threaded, F.lit("")).otherwise(_s(F.col("next_message"))).alias("next_msg"),
    )


# ---------------------------------------------------------------------------
# J3 / J4 (W4 / W5): previous / next different message by the same author
# ---------------------------------------------------------------------------
def same_author_messages(utt: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row: the last earlier and the first later message id, among rows
    with the same author and the same reply target, that differs from the row's
    own message (exact under interleaving).  A null target, author or message matches
    nothing.  Returns key, ``carry``, ``prev_same_msg, next_same_msg``; one scan."""
    usable = F.col("reply_to").isNotNull() & F.col("user_id").isNotNull() & F.col("msg_id").isNotNull()
    g = utt.select(*KEY, *carry, "user_id", "reply_to", F.when(usable, F.col("msg_id")).alias("_msg"))
    grp = THREAD + ["user_id", "reply_to"]
    found = scan(chunked(g, grp), grp, [Op("two", "_msg", "_p"), Op("two", "_msg", "_n", reverse=True)])
    return found.select(
        *KEY, *carry,
        F.when(F.col("_msg").isNotNull(), F.col("_p.second")).alias("prev_same_msg"),
        F.when(F.col("_msg").isNotNull(), F.col("_n.second")).alias("next_same_msg"),
    )


def message_lookups(utt: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """J1 + J3 + J4 as one row per answer: every row asks for its own message (``self``)
    and, where found, the same author's previous and next message (``prev``, ``next``).

    One join with the message table answers all three.  Returns key, ``role``, ``msg_id``,
    ``n_utts``, ``text`` (of the own message without blank utterances, of the others whole).
    """
    texts = texts if texts is not None else message_texts(utt)
    t = texts.select(*THREAD, "msg_id", "n_utts", "text_nonblank", "text_all")
    ask = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("msg_id"))
    asks = same_author_messages(utt, carry=("msg_id",)).select(
        *KEY, F.inline(F.array(ask("self", "msg_id"), ask("prev", "prev_same_msg"), ask("next", "next_same_msg")))
    )
    found = asks.where(F.col("msg_id").isNotNull()).join(t, THREAD + ["msg_id"])
    text = F.when(F.col("role") == "self", F.col("text_nonblank")).otherwise(F.col("text_all"))
    return found.select(*KEY, "role", "msg_id", "n_utts", text.alias("text"))


def same_author_context(utt: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """J3 + J4 with the full text (A1b) of each found message, for rows that have one."""
    found = message_lookups(utt, texts).where("role <> 'self'")
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return found.groupBy(*KEY).agg(
        pick("prev", "msg_id").alias("prev_same_msg"),
        pick("prev", "text").alias("prev_same_text"),
        pick("next", "msg_id").alias("next_same_msg"),
        pick("next", "text").alias("next_same_text"),
    )


# ---------------------------------------------------------------------------
# J5 (W6): the first two later messages replying to the row's author
# ---------------------------------------------------------------------------
def reply_events(utt: DataFrame) -> DataFrame:
    """J5 as one row per found message: key, ``slot`` (1 or 2, by first appearance), ``reply``
    (``struct(msg_id, text, user)``; ``user`` = author of the first matching row).

    Candidates (rows that reply to somebody else) and askers (authors) meet in one scan in
    reverse row order, which carries the next two candidates of different messages as ``(msg_id, user,
    start row)``.  The texts come from one join with the candidates' messages: whole, or from
    the start row on when the message began before the asking row.
    """
    s = text_or_blank("message")
    cand = utt.where(
        F.col("reply_to").isNotNull()
        & F.col("user_id").isNotNull()
        & F.col("msg_id").isNotNull()
        & (F.col("user_id") != F.col("reply_to"))
    )
    grp = THREAD + ["key"]
    info = F.struct("msg_id", F.col("user_id").alias("user"), F.col("row_idx").alias("start"))
    c = cand.select(*THREAD, F.col("reply_to").alias("key"), "row_idx", F.lit(0).alias("is_probe"), info.alias("info"))
    probe = utt.where(F.col("user_id").isNotNull()).select(
        *THREAD, F.col("user_id").cast("string").alias("key"), "row_idx", F.lit(1).alias("is_probe"),
        F.lit(None).cast(c.schema["info"].dataType).alias("info"),
    )
    both = chunked(c.unionByName(probe), grp)
    found = scan(both, grp, [Op("two", "info", "after", reverse=True, by="msg_id")], tiebreak=["is_probe"])
    slot = lambda i, c: F.struct(F.lit(i).alias("slot"), F.col(f"after.{c}").alias("hit"))
    asks = found.where("is_probe = 1").select(*KEY, "key", F.inline(F.array(slot(1, "first"), slot(2, "second"))))
    asks = asks.where(F.col("hit").isNotNull()).select(*KEY, "key", "slot", "hit", F.col("hit.msg_id").alias("msg_id"))
    msg = grp + ["msg_id"]
    items = cand.groupBy(*THREAD, F.col("reply_to").alias("key"), "msg_id").agg(
        F.array_sort(F.collect_list(F.struct("row_idx", s.alias("s")))).alias("items")
    )
    rest = F.filter("items", lambda x: x["row_idx"] >= F.col("hit.start"))
    reply = F.struct("msg_id", F.array_join(F.transform(rest, lambda x: x["s"]), " ").alias("text"), F.col("hit.user").alias("user"))
    return asks.join(items, msg).select(*KEY, "slot", reply.alias("reply"))


def replies_received(utt: DataFrame) -> DataFrame:
    """For each row: the first two distinct later messages (by first appearance
    after the row) whose rows reply to the row's author from another user.

    Only the matching rows after the row count, so a message that started
    before the row is cut to its later part.  Returns key + ``r1, r2`` (see
    :func:`reply_events`) for rows that have replies.
    """
    pick = lambda i: F.max(F.when(F.col("slot") == i, F.col("reply"))).alias(f"r{i}")
    return reply_events(utt).groupBy(*KEY).agg(pick(1), pick(2))


def render_replies(r1: Column, r2: Column) -> Column:
    """``\\n- Message #{m} from {user}: "{text}"`` for r1/r2, ascending by message."""
    both = F.array_sort(F.filter(F.array(r1, r2), lambda x: x.isNotNull()))
    return F.array_join(
        F.transform(
            both,
            lambda x: F.concat(
                F.lit("\n- Message #"), x["msg_id"].cast("string"), F.lit(" from "), _s(x["user"]),
                F.lit(': "'), x["text"], F.lit('"'),
            ),
        ),
        "",
    )


# ---------------------------------------------------------------------------
# Threaded narrative
# ---------------------------------------------------------------------------
def context_events(utt: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """What a threaded narrative is made of, one row per key: the row's own columns, its
    messages (J1, J3, J4), history (J2) and replies (J5).

    Every lookup gives typed events (key, ``kind`` and its columns); their union meets in one
    aggregate on the key, instead of each lookup being folded and joined on its own.
    """
    own = utt.select(*KEY, F.lit("row").alias("kind"), F.struct("msg_id", "user_id", "message", "reply_to", "category").alias("base"))
    messages = message_lookups(utt, texts).select(*KEY, F.col("role").alias("kind"), F.struct("msg_id", "n_utts", "text").alias("found"))
    history = referred_parts(utt, text_if=~_cat_is(CAT_COMMENT)).select(*KEY, F.lit("history").alias("kind"), "n", "part")
    replies = reply_events(utt).select(*KEY, F.concat(F.lit("r"), F.col("slot")).alias("kind"), "reply")
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [messages, history, replies], own)
    of = lambda kind, c: F.first(F.when(F.col("kind") == kind, F.col(c)), ignorenulls=True)
    got = events.groupBy(*KEY).agg(
        of("row", "base").alias("base"), of("self", "found").alias("own"), of("prev", "found").alias("prev"), of("next", "found").alias("next"),
        F.sum("n").alias("n_before"), F.collect_list("part").alias("parts"), of("r1", "reply").alias("r1"), of("r2", "reply").alias("r2"),
    )
    return got.select(
        *KEY, "base.*", F.col("own.n_utts").alias("n_utts"), F.col("own.text").alias("text_nonblank"),
        F.col("prev.msg_id").alias("prev_same_msg"), F.col("prev.text").alias("prev_same_text"),
        F.col("next.msg_id").alias("next_same_msg"), F.col("next.text").alias("next_same_text"),
        "n_before", history_text(F.col("parts")).alias("referred"), "r1", "r2",
    )


def context_threaded(utt: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The local-context narrative of every row (threaded layout)."""
    j = context_events(utt, texts)
    rid = F.col("row_idx").cast("string")
    user = _s(F.col("user_id"))
    reply_to = _s(F.col("reply_to"))
    head = F.concat(
        F.lit("We will be annotating Utterance #"), rid, F.lit(" from Message #"), _s(F.col("msg_id")),
        F.lit(" by "), user, F.lit(':\n"'), text_or_blank("message"), F.lit('"\n'), F.lit("\n**Local Context**:"),
    )
    siblings = F.when(
        F.col("n_utts") > 1,
        F.when(
            _cat_is(CAT_ORIGINAL_POST),
            F.lit("\nThe Utterance is part of the thread message. Read the full thread starter message for context."),
        ).otherwise(
            F.concat(
                F.lit('\nThis utterance is part of the full message:\n"'), F.col("text_nonblank"),
                F.lit('"\n\nYou are asked only to annotate the Utterance #'), rid, F.lit('".'),
            )
        ),
    )
    referred = F.when(
        F.col("n_before") > 0,
        F.when(
            _cat_is(CAT_COMMENT),
            F.concat(
                F.lit("\nUtterance #"), rid, F.lit(' is a comment on the original post by "'), reply_to,
                F.lit('". Read the thread starter message for the context.'),
            ),
        ).otherwise(
            F.concat(
                F.lit("\nUtterance #"), rid, F.lit(' is a reply to user "'), reply_to,
                F.lit('". The following earlier messages by '), reply_to,
                F.lit(" may help contextualize the reply:"), F.col("referred"),
            )
        ),
    )
    not_op = ~_cat_is(CAT_ORIGINAL_POST)
    prev_same = F.when(
        not_op & F.col("prev_same_msg").isNotNull(),
        F.concat(
            F.lit("\n\nPrevious message from "), user, F.lit(" in this thread:\n- Message #"),
            F.col("prev_same_msg").cast("string"), F.lit(': "'), _s(F.col("prev_same_text")), F.lit('"'),
        ),
    )
    next_same = F.when(
        not_op & F.col("next_same_msg").isNotNull(),
        F.concat(
            F.lit("\n\nNext message from "), user, F.lit(" in this thread:\n- Message #"),
            F.col("next_same_msg").cast("string"), F.lit(': "'), _s(F.col("next_same_text")), F.lit('"'),
        ),
    )
    replies = F.when(
        F.col("r1").isNotNull(),
        F.concat(
            F.lit("\n\nOther users replied to "), user, F.lit(" afterward. Here are some such replies:"),
            render_replies(F.col("r1"), F.col("r2")),
        ),
    )
    parts = [head, siblings, referred, prev_same, next_same, replies]
    return j.select(*KEY, F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("narrative"))


# ---------------------------------------------------------------------------
# Sequential narrative
# ---------------------------------------------------------------------------
def context_sequential(utt: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The local-context narrative of every row (sequential layout)."""
    texts = texts if texts is not None else message_texts(utt)
    nb = neighbour_rows(utt, carry=["msg_id", "utt_no", "user_id", "message"])
    j = nb.join(texts.select(*MSG, "text_nonblank"), MSG, "left")
    text = text_or_blank("message")
    body = F.concat(
        F.lit("**Local Context**: We will be annotating Utterance #"), _s(F.col("msg_id")), F.lit(" (#"),
        _s(F.col("utt_no")), F.lit(") from "), _s(F.col("user_id")), F.lit(':\n"'), text, F.lit('"\n'),
        F.lit("The full message is:\n"), _s(F.col("text_nonblank")),
        F.lit('\n\nYou are asked only to annotate the utterance "'), text, F.lit('".'),
    )
    prev = F.when(
        F.col("has_prev"),
        F.concat(
            F.lit("\nThis follows the previous message from "), _s(F.col("prev_user")), F.lit(':\n"'),
            text_or_blank("prev_message"), F.lit('"'),
        ),
    )
    nxt = F.when(
        F.col("has_next"),
        F.concat(
            F.lit("\n\nIt is followed by a message from "), _s(F.col("next_user")), F.lit(':\n"'),
            text_or_blank("next_message"), F.lit('"'),
        ),
    )
    return j.select(
        *KEY, F.concat(body, F.coalesce(prev, F.lit("")), F.coalesce(nxt, F.lit(""))).alias("narrative")
    )


# ---------------------------------------------------------------------------
# P5: layout router
# ---------------------------------------------------------------------------
def local_context(utt: DataFrame) -> DataFrame:
    """Narrative of every row, routed by layout (C1 for threaded, C2 otherwise).

    Each branch only sees its own threads, so the layout filter is pushed
    below every join and window of the branch.
    """
    thr = utt.where(F.col("layout") == LAYOUT_THREADED)
    seq = utt.where(F.col("layout") != LAYOUT_THREADED)
    return context_threaded(thr).unionByName(context_sequential(seq))
