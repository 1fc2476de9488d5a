"""Registered queries: one per operator key of the blueprint's inventory.

Every query reads the driver's tables (``conversations`` through the derived
``utterances`` view, or tables Spark derives from it) and runs over all of
them.  ``ORACLE`` holds the matching DuckDB statement where one exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BACKGROUND_SEQUENTIAL, BACKGROUND_THREADED, DEFAULT_MAX_TRIES
from ..constants import ALLOWED_META, ALLOWED_NON_BONA_FIDE, ANNOT_CLOSE, ANNOT_OPEN, REASON_CLOSE, REASON_OPEN
from ..functions.json import first_text_part, objects, once, prompt_json
from ..functions.text import between_tags, clean_tag_list, is_policy_error, py_strip
from ..operators import context as C
from ..operators import messages as M
from ..operators import schema as P
from ..operators.history import referred_messages
from ..operators.attempts import resolve_attempts, winning_attempts
from ..operators.output import annotated_output, attach_annotations, read_run, run_id, run_stamp, write_annotations
from ..operators.parse import parse_responses, politeness_code, politeness_ok
from ..operators.prompts import global_context, starter_texts, system_prompt_text, user_prompts
from ..operators.resume import blank_annotations, classify_prior, merge_annotations, read_annotations, resume_merge, todo_rows
from ..operators.summary import debug_sample, run_summary
from ..operators.generate import StubGenerator, generate, with_backend
from ..session import scratch_path
from ..sources.exports import read_exports, write_exports
from ..sources.tables import table, utterances_table
from . import oracle as O
from .runs import prior_output, stub_run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEY = C.KEY
THREAD = P.THREAD


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _utt(spark, sf_dir):
    return utterances_table(spark, sf_dir)


def _stub_attempts(spark, sf_dir, tries: int = DEFAULT_MAX_TRIES) -> DataFrame:
    """Stub generator output for every row's stored prompt and attempts 0 .. tries - 1 (no rounds)."""
    prompts = stub_run(spark, sf_dir).prompts
    if tries > 1:
        # a row is many attempts: dealt evenly, whatever the sizes of the stored files
        prompts = prompts.repartition(*KEY)
    return generate(prompts, StubGenerator(), tries=tries)


W = O.with_ctes
_TEXT_COLUMNS = ["annotation_act", "annotation_politeness", "annotation_meta", "annotation_NBF", "annotation_reasoning"]

# =============================================================================
# S: sources and sinks
# =============================================================================


@query(
    "read_utterances",
    W() + "SELECT corpus, layout, thread_id, row_idx, msg_id, utt_no, user_id, message, reply_to, "
    "CASE WHEN layout = 'threaded' THEN category END AS category FROM utterances",
)
def q_read_utterances(spark, sf_dir):
    """Export one file per thread, read the folder back into the canonical table."""
    path = scratch_path(spark, "exports")
    write_exports(_utt(spark, sf_dir), path)
    return read_exports(spark, path).select(*_utt(spark, sf_dir).columns)


@query(
    "read_annotations",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, "
    + ", ".join(f"CASE WHEN (thread_id + row_idx) % 4 = 0 THEN '' ELSE {c} END AS {c}" for c in _TEXT_COLUMNS)
    + ", CASE WHEN (thread_id + row_idx) % 4 <> 0 THEN coalesce(response, '') ELSE '' END AS raw_response"
    + ", CASE WHEN (thread_id + row_idx) % 4 <> 0 THEN CAST(annotation_seed AS VARCHAR) END AS annotation_seed"
    + ", CASE WHEN (thread_id + row_idx) % 4 <> 0 THEN ts END AS annotation_timestamp FROM resolved",
)
def q_read_annotations(spark, sf_dir):
    """Write a previous output (prior-run fixture) and read it back."""
    path = scratch_path(spark, "prior")
    prior_output(stub_run(spark, sf_dir)).write.mode("overwrite").parquet(path)
    back = read_annotations(spark, path).withColumn("annotation_seed", F.col("annotation_seed").cast("string"))
    return back.select(*KEY, *_TEXT_COLUMNS, "raw_response", "annotation_seed", "annotation_timestamp")


@query(
    "prompt_assets",
    W() + f"SELECT DISTINCT layout, {O.system_prompt_sql()} AS system_prompt, "
    f"CASE layout WHEN 'threaded' THEN {O.lit(BACKGROUND_THREADED)} ELSE {O.lit(BACKGROUND_SEQUENTIAL)} END AS background FROM utterances",
)
def q_prompt_assets(spark, sf_dir):
    """S3: the prompt assets per layout in use (system prompt file + background)."""
    from ..operators.prompts import backgrounds

    layouts = _utt(spark, sf_dir).select("layout").distinct()
    system = system_prompt_text(spark)  # one small asset file, read once
    j = layouts.join(F.broadcast(backgrounds(spark)), "layout", "left")
    return j.select("layout", F.lit(system).alias("system_prompt"), "background")


@query(
    "write_annotations",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, " + ", ".join(_TEXT_COLUMNS) + ", coalesce(response, '') AS raw_response, "
    "annotation_seed, f AS format FROM resolved CROSS JOIN (SELECT unnest(['csv', 'parquet']) AS f)",
)
def q_write_annotations(spark, sf_dir):
    """An older run, the output with its CSV export and a run that never ended, read back: the newest complete one."""
    run = stub_run(spark, sf_dir)
    base = scratch_path(spark, "output")
    rid = run_id(sf_dir, "gpt-4o-2024-08-06", run_stamp())
    write_annotations(blank_annotations(run.output(), F.lit(True)), base, f"{rid}_before")
    write_annotations(run.output(), base, rid, csv=True)
    run.utt.limit(1).write.parquet(f"{base}/table/run_id={rid}_died/corpus=x")
    cols = [*KEY, *_TEXT_COLUMNS, "raw_response", "annotation_seed"]
    table = read_run(spark, base)
    text = read_annotations(spark, f"{base}/csv/run_id={rid}", "csv").select(*cols)
    typed = text.select(*[F.col(c).cast(t).alias(c) for c, t in table.select(*cols).dtypes])
    both = table.select(*cols, F.lit("parquet").alias("format")).unionByName(typed.withColumn("format", F.lit("csv")))
    return both.select("*")


# =============================================================================
# P: projections, schema, predicates
# =============================================================================
_CANON_COLS = ["corpus", "layout", "thread_id", "row_idx", "msg_id", "utt_no", "time", "user_id", "gender", "message", "reply_to", "category"]


@query(
    "canonical_utterances",
    W()
    + "SELECT corpus, layout, thread_id, row_idx, msg_id, utt_no, '' AS time, user_id, '' AS gender, message, "
    "CASE WHEN layout = 'threaded' THEN reply_to ELSE '' END AS reply_to, "
    "CASE WHEN layout = 'threaded' THEN category END AS category FROM utterances",
)
def q_canonical_utterances(spark, sf_dir):
    """Export-shaped frames of both layouts -> canonical schema."""
    u = _utt(spark, sf_dir)
    thr = u.where(F.col("layout") == "threaded").select(
        "corpus", "thread_id", "row_idx",
        F.col("msg_id").alias("Msg#"), F.col("category").alias("Category"), F.col("user_id").alias("User ID"),
        F.col("reply_to").alias("Reply to_ID"), F.col("message").alias("Message"),
    )
    seq = u.where(F.col("layout") != "threaded").select(
        "corpus", "thread_id", "row_idx",
        F.col("msg_id").alias("Msg#"), F.col("utt_no").alias("Utterance #"), F.col("user_id").alias("User ID"),
        F.col("message").alias("Message"),
    )
    a = P.canonicalise(thr)
    b = P.canonicalise(seq).withColumn("category", F.lit(None).cast("string"))
    return a.unionByName(b, allowMissingColumns=True).select(*_CANON_COLS)


_NUMBER = "CASE WHEN (thread_id * 7 + row_idx) % 13 = 0 THEN NULL WHEN (thread_id + row_idx) % 17 = 0 THEN 'n/a' ELSE concat(msg_id, '.0') END"


@query(
    "rejected_rows",
    W()
    + f"SELECT corpus, thread_id, row_idx, CASE WHEN m IS NULL THEN 'missing message number' WHEN m = 'n/a' THEN 'message number is not a whole number' END "
    f"AS reject_reason, CASE WHEN m <> 'n/a' THEN msg_id ELSE -1 END AS msg_id, m AS raw_msg_id FROM (SELECT *, {_NUMBER} AS m FROM utterances)",
)
def q_rejected_rows(spark, sf_dir):
    """Exports with missing and bad message numbers, set apart in one pass; both outputs."""
    export = _utt(spark, sf_dir).withColumn("Msg#", F.expr(_NUMBER)).withColumnsRenamed({"user_id": "User ID", "message": "Message"})
    accepted, rejected = P.split_rejects(export.drop("msg_id"), scratch_path(spark, "rejects"))
    good = accepted.select(*KEY, "msg_id", F.concat(F.col("msg_id").cast("string"), F.lit(".0")).alias("raw_msg_id"))
    bad = rejected.select(*KEY, "reject_reason", "raw_msg_id")
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.select(*KEY, "reject_reason", F.coalesce("msg_id", F.lit(-1)).alias("msg_id"), "raw_msg_id")


@query(
    "utterance_number",
    W() + "SELECT a.corpus, a.thread_id, a.row_idx, CAST(count(*) AS BIGINT) AS utt_no FROM utterances a JOIN utterances b "
    "ON b.corpus = a.corpus AND b.thread_id = a.thread_id AND b.msg_id = a.msg_id AND b.row_idx <= a.row_idx GROUP BY ALL",
)
def q_utterance_number(spark, sf_dir):
    """Running utterance count per message."""
    u = _utt(spark, sf_dir).drop("utt_no")
    return P.with_utterance_number(u).select(*KEY, "utt_no")


@query(
    "row_ordinal",
    "WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, "
    "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations) "
    "SELECT conv_id AS thread_id, turn, CAST(pos AS BIGINT) AS pos, "
    "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS BIGINT) AS row_idx FROM l",
)
def q_row_ordinal(spark, sf_dir):
    """0-based line ordinal within each conversation by (turn, line position)."""
    conv = table(spark, sf_dir, "conversations")
    lines = conv.select(
        F.col("conv_id").alias("thread_id"), "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).select("thread_id", "turn", F.col("pos").cast("long").alias("pos"))
    return P.row_ordinal(lines, ["thread_id"], ["turn", "pos"], segment_col="turn")


@query(
    "layout_route",
    W(*O.prompts_ctes())
    + "SELECT n.corpus, n.thread_id, n.row_idx, u.layout, n.narrative FROM narratives n JOIN utterances u "
    "ON u.corpus = n.corpus AND u.thread_id = n.thread_id AND u.row_idx = n.row_idx",
)
def q_layout_route(spark, sf_dir):
    """P5: narratives routed by layout (C1 for threaded threads, C2 otherwise)."""
    u = _utt(spark, sf_dir)
    return C.local_context(u).join(u.select(*KEY, "layout"), KEY).select(*KEY, "layout", "narrative")


@query(
    "threaded_flag",
    W() + f"SELECT corpus, thread_id, bool_or(length({O.S('reply_to')}) > 0) AS threaded FROM utterances GROUP BY ALL",
)
def q_threaded_flag(spark, sf_dir):
    """Threads with any non-blank reply target."""
    return P.threaded_flags(_utt(spark, sf_dir)).drop("last_row")


@query(
    "replies_only",
    W() + f"SELECT corpus, thread_id, row_idx, reply_to FROM utterances WHERE reply_to IS NOT NULL AND reply_to <> 'N/A' AND {O.strip('reply_to')} <> ''",
)
def q_replies_only(spark, sf_dir):
    """Rows with a usable reply target."""
    return P.replies_only(_utt(spark, sf_dir)).select(*KEY, "reply_to")


@query(
    "thread_starters",
    W() + "SELECT corpus, thread_id, row_idx, msg_id, message FROM utterances WHERE "
    "CASE WHEN layout = 'threaded' THEN coalesce(category = 'Original post', false) ELSE coalesce(msg_id = 1, false) END",
)
def q_thread_starters(spark, sf_dir):
    """Thread-starter rows."""
    return P.thread_starters(_utt(spark, sf_dir)).select(*KEY, "msg_id", "message")


@query(
    "completion_status",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, CASE WHEN (thread_id + row_idx) % 4 = 0 THEN 'todo' "
    "WHEN status = 'ok' THEN 'done' ELSE 'terminal' END AS prior_status FROM resolved",
)
def q_completion_status(spark, sf_dir):
    """Classify each row of a previous output."""
    return classify_prior(prior_output(stub_run(spark, sf_dir)))


# =============================================================================
# J: joins
# =============================================================================
@query(
    "sibling_message",
    W(O.MSG_TEXTS) + "SELECT u.corpus, u.thread_id, u.row_idx, m.n_utts, m.text_nonblank FROM utterances u "
    "JOIN msg_texts m ON m.corpus = u.corpus AND m.thread_id = u.thread_id AND m.msg_id = u.msg_id",
)
def q_sibling_message(spark, sf_dir):
    """Each row with its message size and full text."""
    return M.sibling_message(_utt(spark, sf_dir)).select(*KEY, "n_utts", "text_nonblank")


_REF_ALL = f"""
ref_rows AS (
 SELECT a.corpus, a.thread_id, a.row_idx, b.msg_id, b.row_idx AS b_row, {O.S('b.message')} AS s, b.category AS b_cat
 FROM utterances a JOIN utterances b ON b.corpus = a.corpus AND b.thread_id = a.thread_id AND b.user_id = a.reply_to AND b.row_idx < a.row_idx),
ref_grp AS (SELECT corpus, thread_id, row_idx, msg_id, string_agg(s, ' ' ORDER BY b_row) AS txt
            FROM ref_rows WHERE coalesce(b_cat, '') <> 'Original post' GROUP BY ALL),
ref_list AS (SELECT corpus, thread_id, row_idx, string_agg(concat(chr(10), '- Message #', msg_id, ': "', txt, '"'), '' ORDER BY msg_id) AS lst
             FROM ref_grp GROUP BY ALL)
"""


@query(
    "referred_messages",
    W(_REF_ALL)
    + "SELECT a.corpus, a.thread_id, a.row_idx, CAST((SELECT count(*) FROM ref_rows r WHERE r.corpus = a.corpus AND r.thread_id = a.thread_id "
    "AND r.row_idx = a.row_idx) AS BIGINT) AS n_before, coalesce(l.lst, '') AS referred FROM utterances a "
    "LEFT JOIN ref_list l ON l.corpus = a.corpus AND l.thread_id = a.thread_id AND l.row_idx = a.row_idx "
    "WHERE a.reply_to IS NOT NULL AND a.reply_to <> 'N/A'",
)
def q_referred_messages(spark, sf_dir):
    """Earlier messages by the replied-to user (count and rendered list)."""
    return referred_messages(_utt(spark, sf_dir))


def _same_author_sql(direction: str) -> str:
    op, agg, name = ("<", "arg_max", "prev") if direction == "prev" else (">", "arg_min", "next")
    return (
        W(O.MSG_TEXTS)
        + f", sa AS (SELECT a.corpus, a.thread_id, a.row_idx, {agg}(b.msg_id, b.row_idx) AS m FROM utterances a JOIN utterances b "
        f"ON b.corpus = a.corpus AND b.thread_id = a.thread_id AND b.user_id = a.user_id AND b.reply_to = a.reply_to "
        f"AND b.row_idx {op} a.row_idx AND b.msg_id <> a.msg_id GROUP BY ALL) "
        f"SELECT sa.corpus, sa.thread_id, sa.row_idx, sa.m AS {name}_same_msg, t.text_all AS {name}_same_text FROM sa "
        f"JOIN msg_texts t ON t.corpus = sa.corpus AND t.thread_id = sa.thread_id AND t.msg_id = sa.m"
    )


@query("prev_same_author", _same_author_sql("prev"))
def q_prev_same_author(spark, sf_dir):
    """Last earlier different message by the same author to the same target."""
    r = C.same_author_context(_utt(spark, sf_dir))
    return r.where(F.col("prev_same_msg").isNotNull()).select(*KEY, "prev_same_msg", "prev_same_text")


@query("next_same_author", _same_author_sql("next"))
def q_next_same_author(spark, sf_dir):
    """First later different message by the same author to the same target."""
    r = C.same_author_context(_utt(spark, sf_dir))
    return r.where(F.col("next_same_msg").isNotNull()).select(*KEY, "next_same_msg", "next_same_text")


@query(
    "replies_received",
    W()
    + f""", rep_rows AS (
 SELECT a.corpus, a.thread_id, a.row_idx, b.msg_id, b.row_idx AS b_row, b.user_id AS b_user, {O.S('b.message')} AS s
 FROM utterances a JOIN utterances b ON b.corpus = a.corpus AND b.thread_id = a.thread_id AND b.reply_to = a.user_id
      AND b.row_idx > a.row_idx AND b.user_id <> a.user_id),
rep_msgs AS (SELECT corpus, thread_id, row_idx, msg_id, min(b_row) AS first_b, arg_min(b_user, b_row) AS who,
                    string_agg(s, ' ' ORDER BY b_row) AS txt FROM rep_rows GROUP BY ALL),
rep_top AS (SELECT *, row_number() OVER (PARTITION BY corpus, thread_id, row_idx ORDER BY first_b) AS rk FROM rep_msgs)
SELECT corpus, thread_id, row_idx, CAST(count(*) AS BIGINT) AS n_messages,
       string_agg(concat(chr(10), '- Message #', msg_id, ' from ', who, ': "', txt, '"'), '' ORDER BY msg_id) AS replies
FROM rep_top WHERE rk <= 2 GROUP BY ALL""",
)
def q_replies_received(spark, sf_dir):
    """The first two later messages replying to the row's author."""
    r = C.replies_received(_utt(spark, sf_dir))
    return r.select(
        *KEY,
        F.when(F.col("r2").isNull(), F.lit(1)).otherwise(F.lit(2)).cast("long").alias("n_messages"),
        C.render_replies(F.col("r1"), F.col("r2")).alias("replies"),
    )


@query(
    "reply_parent",
    W()
    + f"SELECT a.corpus, a.thread_id, a.row_idx, (SELECT count(*) FROM utterances b WHERE b.corpus = a.corpus AND b.thread_id = a.thread_id "
    f"AND b.row_idx < a.row_idx AND b.user_id = {O.strip('a.reply_to')}) > 0 AS parent_found, "
    f"(SELECT arg_max(coalesce(b.message, ''), b.row_idx) FROM utterances b WHERE b.corpus = a.corpus AND b.thread_id = a.thread_id "
    f"AND b.row_idx < a.row_idx AND b.user_id = {O.strip('a.reply_to')}) AS parent_message "
    f"FROM utterances a WHERE a.reply_to IS NOT NULL AND a.reply_to <> 'N/A' AND {O.strip('a.reply_to')} <> ''",
)
def q_reply_parent(spark, sf_dir):
    """As-of join to the latest earlier row of the reply target."""
    r = C.reply_parent(_utt(spark, sf_dir))
    return r.select(*KEY, "parent_found", F.coalesce(F.col("parent_message"), F.when(F.col("parent_found"), F.lit(""))).alias("parent_message"))


_OUT_TEXT = "annotation_act, annotation_politeness, annotation_meta, annotation_NBF, annotation_reasoning"
# rows kept from the earlier run say so in their reasoning; the new run's rows do not
_MERGED_TEXT = _OUT_TEXT.replace(
    "annotation_reasoning",
    "CASE WHEN (thread_id + row_idx) % 4 <> 0 AND annotation_reasoning <> '' THEN concat('prior: ', annotation_reasoning) "
    "ELSE annotation_reasoning END AS annotation_reasoning",
)


def _told_apart(prior: DataFrame) -> DataFrame:
    said = F.col("annotation_reasoning")
    return prior.withColumn("annotation_reasoning", F.when(said != "", F.concat(F.lit("prior: "), said)).otherwise(said))


@query(
    "attach_annotations",
    W(O.STUB, O.PARSED)
    + f"SELECT u.*, {_OUT_TEXT}, annotation_seed FROM utterances u JOIN resolved r "
    "ON r.corpus = u.corpus AND r.thread_id = u.thread_id AND r.row_idx = u.row_idx",
)
def q_attach_annotations(spark, sf_dir):
    """Utterances left-joined with their resolved annotations."""
    run = stub_run(spark, sf_dir)
    return attach_annotations(run.utt, run.resolved)


@query(
    "winning_attempts",
    W(O.STUB, O.PARSED)
    + "SELECT l.corpus, l.thread_id, l.row_idx, l.attempt, l.seed, l.response FROM ledger l JOIN resolved r "
    "ON r.corpus = l.corpus AND r.thread_id = l.thread_id AND r.row_idx = l.row_idx AND r.annotation_seed = l.seed "
    "WHERE r.status = 'ok'",
)
def q_winning_attempts(spark, sf_dir):
    """The raw attempt that produced each annotation."""
    run = stub_run(spark, sf_dir)
    return winning_attempts(run.ledger, run.resolved).select(*KEY, "attempt", "seed", "response")


@query("todo_rows", W() + "SELECT corpus, thread_id, row_idx FROM utterances WHERE (thread_id + row_idx) % 4 = 0")
def q_todo_rows(spark, sf_dir):
    """Rows of a previous output that still need annotating."""
    run = stub_run(spark, sf_dir)
    return todo_rows(run.utt, prior_output(run)).select(*KEY)


@query(
    "with_background",
    W(O.STARTERS, O.GLOBAL) + "SELECT corpus, thread_id, layout, background FROM global_ctx",
)
def q_with_background(spark, sf_dir):
    """Background narrative per thread (broadcast join with the asset table)."""
    from ..operators.prompts import backgrounds

    t = _utt(spark, sf_dir).select(*THREAD, "layout").distinct()
    return t.join(F.broadcast(backgrounds(spark)), "layout", "left").select(*THREAD, "layout", "background")


# =============================================================================
# A: aggregations
# =============================================================================
@query("message_text_nonblank", W(O.MSG_TEXTS) + "SELECT corpus, thread_id, msg_id, text_nonblank FROM msg_texts")
def q_message_text_nonblank(spark, sf_dir):
    """Ordered concatenation, blanks dropped."""
    return M.message_texts(_utt(spark, sf_dir)).select(*M.MSG, "text_nonblank")


@query("message_text_all", W(O.MSG_TEXTS) + "SELECT corpus, thread_id, msg_id, text_all FROM msg_texts")
def q_message_text_all(spark, sf_dir):
    """Ordered concatenation, blanks kept."""
    return M.message_texts(_utt(spark, sf_dir)).select(*M.MSG, "text_all")


@query(
    "starter_text",
    W(O.STARTERS) + "SELECT corpus, thread_id, msg_id, first_row, text FROM starter_msgs",
)
def q_starter_text(spark, sf_dir):
    """Thread-starter messages (raw utterances, nulls dropped)."""
    return starter_texts(_utt(spark, sf_dir))


@query(
    "global_context",
    W(O.STARTERS, O.GLOBAL) + "SELECT corpus, thread_id, global_context FROM global_ctx",
)
def q_global_context(spark, sf_dir):
    """A2: per-thread background and thread-starter list."""
    return global_context(_utt(spark, sf_dir))


@query(
    "distinct_messages",
    W() + "SELECT corpus, thread_id, msg_id, CAST(min(row_idx) AS BIGINT) AS first_row FROM utterances GROUP BY ALL",
)
def q_distinct_messages(spark, sf_dir):
    """A3: distinct messages with their first-appearance row."""
    return M.distinct_messages(_utt(spark, sf_dir))


@query("message_sizes", W(O.MSG_TEXTS) + "SELECT corpus, thread_id, msg_id, n_utts FROM msg_texts")
def q_message_sizes(spark, sf_dir):
    """A4: utterances per message."""
    return M.message_texts(_utt(spark, sf_dir)).select(*M.MSG, "n_utts")


@query(
    "run_summary",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, CAST(count_if(annotation_act NOT IN ('__FAILED__', '__FLAGGED__')) AS BIGINT) AS annotated, "
    "CAST(count_if(annotation_act = '__FAILED__') AS BIGINT) AS failed, CAST(count_if(annotation_act = '__FLAGGED__') AS BIGINT) AS flagged, "
    "CAST(count(*) AS BIGINT) AS total, round_even(count_if(annotation_act NOT IN ('__FAILED__', '__FLAGGED__')) * 100.0 / count(*), 1) AS success_pct "
    "FROM resolved GROUP BY corpus",
)
def q_run_summary(spark, sf_dir):
    """A5: run summary per corpus."""
    return run_summary(stub_run(spark, sf_dir).resolved, by=["corpus"])


# =============================================================================
# W / T: windows, sort / limit
# =============================================================================
@query(
    "prev_row",
    W() + "SELECT a.corpus, a.thread_id, a.row_idx, b.user_id AS prev_user, b.message AS prev_message FROM utterances a "
    "JOIN utterances b ON b.corpus = a.corpus AND b.thread_id = a.thread_id AND b.row_idx = a.row_idx - 1",
)
def q_prev_row(spark, sf_dir):
    """Previous row's user and message."""
    return C.neighbour_rows(_utt(spark, sf_dir)).where("has_prev").select(*KEY, "prev_user", "prev_message")


@query(
    "next_row",
    W() + "SELECT a.corpus, a.thread_id, a.row_idx, b.user_id AS next_user, b.message AS next_message FROM utterances a "
    "JOIN utterances b ON b.corpus = a.corpus AND b.thread_id = a.thread_id AND b.row_idx = a.row_idx + 1",
)
def q_next_row(spark, sf_dir):
    """Next row's user and message."""
    return C.neighbour_rows(_utt(spark, sf_dir)).where("has_next").select(*KEY, "next_user", "next_message")


@query(
    "debug_sample",
    W() + "SELECT corpus, thread_id, row_idx, message FROM utterances ORDER BY corpus, thread_id, row_idx LIMIT 20",
)
def q_debug_sample(spark, sf_dir):
    """The first 20 pending rows of a fresh run."""
    return debug_sample(_utt(spark, sf_dir).select(*KEY, "message"))


# =============================================================================
# U: set operations
# =============================================================================
@query("merged_annotations", W(O.STUB, O.PARSED) + f"SELECT corpus, thread_id, row_idx, {_MERGED_TEXT}, annotation_seed FROM resolved")
def q_merged_annotations(spark, sf_dir):
    """Previous output + a re-run of its todo rows, last result wins."""
    run = stub_run(spark, sf_dir)
    prior = _told_apart(prior_output(run))
    todo = todo_rows(run.utt, prior).select(*KEY)
    new = run.output().join(todo, KEY, "left_semi")
    return merge_annotations(prior, new).select(*KEY, *_OUT_TEXT.split(", "), "annotation_seed")


# =============================================================================
# X: scalar functions (on the stub responses)
# =============================================================================
@query("clean_text", W() + f"SELECT corpus, thread_id, row_idx, {O.strip('message')} AS clean FROM utterances")
def q_clean_text(spark, sf_dir):
    """Python-style whitespace strip."""
    return _utt(spark, sf_dir).select(*KEY, py_strip(F.col("message")).alias("clean"))


_ATT = ["corpus", "thread_id", "row_idx", "attempt"]


@query(
    "tag_blocks",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, attempt, reasoning AS reason_block, js AS annot_block FROM p2 WHERE response IS NOT NULL",
)
def q_tag_blocks(spark, sf_dir):
    """Reason and annotation blocks of every stub response."""
    g = _stub_attempts(spark, sf_dir).where(F.col("response").isNotNull())
    return g.select(
        *_ATT,
        F.coalesce(between_tags(F.col("response"), REASON_OPEN, REASON_CLOSE), F.lit("")).alias("reason_block"),
        between_tags(F.col("response"), ANNOT_OPEN, ANNOT_CLOSE).alias("annot_block"),
    )


@query(
    "politeness_codes",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, attempt, pol_v AS politeness, "
    "(pol_v = '' OR split_part(pol_v, ' ', 1) IN ('+P', '+N', '-P', '-N')) AS politeness_ok FROM p3 WHERE j IS NOT NULL",
)
def q_politeness_codes(spark, sf_dir):
    """Dash-normalised politeness and its validity."""
    g = objects(_stub_attempts(spark, sf_dir), between_tags(F.col("response"), ANNOT_OPEN, ANNOT_CLOSE), "j")
    pol = g.select(*_ATT, politeness_code(F.col("j.politeness")).alias("politeness"))
    return pol.withColumn("politeness_ok", politeness_ok(F.col("politeness")))


@query(
    "meta_tags",
    W(O.STUB, O.PARSED) + "SELECT corpus, thread_id, row_idx, attempt, meta_v AS meta, nbf_v AS nbf FROM parsed WHERE j_ok",
)
def q_meta_tags(spark, sf_dir):
    """Cleaned meta-act and non-bona-fide tag lists."""
    from ..functions.json import variant_text

    g = objects(_stub_attempts(spark, sf_dir), between_tags(F.col("response"), ANNOT_OPEN, ANNOT_CLOSE), "j")
    meta = clean_tag_list(py_strip(variant_text(F.col("j.`self/reported`"))), ALLOWED_META)
    nbf = clean_tag_list(py_strip(variant_text(F.col("j.`non-bona fide`"))), ALLOWED_NON_BONA_FIDE)
    return g.select(*_ATT, meta.alias("meta"), nbf.alias("nbf"))


@query(
    "valid_acts",
    W(O.STUB, O.PARSED)
    + f"SELECT corpus, thread_id, row_idx, attempt, act_v AS act, coalesce(act_v IN ({O.ACTS_SQL}), false) AS act_ok FROM p3 WHERE j IS NOT NULL",
)
def q_valid_acts(spark, sf_dir):
    """Act value and domain membership."""
    from ..constants import ALLOWED_ACTS
    from ..functions.json import variant_string

    g = objects(_stub_attempts(spark, sf_dir), between_tags(F.col("response"), ANNOT_OPEN, ANNOT_CLOSE), "j")
    act = g.select(*_ATT, py_strip(variant_string(F.col("j.act"))).alias("act"))
    return act.withColumn("act_ok", F.coalesce(F.col("act").isin(ALLOWED_ACTS), F.lit(False)))


@query(
    "reasoning_ok",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, attempt, CAST(length(reasoning) AS BIGINT) AS reason_chars, length(reasoning) >= 20 AS reasoning_ok "
    "FROM parsed WHERE response IS NOT NULL",
)
def q_reasoning_ok(spark, sf_dir):
    """Reasoning length in code points and the 20-character minimum."""
    g = _stub_attempts(spark, sf_dir).where(F.col("response").isNotNull())
    r = F.coalesce(between_tags(F.col("response"), REASON_OPEN, REASON_CLOSE), F.lit(""))
    return g.select(*_ATT, F.char_length(r).cast("long").alias("reason_chars"), (F.char_length(r) >= 20).alias("reasoning_ok"))


@query(
    "error_class",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, attempt, error, outcome AS error_class FROM parsed WHERE error IS NOT NULL",
)
def q_error_class(spark, sf_dir):
    """Policy refusals (terminal) vs other errors (retried)."""
    g = _stub_attempts(spark, sf_dir).where(F.col("error").isNotNull())
    return g.select(*_ATT, "error", F.when(is_policy_error(F.col("error")), F.lit("flagged")).otherwise(F.lit("api_error")).alias("error_class"))


@query(
    "annotation_json",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, attempt, j IS NOT NULL AS json_ok, "
    "CASE WHEN j IS NOT NULL THEN coalesce(json_type(j, '$.\"non-bona fide\"'), 'MISSING') END AS nbf_type FROM p2 WHERE js IS NOT NULL",
)
def q_annotation_json(spark, sf_dir):
    """Strict JSON-object parse of the annotation block (validity and the
    JSON type of the non-bona-fide value, which decides how it is read)."""
    from ..functions.json import parse_json_object

    g = _stub_attempts(spark, sf_dir).withColumn("js", between_tags(F.col("response"), ANNOT_OPEN, ANNOT_CLOSE))
    g = g.where(F.col("js").isNotNull()).withColumn("j", parse_json_object(F.col("js")))
    kind = lambda t: F.when(t == "VOID", F.lit("NULL")).when(t == "STRING", F.lit("VARCHAR")).otherwise(t)
    nbf = F.col("j.`non-bona fide`")
    dtype = F.when(nbf.isNull(), F.lit("MISSING")).otherwise(once(F.schema_of_variant(nbf), kind))
    return g.select(*_ATT, F.col("j").isNotNull().alias("json_ok"), F.when(F.col("j").isNotNull(), dtype).alias("nbf_type"))


@query(
    "prompt_json",
    W(*O.prompts_ctes()) + f"SELECT corpus, thread_id, row_idx, {O.prompt_json_sql('user_prompt')} AS raw_prompt FROM prompts",
)
def q_prompt_json(spark, sf_dir):
    """The chat transcript of every row as JSON text."""
    u = _utt(spark, sf_dir)
    system = system_prompt_text(spark)
    return user_prompts(u).select(*KEY, prompt_json(F.lit(system), F.col("user_prompt")).alias("raw_prompt"))


@query(
    "attempt_schedule",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, attempt, seed, outcome, CAST(pow(2, attempt) AS DOUBLE) AS backoff_s FROM ledger",
)
def q_attempt_schedule(spark, sf_dir):
    """X16 + ledger: every attempt actually made, with its seed and backoff."""
    return stub_run(spark, sf_dir).ledger.select(*_ATT, "seed", "outcome", "backoff_s")


# =============================================================================
# F: the generator boundary
# =============================================================================
@query(
    "generate_stub",
    W(O.STUB) + "SELECT corpus, thread_id, row_idx, attempt, seed, response, error FROM stub WHERE attempt = 0",
)
def q_generate_stub(spark, sf_dir):
    """one stub generation per row (attempt 0) through mapInPandas."""
    return _stub_attempts(spark, sf_dir, 1).select(*_ATT, "seed", "response", "error")


_MODELS = ["gpt-4o-2024-08-06", "o3-2025-04-16", "claude-sonnet-4", "gemini-2.5-pro", "meta-llama/Llama-3.1-8B"]
_MODEL_SQL = f"CASE thread_id % {len(_MODELS)} " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODELS)) + " END"


@query(
    "backend_params",
    W()
    + f""", routed AS (SELECT corpus, thread_id, row_idx, {_MODEL_SQL} AS model FROM utterances),
b AS (SELECT *, CASE WHEN model LIKE 'gpt-%' OR model LIKE 'o3-%' THEN 'openai' WHEN model LIKE 'claude-%' THEN 'anthropic'
  WHEN model LIKE 'gemini-%' THEN 'gemini' WHEN lower(model) LIKE '%llama%' THEN 'llama' END AS backend FROM routed)
SELECT corpus, thread_id, row_idx, model, backend,
  CAST(CASE backend WHEN 'openai' THEN 0.6 WHEN 'llama' THEN 0.6 WHEN 'anthropic' THEN 0 WHEN 'gemini' THEN 0 END AS DOUBLE) AS temperature,
  CAST(CASE backend WHEN 'openai' THEN 0.9 WHEN 'llama' THEN 0.9 WHEN 'anthropic' THEN 1 WHEN 'gemini' THEN 1 END AS DOUBLE) AS top_p,
  CAST(CASE WHEN backend = 'llama' THEN 1024 WHEN backend IS NOT NULL THEN 10240 END AS INTEGER) AS max_tokens,
  CASE WHEN backend IS NOT NULL THEN backend IN ('openai', 'llama') END AS sends_seed,
  CASE WHEN backend IS NOT NULL THEN backend = 'gemini' END AS flat_prompt FROM b""",
)
def q_backend_params(spark, sf_dir):
    """Every utterance's thread routed to a model's backend, with its settings."""
    u = _utt(spark, sf_dir).select(*KEY)
    models = F.array(*map(F.lit, _MODELS))
    routed = with_backend(u.withColumn("model", F.get(models, (F.col("thread_id") % len(_MODELS)).cast("int"))))
    return routed.select(*KEY, "model", "backend", "temperature", "top_p", "max_tokens", "sends_seed", "flat_prompt")


@query(
    "first_text_part",
    W(O.STUB)
    + f"SELECT corpus, thread_id, row_idx, attempt, CASE WHEN row_idx % 3 = 2 THEN '' ELSE {O.strip('coalesce(response, chr(32))')} END AS answer "
    "FROM stub WHERE attempt = 0",
)
def q_first_text_part(spark, sf_dir):
    """The first text part of nested answers (an empty part first, the text in the
    first or second candidate, or no candidate at all)."""
    part = lambda *t: F.struct(F.struct(F.array(*[F.struct(x.alias("text")) for x in t]).alias("parts")).alias("content"))
    empty, text = F.lit(""), F.col("response")
    kind = F.col("row_idx") % 3
    nested = F.when(kind == 0, F.array(part(empty, text))).when(kind == 1, F.array(part(empty, empty), part(text, text)))
    nested = F.coalesce(nested, F.array().cast("array<struct<content:struct<parts:array<struct<text:string>>>>>"))
    return _stub_attempts(spark, sf_dir, 1).select(*_ATT, first_text_part(nested).alias("answer"))


# =============================================================================
# C: composite operators
# =============================================================================
@query("context_threaded", W(O.MSG_TEXTS, O.CONTEXT_THREADED) + "SELECT * FROM context_threaded")
def q_context_threaded(spark, sf_dir):
    """Threaded narratives."""
    return C.context_threaded(_utt(spark, sf_dir).where(F.col("layout") == "threaded"))


@query("context_sequential", W(O.MSG_TEXTS, O.CONTEXT_SEQUENTIAL) + "SELECT * FROM context_sequential")
def q_context_sequential(spark, sf_dir):
    """Sequential narratives."""
    return C.context_sequential(_utt(spark, sf_dir).where(F.col("layout") != "threaded"))


@query(
    "context_pair",
    W()
    + f""", flags AS (SELECT corpus, thread_id, bool_or(length({O.S('reply_to')}) > 0) AS threaded FROM utterances GROUP BY ALL)
SELECT a.corpus, a.thread_id, a.row_idx,
  CASE WHEN f.threaded THEN coalesce((SELECT arg_max(coalesce(b.message, ''), b.row_idx) FROM utterances b WHERE b.corpus = a.corpus
         AND b.thread_id = a.thread_id AND b.row_idx < a.row_idx AND a.reply_to IS NOT NULL AND a.reply_to <> 'N/A'
         AND {O.strip('a.reply_to')} <> '' AND b.user_id = {O.strip('a.reply_to')}), '')
       ELSE coalesce((SELECT b.message FROM utterances b WHERE b.corpus = a.corpus AND b.thread_id = a.thread_id AND b.row_idx = a.row_idx - 1), '') END AS prev_msg,
  CASE WHEN f.threaded THEN '' ELSE coalesce((SELECT b.message FROM utterances b WHERE b.corpus = a.corpus AND b.thread_id = a.thread_id
         AND b.row_idx = a.row_idx + 1), '') END AS next_msg
FROM utterances a JOIN flags f ON f.corpus = a.corpus AND f.thread_id = a.thread_id""",
)
def q_context_pair(spark, sf_dir):
    """(prev, next) message pair per row."""
    return C.context_pair(_utt(spark, sf_dir))


@query("prompts", W(*O.prompts_ctes()) + "SELECT corpus, thread_id, row_idx, user_prompt FROM prompts")
def q_prompts(spark, sf_dir):
    """C4: the user prompt of every row."""
    return user_prompts(_utt(spark, sf_dir))


@query(
    "parse_responses",
    W(O.STUB, O.PARSED)
    + "SELECT corpus, thread_id, row_idx, attempt, outcome, CASE WHEN outcome = 'ok' THEN act_v END AS act, "
    "CASE WHEN outcome = 'ok' THEN pol_v END AS politeness, CASE WHEN outcome = 'ok' THEN meta_v END AS meta, "
    "CASE WHEN outcome = 'ok' THEN nbf_v END AS nbf, reasoning FROM parsed WHERE response IS NOT NULL",
)
def q_parse_responses(spark, sf_dir):
    """Parse and validate every stub response."""
    g = _stub_attempts(spark, sf_dir).where(F.col("response").isNotNull())
    return parse_responses(g).select(*_ATT, "outcome", "act", "politeness", "meta", "nbf", "reasoning")


_RESOLVED_COLS = (
    "corpus, thread_id, row_idx, status, annotation_act, annotation_politeness, annotation_meta, annotation_NBF, "
    "annotation_reasoning, annotation_seed, n_attempts"
)


_RESOLVED_SQL = _RESOLVED_COLS.replace(
    "n_attempts", f"CAST(coalesce(decided_attempt + 1, {DEFAULT_MAX_TRIES}) AS BIGINT) AS n_attempts"
)


@query("annotate", W(O.STUB, O.PARSED) + f"SELECT {_RESOLVED_SQL} FROM resolved")
def q_annotate(spark, sf_dir):
    """Retry rounds with the stub generator, resolved per row."""
    return stub_run(spark, sf_dir).resolved.select(*_RESOLVED_COLS.split(", "))


@query("resolve_attempts", W(O.STUB, O.PARSED) + f"SELECT {_RESOLVED_SQL} FROM resolved")
def q_resolve_attempts(spark, sf_dir):
    """Resolution of a ledger holding every attempt of every row."""
    from ..operators.attempts import classify_attempts

    ledger = classify_attempts(_stub_attempts(spark, sf_dir))
    return resolve_attempts(_utt(spark, sf_dir), ledger).select(*_RESOLVED_COLS.split(", "))


@query(
    "annotated_output",
    W(O.STUB, O.PARSED, *O.prompts_ctes())
    + f"SELECT u.*, r.annotation_act, r.annotation_politeness, r.annotation_meta, r.annotation_NBF, r.annotation_reasoning, "
    f"CASE WHEN r.status = 'ok' THEN {O.prompt_json_sql('p.user_prompt')} ELSE '' END AS raw_prompt, "
    "coalesce(r.response, '') AS raw_response, r.annotation_seed, r.ts AS annotation_timestamp "
    "FROM utterances u JOIN resolved r ON r.corpus = u.corpus AND r.thread_id = u.thread_id AND r.row_idx = u.row_idx "
    "LEFT JOIN prompts p ON p.corpus = u.corpus AND p.thread_id = u.thread_id AND p.row_idx = u.row_idx",
)
def q_annotated_output(spark, sf_dir):
    """The full output table."""
    return stub_run(spark, sf_dir).output()


@query(
    "resume_merge",
    W(O.STUB, O.PARSED) + f"SELECT corpus, thread_id, row_idx, {_MERGED_TEXT}, annotation_seed FROM resolved",
)
def q_resume_merge(spark, sf_dir):
    """Resume from a previous output: annotate only its todo rows, merge."""
    from ..operators.attempts import annotate as run_annotate

    run = stub_run(spark, sf_dir)
    prior = _told_apart(prior_output(run))
    todo = todo_rows(run.utt, prior)
    prompts = run.prompts.join(todo.select(*KEY), KEY, "left_semi")
    resolved, _ = run_annotate(prompts, StubGenerator(), run.system_prompt, work_dir=scratch_path(spark, "resume"))
    new = annotated_output(todo, resolved, run.prompts, run.system_prompt)
    return resume_merge(prior, new).select(*KEY, *_OUT_TEXT.split(", "), "annotation_seed")


# =============================================================================
# ST: streaming
# =============================================================================
@query("annotate_stream", W(O.STUB, O.PARSED) + f"SELECT {_RESOLVED_SQL} FROM resolved")
def q_annotate_stream(spark, sf_dir):
    """ST1: incremental annotation of materialised prompts (availableNow trigger)."""
    from ..streaming.annotate_stream import annotate_stream

    run = stub_run(spark, sf_dir)
    work = scratch_path(spark, "stream")
    return annotate_stream(
        spark, f"{run.work_dir}/prompts", StubGenerator(), run.system_prompt, work, files_per_trigger=4
    ).select(*_RESOLVED_COLS.split(", "))
