"""Schema normalisation, row ordinals and row predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CAT_ORIGINAL_POST, LAYOUT_SEQUENTIAL, LAYOUT_THREADED, NO_TARGET
from ..functions.text import py_strip

THREAD = ["corpus", "thread_id"]

# export column name -> canonical column name
EXPORT_NAMES = {
    "Msg#": "msg_id",
    "Utterance #": "utt_no",
    "Date": "date",
    "Time": "time",
    "User ID": "user_id",
    "Gender": "gender",
    "Message": "message",
    "Reply to_ID": "reply_to",
    "Category": "category",
}
# canonical order of the base columns; anything else follows unchanged
BASE_ORDER = ["msg_id", "utt_no", "date", "time", "user_id", "gender", "message", "reply_to"]
# optional columns filled with '' when an export lacks them (not date, not category)
FILLED_IF_ABSENT = ["gender", "time", "reply_to"]
REQUIRED = ["msg_id", "user_id", "message"]


def require_columns(columns: list[str]) -> None:
    """Raise when a required column is missing (``Message`` first, then the rest)."""
    cols = set(columns)
    if "message" not in cols and "Message" not in cols:
        raise ValueError("input must contain a 'Message' column")
    missing = sorted(c for c in REQUIRED if c not in cols and _export_name(c) not in cols)
    if missing:
        raise ValueError(f"input missing required column(s): {missing}")


def _export_name(canonical: str) -> str:
    for k, v in EXPORT_NAMES.items():
        if v == canonical:
            return k
    return canonical


def with_utterance_number(df: DataFrame, keys: list[str] | None = None, out: str = "utt_no") -> DataFrame:
    """Running count of rows per message, 1-based, in row order.

    A chunked scan (see ``scan.py``): a message with very many rows is
    numbered by several tasks, each adding the row counts of earlier chunks.
    """
    from .scan import Op, chunked, scan

    grp = (keys or THREAD) + ["msg_id"]
    return scan(chunked(df, grp), grp, [Op("count", "row_idx", out)]).drop("_chunk")


def canonicalise(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rename export columns, add missing optional ones, fix the column order.

    ``keys`` (default ``corpus, thread_id, row_idx``) must already be present;
    the layout is ``threaded`` when the export has a ``Category`` column.
    """
    keys = keys or THREAD + ["row_idx"]
    threaded = "Category" in df.columns or "category" in df.columns
    renamed = df.withColumnsRenamed({k: v for k, v in EXPORT_NAMES.items() if k in df.columns})
    require_columns(renamed.columns)
    missing = [c for c in FILLED_IF_ABSENT if c not in renamed.columns]
    if missing:
        renamed = renamed.withColumns({c: F.lit("") for c in missing})
    renamed = renamed.withColumn("msg_id", message_number(renamed))
    renamed = renamed.withColumn("user_id", F.col("user_id").cast("string"))
    if "utt_no" not in renamed.columns:
        renamed = with_utterance_number(renamed, [k for k in keys if k != "row_idx"])
    if "layout" not in renamed.columns:
        renamed = renamed.withColumn("layout", F.lit(LAYOUT_THREADED if threaded else LAYOUT_SEQUENTIAL))
    lead = [c for c in keys + ["layout"] if c in renamed.columns]
    base = [c for c in BASE_ORDER if c in renamed.columns]
    rest = [c for c in renamed.columns if c not in lead and c not in base]
    return renamed.select(*lead, *base, *rest)


def message_number(df: DataFrame) -> Column:
    """``msg_id`` as a whole number (text like ``7`` or ``7.0`` too), null where it is none."""
    if dict(df.dtypes)["msg_id"] != "string":
        return F.col("msg_id").cast("long")
    real = F.col("msg_id").try_cast("double")
    whole = F.when(real == F.floor(real), real.try_cast("bigint"))
    return F.coalesce(F.col("msg_id").try_cast("bigint"), whole)


MISSING_NUMBER = "missing message number"
BAD_NUMBER = "message number is not a whole number"


def split_rejects(df: DataFrame, path: str, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, rejected rows with ``reject_reason``) of an export-shaped table.

    Later steps need a message number, so rows without one are set apart.  One pass writes
    both outputs as partitions of ``path``; reading either prunes to its files.  Accepted
    rows keep their ``row_idx``.  ``raw_msg_id`` is the number as the export had it.
    """
    names = {k: v for k, v in EXPORT_NAMES.items() if k in df.columns}
    own = next((k for k, v in names.items() if v == "msg_id"), "msg_id")
    require_columns([*df.columns, *names.values()])
    made = canonicalise(df.withColumn("raw_msg_id", F.col(f"`{own}`").cast("string")), keys)
    blank = F.coalesce(py_strip(F.col("raw_msg_id")), F.lit("")) == ""
    reason = F.when(F.col("msg_id").isNull(), F.when(blank, F.lit(MISSING_NUMBER)).otherwise(F.lit(BAD_NUMBER)))
    both = made.withColumn("reject_reason", reason).withColumn("accepted", F.col("msg_id").isNotNull())
    both.write.partitionBy("accepted").parquet(path)
    stored = df.sparkSession.read.schema(both.schema).parquet(path)
    accepted = stored.where("accepted").drop("accepted", "reject_reason", "raw_msg_id")
    return accepted, stored.where("NOT accepted").drop("accepted", "msg_id")


def row_ordinal(
    df: DataFrame,
    thread_cols: list[str],
    order_cols: list[str],
    segment_col: str | None = None,
) -> DataFrame:
    """0-based ``row_idx`` within each thread by an explicit source order.

    The order must be a real column (file and row index, turn and line
    position); never ``monotonically_increasing_id``.

    With ``segment_col`` (a column whose order agrees with ``order_cols``, such
    as the source file or the turn), rows are numbered inside each
    ``(thread, segment)`` and shifted by the row count of the thread's earlier
    segments, which comes from a one-row-per-segment summary.  A thread with
    very many rows is then numbered by many tasks instead of one window.
    """
    if segment_col is None:
        w = Window.partitionBy(*thread_cols).orderBy(*order_cols)
        return df.withColumn("row_idx", (F.row_number().over(w) - 1).cast("long"))
    seg = thread_cols + [segment_col]
    local = df.withColumn("_pos", F.row_number().over(Window.partitionBy(*seg).orderBy(*order_cols)))
    counts = df.groupBy(*seg).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *seg,
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(*thread_cols).orderBy(segment_col).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    return (
        local.join(offsets, seg, "left")
        .withColumn("row_idx", (F.col("_off") + F.col("_pos") - 1).cast("long"))
        .drop("_pos", "_off")
    )


def has_reply_target(c="reply_to") -> Column:
    """A usable reply target: not null, not ``N/A``, not blank."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (col != NO_TARGET) & (py_strip(col) != "")


def replies_only(df: DataFrame) -> DataFrame:
    """P7 as a filter."""
    return df.where(has_reply_target())


def threaded_flags(df: DataFrame) -> DataFrame:
    """Per thread, whether any row has a non-blank reply target (null = blank).

    An aggregate (partial on the map side) rather than a window, so a very
    large thread does not end up as one window partition.  ``last_row``: its largest row.
    """
    return df.groupBy(*THREAD).agg(
        F.max(F.length(py_strip(F.coalesce(F.col("reply_to"), F.lit("")))) > 0).alias("threaded"), F.max("row_idx").alias("last_row")
    )


def is_thread_starter() -> Column:
    """Threaded layout -> ``Original post`` rows; sequential -> message #1."""
    return F.when(
        F.col("layout") == LAYOUT_THREADED, F.coalesce(F.col("category") == CAT_ORIGINAL_POST, F.lit(False))
    ).otherwise(F.coalesce(F.col("msg_id") == 1, F.lit(False)))


def thread_starters(df: DataFrame) -> DataFrame:
    return df.where(is_thread_starter())
