"""Resuming from a previous run's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import OUTPUT_COLUMNS, STATUS_FAILED, STATUS_FLAGGED
from ..functions.text import py_strip
from .context import KEY
from .schema import THREAD

STATUS_MARKERS = [STATUS_FAILED, STATUS_FLAGGED]
WORD_ROWS = 64  # rows of a thread whose completion is one long


def read_annotations(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """A previous output table (Parquet; CSV only as an import, where an
    empty cell must stay '' rather than null)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", None)
        .csv(path)
    )


def _filled(c: str) -> Column:
    return F.coalesce(py_strip(F.col(c).cast("string")), F.lit("")) != ""


def completion_status(prior: DataFrame) -> Column:
    """``done`` (act not blank/status, reasoning and raw response present),
    ``terminal`` (act is a status marker), else ``todo``.  Null counts as blank."""
    act = F.coalesce(py_strip(F.col("annotation_act")), F.lit(""))
    done = (act != "") & ~act.isin(STATUS_MARKERS) & _filled("annotation_reasoning") & _filled("raw_response")
    return F.when(done, F.lit("done")).when(act.isin(STATUS_MARKERS), F.lit("terminal")).otherwise(F.lit("todo"))


def classify_prior(prior: DataFrame, retry_failed: bool = False) -> DataFrame:
    """key + ``prior_status`` for every row of a previous output."""
    st = completion_status(prior)
    if retry_failed:
        st = F.when(st == "terminal", F.lit("todo")).otherwise(st)
    return prior.select(*KEY, st.alias("prior_status"))


def todo_rows(utt: DataFrame, prior: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Utterances still to annotate = all rows minus completed ones.

    A thread's completed rows are exact bitmaps, one number for 64 rows, so that what is
    shuffled of a previous run is a value per (thread, 64 rows) instead of a key per row, and the
    rows test their bit.  A hot thread is as many keys as it has such words.
    """
    completed = classify_prior(prior, retry_failed).where(F.col("prior_status") != "todo")
    done = completed.groupBy(*THREAD, _word().alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({_BIT} AS int))")).alias("_done"))
    tested = utt.withColumn("_word", _word()).join(done, [*THREAD, "_word"], "left")
    bit = F.expr(f"shiftright(_done, cast({_BIT} AS int)) & 1L")
    return tested.where(F.coalesce(bit, F.lit(0)) == 0).select(*utt.columns)


_BIT = f"pmod(row_idx, {WORD_ROWS})"


def _word() -> Column:
    return F.floor(F.col("row_idx") / F.lit(WORD_ROWS)).cast("long")


def merge_annotations(*outputs: DataFrame) -> DataFrame:
    """U2+U3: union of several runs' rows (oldest first); per key the last run
    with a completed (or status) row wins, otherwise the newest row.

    An aggregate, not a window: of a key's rows only the winner so far is kept, before
    the shuffle as well.
    """
    tagged = [o.withColumn("_run", F.lit(i)) for i, o in enumerate(outputs)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    has = (completion_status(u) != "todo").cast("int")
    rest = [c for c in u.columns if c not in (*KEY, "_run")]
    best = u.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(has.alias("h"), F.col("_run"))).alias("_w"))
    return best.select(*[F.col(c) if c in KEY else F.col(f"_w.`{c}`").alias(c) for c in u.columns if c != "_run"])


def resume_merge(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Previous output rows that were complete, plus the new run's rows.

    The new run annotated the todo rows only, so the two share no key.
    """
    return prior.where(completion_status(prior) != "todo").unionByName(new, allowMissingColumns=True)


def blank_annotations(out: DataFrame, blank_if: Column) -> DataFrame:
    """Clear the output columns where ``blank_if`` holds (prior-run fixtures)."""
    cols = {}
    for c in OUTPUT_COLUMNS:
        dt = dict(out.dtypes)[c]
        empty = F.lit("") if dt == "string" else F.lit(None).cast(dt)
        cols[c] = F.when(blank_if, empty).otherwise(F.col(c))
    return out.withColumns(cols)
