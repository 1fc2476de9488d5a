"""Retry rounds over an append-only attempts ledger.

Round ``a`` sends every row whose attempt ``a - 1`` did not end to the generator with
seed ``93187 + a``, parses the answers and appends them to ``<ledger>/round=<a>`` in
``commit_parts`` jobs (by key hash) *before* anything else reads them, so a crash loses
at most one part's calls.

One write job is all that a part of a round costs: its rows are those of the round before
that still carry their prompt (a row that has ended does not, so the next round reads
no prompts but those it sends, and joins nothing), and how many rows are left and when the
first of them is due are metrics observed in the write (``DataFrame.observe``).  Each written part adds a line to
the frontier, a small table beside the ledger from which a new run takes up the work: lines
are read once, parts that have one are skipped.  A part without a line may have left files;
the rows in them are not sent again.

With ``backoff`` every row has its own due time, 2^attempt s after its call ended (at most
``max_wait``).  The driver sleeps until the first row of a round is due, the tasks wait for the others one
by one; nobody waits for the slowest row of the round before.

Terminal attempts: ``ok`` (valid annotation) and ``flagged`` (content-policy
error).  Everything else (``api_error``, ``reason_short``, ``no_tags``,
``bad_json``, ``bad_act``, ``bad_politeness``) is retried.
"""

from __future__ import annotations

import os
import time
from collections import namedtuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import BASE_SEED, DEFAULT_MAX_TRIES, STATUS_FAILED, STATUS_FLAGGED
from ..functions.text import is_policy_error
from ..session import is_complete, mark_complete, read_if_there, scratch_path, shuffles_end_with_the_job
from .context import KEY
from .generate import TextGenerator, backoff_seconds, generate
from .parse import parse_responses

TERMINAL = ["ok", "flagged"]
LEDGER_COLUMNS = KEY + [
    "attempt", "seed", "response", "error", "ts", "outcome",
    "act", "politeness", "meta", "nbf", "reasoning", "backoff_s",
]
LEDGER_SCHEMA = (
    "corpus string, thread_id bigint, row_idx bigint, attempt int, seed bigint, response string, error string, ts double, "
    "outcome string, act string, politeness string, meta string, nbf string, reasoning string, backoff_s double"
)
ROUND_SCHEMA = f"{LEDGER_SCHEMA}, user_prompt string, due double"
PROMPT_SCHEMA = "corpus string, thread_id bigint, row_idx bigint, user_prompt string"
# of the frontier: a written part of a round, the rows it leaves and when the first of them is due
FRONTIER_SCHEMA = "attempt int, part int, parts int, left_over bigint, first_due double"
Line = namedtuple("Line", [c.split()[0] for c in FRONTIER_SCHEMA.split(", ")])


def classify_attempts(gen: DataFrame) -> DataFrame:
    """Parse generator output and set each attempt's ``outcome`` (X8 + C5)."""
    parsed = parse_responses(gen)
    outcome = (
        F.when(F.col("error").isNotNull(), F.when(is_policy_error(F.col("error")), F.lit("flagged")).otherwise(F.lit("api_error")))
        .otherwise(F.col("outcome"))
    )
    kept = [c for c in ("user_prompt", "ended") if c in gen.columns]
    return parsed.withColumn("outcome", outcome).withColumn("backoff_s", backoff_seconds(F.col("attempt"))).select(*LEDGER_COLUMNS, *kept)


def read_ledger(spark, ledger_dir: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_dir).select(*LEDGER_COLUMNS)


def left_rows(spark, *rounds: str) -> DataFrame:
    """The rows of written rounds that have to be sent again: those with their prompt."""
    written = spark.read.schema(ROUND_SCHEMA).parquet(*rounds)
    return written.where(F.col("user_prompt").isNotNull()).select(*KEY, "user_prompt", "due")


def write_line(spark, frontier_at: str, line: Line) -> Line:
    """Append a line to the frontier: the part it names is written."""
    typed = [F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(line, FRONTIER_SCHEMA.split(", "), strict=True)]
    spark.range(1).coalesce(1).select(*typed).write.mode("append").parquet(frontier_at)
    return line


def run_rounds(
    prompts: DataFrame,
    generator: TextGenerator,
    system_prompt: str = "",
    max_tries: int = DEFAULT_MAX_TRIES,
    ledger_dir: str | None = None,
    backoff: bool = False,
    batch_rows: int | None = None,
    parallelism: int | None = None,
    model: str | None = None,
    commit_parts: int = 4,
    max_wait: float | None = None,
    state_dir: str | None = None,
    rounds: int | None = None,
    start: int = 0,
) -> str:
    """Run attempt rounds for every row of ``prompts`` (key + ``user_prompt``).

    With ``backoff`` a row waits 2^attempt s (at most ``max_wait`` s where given) after its
    call before it is sent again, as a rate-limited API needs.  The first round is committed in
    ``commit_parts`` parts, each later one in half as many.  The frontier goes to
    ``state_dir`` (default: beside the ledger).  Returns the ledger folder.

    With ``rounds`` it stops after so many, unless a later one was begun before; the rest is a call of its own,
    whose first round is ``start`` and whose ``prompts`` are what the rounds before it left (:func:`left_rows`).
    """
    spark = prompts.sparkSession
    ledger_dir = ledger_dir or scratch_path(spark, "attempts")
    frontier_at = os.path.join(state_dir or f"{ledger_dir.rstrip('/')}-state", "frontier")
    known = read_if_there(spark, frontier_at, FRONTIER_SCHEMA)
    frontier = {(r.attempt, r.part): r for r in known.collect()} if known is not None else {}  # a line per part
    begun = max((a for a, _ in frontier), default=-1)
    end = max_tries if rounds is None or begun >= start + rounds else min(max_tries, start + rounds)
    again = ~F.col("outcome").isin(TERMINAL)
    wait = F.col("backoff_s") if max_wait is None else F.least(F.col("backoff_s"), F.lit(float(max_wait)))
    for attempt in range(start, end):
        out = f"{ledger_dir}/round={attempt}"
        parts = next((r.parts for (a, _), r in frontier.items() if a == attempt), max(1, commit_parts >> attempt))
        missing = [p for p in range(parts) if (attempt, p) not in frontier]
        if missing:
            if attempt == 0:
                pending = prompts.select(*KEY, F.coalesce("user_prompt", F.lit("")).alias("user_prompt"))
            else:
                pending = prompts if attempt == start else left_rows(spark, f"{ledger_dir}/round={attempt - 1}")
                due = [r.first_due for (a, _), r in frontier.items() if a == attempt - 1 and r.first_due is not None]
                if backoff and due:
                    time.sleep(max(0.0, min(due) - time.time()))
            if not backoff and attempt:
                pending = pending.drop("due")
            # files of a part that was not finished; parts with a line in the frontier are not looked at
            left = read_if_there(spark, out, ROUND_SCHEMA)
            if left is not None:
                pending = pending.join(left.select(*KEY), KEY, "left_anti")
        for part in missing:
            mine = F.pmod(F.xxhash64(*KEY), F.lit(parts)) == part
            gen = generate(
                pending.where(mine).withColumn("attempt", F.lit(attempt)), generator, system_prompt, parallelism, batch_rows, model, keep=True
            )
            done = classify_attempts(gen)
            done = done.withColumns(
                {"user_prompt": F.when(again, F.col("user_prompt")), "due": F.when(again, F.col("ended") + wait)}
            ).drop("ended")
            seen = Observation()
            done.observe(seen, F.count("user_prompt").alias("n"), F.min("due").alias("due")).write.mode("append").parquet(out)
            n, due = seen.get["n"], seen.get["due"]
            if left is not None:
                old = left.where(mine).agg(F.count("user_prompt").alias("n"), F.min("due").alias("due")).first()
                n, due = n + old.n, min((x for x in (due, old.due) if x is not None), default=None)
            frontier[attempt, part] = write_line(spark, frontier_at, Line(attempt, part, parts, n, due))
        if not sum(frontier[attempt, p].left_over for p in range(parts)):
            break
    return ledger_dir


def resolve_attempts(todo: DataFrame, ledger: DataFrame, max_tries: int = DEFAULT_MAX_TRIES) -> DataFrame:
    """One final row per todo key: the first terminal attempt decides.

    ``status``: ``ok`` / ``flagged`` / ``failed`` (no terminal attempt).  Status
    rows carry blank fields and seed 93187.  ``min_by`` is an aggregate with a
    map-side partial step; no window over the ledger is needed.
    """
    first = (
        ledger.where(F.col("outcome").isin(TERMINAL))
        .groupBy(*KEY)
        .agg(F.min_by(F.struct("attempt", "seed", "outcome", "act", "politeness", "meta", "nbf", "reasoning", "response", "ts"), F.col("attempt")).alias("w"))
    )
    j = todo.select(*KEY).join(first, KEY, "left")
    ok = F.coalesce(F.col("w.outcome") == "ok", F.lit(False))
    status = F.when(F.col("w").isNull(), F.lit("failed")).when(ok, F.lit("ok")).otherwise(F.lit("flagged"))
    blank = lambda c: F.when(ok, F.col(c)).otherwise(F.lit(""))
    return j.select(
        *KEY,
        status.alias("status"),
        F.when(ok, F.col("w.act"))
        .when(F.col("w").isNull(), F.lit(STATUS_FAILED))
        .otherwise(F.lit(STATUS_FLAGGED))
        .alias("annotation_act"),
        blank("w.politeness").alias("annotation_politeness"),
        blank("w.meta").alias("annotation_meta"),
        blank("w.nbf").alias("annotation_NBF"),
        blank("w.reasoning").alias("annotation_reasoning"),
        F.when(ok, F.col("w.seed")).otherwise(F.lit(BASE_SEED).cast("long")).alias("annotation_seed"),
        F.when(ok, F.col("w.attempt")).alias("attempt"),
        F.coalesce(F.col("w.attempt") + 1, F.lit(max_tries)).cast("long").alias("n_attempts"),
        F.when(ok, F.col("w.response")).alias("response"),
        F.when(ok, F.col("w.ts")).alias("ts"),
    )


def winning_attempts(ledger: DataFrame, resolved: DataFrame) -> DataFrame:
    """The raw attempt that produced each annotation (semi join on key + seed).

    Only ``ok`` rows take part: status rows carry seed 93187, which would
    otherwise match attempt 0.
    """
    winners = resolved.where(F.col("status") == "ok").select(*KEY, F.col("annotation_seed").alias("seed"))
    return ledger.join(winners, KEY + ["seed"], "left_semi")


def annotate(
    prompts: DataFrame,
    generator: TextGenerator,
    system_prompt: str = "",
    max_tries: int = DEFAULT_MAX_TRIES,
    work_dir: str | None = None,
    **options,
) -> tuple[DataFrame, str]:
    """Materialise the prompts, run the rounds, resolve: ``(resolved, ledger_dir)``.

    ``options`` go to :func:`run_rounds` (backoff, batch_rows, parallelism, model, ...).
    """
    spark = prompts.sparkSession
    work_dir = work_dir or scratch_path(spark, "annotate")
    at, done = os.path.join(work_dir, "prompts"), os.path.join(work_dir, "prompts-state")
    if not is_complete(spark, done):
        with shuffles_end_with_the_job(spark):
            prompts.select(*KEY, "user_prompt").write.mode("overwrite").parquet(at)
        mark_complete(spark, done)
    stored = spark.read.schema(PROMPT_SCHEMA).parquet(at)
    ledger_dir = run_rounds(stored, generator, system_prompt, max_tries, os.path.join(work_dir, "attempts"), **options)
    return resolve_attempts(stored, read_ledger(spark, ledger_dir), max_tries), ledger_dir
