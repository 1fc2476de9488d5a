"""ST1: incremental annotation with Structured Streaming.

Context needs *later* rows of a thread, so it stays a batch step that writes
the prompts table.  The stream then picks up prompt files as they arrive
(``maxFilesPerTrigger`` bounds a micro-batch), runs the attempt rounds for the
micro-batch and commits them to a ledger folder of that run and batch.  The stream is
stateless; its checkpoint records which files were done, so a restart
processes only new files, and a re-run micro-batch (same ``batch_id``) reuses
the rounds it already committed instead of calling the model again.

A round costs some jobs however few rows it has, and a few rows need every try.  So
:func:`annotate_stream`, which ends when the files that are there are done, makes only the first round in each
micro-batch; what all of them leave goes through the later rounds together, in a ledger folder named
after the first and the last of these micro-batches (``batch=0to7``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_MAX_TRIES
from ..operators.attempts import FRONTIER_SCHEMA, Line, left_rows, read_ledger, resolve_attempts, run_rounds, write_line
from ..operators.context import KEY
from ..operators.generate import TextGenerator
from ..session import is_complete, mark_complete, read_if_there

PROMPT_SCHEMA = "corpus string, thread_id bigint, row_idx bigint, user_prompt string"


def start_annotate_stream(
    spark: SparkSession,
    prompts_path: str,
    generator: TextGenerator,
    system_prompt: str,
    work_dir: str,
    max_tries: int = DEFAULT_MAX_TRIES,
    files_per_trigger: int = 1,
    available_now: bool = True,
    run_id: str = "0",
    **options,
):
    """Start the stream; returns the ``StreamingQuery``.

    ``run_id`` names the ledger's share of this checkpoint: a stream that starts with a
    new checkpoint over an old work folder must have a new one.  ``options`` go to
    :func:`run_rounds`.
    """
    mine = f"run={run_id}"

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*KEY, "user_prompt")
        ledger, state = (os.path.join(work_dir, x, mine, f"batch={batch_id}") for x in ("ledger", "state"))
        run_rounds(batch, generator, system_prompt, max_tries, ledger, state_dir=state, **options)

    stream = spark.readStream.schema(PROMPT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(prompts_path)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", os.path.join(work_dir, "checkpoint", mine))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def later_rounds(
    spark: SparkSession,
    generator: TextGenerator,
    system_prompt: str,
    work_dir: str,
    max_tries: int = DEFAULT_MAX_TRIES,
    run_id: str = "0",
    died: bool = False,
    **options,
) -> None:
    """The rounds after the first for the rows that micro-batches have left, all together.

    Which micro-batches they are is written before the first call: with ``died`` only those are taken up
    whose later rounds were begun and did not end.
    """
    ledger, state = (os.path.join(work_dir, x, f"run={run_id}") for x in ("ledger", "state"))
    lines = read_if_there(spark, f"{state}/batch=*/frontier", f"{FRONTIER_SCHEMA}, batch string", basePath=state)
    if lines is None:
        return
    first = F.col("attempt") == 0
    told = {
        r.batch: r
        for r in lines.groupBy("batch").agg(
            F.max("attempt").alias("last"), F.min(F.when(first, F.col("first_due"))).alias("due"),
            F.sum(F.when(first, F.col("left_over"))).alias("left_over"),
            (F.countDistinct(F.when(first, F.col("part"))) == F.max(F.when(first, F.col("parts")))).alias("written"),
        ).collect()
    }
    spans = sorted((int(hi), int(lo)) for lo, to, hi in (b.partition("to") for b in told if "to" in b))
    batches = sorted(int(b) for b, r in told.items() if "to" not in b and r.written)
    if not died:
        batches = [b for b in batches if not spans or b > spans[-1][0]]
        span = (batches[0], batches[-1]) if batches else None
    else:
        span = spans[-1][::-1] if spans else None
    if span is None:
        return
    # a micro-batch that has begun a later round by itself makes all of them
    held = [told[str(b)] for b in batches if span[0] <= b <= span[1] and not told[str(b)].last and told[str(b)].left_over]
    mine, done = (os.path.join(x, f"batch={span[0]}to{span[1]}") for x in (ledger, state))
    if not held or died and is_complete(spark, f"{done}/done"):
        return
    if not died:
        due = min((r.due for r in held if r.due is not None), default=None)
        write_line(spark, f"{done}/frontier", Line(0, 0, 1, sum(r.left_over for r in held), due))
    prompts = left_rows(spark, *[f"{ledger}/batch={r.batch}/round=0" for r in held])
    run_rounds(prompts, generator, system_prompt, max_tries, mine, state_dir=done, start=1, **options)
    mark_complete(spark, f"{done}/done")


def annotate_stream(
    spark: SparkSession,
    prompts_path: str,
    generator: TextGenerator,
    system_prompt: str,
    work_dir: str,
    max_tries: int = DEFAULT_MAX_TRIES,
    files_per_trigger: int = 1,
    run_id: str = "0",
    **options,
) -> DataFrame:
    """Run the stream until every available prompt file is done, and the rounds that are left, then resolve."""
    later = lambda died: later_rounds(spark, generator, system_prompt, work_dir, max_tries, run_id, died, **options)
    later(True)
    q = start_annotate_stream(
        spark, prompts_path, generator, system_prompt, work_dir, max_tries, files_per_trigger, run_id=run_id, **options | {"rounds": 1}
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    later(False)
    prompts = spark.read.schema(PROMPT_SCHEMA).parquet(prompts_path)
    return resolve_attempts(prompts, read_ledger(spark, os.path.join(work_dir, "ledger", f"run={run_id}")), max_tries)
