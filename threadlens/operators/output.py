"""The annotated output table and its sinks."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import OUTPUT_COLUMNS
from ..functions.json import prompt_json
from ..session import row_by_row, shuffles_end_with_the_job
from .context import KEY

_TEXT_OUT = ["annotation_act", "annotation_politeness", "annotation_meta", "annotation_NBF", "annotation_reasoning"]


def attach_annotations(utt: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every utterance with its annotation fields; blanks where none exists."""
    ann = resolved.select(*KEY, *_TEXT_OUT, "annotation_seed")
    j = utt.join(ann, KEY, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in _TEXT_OUT})


def annotated_output(
    utt: DataFrame,
    resolved: DataFrame,
    prompts: DataFrame,
    system_prompt: str,
) -> DataFrame:
    """Utterance columns, then the nine output columns in order.

    ``raw_prompt``/``raw_response``/``annotation_timestamp`` come from the
    winning attempt only (status rows keep them blank).  The chat transcript is
    rebuilt from the stored user prompt here, so the ledger never stores a copy
    of the system prompt per attempt.
    """
    win = resolved.where(F.col("status") == "ok").select(*KEY, "response", "ts")
    raw = win.join(prompts.select(*KEY, "user_prompt"), KEY, "left").select(
        *KEY,
        prompt_json(F.lit(system_prompt), F.coalesce(F.col("user_prompt"), F.lit(""))).alias("raw_prompt"),
        F.col("response").alias("raw_response"),
        F.col("ts").alias("annotation_timestamp"),
    )
    j = attach_annotations(utt, resolved).join(raw, KEY, "left")
    j = j.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ["raw_prompt", "raw_response"]})
    base = [c for c in utt.columns]
    return j.select(*base, *OUTPUT_COLUMNS)


def write_annotations(df: DataFrame, base: str, rid: str, csv: bool = False) -> str:
    """One run's output under ``base``; returns the folder of its table.

    Parquet partitioned by corpus (the source of truth), optionally also exported as quoted CSV with a
    header, in gzip files.  Every row's ``raw_prompt`` holds the system prompt: both are written by codecs that
    find it again in the row before, which the default ones (none for CSV) do not.  The export is made from the
    table, so what the run's rows need is joined and shuffled once.  A run has a folder of its own, ``run_id=<rid>``, and never overwrites: a
    second run with the same id fails.  The line in ``complete`` is written last, so a run
    that died is not read.
    """
    spark = df.sparkSession
    path = f"{base}/table/run_id={rid}"
    blank = Observation()
    seen = df.observe(blank, F.count_if(F.col("corpus") == "").alias("n"))
    with shuffles_end_with_the_job(spark):
        seen.write.option("compression", "zstd").partitionBy("corpus").parquet(path)
    if csv:
        # a folder's name does not tell '' from null: with such rows the export is made from the start
        rows = df if blank.get["n"] else spark.read.schema(df.schema).parquet(path).select(*df.columns)
        with shuffles_end_with_the_job(spark), row_by_row(spark):
            text = rows.write.option("header", True).option("quoteAll", True).option("escape", '"')
            text.option("compression", "gzip").csv(f"{base}/csv/run_id={rid}")
    line = spark.range(1).coalesce(1).select(F.lit(rid).alias("run_id"), F.current_timestamp().alias("ended"))
    line.write.mode("append").parquet(f"{base}/complete")
    return path


def complete_runs(spark: SparkSession, base: str) -> DataFrame:
    """``run_id, ended`` of the runs under ``base`` that were written in full."""
    return spark.read.schema("run_id string, ended timestamp").parquet(f"{base}/complete")


def read_run(spark: SparkSession, base: str, rid: str | None = None) -> DataFrame:
    """The output of a complete run, the newest one by default, with its ``run_id``."""
    runs = complete_runs(spark, base)
    known = runs if rid is None else runs.where(F.col("run_id") == rid)
    newest = known.agg(F.max_by("run_id", F.struct("ended", "run_id")).alias("r")).first().r
    if newest is None:
        raise ValueError(f"no complete run {rid or ''} under {base}")
    # the id comes from the folder's name: the read is pruned to that folder
    return spark.read.option("basePath", f"{base}/table").parquet(f"{base}/table/run_id={newest}")


# -- X15: run stamp and output naming ----------------------------------------------
RUN_STAMP_FORMAT = "%m-%d_%H-%M-%S"


def run_stamp(when: datetime | None = None) -> str:
    """Run stamp ``MM-dd_HH-mm-ss`` (taken once per run on the driver)."""
    return (when or datetime.now()).strftime(RUN_STAMP_FORMAT)


def run_id(input_path: str, model: str, stamp: str) -> str:
    """``<input stem>_annotated_<model with / and - as _>_<stamp>``."""
    stem = os.path.splitext(os.path.basename(input_path.rstrip("/")))[0]
    return f"{stem}_annotated_{model.replace('/', '_').replace('-', '_')}_{stamp}"
