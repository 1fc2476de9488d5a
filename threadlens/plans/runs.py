"""Shared pipeline runs for the registered queries.

Several queries look at the same run (prompts -> stub generator -> ledger ->
resolution).  The run is materialised once per (session, input folder, tries)
under the shared checkpoint folder and reused while its files exist.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_MAX_TRIES
from ..operators.attempts import annotate, read_ledger
from ..operators.generate import StubGenerator
from ..operators.output import annotated_output
from ..operators.prompts import DEFAULT_MODEL, system_prompt_text, user_prompts
from ..operators.resume import blank_annotations
from ..session import is_complete, scratch_path
from ..sources.tables import utterances_table

@dataclass
class Run:
    utt: DataFrame
    prompts: DataFrame
    resolved: DataFrame
    ledger: DataFrame
    system_prompt: str
    work_dir: str

    def output(self) -> DataFrame:
        return annotated_output(self.utt, self.resolved, self.prompts, self.system_prompt)


_RUNS: dict[tuple, str] = {}


def stub_run(spark: SparkSession, sf_dir: str, tries: int = DEFAULT_MAX_TRIES, model: str = DEFAULT_MODEL) -> Run:
    """Annotate every utterance of ``sf_dir`` with the stub generator."""
    utt = utterances_table(spark, sf_dir)
    system = system_prompt_text(spark)
    key = (id(spark), sf_dir, tries, model)
    work = _RUNS.get(key)
    if work is None or not is_complete(spark, f"{work}/prompts-state"):
        work = scratch_path(spark, "stub-run")
        _RUNS[key] = work
    resolved, ledger_dir = annotate(user_prompts(utt, model), StubGenerator(), system, tries, work)
    prompts = spark.read.parquet(f"{work}/prompts")
    return Run(utt, prompts, resolved, read_ledger(spark, ledger_dir), system, work)


def prior_output(run: Run) -> DataFrame:
    """Prior-run fixture: the resolved output with every annotation column
    blanked where ``(thread_id + row_idx) % 4 = 0`` (those rows are todo)."""
    return blank_annotations(run.output(), (F.col("thread_id") + F.col("row_idx")) % 4 == 0)
