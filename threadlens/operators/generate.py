"""the text generator boundary (the only Python step of the pipeline).

A ``TextGenerator`` turns a pandas batch of prompts into responses.  Spark
hands it Arrow batches through ``mapInPandas``: one generator instance per
task (one client / connection per task), many prompts per call.  The partition
function never raises for a row: a call that fails, or answers with another number
of rows, is repeated on both halves of its batch down to single rows, so only the rows
that fail by themselves get an ``error`` value; an empty answer becomes the error
``empty output``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    ALLOWED_ACTS,
    BACKEND_PARAMS,
    BACKEND_PREFIXES,
    BACKEND_SUBSTRING,
    BASE_SEED,
)
from ..session import bound_arrow_batches

GEN_COLUMNS = ["corpus", "thread_id", "row_idx", "attempt", "seed", "response", "error", "ts"]
GEN_SCHEMA = (
    "corpus string, thread_id bigint, row_idx bigint, attempt int, seed bigint, "
    "response string, error string, ts double"
)
# what a call can keep of its row: the prompt as it came, and when the answer was there
KEPT_SCHEMA = "user_prompt string, ended double"
EMPTY_OUTPUT = "empty output"
SLICE_ROWS = 4096  # attempts that a task makes of an Arrow batch at a time


@dataclass(frozen=True)
class Settings:
    """what a backend is asked for: model and sampling settings."""

    model: str
    backend: str
    temperature: float | None
    top_p: float | None
    max_tokens: int | None
    sends_seed: bool
    flat_prompt: bool


def settings_for(model: str) -> Settings:
    """The backend of a model name and its settings."""
    routed = [b for prefix, b in BACKEND_PREFIXES if model.startswith(prefix)]
    if not routed and BACKEND_SUBSTRING[0] in model.lower():
        routed = [BACKEND_SUBSTRING[1]]
    if not routed:
        raise ValueError(f"no backend for model {model!r}")
    row = next(r for r in BACKEND_PARAMS if r[0] == routed[0])
    return Settings(model, *row)


class TextGenerator:
    """Base class for pluggable generators.  Must be picklable.

    ``settings`` holds the run's model and sampling settings (None when the run
    names no model).  For backends without chat roles ``user_prompt`` already starts
    with the system prompt, and ``system_prompt`` is empty.

    ``generate`` receives a batch with columns ``corpus, thread_id, row_idx,
    attempt, seed, user_prompt`` (and the run's ``system_prompt`` once) and
    returns a frame of the same length with ``response`` (str or None),
    ``error`` (str or None) and ``ts`` (epoch seconds, float).
    """

    settings: Settings | None = None

    def open(self) -> None:  # once per task
        pass

    def close(self) -> None:
        pass

    def generate(self, batch: pd.DataFrame, system_prompt: str) -> pd.DataFrame:
        raise NotImplementedError


# -- stub generator (tests and benchmark) ------------------------------------------
# FIXED VALUES: the stub's answer table (politeness by (row+attempt)%29, meta by
# row%5, non-bona-fide by row%7), see FIXTURES.md §3.
_STUB_POLITENESS = {28: "*P", 1: "+P", 2: "–N", 3: "-P [Insult]", 4: "—P [Silencer]"}
_STUB_META = {1: "reported", 2: "reported, bogus", 3: "NA"}
_STUB_NBF = {1: "true", 2: '"True"', 3: '"Ture"', 4: "false", 5: '"False"', 6: "null"}
_STUB_NO_TAGS = '[REASON]The speaker states something in context.[/REASON] {"act":"Claim"}'
_STUB_POLICY = "Request rejected by content policy"


def stub_k(thread_id, row_idx, attempt):
    """Outcome selector of the stub: 0-18 act, 19 policy error, 20 empty,
    21 no tags, 22 short reasoning.  Rows with ``row_idx % 11 = 5`` repeat."""
    step = np.where(row_idx % 11 == 5, 0, 13)
    return (thread_id * 31 + row_idx * 7 + attempt * step) % 23


class StubGenerator(TextGenerator):
    """Deterministic stand-in for a model: the answer is arithmetic on the key."""

    def __init__(self, ts0: float = 1_700_000_000.0):
        self.ts0 = ts0

    def generate(self, batch: pd.DataFrame, system_prompt: str) -> pd.DataFrame:
        t = batch["thread_id"].to_numpy(dtype=np.int64)
        r = batch["row_idx"].to_numpy(dtype=np.int64)
        a = batch["attempt"].to_numpy(dtype=np.int64)
        k = stub_k(t, r, a)
        responses, errors = [], []
        for ki, ri, ai in zip(k.tolist(), r.tolist(), a.tolist()):
            if ki == 19:
                responses.append(None)
                errors.append(_STUB_POLICY)
            elif ki == 20:
                responses.append("")
                errors.append(None)
            elif ki == 21:
                responses.append(_STUB_NO_TAGS)
                errors.append(None)
            else:
                reason = "too short" if ki == 22 else f"Row {ri} is read in its local context."
                act = ALLOWED_ACTS[ki] if ki <= 18 else "Claim"
                responses.append(
                    f"[REASON] {reason} [/REASON]\n"
                    f'[ANNOT]{{"act":"{act}","politeness":"{_STUB_POLITENESS.get((ri + ai) % 29, "")}",'
                    f'"self/reported":"{_STUB_META.get(ri % 5, "")}","non-bona fide":{_STUB_NBF.get(ri % 7, chr(34) * 2)}}}[/ANNOT]'
                )
                errors.append(None)
        return pd.DataFrame({"response": responses, "error": errors, "ts": self.ts0 + a.astype(float)})


# -- seeds, backoff, backends -----------------------------------------------------
def attempt_seed(attempt: Column) -> Column:
    """Seed of an attempt."""
    return F.lit(BASE_SEED).cast("long") + attempt.cast("long")


def backoff_seconds(attempt: Column) -> Column:
    """Wait before retrying after ``attempt`` (2^attempt s)."""
    return F.pow(F.lit(2.0), attempt.cast("double"))


def backend_route(model: Column) -> Column:
    """Backend of a model name (null when unsupported)."""
    expr = None
    for prefix, backend in BACKEND_PREFIXES:
        cond = model.startswith(prefix)
        expr = F.when(cond, F.lit(backend)) if expr is None else expr.when(cond, F.lit(backend))
    sub, backend = BACKEND_SUBSTRING
    return expr.when(F.lower(model).contains(sub), F.lit(backend))


def backend_params(spark: SparkSession) -> DataFrame:
    """sampling settings per backend (four rows, from fixed values)."""
    return spark.createDataFrame(
        BACKEND_PARAMS,
        "backend string, temperature double, top_p double, max_tokens int, sends_seed boolean, flat_prompt boolean",
    )


def flat_prompt(system: Column, user: Column) -> Column:
    """one-text prompt for backends without chat roles: ``system ⏎⏎ user``."""
    return F.concat(system, F.lit("\n\n"), user)


def with_backend(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Attach the backend and its settings to rows carrying a model name.

    The parameter table has exactly one row per backend, so it is broadcast.
    """
    params = backend_params(df.sparkSession)
    routed = df.withColumn("backend", backend_route(F.col(model_col)))
    return routed.join(F.broadcast(params), "backend", "left")


# -- the mapInPandas boundary -------------------------------------------------------
def _call(generator: TextGenerator, batch: pd.DataFrame, system_prompt: str) -> list[tuple]:
    """(response, error, ts) per row; a failing batch is halved until one row fails alone."""
    n = len(batch)
    try:
        out = generator.generate(batch, system_prompt)
        if len(out) != n:
            raise ValueError(f"{len(out)} answers to {n} prompts")
        rows = zip(out["response"].tolist(), out["error"].tolist(), out["ts"].astype(float).tolist(), strict=True)
        return [_row(*r) for r in rows]
    except Exception as exc:
        if n == 1:
            return [(None, f"{type(exc).__name__}: {exc}", time.time())]
        halves = batch.iloc[: n // 2].reset_index(drop=True), batch.iloc[n // 2 :].reset_index(drop=True)
        return [r for half in halves for r in _call(generator, half, system_prompt)]


def _row(response, error, ts: float) -> tuple:
    error = None if pd.isna(error) else str(error)
    if error is None and (pd.isna(response) or not str(response).strip()):
        error = EMPTY_OUTPUT
    return (None if error is not None else str(response)), error, ts


def _slices(whole: pd.DataFrame, tries: int | None, batch_rows: int | None) -> Iterator[pd.DataFrame]:
    """The attempts of an Arrow batch, in the order in which they are due, some at a time."""
    if "due" in whole:
        whole = whole.sort_values("due", kind="stable", na_position="first")
    n = max(1, SLICE_ROWS // (tries or 1))
    for at in range(0, len(whole), n):
        rows = whole.iloc[at : at + n]
        if tries:
            attempt = np.tile(np.arange(tries, dtype=np.int32), len(rows))
            rows = rows.take(np.repeat(np.arange(len(rows)), tries)).assign(attempt=attempt, seed=BASE_SEED + attempt.astype(np.int64))
        size = batch_rows or len(rows)
        for i in range(0, len(rows), size):
            yield rows.iloc[i : i + size].reset_index(drop=True)


def generate(
    pending: DataFrame,
    generator: TextGenerator,
    system_prompt: str = "",
    parallelism: int | None = None,
    batch_rows: int | None = None,
    model: str | None = None,
    keep: bool = False,
    tries: int | None = None,
) -> DataFrame:
    """Call the generator once per pending attempt.

    ``pending`` needs ``corpus, thread_id, row_idx, attempt, user_prompt``; only
    those columns cross into Python (select first: projections and filters do
    not pass through ``mapInPandas``).  Result columns: ``GEN_COLUMNS``.
    With ``tries`` every row is asked for its attempts 0 .. tries - 1 and needs no ``attempt``:
    its prompt crosses into Python once, not once per attempt.

    ``parallelism`` is the number of concurrent generator tasks (for a remote
    model: the API concurrency limit); None keeps the input's partitioning.
    ``batch_rows`` bounds the prompts per generator call (the Arrow batch is split);
    None passes whole batches, which the session bounds by bytes (``bound_arrow_batches``), or
    ``SLICE_ROWS`` attempts at a time.  ``model`` selects the settings the generator gets.
    ``keep`` also returns each row's prompt and the time its call ended.  A column ``due`` (epoch
    seconds, may be null) is the time before which a row must not be sent: a task takes the
    rows of an Arrow batch in that order and waits for those that are not due yet.
    """
    bound_arrow_batches(pending.sparkSession)
    settings = settings_for(model) if model else None
    asked = [] if tries else [F.col("attempt").cast("int").alias("attempt"), attempt_seed(F.col("attempt")).alias("seed")]
    src = pending.select("corpus", "thread_id", "row_idx", *asked, "user_prompt", *(["due"] if "due" in pending.columns else []))
    flat = bool(settings and settings.flat_prompt)
    if parallelism:
        src = src.repartition(parallelism)

    def answered(pdf):
        if "due" in pdf:
            wait = (pdf["due"].max() or 0) - time.time()
            time.sleep(wait if wait > 0 else 0)  # a missing time compares as not later
            pdf = pdf.drop(columns="due")
        asked = pdf.assign(user_prompt=system_prompt + "\n\n" + pdf["user_prompt"]) if flat else pdf
        answers = _call(generator, asked, "" if flat else system_prompt)
        got = pd.DataFrame(answers, columns=["response", "error", "ts"], dtype=object)
        keys = pdf[["corpus", "thread_id", "row_idx", "attempt", "seed"]]
        out = pd.concat([keys, got.astype({"ts": float})], axis=1)
        return out.assign(user_prompt=pdf["user_prompt"], ended=time.time()) if keep else out

    def run(batches):
        generator.settings = settings
        generator.open()
        try:
            for whole in batches:
                yield from map(answered, _slices(whole, tries, batch_rows))
                del whole  # before the next batch is read
        finally:
            generator.close()

    return src.mapInPandas(run, f"{GEN_SCHEMA}, {KEPT_SCHEMA}" if keep else GEN_SCHEMA)
