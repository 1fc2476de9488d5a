"""C6-C9 / ST1: status counts, exactly-once ledger effects, resume, stream restart."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def run(spark):
    from threadlens.plans.runs import stub_run

    return stub_run(spark, SF_SMALL, tries=3)


def test_status_counts_match_fixture_table(run):
    got = {r["status"]: r["count"] for r in run.resolved.groupBy("status").count().collect()}
    assert got == {"ok": 195, "flagged": 10, "failed": 2}
    first = {r["outcome"]: r["count"] for r in run.ledger.where("attempt = 0").groupBy("outcome").count().collect()}
    assert first == {"ok": 171, "api_error": 10, "flagged": 10, "reason_short": 8, "no_tags": 8}


def test_status_rows_are_blank_with_base_seed(run):
    bad = run.resolved.where(F.col("status") != "ok")
    assert bad.where((F.col("annotation_seed") != 93187) | (F.col("annotation_reasoning") != "")).count() == 0
    out = run.output().where(F.col("annotation_act").isin("__FAILED__", "__FLAGGED__"))
    assert out.where((F.col("raw_prompt") != "") | (F.col("raw_response") != "")).count() == 0


def test_output_column_order(run):
    from threadlens.constants import OUTPUT_COLUMNS

    assert run.output().columns[-len(OUTPUT_COLUMNS):] == OUTPUT_COLUMNS


class ExplodingGenerator:
    """A generator that must never be called (ledger replay test)."""

    def open(self):
        pass

    def close(self):
        pass

    def generate(self, batch, system_prompt):
        return pd.DataFrame({"response": [None] * len(batch), "error": ["CALLED AGAIN"] * len(batch), "ts": [0.0] * len(batch)})


def test_rerun_replays_ledger_without_new_calls(spark, run):
    from threadlens.operators.attempts import read_ledger, run_rounds

    ledger_dir = f"{run.work_dir}/attempts"
    before = read_ledger(spark, ledger_dir).count()
    run_rounds(run.prompts, ExplodingGenerator(), run.system_prompt, 3, ledger_dir)
    after = read_ledger(spark, ledger_dir)
    assert after.count() == before
    assert after.where(F.col("error") == "CALLED AGAIN").count() == 0


def test_resume_annotates_only_todo_rows(spark, run):
    from threadlens.operators.resume import classify_prior, todo_rows
    from threadlens.plans.runs import prior_output

    prior = prior_output(run)
    todo = todo_rows(run.utt, prior)
    expect = run.utt.where((F.col("thread_id") + F.col("row_idx")) % 4 == 0)
    assert todo.select("thread_id", "row_idx").exceptAll(expect.select("thread_id", "row_idx")).count() == 0
    assert todo.count() == expect.count()
    st = {r["prior_status"]: r["count"] for r in classify_prior(prior).groupBy("prior_status").count().collect()}
    assert st["todo"] == expect.count()


def test_merge_last_result_wins(spark, run):
    from threadlens.operators.resume import merge_annotations

    out = run.output()
    older = out.withColumn("annotation_act", F.lit("Claim")).withColumn("annotation_reasoning", F.lit("older reasoning text"))
    merged = merge_annotations(older, out)
    assert merged.count() == out.count()
    assert merged.select(*out.columns).exceptAll(out).count() == 0


def test_stream_restart_processes_only_new_files(spark, run, tmp_path):
    from threadlens.operators.generate import StubGenerator
    from threadlens.streaming.annotate_stream import annotate_stream

    src = str(tmp_path / "prompts")
    work = str(tmp_path / "work")
    keys = run.prompts.select("thread_id").distinct().orderBy("thread_id").collect()
    half = [r.thread_id for r in keys[: len(keys) // 2]]
    run.prompts.where(F.col("thread_id").isin(half)).write.mode("append").parquet(src)
    first = annotate_stream(spark, src, StubGenerator(), run.system_prompt, work, max_tries=3)
    n1 = first.count()
    run.prompts.where(~F.col("thread_id").isin(half)).write.mode("append").parquet(src)
    second = annotate_stream(spark, src, StubGenerator(), run.system_prompt, work, max_tries=3)
    assert second.count() == run.prompts.count() > n1
    batches = [d for d in os.listdir(os.path.join(work, "ledger", "run=0")) if d.startswith("batch=")]
    ledger = spark.read.parquet(os.path.join(work, "ledger"))
    # every (row, attempt) was generated exactly once across both runs
    assert ledger.groupBy("thread_id", "row_idx", "attempt").count().where("count > 1").count() == 0
    assert len(batches) >= 2
    got = {r["status"]: r["count"] for r in second.groupBy("status").count().collect()}
    assert got == {"ok": 195, "flagged": 10, "failed": 2}


def test_only_python_node_is_the_generator(spark, run):
    from threadlens.operators.attempts import classify_attempts
    from threadlens.operators.generate import StubGenerator, generate

    pend = run.prompts.withColumn("attempt", F.lit(0))
    plan = classify_attempts(generate(pend, StubGenerator()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_projection_pushed_into_scan(spark):
    from threadlens.operators.messages import message_texts
    from threadlens.sources.tables import utterances_table

    plan = message_texts(utterances_table(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    # reads only the columns it needs
    assert "ReadSchema: struct<corpus:string,thread_id:bigint,row_idx:bigint,msg_id:bigint,message:string>" in plan


def test_required_columns_checked():
    from threadlens.operators.schema import require_columns

    with pytest.raises(ValueError, match="Message"):
        require_columns(["Msg#", "User ID"])
    with pytest.raises(ValueError, match="user_id"):
        require_columns(["Msg#", "Message"])


def test_backend_routing(spark):
    from threadlens.operators.generate import with_backend

    df = spark.createDataFrame(
        [("gpt-4o-2024-08-06",), ("o3-mini",), ("claude-sonnet-4",), ("gemini-2.5-pro",), ("meta-llama/Llama-3.1-8B-Instruct",), ("mistral",)],
        "model string",
    )
    got = {r.model: (r.backend, r.max_tokens) for r in with_backend(df).collect()}
    assert got["gpt-4o-2024-08-06"] == ("openai", 10240)
    assert got["o3-mini"] == ("openai", 10240)
    assert got["claude-sonnet-4"] == ("anthropic", 10240)
    assert got["gemini-2.5-pro"] == ("gemini", 10240)
    assert got["meta-llama/Llama-3.1-8B-Instruct"] == ("llama", 1024)
    assert got["mistral"] == (None, None)


def test_first_text_part(spark):
    from threadlens.functions.json import first_text_part

    df = spark.createDataFrame(
        [([{"content": {"parts": [{"text": ""}, {"text": "  hi  "}]}}],), ([{"content": {"parts": [{"text": ""}]}}],), ([],)],
        "c array<struct<content: struct<parts: array<struct<text: string>>>>>",
    )
    assert [r[0] for r in df.select(first_text_part(F.col("c"))).collect()] == ["hi", "", ""]


def test_o3_reasoning_extra():
    from threadlens.constants import REASONING_O3_EXTRA
    from threadlens.operators.prompts import reasoning_block

    assert reasoning_block("o3-2025-04-16").endswith(REASONING_O3_EXTRA)
    assert not reasoning_block("gpt-4o").endswith(REASONING_O3_EXTRA)


def test_chunked_utterance_number_equals_fixture(spark, monkeypatch):
    from threadlens.operators import scan
    from threadlens.operators.schema import with_utterance_number
    from threadlens.sources.tables import utterances_table

    u = utterances_table(spark, SF_SMALL)
    monkeypatch.setattr(scan, "CHUNK_ROWS", 2)
    got = with_utterance_number(u.drop("utt_no")).select("thread_id", "row_idx", "utt_no")
    assert got.exceptAll(u.select("thread_id", "row_idx", "utt_no")).count() == 0
    assert got.count() == u.count()


def test_segmented_row_ordinal_equals_plain_window(spark):
    from threadlens.operators.schema import row_ordinal
    from threadlens.sources.tables import table

    conv = table(spark, SF_SMALL, "conversations")
    lines = conv.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    plain = row_ordinal(lines, ["conv_id"], ["turn", "pos"])
    seg = row_ordinal(lines, ["conv_id"], ["turn", "pos"], segment_col="turn")
    cols = ["conv_id", "turn", "pos", "row_idx"]
    assert seg.select(cols).exceptAll(plain.select(cols)).count() == 0


def test_run_naming_and_stamp(spark):
    from datetime import datetime

    from threadlens.operators.output import run_id, run_stamp

    st = run_stamp(datetime(2025, 3, 4, 5, 6, 7))
    assert st == "03-04_05-06-07"
    assert run_id("data/forum_a.xlsx", "meta-llama/Llama-3.1-8B", st) == "forum_a_annotated_meta_llama_Llama_3.1_8B_03-04_05-06-07"


def test_flat_prompt(spark):
    from threadlens.operators.generate import flat_prompt

    df = spark.createDataFrame([("sys", "usr")], "s string, u string")
    assert df.select(flat_prompt(F.col("s"), F.col("u"))).first()[0] == "sys\n\nusr"


def test_generator_batch_rows(spark, run):
    from threadlens.operators.generate import TextGenerator, generate

    class BatchSizeGenerator(TextGenerator):
        """Answers with the size of the batch it was called with (defined
        here so it is pickled by value for the workers)."""

        def generate(self, batch, system_prompt):
            n = len(batch)
            return pd.DataFrame({"response": [str(n)] * n, "error": [None] * n, "ts": [0.0] * n})

    pend = run.prompts.withColumn("attempt", F.lit(0))
    sizes = generate(pend, BatchSizeGenerator(), batch_rows=7).select(F.col("response").cast("int").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 7
    assert sizes.count() == run.prompts.count()


def test_layout_filter_pushed_into_scan(spark):
    from threadlens.operators.context import local_context
    from threadlens.sources.tables import utterances_table

    df = local_context(utterances_table(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(layout,threaded)" in plan  # the threaded branch reads only its rows
    assert "Not(EqualTo(layout,threaded))" in plan  # and so does the sequential one


def _answers(fail=None, drop=None, log=None):
    """A generator (pickled by value) that answers every prompt with a valid annotation,
    but raises for prompts in ``fail`` and answers one row short for batches with ``drop``."""
    from threadlens.operators.generate import TextGenerator

    class Answers(TextGenerator):
        def generate(self, batch, system_prompt):
            prompts = batch["user_prompt"].tolist()
            for p in prompts:
                if fail and p in fail:
                    raise RuntimeError(fail[p])
            if drop and len(prompts) > 1:
                prompts = prompts[1:]
            if log:
                with open(log, "a") as f:
                    f.writelines(f"{r.row_idx} {r.attempt} {r.user_prompt}\n" for r in batch.itertuples())
            said = "[REASON] a reason that is long enough [/REASON][ANNOT]{\"act\":\"Claim\"}[/ANNOT]"
            return pd.DataFrame({"response": [said] * len(prompts), "error": [None] * len(prompts), "ts": [1.0] * len(prompts)})

    return Answers()


def _prompts(spark, n=40):
    return spark.createDataFrame([("c", 1, i, f"p{i}") for i in range(n)], "corpus string, thread_id long, row_idx long, user_prompt string")


@pytest.mark.parametrize("message,outcome", [("blocked by content policy", "flagged"), ("timeout", "api_error")])
def test_one_failing_row_does_not_fail_its_batch(spark, message, outcome):
    from threadlens.operators.attempts import classify_attempts
    from threadlens.operators.generate import generate

    pend = _prompts(spark).coalesce(1).withColumn("attempt", F.lit(0))
    got = {r.row_idx: r.outcome for r in classify_attempts(generate(pend, _answers(fail={"p17": message}))).collect()}
    assert got == {i: outcome if i == 17 else "ok" for i in range(40)}


def test_short_answer_frame_is_isolated(spark):
    from threadlens.operators.generate import generate

    got = generate(_prompts(spark, 9).coalesce(1).withColumn("attempt", F.lit(0)), _answers(drop=True)).collect()
    assert len(got) == 9 and all(r.error is None for r in got)


def test_half_written_round_is_completed_without_new_calls(spark, tmp_path):
    from threadlens.operators.attempts import classify_attempts, read_ledger, run_rounds
    from threadlens.operators.generate import generate

    prompts, log = _prompts(spark), str(tmp_path / "calls")
    ledger = str(tmp_path / "attempts")
    part = prompts.where("row_idx < 10").withColumn("attempt", F.lit(0))
    classify_attempts(generate(part, _answers())).write.parquet(f"{ledger}/round=0")  # no marker: the job died
    run_rounds(prompts, _answers(log=log), ledger_dir=ledger)
    with open(log) as f:
        assert sorted(int(x.split()[0]) for x in f) == list(range(10, 40))
    assert read_ledger(spark, ledger).count() == 40


def test_crash_within_a_round_loses_one_part(spark, tmp_path, monkeypatch):
    from threadlens.operators import attempts

    prompts, log, ledger = _prompts(spark), str(tmp_path / "calls"), str(tmp_path / "attempts")
    real, seen = attempts.classify_attempts, []

    def dies(gen):
        seen.append(1)
        if len(seen) == 3:
            raise KeyboardInterrupt
        return real(gen)

    monkeypatch.setattr(attempts, "classify_attempts", dies)
    with pytest.raises(KeyboardInterrupt):
        attempts.run_rounds(prompts, _answers(log=log), ledger_dir=ledger)
    monkeypatch.setattr(attempts, "classify_attempts", real)
    attempts.run_rounds(prompts, _answers(log=log), ledger_dir=ledger)
    with open(log) as f:
        assert sorted(int(x.split()[0]) for x in f) == list(range(40))  # every row called once


def test_settings_reach_the_generator(spark):
    from threadlens.operators.generate import TextGenerator, generate

    class Says(TextGenerator):
        def generate(self, batch, system_prompt):
            said = [f"{self.settings.backend} {self.settings.max_tokens} {system_prompt}|{p}" for p in batch["user_prompt"]]
            return pd.DataFrame({"response": said, "error": [None] * len(said), "ts": [0.0] * len(said)})

    pend = _prompts(spark, 1).withColumn("attempt", F.lit(0))
    say = lambda m: generate(pend, Says(), "sys", model=m).first().response
    assert say("gpt-4o") == "openai 10240 sys|p0"
    assert say("meta-llama/Llama-3.1-8B") == "llama 1024 sys|p0"
    assert say("gemini-2.5-pro") == "gemini 10240 |sys\n\np0"
    with pytest.raises(ValueError, match="mistral"):
        generate(pend, Says(), model="mistral")


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_exports_keep_the_row_order(spark, tmp_path, fmt):
    from threadlens.sources.exports import read_export_folder

    path = str(tmp_path / fmt)
    rows = [(i, i, "u", f"m{i}" if i != 5 else None, "c", 7) for i in range(12)]
    df = spark.createDataFrame(rows, "`order` long, `Msg#` long, `User ID` string, Message string, corpus string, thread_id long")
    df.orderBy(F.rand(3)).write.option("header", True).format(fmt).save(path)
    got = read_export_folder(spark, path, fmt, order_col="order").orderBy("row_idx").collect()
    assert [r.message for r in got] == [f"m{i}" if i != 5 else None for i in range(12)]
    assert [r.msg_id for r in got] == list(range(12))
    with pytest.raises(ValueError, match="order column"):
        read_export_folder(spark, path, fmt, order_col="order", order_type="string")
    with pytest.raises(Exception, match="not a valid value"):
        read_export_folder(spark, path, fmt, order_col="User ID").collect()


def test_merge_prefers_results_and_later_runs(spark, run):
    from threadlens.operators.resume import blank_annotations, merge_annotations, resume_merge, todo_rows

    out = run.output()
    odd = F.col("row_idx") % 2 == 1
    newer = blank_annotations(out.withColumn("annotation_reasoning", F.lit("a newer reasoning text")), odd)
    merged = {(r.thread_id, r.row_idx): r.annotation_reasoning for r in merge_annotations(out, newer).collect()}
    older = {(r.thread_id, r.row_idx): r.annotation_reasoning for r in out.collect()}
    assert merged == {k: older[k] if k[1] % 2 else "a newer reasoning text" for k in older}
    prior = blank_annotations(out, odd)
    again = todo_rows(out, prior).withColumn("annotation_reasoning", F.lit("new"))
    got = {(r.thread_id, r.row_idx): r.annotation_reasoning for r in resume_merge(prior, again).collect()}
    assert set(got) == set(older) and {k for k, v in got.items() if v == "new"} >= {k for k in older if k[1] % 2}
