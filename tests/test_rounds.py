"""Retry rounds: jobs a round costs, due times, restarts from the frontier."""

import time

import pandas as pd
import pytest

from threadlens.operators.attempts import FRONTIER_SCHEMA, read_ledger, resolve_attempts, run_rounds
from threadlens.operators.generate import TextGenerator

SAID = '[REASON] a reason that is long enough [/REASON][ANNOT]{"act":"Claim"}[/ANNOT]'


def answering(good_from, log=None, slow=None):
    """Answers row i properly from attempt ``good_from(i)`` on; logs every call with its time."""

    class Answers(TextGenerator):
        def generate(self, batch, system_prompt):
            now = time.time()
            if slow:
                time.sleep(slow)
            if log:
                with open(log, "a") as f:
                    f.writelines(f"{r.row_idx} {r.attempt} {now} {time.time()} {r.user_prompt}\n" for r in batch.itertuples())
            said = [SAID if r.attempt >= good_from(r.row_idx) else "" for r in batch.itertuples()]
            return pd.DataFrame({"response": said, "error": [None] * len(said), "ts": [1.0] * len(said)})

    return Answers()


def prompts_of(spark, n=40):
    rows = [("c", 1, i, f"p{i}") for i in range(n)]
    return spark.createDataFrame(rows, "corpus string, thread_id long, row_idx long, user_prompt string").repartition(3)


def calls(log):
    with open(log) as f:
        return [(int(a), int(b), float(c), float(d), p.strip()) for a, b, c, d, p in (x.split(" ", 4) for x in f)]


def test_a_part_costs_one_write_and_a_line(spark, tmp_path):
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "retry rounds")
    prompts = prompts_of(spark)
    run_rounds(prompts, answering(lambda i: i % 8), ledger_dir=str(tmp_path / "a"), commit_parts=2)
    jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    sc.setJobGroup("other", "")
    parts = 2 + 7  # rounds 0 to 7, the first in two parts
    # a part: its calls (the first ones after a shuffle of the prompts) and its line in the frontier
    assert jobs <= 2 * parts + 2
    assert read_ledger(spark, str(tmp_path / "a")).count() == sum(i % 8 + 1 for i in range(40))


def test_rows_carry_their_prompt_until_they_end(spark, tmp_path):
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "a")
    run_rounds(prompts_of(spark), answering(lambda i: i % 4, log), ledger_dir=ledger)
    got = calls(log)
    assert sorted((i, a) for i, a, *_ in got) == [(i, a) for i in range(40) for a in range(i % 4 + 1)]
    assert all(p == f"p{i}" for i, _, _, _, p in got)
    kept = spark.read.parquet(f"{ledger}/round=1").select("row_idx", "user_prompt").collect()
    assert {r.row_idx: r.user_prompt for r in kept} == {i: f"p{i}" if i % 4 > 1 else None for i in range(40) if i % 4 >= 1}
    out = resolve_attempts(prompts_of(spark), read_ledger(spark, ledger)).collect()
    assert {r.row_idx: r.n_attempts for r in out} == {i: i % 4 + 1 for i in range(40)}


def test_every_row_waits_for_its_own_due_time(spark, tmp_path):
    log = str(tmp_path / "calls")
    began = time.time()
    run_rounds(
        prompts_of(spark, 12).coalesce(1), answering(lambda i: 2, log, slow=0.1), ledger_dir=str(tmp_path / "a"),
        backoff=True, max_wait=1.5, batch_rows=1, commit_parts=1,
    )
    at = {(i, a): (start, end) for i, a, start, end, _ in calls(log)}
    for i in range(12):
        for a, wait in ((1, 1.0), (2, 1.5)):
            assert at[i, a][0] >= at[i, a - 1][1] + wait - 0.01
    # rows went on in the order in which they were due, none waited for a whole round
    for a in (1, 2):
        before = sorted(range(12), key=lambda i: at[i, a - 1][1])
        assert before == sorted(range(12), key=lambda i: at[i, a][0])
    assert time.time() - began < 60


@pytest.mark.parametrize("dies_at", [2, 3, 5])
def test_restart_takes_up_the_frontier(spark, tmp_path, monkeypatch, dies_at):
    from threadlens.operators import attempts

    log, ledger = str(tmp_path / "calls"), str(tmp_path / "a")
    real, seen = attempts.classify_attempts, []

    def dies(gen):
        seen.append(1)
        if len(seen) == dies_at:
            raise KeyboardInterrupt
        return real(gen)

    monkeypatch.setattr(attempts, "classify_attempts", dies)
    with pytest.raises(KeyboardInterrupt):
        run_rounds(prompts_of(spark), answering(lambda i: i % 3, log), ledger_dir=ledger)
    monkeypatch.setattr(attempts, "classify_attempts", real)
    run_rounds(prompts_of(spark), answering(lambda i: i % 3, log), ledger_dir=ledger, commit_parts=1)
    assert sorted((i, a) for i, a, *_ in calls(log)) == [(i, a) for i in range(40) for a in range(i % 3 + 1)]


def test_rows_of_a_part_without_a_line_are_kept_and_go_on(spark, tmp_path):
    """The job that wrote the part ended, the driver died before its line: no second call."""
    import shutil

    log, ledger = str(tmp_path / "calls"), str(tmp_path / "a")
    run_rounds(prompts_of(spark), answering(lambda i: i % 3, log), max_tries=1, ledger_dir=ledger, commit_parts=2)
    frontier = spark.read.schema(FRONTIER_SCHEMA).parquet(f"{ledger}-state/frontier").where("part = 0")
    rows = [tuple(r) for r in frontier.collect()]
    shutil.rmtree(f"{ledger}-state")
    spark.createDataFrame(rows, FRONTIER_SCHEMA).write.parquet(f"{ledger}-state/frontier")
    run_rounds(prompts_of(spark), answering(lambda i: i % 3, log), ledger_dir=ledger, commit_parts=2)
    assert sorted((i, a) for i, a, *_ in calls(log)) == [(i, a) for i in range(40) for a in range(i % 3 + 1)]
    assert read_ledger(spark, ledger).where("outcome = 'ok'").count() == 40


def test_nothing_to_do(spark, tmp_path):
    ledger = run_rounds(prompts_of(spark).limit(0), answering(lambda i: 0), ledger_dir=str(tmp_path / "a"))
    assert read_ledger(spark, ledger).count() == 0
