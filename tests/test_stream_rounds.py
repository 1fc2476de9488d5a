"""What a stream's micro-batches cost, and what becomes of the rows that they leave."""

import os

import pytest
from pyspark.sql import functions as F
from test_rounds import answering, calls

from threadlens.operators.attempts import read_ledger
from threadlens.streaming.annotate_stream import annotate_stream, start_annotate_stream

BATCHES = 5


def prompt_files(spark, path, at=0, n=BATCHES, rows=8):
    for b in range(at, at + n):
        spark.range(b * rows, (b + 1) * rows).coalesce(1).select(
            F.lit("c").alias("corpus"), F.lit(1).cast("long").alias("thread_id"), F.col("id").alias("row_idx"),
            F.concat(F.lit("p"), F.col("id").cast("string")).alias("user_prompt"),
        ).write.mode("append").parquet(path)


def good_from():
    return lambda i: 9 if i == 3 else i % 4  # row 3 never ends


def made(n, tries):
    return sorted((i, a) for i in range(n) for a in range(min(good_from()(i) + 1, tries)))


def told(log):
    return sorted((i, a) for i, a, *_ in calls(log))


def test_later_rounds_are_made_once_for_all_micro_batches(spark, tmp_path):
    src, work, log = (str(tmp_path / x) for x in ("prompts", "work", "log"))
    prompt_files(spark, src)
    sc = spark.sparkContext
    before = sc._jsc.sc().dagScheduler().nextJobId()
    out = annotate_stream(spark, src, answering(good_from(), log), "", work, max_tries=6, commit_parts=1)
    jobs = sc._jsc.sc().dagScheduler().nextJobId() - before
    # a micro-batch: its round and its line; a later round: the same, once; and what stands around them
    assert jobs <= 2 * BATCHES + 2 * 5 + 12
    assert told(log) == made(40, 6)
    assert all(p == f"p{i}" for i, _, _, _, p in calls(log))
    assert {r.row_idx: (r.status, r.n_attempts) for r in out.collect()} == {
        i: ("failed", 6) if i == 3 else ("ok", i % 4 + 1) for i in range(40)
    }
    assert sorted(x for x in os.listdir(f"{work}/ledger/run=0") if x.startswith("batch=")) == ["batch=0", "batch=0to4", *[f"batch={b}" for b in range(1, 5)]]
    # once more, without and with new files: nothing is sent again
    annotate_stream(spark, src, answering(good_from(), log), "", work, max_tries=6, commit_parts=1)
    assert told(log) == made(40, 6)
    prompt_files(spark, src, BATCHES, 2)
    out = annotate_stream(spark, src, answering(good_from(), log), "", work, max_tries=6)
    assert told(log) == made(56, 6) and out.where("status = 'ok'").count() == 55


@pytest.mark.parametrize("dies_at", [3, 7, 9, 11])
def test_a_died_stream_is_taken_up(spark, tmp_path, monkeypatch, dies_at):
    """It dies in a micro-batch (2 parts each) or in the later rounds; meanwhile there is a new file."""
    from threadlens.operators import attempts

    src, work, log = (str(tmp_path / x) for x in ("prompts", "work", "log"))
    prompt_files(spark, src, n=3)
    real, seen = attempts.classify_attempts, []

    def dies(gen):
        seen.append(1)
        if len(seen) == dies_at:
            raise RuntimeError("died")
        return real(gen)

    monkeypatch.setattr(attempts, "classify_attempts", dies)
    with pytest.raises(Exception, match="died"):
        annotate_stream(spark, src, answering(good_from(), log), "", work, max_tries=6, commit_parts=2)
    monkeypatch.setattr(attempts, "classify_attempts", real)
    prompt_files(spark, src, 3, 1)
    out = annotate_stream(spark, src, answering(good_from(), log), "", work, max_tries=6, commit_parts=2)
    assert told(log) == made(32, 6)
    assert read_ledger(spark, f"{work}/ledger/run=0").count() == len(made(32, 6))
    assert out.where("status = 'ok'").count() == 31


def test_a_micro_batch_with_later_rounds_goes_on_by_itself(spark, tmp_path):
    """Micro-batches of a stream that is not waited for make all their rounds; nothing of them is sent again."""
    src, work, log = (str(tmp_path / x) for x in ("prompts", "work", "log"))
    prompt_files(spark, src, n=2)
    q = start_annotate_stream(spark, src, answering(good_from(), log), "", work, max_tries=3)
    q.awaitTermination()
    assert q.exception() is None and told(log) == made(16, 3)
    prompt_files(spark, src, 2, 1)
    annotate_stream(spark, src, answering(good_from(), log), "", work, max_tries=3)
    assert told(log) == made(24, 3)
