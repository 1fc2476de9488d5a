"""Run identity, rejects, todo bitmaps."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.constants import OUTPUT_COLUMNS
from threadlens.operators.output import complete_runs, read_run, write_annotations
from threadlens.operators.resume import todo_rows
from threadlens.operators.schema import BAD_NUMBER, MISSING_NUMBER, split_rejects


def table(spark, text):
    return spark.createDataFrame([("a", 1, text), ("b", 2, text)], "corpus string, thread_id long, annotation_act string")


def test_no_run_overwrites_another(spark, tmp_path):
    base = str(tmp_path)
    write_annotations(table(spark, "first"), base, "r1")
    write_annotations(table(spark, "second"), base, "r2", csv=True)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_annotations(table(spark, "third"), base, "r1")
    assert {r.annotation_act for r in read_run(spark, base).collect()} == {"second"}
    assert {r.annotation_act for r in read_run(spark, base, "r1").collect()} == {"first"}
    assert {r.run_id for r in read_run(spark, base).collect()} == {"r2"}
    assert sorted(r.run_id for r in complete_runs(spark, base).collect()) == ["r1", "r2"]


def test_a_run_that_died_is_not_read(spark, tmp_path):
    base = str(tmp_path)
    write_annotations(table(spark, "first"), base, "r1")
    table(spark, "half").write.partitionBy("corpus").parquet(f"{base}/table/run_id=r2")  # no line in complete
    assert {r.annotation_act for r in read_run(spark, base).collect()} == {"first"}
    with pytest.raises(ValueError, match="no complete run r2"):
        read_run(spark, base, "r2")


@pytest.mark.parametrize("kind", ["string", "long"])
def test_rejects_are_set_apart_with_their_reason(spark, tmp_path, kind):
    raw = ["1", None, " ", "x", "2.0", "2.5", "7", "99999999999999999999"]
    if kind == "long":
        raw = [1, None, None, 4]
    rows = [("c", 1, i, m, "u", f"t{i}", i % 3) for i, m in enumerate(raw)]
    df = spark.createDataFrame(rows, f"corpus string, thread_id long, row_idx long, `Msg#` {kind}, `User ID` string, Message string, reject int")
    accepted, rejected = split_rejects(df, str(tmp_path / kind))
    if kind == "long":
        assert {(r.row_idx, r.msg_id) for r in accepted.collect()} == {(0, 1), (3, 4)}
        assert {(r.row_idx, r.reject_reason) for r in rejected.collect()} == {(1, MISSING_NUMBER), (2, MISSING_NUMBER)}
        return
    assert {(r.row_idx, r.msg_id, r.message) for r in accepted.collect()} == {(0, 1, "t0"), (4, 2, "t4"), (6, 7, "t6")}
    want = {(1, None, MISSING_NUMBER), (2, " ", MISSING_NUMBER), (3, "x", BAD_NUMBER), (5, "2.5", BAD_NUMBER), (7, raw[7], BAD_NUMBER)}
    assert {(r.row_idx, r.raw_msg_id, r.reject_reason) for r in rejected.collect()} == want
    assert "reject" in accepted.columns and "reject" in rejected.columns  # other columns stay


def test_todo_bitmaps_equal_an_anti_join(spark):
    rnd = random.Random(3)
    keys = [("c", t, i) for t, n in ((1, 1), (2, 63), (3, 64), (4, 65), (5, 400)) for i in range(n)]
    utt = spark.createDataFrame([(*k, f"m{k[2]}") for k in keys], "corpus string, thread_id long, row_idx long, message string")
    state = {k: rnd.choice(["Claim", "__FAILED__", "", None]) for k in keys if rnd.random() < 0.9}
    blank = {c: F.lit("x") for c in OUTPUT_COLUMNS if c != "annotation_act"}
    prior = spark.createDataFrame([(*k, v) for k, v in state.items()], "corpus string, thread_id long, row_idx long, annotation_act string").withColumns(blank)
    for retry in (False, True):
        done = {"Claim"} if retry else {"Claim", "__FAILED__"}
        got = todo_rows(utt, prior, retry)
        assert got.columns == utt.columns
        assert sorted((r.corpus, r.thread_id, r.row_idx) for r in got.collect()) == sorted(k for k in keys if state.get(k) not in done)
