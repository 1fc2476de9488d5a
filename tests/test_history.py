"""History pages against a plain scan over each thread."""

import random

import pytest
from pyspark.sql import functions as F
from test_context_bruteforce import SCHEMA, random_threads

from threadlens.operators import history, scan
from threadlens.operators.history import history_pages, referred_messages


def brute(rows, i):
    r = rows[i]
    earlier = [x for x in rows[:i] if x["user_id"] == r["reply_to"]]
    kept = [x for x in earlier if x["category"] != "Original post" and x["msg_id"] is not None]
    out = ""
    for m in sorted({x["msg_id"] for x in kept}):
        out += f'\n- Message #{m}: "' + " ".join((x["message"] or "").strip() for x in kept if x["msg_id"] == m) + '"'
    return len(earlier), out


@pytest.mark.parametrize("page, rows_a_chunk", [(256, 1 << 14), (1, 3), (2, 4), (3, 1)])
def test_pages_cuts_and_chunks(spark, monkeypatch, page, rows_a_chunk):
    monkeypatch.setattr(history, "PAGE_MSGS", page)
    monkeypatch.setattr(scan, "CHUNK_ROWS", rows_a_chunk)
    threads = random_threads(page * 10 + rows_a_chunk, 30)
    rnd = random.Random(page)
    for rows in threads:  # numbers that repeat, jump and are missing
        for r in rows:
            r["msg_id"] = None if rnd.random() < 0.05 else r["msg_id"] * rnd.choice([1, 1, 1, 7]) - 3
    df = spark.createDataFrame([r for t in threads for r in t], SCHEMA)
    got = {(r.thread_id, r.row_idx): (r.n_before, r.referred) for r in referred_messages(df).collect()}
    want = {
        (t, i): brute(rows, i) for t, rows in enumerate(threads) for i, r in enumerate(rows) if r["reply_to"] not in (None, "N/A")
    }
    assert got == want


def test_one_user_of_ten_thousand_messages(spark, monkeypatch):
    """Replies throughout a long thread: whole histories, each message stored once."""
    monkeypatch.setattr(scan, "CHUNK_ROWS", 2_000)
    n = 10_000
    rows = spark.range(n + n // 400).select(
        F.lit("c").alias("corpus"), F.lit(1).cast("long").alias("thread_id"), F.col("id").alias("row_idx"),
        F.when(F.col("id") % 401 == 400, 5_000_000 + F.col("id")).otherwise(F.col("id") - F.floor(F.col("id") / 401)).alias("msg_id"),
        F.lit(1).cast("long").alias("utt_no"), F.when(F.col("id") % 401 == 400, "asker").otherwise("writer").alias("user_id"),
        F.concat(F.lit("m"), F.col("id")).alias("message"), F.when(F.col("id") % 401 == 400, "writer").alias("reply_to"),
        F.lit("Reply").alias("category"),
    )
    pages = history_pages(rows).where("key = 'writer'")
    assert pages.agg(F.sum("n"), F.count("*")).first()[:] == (n, -(-n // history.PAGE_MSGS))
    got = referred_messages(rows).orderBy("row_idx").collect()
    assert len(got) == n // 400
    for k, r in enumerate(got):
        own = [i for i in range(r.row_idx) if i % 401 != 400]
        assert r.n_before == len(own) == 400 * (k + 1)
        assert r.referred == "".join(f'\n- Message #{m}: "m{i}"' for m, i in enumerate(own))


def test_plan_has_no_window_and_no_cross_join(spark):
    df = spark.createDataFrame([r for t in random_threads(1, 5) for r in t], SCHEMA)
    plan = referred_messages(df)._jdf.queryExecution().executedPlan().toString()
    for node in ("Window", "CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert node not in plan


def test_rows_without_text(spark):
    df = spark.createDataFrame([r for t in random_threads(4, 10) for r in t], SCHEMA)
    whole = {(r.thread_id, r.row_idx): r for r in referred_messages(df).collect()}
    some = referred_messages(df, text_if=F.col("category") == "Reply").collect()
    reply = {(r.thread_id, r.row_idx) for r in df.where("category = 'Reply'").collect()}
    assert len(some) == len(whole)
    for r in some:
        w = whole[r.thread_id, r.row_idx]
        assert r.n_before == w.n_before and r.referred == (w.referred if (r.thread_id, r.row_idx) in reply else None)
