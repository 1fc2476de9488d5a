"""J1-J6 / C1-C3 against a nested-loop restatement on random small threads:
interleaved messages, self-replies, null / 'N/A' / blank targets, targets who
never speak, one-row threads, blank and null utterances."""

import random

import pytest

import bruteforce as BF

USERS = ["u1", "u2", "u3", "u4"]
TARGETS = USERS + [None, None, "N/A", "", "ghost", " u2 "]
CATS = ["Original post", "Comment", "Reply", None]
TEXTS = ["hello", " padded ", "", "  ", None, "a b", "multi\nline", "ünï", "x" * 30, "tail　"]


def random_threads(seed: int, n_threads: int = 40):
    rnd = random.Random(seed)
    out = []
    for t in range(n_threads):
        n = rnd.choice([1, 2, 3, 5, 8, 13, 21])
        msg, rows = 1, []
        for i in range(n):
            if rnd.random() < 0.35 and i > 0:
                msg = rnd.choice([r["msg_id"] for r in rows])  # interleave / continue a message
            elif i > 0:
                msg = max(r["msg_id"] for r in rows) + 1
            uid = rnd.choice(USERS)
            rows.append(
                {
                    "corpus": "c",
                    "thread_id": t,
                    "row_idx": i,
                    "msg_id": msg,
                    "utt_no": 0,
                    "user_id": uid,
                    "message": rnd.choice(TEXTS),
                    "reply_to": uid if rnd.random() < 0.1 else rnd.choice(TARGETS),
                    "category": rnd.choice(CATS),
                }
            )
        counts = {}
        for r in rows:
            counts[r["msg_id"]] = counts.get(r["msg_id"], 0) + 1
            r["utt_no"] = counts[r["msg_id"]]
        out.append(rows)
    return out


SCHEMA = (
    "corpus string, thread_id long, row_idx long, msg_id long, utt_no long, user_id string, "
    "message string, reply_to string, category string"
)


@pytest.fixture(params=[None, 3], ids=["default", "chunk3"])
def chunk(request, monkeypatch):
    """Run each test with whole groups in one chunk and with 3-row chunks
    (every longer group then crosses chunk boundaries)."""
    from threadlens.operators import scan

    if request.param is not None:
        monkeypatch.setattr(scan, "CHUNK_ROWS", request.param)
    return request.param


def frame(spark, threads, layout):
    rows = [dict(r, layout=layout) for th in threads for r in th]
    return spark.createDataFrame(rows, SCHEMA + ", layout string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_threaded_narratives(spark, chunk, seed):
    from threadlens.operators.context import context_threaded

    threads = random_threads(seed)
    got = {(r.thread_id, r.row_idx): r.narrative for r in context_threaded(frame(spark, threads, "threaded")).collect()}
    n = 0
    for t, rows in enumerate(threads):
        for i in range(len(rows)):
            assert got[(t, i)] == BF.threaded(rows, i), (seed, t, i)
            n += 1
    assert len(got) == n


@pytest.mark.parametrize("seed", [4, 5])
def test_sequential_narratives(spark, chunk, seed):
    from threadlens.operators.context import context_sequential

    threads = random_threads(seed)
    got = {(r.thread_id, r.row_idx): r.narrative for r in context_sequential(frame(spark, threads, "sequential")).collect()}
    for t, rows in enumerate(threads):
        for i in range(len(rows)):
            assert got[(t, i)] == BF.sequential(rows, i), (seed, t, i)


@pytest.mark.parametrize("seed", [6, 7])
def test_context_pair(spark, chunk, seed):
    from threadlens.operators.context import context_pair

    threads = random_threads(seed)
    got = {(r.thread_id, r.row_idx): (r.prev_msg, r.next_msg) for r in context_pair(frame(spark, threads, "threaded")).collect()}
    for t, rows in enumerate(threads):
        for i in range(len(rows)):
            assert got[(t, i)] == BF.pair(rows, i), (seed, t, i)


def test_no_cartesian_or_nested_loop_in_context_plans(spark):
    from threadlens.operators.context import context_pair, local_context

    df = frame(spark, random_threads(9, 5), "threaded")
    for plan_df in (local_context(df), context_pair(df)):
        plan = plan_df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        assert "Python" not in plan and "ArrowEval" not in plan


def test_reply_message_cut_at_probe_row(spark):
    """A reply message that starts before the probe row contributes only its
    later rows (exercises the partial-text lookup of J5)."""
    from threadlens.operators.context import context_threaded, replies_received

    base = {"corpus": "c", "thread_id": 1, "utt_no": 1, "category": "Reply"}
    rows = [
        dict(base, row_idx=0, msg_id=1, user_id="a", message="a0", reply_to=None),
        dict(base, row_idx=1, msg_id=2, user_id="b", message="b1", reply_to="a"),
        dict(base, row_idx=2, msg_id=1, user_id="a", message="a2", reply_to=None),
        dict(base, row_idx=3, msg_id=2, user_id="b", message="b3", reply_to="a"),
        dict(base, row_idx=4, msg_id=3, user_id="c", message="c4", reply_to="a"),
    ]
    df = frame(spark, [rows], "threaded")
    got = {r.row_idx: (r.r1, r.r2) for r in replies_received(df).collect()}
    assert got[0][0]["text"] == "b1 b3" and got[0][1]["text"] == "c4"
    assert got[2][0]["text"] == "b3" and got[2][1]["msg_id"] == 3
    narr = {r.row_idx: r.narrative for r in context_threaded(df).collect()}
    for i in range(len(rows)):
        assert narr[i] == BF.threaded(rows, i)
