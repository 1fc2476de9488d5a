"""Chat formatting against plain Python, and its edge cases."""

import hashlib
from collections import defaultdict

from conftest import SF_SMALL
from pyspark.sql import functions as F
from threadlens.llm import chat_format as C
from threadlens.llm.queries import GUARD_ID, GUARD_TEXT, op1_chat_formatting

PART = C.PART_TYPE


def brute(rows):
    conv = defaultdict(list)
    for r in rows:
        conv[r["conv_id"]].append(r)
    out = {}
    for c, turns in conv.items():
        turns = sorted(turns, key=lambda r: r["turn"])
        said = "".join(f"{r['role']}\n{r['text'] or ''}\n" for r in turns)
        loss = "".join(r["text"] or "" for r in turns if r["role"] == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_equals_brute_force(ready, rows):
    want = rows("conversations") + [
        {"conv_id": GUARD_ID, "turn": i, "role": r, "text": GUARD_TEXT} for i, r in enumerate(("user", "assistant"))
    ]
    got = op1_chat_formatting(ready, SF_SMALL).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(want)
    assert len(got) == len({r.conv_id for r in got})


def test_parts_become_ordered_placeholders(ready):
    p = lambda t, **k: {"type": t, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    data = [
        (1, 0, "user", [p("text", text="see <image:1> "), p("image", ref="a.png", width=1024, height=512), p("audio", ref="b.wav", seconds=2.0)]),
        (1, 1, "assistant", [p("text", text="ok \\s </turn>\n"), p("document", ref="c.pdf", pages=3), p("odd", ref="x")]),
        (2, None, None, None),
        (2, 0, "user", []),
    ]
    df = ready.createDataFrame(data, f"conv_id long, turn long, role string, parts {PART}").withColumn("len", F.lit(1))
    got = {r.conv_id: r for r in C.read_back(C.format_chat(df)).collect()}
    one = got[1]
    assert one.formatted.count("<turn:") == 2 and one.formatted_chars == len(one.formatted)
    assert [(a.ordinal, a.type, a.ref, a.tokens, a.turn_index) for a in one.attachments] == [
        (1, "image", "a.png", 85 + 2 * 170, 0), (2, "audio", "b.wav", 50, 0), (3, "document", "c.pdf", 1800, 1), (4, "part", "x", 0, 1),
    ]
    assert one.read_turns[0].text == "see <image:1> <image:1><audio:2>"
    assert "see \\limage:1\\g <image:1><audio:2>" in one.formatted
    assert one.read_loss == ["ok \\s </turn>\n<document:3><part:4>"]
    assert [t.role for t in got[2].read_turns] == ["", "user"] and got[2].read_loss == []


def test_ties_repeats_nulls_and_empty(ready):
    data = [(None, 1, "assistant", "b"), (None, 1, "assistant", "a"), (5, 0, "assistant", None), (5, 0, "assistant", None), (6, 2, "user", "x" * 200_000)]
    df = ready.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("parts", C.text_part(F.col("text")))
    got = {r.conv_id: r for r in C.digest(C.format_chat(df)).collect()}
    assert got[None].loss_chars == 2 and got[None].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert got[5].n_turns == 2 and got[5].loss_chars == 0
    assert got[6].formatted_chars > 200_000
    assert C.digest(C.format_chat(df.limit(0))).count() == 0
