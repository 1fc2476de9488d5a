"""Benchmark decontamination: against full alignments, planted edits, edge cases."""

import random
import time

import numpy as np
import pytest
from conftest import SF_SMALL
from threadlens.llm import qgram_decontam as Q
from threadlens.llm.queries import op8_decontamination


def least_edits(item, text):
    """Fewest edits between the item and any stretch of the text."""
    a, b = Q.plain(item), Q.plain(text)
    row = np.zeros(len(b) + 1, np.int64)
    at = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (b != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def test_whole_table(ready, rows):
    got = {(r.doc_id, r.item_id): r for r in op8_decontamination(ready, SF_SMALL).collect()}
    items = [(i["item_id"], i["text"]) for i in rows("benchmark")]
    want = set()
    for d in rows("documents"):
        for i, t in items:
            if len(d["text"] or "") >= 30 and least_edits(t, d["text"]) <= Q.edits(len(t)):
                want.add((d["doc_id"], i))
    assert set(got) == want and want


def test_planted_edits_are_all_found(rows):
    rnd = random.Random(4)
    items = [(i["item_id"], i["text"]) for i in rows("benchmark")]
    index, docs = Q.Index(items), [d["text"] for d in rows("documents")]
    texts, truth = [], []
    for _ in range(150):
        i, t = rnd.choice(items)
        chars = list(t.upper() if rnd.random() < 0.3 else t)
        for _ in range(rnd.randint(0, Q.edits(len(t)) + 3)):
            p = rnd.randrange(len(chars))
            chars[p : p + rnd.randint(0, 1)] = rnd.choice(["", "x", "\n", "q"])
        around = rnd.choice(docs)
        cut = rnd.randint(0, len(around))
        texts.append(around[:cut] + "".join(chars) + around[cut:])
        truth.append(i)
    for text, matches in zip(texts, index.scan(texts), strict=True):
        found = {m[0]: m for m in matches}
        for i, t in items:
            least = least_edits(t, text)
            assert (i in found) == (least <= Q.edits(len(t))), (i, least)
        for i, a, b, e in matches:
            assert least_edits(dict(items)[i], text[a:b]) == e


def test_both_ends_repeats_and_short_items():
    t = "the quick brown fox jumps over the lazy dog and runs away from it all"
    index = Q.Index([(1, t), (2, "Short item"), (3, t), (None, "x" * 60)])
    got = index.scan([t, "a " + t + " b " + t, "a SHORT\nITEM here, short item", None, "", "nothing", "x" * 200])
    assert [(m[0], m[1], m[2]) for m in got[0]] == [(1, 0, len(t)), (3, 0, len(t))]
    assert [m[1] for m in got[1] if m[0] == 1] == [2, len(t) + 5]
    assert got[2] == [(2, 2, 12, 0), (2, 19, 29, 0)]
    assert got[3] == got[4] == got[5] == [] and got[6]


@pytest.mark.parametrize("size", [50, 10_000_000])
def test_blocks_nulls_and_clashing_names(ready, size, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_CHARS", size)
    t = "the quick brown fox jumps over the lazy dog and runs away from it all"
    docs = ready.createDataFrame([(None, t, 1), (7, None, 2), (7, "", 3), (8, "y" * 100_000 + t, 4), (8, "y" * 100_000 + t, 4)], "doc_id long, text string, item_id int")
    bench = ready.createDataFrame([(1, t), (2, None), (3, ""), (4, "z" * 90)], "item_id long, text string")
    got = Q.find_passages(docs, bench).collect()
    assert sorted((r.item_id, [(m.item_id, m.start) for m in r._matches]) for r in got) == [
        (1, [(1, 0)]), (2, []), (3, []), (4, [(1, 100_000)]), (4, [(1, 100_000)]),
    ]
    assert Q.find_passages(docs, bench.limit(0)).where("size(_matches) > 0").count() == 0
    assert Q.find_passages(docs.limit(0), bench).count() == 0


def test_windows_equal_single_alignments():
    rnd = np.random.default_rng(3)
    item = rnd.integers(97, 101, 140).astype(np.uint32)
    for _ in range(20):
        region = item.copy()
        for p in rnd.integers(0, len(region), 12):
            region = np.insert(region, p, 120) if rnd.random() < 0.5 else np.delete(region, min(p, len(region) - 1))
        region = region[rnd.integers(0, 30) :]
        starts = np.arange(len(item) - Q.PART + 1)
        before, under = starts - 40, np.arange(Q.PART + 50)
        place = before[:, None] + under
        chars = np.where((place >= 0) & (place < len(region)), region[np.clip(place, 0, len(region) - 1)], 0)
        size = np.full(len(starts), len(region))
        got = Q.window_edits(item[starts[:, None] + np.arange(Q.PART)], chars, before, size)
        every = Q.align_many(item, starts, np.full(len(starts), Q.PART), region, before, before, size, 51)
        for s in starts.tolist():
            want = Q.align(item[s : s + Q.PART], region, s - 40, s + 10, Q.PART_EDITS)
            assert (got[s] if got[s] <= Q.PART_EDITS else None) == (want[0] if want else None)
            assert tuple(every[s]) == Q.align(item[s : s + Q.PART], region, s - 40, s + 10, Q.PART)


def test_parts_and_replaced_words(ready):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(70)]
    item = " ".join(words)[:400]
    short = " ".join(words[::-1])[:233]
    changed = list(short)
    for at in (60, 120, 180):
        changed[at : at + 5] = "VWXYZ"
    noise = " ".join("".join(rnd.choice("qrstuvwxyz") for _ in range(5)) for _ in range(60))
    texts = [
        item[:360], noise + item[200:] + noise, noise + item[100:300], "".join(changed) + noise, item[50:130], item[50 : 50 + Q.PART - Q.PART_EDITS - 1],
        noise, item[:100] + noise + item[300:], noise + item, None,
    ]
    docs = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = ready.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    got = {r.doc_id: [tuple(m) for m in r._matches] for r in Q.find_passages(docs, bench).collect()}
    n = len(noise)
    assert [m[0] for m in got[3]] == [2] and got[5] == got[6] == got[9] == []
    assert [(m[0], m[1] <= a, m[2] >= b, m[3] <= 2 * Q.PART_EDITS) for d, a, b in ((0, 0, 360), (1, n, n + 200), (2, n, n + 200), (4, 0, 80)) for m in got[d]] == [(1, True, True, True)] * 4
    assert [m[0] for m in got[7]] == [1, 1] and got[8] == [(1, n, n + 400, 0)]


def random_text(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(n // 5))[:n]


@pytest.mark.parametrize("size", [60, 95])
def test_wording_that_all_items_share(size):
    """Against all windows of all items aligned with the whole text."""
    rnd = random.Random(size)
    template = random_text(rnd, size)
    items = [(k, random_text(rnd, 50) + template + random_text(rnd, 50)) for k in range(6)] + [(9, random_text(rnd, 150))]
    text = "".join(random_text(rnd, 40) + template for _ in range(5)) + items[2][1][30:150]
    want, codes = set(), Q.plain(text)
    for k, t in items:
        c = Q.plain(t)
        if any(Q.align(c[s : s + Q.PART], codes, -s - Q.PART, len(codes) - s, Q.PART_EDITS) for s in range(len(c) - Q.PART + 1)):
            want.add(k)
    whole = Q.Index(items).scan([text], parts=True)[0]
    assert {m[0] for m in whole} == want and want == ({2} if size < 75 else {*range(6)})
    for k, a, b, e in whole:
        assert b - a >= Q.PART - Q.PART_EDITS and e <= 2 * Q.PART_EDITS and least_edits(text[a:b], dict(items)[k]) <= e
    if size > Q.PART:
        assert [sum(m[0] == k for m in whole) for k, _ in items[:2]] == [6, 6]  # five times, and in the part of an item


@pytest.mark.parametrize("rows", [1, 1000])
def test_portions_change_nothing(rows, monkeypatch):
    rnd = random.Random(5)
    template = random_text(rnd, 90)
    items = [(k % 5, random_text(random.Random(k % 7), 60) + template) for k in range(12)]  # equal texts too
    texts = [random_text(rnd, 30) + items[i][1] + template * 2 for i in range(4)]
    whole = Q.Index(items).scan(texts, parts=True)
    monkeypatch.setattr(Q, "PAIR_ROWS", rows)
    monkeypatch.setattr(Q, "WINDOW_ROWS", 7)
    assert Q.Index(items).scan(texts, parts=True) == whole and all(whole)


@pytest.mark.parametrize("size", [60, 100])
def test_common_wording_many_times_is_fast(size):
    rnd = random.Random(1)
    template = random_text(rnd, size)
    items = [(k, template + " " + random_text(rnd, 150)) for k in range(200)]
    text = "".join(random_text(rnd, 30) + template for _ in range(100))
    index, begun = Q.Index(items), time.process_time()
    got = index.scan([text], parts=True)[0]
    assert len(got) == (0 if size < 75 else 200 * 100) and time.process_time() - begun < 60
