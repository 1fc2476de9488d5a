"""N-gram Jaccard join: against all pairs, the signature guarantee, edge cases."""

import random
import re

import numpy as np
import pytest
from conftest import SF_SMALL
from threadlens.llm import partenum_join as P
from threadlens.llm.queries import op6_ngram_jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (size, smallest reachable id), by comparing all pairs."""
    sets = [(i, brute_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 3 * max(len(a), len(b)) <= 4 * min(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 75 * (len(a) + len(b) - n):
                    x, y = sorted((top(i), top(j)))
                    root[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def test_whole_table(ready, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_ngram_jaccard(ready, SF_SMALL).collect()}
    assert got == brute([(d["doc_id"], d["text"]) for d in rows("documents")])


@pytest.mark.parametrize("subset", [1, 2])
def test_similar_sets_share_a_signature(subset):
    rng = np.random.default_rng(subset)
    none = P.Often((np.empty(0, np.uint64), np.empty(0, np.int64)))
    tried = 0
    for _ in range(3000):
        r = int(rng.integers(1, 30 if subset > 1 else 400))
        x = rng.integers(0, 2**63, r).astype(np.uint64)
        lose, gain = int(rng.integers(0, r // 5 + 1)), int(rng.integers(0, r // 5 + 1))
        y = np.concatenate([x[lose:], rng.integers(0, 2**63, gain).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 75 * (len(np.unique(np.concatenate([x, y])))):
            continue
        tried += 1
        every = np.unique(np.concatenate([P.parts(x, b) for b, _ in P.schemes(r)]))
        often = np.sort(rng.choice(every, len(every) // 2, replace=False))
        for hot in (none, P.Often((often, rng.integers(1, 5, len(often))))):
            a, b = (P.signatures(np.unique(v), hot, subset) for v in (x, y))
            assert np.intersect1d(a, b).size, (r, lose, gain)
    assert tried > 300


def _variants(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, passage = [], " ".join(rnd.choice(words) for _ in range(40))
    for i in range(n):
        if rows and rnd.random() < 0.7:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.3:
                w += [rnd.choice(words) for _ in range(rnd.randint(1, 12))]
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) + (" " + passage) * rnd.randint(0, 1)))
    return rows


def test_chains_and_shared_passages(ready):
    rows = [(1000 * s + i, t) for s in range(4) for i, t in _variants(s)]
    df = ready.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_all_parts_frequent_and_subsets_of_two(ready, monkeypatch):
    monkeypatch.setattr(P, "HOT_LOCAL", 1)
    rows = _variants(9, 120)
    df = ready.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.near_duplicates(df).collect()}
    assert got == brute(rows)
    small = [(i, " ".join(t.split()[:14])) for i, t in rows]
    df = ready.createDataFrame(small, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.near_duplicates(df, subset=2).collect()}
    assert got == brute(small)


def test_large_groups_are_compared_in_blocks(ready, monkeypatch):
    monkeypatch.setattr(P, "FEW", 2)
    monkeypatch.setattr(P, "BLOCK", 3)
    rnd = random.Random(8)
    common = " ".join(f"p{i}" for i in range(40))
    # a family whose members share much, but seldom enough to link
    rows = [(i, common + " " + " ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randint(5, 16)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in _variants(11, 50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.near_duplicates(ready.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [4, 512])
def test_a_pair_of_many_groups_is_made_in_one(ready, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = np.random.default_rng(6)
    shared = rng.integers(0, 2**64 - 1, 300, np.uint64)
    packed = [bytearray(P.packed(P.buckets(np.unique(np.append(shared, rng.integers(0, 2**64 - 1, 20, np.uint64)))))) for _ in range(14)]
    nodes = ready.createDataFrame(list(enumerate(packed)), "node long, buckets binary")
    # 90 groups, each without another few of the members; the last two nodes meet in one group only
    groups = {int(s): set(rng.choice(12, 9, replace=False).tolist()) for s in rng.integers(-(2**63), 2**63 - 1, 90)}
    groups |= {2**63 - 1: {12, 13}, -(2**63): {0, 12}, 5: {1, 13}}
    of = [min(n, 12) // 2 + (n == 13) for n in range(14)]  # two nodes a component, but for the last two
    rows = [(s, n, of[n], len(m)) for s, m in groups.items() for n in m]
    want = sorted({(a, b) for m in groups.values() for a in m for b in m if a < b and of[a] != of[b]})
    assert (12, 13) in want
    monkeypatch.setattr(type(nodes), "distinct", lambda df: df)  # what the comparison itself makes
    df = ready.createDataFrame(rows, "sig long, node long, c long, many long")
    assert sorted(tuple(r) for r in P.in_blocks(df, nodes).collect()) == want
    monkeypatch.setattr(P, "EARLIEST", 1)  # lists too short to show what is shared: more than once, but none lost
    assert {tuple(r) for r in P.in_blocks(df, nodes).collect()} == set(want)


def test_sets_that_share_a_name(ready, monkeypatch):
    monkeypatch.setattr(P, "NAME_BYTES", 1)
    rows = _variants(5, 40) + [(100 + i, t) for i, t in _variants(6, 40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.near_duplicates(ready.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(ready):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, " \n\x0b", "c"), (9, "One two", "d"), (4, "one\ttwo", "e"), (5, "one two three", "f"), (None, "one two", "g"),
        (None, None, "h"), (6, long, "i"), (7, long + " y", "j"), (8, "É a b c d", "k"), (10, "é a b c d", "l"), (11, "one two", "m"), (11, "one two", "n"),
    ]
    df = ready.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in P.near_duplicates(df).collect())
    assert got == [
        (False, 1, 0, 1), (False, 2, 0, 2), (False, 3, 0, 3), (False, 4, 1, 4), (False, 5, 1, 5), (False, 6, 29_996, 6), (False, 7, 29_997, 6),
        (False, 8, 1, 8), (False, 9, 1, 4), (False, 10, 1, 10), (False, 11, 1, 4), (False, 11, 1, 4), (True, 0, 0, None), (True, 0, 1, None),
    ]
    assert P.near_duplicates(df.limit(0)).count() == 0


def test_null_id_comes_before_a_copy_with_a_near_copy(ready, monkeypatch):
    monkeypatch.setattr(P, "FEW", 0)  # also in the block comparison
    a = " ".join(f"x{i}" for i in range(100))
    rows = [(None, a), (1, a), (2, a + " y"), (None, a + " y"), (3, "b " + a)]
    df = ready.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in P.near_duplicates(df).collect() if r.doc_id)
    assert got == [(1, 96, 1), (2, 97, 1), (3, 97, 1)]
    assert [r.component_id for r in P.near_duplicates(df).where("doc_id IS NULL").collect()] == [None, None]


def test_one_id_with_two_texts_links_both(ready):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (2, b), (5, a), (5, b), (6, "c d e f g h")]
    got = {(r.doc_id, r.component_id) for r in P.near_duplicates(ready.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 6)}


def test_tables_on_the_way_are_freed(ready):
    import os

    from threadlens.session import checkpoint_dir

    at = checkpoint_dir(ready).removeprefix("file:") + "/llm"
    have = lambda: set(os.listdir(at)) if os.path.isdir(at) else set()
    body = " ".join(f"word{i}" for i in range(60))
    docs = ready.createDataFrame([(i, f"{body} end{i}") for i in range(5)] + [(9, "else")], "doc_id long, text string")
    before = have()
    got = P.near_duplicates(docs)
    assert [n.split("-")[0] for n in have() - before] == ["components"]
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}


def test_large_unrelated_sets_are_not_brought_together(ready):
    rng = np.random.default_rng(3)
    one = np.unique(rng.integers(0, 2**64 - 1, 9000, np.uint64))
    near = np.unique(np.append(one[200:], rng.integers(0, 2**64 - 1, 200, np.uint64)))
    other = np.unique(rng.integers(0, 2**64 - 1, 9000, np.uint64))
    smaller = np.unique(np.append(one[:3000], rng.integers(0, 2**64 - 1, 4000, np.uint64)))  # fewer buckets
    sets = [one, near, other, smaller]
    coarse = np.stack([np.frombuffer(P.buckets(x), np.uint16).astype(np.int64) for x in sets])
    assert P._may_link(coarse, coarse)[0, 2]  # the 256 buckets don't tell
    counts = ready.createDataFrame([(i, bytearray(P.finer(x))) for i, x in enumerate(sets)], "node long, set binary")
    pairs = ready.createDataFrame([(0, 1), (0, 2), (0, 3), (2, 3)], "a long, b long")
    assert [tuple(r) for r in P.closer(pairs, counts).collect()] == [(0, 1)]


def test_shingles_of_many_texts_at_once():
    import pyarrow as pa

    rng = random.Random(5)
    signs = ["A", "b", "ß", " ", "\t", "\n", "\x1c", " ", "", "a" * 8, "b" * 9, "C" * 16, "d" * 65]
    texts = [None if rng.random() < 0.1 else "".join(rng.choices(signs, k=rng.choice([0, 1, 5, 40]))) for _ in range(400)]
    got = P.shingle_sets(pa.array(texts, pa.string()).slice(3, 390))
    want = [brute_set(t) for t in texts[3:393]]
    assert [len(x) for x in got] == [len(s) for s in want]
    assert len({x.tobytes() for x in got}) == len(set(map(frozenset, want)))
    assert all((np.diff(x) > 0).all() for x in map(np.ndarray.tolist, got))


def test_signatures_of_the_same_members_are_one_group(ready):
    rows = [(s, n) for s in range(50) for n in (1, 2, 3)] + [(s, n) for s in range(60, 63) for n in (2, 3)]
    rows += [(70, 4), (70, 4), (71, 4)] + [(60, 3)]  # one node alone; a row that two tasks made
    got = P.groups_of(ready.createDataFrame(rows, "sig long, node long")).collect()
    assert sorted((r.node, r.many, r.times) for r in got) == [(1, 3, 50), (2, 2, 3), (2, 3, 50), (3, 2, 3), (3, 3, 50)]
    members = {}
    for r in got:
        members.setdefault(r.sig, set()).add(r.node)
    assert sorted(map(sorted, members.values())) == [[1, 2, 3], [2, 3]]


def test_counts_by_bucket_take_as_few_bits_as_they_need():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64 - 1, n, np.uint64)) for n in (1, 300, 9000, 200, 90_000)]
    sets.append(np.arange(70_000, dtype=np.uint64) * np.uint64(P.BUCKETS))  # more in a bucket than is counted
    rows = [P.packed(P.buckets(x)) for x in sets]
    assert [len(r) for r in rows] == [128, 128, 256, 128, 512, 512]
    assert (P.unpacked(rows) == np.stack([np.frombuffer(P.buckets(x), np.uint16) for x in sets])).all()
    assert P.unpacked([]).shape == (0, P.BUCKETS)
