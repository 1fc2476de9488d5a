"""SimHash near-duplicates: against all pairs, the adders, tiles, odd rows."""

import random
import re

import numpy as np
import xxhash
from conftest import SF_SMALL
from threadlens.llm import sliced_simhash as S
from threadlens.llm.queries import op13_simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """doc_id -> (fingerprint, smallest reachable id), by comparing all pairs."""
    made = [(i, brute_print(t)) for i, t in rows]
    return groups(made)


def groups(made):
    root = {i: i for i, _ in made}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(made):
        for j, b in made[:k]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {(i, f"{f:016x}", top(i)) for i, f in made}


def told(df):
    return {(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()}


def test_whole_table(ready, rows):
    want = brute([(d["doc_id"], d["text"]) for d in rows("documents")])
    assert told(op13_simhash_dedup(ready, SF_SMALL)) == want
    assert len({c for _, _, c in want}) < len(want)


def family(rnd, n, most):
    """Fingerprints around one another: chains of changed bits."""
    out = [rnd.getrandbits(64)]
    while len(out) < n:
        f = rnd.choice(out)
        for _ in range(rnd.randint(1, most)):
            f ^= 1 << rnd.randrange(64)
        out.append(f)
    return out


def test_adders_agree_with_popcounts():
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 200):
        fp = np.array(family(random.Random(n), n, 3), np.uint64)
        fp[0] = 0
        planes = S.sliced(fp)
        q, word = np.repeat(np.arange(n), planes.shape[1]), np.tile(np.arange(planes.shape[1]), n)
        mask = rng.integers(0, 2**63, len(q)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        left, near = S.within(planes, fp[q], word, mask)
        bits = np.zeros((len(q), 64), np.uint8)
        bits[left] = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        padded = np.zeros(planes.shape[1] * 64, np.uint64)
        padded[:n] = fp
        want = np.bitwise_count(fp[q][:, None] ^ padded.reshape(-1, 64)[word]) <= 4
        want &= np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        assert (bits.astype(bool) == want).all()


def test_large_keys_are_dealt_into_tiles(ready, monkeypatch):
    monkeypatch.setattr(S, "TILE", 7)
    monkeypatch.setattr(S, "HELD", 50)
    monkeypatch.setattr(S, "ITEMS", 9)
    monkeypatch.setattr(S, "FEW_HOT", 3)
    for seed, most in ((1, 3), (2, 6), (3, 9)):
        rnd = random.Random(seed)
        prints = list(dict.fromkeys(family(rnd, 90, most) + family(rnd, 40, 2) + [rnd.getrandbits(64) for _ in range(20)]))
        signed = [f - (1 << 64) if f >> 63 else f for f in prints]
        nodes = ready.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
        got = {r.node: r.component for r in S.components(S.edges(nodes)).collect()}
        of = {i: c for i, _, c in groups(list(enumerate(prints)))}
        for i, f in enumerate(signed):
            for j, g in enumerate(signed[:i]):
                assert (of[i] == of[j]) == (got.get(f, f) == got.get(g, g))


def test_odd_rows(ready, tmp_path):
    long = " ".join(f"x{i % 997}" for i in range(150_000))
    rows = [
        (1, None), (2, ""), (3, " \n\x0b"), (9, "One two"), (4, "one\ttwo"), (5, "one two three"), (6, long), (7, long + " y"), (8, "É a b c d"),
        (10, "é a b c d"), (11, "a\x1cb c\x85d e f g"), (12, "one two"), (12, "one two"), (13, "the same four words " * 50),
    ]
    more = [(None, "one two"), (None, None)]
    df = ready.createDataFrame([(i, t, "clash", 1) for i, t in rows + more], "doc_id long, text string, fp string, low long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_simhash_dedup(ready, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(more)
    want = brute(list(dict(rows).items()))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want
    assert sorted((r.fingerprint, r.component_id) for r in got if r.doc_id is None) == sorted([(f"{brute_print('one two'):016x}", None), ("0" * 16, None)])
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert told(op13_simhash_dedup(ready, f"{tmp_path}/none")) == set()


def test_one_id_with_two_texts_links_both(ready):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (2, b), (5, a), (5, b), (6, "c d e f g h")]
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(ready.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 6)}
