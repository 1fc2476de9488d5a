"""Merkle manifest: against plain recursion over lists, edge cases, block sizes."""

import zlib
from hashlib import sha256

import pytest
from conftest import SF_SMALL
from threadlens.llm import merkle_manifest as M
from threadlens.llm.queries import op11_merkle_manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(d, more=0):
    n = d["n_chars"]
    return h("".join(enc(v) for v in (d["doc_id"], d["source"], d["lang"], n if n is None else n + more, d["text"])))


def tree(nodes):
    """Root and, per node, the siblings as (left ones, right ones) level by level."""
    paths = [[] for _ in nodes]
    level = [(d, [i]) for i, d in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 2):
            run = level[k : k + 2]
            for j, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(([x for x, _ in run[:j]], [x for x, _ in run[j + 1 :]]))
            above.append((h("".join(x for x, _ in run)), [i for _, b in run for i in b]))
        level = above
    return level[0][0] if level else None, paths


def brute(rows):
    groups = {}
    for d in rows:
        groups.setdefault(d["lang"], []).append(d)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        own = sorted(groups[g], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf_of(d)))
        made[g] = (own, *tree([leaf_of(d) for d in own]))
    root, upper = tree([made[g][1] for g in order])
    out = []
    for g, path in zip(order, upper):
        own, subroot, paths = made[g]
        for d, p in zip(own, paths):
            siblings = [x for left, right in p + path for x in left + right]
            changed = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            at = leaf_of(d, 1 if changed else 0)
            for left, right in p + path:
                at = h("".join(left) + at + "".join(right))
            out.append((d["doc_id"], leaf_of(d), subroot, root, h("".join(siblings)), at, at == root))
    return sorted(out, key=str)


COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def got(spark, path):
    return sorted((tuple(r[c] for c in COLUMNS) for r in op11_merkle_manifest(spark, path).collect()), key=str)


def test_whole_table(ready, rows):
    made = got(ready, SF_SMALL)
    assert made == brute(rows("documents"))
    assert 0 < sum(not r[-1] for r in made) < len(made) / 3


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, proof string"


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_sizes_and_odd_rows(ready, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    docs = []
    for g, n in zip([None, "", "de", "é", "z", "zz"], [1, 2, 3, 9, 33, 70]):
        docs += [(i * 3, f"t{i} é\n", g, None if i % 2 else "web", None if i % 5 == 0 else i) for i in range(n)]
    docs += [(None, None, "de", None, None), (None, None, "de", None, None), (7, "", "é", "", 0), (7, "", "é", "", 0), (7, "x" * 100_000, "é", "s", 2)]
    docs += [(None, "a", None, None, 1), (10**15, "a", "z", "s", 2**62)]
    df = ready.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA)
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d)) for d in docs])
    assert got(ready, str(tmp_path)) == want


def test_empty_and_single(ready, tmp_path):
    df = ready.createDataFrame([(1, "a", "en", "s", 1, "", "")], SCHEMA)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert got(ready, f"{tmp_path}/none") == []
    df.write.parquet(f"{tmp_path}/one/documents.parquet")
    ((_, leaf, subroot, root, proof, folded, verified),) = got(ready, f"{tmp_path}/one")
    assert leaf == subroot == root == folded and proof == h("") and verified


def test_queue_sweeps_any_subtree():
    for n in range(1, 40):
        digests = [sha256(bytes([i])).digest() for i in range(n)]
        root, paths = tree([d.hex() for d in digests])
        levels = M.height(n)
        nodes = M.forward(0, n, digests, levels)
        assert nodes[levels, 0].hex() == root
        proofs = M.backward(nodes, (levels, 0), b"end")
        for i in range(n):
            assert proofs[i] == bytes.fromhex("".join(x for a, b in paths[i] for x in a + b)) + b"end"
            assert M.fold(digests[i], proofs[i], (i, n)).hex() == root
