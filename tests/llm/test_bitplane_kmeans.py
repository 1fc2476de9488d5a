"""Centroid clustering: against plain integer arithmetic, packing, odd rows."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF_SMALL
from threadlens.llm import bitplane_kmeans as B
from threadlens.llm.queries import op12_centroid_clustering


def brute(rows, k=40, rounds=5):
    """(id, cluster, distance, cluster inertia, inertia, digest) by plain loops."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(x)) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in first[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [assign(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    made = [(i, *assign(v)) for i, v in kept]
    inertia = {}
    for _, d, c in made:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in made), key=str)


def got(spark, path):
    names = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()
    return sorted((tuple(r[c] for c in names) for r in op12_centroid_clustering(spark, path).collect()), key=str)


def test_whole_table(ready, rows):
    want = brute([(r["vec_id"], r["embedding"]) for r in rows("embeddings")])
    assert got(ready, SF_SMALL) == want
    assert len({c for _, c, *_ in want}) > 1


def test_dot_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (1, 2, 200, 2**26):
        x, y = rng.integers(-top, top, (50, 64)), rng.integers(-top // 2 - 1, top, (7, 64))
        x[0], y[0], x[1] = -top, top - 1, 0
        p, q = B.planes_of(x), B.planes_of(y)
        assert (B.components_of(p) == x).all()
        assert (B.dots(p, q) == x @ y.T).all()
        assert (B.own_dots(p) == (x * x).sum(axis=1)).all()


SCHEMA = "vec_id long, embedding array<float>, id string, planes string"


def test_odd_rows(ready, tmp_path):
    rng = np.random.default_rng(1)
    base = [rng.normal(size=64).astype(np.float32) * s for s in (0.1, 1, 30) for _ in range(30)]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (201, rows[3][1]), (None, rows[4][1]), (None, None), (203, [])]
    bad = [float("nan"), float("inf"), float("-inf"), None]
    rows += [(300 + i, [b, *rows[0][1][1:]]) for i, b in enumerate(bad)] + [(310, rows[0][1][1:]), (311, [*rows[0][1], 0.0]), (312, [0.0] * 64), (312, [0.0] * 64)]
    df = ready.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(ready, str(tmp_path)) == brute(rows)


def test_few_none_and_too_large(ready, tmp_path):
    rows = [(i, [i / 7] * 64) for i in range(3)]
    df = ready.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/few/embeddings.parquet")
    assert got(ready, f"{tmp_path}/few") == brute([(i, np.float32(v).tolist()) for i, v in rows])
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert got(ready, f"{tmp_path}/none") == []
    big = ready.createDataFrame([(1, [1e9] * 64, "a", "b")], SCHEMA)
    big.write.parquet(f"{tmp_path}/big/embeddings.parquet")
    with pytest.raises(Exception, match="lies beyond"):
        got(ready, f"{tmp_path}/big")
