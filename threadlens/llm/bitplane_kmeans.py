"""Centroid clustering by bit-plane popcounts.

A vector's 64 components are integers, kept as bit planes: plane b is one uint64 that holds
bit b of all components.  With X and C the planes of a vector and of a centroid,

    dot(x, c) = sum over i, j of weight_i * weight_j * popcount(X_i & C_j)

where a plane's weight is 2 ** b, and minus that for the last one (two's complement).  The
squared distance is dot(x, x) + dot(c, c) - 2 dot(x, c); all of it is integer arithmetic,
so distances and ties are exact.

The packed vectors are written once (a plane of a vector is eight bytes, ten planes or so
instead of 64 numbers); every round reads them, assigns each vector within its task, and
sums the members' components per centroid, plane by plane: a task returns one row per
centroid, so what is shuffled and what the driver holds between rounds is bounded by the
number of centroids, whatever the number of vectors and however large one cluster is.

Defined cases: vectors that are null, or have another number of components, or a null or
non-finite one are left out; repeated rows count as often as they occur; fewer vectors
than centroids: every vector starts one; a null id is kept but starts a centroid only if
ids are too few; equal ids start by their components; an empty table gives no rows.
A component times the scale must lie within 2 ** 27 of zero, so that squared distances
fit a long; a value beyond stops the job with a message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import per_worker, slices, stored

DIMENSIONS = 64
SCALE = 256
LIMIT = 1 << 27
CENTROIDS = 40
ROUNDS = 5
SEED = 2
BATCH = 1_000_000  # bytes of packed vectors at a time


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the usable vectors' integer components."""
    x = F.col(vector_col).cast("array<double>")
    usable = (F.size(x) == DIMENSIONS) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * SCALE))
    # the check comes first: floor() of a larger double would be cut to a long
    wide = F.exists(x, lambda v: F.abs(v * SCALE) >= LIMIT)
    error = F.raise_error(F.lit(f"a component times {SCALE} lies beyond {LIMIT}")).cast("array<bigint>")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).where(F.coalesce(usable, F.lit(False)))
    return kept.select("id", F.when(wide, error).otherwise(scaled).alias("x"))


def planes_of(x: np.ndarray) -> np.ndarray:
    """The bit planes of integer rows (n, 64) as uint64 (n, planes), lowest bit first."""
    most = int(np.maximum(x, ~x).max(initial=0))  # ~x is -x - 1
    count = most.bit_length() + 1  # the sign needs one more
    bits = (x[:, None, :] >> np.arange(count)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def components_of(planes: np.ndarray) -> np.ndarray:
    """The integers (n, 64) that :func:`planes_of` packed."""
    n, count = planes.shape
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(n, count, 8), axis=2, bitorder="little")
    out = np.zeros((n, DIMENSIONS), np.int64)
    for b, w in enumerate(weights(count)):
        out += bits[:, b, :].astype(np.int64) * w
    return out


def weights(count: int) -> list[int]:
    """What the planes weigh: powers of two, the last one negative."""
    return [1 << b for b in range(count - 1)] + [-(1 << count - 1)]


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All dot products of rows of ``left`` (n planes) with rows of ``right``, as (n, m)."""
    a, b = left.shape[1], right.shape[1]
    out = np.zeros((len(left), len(right)), np.int64)
    for shift in range(a + b - 1):
        # pairs of planes of one weight add up their counts before they are weighed
        same = np.zeros(out.shape, np.int16)
        for i in range(max(0, shift - b + 1), min(a, shift + 1)):
            j = shift - i
            count = np.bitwise_count(left[:, i, None] & right[None, :, j])
            if (i == a - 1) != (j == b - 1):
                same -= count
            else:
                same += count
        out += same.astype(np.int64) << shift
    return out


def own_dots(planes: np.ndarray) -> np.ndarray:
    """Every row's dot product with itself."""
    out = np.zeros(len(planes), np.int64)
    w = weights(planes.shape[1])
    for i in range(len(w)):
        for j in range(i, len(w)):
            count = np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
            out += count * (w[i] * w[j] * (1 if i == j else 2))
    return out


def nearest(planes: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number) and squared distance."""
    others = planes_of(centroids)
    distance = norms[:, None] + own_dots(others)[None, :] - 2 * dots(planes, others)
    at = distance.argmin(axis=1)
    return at, distance[np.arange(len(at)), at]


def packed(vectors: DataFrame) -> DataFrame:
    """(id, planes, norm) of (id, x), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4 * BATCH):
            x = part.column(1).flatten().to_numpy().reshape(-1, DIMENSIONS)
            planes = planes_of(x)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([p.tobytes() for p in planes], pa.binary()), pa.array(own_dots(planes))],
                ["id", "planes", "norm"],
            )

    return stored(vectors.mapInArrow(run, "id long, planes binary, norm long"), "planes")


def _unpacked(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, planes, norms) per number of planes: slices were packed on their own."""
    held, norms = part.column(1), part.column(2).to_numpy()
    sizes = np.diff(np.frombuffer(held.buffers()[1], np.int32, len(held) + 1, 4 * held.offset))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        raw = b"".join(held.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(raw, np.uint64).reshape(len(rows), -1), norms[rows]


def sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, total): per task and centroid the members' number and component sums."""
    given = per_worker(vectors.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = given.get(np.asarray)
        n, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), DIMENSIONS), np.int64)
        for part in slices(batches, BATCH):
            for _, planes, norms in _unpacked(part):
                at, _ = nearest(planes, norms, centres)
                n += np.bincount(at, minlength=len(n))
                x = components_of(planes)
                for c in np.unique(at):
                    total[c] += x[at == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"],
        )

    return vectors.mapInArrow(run, "cluster int, n long, total array<long>")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their members' means, exactly."""
    own = sums(vectors, centroids)
    # sums over tasks may pass a long
    wide = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMENSIONS)]
    new = centroids.copy()
    for r in own.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # a row per centroid
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(DIMENSIONS)]
    return new


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    given = per_worker(vectors.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = given.get(np.asarray)
        for part in slices(batches, BATCH):
            cluster, distance = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows, np.int64)
            for rows, planes, norms in _unpacked(part):
                cluster[rows], distance[rows] = nearest(planes, norms, centres)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, "id long, cluster int, distance long")


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, as first centroids."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.select(order.alias("h"), "planes").withColumn("last", F.col("h").isNull())
    rows = [bytes(r["planes"]) for r in first.orderBy("last", "h", "planes").limit(k).collect()]
    if not rows:
        return np.zeros((0, DIMENSIONS), np.int64)
    return np.concatenate([components_of(np.frombuffer(r, np.uint64)[None, :]) for r in rows])


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, and the final centroids (k, 64)."""
    held = packed(whole_vectors(vectors, id_col, vector_col))
    centroids = starts(held, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(held, centroids)
    return stored(assigned(held, centroids), "assigned"), centroids


def with_inertia(made: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``made`` plus cluster_inertia, inertia and centroid_sha256."""
    spark = made.sparkSession
    rows = {r["cluster"]: int(r["d"]) for r in made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = [(c, d, sum(rows.values()), digests[c]) for c, d in rows.items()]
    few = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.join(F.broadcast(few), "cluster")  # a row per centroid
