"""Merkle dataset manifest by time-forward processing.

Every row is a leaf.  The leaves of a group stand in order; while a group has several
nodes, every two neighbours (the last one alone, if it has none) become their hash, and
what remains is the group's subroot.  The subroots, in the order of their groups, become
the root in the same way.

Time-forward processing: a node is labelled by its level and its place in the level, and
nodes are handled in the order of their labels, so that every message a node needs has
been sent before its turn.  Upwards a node sends its digest to its parent's label, and a
priority queue hands a parent the digests of its children.  The reversed sweep starts at
the root with an empty proof; every node sends to its children their siblings' digest
before its own proof, and what reaches a leaf is the leaf's proof.

The queue is external: labels are cut in blocks, the complete subtrees over
``2 ** LEVELS`` neighbours.  Messages within a block wait in a heap that is as small as
the block, messages between blocks are rows that Spark shuffles, spills and sorts by label.  A round
reduces a level to one node per block, so there are log(rows) / ``LEVELS`` rounds each
way.  A group's size doesn't matter: its blocks are dealt by (group, block).

Positions need no task that sees a whole group: rows are range partitioned by group and
order and sorted, each partition counts its rows per group, and a running sum over these
counts (one row per partition and group) tells where a partition begins.

Defined cases: a null group is a group, the first one; null order values come first; rows
with equal order are in the order of their leaves, equal leaves stand side by side;
a lone leaf is its own subroot, a lone subroot is the root; an empty table has an empty
manifest; only the columns asked for are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import map_arrow, stored

LEVELS = 7  # levels of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIZE = 32  # bytes of a digest

NODE = "grp string, pos long, n long, digest binary"


def leaf_digest(values: list[Column]) -> Column:
    """The leaf of these values: sha256 of each as length, colon, text (``-`` for null)."""

    def told(v: Column) -> Column:
        text = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(told, values)), 256))


def parent_digest(children: list[bytes]) -> bytes:
    """The hash over the children's digests as hexadecimal text."""
    return sha256(b"".join(children).hex().encode()).digest()


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` and ``n``: place in the group (from 0) and the group's size."""
    keys = [F.col(c) for c in (*group, *order)]
    # identical rows have no order of their own; the row id only lets them be parted
    salted = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    at = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    # the row id's upper bits are the partition
    part = F.shiftright("at", 33)
    runs = at.groupBy(part.alias("part"), *group).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("part").alias("r_part"), *[F.col(c).alias(f"r_{c}") for c in group],
        (F.col("first") - F.coalesce(F.sum("here").over(before), F.lit(0))).alias("zero"),
        F.sum("here").over(whole).alias("n"),
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in group], part == F.col("r_part"))
    got = at.join(runs, same)
    return got.withColumn("pos", F.col("at") - F.col("zero")).drop("at", "zero", "r_part", *[f"r_{c}" for c in group])


def height(n: int) -> int:
    """Levels above ``n`` neighbours up to the one node that remains."""
    return (n - 1).bit_length()


def forward(first: int, n: int, digests: list[bytes], levels: int) -> dict[tuple[int, int], bytes]:
    """Every node (level, place) of the subtree over the neighbours from place ``first`` of a
    level of ``n`` nodes: the sweep upwards, by labels from a priority queue."""
    nodes = {(0, first + i): d for i, d in enumerate(digests)}
    queue = [((1, place // 2), place, d) for (_, place), d in nodes.items()] if levels else []
    heapify(queue)
    while queue:
        label, _, digest = heappop(queue)
        children = [digest]
        while queue and queue[0][0] == label:
            children.append(heappop(queue)[2])
        nodes[label] = parent_digest(children)
        level, place = label
        if level < levels:
            heappush(queue, ((level + 1, place // 2), place, nodes[label]))
    return nodes


def backward(nodes: dict[tuple[int, int], bytes], top: tuple[int, int], proof: bytes) -> dict[int, bytes]:
    """Place -> proof of the neighbours below ``top``: the sweep in reversed label order."""
    queue = [(-top[0], -top[1], proof)]
    out = {}
    while queue:
        level, place, proof = heappop(queue)
        level, place = -level, -place
        if not level:
            out[place] = proof
            continue
        for child in (2 * place, 2 * place + 1):
            if (level - 1, child) in nodes:
                heappush(queue, (1 - level, -child, nodes.get((level - 1, child ^ 1), b"") + proof))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (grp, block), which come sorted."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, block in groupby(rows, itemgetter("grp", "block")):
        yield list(block)


def _block() -> Column:
    return F.shiftright("pos", LEVELS)


def _out(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def tops(nodes: DataFrame) -> DataFrame:
    """The next round's nodes: what remains of each block of ``nodes`` (grp, pos, n, digest)."""
    dealt = nodes.withColumn("block", _block()).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for block in _blocks(batches):
            n, first = block[0]["n"], block[0]["pos"]
            levels = min(LEVELS, height(n))
            got = forward(first, n, [r["digest"] for r in block], levels)
            rows.append((block[0]["grp"], first >> LEVELS, (n - 1 >> LEVELS) + 1, got[levels, first >> levels]))
            if len(rows) >= 1000:
                yield _out(rows, ["grp", "pos", "n", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.binary()])
                rows = []
        yield _out(rows, ["grp", "pos", "n", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.binary()])

    return stored(dealt.mapInArrow(run, NODE), "nodes")


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """All rounds' nodes; those with n = 1 are what remains of their group."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(tops(rounds[-1].where("n > 1")))
        most = (most - 1 >> LEVELS) + 1
    return rounds


def _remaining(rounds: list[DataFrame]) -> DataFrame:
    """(grp, round, digest): the node that remains of each group."""
    ends = [t.where("n = 1").select("grp", F.lit(i).alias("round"), "digest") for i, t in enumerate(rounds)]
    return reduce(DataFrame.union, ends)


def proved(nodes: DataFrame, mail: DataFrame, told: list[str]) -> DataFrame:
    """``nodes`` with ``proof`` and the columns ``told`` that their block's message has.

    ``mail`` has (grp, pos: the block, proof, *told).  A message sorts before the nodes of
    its block, which is the order that the queue of the reversed sweep asks for.
    """
    letters = mail.withColumnsRenamed({"pos": "block"}).withColumn("pos", F.lit(-1).cast("long"))
    both = nodes.withColumn("block", _block()).unionByName(letters, allowMissingColumns=True)
    dealt = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    schema = both.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rows = None, []

        def checked() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = batch.schema
                yield batch

        for block in _blocks(checked()):
            letter, own = block[0], block[1:]
            n, first = own[0]["n"], own[0]["pos"]
            levels = min(LEVELS, height(n))
            got = backward(forward(first, n, [r["digest"] for r in own], levels), (levels, first >> levels), letter["proof"])
            also = {k: letter[k] for k in told}
            rows += [r | also | {"proof": got[r["pos"]]} for r in own]
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return dealt.mapInArrow(run, schema).drop("block")


def descended(rounds: list[DataFrame], ends: DataFrame, told: list[str]) -> DataFrame:
    """The first round's nodes with their proofs; ``ends`` are the messages (grp, round,
    proof, *told) to the node that remains of each group."""

    def own(i: int) -> DataFrame:
        return ends.where(F.col("round") == i).select("grp", F.lit(0).cast("long").alias("pos"), "proof", *told)

    last = len(rounds) - 1
    mail = own(last)
    for i in range(last, -1, -1):
        got = proved(rounds[i], mail, told)
        if not i:
            return got
        mail = stored(got.select("grp", "pos", "proof", *told), "mail").unionByName(own(i - 1))


def manifest(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The manifest of ``rows`` (grp: string, key: long, leaf: binary, *carry).

    Returns grp, key, pos and n (place in the group and its size), leaf, *carry, proof (the
    siblings' digests from the leaf up to the root, one after the other), subroot, root,
    place and groups (of the subroot among all).
    """
    leaves = stored(rows.select("grp", "key", "leaf", *carry), "leaves")
    placed = stored(numbered(leaves, ["grp"], ["key", "leaf"]).withColumnRenamed("leaf", "digest"), "placed")
    rounds = climbed(placed.select("grp", "pos", "n", "digest"))
    subroots = stored(_remaining(rounds), "subroots")
    upper = numbered(subroots.withColumnRenamed("grp", "name"), [], ["name"]).withColumn("grp", F.lit(None).cast("string"))
    upper = stored(upper.select("grp", "pos", "n", "digest", "name", "round"), "upper")
    upper_rounds = climbed(upper.select("grp", "pos", "n", "digest"))
    root = _remaining(upper_rounds).select(
        "grp", "round", F.lit(b"").alias("proof"), F.col("digest").alias("root")
    )
    upper_proved = descended([upper, *upper_rounds[1:]], root, ["root"])
    ends = stored(
        upper_proved.select(
            F.col("name").alias("grp"), "round", "proof", "root", F.col("digest").alias("subroot"),
            F.col("pos").alias("place"), F.col("n").alias("groups"),
        ),
        "ends",
    )
    got = descended([placed, *rounds[1:]], ends, ["root", "subroot", "place", "groups"])
    return got.withColumnRenamed("digest", "leaf")


def fold(leaf: bytes, proof: bytes, *places: tuple[int, int]) -> bytes:
    """The root that ``leaf`` and its proof lead to; ``places`` are (place, size) of the leaf
    in its group, of the group among all."""
    digest, used = leaf, 0
    for place, size in places:
        while size > 1:
            run = [digest]
            if place ^ 1 < size:
                run.insert(1 - place % 2, proof[used : used + SIZE])
                used += SIZE
            digest, place, size = parent_digest(run), place // 2, (size + 1) // 2
    return digest


def folded(made: DataFrame, leaf: str) -> DataFrame:
    """``made`` (a manifest) with ``folded``: the root recomputed from the column ``leaf`` and the proof."""

    def columns(part: pa.RecordBatch) -> list:
        names = (leaf, "proof", "pos", "n", "place", "groups")
        rows = zip(*(part.column(c).to_pylist() for c in names), strict=True)
        return [pa.array([fold(d, p, (a, b), (c, e)) for d, p, a, b, c, e in rows], pa.binary())]

    return map_arrow(made, [("folded", T.BinaryType())], columns)
