"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has bit b set if more than half the hashes of its four-word
shingles have it.  Fingerprints that differ in at most ``RADIUS`` bits link.

Candidates: the 64 bits are cut in ``RADIUS`` + 2 blocks.  Two fingerprints within the
radius are equal in at least two of the blocks, so each fingerprint stands under one key for every
pair of blocks (21 or 22 bits), and all linked pairs meet under some key.  Copies
(equal fingerprints) are one row before that.

Bit-sliced comparison: the fingerprints under a key are stored vertically, 64 to a word,
one word for each bit.  A query is compared with 64 fingerprints at once: the words of
its bits, inverted where its own bit is set, show who differs, and carry-save adders
count the differences of all 64 in parallel (words of ones, twos, fours and more).  After every
eight bits the words in which all counts are past the radius are abandoned.

A key with very many fingerprints is dealt into tiles of two blocks of about ``TILE``
members, which are compared on their own, wherever they are.  A tile returns no pairs but a
forest that connects what is linked in it: at most one edge per member.  Components are found from
these edges by joins.

Defined cases: null, empty or blank text: the fingerprint is zero and links like any other;
fewer than four words: the whole sequence is the shingle; null ids: a fingerprint and no
component, linked with nothing; rows with equal ids are one document, which links all their
texts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from threadlens.llm.common import map_arrow, stored
from threadlens.llm.partenum_join import components

WORDS = 4
SEED = 42
RADIUS = 4
BITS = 64
TILE = 2048  # members of a block of a large key's tile
HELD = 16_384  # rows compared in one go, in whole tiles
ITEMS = 1 << 16  # (query, word) items compared at a time
CHUNK = 1 << 16  # shingles of a text counted at a time
FEW_HOT = 10_000  # keys with many members that are joined by broadcast (16 bytes each)

_U = np.uint64
_ALL = ~_U(0)


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, repeats included, in chunks."""
    # bytes: lower() changes A-Z only, split() cuts at ASCII white space only
    words = (text or "").encode().lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = min(WORDS, len(words))
    starts = np.concatenate([[0], ends[: len(words) - n] + 1])
    ends = ends[n - 1 :]
    for i in range(0, len(starts), CHUNK):
        spans = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        h = [xxh64_intdigest(line[a:b], SEED) for a, b in spans]
        yield np.array(h, _U)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text."""
    total, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, fp)."""

    def columns(part: pa.RecordBatch) -> list:
        fp = np.fromiter(map(fingerprint, part.column(1).to_pylist()), _U, part.num_rows)
        return [pa.array(fp.view(np.int64))]

    return map_arrow(docs.select("doc_id", "text"), [("fp", T.LongType())], columns).select("doc_id", "fp")


def keys_of(fp: Column) -> list[Column]:
    """The keys under which a fingerprint stands: pairs of blocks with their number."""
    count = RADIUS + 2
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    out = []
    for k, pair in enumerate(combinations(range(count), 2)):
        key = F.lit(k).cast("long")
        for i in pair:
            width = cuts[i + 1] - cuts[i]
            block = F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(block)
        out.append(key)
    return out


def sliced(fp: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row b holds bit b, 64 fingerprints to a word."""
    padded = np.zeros(-(-len(fp) // 64) * 64, _U)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(planes).view(_U)[:, :, 0]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three words, bit by bit."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(planes: np.ndarray, query: np.ndarray, word: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (query fingerprint, word of the planes, lanes that count): the items that
    are left and their lanes whose distance is at most ``RADIUS``."""
    alive = np.arange(len(query))
    ones, twos, fours, over = (np.zeros(len(query), _U) for _ in range(4))

    def differ(bit: int) -> np.ndarray:
        inverted = _U(0) - ((query >> _U(bit)) & _U(1))
        return planes[bit, word] ^ inverted

    for bit in range(0, BITS, 8):
        carried = []
        for b in (bit, bit + 4):
            ones, c = _add(ones, differ(b), differ(b + 1))
            ones, d = _add(ones, differ(b + 2), differ(b + 3))
            twos, e = _add(twos, c, d)
            carried.append(e)
        fours, eights = _add(fours, *carried)
        over |= eights
        near = ~(over | past(ones, twos, fours)) & mask
        keep = np.flatnonzero(near)
        if len(keep) < len(alive):
            alive, query, word, mask = alive[keep], query[keep], word[keep], mask[keep]
            ones, twos, fours, over, near = ones[keep], twos[keep], fours[keep], over[keep], near[keep]
    return alive, near


def past(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray) -> np.ndarray:
    """Lanes whose count (below eight) is past the radius of four."""
    return fours & (ones | twos)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of ``n`` members reaches by the links (a, b)."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def linked(fp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Forest of the links of each member i with the members from start[i] to end[i]."""
    planes = sliced(fp)
    first = start // 64
    count = np.where(end > start, (end - 1) // 64 - first + 1, 0)
    low = np.arange(len(fp))
    cuts = np.concatenate([[0], np.cumsum(count)])
    for i in range(0, cuts[-1], ITEMS):
        item = np.arange(i, min(i + ITEMS, cuts[-1]))
        q = np.searchsorted(cuts, item, side="right") - 1
        word = first[q] + item - cuts[q]
        lo = np.maximum(start[q] - 64 * word, 0).astype(_U)
        hi = np.minimum(end[q] - 64 * word, 64).astype(_U)
        mask = (_ALL << lo) & (_ALL >> (_U(64) - hi))
        left, near = within(planes, fp[q], word, mask)
        if len(left):
            row, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = q[left[row]], 64 * word[left[row]] + lane
            low = forest(len(fp), low[a], low[b])[low]
    return low


def compared(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) among ``rows``: sorted key, lo, hi, own and fingerprint, in whole tiles."""
    key, lo, hi, own, fp = rows
    new = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
    edge = np.concatenate([[0], new, [len(key)]])
    size = np.diff(edge)
    some = np.repeat(size > 1, size)
    key, lo, hi, own, fp = (x[some] for x in rows)
    edge = np.concatenate([[0], np.cumsum(size[size > 1])])
    tile = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    end = edge[1:][tile]
    # within one block each member looks at those after it, else the first block at the second
    second = np.bincount(tile[own == lo], minlength=len(edge) - 1) + edge[:-1]
    start = np.where(lo == hi, np.arange(len(fp)) + 1, np.where(own == lo, second[tile], end))
    low = linked(fp.view(_U), start, end)
    moved = np.flatnonzero(low != np.arange(len(low)))
    return fp[low[moved]], fp[moved]


def edges(nodes: DataFrame) -> DataFrame:
    """(a, b) edges that connect the fingerprints ``nodes`` (fp) within the radius."""
    keyed = nodes.select(F.explode(F.array(*keys_of(F.col("fp")))).alias("key"), "fp")
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > TILE), "hot-keys")
    # the join is by broadcast only while the list is small
    few = hot.count() <= FEW_HOT
    n = F.coalesce(F.ceil(F.col("many") / TILE), F.lit(1)).cast("int")
    dealt = keyed.join(F.broadcast(hot) if few else hot, "key", "left").select("key", "fp", n.alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tile = ["key", "lo", "hi"]
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
    dealt = dealt.repartition(*tile).sortWithinPartitions(*tile, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in compared(rows)], ["a", "b"])

        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])], axis=1)
            if held.shape[1] >= HELD:
                # the last tile may go on in the next batch
                last = (held[:3] == held[:3, -1:]).all(axis=0)
                cut = held.shape[1] - int(last.sum())
                if cut:
                    yield found(held[:, :cut])
                    held = held[:, cut:]
        if held.shape[1]:
            yield found(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits, signed), component_id (smallest id reachable, itself included)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = stored(fingerprints(docs), "fingerprints")
    known = made.where("doc_id IS NOT NULL")
    nodes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    links = edges(nodes)
    # an id with several texts links their fingerprints
    of = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    several = stored(of, "several")
    if several.limit(1).count():
        links = links.union(known.join(several, "doc_id").where("fp <> a").select("a", "fp"))
    found = components(links)
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    of = named.select("fp", "c").join(lowest, "c").select("fp", "component_id")
    got = made.join(of, "fp", "left")
    return got.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
