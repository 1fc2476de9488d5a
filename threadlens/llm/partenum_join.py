"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct five-word shingles (64-bit hashes).  Two documents
link when their Jaccard similarity is at least 3/4, and then their sets differ in at
most D = (r + s) / 7 elements, r and s being the sizes.

PartEnum: sizes are divided into bands (each four times as wide as the one before).
For each band the shingle domain is partitioned by a hash into a fixed number of parts.
D differences touch at most D parts, so of the non-empty parts of a set all but D are
equal in a similar set.  A signature is the band and the contents of a subset of
``SUBSET`` parts (one part by default; larger subsets are enumerated).  A set signs in
its own band, and in the band below if a similar set may lie there.  Sets of equal size
band that are similar share at least one signature.

Of its signatures a set needs to show only its first D + SUBSET parts, in an order that
is the same for all sets: if two lists agree in all but D places, their beginnings of
that length share ``SUBSET``.  The order puts often seen parts last (passages that many
documents share), as far as a bounded list of such parts knows them; any order gives
the same links.  The few sets with too few non-empty parts to be sure also show one
signature that all such sets of the band have in common.

Copies (equal sets) are one node, named by a hash of the set, so they never meet as pairs.
Signatures that the same nodes show are one group: variants of a text have many parts in
common, and all but one of these say nothing new.  The hub of a group is the member that meets most others.  Every node proposes
one pair, with the best hub of all its groups; where the verified links leave more than one
component in a group, each node proposes another one, with a hub of another component, up to ``PROPOSALS`` times
(while that finds links), and then all members of different components are paired, so nothing is lost, and pairs within a
component, which can change nothing, are not made.  A pair is first held against counts of its shingles by hash
bucket, which bound the common ones from above, what is left against counts by as many buckets as the
sets are large, then it is verified on the sets themselves.
Components are found by repeated minima with shortcuts, all as Spark joins.

Texts are never shuffled: each pass over the documents makes what it needs of them.

Defined cases: null, empty or blank text: an empty set, linked with nothing; fewer than
five words: the whole sequence is one shingle; null ids: a row of their own, linked with
nothing; rows with equal ids are one document, which links all their texts; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import per_worker, scratch, slices, stored

WORDS = 5
SUBSET = 1
BAND = 4  # sizes of a band span this factor
MIN_PARTS = 16
HOT_LOCAL = 2  # times a part is seen in a chunk to be reported as frequent
HOT_CHUNK = 4_000_000  # signatures a chunk
MAX_HOT = 200_000  # entries of the broadcast list of frequent parts
NAME_BYTES = 8  # of a set's digest that name its node
BUCKETS = 256
FULL = 65_535  # a bucket's count is known up to this
FINE_FULL = 255  # the same of the finer buckets
BITMAP = 1 << 24
FEW = 24  # members of a group whose pairs are made as rows
BLOCK = 512  # members of a larger group that are compared at a time
EARLIEST = 32  # of its larger groups that a node brings along, so that a pair is made in one of them
PROPOSALS = 2  # times that open groups get another pair for each node before all pairs are compared
FRUITFUL = 20  # another such turn if one proposal in so many was a link
BATCH = 4_000_000
LONG_WORD = 64  # bytes of words that are hashed eight at a time

_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], _U)

_FOLD = np.arange(256, dtype=np.uint8)  # A-Z to lower case
_FOLD[65:91] += 32
_SOLID = np.ones(256, bool)  # all but ASCII white space
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LEADING = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)  # masks of the first n of eight bytes


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and where each text's ones begin (and the last one's end)."""
    n = len(texts)
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, 8 * texts.offset)
    size = int(at[-1] - at[0])
    if not size:
        return np.empty(0, _U), np.zeros(n + 1, np.int64)
    given, at = np.frombuffer(data, np.uint8, size, int(at[0])), at - at[0]
    text = np.zeros(size + 8, np.uint8)  # eight bytes can be read anywhere
    np.take(_FOLD, given, out=text[:size])
    solid, border = _SOLID[given], np.zeros(size + 1, bool)
    border[at] = True
    # a word also ends where its text does
    apart = ~solid[:-1] | ~solid[1:] | border[1:-1]
    first = np.flatnonzero(solid & np.append(True, apart))
    length = np.flatnonzero(solid & np.append(apart, True)) + 1 - first
    eight = np.ndarray(size + 1, "<u8", text, 0, (1,))
    with np.errstate(over="ignore"):
        h = _mix(length.astype(_U) * _FACTORS[0] ^ (eight[first] & _LEADING[np.minimum(length, 8)]))
        more, done = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
        while len(more):
            left = length[more] - done
            h[more] = _mix(h[more] * _FACTORS[1] ^ (eight[first[more] + done] & _LEADING[np.minimum(left, 8)]))
            more, done = more[left > 8], done + 8
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(text[first[i] : first[i] + length[i]])
    return h, np.searchsorted(first, at)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its five-word shingles."""
    if not len(texts):
        return []
    h, at = _words(texts)

    def mixed(h: np.ndarray, n: int) -> np.ndarray:
        """Of all runs of ``n`` words."""
        with np.errstate(over="ignore"):
            total = h[: len(h) - n + 1] * _FACTORS[0] + _U(n)
            for i in range(1, n):
                total += h[i : len(h) - n + 1 + i] * _FACTORS[i]
        return _mix(total)

    whole = mixed(h, WORDS) if len(h) >= WORDS else h
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = min(WORDS, j - i)
        x = np.sort(whole[i : j - WORDS + 1] if n == WORDS else mixed(h[i:j], n) if n else h[:0])
        new = x[1:] != x[:-1]
        out.append(x if new.all() else x[np.append(True, new)])
    return out


def buckets(x: np.ndarray) -> bytes:
    """How many elements of a set fall in each hash bucket."""
    counts = np.bincount((x & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, FULL).astype(np.uint16).tobytes()


def packed(counts: bytes) -> bytes:
    """Counts by bucket in 4, 8 or 16 bits each, as the largest of them needs: they are shuffled often."""
    c = np.frombuffer(counts, np.uint16)
    if c.max() < 16:
        return (c[::2] | c[1::2] << 4).astype(np.uint8).tobytes()
    return c.astype(np.uint8).tobytes() if c.max() < 256 else counts


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The counts by bucket of ``packed`` rows, as a matrix."""
    out, sizes = np.empty((len(rows), BUCKETS), np.int32), np.array([len(r) for r in rows], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        c = np.frombuffer(b"".join(rows[i] for i in at), np.uint16 if size == 2 * BUCKETS else np.uint8).reshape(len(at), -1)
        out[at] = c if size >= BUCKETS else np.stack([c & 15, c >> 4], axis=2).reshape(len(at), BUCKETS)
    return out


def finer(x: np.ndarray) -> bytes:
    """The same by more buckets, a power of two of them: two elements a bucket, or fewer."""
    n = BUCKETS
    while 2 * n < len(x):
        n *= 2
    return np.minimum(np.bincount((x & _U(n - 1)).astype(np.int64), minlength=n), FINE_FULL).astype(np.uint8).tobytes()


def band_of(size: int) -> int:
    """Band b holds the sizes from BAND ** b up to BAND ** (b + 1) - 1."""
    b = 0
    while size >= BAND ** (b + 1):
        b += 1
    return b


def schemes(size: int) -> list[tuple[int, int]]:
    """(band, largest number of differing parts) in which a set of this size signs."""
    b = band_of(size)
    # with a larger partner (up to 4/3) D is at most size / 3, with a smaller one 2 size / 7
    out = [(b, size // 3)]
    if b and -(-3 * size // 4) < BAND**b:
        out.append((b - 1, 2 * size // 7))
    return out


def parts(x: np.ndarray, band: int) -> np.ndarray:
    """Signatures of the non-empty parts of a set in a band's partition."""
    n = max(MIN_PARTS, 3 * BAND**band)
    with np.errstate(over="ignore"):
        # the part by a product with a constant of the band, the contents by their sum
        at = ((x * (_FACTORS[1] + _U(2 * band))) >> _U(32)) * _U(n) >> _U(32)
        at = at.astype(np.int64)
        # sums of 32-bit halves stay exact as floats
        low = np.bincount(at, weights=(x & _U(0xFFFFFFFF)).astype(np.float64), minlength=n)
        high = np.bincount(at, weights=(x >> _U(32)).astype(np.float64), minlength=n)
        full = np.flatnonzero(np.bincount(at, minlength=n))
        content = low[full].astype(_U) + (high[full].astype(_U) << _U(32))
        return _mix(content + full.astype(_U) * _FACTORS[2] + _U(band + 1) * _FACTORS[3])


class Often:
    """A bounded list of parts that many sets have, with their counts."""

    def __init__(self, listed: tuple[np.ndarray, np.ndarray]):
        self.sig, self.n = listed
        self.some = np.zeros(1 << 20, bool)
        self.some[self.sig >> _U(44)] = True

    def seen(self, p: np.ndarray) -> np.ndarray:
        """How often each of ``p`` is known to occur."""
        out = np.zeros(len(p), np.int64)
        maybe = np.flatnonzero(self.some[p >> _U(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.sig, p[maybe]), len(self.sig) - 1)
            out[maybe] = np.where(self.sig[at] == p[maybe], self.n[at], 0)
        return out


def signatures(x: np.ndarray, often: Often, subset: int = SUBSET) -> np.ndarray:
    """What a set shows: subsets of its first parts in the common order (rarest first,
    then by hash), per band."""
    out = []
    for band, differ in schemes(len(x)):
        p, need = parts(x, band), differ + subset
        if len(p) > need:
            seen = often.seen(p)
            rare = p[seen == 0]
            if len(rare) > need:
                shown = np.partition(rare, need - 1)[:need]
            else:
                shown = p[np.lexsort((p, seen))[:need]]
        else:
            shown = p
        if subset > 1:
            with np.errstate(over="ignore"):
                sets = [np.sort(np.array(c)) for c in combinations(shown, subset)]
                shown = np.array([_mix((c * _FACTORS[: len(c)]).sum(keepdims=True))[0] for c in sets], _U)
        out.append(shown)
        if len(p) < need:
            # too few parts for a sure match: all such sets of the band meet here
            out.append(_mix(np.array([band + 1], _U) * _FACTORS[4]))
    return np.concatenate(out) if out else x


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _namer(odd: dict[bytes, int], size: int):
    """Names nodes: the first bytes of a set's digest as a signed number.

    Sets that share these (some N * N / 2**65 of N sets) but one are listed in ``odd``
    and take the last eight bytes.
    """

    def name(key: bytes) -> int:
        other = odd.get(key)
        return int.from_bytes(key[:size], "little", signed=True) if other is None else other

    return name


def describe(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, n, key: the set's 128-bit digest, node, counts by bucket), and per
    chunk the frequent parts (sig, n); one pass, stored."""
    names = ["doc_id", "n", "key", "node", "buckets", "sig"]
    name = _namer({}, NAME_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        found: list[np.ndarray] = []
        held = 0

        def frequent() -> pa.RecordBatch:
            sig, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, _U), np.empty(0, int))
            keep = n >= HOT_LOCAL
            k = int(keep.sum())
            none = [pa.nulls(k, t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays(
                [none[0], pa.array(n[keep], pa.int64()), *none[1:], pa.array(_signed(sig[keep]), pa.int64())], names
            )

        for part in slices(batches, BATCH):
            rows = []
            for i, x in zip(part.column(0).to_pylist(), shingle_sets(part.column(1)), strict=True):
                key = _digest(x) if len(x) else None
                new = key is not None and i is not None and key not in seen
                # copies in one chunk carry the counts once, on a row that link() keeps
                rows.append((len(x), key, key and name(key), packed(buckets(x)) if new else None))
                if new:
                    seen.add(key)
                    found += [parts(x, b) for b, _ in schemes(len(x))]
                    held += len(x)
                if held >= HOT_CHUNK:
                    yield frequent()
                    found, held = [], 0
                    seen.clear()
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.nulls(len(rows), pa.int64())], names)
        yield frequent()

    schema = "doc_id long, n long, key binary, node long, buckets binary, sig long"
    both = stored(docs.mapInArrow(run, schema), "shingle-sets")
    return both.where("sig IS NULL").drop("sig"), both.where("sig IS NOT NULL").select("sig", "n")


def sign(docs: DataFrame, hot: DataFrame, subset: int = SUBSET, name=_namer({}, 8)) -> DataFrame:
    """(sig, node) rows of all documents (doc_id, text); copies in one task sign once."""
    rows = hot.groupBy("sig").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sig").limit(MAX_HOT).collect()
    sig = np.array([r["sig"] for r in rows], np.int64).view(_U)
    n = np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(sig)
    listed = per_worker(docs.sparkSession, (sig[order], n[order]))  # bounded by MAX_HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = listed.get(Often)
        seen: set[int] = set()
        for part in slices(batches, BATCH // 4):
            sigs, nodes = [np.empty(0, _U)], [np.empty(0, np.int64)]
            for i, x in zip(part.column(0).to_pylist(), shingle_sets(part.column(1)), strict=True):
                if i is not None and len(x) and (node := name(_digest(x))) not in seen:
                    seen.add(node)
                    s = signatures(x, often, subset)
                    sigs.append(s)
                    nodes.append(np.full(len(s), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sigs))), pa.array(np.concatenate(nodes))], ["sig", "node"])

    return docs.mapInArrow(run, "sig long, node long")


def groups_of(shown: DataFrame) -> DataFrame:
    """(sig, node, many, times): the groups of the nodes that show a signature in common, from (sig, node) rows.

    Signatures of the same members (``many`` nodes) are one group, named by a hash of its
    members, with how many times it was found.  Should groups share a hash, their
    members meet in one, which loses no pair.
    """
    own = Window.partitionBy("sig")
    met = shown.repartition("sig").withColumn("low", F.min("node").over(own)).withColumn("top", F.max("node").over(own))
    # a part that one node alone shows links nothing
    met = met.where("low <> top").select("sig", "node").distinct()
    met = met.withColumn("many", F.count("*").over(own)).withColumn("members", F.bit_xor(F.xxhash64("node")).over(own))
    return met.groupBy(F.col("members").alias("sig"), "node").agg(F.max("many").alias("many"), F.count("*").alias("times"))


def _sets(docs: DataFrame, wanted: DataFrame, name, made=np.ndarray.tobytes) -> DataFrame:
    """(node, set: bytes of its sorted hashes, or what ``made`` makes of them) of the documents ``wanted`` (doc_id).

    The ids wanted are broadcast as a bitmap of fixed size; others that it lets through
    do no harm, as the sets are joined by node.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    words = wanted.groupBy(F.floor(slot / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {BITMAP}), 64) AS int))")).alias("b")
    )
    bits = np.zeros(BITMAP // 64, np.int64)
    for r in words.collect():  # at most BITMAP / 64 rows
        bits[r["w"]] = r["b"]
    bitmap = per_worker(docs.sparkSession, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.get(np.asarray)
        for part in slices(batches, BATCH):
            at = part.column(0).to_numpy()
            keep = (known[at // 64] >> (at % 64)) & 1 == 1
            x = [v for v in shingle_sets(part.column(1).filter(pa.array(keep))) if len(v)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name(_digest(v)) for v in x], pa.int64()), pa.array([made(v) for v in x], pa.binary())],
                ["node", "set"],
            )

    chosen = docs.where("doc_id IS NOT NULL").select(slot.alias("slot"), "text")
    return chosen.mapInArrow(run, "node long, set binary").groupBy("node").agg(F.any_value("set").alias("set"))


def _may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of bucket counts ``x`` and ``y`` may be similar, as a matrix."""
    most = np.minimum(x[:, None, :], y[None, :, :]).sum(axis=2, dtype=np.int64)
    total = x.sum(axis=1, dtype=np.int64)[:, None] + y.sum(axis=1, dtype=np.int64)[None, :]
    full = (x >= FULL).any(axis=1)[:, None] | (y >= FULL).any(axis=1)[None, :]
    return (100 * most >= 75 * (total - most)) | full


def _met_before(x: np.ndarray, y: np.ndarray, sig: int) -> np.ndarray:
    """Which rows of ``x`` and ``y``, each with distinct groups, have one before ``sig`` in common."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < sig)).any(axis=1)


def in_blocks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of each group's members (sig, node, c, many) of different components
    that the counts by bucket allow, without making all pairs as rows.

    A group is dealt into blocks of about ``BLOCK`` members; each task compares two blocks
    as matrices and returns the few pairs that remain.  Texts that share a passage meet in
    hundreds of groups: a pair is left to the first of them, as far as both nodes'
    ``EARLIEST`` first groups show it.  No group before a pair's first one can be shown, so
    none is lost; some pairs of nodes in many groups come more than once.
    """
    last = np.iinfo(np.int64).max  # fills up shorter lists; no group is after it
    before = rows.groupBy("node").agg(F.array_sort(F.collect_set("sig")).alias("in"))
    before = before.select("node", F.slice(F.concat("in", F.array_repeat(F.lit(last), EARLIEST)), 1, EARLIEST).alias("before"))
    about = nodes.select("node", "buckets").join(before, "node")
    n = F.ceil(F.col("many") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    dealt = rows.withColumn("n", n).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("sig", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "c")
    keys = ["sig", "lo", "hi"]
    dealt = dealt.join(about, "node").select(*keys, "own", "node", "c", "buckets", "before")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        lo, hi, own, node, c = (t.column(k).to_numpy() for k in ("lo", "hi", "own", "node", "c"))
        counts = unpacked(t.column("buckets").to_pylist())
        before = t.column("before").combine_chunks().flatten().to_numpy().reshape(-1, EARLIEST)
        sig = t.column("sig")[0].as_py()
        left = np.flatnonzero(own == lo[0])
        right = left if lo[0] == hi[0] else np.flatnonzero(own == hi[0])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(left), 32):
            some = left[i : i + 32]
            apart = c[some][:, None] != c[right][None, :]
            if lo[0] == hi[0]:  # else each pair is seen from both sides
                apart &= node[some][:, None] < node[right][None, :]
            x, y = np.nonzero(_may_link(counts[some], counts[right]) & apart)
            new = ~_met_before(before[some[x]], before[right[y]], sig)
            one, two = node[some[x[new]]], node[right[y[new]]]
            a.append(np.minimum(one, two))
            b.append(np.maximum(one, two))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and tuple(k[i]) != key:
                    yield compare(held)
                    held = []
                key = tuple(k[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield compare(held)

    return dealt.mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the counts by bucket do not rule out."""
    one = nodes.select(F.col("node").alias("a"), F.col("buckets").alias("ca"))
    two = nodes.select(F.col("node").alias("b"), F.col("buckets").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, BATCH):
            col = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            x, y = (unpacked(col[c].to_pylist()) for c in ("ca", "cb"))
            most, total = np.minimum(x, y).sum(axis=1), (x + y).sum(axis=1)
            keep = (100 * most >= 75 * (total - most)) | (np.maximum(x, y) >= FULL).any(axis=1)
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long")


def _similar(common: int, total: int) -> bool:
    return 100 * common >= 75 * (total - common)


def _tested(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs (a, b) that pass a test of what ``sets`` (node, set) has of both."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, BATCH):
            col = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            keep = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(col["sa"], col["sb"], strict=True)]
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def closer(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs (a, b) that the counts by finer buckets do not rule out.

    In large sets most of the 256 buckets have as many elements by chance, and these sets
    are what is costly to bring together.
    """

    def test(x: pa.Buffer, y: pa.Buffer) -> bool:
        x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
        if max(x.max(), y.max()) == FINE_FULL:
            return True
        y = y.reshape(-1, len(x)).sum(axis=0, dtype=np.int64)  # a bucket of fewer is several of more
        return _similar(int(np.minimum(x, y).sum()), int(x.sum(dtype=np.int64) + y.sum()))

    return _tested(pairs, counts, test)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by the sets themselves."""

    def test(x: pa.Buffer, y: pa.Buffer) -> bool:
        x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
        # both sorted and distinct: equal neighbours in the merged order are common
        both = np.sort(np.concatenate([x, y]), kind="stable")
        return _similar(int((both[1:] == both[:-1]).sum()), len(both))

    return _tested(pairs, sets, test)


def components(edges: DataFrame) -> DataFrame:
    """(node, component: smallest node reachable) of all nodes of ``edges`` (a, b).

    Every round each node takes the smallest label among itself and its neighbours, then
    the label of its label; rounds end when no label changes.
    """
    with scratch(edges.sparkSession) as keep:
        both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
        while True:
            near = both.join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
            low = labels.join(near, "node").select("node", "c", F.least("c", "m").alias("m"))
            jump = labels.select(F.col("node").alias("m"), F.col("c").alias("j"))
            new = stored(low.join(jump, "m").select("node", "c", F.least("m", "j").alias("new")), "labels")
            changed = new.where("new <> c").limit(1).count()
            labels = new.select("node", F.col("new").alias("c"))
            if not changed:
                return keep(labels.select("node", F.col("c").alias("component")), "reached")


def _fits(a: Column, b: Column) -> Column:
    """Sizes of which similar sets can be."""
    return (a * 4 >= b * 3) & (b * 4 >= a * 3)


def pairs_within(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of members of different components and fitting sizes of small groups (sig, node, size, c)."""
    member = F.struct("node", "size", "c")
    each = rows.groupBy("sig").agg(F.collect_list(member).alias("m")).select("m", F.explode("m").alias("x"))
    x = F.col("x")
    others = F.filter("m", lambda y: (y["node"] > x["node"]) & (y["c"] != x["c"]) & _fits(x["size"], y["size"]))
    return each.select(x["node"].alias("a"), F.explode(others).alias("y")).select("a", F.col("y.node").alias("b"))


def link(docs: DataFrame, sets: DataFrame, hot: DataFrame, subset: int, name) -> DataFrame:
    """(node, component: smallest node) of the nodes that have a link."""
    groups = Window.partitionBy("sig")
    known = sets.where("node IS NOT NULL AND doc_id IS NOT NULL")
    of = [F.min("doc_id").alias("doc_id"), F.max("n").alias("size"), F.max("buckets").alias("buckets")]
    nodes = stored(known.groupBy("node").agg(*of), "nodes")
    shared = stored(groups_of(sign(docs, hot, subset, name)), "shared")
    # a group's hub is the member that meets most others in all its groups: in a family of
    # variants the one they all come from, or the one nearest to it
    fame = shared.groupBy("node").agg(F.sum(F.col("many") * F.col("times")).alias("fame"))
    fame = stored(fame.join(nodes.select("node", F.col("size").cast("int").alias("size")), "node"), "fame")
    ranked = shared.select("sig", "node").join(fame, "node")

    def star_of(rows: DataFrame) -> DataFrame:
        """For each node one pair with a hub of its groups that it may be similar to."""
        best = F.struct("fame", "node", "size", *[c for c in rows.columns if c == "c"])
        d = rows.withColumn("h", F.max(best).over(groups)).withColumn("hub", F.col("h.node"))
        d = d.where(F.col("hub") != F.col("node")).withColumn("hub_size", F.col("h.size")).where(_fits(F.col("size"), F.col("hub_size")))
        if "c" in rows.columns:
            d = d.where(F.col("c") != F.col("h.c"))
        # a node proposes one pair, with the hub that meets most others of all its groups
        one = d.groupBy("node").agg(F.max(F.struct(F.col("h.fame").alias("fame"), "hub")).alias("top"))
        one = one.withColumn("hub", F.col("top.hub"))
        return one.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()

    star = stored(star_of(ranked), "star")

    def checked(pairs: DataFrame) -> DataFrame:
        left = stored(possible(pairs, nodes), "possible")
        for test, made, to in ((closer, finer, "closer"), (verify, np.ndarray.tobytes, "links")):
            if left.limit(1).count():  # else no text needs to be read
                ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
                wanted = nodes.select("node", "doc_id").join(ends, "node", "left_semi").select("doc_id")
                left = stored(test(left, _sets(docs, wanted, name, made)), to)
        return left

    def open_groups(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Those of the groups that the links so far leave in more than one component."""
        own = rows.select("sig", "node", "size", "fame").join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
        own = own.withColumn("lo", F.min("c").over(groups)).withColumn("hi", F.max("c").over(groups))
        own = own.withColumn("many", F.count("*").over(groups)).where("lo <> hi")
        return stored(own.select("sig", "node", "size", "fame", "c", "many"), "open")

    links = checked(star)
    found = components(links)
    tried, rows = star, ranked
    turns = PROPOSALS
    while True:
        rows = open_groups(rows, found)  # a group that is closed stays closed
        last = not turns
        if last:  # whatever is left: all pairs of different components
            rest = pairs_within(rows.where(F.col("many") <= FEW)).union(in_blocks(rows.where(F.col("many") > FEW), nodes)).distinct()
        else:  # each group's most met member of another component than the first hub's
            first = rows.withColumn("h", F.max_by("c", F.struct("fame", "node")).over(groups))
            rest = star_of(first.withColumn("fame", F.when(F.col("c") == F.col("h"), F.lit(-1)).otherwise(F.col("fame"))).drop("h"))
        rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "rest")
        new = 0
        if rest.limit(1).count():
            more = checked(rest)
            tried = tried.union(rest)
            new = more.count()
            if new:
                links = links.union(more)
                found = components(links)
        if last:
            break
        turns = turns - 1 if new and FRUITFUL * new >= rest.count() else 0
    return found


def near_duplicates(docs: DataFrame, subset: int = SUBSET) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    The result is a stored table; the tables made on the way to it are freed.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, subset), "components")


def _near_duplicates(docs: DataFrame, subset: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, hot = describe(docs)
    some = sets.where("node IS NOT NULL").select("node", "key").distinct()
    first = some.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    odd = {bytes(r["key"]): int.from_bytes(r["key"][8:], "little", signed=True)
           for r in some.join(first, "node").where("key <> lo").select("key").collect()}
    for key, node in odd.items():
        sets = sets.withColumn("node", F.when(F.col("key") == F.lit(key), F.lit(node)).otherwise(F.col("node")))
    found = link(docs, sets, hot, subset, _namer(odd, NAME_BYTES))
    known = sets.where("node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "node", "key")
    # an id with several texts links their nodes
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    if several.limit(1).count():
        more = known.join(several.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
        found = components(found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    named = known.select("doc_id", "node").join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    low = named.groupBy("c").agg(F.min("doc_id").alias("low"))
    of = named.select("node", "c").distinct().join(low, "c").select("node", "low")
    got = sets.select("doc_id", "n", "node").join(of, "node", "left")
    return got.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"),
    )
