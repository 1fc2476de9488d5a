"""Benchmark decontamination by the q-gram lemma.

A document is contaminated by a benchmark item if some stretch of it is at most
``edits(m)`` insertions, deletions and substitutions away from the item's m characters
(upper case and kinds of white space aside).  Then it shares at least
m - q + 1 - q * edits of the item's q-grams, all on diagonals (place in the document
minus place in the item) no further apart than the budget.  So the shared q-grams are
counted in overlapping bands of diagonals; the bands that reach the bound are kept and
verified by a banded alignment.  No match within the budget is lost.  Items shorter
than ``SHORT_ITEM`` characters, for which the bound says nothing, count only if they stand
in the document exactly.

Parts of an item count as well: a document is also contaminated by a stretch that is at
most ``PART_EDITS`` edits away from some ``PART`` consecutive characters of the item.  The
same lemma holds for every such window: of its q-grams PART - q + 1 - q * PART_EDITS are
shared in one band.  The windows of the item that reach this bound are asked once more for
shared grams of SHORT characters on the band, and what is left is aligned, many at a time; a
window that many items have is aligned once at a place.
Overlapping windows that match are reported as one part, aligned as a whole.

Plan: the benchmark is a stated query set; it is read in blocks of at most
``BLOCK_CHARS`` characters (its index, some 20 bytes a character, is what is broadcast), and
each block is one pass over the documents without a shuffle.  A pass hashes all places
of a batch of texts at once; what texts and items share is looked at in portions of some ``PAIR_ROWS``
rows, so a wording that all items have costs time, not memory.

Defined cases: null or empty text: no match; empty or null items: ignored; items with
equal texts: each reported; null ids are reported as such; repeated rows: each on its
own; overlapping matches of one item: the whole item with the fewest edits, else the longest
part, of these the one with the fewest edits; extra columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import map_arrow, mark_of, per_worker

Q = 12
EDIT_RATE = 0.05
SHORT_ITEM = 3 * Q
PART, PART_EDITS = 80, 5  # 13 words or so, one of them replaced
SHORT = 4
BLOCK_CHARS = 4_000_000
PAIR_ROWS = 2_000_000  # q-grams of texts times their places in items that are looked at together
WINDOW_ROWS = 8_000  # windows aligned together
FILTER_BITS = 20
MATCH = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("start", "end", "edits")]])
)
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_STEP = 1 << 32  # one edit, above the start of the match in one number


def edits(m: int) -> int:
    """The edit budget of an item of m characters."""
    return int(EDIT_RATE * m) if m >= SHORT_ITEM else 0


def plain(text: str) -> np.ndarray:
    """Code points, A-Z in lower case, all ASCII white space as one kind."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[(c >= 65) & (c <= 90)] += 32
    c[(c >= 9) & (c <= 13)] = 32
    c[c == 0] = 1  # 0 stands between texts
    return c


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, by doubling the length."""
    with np.errstate(over="ignore"):
        h = {1: codes.astype(np.uint64)}
        power = {1: _BASE}
        for n in (1, 2, 4):
            h[2 * n] = h[n][:-n] * power[n] + h[n][n:]
            power[2 * n] = power[n] * power[n]
        return h[8][:-4] * power[4] + h[4][8:]


def _slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * _MIX) >> np.uint64(64 - FILTER_BITS)


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best stretch of ``region`` for ``item`` on the diagonals
    ``low`` to ``high``, if within the budget.  Of equals the earliest end."""
    m, width = len(item), high - low + 1
    far = (budget + 1) * _STEP
    step = np.arange(width, dtype=np.int64) * _STEP
    # cell j of row i is the place i + low + j of the region; a value holds edits and start
    places = np.arange(low, high + 1, dtype=np.int64)
    row = np.where((places >= 0) & (places <= len(region)), places, far)
    pad = np.zeros(width, np.uint32)
    padded = np.concatenate([pad, region, pad])
    for i in range(1, m + 1):
        at = i + low - 1 + width  # place of the first cell's character in padded
        if at + width <= 0 or at >= len(padded):
            return None
        chars = padded[max(at, 0) : at + width]
        if len(chars) < width:
            chars = np.concatenate([pad[: max(0, -at)], chars, pad])[:width]
        swap = row + np.where(chars == item[i - 1], 0, _STEP)
        skip = np.append(row[1:], far) + _STEP  # a character of the item is missing
        best = np.minimum(swap, skip)
        inside = (places + i >= 0) & (places + i <= len(region))
        best = np.where(inside, best, far)
        row = np.minimum.accumulate(best - step) + step  # characters inserted
        row = np.where(inside, row, far)
        if row.min() >= far:
            return None
    j = int(np.argmin(row // _STEP))
    cost = int(row[j] // _STEP)
    return (cost, int(row[j] % _STEP), m + low + j) if cost <= budget else None


def window_edits(windows: np.ndarray, chars: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per row of ``windows`` the edits to its best stretch of a text on a band of diagonals;
    what is over the budget is not exact.  ``chars`` are the characters under the band, ``before`` is
    the place in the text of the first of them, ``size`` the length of the text."""
    m = windows.shape[1]
    width, far = chars.shape[1] - m + 1, PART_EDITS + 1
    step = np.arange(width, dtype=np.int8)[:, None]
    windows, chars = np.ascontiguousarray(windows.T), np.ascontiguousarray(chars.T)
    places = np.arange(width)[:, None] + before
    edge = ((before < 0) | (before + len(chars) > size)).any()
    row = np.where((places >= 0) & (places <= size), 0, far).astype(np.int8)
    skip = np.full_like(row, far + 1)
    for i in range(m):
        np.add(row[1:], 1, out=skip[:-1])
        row += chars[i : i + width] != windows[i]
        np.minimum(row, skip, out=row)
        row -= step  # characters inserted
        for j in range(1, width):
            np.minimum(row[j], row[j - 1], out=row[j])
        row += step
        np.minimum(row, far, out=row)
        if edge:
            row[(places + (i + 1) < 0) | (places + (i + 1) > size)] = far
    return row.min(axis=0)


def align_many(items: np.ndarray, at: np.ndarray, length: np.ndarray, texts: np.ndarray, base: np.ndarray, before: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """``align`` of many stretches at once, without a budget: rows (edits, start, end).

    Stretch r is ``items[at[r] : at[r] + length[r]]``; the band's first cell stands at
    ``texts[base[r]]``, which is the place ``before[r]`` of a text of ``size[r]`` characters.
    """
    out = np.zeros((len(at), 3), np.int64)
    order = np.argsort(-length, kind="stable")
    at, length, base, before, size = (x[order] for x in (at, length, base, before, size))
    cells, step = np.arange(width, dtype=np.int64), np.arange(width, dtype=np.int64) * _STEP
    far = (length + 1) * _STEP
    inside = lambda i, n: (before[:n, None] + cells + i >= 0) & (before[:n, None] + cells + i <= size[:n, None])
    row = np.where(inside(0, len(at)), before[:, None] + cells, far[:, None])
    for i in range(int(length[0]) if len(at) else 0):
        n = int(np.searchsorted(-length, -i, side="left"))  # those longer than i
        row, limit = row[:n], far[:n, None]
        place = before[:n, None] + cells + i
        chars = np.where((place >= 0) & (place < size[:n, None]), texts[np.clip(base[:n, None] + cells + i, 0, len(texts) - 1)], 0)
        swap = row + np.where(chars == items[at[:n] + i][:, None], 0, _STEP)
        skip = np.concatenate([row[:, 1:], limit], axis=1) + _STEP
        here = inside(i + 1, n)
        best = np.where(here, np.minimum(swap, skip), limit)
        row = np.where(here, np.minimum.accumulate(best - step, axis=1) + step, limit)
        ended = np.flatnonzero(length[:n] == i + 1)
        if len(ended):
            j = np.argmin(row[ended] // _STEP, axis=1)
            value = row[ended, j]
            out[order[ended]] = np.stack([value // _STEP, value % _STEP, before[ended] + i + 1 + j], axis=1)
    return out


class Index:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        same: dict[bytes, list[int | None]] = {}  # the ids of each distinct text
        for i, t in items:
            same.setdefault(plain(t).tobytes(), []).append(i)
        self.ids = list(same.values())
        self.codes = [np.frombuffer(c, np.uint32) for c in same]
        self.short = [k for k, c in enumerate(self.codes) if len(c) < SHORT_ITEM]
        hashes, owner, place = [], [], []
        for k, c in enumerate(self.codes):
            if len(c) >= SHORT_ITEM:
                h = gram_hashes(c)
                hashes.append(h)
                owner.append(np.full(len(h), k, np.int32))
                place.append(np.arange(len(h), dtype=np.int32))
        joined = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        h, self.owner, self.place = joined(hashes, np.uint64), joined(owner, np.int32), joined(place, np.int32)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = self.owner[order], self.place[order]
        self.grams, gram = np.unique(h[order], return_inverse=True)
        # owners ascend within a gram, so the places of a gram in some items are one slice
        self.key = gram * np.int64(len(self.codes)) + self.owner
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[_slot(self.grams)] = True
        size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edits(n) for n in size], np.int64)
        self.bound = size - Q + 1 - Q * self.budget
        self.size = size
        self.flat = np.concatenate([*self.codes, np.zeros(PART, np.uint32)])
        self.offset = np.cumsum(size) - size
        self.window = window_classes(self.flat)

    def scan(self, texts: list[str | None], parts: bool = False) -> list[list[tuple]]:
        """Per text the matches (item id, start, end, edits) of whole items, or of their
        ``parts`` too, by start."""
        codes = [plain(t or "") for t in texts]
        out: list[list[tuple]] = [[] for _ in texts]
        gap = np.zeros(Q, np.uint32)
        starts = np.cumsum([0, *[len(c) + Q for c in codes]])
        if len(self.grams) and len(codes):
            every = np.concatenate([x for c in codes for x in (c, gap)])
            h = gram_hashes(every)
            hits = np.flatnonzero(self.seen[_slot(h)])
            at = np.minimum(np.searchsorted(self.grams, h[hits]), len(self.grams) - 1)
            real = self.grams[at] == h[hits]
            hits, at = hits[real], at[real]
            owner = np.searchsorted(starts, hits, side="right") - 1
            for one, a, b in self._shares(owner, at, 0, len(self.codes)):
                whole = self._verify(codes, out, starts, hits[one], at[one], a, b)
                if parts:
                    self._verify_parts(codes, every, out, starts, hits[one], at[one], whole, a, b)
        for k in self.short:
            needle = self.codes[k].tobytes()
            for i, c in enumerate(codes) if needle else ():
                found = _find(c.tobytes(), needle)
                out[i] += [(k, a, a + len(self.codes[k]), 0) for a in found]
        dealt = [[(i, *m[1:]) for m in x for i in self.ids[m[0]]] for x in out]
        return [sorted(x, key=lambda y: (y[1], y[2], y[0] is None, y[0] or 0)) for x in dealt]

    def _places(self, grams, a, b) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places of each gram in the items ``a`` to ``b``."""
        n = len(self.codes)
        first = np.searchsorted(self.key, grams * n + a)
        return first, np.searchsorted(self.key, grams * n + b) - first

    def _shares(self, owner, grams, a, b, at=0) -> Iterator[tuple[slice, int, int]]:
        """Slices of the hits, with a range of items, of at most ``PAIR_ROWS`` hits times places where
        more than one text or item is left to split; each text and item are in one of them."""
        total = int(self._places(grams, a, b)[1].sum()) if len(grams) else 0
        if not total:
            return
        if total <= PAIR_ROWS or owner[0] == owner[-1] and b - a == 1:
            yield slice(at, at + len(grams)), a, b
        elif owner[0] != owner[-1]:
            cut = int(np.searchsorted(owner, (owner[0] + owner[-1]) // 2, side="right"))
            yield from self._shares(owner[:cut], grams[:cut], a, b, at)
            yield from self._shares(owner[cut:], grams[cut:], a, b, at + cut)
        else:
            mid = (a + b) // 2
            yield from self._shares(owner, grams, a, mid, at)
            yield from self._shares(owner, grams, mid, b, at)

    def _bands(self, starts, hits, grams, width, bound, a, b) -> np.ndarray:
        """Columns (text, item, band, place in the item) of the shared q-grams, sorted, of
        the texts and items (``a`` to ``b``) that share as many as the bound in all."""
        first, n = self._places(grams, a, b)
        total = int(n.sum())
        # every hit with every place of its gram in the items
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
        place, item = self.place[entry].astype(np.int64), self.owner[entry].astype(np.int64)
        doc = np.repeat(np.searchsorted(starts, hits, side="right") - 1, n)
        diagonal = np.repeat(hits, n) - starts[doc] - place
        pairs, pair, many = np.unique(doc * len(self.codes) + item, return_inverse=True, return_counts=True)
        keep = many[pair] >= bound[item]
        pair, place, diagonal, item = pair[keep], place[keep], diagonal[keep], item[keep]
        if not len(pair):
            return np.empty((4, 0), np.int64)
        band = diagonal // width[item]
        # bands are two budgets wide and overlap by one: a hit is in its own and the one before
        least = int(band.min()) - 1
        span = int(band.max()) - least + 1
        both = np.concatenate([pair * span + (band - least), pair * span + (band - least - 1)])
        groups, group = np.unique(both, return_inverse=True)
        deep = int(place.max()) + 1
        key = np.unique(group * deep + np.tile(place, 2))  # each q-gram of an item counts once
        group, place = key // deep, key % deep
        pair = pairs[groups // span]
        return np.stack([(pair // len(self.codes))[group], (pair % len(self.codes))[group], (groups % span + least)[group], place])

    def _verify(self, codes, out, starts, hits, grams, a, b) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Counts per text, item and band, and aligns where the bound is met; the stretches
        found by text and item."""
        whole: dict[tuple[int, int], list[tuple[int, int]]] = {}
        key = self._bands(starts, hits, grams, np.maximum(self.budget, 1), self.bound, a, b)
        if not key.size:
            return whole
        change = np.flatnonzero((np.diff(key[:3], axis=1) != 0).any(axis=0)) + 1
        first = np.concatenate([[0], change])
        size = np.diff(np.concatenate([first, [key.shape[1]]]))
        good = size >= self.bound[key[1, first]]
        last = None
        for d, k, b in key[:3, first[good]].T.tolist():
            budget, width = int(self.budget[k]), max(int(self.budget[k]), 1)
            low, high = b * width - budget, (b + 2) * width - 1 + budget
            text, item_codes = codes[d], self.codes[k]
            lo, hi = max(0, low), min(len(text), high + len(item_codes))
            got = align(item_codes, text[lo:hi], low - lo, high - lo, budget)
            if got is None:
                continue
            match = (k, lo + got[1], lo + got[2], got[0])
            # neighbouring bands see the same stretch
            if last and last[:2] == (d, k) and out[d][-1][2] > match[1]:
                if match[3] < out[d][-1][3]:
                    out[d][-1] = match
                    whole[d, k][-1] = match[1:3]
                continue
            out[d].append(match)
            whole.setdefault((d, k), []).append(match[1:3])
            last = (d, k)
        return whole

    def _verify_parts(self, codes, every, out, starts, hits, grams, whole, a, b) -> None:
        """Aligns the windows of an item whose q-grams in one band reach the bound.

        Before that the lemma is asked again with short grams, which leaves few windows that only
        share a wording; a window that many items have is aligned once at a place.
        """
        n, more = len(self.codes), PART - Q - Q * PART_EDITS  # shared q-grams of a window besides its first
        key = self._bands(starts, hits, grams, *(np.full(n, x) for x in (PART_EDITS, more + 1)), a, b)
        one, other = key[:, : max(0, key.shape[1] - more)], key[:, more:]
        some = np.flatnonzero((one[:3] == other[:3]).all(axis=0) & (other[3] - one[3] <= PART - Q) & (self.size[one[1]] >= PART))
        if not len(some):
            return
        one, last = one[:, some], other[3, some]
        new = np.concatenate([[True], (np.diff(one[:3], axis=1) != 0).any(axis=0)])
        group = np.cumsum(new) - 1
        doc, item, band = one[:3, new]
        # the windows that hold both ends of a run of enough shared q-grams; a segment of marks per group
        long = self.size[item] + 1
        segment = np.cumsum(long) - long
        total = int(long.sum())
        marks = np.bincount(segment[group] + np.maximum(last - (PART - Q), 0), minlength=total)
        marks -= np.bincount(segment[group] + np.minimum(one[3], self.size[one[1]] - PART) + 1, minlength=total)
        spot = np.flatnonzero(np.cumsum(marks) > 0)
        group = np.searchsorted(segment, spot, side="right") - 1
        at = spot - segment[group]
        low = (band - 1) * PART_EDITS
        width = 4 * PART_EDITS
        keep = self._share_short_grams(every, starts, doc, item, low, width, segment, total, spot, group, at)
        pair = doc * n + item
        for (d, k), stretches in whole.items():  # wherever windows match there, they overlap the whole item's stretch
            x, y = np.searchsorted(group, np.searchsorted(pair, [d * n + k, d * n + k + 1]))
            near = at[x:y] + low[group[x:y]]
            for u, v in stretches:
                keep[x:y] &= (near + width - 1 >= v) | (near + PART <= u)
        group, at = group[keep], at[keep]
        length = np.array([len(c) for c in codes])
        before = at + low[group]
        base, flat = starts[doc[group]] + before, self.offset[item[group]] + at
        # equal windows at one place are one row
        spread = int(starts[-1]) + 2 * int(self.size.max()) + 2
        _, rep, back = np.unique(self.window[flat] * spread + (base + self.size.max()), return_index=True, return_inverse=True)
        cost = np.empty(len(rep), np.int8)
        for x in range(0, len(rep), WINDOW_ROWS):
            r = rep[x : x + WINDOW_ROWS]
            size = length[doc[group[r]]]
            under = np.arange(PART + width - 1)
            place = before[r][:, None] + under
            chars = np.where((place >= 0) & (place < size[:, None]), every[np.clip(base[r][:, None] + under, 0, len(every) - 1)], 0)
            cost[x : x + WINDOW_ROWS] = window_edits(self.flat[flat[r][:, None] + np.arange(PART)], chars, before[r], size)
        good = cost[back] <= PART_EDITS
        group, at = group[good], at[good]
        if not len(at):
            return
        head = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(at) >= PART)])
        tail = np.append(head[1:], True)
        group, i, j = group[head], at[head], at[tail] + PART
        before = i + low[group]
        found: dict[tuple[int, int], list[tuple]] = {}
        for x in range(0, len(i), WINDOW_ROWS):
            y = slice(x, x + WINDOW_ROWS)
            g = group[y]
            got = align_many(
                self.flat, self.offset[item[g]] + i[y], (j - i)[y], every, starts[doc[g]] + before[y], before[y], length[doc[g]], width
            )
            for d, k, span, (edited, u, v) in zip(doc[g].tolist(), item[g].tolist(), (i - j)[y].tolist(), got.tolist(), strict=True):
                found.setdefault((d, k), []).append((span, edited, u, v))
        for (d, k), stretches in found.items():
            taken = sorted(whole.get((d, k), ()))
            for _, edited, u, v in sorted(stretches):
                x = bisect_left(taken, (u, v))
                if (x == 0 or taken[x - 1][1] <= u) and (x == len(taken) or v <= taken[x][0]):
                    taken.insert(x, (u, v))
                    out[d].append((k, u, v, edited))

    def _share_short_grams(self, every, starts, doc, item, low, width, segment, total, spot, group, at) -> np.ndarray:
        """Whether a window shares enough of its ``SHORT``-grams on the band's diagonals."""
        mine, theirs = short_grams(self.flat), short_grams(every)
        # the places of the items that some window covers
        marks = np.bincount(spot, minlength=total + PART) - np.bincount(spot + PART - SHORT + 1, minlength=total + PART)
        need = np.flatnonzero(np.cumsum(marks)[:total] > 0)
        owner = np.searchsorted(segment, need, side="right") - 1
        place = need - segment[owner]
        gram = mine[self.offset[item[owner]] + place]
        first = starts[doc[owner]] + place + low[owner]
        shared = np.zeros(len(need), bool)
        for j in range(width):
            shared |= theirs[np.clip(first + j, 0, len(theirs) - 1)] == gram
        sums = np.zeros(total + 1, np.int32)
        sums[need + 1] = shared
        np.cumsum(sums, out=sums)
        return sums[spot + PART - SHORT + 1] - sums[spot] >= PART - SHORT + 1 - SHORT * PART_EDITS


def short_grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the ``SHORT``-grams."""
    h = np.zeros(max(0, len(codes) - SHORT + 1), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(SHORT):
            h = h * np.uint32(0x9E3779B1) + codes[i : len(codes) - SHORT + 1 + i]
    return h


def window_classes(codes: np.ndarray) -> np.ndarray:
    """Per place the number of its window of ``PART`` characters; equal numbers, equal windows."""
    n = len(codes) - PART + 1
    h = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        # by doubling the length: 80 is 64 and 16
        power, size, made = _BASE, 1, {1: h}
        while 2 * size <= PART:
            h = h[:-size] * power + h[size:]
            power, size = power * power, 2 * size
            made[size] = h
        whole, at = np.zeros(n, np.uint64), 0
        for size in sorted(made, reverse=True):
            if PART & size:
                whole = whole * _MIX + made[size][at : at + n]
                at += size
    order = np.argsort(whole, kind="stable")
    new = np.ones(n, bool)
    new[1:] = whole[order[1:]] != whole[order[:-1]]
    equal = np.flatnonzero(~new)
    for x in range(0, len(equal), WINDOW_ROWS):  # equal hashes of different windows don't count
        e = equal[x : x + WINDOW_ROWS]
        a, b = (order[e - d][:, None] + np.arange(PART) for d in (0, 1))
        new[e] = (codes[a] != codes[b]).any(axis=1)
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _find(data: bytes, needle: bytes) -> Iterator[int]:
    at = data.find(needle)
    while at >= 0:
        if at % 4 == 0:
            yield at // 4
            at = data.find(needle, at + len(needle))
        else:
            at = data.find(needle, at + 1)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, read one after the other."""
    block, chars = [], 0
    items = benchmark.select("item_id", "text").where(F.length("text") > 0).orderBy("item_id", "text")
    for r in items.toLocalIterator():
        if block and chars + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str | None = None) -> DataFrame:
    """``docs`` plus ``out``: the benchmark items and parts of them in the whole text, as an array of
    (item_id, start, end, edits) in code points, by start.  ``out`` is ``_matches`` unless given; where
    a column of ``docs`` begins with ``_``, with more of them (``mark_of``)."""
    out = out or mark_of(docs) + "matches"
    at, found = docs.columns.index(text), docs
    names = []
    for i, block in enumerate(_blocks(benchmark)):
        shared = per_worker(docs.sparkSession, block)

        def columns(batch: pa.RecordBatch, shared=shared) -> list[pa.Array]:
            rows = shared.get(Index).scan(batch.column(at).to_pylist(), parts=True)
            keys = ("item_id", "start", "end", "edits")
            return [pa.array([[dict(zip(keys, m, strict=True)) for m in r] for r in rows], _MATCH)]

        names.append(f"{mark_of(docs)}{i}")
        found = map_arrow(found, [(names[-1], MATCH)], columns, 2_000_000)
    every = F.array_sort(F.concat(*names)) if len(names) > 1 else F.col(names[0]) if names else F.array().cast(MATCH)
    return found.select(*docs.columns, every.alias(out))
