"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one encoding, so exactly one valid last
token.  The table of these last tokens is filled from left to right: of the tokens
that end a prefix, the valid one is the one that BPE leaves standing beside the last
token of what is before it.  Reading the table backwards gives the encoding of any
prefix.  Appending bytes only adds entries; after an edit entries are recomputed
until as many as the longest token has bytes agree with the old ones in a row, since
an entry depends on no others.

Two tokens may stand side by side if undoing their merges, the later one first, meets
no pair across the seam that would have been merged earlier; answers are remembered.

Each match of the splitting pattern is encoded separately; as no match spans the place
before a lone space, texts are cut there and the encodings of whole words remembered.  Spark runs the encoder over
Arrow batches, a few hundred texts at a time; no shuffle.  The vocabulary (some 50,000
entries, its size fixed by the file) is broadcast; each worker remembers the encodings
of up to ``MEMORY`` words and pairs and starts afresh beyond, which changes no result.

Defined cases: null or empty text: no tokens, empty bytes; null id in an array: not
allowed; repeated rows: each on its own; extra columns are kept.
"""

from __future__ import annotations

import base64
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadlens.llm.common import map_arrow

MEMORY = 400_000
# longer words are not remembered, longer pieces encoded one by one
SHORT = 64
BATCH = 4_000_000  # bytes of text at a time
# a space at the end, or a space and more white space (all that Unicode calls so)
UNCUT = r" $| [\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class Ranks:
    """A byte-level BPE vocabulary: token bytes by rank, and the merge behind each."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ids = tokens
        self.tokens = {i: b for b, i in tokens.items()}
        self.longest = max(map(len, tokens))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for i in sorted(self.tokens):
            self._undo(i)

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _undo(self, i: int) -> None:
        """The pair whose merge made token ``i``: what lower ranks leave of its bytes."""
        parts = [self.ids[bytes([x])] for x in self.tokens[i]]
        while len(parts) > 2:
            best, at = None, -1
            for j in range(len(parts) - 1):
                made = self.ids.get(self.tokens[parts[j]] + self.tokens[parts[j + 1]])
                if made is not None and made < i and (best is None or made < best):
                    best, at = made, j
            if best is None:
                break
            parts[at : at + 2] = [best]
        if len(parts) == 2:
            self.left[i], self.right[i] = parts
            self.pairs[parts[0], parts[1]] = i

    def stand(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side."""
        left, right, pairs = self.left, self.right, self.pairs
        # only merges older than ``bound`` could have come first; b's own counts as older
        bound = None
        while True:
            made = pairs.get((a, b))
            if made is not None and (bound is None or made < bound):
                return False
            undo_a = a in right and (a > b or b not in left)
            if undo_a:
                bound, a = a, right[a]
            elif b in left:
                bound, b = b + 1, left[b]
            else:
                return True


class PrefixTable:
    """The last tokens of all prefixes of one piece, open to appends and edits."""

    def __init__(self, ranks: Ranks, data: bytes = b"", known: dict[int, bool] | None = None):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.known = {} if known is None else known
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def _fill(self, to: int) -> None:
        """Entries up to the prefix of ``to`` bytes."""
        data, last, known = self.data, self.last, self.known
        get, longest, stand = self.ranks.ids.get, self.ranks.longest, self.ranks.stand
        for end in range(len(last), to + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                key = last[start] << 32 | token
                fits = known.get(key)
                if fits is None:
                    fits = known[key] = stand(last[start], token)
                if fits:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replaces ``removed`` bytes at ``at``; returns how many entries were recomputed."""
        old, shift = self.last, len(inserted) - removed
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        self.last = old[: at + 1]
        agree, done = 0, 0
        for end in range(at + 1, len(self.data) + 1):
            self._fill(end)
            done += 1
            inside = end > at + len(inserted)
            agree = agree + 1 if inside and old[end - shift] == self.last[end] else 0
            if agree >= self.ranks.longest:
                self.last += old[end - shift + 1 :]
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        out, end = [], len(self.data) if end is None else end
        while end:
            out.append(self.last[end])
            end -= len(self.ranks.tokens[out[-1]])
        return out[::-1]


def _common(pieces: list[bytes]) -> list[int]:
    """How many first bytes each piece shares with the one before it."""
    if not pieces:
        return []
    wide = np.array(pieces, dtype=f"S{SHORT}").view(np.uint8).reshape(len(pieces), SHORT)
    size = np.fromiter(map(len, pieces), int, len(pieces))
    differ = wide[1:] != wide[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), SHORT)
    return [0, *np.minimum(first, np.minimum(size[1:], size[:-1])).tolist()]


class Encoder:
    """Encodes and decodes texts; remembers words and token pairs."""

    def __init__(self, ranks: Ranks, pattern: str, memory: int = MEMORY):
        self.ranks, self.memory = ranks, memory
        self.split = regex.compile(pattern).findall
        # encodings of words as they stand after a space
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[int, bool] = {}

    def _in_order(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Encodings of sorted distinct pieces; each starts from the entries of the one
        before it that belong to their common prefix."""
        get, known, stand = self.ranks.ids.get, self.known, self.ranks.stand
        last: list[int] = [-1]
        said: list[tuple[int, ...]] = [()]  # the encodings of the prefixes
        out = []
        for data, same in zip(pieces, _common(pieces), strict=True):
            del last[same + 1 :], said[same + 1 :]
            for end in range(same + 1, len(data) + 1):
                # the valid last token is unique, so the order of the search is free
                for start in range(end - 1, -1, -1):
                    token = get(data[start:end])
                    if token is None:
                        continue
                    key = last[start] << 32 | token
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = not start or stand(last[start], token)
                    if fits:
                        last.append(token)
                        said.append((*said[start], token))
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            out.append(said[-1])
        return out

    def _matches(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Encodings of texts, each split by the pattern."""
        split, get = self.split, self.ranks.ids.get
        # a word of letters is one match
        odd = {t: split(t) for t in texts if not (t[1:].isalpha() and (t[0] == " " or t[0].isalpha()))}
        pieces = set(chain.from_iterable(odd.values()))
        pieces.update([t for t in texts if t not in odd] if odd else texts)
        if len(self.known) > self.memory:
            self.known.clear()
        found: dict[str, tuple[int, ...]] = {}
        short = []
        for piece in pieces:
            data = piece.encode()
            whole = get(data)
            if whole is not None:
                found[piece] = (whole,)
            elif len(data) <= SHORT:
                short.append(piece)
            else:
                found[piece] = tuple(PrefixTable(self.ranks, data, self.known).ids())
        short.sort()  # code points sort as their UTF-8 bytes do
        found.update(zip(short, self._in_order([p.encode() for p in short]), strict=True))
        return [
            found[t] if (c := odd.get(t)) is None else tuple(chain.from_iterable(map(found.__getitem__, c))) for t in texts
        ]

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """The ids of texts; null counts as empty.

        Each distinct word of the texts is encoded once, and the ids of all its
        occurrences are gathered from there.
        """
        texts = pc.fill_null(texts, "")
        # no match spans the place before a space that something else than white space follows
        whole = pc.match_substring_regex(texts, UNCUT)
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        ends = cut.offsets.to_numpy().astype(np.int64)
        begins = ends[:-1]
        later = np.ones(ends[-1], bool)
        later[begins] = False
        firsts = pc.if_else(whole, texts, cut.values.take(pa.array(begins))).dictionary_encode()
        words = cut.values.filter(pa.array(later)).dictionary_encode()
        said = self._after_space(_strings(words.dictionary))
        code = np.empty(ends[-1], np.int64)
        code[later] = words.indices.to_numpy()
        code[begins] = firsts.indices.to_numpy() + len(said)
        said += self._matches(_strings(firsts.dictionary))
        size = np.fromiter(map(len, said), np.int64, len(said))
        ids = _gather(np.fromiter(chain.from_iterable(said), np.int32, size.sum()), size, code)
        offsets = np.concatenate([[0], np.cumsum(size[code])])[ends]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    def _after_space(self, words: list[str]) -> list[tuple[int, ...]]:
        """Encodings of distinct words as they stand after a space."""
        have = self.words
        missing = [w for w in words if w not in have]
        if len(have) + len(missing) > self.memory:
            have.clear()
            missing = words
        have.update(zip(missing, self._matches([" " + w for w in missing]), strict=True))
        said = [have[w] for w in words]
        for w in missing:
            if len(w) > SHORT:
                del have[w]
        return said

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def append(self, pieces: list[str], more: str) -> list[str]:
        """The pieces of a text with ``more`` after it: all but its last two stay."""
        return pieces[:-2] + self.split("".join(pieces[-2:]) + more)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))

    def decode_array(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of lists of ids, gathered from those of the vocabulary."""
        blob, size = self.vocabulary
        ends = ids.offsets.to_numpy()
        flat = ids.values.to_numpy()[ends[0] : ends[-1]]
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(size):
            raise ValueError("an id outside of the vocabulary")
        places = np.concatenate([[0], np.cumsum(size[flat])])[ends - ends[0]]
        data = _gather(blob, size, flat)
        return pa.Array.from_buffers(
            pa.binary(), len(ids), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)]
        )

    @cached_property
    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens by id, one after the other, and their lengths."""
        tokens = [self.ranks.tokens.get(i, b"") for i in range(max(self.ranks.tokens) + 1)]
        return np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _gather(flat: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The runs numbered ``code``, in that order; run i is ``size[i]`` items of ``flat``."""
    start, length = np.cumsum(size) - size, size[code]
    shift = start[code] - (np.cumsum(length) - length)
    return flat[np.repeat(shift, length) + np.arange(length.sum())]


def encode_texts(
    docs: DataFrame, ranks, pattern: str, text: str = "text", out: str = "ids", back: str | None = None
) -> DataFrame:
    """``docs`` plus ``out``, the token ids of the whole text (array of int).

    With ``back``, also a column of that name with the bytes the ids decode to.
    ``ranks`` is ``Ranks``, shared by ``per_worker``.
    """
    at = docs.columns.index(text)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = ranks.get(Encoder, pattern)
        ids = coder.encode_array(batch.column(at))
        return [ids, coder.decode_array(ids)] if back else [ids]

    added = [(out, T.ArrayType(T.IntegerType(), False)), *[(back, T.BinaryType())] * bool(back)]
    return map_arrow(docs, added, columns, BATCH)


def decode_ids(df: DataFrame, ranks, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out``, the bytes of the ids."""
    at = df.columns.index(ids)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        return [ranks.get(Encoder, pattern).decode_array(batch.column(at))]

    return map_arrow(df, [(out, T.BinaryType())], columns, BATCH)
