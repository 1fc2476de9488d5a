"""Token counts of a unigram vocabulary by dynamic programming over a trie.

A text's pre-tokens are its words, each with the word mark in front.  The best
segmentation of a pre-token into pieces (highest sum of piece scores, then fewest
tokens) needs, at every character, only the best scores of the prefixes before it.
Pre-tokens that share a prefix share these, so the distinct pre-tokens of a batch are
inserted into a trie and each node's forward score is computed once.  The trie is
walked in order while it is built: only the path from the root to the present node is
held, and a terminal node leaves the token count of its pre-token.  A text's count is
the sum over its words.

A character that no piece covers becomes its UTF-8 bytes, one token each.

Spark runs this over Arrow batches; nothing is shuffled.  Each worker remembers the
counts of up to ``MEMORY`` words and starts afresh beyond, which changes no result.

Defined cases: null, empty or blank text: 0 tokens; very long words are one pre-token
like any other; repeated rows: each on its own; extra columns are kept (names that
begin with ``_``: see ``clear_names``).
"""

from __future__ import annotations

from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadlens.llm.common import clear_names, map_arrow

MEMORY = 1_000_000
MARK = "▁"
# how much worse than the worst piece a byte of an uncovered character is
BYTE_COST = 10.0
BYTES = 1 << 32  # a count holds tokens below this and byte tokens above


class Pieces:
    """Pieces of a unigram vocabulary with their scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.byte = min(scores.values()) - BYTE_COST

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The ordinary pieces of a sentencepiece model file."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)
        return cls({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not odd(i)})


class Path:
    """Forward scores from the trie's root to one node."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.word = pieces, ""
        # per prefix: best score, fewest tokens (byte tokens counted above BYTES) at it
        self.score, self.count = [0.0], [0]

    def to(self, word: str) -> int:
        """Goes to the node of ``word``; nodes shared with the last word are not entered again."""
        same = len(commonprefix((self.word, word)))
        score, count, pieces = self.score, self.count, self.pieces
        del score[same + 1 :], count[same + 1 :]
        get, longest = pieces.scores.get, pieces.longest
        for end in range(same + 1, len(word) + 1):
            # the last character by itself, as bytes if it is no piece
            n = len(word[end - 1].encode())
            best, fewest = score[end - 1] + n * pieces.byte, count[end - 1] + n + n * BYTES
            for start in range(end - longest if end > longest else 0, end):
                s = get(word[start:end])
                if s is None:
                    continue
                s += score[start]
                if s > best or s == best and (count[start] + 1) % BYTES < fewest % BYTES:
                    best, fewest = s, count[start] + 1
            score.append(best)
            count.append(fewest)
        self.word = word
        return count[-1]


class Counter:
    """Counts texts; remembers the counts of words."""

    def __init__(self, pieces: Pieces, memory: int = MEMORY):
        self.pieces, self.memory = pieces, memory
        self.known: dict[bytes, int] = {}

    def count(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(words, tokens, byte tokens) of each text."""
        # bytes.split() cuts at exactly the six white space characters of ASCII
        cut = [(t or "").encode().split() for t in texts]
        known, asked = self.known, set()
        for words in cut:
            asked.update(words)
        missing = asked.difference(known)
        if len(known) + len(missing) > self.memory:
            known.clear()
            missing = asked
        path = Path(self.pieces)
        for w in sorted(missing):
            known[w] = path.to(MARK + w.decode())
        out = []
        for words in cut:
            total = sum(map(known.__getitem__, words))
            out.append((len(words), total % BYTES, total // BYTES))
        for w in [w for w in missing if len(w) > 64]:
            del known[w]
        return out


@clear_names
def count_tokens(docs: DataFrame, pieces, text: str = "text") -> DataFrame:
    """``docs`` plus ``_n_words``, ``_n_tokens`` and ``_n_byte_tokens`` of the whole text.

    ``pieces`` is ``Pieces``, shared by ``per_worker``.
    """
    at = docs.columns.index(text)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = pieces.get(Counter).count(batch.column(at).to_pylist())
        return [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]

    return map_arrow(docs, [(n, T.LongType()) for n in ("_n_words", "_n_tokens", "_n_byte_tokens")], columns)
