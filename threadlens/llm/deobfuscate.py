"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

Writers hide words by look-alike signs (``1d10t``), separators (``s.t.u.p.i.d``, or one
letter a word) and repetition (``looooser``).  Such a word is a lattice: each sign stands
for itself, for the letters it looks like, or for nothing, each at a cost of the
channel.  Viterbi decoding finds the path that is likeliest under a character trigram
model and the channel.  Words without such signs have one path and stay.  A run of single
characters is one lattice in which every gap may also be a word end, so that a phrase
spaced letter by letter gives all its words.

The character model comes from all words of all documents: every task counts
trigrams, Spark sums them.  What toxic text is made of is learned from labelled documents:
words and word beginnings of the restored texts, each weighed by the log odds of the
smoothed share of toxic documents among those that have it.  A text is scored by a
logistic function of its three heaviest distinct words, the sum of all weights and its
length; one half of the sample gives the weights, the other half the logistic function.

Fitting uses a bounded sample, the ``MAX_LABELLED`` labelled rows with the lowest hash of
their id (joined by broadcast, so no text is shuffled), and of the words and beginnings that speak for
toxic the ``MAX_EVIDENCE`` with the highest odds.  The character model's counts are sums over all
trigrams of the corpus; of trigrams, pairs and contexts the ``MAX_GRAMS`` commonest are broadcast,
rarer ones fall back on shorter contexts.  All documents are scored.

Runs of one sign are read as three of them, runs of separators and of a letter with its separator as one;
words of any length are decoded.  Words cut in longer chunks (``stu pid``) are not joined.

Defined cases: null or empty text: the score of no evidence; null id: never a training row,
not held out; labels of one kind only: the same score everywhere; repeated rows: each on its own;
extra columns are kept
(names that begin with ``_``: see ``clear_names``).
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import clear_names, hash_sample, largest, map_arrow, per_worker, slices, stored
from threadlens.llm.pairwise_rank import held_out

MAX_LABELLED = 20_000
MAX_EVIDENCE = 50_000
MAX_GRAMS = 200_000
MIN_TOXIC = 3  # toxic documents a word must be in to count as evidence
PRIOR = 20.0  # documents that the prior share weighs
BEGINNINGS = (4, 5, 6)
SHORT_WORD = 40  # words up to this length are remembered
MEMORY = 500_000

# look-alike signs (fixed values)
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
BETWEEN = set(".-_*'~")
EDGES = ".,;:?\"'()[]{}<>…«»“”‘’*-_~#%&=/\\"
START, END = "^", "$"

_DISGUISED = re.compile(r"(?i)^[\w@$!|+(€£¡.*'~-]+$").match
_RUN = re.compile(r"([^\W\d_])\1\1").search
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)").findall
_MANY = re.compile(r"(.)\1{3,}")
_SPREAD = re.compile(r"([^\W\d_][.\-_*'~])\1{2,}")
_SEPARATORS = re.compile(r"([.\-_*'~])[.\-_*'~]+")
# channel costs in nats
SWAP, DROP_SIGN, DROP_EDGE, DROP_BETWEEN, DROP_REPEAT, DROP_DOUBLE = 1.0, 14.0, 3.0, 0.3, 0.5, 6.0
WORD_END, DROP_WIDE = 1.0, 3.0  # a word end at a narrow gap of a run, none at a wide one


# the shorter sums of a trigram, as (first character, length): its last two, its last, its first two, its middle one
SUMS = ((1, 2), (2, 1), (0, 2), (1, 1))


class CharModel:
    """Trigram model over characters, falling back on shorter contexts."""

    def __init__(self, tri: dict[str, int], bi: dict[str, int], uni: dict[str, int], tri_of: dict[str, int], bi_of: dict[str, int]):
        # a trigram whose context was not kept falls back as an unknown one does
        self.tri = {g: n for g, n in tri.items() if g[:2] in tri_of}
        self.bi, self.uni, self.tri_of, self.bi_of = Counter(bi), Counter(uni), Counter(tri_of), Counter(bi_of)
        self.total, self.kinds = sum(uni.values()), len(uni) + 1

    @classmethod
    def of(cls, grams: dict[str, int]) -> CharModel:
        """The model of some trigrams with their counts."""
        parts = [Counter() for _ in SUMS]
        for g, n in grams.items():
            for sums, (at, size) in zip(parts, SUMS, strict=True):
                sums[g[at : at + size]] += n
        return cls(grams, *parts)

    def cost(self, context: str, c: str) -> float:
        """Negative log of the chance of ``c`` after two characters."""
        p = (self.uni[c] + 0.5) / (self.total + 0.5 * self.kinds)
        p = (self.bi[context[1] + c] + 5 * p) / (self.bi_of[context[1]] + 5)
        p = (self.tri.get(context + c, 0) + 5 * p) / (self.tri_of[context] + 5)
        return -math.log(p)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Per character the readings with their channel costs; "" stands for nothing."""
    out = []
    for i, c in enumerate(word):
        again = i > 0 and word[i - 1] == c
        long = again and (i > 1 and word[i - 2] == c or i + 1 < len(word) and word[i + 1] == c)
        skip = DROP_REPEAT if long else DROP_DOUBLE
        if c in LOOKS:
            sign = DROP_SIGN if c.isdigit() or 0 < i < len(word) - 1 else DROP_EDGE
            options = [(m, SWAP) for m in LOOKS[c]] + [("", min(sign, skip) if again else sign)]
        elif c in BETWEEN:
            options = [("", DROP_BETWEEN)]
        else:
            options = [(c, 0.0)] + ([("", skip)] if again else [])
        out.append(options)
    return out


def decode(word: str, model: CharModel) -> str:
    """The likeliest reading of a disguised word."""
    # per context the cost and the path as (path before, character)
    best: dict[str, tuple[float, tuple | None]] = {START * 2: (0.0, None)}
    for options in lattice(word):
        after: dict[str, tuple[float, tuple | None]] = {}
        for context, (cost, path) in best.items():
            for c, extra in options:
                state, total = context, cost + extra
                if c:
                    state, total = context[1] + c, total + model.cost(context, c)
                if state not in after or total < after[state][0]:
                    after[state] = total, (path, c) if c else path
        best = after
    return _said(min(((cost + model.cost(s, END), path) for s, (cost, path) in best.items()), key=lambda e: e[0])[1])


def _said(path: tuple | None) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def spaced_words(text: str, model: CharModel) -> list[str]:
    """The likeliest words of the runs of single characters in a text.

    A gap wider than the run's narrowest one is a word end for nothing.
    """
    out = []
    for run in _SPACED(text.lower()):
        signs, gaps = run.split(), [len(g) for g in re.findall(r"\s+", run)]
        if not any(map(str.isalpha, signs)):
            continue
        narrow = min(gaps)
        # per context the cost and the path as (path before, character)
        best: dict[str, tuple[float, tuple | None]] = {START * 2: (0.0, None)}
        for i, options in enumerate(lattice("".join(signs))):
            if i:
                wide = gaps[i - 1] > narrow
                ends = [
                    (cost + model.cost(s, END) + (0.0 if wide else WORD_END), (path, " "))
                    for s, (cost, path) in best.items() if s != START * 2
                ]
                if wide:
                    best = {s: (cost + (DROP_WIDE if s != START * 2 else 0.0), path) for s, (cost, path) in best.items()}
                if ends:
                    end = min(ends, key=lambda e: e[0])
                    if START * 2 not in best or end[0] < best[START * 2][0]:
                        best[START * 2] = end
            after: dict[str, tuple[float, tuple | None]] = {}
            for context, (cost, path) in best.items():
                for c, extra in options:
                    state, total = context, cost + extra
                    if c:
                        state, total = context[1] + c, total + model.cost(context, c)
                    if state not in after or total < after[state][0]:
                        after[state] = total, (path, c) if c else path
            best = after
        path = min(((cost + model.cost(s, END), path) for s, (cost, path) in best.items()), key=lambda e: e[0])[1]
        out += _said(path).split()
    return out


def squeezed(word: str) -> str:
    """The word with long runs of a sign, of separators, and of a letter and a separator cut short."""
    return _SPREAD.sub(r"\1", _SEPARATORS.sub(r"\1", _MANY.sub(r"\1\1\1", word)))


def disguised(core: str) -> bool:
    """Whether a word (without outer punctuation) could be read otherwise."""
    if len(core) < 3 or core.isalpha() and not _RUN(core):
        return False
    return bool(_DISGUISED(core)) and any(map(str.isalpha, core))


def restored(word: str, model: CharModel) -> list[str]:
    """The word in lower case without outer punctuation, and its likeliest reading."""
    core = word.lower().strip(EDGES)
    if core.isalpha() and not _RUN(core):  # most words: neither signs nor repetition
        return [core]
    said = [core]
    bare = core.strip("!$+|")
    if bare != core:
        said.append(bare)
    for c in dict.fromkeys(said):
        if disguised(c) and (read := decode(squeezed(c), model)) not in said:
            said.append(read)
    return said


def evidence(word: str, model: CharModel) -> Iterator[str]:
    """The restored forms of a word and their beginnings (marked by a final ``~``)."""
    for form in restored(word, model):
        yield form
        for n in BEGINNINGS:
            if len(form) > n:
                yield form[:n] + "~"


def words_of(text: str) -> list[str]:
    """Words, and runs of single characters joined to one word; a one-letter word may
    stand before or after the run, so it is also read without its first or last letter."""
    runs = ["".join(s.split()) for s in _SPACED(text)]
    return text.split() + [x for s in runs for x in (s, s[1:], s[:-1])]


def all_words(text: str, model: CharModel) -> list[str]:
    """``words_of`` a text and its ``spaced_words``; runs are looked for only if there are
    three words of one character that follow one another (lower case makes no word shorter)."""
    words = text.split()
    single = [i for i, n in enumerate(map(len, words)) if n == 1]
    if not any(k - i == 2 for i, k in zip(single, single[2:], strict=False)):
        return words
    return words_of(text) + spaced_words(text, model)


def char_model(docs: DataFrame, text: str = "text") -> CharModel:
    """The character model of all words of all documents."""
    at = docs.columns.index(text)

    def grams(words: Iterable[tuple[str, int]], out: Counter) -> None:
        for w, n in words:
            core = w.lower().strip(EDGES)
            if core.isalpha():
                s = START * 2 + core + END
                for i in range(len(s) - 2):
                    out[s[i : i + 3]] += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = Counter(), Counter()
        for part in slices(batches, 8_000_000):
            for t in part.column(at).to_pylist():
                if t:
                    words.update(t.split())
            long = [w for w in words if len(w) > SHORT_WORD]
            grams([(w, words.pop(w)) for w in long], out)
            if len(words) > MEMORY:
                grams(words.items(), out)
                words.clear()
            if len(out) > MEMORY:
                yield _counts("gram", out)
        grams(words.items(), out)
        yield _counts("gram", out)

    counted = docs.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = stored(counted, "trigrams")
    # the sums over all trigrams are made before any is left out
    parts = [counted] + [
        counted.groupBy(F.substring("gram", i + 1, size).alias("gram")).agg(F.sum("n").alias("n")) for i, size in SUMS
    ]
    return CharModel(*({r["gram"]: r["n"] for r in largest(p, MAX_GRAMS, "n", "gram").collect()} for p in parts))


def _counts(name: str, out: Counter) -> pa.RecordBatch:
    """What was counted so far; counting begins anew."""
    batch = pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], [name, "n"])
    out.clear()
    return batch


def _having(rows: DataFrame, model: per_worker) -> DataFrame:
    """In how many toxic (``n``) and clean (``others``) documents each piece of evidence is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, memo, out = model.get(_same), {}, (Counter(), Counter())
        for part in slices(batches, 8_000_000):
            for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for w in set(all_words(t or "", chars)):
                    if w in memo:
                        found.update(memo[w])
                        continue
                    pieces = list(evidence(w, chars))
                    found.update(pieces)
                    if len(w) <= SHORT_WORD:
                        if len(memo) > MEMORY:
                            memo.clear()
                        memo[w] = pieces
                out[y].update(found)
            if max(map(len, out)) > MEMORY:
                yield from sides(out)
        yield from sides(out)

    def sides(out: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for y, counted in enumerate(out):
            b = _counts("e", counted)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, y, np.int32))], ["e", "n", "y"])

    counted = rows.select("_t", "_y").mapInArrow(run, "e string, n long, y int")
    return counted.groupBy("e").agg(
        F.sum(F.col("n") * F.col("y")).alias("n"), F.sum(F.col("n") * (1 - F.col("y"))).alias("others")
    )


def _same(x):
    return x


class Scorer:
    """Measures texts by the weights of their words; remembers words."""

    def __init__(self, learned: tuple[CharModel, dict[str, float]]):
        self.chars, self.weight = learned
        self.known: dict[str, float] = {}

    def _word(self, w: str) -> float:
        have, best = self.weight, None
        for form in restored(w, self.chars):
            for e in (form, *[form[:n] + "~" for n in BEGINNINGS if len(form) > n]):
                x = have.get(e)
                if x is not None and (best is None or x > best):
                    best = x
        return 0.0 if best is None else best

    def measure(self, texts: Iterable[str | None]) -> np.ndarray:
        """Per text: 1, the three heaviest distinct words, all weights, length (both as logs)."""
        cut = [all_words(t or "", self.chars) for t in texts]
        known, asked = self.known, set()
        for c in cut:
            asked.update(c)
        missing = asked.difference(known)
        if len(known) + len(missing) > MEMORY:
            known.clear()
            missing = asked
        for w in missing:
            known[w] = self._word(w)
        out = np.zeros((len(cut), 6))
        for i, c in enumerate(cut):
            heavy = [x for x in map(known.__getitem__, set(c)) if x]
            top = heapq.nlargest(3, heavy)
            out[i] = [1.0, *top, *[0.0] * (3 - len(top)), math.log1p(sum(heavy)), math.log1p(len(c))]
        for w in [w for w in missing if len(w) > SHORT_WORD]:
            del known[w]
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of ``x`` that tell ``y`` 1 from 0."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _odds(p: float) -> float:
    return math.log(p / (1 - p))


def _weights(rows: DataFrame, model: per_worker, rate: float) -> dict[str, float]:
    """Evidence that speaks for toxic, by its log odds over the sample's."""
    found = _having(rows, model).where(F.col("n") >= MIN_TOXIC)
    share = (F.col("n") + PRIOR * rate) / (F.col("n") + F.col("others") + PRIOR)
    strong = found.select("e", share.alias("p")).where(F.col("p") > 1.5 * rate)
    return {r["e"]: round(_odds(r["p"]) - _odds(rate), 6) for r in largest(strong, MAX_EVIDENCE, "p", "e").collect()}


@dataclass(frozen=True)
class Learned:
    """The character model, the weights of the evidence, and the logistic function."""

    chars: CharModel
    weight: dict[str, float]
    logit: tuple[float, ...]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> Learned:
    """What is learned from all words and from the labelled rows that are not held out."""
    spark = docs.sparkSession
    chars = char_model(docs, text)
    model = per_worker(spark, chars)
    truth = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).select(
        F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")
    )
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("_id")), F.lit(2))
    # bounded by MAX_LABELLED, hence safe to broadcast
    sample = F.broadcast(hash_sample(truth, MAX_LABELLED, "_id", "_y").withColumn("_half", half))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_t")).join(sample, "_id").select("_t", "_y", "_half")
    rows = stored(rows, "labelled")
    n_toxic, n_clean = (rows.where(F.col("_y") == y).count() for y in (1, 0))
    rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    weight = _weights(rows.where(F.col("_half") == 0), model, rate)
    scorer = per_worker(spark, (chars, weight))

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(list(scorer.get(Scorer).measure(batch.column(0).to_pylist())), pa.list_(pa.float64()))]

    rest = map_arrow(rows.where(F.col("_half") == 1), [("_x", T.ArrayType(T.DoubleType()))], columns)
    rest = sorted(rest.select("_y", "_x").collect(), key=lambda r: (r["_x"], r["_y"]))
    x, y = np.array([r["_x"] for r in rest]).reshape(-1, 6), np.array([r["_y"] for r in rest], dtype=float)
    if 0 < y.sum() < len(y):
        # the logistic function is known; for scoring, both halves give evidence
        return Learned(chars, _weights(rows, model, rate), tuple(map(float, logistic(x, y))))
    return Learned(chars, {}, (_odds(rate), *[0.0] * 5))


@clear_names
def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_held_out`` and ``_score``."""
    learned = learn(docs, labels, text)
    scorer = per_worker(docs.sparkSession, (learned.chars, learned.weight))
    logit, at = np.array(learned.logit), docs.columns.index(text)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        x = scorer.get(Scorer).measure(batch.column(at).to_pylist())
        return [pa.array(1 / (1 + np.exp(-np.clip(x @ logit, -30, 30))), pa.float64())]

    got = map_arrow(docs, [("_score", T.DoubleType())], columns)
    return got.withColumn("_held_out", held_out(F.col("doc_id")))
