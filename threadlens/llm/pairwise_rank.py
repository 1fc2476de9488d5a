"""Quality classifier: Bradley-Terry pairwise ranking.

Every document is measured once.  Preference pairs (a document labelled good, one
labelled bad) say that the first should win; the chance that it does is the logistic
function of the difference of two scores, each linear in the document's features.  The
weights minimise the logistic loss on the feature differences (Newton steps with a
ridge).  All documents are then ranked by score, and the cutoff is the quantile of all
scores at the labelled share of bad documents (``percentile_approx``, a rank error of at most
1 / ``ACCURACY``; half-way to the next score above); the reported score is a logistic curve
through the cutoff, where it equals ``CUT``.

Fitting uses a bounded sample: ``MAX_LABELLED`` labelled rows, those with the lowest
hash of their id, and ``MAX_PAIRS`` pairs drawn from them with a fixed seed.  Only the
sample's features come to the driver.  The share and the quantile cover all labels and all
documents.  Everything else covers all rows: one Arrow
pass measures, its narrow result is stored and scored by column expressions.

Defined cases: null or empty text: the features of no words; null id: never a
training row, not held out; no labels of one kind: all scores 0.5; repeated rows: each on
its own; extra columns are kept (names that begin with ``_``: see ``clear_names``).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import clear_names, hash_sample, map_arrow, stored

MAX_LABELLED = 20_000
MAX_PAIRS = 40_000
CUT = 0.7
RIDGE = 1e-3
ACCURACY = 100_000
CLIP = 6.0  # standard deviations
FEATURES = ("words", "word_length", "neighbours_equal", "distinct", "symbols", "exclamations", "capitals", "digits", "lines_repeated", "compressed")

_CAPITALS, _DIGITS, _SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>"


def features(text: str | None) -> list[float]:
    """Measures of a whole text, in the order of FEATURES."""
    data = (text or "").encode()
    words, size = data.split(), max(1, len(data))
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        # distinct words grow slower than the text: compare with its square root
        float(np.log1p(len(set(words)) / n**0.8)),
        float(np.log1p(10 * sum(map(data.count, _SYMBOLS)) / n)),
        float(np.log1p(10 * data.count(b"!") / n)),
        (size - len(data.translate(None, _CAPITALS))) / size,
        (size - len(data.translate(None, _DIGITS))) / size,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(zlib.compress(data, 1)) / size),
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised features, and the middle score of the good documents."""

    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    good: float


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, by the CRC-32 of their decimal text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = MAX_PAIRS, seed: int = 7) -> Ranking | None:
    """Bradley-Terry weights from the features of good and bad documents."""
    if not len(good) or not len(bad):
        return None
    every = np.vstack([good, bad])
    centre, spread = every.mean(axis=0), every.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = lambda x: np.clip((x - centre) / spread, -CLIP, CLIP)
    rng = np.random.default_rng(seed)
    d = z(good)[rng.integers(0, len(good), pairs)] - z(bad)[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the pair is lost
        grad = -(d * p[:, None]).mean(axis=0) + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Ranking(*(tuple(map(float, x)) for x in (centre, spread, w)), float(np.median(z(good) @ w)))


def measured(docs: DataFrame, text: str = "text", out: str = "_features") -> DataFrame:
    """``docs`` without the text, plus the features of the whole text; stored."""
    at = docs.columns.index(text)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([features(t) for t in batch.column(at).to_pylist()], pa.list_(pa.float64()))]

    return stored(map_arrow(docs, [(out, T.ArrayType(T.DoubleType()))], columns).drop(text), "features")


def learn(known: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[Ranking | None, float]:
    """The ranking learned from the labelled rows that are not held out, and the share of bad ones."""
    truth = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).select(
        F.col("doc_id").alias("_id"), F.col(label).alias("_y")
    ).distinct()
    labelled = known.select(F.col("doc_id").alias("_id"), "_features").join(truth, "_id")
    n = labelled.agg(F.count("*").alias("all"), F.count_if(F.col("_y") == 0).alias("bad")).first()
    rows = hash_sample(labelled, MAX_LABELLED, "_id", "_y", "_features").select("_y", "_features").collect()
    side = lambda y: np.array([r["_features"] for r in rows if r["_y"] == y]).reshape(-1, len(FEATURES))
    return fit(side(1), side(0)), n["bad"] / max(1, n["all"])


def raw_score(model: Ranking, x: Column) -> Column:
    """What the documents are ranked by."""
    s = F.lit(0.0)
    for i, (c, d, w) in enumerate(zip(model.centre, model.spread, model.weights, strict=True)):
        s = s + F.greatest(F.least((F.get(x, F.lit(i)) - c) / d, F.lit(CLIP)), F.lit(-CLIP)) * w
    return s


def cutoff(scores: DataFrame, share: float) -> float:
    """The quantile of all ``_raw`` scores, half-way between the last score below it and the first above."""
    last = scores.agg(F.percentile_approx("_raw", share, ACCURACY).alias("q")).first().q
    if last is None:
        return 0.0
    above = scores.where(F.col("_raw") > last).agg(F.min("_raw").alias("q")).first().q
    return last if above is None else (last + above) / 2


def reported(raw: Column, at: float, good: float) -> Column:
    """The reported score, 0 to 1: ``CUT`` at the cutoff ``at``."""
    scale = max((good - at) / 4, 1e-6)
    return 1 / (1 + F.exp(-((raw - at) / scale + float(np.log(CUT / (1 - CUT))))))


@clear_names
def rank_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the text, plus ``_held_out`` and ``_score``."""
    known = measured(docs)
    model, share = learn(known, labels)
    if model is None:
        score = F.lit(0.5)
    else:
        raw = raw_score(model, F.col("_features"))
        score = reported(raw, cutoff(known.select(raw.alias("_raw")), share), model.good)
    return known.select(
        *[c for c in docs.columns if c != "text"], held_out(F.col("doc_id")).alias("_held_out"), score.alias("_score")
    )
