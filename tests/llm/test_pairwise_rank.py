"""Quality classifier: held-out accuracy, the fit, and edge cases."""

import zlib

import numpy as np
import pytest
from threadlens.llm import pairwise_rank as R
from threadlens.llm.queries import op5_quality_classifier

SF = "/root/testdata/sf0.01"


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(ready, rows):
    got = {r.doc_id: r for r in op5_quality_classifier(ready, SF).collect()}
    assert len(got) == len(rows("documents", SF))
    assert all(r.held_out == out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    known = [(got[x["doc_id"]].predicted, x["quality"]) for x in rows("labels", SF) if out(x["doc_id"])]
    assert sum(a == b for a, b in known) / len(known) >= 0.95


def test_labels_of_held_out_rows_are_not_read(ready, rows):
    docs = ready.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    labels = ready.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", R.F.when(R.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    a, b = (sorted((r.doc_id, r._score) for r in R.rank_documents(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_fit_orders_pairs():
    rng = np.random.default_rng(1)
    truth = np.array([2.0, -1.0, 0.0])
    x = rng.normal(size=(4000, 3))
    y = 1 / (1 + np.exp(-x @ truth)) > rng.random(4000)
    m = R.fit(x[y], x[~y], pairs=20_000)
    w = np.array(m.weights)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.1 * w[0] and w[1] / w[0] == pytest.approx(-0.5, abs=0.1)
    assert m.good == pytest.approx(np.median(np.clip((x[y] - m.centre) / m.spread, -6, 6) @ w))
    assert R.fit(x[:0], x) is None


def test_odd_rows(ready):
    df = ready.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "A ! # 1\nA ! # 1", 3.0), (2, "w " * 100_000, 4.0)], "doc_id long, text string, score double")
    none = ready.createDataFrame([], "doc_id long, quality int")
    got = R.rank_documents(df, none).collect()
    assert len(got) == 4 and {r._score for r in got} == {0.5} and {r.score for r in got} == {1.0, 2.0, 3.0, 4.0}
    odd = ready.createDataFrame([(None, None), (None, 1), (1, 5), (2, 1), (2, 1)], "doc_id long, quality int")
    assert R.rank_documents(df, odd).count() == 4
    assert R.rank_documents(df.limit(0), none).count() == 0


def test_scores_equal_a_plain_fit(ready, rows):
    """The query's scores against gradient descent over the pairs and a sorted list of all scores."""
    texts = {x["doc_id"]: x["text"] for x in rows("documents", SF)}
    truth = {(x["doc_id"], x["quality"]) for x in rows("labels", SF) if x["quality"] in (0, 1) and not out(x["doc_id"]) and x["doc_id"] in texts}
    x = {i: np.array(R.features(t)) for i, t in texts.items()}
    good, bad = (np.array([x[i] for i, y in truth if y == k]) for k in (1, 0))
    every = np.vstack([good, bad])
    centre, spread = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-9)
    z = lambda v: np.clip((v - centre) / spread, -R.CLIP, R.CLIP)
    rng = np.random.default_rng(1)
    d = z(good)[rng.integers(0, len(good), 40_000)] - z(bad)[rng.integers(0, len(bad), 40_000)]
    w = np.zeros(d.shape[1])
    for _ in range(4000):
        w += 0.5 * ((d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(axis=0) - R.RIDGE * w)
    raw = {i: float(z(v) @ w) for i, v in x.items()}
    cut = sorted(raw.values())[round(len(bad) / len(every) * len(raw)) - 1]
    got = {r.doc_id: r for r in op5_quality_classifier(ready, SF).collect()}
    agree = sum((raw[i] > cut) == bool(got[i].predicted) for i in raw) / len(raw)
    order = [np.argsort(np.argsort([f(i) for i in sorted(raw)])) for f in (raw.__getitem__, lambda i: got[i].score)]
    assert agree > 0.99 and np.corrcoef(*order)[0, 1] > 0.98


def test_quantile_is_of_all_documents(ready):
    df = ready.range(1000).selectExpr("cast(id as double) / 7 as _raw")
    assert R.cutoff(df, 0.25) == pytest.approx((249 / 7 + 250 / 7) / 2) and R.cutoff(df, 1.0) == pytest.approx(999 / 7)
    assert R.cutoff(df.limit(0), 0.5) == 0.0
