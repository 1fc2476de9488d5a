"""Quality rules: measures against plain Python, cutoffs against exact binomials."""

import math
import re

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from threadlens.llm import risk_rules as R
from threadlens.llm.queries import op2_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, at = {}, {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_measures_of_the_whole_table(ready, rows):
    got = {r.doc_id: r for r in op2_quality_rules(ready, SF_SMALL).collect()}
    docs = rows("documents")
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        want = brute(d["text"])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_odd_texts(ready):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x x x x x x", "a\n\na\n \na", "é|ü <a> \x1f\x0bq", "one", "a b c d e " * 5000]
    df = ready.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r._m for r in R.measure(df).collect()}
    for i, t in enumerate(texts):
        m = got[i]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(t), t
    assert R.measure(df.limit(0)).count() == 0


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.05), (50, 50, 0.5), (40, 5000, 0.01), (900, 100_000, 0.01)])
def test_binomial_tail(ready, k, n, p):
    lf = math.lgamma
    want = sum(math.exp(lf(n + 1) - lf(j + 1) - lf(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
    df = ready.createDataFrame([(k, n, p)], "k long, n long, p double")
    got = df.select(R.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).first().t
    assert got == pytest.approx(min(want, 1.0), rel=1e-6)


def _labelled(ready, good, bad, noisy):
    """good clean rows, bad rows with a symbol per word, noisy good rows like bad ones."""
    m = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_lines:bigint,n_repeat_words:bigint>"
    rows = [("en", True, (50, 250, 0, 0, 3, 0))] * good + [("en", False, (50, 250, 100, 0, 3, 0))] * bad
    rows += [("en", True, (50, 250, 100, 0, 3, 0))] * noisy
    return ready.createDataFrame(rows, f"stratum string, good boolean, _m {m}")


def test_cutoffs_are_certified_or_off(ready):
    risk = R.Risk(risk=0.06, delta=0.05)
    on = R.calibrate(_labelled(ready, 1000, 50, 0), risk).collect()
    assert on[0].symbol_share == 0.3 and on[0].dup_line_share is None
    assert R.calibrate(_labelled(ready, 100, 50, 0), risk).count() == 0  # too few to be sure
    assert R.calibrate(_labelled(ready, 1000, 500, 100), risk).count() == 0  # a tenth of the good ones


def test_no_labels_empty_table_and_strata(ready, rows):
    docs = ready.createDataFrame([(1, "a b c d e f g h i j k", None, "x"), (1, "a", "en", "y"), (None, None, "en", "z")],
                                 "doc_id long, text string, lang string, n_chars string")
    labels = ready.createDataFrame([(None, None), (7, 1)], "doc_id long, quality int")
    got = R.quality_rules(docs, labels).collect()
    assert sorted((r.doc_id is None, r._kept) for r in got) == [(False, False), (False, True), (True, False)]
    assert R.quality_rules(docs.limit(0), labels).count() == 0
    assert R.quality_rules(docs, labels.limit(0)).count() == 3
