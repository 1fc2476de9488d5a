"""Toxicity: decoding, held-out recall, and edge cases."""

import random
import zlib

import pytest
from threadlens.llm import deobfuscate as D
from threadlens.llm.queries import op4_toxicity

SF = "/root/testdata/sf0.1"
WORDS = "idiot stupid loser clown worthless thing the reason station water"


@pytest.fixture(scope="module")
def chars():
    grams = {}
    for w in WORDS.split():
        s = "^^" + w + "$"
        for i in range(len(s) - 2):
            grams[s[i : i + 3]] = grams.get(s[i : i + 3], 0) + 50
    return D.CharModel.of(grams)


@pytest.mark.parametrize("hidden,word", [
    ("1d10t", "idiot"), ("st0p", "st0p"), ("$tupid", "stupid"), ("5tup1d", "stupid"), ("looooser", "loser"), ("c.l.o.w.n", "clown"),
    ("l" + "o" * 60 + "ser", "loser"), ("-".join("i" * 30 + "diot"), "idiot"), ("c" + "." * 50 + "lown", "clown"), ("w0rthl3ss", "worthless"), ("W0RTHLESS!!!", "worthless"), ("i-d-i-o-t", "idiot"), ("cl0wn,", "clown"),
])
def test_decoding(chars, hidden, word):
    assert word in D.restored(hidden, chars)


def test_viterbi_equals_all_paths(chars):
    import itertools

    for word in ("1d10t", "l00ser", "st-u", "aab!", "8o"):
        paths = []
        for p in itertools.product(*D.lattice(word)):
            said, cost, ctx = "", 0.0, "^^"
            for c, extra in p:
                cost += extra
                if c:
                    cost += chars.cost(ctx, c)
                    ctx, said = ctx[1] + c, said + c
            paths.append((cost + chars.cost(ctx, "$"), said))
        assert D.decode(word, chars) == min(paths)[1]


def test_plain_words_stay(chars):
    for w in ("thing", "42", "", "...", "the.", "4587121519400672"):
        assert len(D.restored(w, chars)) == 1
    assert D.words_of("an i d i o t here") == ["an", "i", "d", "i", "o", "t", "here", "idiot", "diot", "idio"]


def test_held_out_recall(ready, rows):
    got = {r.doc_id: r for r in op4_toxicity(ready, SF).collect()}
    assert len(got) == len(rows("documents", SF))
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r.held_out == out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[x["doc_id"]].predicted, x["toxic"]) for x in rows("labels", SF) if out(x["doc_id"])]
    assert sum(p for p, y in held if y) / sum(y for _, y in held) >= 0.9
    assert sum(p for p, y in held if not y) / sum(1 - y for _, y in held) <= 0.03


def test_disguised_documents_are_found(ready, rows):
    docs = ready.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = ready.read.parquet(f"{SF}/labels.parquet")
    base = rows("documents", SF)[5]["text"][:400]
    new = [(-1, base + " you 1d10t"), (-2, base + " s t u p i d"), (-3, "m.o.r.o.n " + base), (-4, base + " w0rthl3ss"), (-5, base), (-6, None), (-7, "")]
    both = docs.unionByName(ready.createDataFrame(new, "doc_id long, text string"))
    got = {r.doc_id: r._score for r in D.score_toxicity(both, labels).where("doc_id < 0").collect()}
    assert min(got[i] for i in (-1, -2, -3, -4)) >= 0.3 > max(got[i] for i in (-5, -6, -7))


def test_odd_rows(ready):
    df = ready.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "a" * 100_000 + " b", "z"), (1, "a" * 100_000 + " b", "z")], "doc_id long, text string, _t string")
    none = ready.createDataFrame([], "doc_id long, toxic int")
    got = D.score_toxicity(df, none).collect()
    assert len(got) == 4 and len({r["__score"] for r in got}) == 1 and sorted(r._t for r in got) == ["x", "y", "z", "z"]
    assert D.score_toxicity(df.limit(0), none).count() == 0


@pytest.mark.parametrize("text,words", [
    ("so y o u a r e s t u p i d ok", ["you", "are", "stupid"]), ("w h a t a n i d i o t", ["what", "an", "idiot"]),
    ("y o u  a r e  s t u p 1 d", ["you", "are", "stupid"]), ("w\th\ta\tt\na\tn\ti\td\ti\to\tt", ["what", "an", "idiot"]),
    ("I  D  I  O  T", ["idiot"]), ("1 2 3 4 5", []), ("no run here", []),
])
def test_phrases_spaced_letter_by_letter(text, words):
    grams = {}
    for w in [*WORDS.split(), *"you are what an".split() * 3]:
        s = "^^" + w + "$"
        for i in range(len(s) - 2):
            grams[s[i : i + 3]] = grams.get(s[i : i + 3], 0) + 50
    chars = D.CharModel.of(grams)
    heavy = {w: 2.0 for w in ("stupid", "idiot")}
    assert (D.Scorer((chars, heavy)).measure([text])[0][1] == 2.0) == any(w in heavy for w in words)
    assert D.spaced_words(text, chars) == words
    assert len(D.spaced_words("a b " * 50_000, chars)) > 0


def test_model_counts_all_trigrams(ready, monkeypatch):
    docs = ready.createDataFrame([("abc abd " + "x" * 50,), ("abc qed",), (None,)], "text string")
    whole = D.char_model(docs)
    want = D.CharModel.of(whole.tri)
    assert (whole.bi, whole.uni, whole.tri_of, whole.bi_of, whole.total) == (want.bi, want.uni, want.tri_of, want.bi_of, want.total)
    assert whole.tri["xxx"] == 48 and whole.tri["^^a"] == 3
    monkeypatch.setattr(D, "MAX_GRAMS", 8)
    few = D.char_model(docs)
    assert len(few.tri) <= 8 and few.tri["xxx"] == 48
    assert all(few.tri_of[c] == whole.tri_of[c] for c in few.tri_of) and all(few.uni[c] == whole.uni[c] for c in few.uni)


def test_evidence_is_ranked_by_odds(ready, monkeypatch):
    rows = [("vile word" if i < 15 else "word", 1) for i in range(40)] + [("word" if i < 10 else "fine", 0) for i in range(60)]
    df = ready.createDataFrame(rows, "_t string, _y int")
    model, rate = D.per_worker(ready, D.CharModel.of({"^^a": 1})), 0.4
    p = {"vile": (15 + 8) / (15 + 20), "word": (40 + 8) / (50 + 20)}
    assert D._weights(df, model, rate) == {e: round(D._odds(v) - D._odds(rate), 6) for e, v in p.items()}
    monkeypatch.setattr(D, "MAX_EVIDENCE", 1)
    rows = [("rare common" if i < 15 else "common", 1) for i in range(40)] + [("common", 0)] * 20
    df = ready.createDataFrame(rows, "_t string, _y int")
    assert set(D._weights(df, model, rate)) == {"rare"}


def test_runs_are_looked_for_only_where_they_can_be(chars, monkeypatch):
    rng = random.Random(4)
    signs = ["a", "İ", "ß", "so", "s.o", "\x1c", "　", "​", " ", " ", " ", "\n", "x"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(2000)] + ["i d i o t", "a b", ""]
    for t in texts:
        assert D.all_words(t, chars) == D.words_of(t) + D.spaced_words(t, chars)
    monkeypatch.setattr(D, "_SPACED", None)  # not called
    assert D.Scorer((chars, {})).measure(["so it is a x or y", None]).shape == (2, 6)
