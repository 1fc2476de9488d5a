"""Token counts: against a plain dynamic program per word, and edge cases."""

import random
import re

import public_tokenizers as P
import pytest
from conftest import SF_SMALL
from threadlens.llm import unigram_trie as U
from threadlens.llm.common import per_worker
from threadlens.llm.queries import op9_token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def pieces():
    return U.Pieces.load(P.path("piece_bpe_32k.model"))


def brute(word, pieces):
    """(tokens, byte tokens) of one word: best score, then fewest tokens."""
    word, best = U.MARK + word, [(0.0, 0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        s, t, b = best[end - 1]
        options = [(s + n * pieces.byte, -(t + n), b + n)]
        for start in range(end):
            if word[start:end] in pieces.scores:
                s, t, b = best[start]
                options.append((s + pieces.scores[word[start:end]], -(t + 1), b))
        s, t, b = max(options, key=lambda o: o[:2])
        best.append((s, -t, b))
    return best[-1][1:]


def test_whole_table(ready, rows, pieces):
    got = {r.doc_id: r for r in op9_token_counts(ready, SF_SMALL).collect()}
    docs, memo = rows("documents"), {}
    assert len(got) == len(docs)
    for d in docs:
        words = WORD.findall(d["text"] or "")
        each = [memo.setdefault(w, None) or memo.__setitem__(w, brute(w, pieces)) or memo[w] for w in words]
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_tokens, r.n_byte_tokens) == (len(words), sum(x[0] for x in each), sum(x[1] for x in each))


def test_random_words_and_small_memory(pieces):
    rnd, c = random.Random(2), U.Counter(pieces, memory=300)
    for _ in range(5):
        words = ["".join(rnd.choice("abcdeéß日😀\x1f1") for _ in range(rnd.randint(1, 14))) for _ in range(200)]
        got = c.count([w + " " + w for w in words])
        for w, g in zip(words, got, strict=True):
            t, b = brute(w, pieces)
            assert g == (2, 2 * t, 2 * b)


def test_shared_prefixes_are_entered_once(pieces):
    path = U.Path(pieces)
    path.to("abcdef")
    before = path.score[:4]
    path.to("abcxyz")
    assert path.score[:4] == before and len(path.score) == 7


def test_odd_rows(ready, pieces):
    shared = per_worker(ready, pieces)
    df = ready.createDataFrame([(None, None, 1), (1, "", 2), (1, " \n ", 3), (2, "a " * 50_000, 4), (3, "z" * 5000, 5)], "doc_id long, text string, n_tokens int")
    got = {r.n_tokens: r for r in U.count_tokens(df, shared).collect()}
    assert [got[i]._n_words for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 50_000, 1]
    assert got[1]._n_tokens == 0 and got[4]._n_tokens == 50_000 * brute("a", pieces)[0]
    assert U.count_tokens(df.limit(0), shared).count() == 0
