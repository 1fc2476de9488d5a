"""Byte-level BPE: against the tiktoken library, round trips, appends and edits."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from conftest import SF_SMALL
from threadlens.llm import bpe_prefix as B
from threadlens.llm.common import per_worker
from threadlens.llm.queries import op3_byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return B.Ranks.load(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def test_whole_table(ready, rows, library):
    got = {r.doc_id: r for r in op3_byte_bpe(ready, SF_SMALL).collect()}
    docs = rows("documents")
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d["text"] or "").encode()).hexdigest()


@pytest.mark.parametrize("alphabet", ["ab c'sd\n", "  abé 19'\n\t.,!sstréüß日本　\u0085😀̈ª²", "0123456789abcdef", "a!'  \r\n"])
def test_random_texts(ranks, library, alphabet):
    rnd, e = random.Random(7), B.Encoder(ranks, P.PATTERN, memory=2000)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for i in range(0, len(texts), 500):  # the memory overflows on the way
        part = texts[i : i + 500]
        ids = e.encode(part)
        assert ids == [library.encode_ordinary(t) for t in part]
        assert [e.decode(x).decode() for x in ids] == part


def test_long_words_and_texts(ranks, library):
    texts = ["a" * 3000, "ab" * 2000 + " " + "!" * 500, "word " * 30_000, " " * 700, "x\n" * 900]
    assert B.Encoder(ranks, P.PATTERN).encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_prefix_appends_and_edits(ranks):
    rnd = random.Random(3)
    for _ in range(60):
        data = bytes(rnd.choice(b"abcdest ,.xyz") for _ in range(rnd.randint(1, 400)))
        whole = B.PrefixTable(ranks, data)
        cut = rnd.randint(0, len(data))
        grown = B.PrefixTable(ranks, data[:cut])
        grown.append(data[cut:])
        assert grown.last == whole.last
        assert whole.ids(cut) == B.PrefixTable(ranks, data[:cut]).ids()
        at = rnd.randint(0, len(data))
        gone, new = rnd.randint(0, min(5, len(data) - at)), bytes(rnd.choice(b"qe st") for _ in range(rnd.randint(0, 5)))
        whole.edit(at, gone, new)
        fresh = B.PrefixTable(ranks, data[:at] + new + data[at + gone :])
        assert whole.data == fresh.data and whole.last == fresh.last


def test_an_edit_recomputes_only_what_is_near(ranks):
    table = B.PrefixTable(ranks, b"the quick brown fox jumps " * 200)
    assert table.edit(1000, 3, b"cat") < 400


def test_text_append(ranks, library):
    rnd, e = random.Random(5), B.Encoder(ranks, P.PATTERN)
    for _ in range(500):
        t = "".join(rnd.choice("ab'l ls\n 1!") for _ in range(rnd.randint(0, 30)))
        cut = rnd.randint(0, len(t))
        assert e.append(e.split(t[:cut]), t[cut:]) == e.split(t)


def test_nulls_repeats_and_clashing_names(ready, ranks):
    shared = per_worker(ready, ranks)
    df = ready.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "hi there", "c")], "doc_id long, text string, decoded string")
    enc = B.encode_texts(df, shared, P.PATTERN)
    got = B.decode_ids(enc, shared, P.PATTERN, out="back").collect()
    assert sorted((r.decoded, bytes(r.back)) for r in got) == [("a", b""), ("a", b""), ("b", b""), ("c", b"hi there")]
    assert B.encode_texts(df.limit(0), shared, P.PATTERN).count() == 0
