"""Operators on tables whose extra columns bear the names of their own columns."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from threadlens.llm import bpe_prefix, deobfuscate, pairwise_rank, partenum_join, qgram_decontam, risk_rules, secret_parts
from threadlens.llm import sliced_simhash, unigram_trie
from threadlens.llm.common import mark_of, per_worker

NAMES = (
    "_m _w _h _s _l _stratum _kept _base_failed _cut_dup_line_share _assign _access _hex _base _spans _account _opaque _endpoint "
    "_n_assign _n_access _n_hex _score _held_out _features _id _t _y _x _half _matches _0 _n_words _n_tokens _n_byte_tokens _ids _back "
    "__kept __M in0 stratum good n node sig low c component_id fp key buckets ids decoded n_shingles rule end item_id"
).split()
WORDS = "the quick brown fox jumps over a lazy dog while seven mild wizards quietly brew strong dark tea".split()


@pytest.fixture(scope="module")
def tables(ready):
    texts = [None, "", "user: bob secret=abcdefghijklmnop https://a.example/x"]
    texts += [" ".join(WORDS[(i + j * (1 + i % 5)) % len(WORDS)] for j in range(10 + i)) for i in range(20)]
    plain = ready.createDataFrame(
        [(i, "en" if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string"
    )
    labels = ready.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(23)], "doc_id long, quality int, toxic int")
    bench = ready.createDataFrame([(1, " ".join(WORDS[:12]))], "item_id long, text string")
    odd = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    return plain, odd, labels, bench


@pytest.fixture(scope="module")
def operators(ready, tables):
    _, _, labels, bench = tables
    ranks = per_worker(ready, bpe_prefix.Ranks.load(P.path("byte_bpe_50k.tiktoken")))
    pieces = per_worker(ready, unigram_trie.Pieces.load(P.path("piece_bpe_32k.model")))
    return {
        "quality_rules": lambda d: risk_rules.quality_rules(d, labels),
        "quality_rules_no_text": lambda d: risk_rules.quality_rules(d, labels, keep_text=False),
        "encode_texts": lambda d: bpe_prefix.encode_texts(d, ranks, P.PATTERN, out=mark_of(d) + "ids", back=mark_of(d) + "back"),
        "score_toxicity": lambda d: deobfuscate.score_toxicity(d, labels),
        "rank_documents": lambda d: pairwise_rank.rank_documents(d, labels),
        "near_duplicates": partenum_join.near_duplicates,
        "find_passages": lambda d: qgram_decontam.find_passages(d, bench),
        "count_tokens": lambda d: unigram_trie.count_tokens(d, pieces),
        "find_secrets": secret_parts.find_secrets,
        "simhash": sliced_simhash.near_duplicates,
    }


ALL = "quality_rules quality_rules_no_text encode_texts score_toxicity rank_documents near_duplicates find_passages count_tokens find_secrets simhash"


@pytest.mark.parametrize("name", ALL.split())
def test_same_result_beside_any_names(operators, tables, name):
    plain, odd, _, _ = tables
    run = operators[name]
    want, got = run(plain), run(odd)
    added = [c for c in want.columns if c not in plain.columns]
    mark = mark_of(odd)
    named = {c: mark + c[1:] if c.startswith("_") else c for c in added}
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    a, b = sorted(want.collect(), key=key), sorted(got.collect(), key=key)
    assert [[r[c] for c in added] for r in a] == [[r[named[c]] for c in added] for r in b]
    kept = [n for n in NAMES if n in got.columns and n not in named.values()]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in b for n in kept)
    if any(c.startswith("_") for c in added):
        assert kept == NAMES
