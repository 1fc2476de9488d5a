"""The pipeline against a brute-force version of every stage on sf0.001."""

import base64

import corpus_pipeline as C
import public_tokenizers as P
import tiktoken
from conftest import SF_SMALL
from test_partenum_join import brute as brute_groups
from test_qgram_decontam import least_edits
from test_risk_rules import brute as brute_measures
from test_secret_parts import brute as brute_secrets
from threadlens.llm import qgram_decontam as Q
from threadlens.llm import secret_parts as S
from threadlens.llm.common import stored
from threadlens.llm.queries import op2_quality_rules, op10_secret_scans


def test_run_equals_brute_force(ready, rows):
    docs = rows("documents")
    # quality: the base rules here, the certified rules from the operator's own query
    kept = {r.doc_id for r in op2_quality_rules(ready, SF_SMALL).collect() if r.kept}
    for d in docs:
        w, _, _, _, rep = brute_measures(d["text"])
        assert d["doc_id"] not in kept or not (w < 10 or 100 * rep > 20 * w)
    docs = [d for d in docs if d["doc_id"] in kept]
    groups = brute_groups([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if groups[d["doc_id"]][1] == d["doc_id"]]
    items = [r["text"] for r in rows("benchmark")]
    docs = [d for d in docs if not any(least_edits(t, d["text"]) <= Q.edits(len(t)) for t in items)]
    spans = {r.doc_id: r.spans for r in op10_secret_scans(ready, SF_SMALL).collect()}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d in docs:
        text, at = d["text"], 0
        said = [x.split(":") for x in spans[d["doc_id"]].split(",") if x]
        assert {":".join(x) for x in said if x[0] in S.KINDS[:3]} == {x for x in brute_secrets(text)[3].split(",") if x}
        out = ""
        for _, a, b in said:
            if int(a) >= at:
                out += text[at : int(a)] + "[SECRET]"
            at = max(at, int(b))
        want[d["doc_id"]] = library.encode_ordinary(out + text[at:])
    got = C.run(ready, SF_SMALL).collect()
    assert {r.doc_id: r.token_ids for r in got} == want and len(got) == len(want)
    assert all(r.exact and r.n_tokens == len(r.token_ids) for r in got)


def test_stages_keep_the_columns_and_change_something(ready):
    docs = ready.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = docs
    for name, stage in C.STAGES[:-1]:
        after = stage(ready, before, SF_SMALL)
        assert after.schema.names == docs.schema.names and after.dtypes == docs.dtypes, name
        assert after.exceptAll(before).count() + before.exceptAll(after).count() > 0, name
        before = stored(after, name)


def test_odd_documents(ready, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    body = " ".join(f"word{i}" for i in range(30))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, body, None, "s", 1), (2, body, None, "s", 1), (None, body + " token=abcdefghijklmnop", "en", None, None)]
    docs = ready.createDataFrame(rows, schema)
    for frame, n in ((docs, 3), (docs.limit(0), 0)):
        at = str(tmp_path / str(n))
        frame.write.parquet(f"{at}/documents.parquet")
        ready.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        ready.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = C.run(ready, at).collect()
        assert len(got) == n and all(r.exact for r in got)


def test_null_id_before_a_copy_with_a_near_copy(ready, tmp_path):
    body = " ".join(f"word{i}" for i in range(100))
    rows = [(None, body, "en", "s", 1), (1, body, "en", "s", 1), (2, body + " more", "en", "s", 1)]
    at = str(tmp_path)
    ready.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    ready.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    ready.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert sorted(r.doc_id or 0 for r in C.run(ready, at).collect()) == [0, 1]


def test_columns_named_like_internal_ones(ready):
    docs = ready.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    names = "_m _w _kept _base_failed _spans _base _matches _0 _ids component_id node rule".split()
    odd = docs
    for n in names:
        odd = odd.withColumn(n, odd["doc_id"] * 2)
    plain, odd = stored(docs, "plain"), stored(odd, "odd")
    for name, stage in C.STAGES:
        plain, odd = stored(stage(ready, plain, SF_SMALL), name), stored(stage(ready, odd, SF_SMALL), name)
        if name != C.STAGES[-1][0]:
            assert all(r[n] == r["doc_id"] * 2 for r in odd.collect() for n in names), name
        assert sorted(odd.select(*plain.columns).collect()) == sorted(plain.collect()), name
