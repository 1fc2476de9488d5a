"""C5 parser: the edge rows of FIXTURES.md §4."""

import pytest

R20 = "r" * 20


def wrap(annot: str, reason: str = R20) -> str:
    return f"[REASON]{reason}[/REASON]\n[ANNOT]{annot}[/ANNOT]"


NBSP = " "
CASES = [
    # (response, outcome, act, politeness, meta, nbf)
    (wrap('{"act":"Accept"} tail'), "bad_json", None, None, None, None),
    (wrap('{"act":"Accept"},{"act":"Thank"}'), "bad_json", None, None, None, None),
    (wrap('{"act":"Accept",}'), "bad_json", None, None, None, None),
    (wrap("{'act':'Accept'}"), "bad_json", None, None, None, None),
    (wrap('{act:"Accept"}'), "bad_json", None, None, None, None),
    (wrap('// c\n{"act":"Accept"}'), "bad_json", None, None, None, None),
    (wrap('{"act":"Accept","politeness":01}'), "bad_json", None, None, None, None),
    (wrap('{"act":"Acc\nept"}'), "bad_json", None, None, None, None),
    (wrap(""), "bad_json", None, None, None, None),
    (wrap("[1]"), "bad_json", None, None, None, None),
    (wrap('{"act":"Accept"}] [{"act":"Thank"}'), "bad_json", None, None, None, None),
    (wrap('{"act":"Accept"}]'), "bad_json", None, None, None, None),
    (wrap('{"act":"Accept"}] x'), "bad_json", None, None, None, None),
    (wrap('{"act":"Accept","politeness":"}] {[ \\" ]"}'), "bad_politeness", None, None, None, None),
    (wrap('{"act":"Accept","self/reported":{"a":[1,{"b":"]}"}]}}'), "ok", "Accept", "", "", ""),
    (wrap('"str"'), "bad_json", None, None, None, None),
    # long strings, whose brackets and escapes count for nothing
    (wrap('{"act":"Accept","note":"' + "x" * 50_000 + '"}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","note":"' + r'\n{\"' * 20_000 + '"}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","note":"' + r'\n{\"' * 20_000 + '"}}'), "bad_json", None, None, None, None),
    (wrap("null"), "bad_json", None, None, None, None),
    (wrap('{"act":"Claim","act":"Thank"}'), "ok", "Thank", "", "", ""),
    (wrap("{}"), "bad_act", None, None, None, None),
    (wrap('{"act":null}'), "bad_act", None, None, None, None),
    (wrap('{"act":5}'), "bad_act", None, None, None, None),
    (wrap('{"act":"accept"}'), "bad_act", None, None, None, None),
    (wrap('{"act":"Accept"}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"' + NBSP + "Accept" + NBSP + '"}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","extra":{"a":[1,2]}}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","politeness":0}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","politeness":0.0}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","politeness":[]}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","politeness":{}}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","politeness":false}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","politeness":null}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","politeness":true}'), "bad_politeness", None, None, None, None),
    (wrap('{"act":"Accept","politeness":NaN}'), "bad_politeness", None, None, None, None),
    (wrap('{"act":"Accept","politeness":"NA"}'), "bad_politeness", None, None, None, None),
    (wrap('{"act":"Accept","politeness":"-P[Insult]"}'), "bad_politeness", None, None, None, None),
    (wrap('{"act":"Accept","politeness":"−P"}'), "bad_politeness", None, None, None, None),
    (wrap('{"act":"Accept","politeness":"*P"}'), "bad_politeness", None, None, None, None),
    (wrap('{"act":"Accept","politeness":"–N"}'), "ok", "Accept", "-N", "", ""),
    (wrap('{"act":"Accept","politeness":"—P [Silencer]"}'), "ok", "Accept", "-P [Silencer]", "", ""),
    (wrap('{"act":"Accept","politeness":"+P  x"}'), "ok", "Accept", "+P  x", "", ""),
    (wrap('{"act":"Accept","self/reported":"reported,,non-bona fide , Reported"}'), "ok", "Accept", "", "reported, non-bona fide", ""),
    (wrap('{"act":"Accept","self/reported":["reported"]}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","self/reported":"NA"}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","self/reported":"bogus"}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","non-bona fide":true}'), "ok", "Accept", "", "", "True"),
    (wrap('{"act":"Accept","non-bona fide":"True"}'), "ok", "Accept", "", "", "True"),
    (wrap('{"act":"Accept","non-bona fide":"true"}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","non-bona fide":"Ture"}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept","non-bona fide":false}'), "ok", "Accept", "", "", ""),
    (wrap('{"act":"Accept"}', reason="\U0001F600" * 19), "reason_short", None, None, None, None),
    (wrap('{"act":"Accept"}', reason="\U0001F600" * 20), "ok", "Accept", "", "", ""),
    ('[/REASON] x [REASON]' + "y" * 25 + '[ANNOT]{"act":"Accept"}[/ANNOT]', "ok", "Accept", "", "", ""),
    ("", "reason_short", None, None, None, None),
    ('[REASON]' + R20 + '[/REASON] {"act":"Claim"}', "no_tags", None, None, None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    from threadlens.operators.parse import parse_responses

    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, response string")
    rows = parse_responses(df).orderBy("i").collect()
    return {r["i"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_edge_row(parsed, i):
    resp, outcome, act, pol, meta, nbf = CASES[i]
    r = parsed[i]
    assert r["outcome"] == outcome, resp
    assert r["act"] == act
    assert r["politeness"] == pol
    assert r["meta"] == meta
    assert r["nbf"] == nbf


def test_reason_whole_rest_when_close_tag_before_open(parsed):
    i = next(k for k, c in enumerate(CASES) if c[0].startswith("[/REASON] x"))
    assert parsed[i]["reasoning"].startswith("y" * 25)


def test_strip_matches_python(spark):
    from pyspark.sql import functions as F

    from threadlens.functions.text import py_strip

    samples = [" a ", " b　", "\x1cc\x1f", " d ", "\x85e\t\n", "  ", "", "x​y", "᠎z"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(py_strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]
