"""URL filters: hosts, paths and rules against plain Python; shrinkage by hand."""

import re

from conftest import SF_SMALL
from threadlens.llm import host_reputation as H
from threadlens.llm.queries import URL_RULES, op7_url_filters


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = []
    for verdict, r in URL_RULES:
        name, rest = r.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(r), r, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_whole_table(ready, rows):
    got = {r.page_id: r for r in op7_url_filters(ready, SF_SMALL).collect()}
    pages = rows("pages")
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        assert (r.host, r.path) == parts(p["url"])
        want = rule(r.host, r.path)
        assert r.rule == want[0]
        assert r.verdict == want[1] if want[0] else r.verdict in ("allow", "block")


def test_odd_urls(ready):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net/x", "http://x.net", "http://net/", "http://é.ORG/fr/?q", "a\nb://h\n.org/fr/x#y",
            "http://x://y/z", "http://h?p=/a", "http://example.com/de/x", "http://xexample.com/de/x", "http://u@a.co.uk:80/fr/"]
    df = ready.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = ready.createDataFrame([], "host string, bad int")
    got = {r.page_id: r for r in H.judge_urls(df, out, URL_RULES).collect()}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path) == parts(u), u
        want = rule(*parts(u))
        assert (got[i].rule, got[i].verdict) == (want[0], want[1] or "allow"), u
    assert H.judge_urls(df.limit(0), out, URL_RULES).count() == 0
    # equal urls are judged row by row
    assert H.judge_urls(df.union(df), out, URL_RULES).count() == 2 * len(urls)


def test_shrinkage_orders_hosts(ready):
    rows = [("bad.a.com", 1)] * 200 + [("good.a.com", 0)] * 200 + [("few.a.com", 1)] * 2 + [("x.b.org", 0)] * 100 + [("y.c.org", 1)] * 80 + [("y.c.org", 0)] * 20
    out = ready.createDataFrame(rows, "host string, bad int")
    hosts = ready.createDataFrame([(h,) for h in {r[0] for r in rows} | {"new.a.com", "new.zzz"}], "host string")
    got = {r.host: r for r in H.reputation(hosts, out).collect()}
    assert got["bad.a.com"].bound > 0.9 > 0.1 > got["good.a.com"].mean
    assert got["few.a.com"].mean > got["new.a.com"].mean  # two bad pages move it, but
    assert got["few.a.com"].bound < 0.5  # not past the bound
    assert 0.5 < got["y.c.org"].bound < 0.8 and got["new.zzz"].n_outcomes == 0
    pages = ready.createDataFrame([(1, "http://bad.a.com/q"), (2, "http://few.a.com/q"), (3, "http://BAD.a.com/q")], "page_id long, url string")
    v = {r.page_id: r.verdict for r in H.judge_urls(pages, out, URL_RULES).collect()}
    assert v == {1: "block", 2: "allow", 3: "block"}


def test_registered_domains(ready):
    df = ready.createDataFrame([("a.b.co.uk",), ("b.example.com:80",), ("u@b.example.com",), ("localhost",), ("",)], "h string")
    got = df.select(H.domain_of(df.h).alias("d"), H.suffix_of(df.h).alias("s")).collect()
    assert [(r.d, r.s) for r in got] == [("b.co.uk", "co.uk"), ("example.com", "com"), ("example.com", "com"), ("localhost", "localhost"), ("", "")]
