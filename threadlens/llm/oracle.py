"""DuckDB statements for the queries that SQL can express on whole tables.

The encodings (op3, op9), learned models (op4, op5), alignments (op8) and linked spans
(op10) are tested against brute-force
versions, the tokenizer library or held-out labels instead.
"""

from __future__ import annotations

from threadlens.llm.host_reputation import LONG_SUFFIXES
from threadlens.llm.queries import GUARD_ID, GUARD_TEXT, URL_RULES
from threadlens.llm.risk_rules import CUTOFFS, RULES, Risk

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = f"""
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT {GUARD_ID}, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{GUARD_TEXT}' FROM range(2) r(i)),
e AS (
 SELECT *, length(role) + length(text) + 15
   + len(regexp_extract_all(role || text, '[<>\\\\]')) AS shown,
  CASE WHEN trim(text, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, ' '), '\\s+')) END AS tokens
 FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
 sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(shown) AS BIGINT) AS formatted_chars, CAST(sum(tokens) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_attachments
FROM e GROUP BY conv_id
"""


def _op2() -> str:
    risk = Risk()
    share = risk.risk / len(RULES)
    pick = " UNION ALL ".join(
        f"SELECT lang, good, '{r}' AS rule, CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END AS v FROM usable" for r, (a, b) in RULES.items()
    )
    over = " OR ".join(
        f"coalesce((CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END) > (SELECT cutoff FROM best WHERE best.lang = m.stratum AND rule = '{r}'), false)"
        for r, (a, b) in RULES.items()
    )
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
 SELECT w.doc_id, w.stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
 FROM w JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
usable AS (SELECT j.stratum AS lang, l.quality = 1 AS good, j.* EXCLUDE (stratum) FROM judged j JOIN labels l USING (doc_id) WHERE NOT base_failed AND l.quality IS NOT NULL),
strata AS (SELECT lang, CAST(count_if(good) AS DOUBLE) AS n FROM usable GROUP BY lang),
vals AS ({pick}),
tests AS (SELECT v.lang, v.rule, c.cutoff, s.n, CAST(count_if(good AND v.v > c.cutoff) AS BIGINT) AS k, CAST(count_if(NOT good AND v.v > c.cutoff) AS BIGINT) AS b
 FROM vals v JOIN strata s USING (lang), (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in CUTOFFS)}]) AS cutoff) c GROUP BY ALL),
certified AS (SELECT * FROM tests WHERE k <= n * {share!r} AND b > k AND
 CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share!r}) + (n - j) * ln(1 - {share!r})))) END
  <= {risk.delta!r} / ((SELECT count(*) FROM strata) * {len(RULES) * len(CUTOFFS)})),
best AS (SELECT lang, rule, cutoff FROM certified QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY b - k DESC, cutoff DESC) = 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM judged m
"""


OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE list_slice(ws, i, i + 4) END AS sh
 FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a) c USING (doc_id)
"""

_STRENGTH = """(SELECT CASE WHEN coalesce(sum(p * (1 - p) * (n - 1)), 0) = 0 THEN 1.0 ELSE
 round(1 / least(greatest((sum((k - n * p) * (k - n * p) / n) - sum(p * (1 - p))) / sum(p * (1 - p) * (n - 1)), 1e-4), 0.5) - 1, 6) END
 FROM {0} WHERE n > 0)"""
_LONG = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
_RULE = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
    for _, r in sorted(URL_RULES, key=lambda x: -len(x[1]))
)
_VERDICT = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in URL_RULES)

OP7 = f"""
WITH p AS (
 SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
counts AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k
 FROM p JOIN known ON doc_id = TRY_CAST(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) GROUP BY host),
h0 AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS l
 FROM (SELECT DISTINCT host FROM p) LEFT JOIN counts USING (host)),
h AS (SELECT host, n, k, CASE WHEN array_to_string(l[-2:], '.') IN ({_LONG}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
  CASE WHEN array_to_string(l[-2:], '.') IN ({_LONG}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h0),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM counts) AS p FROM h GROUP BY suffix),
ps AS (SELECT suffix, (k + m * p) / (n + m) AS ps FROM s, (SELECT {_STRENGTH.format("s")} AS m)),
d AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(ps) AS p FROM h JOIN ps USING (suffix) GROUP BY domain),
pd AS (SELECT domain, (k + m * p) / (n + m) AS pd FROM d, (SELECT {_STRENGTH.format("d")} AS m)),
r AS (SELECT host, n, k, pd AS p FROM h JOIN pd USING (domain)),
ab AS (SELECT host, k + m * p AS a, n - k + m * (1 - p) AS b FROM r, (SELECT {_STRENGTH.format("r")} AS m)),
g AS (SELECT host, a, b, i, (a - 1) * ln((i - 0.5) / 1024) + (b - 1) * ln(1 - (i - 0.5) / 1024) AS v FROM ab, range(1, 1025) t(i)),
w AS (SELECT host, a, b, i, exp(v - max(v) OVER (PARTITION BY host)) AS w FROM g),
c AS (SELECT host, a, b, sum(w) OVER (PARTITION BY host ORDER BY i) AS c, sum(w) OVER (PARTITION BY host) AS total FROM w),
q AS (SELECT host, any_value(a) AS a, any_value(b) AS b, round((count_if(c < 0.05 * total) + 0.5) / 1024, 9) AS bound FROM c GROUP BY host),
f AS (SELECT p.*, CASE {_RULE} END AS rule, q.a, q.b, q.bound FROM p JOIN q USING (host))
SELECT page_id, host, path, rule, coalesce(CASE rule {_VERDICT} END, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
 round(a / (a + b), 9) AS bad_rate, bound AS bad_rate_bound FROM f
"""

# crc32 by its definition: eight shifts a byte, from all ones, inverted at the end
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT))),
 lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""


def _op11() -> str:
    def leaf(n_chars: str) -> str:
        told = [f"coalesce(strlen(v{i}) || ':' || v{i}, '-')" for i in range(5)]
        told[3] = f"coalesce(strlen({n_chars}) || ':' || {n_chars}, '-')"
        return f"sha256({' || '.join(told)})"

    # a level of all groups is made from the one below; what remains of a group stays at its level
    def levels(name: str, start: str) -> str:
        return f"""{name} AS (
 SELECT g, pos, n, 0 AS l, d FROM {start}
 UNION ALL SELECT g, pos // 2, (n + 1) // 2, l + 1, sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, pos // 2, n, l)"""

    return f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS v0, source AS v1, lang AS v2, CAST(n_chars AS VARCHAR) AS v3, text AS v4,
  CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR) AS w3 FROM documents),
leaves AS MATERIALIZED (SELECT doc_id, lang, {leaf("v3")} AS d, CASE WHEN v0 IS NOT NULL AND {_CRC.format("v0")} % 7 = 0 THEN {leaf("w3")} ELSE {leaf("v3")} END AS given FROM s),
p AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS rid, * FROM leaves),
{levels("low", "p")},
sub AS MATERIALIZED (SELECT g, d AS subroot FROM low WHERE n = 1),
q AS MATERIALIZED (SELECT 0 AS g, g - 1 AS pos, count(*) OVER () AS n, subroot AS d FROM sub),
{levels("high", "q")},
top AS MATERIALIZED (SELECT d AS root FROM high WHERE n = 1),
nodes AS MATERIALIZED (SELECT 0 AS part, g, pos, n, l, d FROM low UNION ALL SELECT 1, g, pos, n, l, d FROM high),
steps AS MATERIALIZED (
 SELECT rid, own.part, own.l, here % 2 AS odd, other.d AS sibling
 FROM (SELECT p.rid, 0 AS part, p.g, l.l, l.n, p.pos >> l.l AS here FROM p JOIN (SELECT DISTINCT g, l, n FROM low WHERE n > 1) l USING (g)
  UNION ALL SELECT p.rid, 1, 0, l.l, l.n, (p.g - 1) >> l.l FROM p CROSS JOIN (SELECT DISTINCT l, n FROM high WHERE n > 1) l) own
 LEFT JOIN nodes other ON other.part = own.part AND other.g = own.g AND other.l = own.l AND other.pos = xor(own.here, 1)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY part, l) AS k FROM steps),
fold AS (
 SELECT rid, CAST(0 AS BIGINT) AS k, given AS d FROM p
 UNION ALL SELECT f.rid, f.k + 1, sha256(CASE WHEN s.odd = 1 THEN coalesce(s.sibling, '') || f.d ELSE f.d || coalesce(s.sibling, '') END)
 FROM fold f JOIN numbered s ON s.rid = f.rid AND s.k = f.k + 1),
folded AS (SELECT rid, arg_max(d, k) AS folded_root FROM fold GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY k)) AS proof_sha256 FROM numbered GROUP BY rid)
SELECT doc_id, d AS leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sub USING (g) CROSS JOIN top JOIN folded USING (rid) LEFT JOIN proof USING (rid)
"""


def _op12(k: int = 40, rounds: int = 5) -> str:
    def nearest(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT rid, min({{'d': d, 'c': c}}) AS m FROM (
  SELECT rid, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{i}) GROUP BY rid)"""

    def moved(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.x, o.x) AS x FROM c{i} o LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
   SELECT m.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN v USING (rid) CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY c) w ON w.c = o.c)"""

    ctes = ", ".join(f"{nearest(i)}, {moved(i)}" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
 FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id))) - 1 AS c, x FROM v QUALIFY c < {k}),
{ctes}, {nearest(rounds)},
r AS MATERIALIZED (SELECT rid, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
 CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM r JOIN v USING (rid) JOIN c{rounds} ON c{rounds}.c = r.cluster
"""


ORACLE: dict[str, str] = {
    "op1_chat_formatting": OP1,
    "op2_quality_rules": _op2(),
    "op6_ngram_jaccard": OP6,
    "op7_url_filters": OP7,
    "op11_merkle_manifest": _op11(),
    "op12_centroid_clustering": _op12(),
}
