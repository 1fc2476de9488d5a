"""Secret scans with multipart credential linking.

Strong findings (assigned secrets, access key ids, long hex runs) are always reported.
Weak candidates - account names, opaque tokens, endpoints - are common in clean text,
so each is reported only where complementary parts co-occur in its scope, an interval
of ``scope`` code points on either side: an account name near a secret, an opaque token
near an identifier or endpoint, an endpoint near both an identifier and a secret.
The intervals are joined by a sweep over the parts of a document in order of their
starts: forward it carries how far the identifiers, secrets and endpoints before a part reach, backward where the
next ones start, which is all that the join asks for.

Spans are exact: matches are found by one pattern pass, and their places by the
lengths of what lies between them; code points, end exclusive.  Sweeps run in pieces of ``PIECE``
elements, so that what they gather is not copied for every element.

Plan: array functions inside each row, no shuffle, no Python.  The weak patterns run
only in documents with a part that could complete them.

Defined cases: null or empty text: no spans; repeated rows: each on its own; spans with
equal starts: in the order of KINDS; weak candidates that overlap a strong finding are
part of it and not reported; extra columns are kept (names that begin with ``_``: see
``clear_names``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import clear_names

# fixed patterns; the kinds in the order in which equal starts are listed
ASSIGN = (
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ACCOUNT = (
    r"(?:[uU][sS][eE][rR](?:_?(?:[nN][aA][mM][eE]|[iI][dD]))?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]"
    r"|[aA][cC][cC][oO][uU][nN][tT])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"
)
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>/?#]{3,}"
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
MIN_SECRET = 12
SPAN = "array<struct<start:int,rank:int,end:int>>"
PIECE = 128
NEVER = 1 << 30
IDS, SECRETS, ENDPOINTS = (1, 3), (0, 2, 4), (5,)  # places in KINDS


def _none() -> Column:
    return F.array().cast(SPAN)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _pieces(xs: Column) -> Column:
    """``xs`` in arrays of ``PIECE`` elements, the last one shorter."""
    last = F.floor((F.size(xs) - 1) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(xs, k * PIECE + 1, PIECE))


def _sweep(xs: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The outputs, of type ``kind``, of ``step(carry, x) -> (carry, output)`` along ``xs``."""
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        after, out = step(a["c"], x)
        return F.struct(after.alias("c"), F.concat(a["o"], F.array(out)).alias("o"))

    def piece(a: Column, part: Column) -> Column:
        start = F.struct(a["now"]["c"].alias("c"), none.alias("o"))
        return F.struct(F.aggregate(part, start, one).alias("now"), F.concat(a["all"], F.array(a["now"]["o"])).alias("all"))

    def whole(v: Column) -> Column:
        start = F.struct(F.struct(carry.alias("c"), none.alias("o")).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("all"))
        return F.aggregate(_pieces(v), start, piece, lambda a: F.flatten(F.concat(a["all"], F.array(a["now"]["o"]))))

    return _let(xs, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def _found(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches, failing ``keep`` left out."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = keep or (lambda hit: F.lit(True))
    # lengths only, so that the sweep carries no texts
    none = F.array().cast("array<struct<gap:int,hit:int,good:boolean>>")
    sizes = _let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(h)), h,
        lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("hit"), good(x).alias("good")),
    )))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        return begin + x["hit"], F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["hit"]).alias("end"), x["good"].alias("good")
        )

    spans = _sweep(sizes, F.lit(0), step, "struct<start:int,rank:int,end:int,good:boolean>")
    return F.transform(F.filter(spans, lambda s: s["good"]), lambda s: F.struct(s["start"], s["rank"], s["end"])).cast(SPAN)


def _long_value(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, "^" + ASSIGN + "$", 2)) >= MIN_SECRET


def _among(events: Column, groups: dict[str, tuple[int, ...]]) -> Column:
    """``events`` (spans) by start, each with ``before``, the farthest end of each group's events
    that come earlier, and ``after``, the first start of those that come later."""
    names = list(groups)
    kind = ",".join(f"{n}:int" for n in names)

    def step(side: str, best, far: int):
        def run(c: Column, x: Column) -> tuple[Column, Column]:
            mine = "end" if side == "before" else "start"
            carry = F.struct(*[
                F.when(x["rank"].isin(*groups[n]), best(c[n], x[mine])).otherwise(c[n]).alias(n) for n in names
            ])
            kept = ["start", "rank", "end"] + (["before"] if side == "after" else [])
            return carry, F.struct(*[x[k].alias(k) for k in kept], c.alias(side))

        return F.struct(*[F.lit(far).alias(n) for n in names]), run

    base = "start:int,rank:int,end:int"
    forward = _sweep(F.array_sort(events), *step("before", F.greatest, -NEVER), f"struct<{base},before:struct<{kind}>>")
    backward = _sweep(
        F.reverse(forward), *step("after", lambda c, x: x, NEVER), f"struct<{base},before:struct<{kind}>,after:struct<{kind}>>"
    )
    return F.reverse(backward)


def _spans(events: Column) -> Column:
    return F.transform(events, lambda s: F.struct(s["start"], s["rank"], s["end"])).cast(SPAN)


def _apart(spans: Column, rank: int, strong: Column) -> Column:
    """``spans``, all of one rank, that overlap none of ``strong``."""
    others = tuple(r for r in range(len(KINDS)) if r != rank)

    def free(spans: Column) -> Column:
        kept = F.filter(
            _among(F.concat(spans, strong), {"other": others}),
            lambda s: (s["rank"] == rank) & (s["before"]["other"] <= s["start"]) & (s["after"]["other"] >= s["end"]),
        )
        return F.when((F.size(spans) == 0) | (F.size(strong) == 0), spans).otherwise(_spans(kept))

    return _let(spans, free)


def _linked(events: Column, scope: int) -> Column:
    """The strong spans, and the weak ones with their complement at most ``scope`` code points away."""

    def near(s: Column, group: str) -> Column:
        return (s["before"][group] + scope >= s["start"]) | (s["after"][group] <= s["end"] + scope)

    def good(s: Column) -> Column:
        ids, secrets, endpoints = (near(s, g) for g in ("ids", "secrets", "endpoints"))
        return (
            F.when(s["rank"] == 3, secrets).when(s["rank"] == 4, ids | endpoints).when(s["rank"] == 5, ids & secrets)
            .otherwise(F.lit(True))
        )

    return _spans(F.filter(_among(events, {"ids": IDS, "secrets": SECRETS, "endpoints": ENDPOINTS}), good))


@clear_names
def find_secrets(docs: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """``docs`` plus ``_base`` (strong spans), ``_spans`` (all reported spans, by start,
    then kind; each start, rank in KINDS, end) and the three strong counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_assign", _found(t, ASSIGN, 0, _long_value))
    df = df.withColumn("_access", F.when(t.contains("AKIA"), _found(t, ACCESS, 1)).otherwise(_none()))
    df = df.withColumn("_hex", _found(t, HEX, 2))
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    df = df.withColumn("_endpoint", F.when(t.contains("://"), _apart(_found(t, ENDPOINT, 5), 5, F.col("_base"))).otherwise(_none()))
    df = df.withColumn("_account", _apart(_found(t, ACCOUNT, 3), 3, F.col("_base")))
    # an opaque token needs an identifier or endpoint somewhere in the document
    partner = (F.size("_access") > 0) | (F.size("_account") > 0) | (F.size("_endpoint") > 0)
    df = df.withColumn(
        "_opaque", F.when(partner, _apart(_found(t, OPAQUE, 4), 4, F.concat("_base", "_endpoint", "_account"))).otherwise(_none())
    )
    return df.select(
        *docs.columns,
        F.size("_assign").cast("long").alias("_n_assign"),
        F.size("_access").cast("long").alias("_n_access"),
        F.size("_hex").cast("long").alias("_n_hex"),
        "_base",
        F.when(F.size("_account") + F.size("_opaque") + F.size("_endpoint") > 0, _linked(F.concat("_base", "_account", "_opaque", "_endpoint"), scope))
        .otherwise(F.col("_base"))
        .alias("_spans"),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans become one mark."""
    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.struct(at.alias("start"), s["start"].alias("end"))

    def cut(gaps: Column) -> Column:
        """The texts of some gaps, cut from the stretch that they are in."""
        begin, end = gaps[0]["start"], F.get(gaps, F.size(gaps) - 1)["end"]
        return _let(F.substr(text, begin + 1, end - begin), lambda near: F.transform(
            gaps, lambda g: F.substr(near, g["start"] - begin + 1, g["end"] - g["start"])
        ))

    # a span that starts inside an earlier one leaves no gap
    gaps = F.filter(_sweep(spans, F.lit(0), step, "struct<start:int,end:int>"), lambda g: g["end"] >= g["start"])
    kept = F.concat_ws(mark, F.flatten(_let(gaps, lambda g: F.transform(_pieces(g), cut))))
    rest = F.substr(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(kept, F.lit(mark), rest)).otherwise(text)
