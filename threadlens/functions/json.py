"""JSON column expressions: strict object parsing, Python-style falsiness,
prompt serialisation (X11-X14)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import KEY_ACT, KEY_META, KEY_NBF, KEY_POLITENESS

ANNOTATION_FIELDS = [KEY_ACT, KEY_POLITENESS, KEY_META, KEY_NBF]
_ANNOT_SCHEMA = "array<struct<" + ", ".join(f"`{k}`: variant" for k in ANNOTATION_FIELDS) + ">>"


def parse_json_object(c: Column) -> Column:
    """Strict JSON object -> ``struct<act, politeness, self/reported,
    non-bona fide: variant>``, or null when the text is not exactly one object.

    Wrapping in ``[...]`` makes trailing text, a second object, or a non-object
    value fail the array-of-struct schema; single quotes are switched off; the
    last duplicate key wins; value types are kept (JSON ``true`` vs ``"true"``).
    """
    read = lambda t: F.from_json(F.concat(F.lit("["), t, F.lit("]")), _ANNOT_SCHEMA, {"allowSingleQuotes": "false"})
    one = lambda arr: F.when((F.size(arr) == 1) & F.get(arr, 0).isNotNull() & ends_with_first_value(c), F.get(arr, 0))
    return once(read(c), one)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` names it.

    Spark shares what is always evaluated, but not what conditions may skip.
    """
    return F.get(F.transform(F.array(c), use), 0)


def objects(df: DataFrame, c: Column, name: str) -> DataFrame:
    """The rows whose text is exactly one JSON object (:func:`parse_json_object`), with it as ``name``.

    Exploding an array of one or none parses each text once; a filter on the
    object would be pushed down to where it has to be parsed a second time.
    """
    return df.select("*", F.explode(F.array_compact(F.array(parse_json_object(c)))).alias(name))


def ends_with_first_value(c: Column) -> Column:
    """True when nothing follows the first top-level JSON value of ``c``.

    The reader stops at the bracket that closes the wrapping array, so text
    such as ``{..}] [..`` would otherwise pass.  Escapes, then string literals are
    taken out and what stands between brackets becomes one sign, all by patterns that
    scan without recursion; then the bracket depth, a running sum over what is left (a few
    signs an object, however long its strings), may reach zero only at the last one.
    """
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)\\.", ""), r'"[^"]*"', "x")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]{}]+", "x"), "")

    def step(acc, ch):
        delta = F.when(ch.isin("{", "["), F.lit(1)).when(ch.isin("}", "]"), F.lit(-1)).otherwise(F.lit(0))
        depth = acc["d"] + delta
        return F.struct(
            depth.alias("d"),
            (acc["closed"] | ((depth == 0) & (delta == -1))).alias("closed"),
            (acc["bad"] | acc["closed"] | (depth < 0)).alias("bad"),
        )

    init = F.struct(F.lit(0).alias("d"), F.lit(False).alias("closed"), F.lit(False).alias("bad"))
    return ~F.aggregate(signs, init, step)["bad"]


def variant_text(v: Column) -> Column:
    """X11: a JSON value as Python's ``str(value or "")`` would show it, for the
    cases that matter: strings as-is, ``true`` -> ``'True'``, falsy values
    (missing, null, false, 0, 0.0, [], {}) -> ``''``; anything else -> its JSON
    text (which is never a valid label).

    The value is rendered to JSON once and classified by its text; only JSON
    strings are decoded (escapes) with ``variant_get``.
    """
    return once(F.to_json(v), lambda js: json_text_value(js, v))


def json_text_value(js: Column, v: Column) -> Column:
    """:func:`variant_text` given ``js = to_json(v)`` (compute it once)."""
    return (
        F.when(js.isNull() | (js == "null") | (js == "false") | js.isin("[]", "{}"), F.lit(""))
        .when(F.startswith(js, F.lit('"')), F.variant_get(v, "$", "string"))
        .when(js == "true", F.lit("True"))
        .when(js.try_cast("double") == 0, F.lit(""))
        .otherwise(js)
    )


def variant_string(v: Column) -> Column:
    """The value when it is a JSON string, else null."""
    return F.when(F.startswith(F.to_json(v), F.lit('"')), F.variant_get(v, "$", "string"))


def json_string(c: Column) -> Column:
    """A string as a JSON string literal (quotes, escapes; non-ASCII kept).

    The array's brackets are cut off as bytes: a substring of text counts its characters one by one.
    """
    arr = F.to_json(F.array(c)).cast("binary")
    return F.substr(arr, F.lit(2), F.octet_length(arr) - F.lit(2)).cast("string")


def prompt_json(system: Column, user: Column) -> Column:
    """The two chat messages serialised like ``json.dumps(messages,
    ensure_ascii=False)``: ``[{"role": "system", "content": ...}, {...}]``."""
    return F.concat(
        F.lit('[{"role": "system", "content": '),
        json_string(system),
        F.lit('}, {"role": "user", "content": '),
        json_string(user),
        F.lit("}]"),
    )


def first_text_part(candidates: Column) -> Column:
    """First non-empty ``candidates[].content.parts[].text``, stripped, else ''.

    ``candidates``: ``array<struct<content: struct<parts: array<struct<text: string>>>>>``.
    """
    from .text import py_strip

    texts = F.flatten(F.transform(candidates, lambda c: F.transform(c["content"]["parts"], lambda p: p["text"])))
    first = F.get(F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != ""), 0)
    return F.coalesce(py_strip(first), F.lit(""))
