"""Parse and validate model responses, as plain column expressions.

Rules, in order; the first failing one is the row's ``outcome``:
``reason_short`` -> ``no_tags`` -> ``bad_json`` -> ``bad_act`` -> ``bad_politeness``;
otherwise ``ok``.  Meta tags and the non-bona-fide flag never fail, they only drop
unknown values.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ALLOWED_ACTS,
    ALLOWED_META,
    ALLOWED_NON_BONA_FIDE,
    ALLOWED_POLITENESS,
    ANNOT_CLOSE,
    ANNOT_OPEN,
    KEY_ACT,
    KEY_META,
    KEY_NBF,
    KEY_POLITENESS,
    MIN_REASON_CHARS,
    REASON_CLOSE,
    REASON_OPEN,
)
from ..functions.json import parse_json_object, variant_string, variant_text
from ..functions.text import between_tags, clean_tag_list, first_token, normalise_dashes, py_strip, rejected_tags

PARSE_COLUMNS = ["outcome", "act", "politeness", "meta", "nbf", "reasoning"]


def reasoning_of(response: Column) -> Column:
    """X2 on the reason block; '' when either tag is missing."""
    return F.coalesce(between_tags(response, REASON_OPEN, REASON_CLOSE), F.lit(""))


def politeness_code(v: Column) -> Column:
    """Dash-normalised, stripped politeness text ('' when falsy)."""
    return py_strip(normalise_dashes(variant_text(v)))


def politeness_ok(pol: Column) -> Column:
    """Blank, or the first space-separated token is one of the four codes."""
    return (pol == "") | first_token(pol).isin(ALLOWED_POLITENESS)


def parse_responses(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Add ``outcome, act, politeness, meta, nbf, reasoning`` (+ ``rejected_meta``).

    ``act``..``nbf`` are set only when ``outcome = 'ok'``; ``reasoning`` always.
    A null response (the call failed) gives null outcome: the caller decides.
    """
    for columns in _steps(df.sparkSession.sparkContext.applicationId, response_col):
        df = df.withColumns(columns)
    return df.drop("_j")


@lru_cache(maxsize=8)
def _steps(app: str, response_col: str) -> list[dict[str, Column]]:
    """The columns that :func:`parse_responses` adds, step by step.

    They are the same for every table, and making these expressions takes the driver longer than a small round takes
    to run, so they are made once per application.
    """
    r = F.col(response_col)
    read = {"reasoning": reasoning_of(r), "_j": parse_json_object(between_tags(r, ANNOT_OPEN, ANNOT_CLOSE))}
    act = py_strip(variant_string(F.col(f"_j.`{KEY_ACT}`")))
    pol = politeness_code(F.col(f"_j.`{KEY_POLITENESS}`"))
    meta_raw = py_strip(variant_text(F.col(f"_j.`{KEY_META}`")))
    nbf_raw = py_strip(variant_text(F.col(f"_j.`{KEY_NBF}`")))
    outcome = (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(F.char_length("reasoning") < MIN_REASON_CHARS, F.lit("reason_short"))
        .when(~(r.contains(ANNOT_OPEN) & r.contains(ANNOT_CLOSE)), F.lit("no_tags"))
        .when(F.col("_j").isNull(), F.lit("bad_json"))
        .when(~F.coalesce(act.isin(ALLOWED_ACTS), F.lit(False)), F.lit("bad_act"))
        .when(~politeness_ok(pol), F.lit("bad_politeness"))
        .otherwise(F.lit("ok"))
    )
    ok = F.col("outcome") == "ok"
    fields = {
        "act": F.when(ok, act),
        "politeness": F.when(ok, pol),
        "meta": F.when(ok, clean_tag_list(meta_raw, ALLOWED_META)),
        "nbf": F.when(ok, clean_tag_list(nbf_raw, ALLOWED_NON_BONA_FIDE)),
        "rejected_meta": F.when(ok, F.concat(rejected_tags(meta_raw, ALLOWED_META), rejected_tags(nbf_raw, ALLOWED_NON_BONA_FIDE))),
    }
    return [read, {"outcome": outcome}, fields]
