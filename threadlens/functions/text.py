"""Text column expressions (all JVM-side, inside whole-stage codegen).

Each function takes and returns a ``Column``; none is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import POLICY_WORDS

# Characters Python's ``str.strip()`` removes that Java's Unicode ``\s`` does not:
# the information separators U+001C..U+001F.  U+0085 is listed explicitly as well.
_WS = r"[\s\x{1c}-\x{1f}\x{85}]"
_STRIP_RE = rf"(?U)\A{_WS}+|{_WS}+\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Unicode whitespace strip with Python ``str.strip()`` semantics.

    ``trim()`` only removes ASCII spaces; plain ``\\s`` misses no-break and
    ideographic spaces.  Null stays null.
    """
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def text_or_blank(c) -> Column:
    """A text cell rendered into a prompt: stripped, null rendered as ''."""
    return py_strip(F.coalesce(_col(c), F.lit("")))


def between_tags(c, open_tag: str, close_tag: str) -> Column:
    """Text after the first ``open_tag`` up to the next ``close_tag``, stripped.

    Both tags must occur somewhere (in any order); otherwise null.  When the
    close tag only occurs before the open tag the rest of the text is taken.
    """
    t = _col(c)
    after = F.substr(t, F.instr(t, open_tag) + F.lit(len(open_tag)))
    inner = F.substring_index(after, close_tag, 1)
    return F.when(t.contains(open_tag) & t.contains(close_tag), py_strip(inner))


def normalise_dashes(c) -> Column:
    """En dash and em dash to hyphen-minus (U+2212 is left alone)."""
    return F.translate(_col(c), "–—", "--")


def first_token(c) -> Column:
    """The part before the first space (the whole string when there is none)."""
    return F.split_part(_col(c), F.lit(" "), F.lit(1))


def clean_tag_list(c, allowed: list[str]) -> Column:
    """Split on ',', strip, drop blanks, keep allowed tags (case-sensitive), join ', '."""
    parts = F.transform(F.split(_col(c), ","), py_strip)
    kept = F.filter(parts, lambda x: (x != "") & x.isin(allowed))
    return F.array_join(kept, ", ")


def rejected_tags(c, allowed: list[str]) -> Column:
    """The tags :func:`clean_tag_list` drops (non-blank, not allowed)."""
    parts = F.transform(F.split(_col(c), ","), py_strip)
    return F.filter(parts, lambda x: (x != "") & ~x.isin(allowed))


def is_policy_error(c) -> Column:
    """An error message that names a content policy or safety refusal."""
    low = F.lower(_col(c))
    cond = None
    for w in POLICY_WORDS:
        cond = low.contains(w) if cond is None else cond | low.contains(w)
    return F.coalesce(cond, F.lit(False))


def ordered_concat(items: Column, sep: str = " ") -> Column:
    """Join the ``s`` fields of an array of ``struct(<order>, s)`` in order.

    ``items`` is typically ``collect_list(struct(row_idx, s))``: array_sort orders
    by the struct's first field, so the result is in row order no matter how the
    partial aggregates were merged.
    """
    return F.array_join(F.transform(F.array_sort(items), lambda e: e["s"]), sep)
