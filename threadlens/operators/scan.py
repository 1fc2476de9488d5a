"""Chunked running scans: ``lag`` and running ``last(.., ignorenulls)`` over a
group ordered by ``row_idx``, exact for groups of any size.

A plain window puts a whole group in one task; one (thread, user) group may
hold a large share of all rows.  Here each group is cut into chunks of
``row_idx div C`` rows:

1. rows are hash-partitioned on ``(group, chunk)`` and every chunk is scanned
   locally (an ordinary window, in parallel across chunks);
2. a per-chunk summary (one row per group and chunk: the chunk's last value in
   scan order) is aggregated without a further shuffle;
3. a window over the *summary* rows of each group carries values across chunk
   boundaries (the summary has ``rows / C`` rows per group);
4. the carries are joined back on ``(group, chunk)``, which the data is
   already partitioned by.

Groups shorter than a chunk (the common case) have one summary row and no
carry; the plan has the same shape for any input, and AQE drops the empty carry join
at run time.  ``C`` is an argument.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# rows of a group that one task scans; small enough that a running list of them is too
CHUNK_ROWS = 1 << 14
UNB = Window.unboundedPreceding
CUR = Window.currentRow


@dataclass(frozen=True)
class Op:
    """``kind``: ``last`` (running last non-null, current row included),
    ``prev`` (value of the previous row of the group, like ``lag``),
    ``count`` (1-based running row count, like ``row_number``; ``value`` unused) or
    ``two`` (the last non-null value, current row included, and the last one before it that
    differs from it in ``by``: a struct ``first, second``; nulls are passed over)."""

    kind: str
    value: str
    out: str
    reverse: bool = False
    by: str | None = None

    def differ(self, a: Column, b: Column) -> Column:
        """Whether two values are there and differ (in ``by``, for structs)."""
        return (a[self.by] if self.by else a) != (b[self.by] if self.by else b)


def chunked(df: DataFrame, group: list[str], chunk_rows: int | None = None) -> DataFrame:
    """Add ``_chunk`` (``chunk_rows`` rows of the thread each) and hash-partition on
    ``(group, _chunk)``."""
    chunk = F.floor(F.col("row_idx") / F.lit(chunk_rows or CHUNK_ROWS)).cast("long")
    return df.withColumn("_chunk", chunk).repartition(*group, "_chunk")


def _order(reverse: bool, tiebreak: list[str]) -> list[Column]:
    cols = ["row_idx"] + tiebreak
    return [F.col(c).desc() for c in cols] if reverse else [F.col(c) for c in cols]


def _ord_key(tiebreak: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in ["row_idx"] + tiebreak])


def _two(op: Op, w: Window, key: Column, marks: dict, local: dict, summary: list) -> None:
    """What a ``two`` needs of a chunk: marks where the value changes, local results, summary."""
    value, mark = F.col(op.value), F.col(f"_m_{op.out}")
    before = F.last(op.value, ignorenulls=True).over(w.rowsBetween(UNB, -1))
    marks[f"_m_{op.out}"] = F.when(op.differ(before, value), before)
    local[op.out] = F.last(op.value, ignorenulls=True).over(w.rowsBetween(UNB, CUR))
    local[f"{op.out}_2"] = F.last(mark, ignorenulls=True).over(w.rowsBetween(UNB, CUR))
    ends = F.min_by if op.reverse else F.max_by
    summary.append(ends(op.value, F.when(value.isNotNull(), key)).alias(f"_s_{op.out}"))
    summary.append(ends(mark, F.when(mark.isNotNull(), key)).alias(f"_s_{op.out}_2"))


def scan(df: DataFrame, group: list[str], ops: list[Op], tiebreak: list[str] | None = None) -> DataFrame:
    """Apply ``ops`` to ``df`` (already :func:`chunked` on ``group``)."""
    tiebreak = tiebreak or []
    local = {}
    firsts = {}
    marks = {}
    summary = []
    for op in ops:
        w = Window.partitionBy(*group, "_chunk").orderBy(*_order(op.reverse, tiebreak))
        key = _ord_key(tiebreak)
        if op.kind == "last":
            local[op.out] = F.last(op.value, ignorenulls=True).over(w.rowsBetween(UNB, CUR))
            k = F.when(F.col(op.value).isNotNull(), key)
            agg = F.min_by(op.value, k) if op.reverse else F.max_by(op.value, k)
        elif op.kind == "prev":
            local[op.out] = F.lag(op.value).over(w)
            firsts[op.out] = F.row_number().over(w) == 1
            agg = F.min_by(op.value, key) if op.reverse else F.max_by(op.value, key)
        elif op.kind == "count":
            local[op.out] = F.row_number().over(w).cast("long")
            agg = F.count(F.lit(1))
        elif op.kind == "two":
            _two(op, w, key, marks, local, summary)
            continue
        else:
            raise ValueError(op.kind)
        summary.append(agg.alias(f"_s_{op.out}"))

    df = df.withColumns(marks) if marks else df
    cols = {f"_l_{o}": c for o, c in local.items()}
    cols.update({f"_f_{o}": c for o, c in firsts.items()})
    d = df.withColumns(cols)

    summ = df.groupBy(*group, "_chunk").agg(*summary)
    carries = []
    for op in ops:
        wc = Window.partitionBy(*group).orderBy(F.col("_chunk").desc() if op.reverse else F.col("_chunk"))
        s = F.col(f"_s_{op.out}")
        if op.kind == "last":
            carries.append(F.last(s, ignorenulls=True).over(wc.rowsBetween(UNB, -1)).alias(f"_c_{op.out}"))
        elif op.kind == "count":
            carries.append(F.sum(s).over(wc.rowsBetween(UNB, -1)).alias(f"_c_{op.out}"))
        elif op.kind == "two":
            before = F.last(s, ignorenulls=True).over(wc.rowsBetween(UNB, -1))
            # what a chunk leaves as second: its own, or what it found if it holds one value only
            left = F.coalesce(F.col(f"_s_{op.out}_2"), F.when(op.differ(before, s), before))
            summ = summ.withColumn(f"_q_{op.out}", left)
            second = F.last(f"_q_{op.out}", ignorenulls=True).over(wc.rowsBetween(UNB, -1))
            carries.append(F.when(before.isNotNull(), F.struct(before.alias("first"), second.alias("second"))).alias(f"_c_{op.out}"))
        else:
            carries.append(F.lag(s).over(wc).alias(f"_c_{op.out}"))
    carry = summ.select(*group, "_chunk", *carries)
    # only chunks that receive something from earlier chunks; when every group
    # fits in one chunk this is empty and AQE drops the join at run time
    has_carry = F.lit(False)
    for op in ops:
        has_carry = has_carry | F.col(f"_c_{op.out}").isNotNull()
    carry = carry.where(has_carry)
    j = d.join(carry, group + ["_chunk"], "left")

    outs = {}
    for op in ops:
        loc, car = F.col(f"_l_{op.out}"), F.col(f"_c_{op.out}")
        if op.kind == "last":
            outs[op.out] = F.coalesce(loc, car)
        elif op.kind == "count":
            outs[op.out] = loc + F.coalesce(car, F.lit(0)).cast(dict(j.dtypes)[f"_l_{op.out}"])
        elif op.kind == "two":
            one, two = F.col(f"_l_{op.out}"), F.col(f"_l_{op.out}_2")
            changed = F.when(op.differ(car["first"], one), car["first"]).otherwise(car["second"])
            outs[op.out] = F.struct(
                F.coalesce(one, car["first"]).alias("first"),
                F.when(one.isNull(), car["second"]).otherwise(F.coalesce(two, changed)).alias("second"),
            )
        else:
            outs[op.out] = F.when(F.col(f"_f_{op.out}"), car).otherwise(loc)
    tmp = [c for c in j.columns if c.startswith(("_l_", "_f_", "_c_", "_m_"))]
    return j.withColumns(outs).drop(*tmp)


def attach(rows: DataFrame, one: DataFrame, group: list[str], last: str = "last_row") -> DataFrame:
    """``rows`` left-joined with ``one``, a table of one row per group.

    A join on the group alone would bring all rows of a group to one task.  ``one`` says how
    far a group goes (``last``: its largest ``row_idx``), so its row is copied to the chunks that
    the group has, which is one for most groups, and the join is on (group, chunk).
    """
    size = F.lit(CHUNK_ROWS)
    chunks = F.sequence(F.lit(0).cast("long"), F.floor(F.col(last) / size).cast("long"))
    copies = one.withColumn("_chunk", F.explode(chunks)).drop(last)
    at = rows.withColumn("_chunk", F.floor(F.col("row_idx") / size).cast("long"))
    return at.join(copies, [*group, "_chunk"], "left").drop("_chunk")
