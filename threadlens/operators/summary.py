"""Run summary and debug sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEBUG_ROWS, STATUS_FAILED, STATUS_FLAGGED


def run_summary(resolved: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A5: annotated / failed / flagged counts and success % (1 decimal).

    One aggregate (map-side partial counts).  The percentage is null for an
    empty group instead of dividing by zero.
    """
    act = F.col("annotation_act")
    aggs = [
        F.count_if(~act.isin(STATUS_FAILED, STATUS_FLAGGED)).alias("annotated"),
        F.count_if(act == STATUS_FAILED).alias("failed"),
        F.count_if(act == STATUS_FLAGGED).alias("flagged"),
        F.count(F.lit(1)).alias("total"),
    ]
    g = resolved.groupBy(*by).agg(*aggs) if by else resolved.agg(*aggs)
    return g.withColumn(
        "success_pct",
        F.bround(F.col("annotated") * 100.0 / F.nullif(F.col("total"), F.lit(0)), 1),
    )


def debug_sample(pending: DataFrame, n: int = DEBUG_ROWS) -> DataFrame:
    """The first ``n`` pending rows in (corpus, thread, row) order.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n and only those reach the final merge.
    """
    return pending.orderBy("corpus", "thread_id", "row_idx").limit(n)
