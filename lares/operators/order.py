"""Positions in a total order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.session import cut


def numbered(df: DataFrame, order: list[Column], group: list[str] | tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """Adds the position (from 1) of every row in its group.

    Rows are dealt by ranges of (group, order), which ends with a unique column, and sorted
    inside a task; a row's number there plus the rows of its group in the tasks before is its
    position. So any number of equal scores spread over tasks, and what meets in one place is
    one count per task and group.
    """
    keys = [F.col(g) for g in group]
    rows = cut(cut(df).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = rows.groupBy(*group, "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cond = [F.col("r._p") == F.col("q._p"), *[F.col(f"r.{g}").eqNullSafe(F.col(f"q.{g}")) for g in group]]
    out = rows.alias("r").join(parts.alias("q"), cond)
    return out.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._i") - F.col("q._first") + F.col("q._before") + 1).alias(name))
