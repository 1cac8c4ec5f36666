"""An extractor's self-test from figures that are gathered while its rows are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lares.session import cut

_FINDING = "check string, severity string, affected long"


def written_and_observed(rows: DataFrame, required: list[str], ranges: dict[str, tuple[float, float]], previous: int | None = None, coverage: float = 0.95, drop: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """(the rows, written; the findings): required fields, plausible ranges and a stable count.

    The figures come with the write itself, so nothing is scanned twice. A source that gave no row
    at all fails its required fields. ``previous`` is the count of the last successful run.
    """
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    odd = F.lit(False)
    for c, (lo, hi) in ranges.items():
        odd = odd | F.coalesce(~F.col(c).between(lo, hi), F.lit(False))
    seen = Observation()
    out = cut(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("whole"), F.count_if(odd).alias("odd")))
    n, n_whole, n_odd = (seen.get[k] for k in ("n", "whole", "odd"))
    lost = max(0, previous - n) if previous else 0
    findings = [
        ("required_fields", "OK" if n and n_whole >= coverage * n else "FAIL", n - n_whole),
        ("plausible_ranges", "FAIL" if n_odd else "OK", n_odd),
        ("stable_count", "FAIL" if previous and lost > drop * previous else "OK", lost),
    ]
    return out, rows.sparkSession.createDataFrame(findings, _FINDING)


def duplicates_finding(rows: DataFrame, key: list[str], pairs: DataFrame) -> DataFrame:
    """MARK with the pairs of near duplicates; a table in which no row has the whole key can't be judged, and says so."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    j = rows.agg(F.count("*").alias("n"), F.count_if(whole).alias("can")).crossJoin(F.broadcast(pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))))  # one row each
    blind = (F.col("n") > 0) & (F.col("can") == 0)
    name = F.when(blind, "duplicates: not evaluable").otherwise("duplicates")
    return j.select(name.alias("check"), F.when(blind | (F.col("pairs") > 0), "MARK").otherwise("OK").alias("severity"), F.when(blind, F.col("n")).otherwise(F.col("pairs")).cast("long").alias("affected"))
