"""Exact order statistics for groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. Here a group
may hold a third of all rows, so ranks are found in two steps instead:

1. rows are first counted per (group, value): map-side combine, and a hot group is spread
   over all reducers because the value is part of the shuffle key;
2. counts per (group, value bucket) locate the bucket that holds each wanted rank; only
   the few buckets that hold one are read again and ranked, each as its own partition key.

Buckets are a monotone logarithmic map, fine enough (0.02 %) that one holds few distinct values of
ordinary data, and their number per group is bounded by the range of the values, whatever the row
count is. Where values may crowd closer than that, ``most`` splits every bucket that holds a wanted
rank again, between its own least and greatest value, until none holds more distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.session import cut

_EPS = 1e-3
_FINE, _COARSE = 4096.0, 16.0  # buckets per e-fold: 0.02 % and 6 % wide
_PARTS = 4096  # of a bucket that is split again


def value_bucket(v: Column, resolution: float = _FINE) -> Column:
    return F.floor(F.signum(v) * F.ln(F.lit(1.0) + F.abs(v) / _EPS) * resolution).cast("int")


def upper_median() -> tuple:
    """Spec of the element at position floor(n/2) of the sorted values (no averaging)."""
    return ("upper", 0.5)


def _ranks(spec, total: Column):
    """(low rank, high rank, fraction), zero-based, of a quantile spec."""
    if isinstance(spec, tuple):
        r = F.floor(total / 2)
        return r, r, F.lit(0.0)
    pos = (total - 1) * F.lit(float(spec))
    lo = F.floor(pos)
    return lo, F.ceil(pos), pos - lo


def _holds(specs: dict, total: Column, before: Column, upto: Column) -> Column:
    """Does a run of rows from ``before`` to below ``upto`` hold a wanted rank?"""
    wanted = [r for spec in specs.values() for r in _ranks(spec, total)[:2]]
    return reduce(lambda a, b: a | b, [(r >= before) & (r < upto) for r in wanted])


def _pick(hist: DataFrame, keys: list[str], specs: dict) -> DataFrame:
    """Buckets that hold a wanted rank, with the count before them and the group total."""
    part = Window.partitionBy(*keys)
    h = (
        hist.withColumn("_cum", F.sum("_n").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(part))
        .withColumn("_before", F.col("_cum") - F.col("_n"))
    )
    more = [c for c in ("_d", "_low", "_high") if c in hist.columns]
    return h.where(_holds(specs, F.col("_total"), F.col("_before"), F.col("_cum"))).select(*keys, "_b", "_before", "_total", *more)


def _finish(rows: DataFrame, keys: list[str], specs: dict) -> DataFrame:
    """rows: keys, _b, _before, _total, _v, _n for the needed buckets only."""
    w = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_n").over(w)).withColumn(
        "_start", F.col("_end") - F.col("_n"))
    aggs = [F.max("_total").alias("n_values")]
    for name, spec in specs.items():
        lo, hi, _ = _ranks(spec, F.col("_total"))
        at = lambda r: F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), F.col("_v")))
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}")]
    out = rows.groupBy(*keys).agg(*aggs)
    cols = []
    for name, spec in specs.items():
        _, _, frac = _ranks(spec, F.col("n_values"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return out.select(*keys, *cols, "n_values")


def _crowded(rows: DataFrame, most: int) -> DataFrame:
    return rows.where((F.col("_d") > most) & (F.col("_low") < F.col("_high")))


def _split(rows: DataFrame, keys: list[str], specs: dict) -> DataFrame:
    """Rows of crowded buckets (keys, _b, _before, _total, _v, _n, _low, _high), cut down to the parts of them that hold a wanted rank."""
    part = F.least(F.lit(_PARTS - 1), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * _PARTS)).cast("int")
    rows = rows.withColumn("_part", part).select(*keys, "_b", "_before", "_total", "_v", "_n", "_part")
    path = [*keys, "_b"]
    hist = rows.groupBy(*path, "_before", "_total", "_part").agg(F.sum("_n").alias("_k"), F.count("*").alias("_d"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    upto = F.sum("_k").over(Window.partitionBy(*path).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    hist = hist.withColumn("_end", F.col("_before") + upto).withColumn("_before", F.col("_end") - F.col("_k"))
    need = hist.where(_holds(specs, F.col("_total"), F.col("_before"), F.col("_end"))).select(*path, "_part", "_before", "_d", "_low", "_high")
    cond = [F.col(f"r.{k}").eqNullSafe(F.col(f"q.{k}")) for k in [*path, "_part"]]
    out = rows.alias("r").join(need.alias("q"), cond)
    return out.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.xxhash64("r._b", "r._part").alias("_b"), "q._before", "r._total", "r._v", "r._n", "q._d", "q._low", "q._high")


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column, specs: dict, weight: Column | None = None, most: int | None = None) -> DataFrame:
    """One row per group with every spec of ``specs`` ({name: probability or upper_median()}).

    NULL values are left out; groups without any value do not appear. ``n_values`` is the
    number of values counted. With ``most`` no task ranks more than so many distinct values of a
    group, however close they lie; each round of splitting writes the rows that are left.
    """
    w = F.lit(1) if weight is None else weight
    freq = (
        df.select(*keys, value.cast("double").alias("_v"), w.cast("bigint").alias("_w"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    if most is not None:
        freq = cut(freq)
    hist = freq.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    need = _pick(hist, keys, specs)
    cond = [F.col(f"f.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys] + [F.col("f._b") == F.col("q._b")]
    rows = freq.alias("f").join(need.alias("q"), cond).select(
        *[F.col(f"f.{k}").alias(k) for k in keys], F.col("f._b").cast("bigint").alias("_b"),
        "q._before", "q._total", "f._v", "f._n", "q._d", "q._low", "q._high")
    if most is not None:
        rows = cut(rows)
        while not _crowded(rows, most).isEmpty():
            few = rows.where((F.col("_d") <= most) | (F.col("_low") >= F.col("_high")))
            rows = cut(few.unionByName(_split(_crowded(rows, most), keys, specs)))
    return _finish(rows, keys, specs)
