"""Backward as-of lookup of a daily rate with a tolerance, and related date lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.params import DEFAULT, Params


def rate_by_day(rates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per calendar day that has a rate at most ``asof_days`` old.

    Each rate is valid on its own day and the next ``asof_days`` days; the latest wins. The
    as-of join becomes an equality join on the day. Zero or missing rates are skipped.
    """
    return (
        rates.where(F.col("rate") > 0)
        .select("day", "rate", F.explode(F.sequence("day", F.date_add("day", p.asof_days))).alias("valid_day"))
        .groupBy("valid_day")
        .agg(F.max_by("rate", "day").alias("rate"), F.max("day").alias("rate_day"))
    )


def with_rate(df: DataFrame, rates: DataFrame, when: str | Column, p: Params = DEFAULT) -> DataFrame:
    """Left join of the rate valid on ``when``.

    The rate side is broadcast: it holds at most one row per calendar day, whatever the
    volume of listings (a century is 36 525 rows of three small columns).
    """
    when = F.col(when) if isinstance(when, str) else when
    daily = F.broadcast(rate_by_day(rates, p))
    return df.withColumn("_day", when.cast("date")).join(
        daily, F.col("_day") == daily.valid_day, "left").drop("_day", "valid_day")


def latest_asof(series: DataFrame, on: Column) -> DataFrame:
    """Latest value of each series at or before a date, with the day it comes from."""
    return (
        series.where((F.col("day") <= on) & F.col("value").isNotNull())
        .groupBy("series")
        .agg(F.max_by("value", "day").alias("value"), F.max("day").alias("value_day"),
             F.max_by("source_id", "day").alias("source_id"))
    )
