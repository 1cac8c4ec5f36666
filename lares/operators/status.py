"""State of what was collected: series, last runs, cells that serve nobody, gain of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.operators.match import with_scope

#: Month names of a sheet's heading.
MONTHS = {m: i for i, m in enumerate(("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"), 1)}


def series_status(rates: DataFrame) -> DataFrame:
    """n, first, last day of the days with a value; one row, also when there is none."""
    return rates.where("rate is not null").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def last_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` latest runs of each source. Spark cuts each map output to ``k`` rows before it shuffles."""
    w = Window.partitionBy("source_id").orderBy(F.desc("ended"))
    return runs.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)


def cells_for_nobody(cells: DataFrame, scope: DataFrame, excluded: DataFrame, saturated: DataFrame) -> DataFrame:
    """reason, cells, listings: sufficient cells (with ``district``) whose units can never rank, and 'useful' for the rest."""
    c = with_scope(cells.where("sufficient"), scope, excluded, saturated)
    reason = F.when(F.col("is_saturated"), "saturated").otherwise(F.coalesce("scope_reason", F.lit("useful")))
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("cells"), F.sum("listings").alias("listings"))


def run_gain(units: DataFrame, comps: DataFrame, since: Column, least: int = 8) -> DataFrame:
    """One row: units whose cell had ``least`` comparables before ``since``, has them now, the gain, and who still waits.

    ``units`` and ``comps`` carry zone, typ, band; work is done on counts per cell, never on pairs.
    """
    key = ["zone", "typ", "band"]
    have = comps.groupBy(*key).agg(F.count_if(F.col("seen") < since).alias("_before"), F.count("*").alias("_now"))
    each = units.groupBy(*key).agg(F.count("*").alias("_u")).join(have, key, "left")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_u"))), F.lit(0))
    before, now = F.coalesce("_before", F.lit(0)) >= least, F.coalesce("_now", F.lit(0)) >= least
    return each.agg(total(before).alias("before"), total(now).alias("now"), total(now & ~before).alias("unlocked"), total(~now).alias("waiting"))


def heading_date(text: Column) -> Column:
    """Last day of the date or range in a heading such as "22 al 26 de mayo de 2006"; NULL if there is none."""
    pattern = r"(\d{1,2})\s*(?:al\s*(\d{1,2}))?\s*de\s*([a-z]+)\s*de\s*(\d{4})"
    part = lambda i: F.regexp_extract(F.lower(text), pattern, i)
    month = F.create_map(*[x for m, i in MONTHS.items() for x in (F.lit(m), F.lit(i))])
    day = F.when(part(2) != "", part(2)).otherwise(part(1))
    iso = F.concat_ws("-", part(4), F.lpad(F.try_element_at(month, part(3)).cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(F.try_element_at(month, part(3)).isNotNull(), F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))


def age_months(day: Column, now: Column) -> Column:
    return (F.year(now) - F.year(day)) * 12 + F.month(now) - F.month(day)
