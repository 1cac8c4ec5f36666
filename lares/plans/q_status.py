"""Status queries and their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import size_band
from lares.operators import rent as R
from lares.operators import status as S
from lares.plans.bindings import NOW, PART_SQL, RATES_SQL, SCOPE_SQL, UNITS_SQL
from lares.plans.q_match import scope_of
from lares.plans.q_quality import RUNS_SQL, runs_of
from lares.plans.q_rent import BANDS, CELLS_SQL, COMPS, band_sql, comps_of
from lares.plans.registry import query, sql_with

RUN_DAY = "2001-07-25"


@query("series_status", sql_with(RATES_SQL, final="SELECT count(*) AS n, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last FROM rates WHERE rate IS NOT NULL"))
def series_status_q(t):
    """Days, first and last day of the rate series."""
    return S.series_status(t.rates).select("n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@query("last_runs", sql_with(RUNS_SQL, final="""
SELECT source_id, CAST(ended AS VARCHAR) AS ended, "rows", ok, back FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ended DESC) AS back FROM runs) WHERE back <= 10"""))
def last_runs_q(t):
    """The ten latest runs of each source."""
    return S.last_runs(runs_of(t)).select("source_id", F.col("ended").cast("string").alias("ended"), "rows", "ok", F.col("back").cast("bigint").alias("back"))


@query("cells_for_nobody", sql_with(*COMPS, CELLS_SQL, SCOPE_SQL, final="""
SELECT coalesce(CASE WHEN t.zone IS NOT NULL THEN 'saturated' END, CASE WHEN s.district IS NOT NULL AND e.district IS NULL THEN 'useful' WHEN e.district IS NOT NULL THEN 'excluded: '||e.why ELSE 'not declared: '||coalesce(c.district,'?') END) AS reason,
 count(*) AS cells, CAST(sum(c.listings) AS BIGINT) AS listings
FROM (SELECT *, split_part(zone, '/', 1) AS district FROM cells WHERE n >= 8) c LEFT JOIN scope s ON c.district=s.district LEFT JOIN excluded e ON c.district=e.district LEFT JOIN saturated t ON c.zone=t.zone GROUP BY 1"""))
def cells_for_nobody_q(t):
    """Deep cells whose zone is saturated or out of scope: collecting there helps no unit."""
    c = R.cells(comps_of(t), BANDS).withColumn("district", F.substring_index("zone", "/", 1))
    return S.cells_for_nobody(c, *scope_of(t))


@query("run_gain", sql_with(*COMPS, UNITS_SQL, final=f"""
, u AS (SELECT zone, typ, band, count(*) AS u FROM (SELECT zone, typ, {band_sql('m2')} AS band FROM units) WHERE zone IS NOT NULL AND typ IS NOT NULL AND band IS NOT NULL GROUP BY ALL),
h AS (SELECT zone, typ, band, count(*) FILTER (seen < DATE '{RUN_DAY}') AS before, count(*) AS now FROM (SELECT *, {band_sql('m2')} AS band FROM comps) WHERE band IS NOT NULL GROUP BY ALL),
j AS (SELECT u, coalesce(before, 0) >= 8 AS b, coalesce(now, 0) >= 8 AS n FROM u LEFT JOIN h USING (zone, typ, band))
SELECT coalesce(CAST(sum(u) FILTER (b) AS BIGINT), 0) AS before, coalesce(CAST(sum(u) FILTER (n) AS BIGINT), 0) AS now, coalesce(CAST(sum(u) FILTER (n AND NOT b) AS BIGINT), 0) AS unlocked, coalesce(CAST(sum(u) FILTER (NOT n) AS BIGINT), 0) AS waiting FROM j"""))
def run_gain_q(t):
    """Units that the comparables seen since the run's day have made evaluable."""
    band = lambda d: d.withColumn("band", size_band(F.col("m2"), BANDS)).where("zone is not null and typ is not null and band is not null")
    return S.run_gain(band(t.units), band(comps_of(t)), F.lit(RUN_DAY).cast("date"))


@query("heading_dates", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 3 THEN CAST(d AS VARCHAR) END AS day, CASE WHEN o_orderkey % 7 <> 3 THEN (year(DATE '{NOW}') - year(d)) * 12 + month(DATE '{NOW}') - month(d) END AS age_months
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def heading_dates_q(t):
    """Valid day and age in months of a sheet, from the words of its heading."""
    day = F.to_date("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in S.MONTHS]), F.month(day))
    last = F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), F.initcap(month), F.lit(" de "), F.year(day).cast("string"))
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 3, F.lit("Fecha de la consulta: 3 de brumario de 2006")).when(k % 2 == 0, F.concat(F.lit("Fecha de la consulta: 1 al "), last)).otherwise(F.concat(F.lit("Fecha: "), last))
    d = S.heading_date(text)
    return t("orders").select(k, d.cast("string").alias("day"), S.age_months(d, t.now).cast("bigint").alias("age_months"))
