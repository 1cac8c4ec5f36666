"""Rent-side queries and their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import freshness_reason, rnd, size_band, text_doubtful, text_not_comparable
from lares.operators import rent as R
from lares.operators.asof import latest_asof, rate_by_day, with_rate
from lares.plans.bindings import NOW, PART_SQL, RATES_SQL, RENTS_SQL, SCOPE_SQL, UNITS_SQL
from lares.plans.registry import query, sql_with

BANDS = ((0, 10), (10, 20), (20, 35), (35, 51))
PROPOSED = ((0, 8), (8, 16), (16, 24), (24, 35), (35, 51))


def band_sql(col: str, bands=BANDS) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {a} AND {col} < {b} THEN '{a}-{b}'" for a, b in bands) + " END"


FURN = "regexp_matches(lower(url), 'amoblad|amueblad|corta[\\s-]estad[ií]a|por[\\s-]d[ií]a|airbnb|temporada|turistic|tur[ií]stic|diario')"

# row reasons, signatures and comparables, reused by every query below
COMPS_SQL = f"""
rrows AS (
  SELECT r.*, coalesce(rent_uf, rent_clp / rate) AS rent,
    CASE WHEN seen IS NULL THEN 'no_date' WHEN seen < DATE '{NOW}' - INTERVAL 21 DAY THEN 'stale'
         WHEN {FURN} THEN 'furnished' WHEN zone IS NULL THEN 'no_zone' WHEN typ IS NULL THEN 'no_typ'
         WHEN m2 IS NULL OR m2 = 0 THEN 'no_m2' WHEN coalesce(rent_uf, rent_clp / rate) IS NULL THEN 'no_uf_rate' END AS reason
  FROM rents r LEFT JOIN rate_on ON seen = valid_day
  WHERE active AND NOT suspicious),
fsig AS (SELECT DISTINCT zone, typ, m2, rent_uf, rent_clp FROM rrows WHERE reason = 'furnished' AND zone IS NOT NULL AND typ IS NOT NULL AND m2 IS NOT NULL),
clean AS (
  SELECT r.*, (f.zone IS NOT NULL) AS twin FROM (SELECT * FROM rrows WHERE reason IS NULL) r
  LEFT JOIN fsig f ON r.zone = f.zone AND r.typ = f.typ AND r.m2 = f.m2
    AND r.rent_uf IS NOT DISTINCT FROM f.rent_uf AND r.rent_clp IS NOT DISTINCT FROM f.rent_clp),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY zone, typ, m2, rent_uf, rent_clp ORDER BY seen DESC, comp_id DESC) AS rn,
         count(*) OVER (PARTITION BY zone, typ, m2, rent_uf, rent_clp) AS copies
  FROM clean WHERE NOT multifamily AND NOT twin),
comps AS (
  SELECT comp_id, zone, typ, m2, rent, copies AS listings, seen FROM ranked WHERE rn = 1
  UNION ALL SELECT comp_id, zone, typ, m2, rent, 1, seen FROM clean WHERE multifamily),
fsizes AS (
  SELECT zone, typ, m2, count(*) AS n FROM (
    SELECT DISTINCT zone, typ, m2, rent_uf, rent_clp FROM rents
    WHERE active AND NOT suspicious AND zone IS NOT NULL AND typ IS NOT NULL AND m2 > 0 AND m2 < 140
      AND seen >= DATE '{NOW}' - INTERVAL 21 DAY AND {FURN}) GROUP BY ALL)"""

COMPS = (RENTS_SQL, RATES_SQL, COMPS_SQL)


def comps_of(t, **kw):
    return R.comparables(t.rents, t.rates, t.now, **kw)


def comps_and_furnished_of(t):
    return R.comparables_and_furnished(t.rents, t.rates, t.now)


@query("size_band", sql_with(RENTS_SQL, final=f"""
SELECT band, count(*) AS n, round(avg(m2), 6) + 0.0 AS avg_m2
FROM (SELECT m2, {band_sql('m2')} AS band FROM rents) GROUP BY band"""))
def size_band_q(t):
    """Size-band label, closed below and open above; sizes outside every band get NULL."""
    return t.rents.select("m2", size_band(F.col("m2"), BANDS).alias("band")).groupBy("band").agg(
        F.count("*").alias("n"), rnd(F.avg("m2")).alias("avg_m2"))


@query("freshness_reason", sql_with(RENTS_SQL, final=f"""
SELECT coalesce(reason, 'fresh') AS reason, count(*) AS n, CAST(min(seen) AS VARCHAR) AS oldest FROM (
  SELECT seen, CASE WHEN seen IS NULL THEN 'no_date' WHEN seen < DATE '{NOW}' - INTERVAL 21 DAY THEN 'stale' END AS reason FROM rents)
GROUP BY 1"""))
def freshness_q(t):
    """Freshness with a reason of its own for rows without a date."""
    r = t.rents.select("seen", F.coalesce(freshness_reason(F.col("seen"), t.now), F.lit("fresh")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.min("seen").cast("string").alias("oldest"))


@query("uf_asof", sql_with(RENTS_SQL, RATES_SQL, final="""
SELECT CAST(r.seen AS VARCHAR) AS seen, CAST(max(day) AS VARCHAR) AS rate_day, round(arg_max(x.rate, day), 4) + 0.0 AS rate, count(DISTINCT comp_id) AS n
FROM rents r LEFT JOIN (SELECT * FROM rates WHERE rate > 0) x ON x.day <= r.seen AND x.day >= r.seen - 7
WHERE r.seen IS NOT NULL GROUP BY r.seen"""))
def uf_asof_q(t):
    """Backward as-of with a seven-day tolerance, as an equality join on the valid day."""
    j = with_rate(t.rents.where("seen is not null"), t.rates, "seen")
    return j.groupBy("seen").agg(F.max("rate_day").cast("string").alias("rate_day"), rnd(F.max("rate"), 4).alias("rate"),
                                 F.count("*").alias("n")).withColumn("seen", F.col("seen").cast("string"))


@query("comparables", sql_with(*COMPS, final="""
SELECT comp_id, zone, typ, m2, round(rent, 6) + 0.0 AS rent, CAST(listings AS BIGINT) AS listings, CAST(seen AS VARCHAR) AS seen FROM comps"""))
def comparables_q(t):
    """Clean comparables: filters, conversion, twin removal, relisting collapse."""
    return comps_of(t, ids=True).select("comp_id", "zone", "typ", "m2", rnd(F.col("rent")).alias("rent"), "listings", F.col("seen").cast("string").alias("seen"))


@query("comparable_discards", sql_with(*COMPS, final="""
SELECT reason, count(*) AS n FROM (
  SELECT reason FROM rrows WHERE reason IS NOT NULL
  UNION ALL SELECT CASE WHEN multifamily THEN 'kept' WHEN twin THEN 'furnished_twin' END FROM clean WHERE multifamily OR twin
  UNION ALL SELECT CASE WHEN rn = 1 THEN 'kept' ELSE 'relisting' END FROM ranked)
GROUP BY 1"""))
def comparable_discards_q(t):
    """Counts per discard reason; they add up to the input."""
    return R.discard_counts(t.rents, t.rates, t.now)


@query("twin_antijoin", sql_with(*COMPS, final="""
SELECT zone, typ, count(*) AS n_twins, round(avg(m2), 6) + 0.0 AS avg_m2 FROM clean WHERE twin AND NOT multifamily GROUP BY 1, 2"""))
def twin_q(t):
    """Clean listings with the exact signature of a furnished one."""
    sig = R._signatures(R.row_reasons(t.rents, t.rates, t.now)).where("n_clean > 0 and n_furnished > 0")
    return sig.groupBy("zone", "typ").agg(
        F.sum("n_clean").cast("bigint").alias("n_twins"),
        rnd(F.sum(F.col("m2") * F.col("n_clean")) / F.sum("n_clean")).alias("avg_m2"))


@query("relisting_collapse", sql_with(*COMPS, final="""
SELECT comp_id, CAST(copies AS BIGINT) AS listings, CAST(seen AS VARCHAR) AS seen FROM ranked WHERE rn = 1 AND copies > 1"""))
def relisting_q(t):
    """Groups of relistings: representative (latest sighting) and number of listings."""
    sig = R._signatures(R.row_reasons(t.rents, t.rates, t.now), ids=True).where("n_clean > 1 and n_furnished = 0")
    return sig.select("comp_id", F.col("n_clean").alias("listings"), F.col("seen").cast("string").alias("seen"))


@query("furnished_pool", sql_with(*COMPS, final="SELECT zone, typ, m2, n FROM fsizes"))
def furnished_pool_q(t):
    """Sizes of furnished listings per zone and type."""
    return R.furnished_sizes(t.rents, t.now)


CELLS_SQL = f"""
cells AS (
  SELECT zone, typ, band, count(*) AS n, CAST(sum(listings) AS BIGINT) AS listings,
         quantile_cont(rent, 0.25) AS rent_p25, quantile_cont(rent, 0.5) AS rent_median, quantile_cont(rent, 0.75) AS rent_p75,
         quantile_cont(rent / m2, 0.5) AS rent_m2_median, quantile_cont(m2, 0.5) AS m2_median
  FROM (SELECT *, {band_sql('m2')} AS band FROM comps) WHERE band IS NOT NULL GROUP BY 1, 2, 3)"""


@query("rent_cells", sql_with(*COMPS, CELLS_SQL, final="""
SELECT zone, typ, band, n, listings, round(rent_p25,6)+0.0 AS rent_p25, round(rent_median,6)+0.0 AS rent_median,
  round(rent_p75,6)+0.0 AS rent_p75, round(rent_m2_median,6)+0.0 AS rent_m2_median, round(m2_median,6)+0.0 AS m2_median,
  n >= 8 AS sufficient, round((rent_p75-rent_p25)/rent_median,6)+0.0 AS dispersion FROM cells"""))
def rent_cells_q(t):
    """Rent cells: counts, quartiles, price per m2, typical size."""
    c = R.cells(comps_of(t), BANDS)
    num = ["rent_p25", "rent_median", "rent_p75", "rent_m2_median", "m2_median", "dispersion"]
    return c.select("zone", "typ", "band", "n", "listings", "sufficient", *[rnd(F.col(x)).alias(x) for x in num])


@query("thin_cells", sql_with(*COMPS, final="""
SELECT zone, typ, count(*) AS n FROM comps GROUP BY 1, 2 HAVING count(*) < 400"""))
def thin_cells_q(t):
    """Zone and type combinations under a minimum number of comparables (400 on this data)."""
    return comps_of(t).groupBy("zone", "typ").agg(F.count("*").alias("n")).where("n < 400")


@query("comparable_audit", sql_with(RENTS_SQL, final=f"""
SELECT zone, typ, count(*) AS n, count(*) FILTER (status='furnished') AS n_furnished, count(*) FILTER (status='stale') AS n_stale,
  count(*) FILTER (status='relisting') AS n_relisting, count(*) FILTER (status='doubtful') AS n_doubtful,
  count(*) FILTER (status IN ('used','doubtful')) AS n_used,
  quantile_cont(rent_clp, 0.5) FILTER (status IN ('used','doubtful')) AS median_clp
FROM (SELECT *, CASE WHEN furn THEN 'furnished' WHEN NOT fresh THEN 'stale' WHEN NOT multifamily AND rn > 1 THEN 'relisting'
             WHEN regexp_matches(url, 'equipad') THEN 'doubtful' ELSE 'used' END AS status
      FROM (SELECT *, row_number() OVER (PARTITION BY zone, typ, m2, rent_clp, rent_uf, fresh AND NOT furn AND NOT multifamily ORDER BY seen DESC, comp_id DESC) AS rn
            FROM (SELECT *, {FURN} AS furn, coalesce(seen >= DATE '{NOW}' - INTERVAL 21 DAY, FALSE) AS fresh
                  FROM rents WHERE active AND rent_clp IS NOT NULL AND zone IS NOT NULL)))
GROUP BY 1, 2"""))
def comparable_audit_q(t):
    """Status of every listing behind a median, summarised per zone and type."""
    return R.audit_summary(R.audit(t.rents, t.rates, t.now))


@query("microunit_rent", sql_with(RENTS_SQL, final=f"""
SELECT band, count(*) AS n, count(age) AS n_dated, count(fees) AS n_fees, round(avg(CASE WHEN published_since IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6)+0.0 AS share_seen_fresh,
  count(published_since) AS n_labelled, round(quantile_cont(age::DOUBLE,0.5),6)+0.0 AS age_median, round(quantile_cont(age_floor::DOUBLE,0.5),6)+0.0 AS age_floor_median,
  round(quantile_cont(per_m2,0.5),6)+0.0 AS per_m2_median, round(quantile_cont(fees,0.5),6)+0.0 AS fees_median
FROM (SELECT CASE WHEN m2<25 THEN '<25' WHEN m2<35 THEN '25-35' WHEN m2<50 THEN '35-50' WHEN m2<70 THEN '50-70' ELSE '70+' END AS band, published_since,
        CASE WHEN published_on < seen AND published_on <= coalesce(first_seen, seen) THEN date_diff('day', published_on, seen) END AS age,
        date_diff('day', coalesce(first_seen, seen), DATE '{NOW}') AS age_floor, rent_uf/m2 AS per_m2,
        CASE WHEN fees_clp > 0 THEN fees_clp/m2 END AS fees
      FROM rents WHERE active AND NOT suspicious AND NOT {FURN} AND m2 > 0) GROUP BY 1"""))
def microunit_rent_q(t):
    """Rent profile of small units by analysis band."""
    out = R.microunit_rent(t.rents, t.now)
    num = ["share_seen_fresh", "age_median", "age_floor_median", "per_m2_median", "fees_median"]
    return out.select("band", "n", "n_dated", "n_fees", "n_labelled", *[rnd(F.col(c)).alias(c) for c in num])


@query("band_simulation", sql_with(*COMPS, UNITS_SQL, final=f"""
, ca AS (SELECT zone, typ, {band_sql('m2')} AS band FROM comps GROUP BY 1,2,3 HAVING count(*) >= 8 AND band IS NOT NULL),
cb AS (SELECT zone, typ, {band_sql('m2', PROPOSED)} AS band, quantile_cont(m2, 0.5) AS typical FROM comps GROUP BY 1,2,3 HAVING count(*) >= 8 AND band IS NOT NULL),
j AS (SELECT u.m2, ca.zone IS NOT NULL AS before, cb.zone IS NOT NULL AS after, typical FROM units u
  LEFT JOIN ca ON u.zone=ca.zone AND u.typ=ca.typ AND {band_sql('u.m2')}=ca.band
  LEFT JOIN cb ON u.zone=cb.zone AND u.typ=cb.typ AND {band_sql('u.m2', PROPOSED)}=cb.band)
SELECT count(*) FILTER (before AND NOT after) AS units_lost, count(*) FILTER (after AND NOT before) AS units_gained,
  count(*) FILTER (before AND after AND abs(m2-typical)/typical < 0.15) AS units_well_matched,
  (SELECT count(*) FROM ca) AS cells_now, (SELECT count(*) FROM cb) AS cells_proposed FROM j""".replace("\n, ca", ", ca")))
def band_simulation_q(t):
    """Cost of different size bands in cells and units."""
    return R.band_simulation(comps_of(t), t.units, BANDS, PROPOSED)


@query("latest_asof", sql_with(RATES_SQL, final="""
SELECT 'uf' AS series, round(arg_max(rate, day), 4) + 0.0 AS value, CAST(max(day) AS VARCHAR) AS value_day, 'daily' AS source_id
FROM rates WHERE day <= DATE '2001-07-16'"""))
def latest_asof_q(t):
    """Latest value at or before a date."""
    s = t.rates.select(F.lit("uf").alias("series"), "day", F.col("rate").alias("value"), F.lit("daily").alias("source_id"))
    return latest_asof(s, F.lit("2001-07-16").cast("date")).select(
        "series", rnd(F.col("value"), 4).alias("value"), F.col("value_day").cast("string").alias("value_day"), "source_id")
