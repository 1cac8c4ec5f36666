"""Matching queries and their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import implausible_reason, rnd, size_band
from lares.operators import match as M
from lares.operators import rent as R
from lares.params import DEFAULT
from lares.plans.bindings import NOW, PART_SQL, RATES_SQL, RENTS_SQL, SCOPE_SQL, UNITS_SQL
from lares.plans.q_rent import BANDS, CELLS_SQL, COMPS, band_sql, comps_and_furnished_of, comps_of
from lares.plans.registry import query, sql_with

P = DEFAULT.with_(bands=BANDS)

IMPLAUSIBLE = """CASE WHEN {p} IS NULL OR {m} IS NULL THEN NULL WHEN {p} NOT BETWEEN 500 AND 60000 THEN 'price_out_of_range'
 WHEN {m} NOT BETWEEN 15 AND 400 THEN 'size_out_of_range' WHEN {p}/{m} < 20 THEN 'uf_m2_below_minimum' WHEN {p}/{m} > 200 THEN 'uf_m2_above_maximum' END"""

UNIT_ROWS_SQL = f"""
urows AS (
  SELECT u.*, coalesce(price_uf, price_clp / rate) AS price,
    (s.district IS NOT NULL AND e.district IS NULL) AS in_scope, t.zone IS NOT NULL AS is_saturated
  FROM units u LEFT JOIN rate_on ON seen = valid_day LEFT JOIN scope s ON u.district = s.district
  LEFT JOIN excluded e ON u.district = e.district LEFT JOIN saturated t ON u.zone = t.zone
  WHERE evidence = 'V' AND NOT from_price AND coalesce(price_uf, price_clp) IS NOT NULL),
ureasons AS (
  SELECT *, CASE WHEN seen IS NULL THEN 'no_date' WHEN seen < DATE '{NOW}' - INTERVAL 21 DAY THEN 'stale' WHEN price IS NULL THEN 'no_uf_rate'
    WHEN zone IS NULL THEN 'no_zone' WHEN is_saturated THEN 'saturated' WHEN NOT in_scope THEN 'out_of_scope' WHEN typ IS NULL THEN 'no_typ'
    WHEN m2 IS NULL OR m2 = 0 THEN 'no_m2' WHEN ({IMPLAUSIBLE.format(p='price', m='m2')}) IS NOT NULL THEN 'implausible' END AS row_reason
  FROM urows),
cand AS (SELECT * FROM ureasons WHERE row_reason IS NULL)"""

WINDOW_SQL = """
sizes AS (SELECT DISTINCT zone, typ, m2 AS m2u FROM cand WHERE m2 < 51),
wcomps AS (SELECT * FROM comps WHERE m2 < 51),
wpairs AS (SELECT s.zone, s.typ, s.m2u, c.m2, c.rent, abs(c.m2 - s.m2u) AS d FROM sizes s JOIN wcomps c ON s.zone = c.zone AND s.typ = c.typ),
wstats AS (
  SELECT s.zone, s.typ, s.m2u,
    count(d) FILTER (d <= greatest(3, s.m2u*0.2)+1e-9) AS n_0, count(d) FILTER (d <= greatest(3, s.m2u*0.3)+1e-9) AS n_1, count(d) FILTER (d <= greatest(3, s.m2u*0.4)+1e-9) AS n_2,
    quantile_cont(p.m2, 0.5) FILTER (d <= greatest(3, s.m2u*0.2)+1e-9) AS m2_0, quantile_cont(p.m2, 0.5) FILTER (d <= greatest(3, s.m2u*0.3)+1e-9) AS m2_1, quantile_cont(p.m2, 0.5) FILTER (d <= greatest(3, s.m2u*0.4)+1e-9) AS m2_2,
    quantile_cont(rent, 0.5) FILTER (d <= greatest(3, s.m2u*0.2)+1e-9) AS rent_0, quantile_cont(rent, 0.5) FILTER (d <= greatest(3, s.m2u*0.3)+1e-9) AS rent_1, quantile_cont(rent, 0.5) FILTER (d <= greatest(3, s.m2u*0.4)+1e-9) AS rent_2,
    count(p.m2) FILTER (p.m2 <= s.m2u*0.85+1e-9) AS smaller_n, quantile_cont(rent/p.m2, 0.5) FILTER (p.m2 <= s.m2u*0.85+1e-9) AS smaller_m2
  FROM sizes s LEFT JOIN wpairs p ON s.zone = p.zone AND s.typ = p.typ AND s.m2u = p.m2u GROUP BY 1, 2, 3),
wfurn AS (
  SELECT s.zone, s.typ, s.m2u,
    coalesce(sum(n) FILTER (abs(f.m2-s.m2u) <= greatest(3, s.m2u*0.2)+1e-9), 0) AS furn_0, coalesce(sum(n) FILTER (abs(f.m2-s.m2u) <= greatest(3, s.m2u*0.3)+1e-9), 0) AS furn_1, coalesce(sum(n) FILTER (abs(f.m2-s.m2u) <= greatest(3, s.m2u*0.4)+1e-9), 0) AS furn_2
  FROM sizes s LEFT JOIN fsizes f ON s.zone = f.zone AND s.typ = f.typ GROUP BY 1, 2, 3),
wall AS (SELECT * FROM wstats JOIN wfurn USING (zone, typ, m2u))"""


def decide_sql(name: str = "decided", source: str = "wall", seasonal: str = "0.30", shift: str = "0.15", beta: str = "0.45", minn: int = 8, extra: str = "") -> str:
    i = "012"
    flags = ", ".join(
        f"(furn_{k} >= 2 AND furn_{k}::DOUBLE/(furn_{k}+n_{k}) >= {seasonal}) AS s{k}, n_{k} >= {minn} AS e{k}, "
        f"coalesce(n_{k} >= {minn} AND abs(m2_{k}-m2u) > m2u*0.2+1e-9, FALSE) AS o{k}" for k in i)
    devs = ", ".join(
        f"coalesce(e{k} AND NOT o{k} AND n_0 >= 3 AND yard <> 0 AND (rent_{k}-yard)/yard > {shift}, FALSE) AS d{k}" for k in "12")
    return f"""
{name}_a AS (SELECT *, {flags}, rent_0 * least(1.0::DOUBLE, pow(m2u/m2_0, {beta})) AS yard FROM {source}),
{name}_b AS (SELECT *, {devs} FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN s0 THEN 'seasonal' WHEN e0 AND NOT o0 THEN 'w0' WHEN s1 THEN 'seasonal' WHEN e1 AND NOT o1 AND NOT d1 THEN 'w1'
   WHEN s2 THEN 'seasonal' WHEN e2 AND NOT o2 AND NOT d2 THEN 'w2' WHEN d1 OR d2 THEN 'wide_shifted' WHEN o0 OR o1 OR o2 THEN 'off_centre' ELSE 'no_comparables' END AS state FROM {name}_b),
{name} AS (SELECT *, CASE state WHEN 'w0' THEN 0 WHEN 'w1' THEN 1 WHEN 'w2' THEN 2 END AS match, CASE WHEN state NOT IN ('w0','w1','w2') THEN state END AS match_reason,
   CASE state WHEN 'w0' THEN rent_0 WHEN 'w1' THEN rent_1 WHEN 'w2' THEN rent_2 END AS rent,
   CASE state WHEN 'w0' THEN n_0 WHEN 'w1' THEN n_1 WHEN 'w2' THEN n_2 END AS n_comps,
   CASE state WHEN 'w0' THEN m2_0 WHEN 'w1' THEN m2_1 WHEN 'w2' THEN m2_2 END AS typical_m2 FROM {name}_c)"""


MATCH_SQL = """
matched AS (
  SELECT c.*, d.match, CASE WHEN c.m2 >= 51 THEN 'out_of_band' ELSE d.match_reason END AS match_reason, d.rent, d.n_comps, d.typical_m2,
    coalesce(d.smaller_n >= 3 AND d.rent/c.m2 > d.smaller_m2, FALSE) AS mark_above_smaller,
    coalesce(pow(c.m2/d.typical_m2, 0.45) < 0.95, FALSE) AS mark_size_shift
  FROM cand c LEFT JOIN decided d ON c.zone = d.zone AND c.typ = d.typ AND c.m2 = d.m2u),
kept AS (SELECT *, row_number() OVER (PARTITION BY zone, typ, m2, price ORDER BY unit_key) AS dup, count(*) OVER (PARTITION BY zone, typ, m2, price) AS copies
  FROM matched WHERE match IS NOT NULL),
zmed AS (SELECT zone, quantile_cont(price/m2, 0.5) AS zone_median FROM cand WHERE NOT suspicious GROUP BY 1)"""

MATCHED = (*COMPS, UNITS_SQL, SCOPE_SQL, UNIT_ROWS_SQL, WINDOW_SQL, decide_sql(), MATCH_SQL)


def scope_of(t):
    return (t.scope, t.excluded, t.saturated)


def inputs(t):
    cand = M.candidates_of(t.units, t.rates, t.now, scope_of(t), P)
    return cand, *comps_and_furnished_of(t)


def decided_of(t):
    cand, comps, furn = inputs(t)
    return cand, M.decisions(cand, comps, furn, P)


@query("implausible_reason", sql_with(PART_SQL, UNITS_SQL, final=f"""
SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT {IMPLAUSIBLE.format(p='price_uf', m='m2')} AS reason FROM units) GROUP BY 1"""))
def implausible_q(t):
    """Plausibility of price, size and price per m2, with the violated rule."""
    r = F.coalesce(implausible_reason(F.col("price_uf"), F.col("m2")), F.lit("ok"))
    return t.units.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("scope_reason", sql_with(PART_SQL, UNITS_SQL, SCOPE_SQL, final="""
SELECT coalesce(CASE WHEN t.zone IS NOT NULL THEN 'saturated' END, CASE WHEN s.district IS NOT NULL AND e.district IS NULL THEN 'in scope'
   WHEN e.district IS NOT NULL THEN 'excluded: '||e.why ELSE 'not declared: '||coalesce(u.district,'?') END) AS reason, count(*) AS n
FROM units u LEFT JOIN scope s ON u.district=s.district LEFT JOIN excluded e ON u.district=e.district LEFT JOIN saturated t ON u.zone=t.zone GROUP BY 1"""))
def scope_q(t):
    """Scope whitelist, exclusions and saturated zones with reasons."""
    d = M.with_scope(t.units, *scope_of(t))
    r = F.when(F.col("is_saturated"), "saturated").otherwise(F.coalesce("scope_reason", F.lit("in scope")))
    return d.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("neighbor_window_join", sql_with(*MATCHED, final="""
SELECT zone, typ, m2u, n_0, n_1, n_2, round(m2_0,6)+0.0 AS m2_0, round(m2_2,6)+0.0 AS m2_2, round(rent_0,6)+0.0 AS rent_0, round(rent_1,6)+0.0 AS rent_1, round(rent_2,6)+0.0 AS rent_2 FROM wall"""))
def window_q(t):
    """Size-window join: counts and medians at 20, 30 and 40 percent."""
    _, d = decided_of(t)
    return d.select("zone", "typ", "m2u", "n_0", "n_1", "n_2", *[rnd(F.col(c)).alias(c) for c in ("m2_0", "m2_2", "rent_0", "rent_1", "rent_2")])


@query("seasonal_guard", sql_with(*MATCHED, final="""
SELECT zone, typ, m2u, CAST(n_0 AS BIGINT) AS n_clean, CAST(furn_0 AS BIGINT) AS n_furnished, round(furn_0::DOUBLE/nullif(furn_0+n_0,0),6)+0.0 AS share,
  coalesce(furn_0 >= 2 AND furn_0::DOUBLE/(furn_0+n_0) >= 0.3, FALSE) AS contaminated FROM wall"""))
def seasonal_q(t):
    """Furnished share in the narrow size window."""
    cand, comps, furn = inputs(t)
    s = M.seasonal_share(M.sizes_of(cand, P), comps.where(size_band(F.col("m2"), BANDS).isNotNull()), furn, P)
    return s.select("zone", "typ", "m2u", "n_clean", "n_furnished", rnd(F.col("share")).alias("share"), "contaminated")


@query("match_rent", sql_with(*MATCHED, final="""
SELECT unit_key, zone, typ, m2, round(price,6)+0.0 AS price, round(rent,6)+0.0 AS rent, n_comps, match, CAST(copies AS BIGINT) AS copies FROM kept WHERE dup = 1"""))
def match_rent_q(t):
    """Units matched to a rent by the guarded window cascade, duplicates collapsed."""
    cand, d = decided_of(t)
    k = M.collapse_duplicates(M.match_units(cand, d, P))
    return k.select("unit_key", "zone", "typ", "m2", rnd(F.col("price")).alias("price"), rnd(F.col("rent")).alias("rent"), "n_comps", "match", "copies")


@query("match_marks", sql_with(*MATCHED, final="""
SELECT unit_key, mark_above_smaller, mark_size_shift, round(typical_m2,6)+0.0 AS typical_m2 FROM kept WHERE dup = 1 AND (mark_above_smaller OR mark_size_shift)"""))
def match_marks_q(t):
    """Provenance marks of accepted matches."""
    cand, d = decided_of(t)
    k = M.collapse_duplicates(M.match_units(cand, d, P)).where("mark_above_smaller or mark_size_shift")
    return k.select("unit_key", "mark_above_smaller", "mark_size_shift", rnd(F.col("typical_m2")).alias("typical_m2"))


DISCARDS_SQL = """
discards AS (
  SELECT coalesce(district,'(no zone)') AS district, reason, count(*) AS n FROM (
    SELECT district, row_reason AS reason FROM ureasons WHERE row_reason IS NOT NULL
    UNION ALL SELECT district, match_reason FROM matched WHERE match IS NULL
    UNION ALL SELECT district, CASE WHEN dup = 1 THEN 'ranks' ELSE 'duplicate' END FROM kept) GROUP BY 1, 2)"""


@query("match_discards", sql_with(*MATCHED, DISCARDS_SQL, final="SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM discards GROUP BY 1"))
def match_discards_q(t):
    """Units per final reason; they add up to the priced units."""
    d = M.discard_counts(t.units, t.rates, *comps_and_furnished_of(t), t.now, scope_of(t), P)
    return d.groupBy("reason").agg(F.sum("n").alias("n"))


REASONS = ["ranks", "stale", "no_date", "no_uf_rate", "out_of_scope", "saturated", "implausible", "no_comparables", "seasonal", "off_centre", "duplicate"]


@query("funnel", sql_with(*MATCHED, DISCARDS_SQL, final="SELECT coalesce(s.district, d.district) AS district, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (reason='{r}'),0) AS BIGINT) AS {r}" for r in REASONS) + " FROM scope s FULL JOIN discards d ON s.district = d.district GROUP BY 1"))
def funnel_q(t):
    """District by reason table; districts without units show zeros."""
    d = M.discard_counts(t.units, t.rates, *comps_and_furnished_of(t), t.now, scope_of(t), P)
    return M.funnel(d, REASONS, t.scope)


@query("zone_discount", sql_with(PART_SQL, RATES_SQL, UNITS_SQL, SCOPE_SQL, UNIT_ROWS_SQL, final="""
, zmed AS (SELECT zone, quantile_cont(price/m2, 0.5) AS zone_median FROM cand WHERE NOT suspicious GROUP BY 1)
SELECT unit_key, round(zone_median,6)+0.0 AS zone_median, round((zone_median - price/m2)/zone_median,6)+0.0 AS discount FROM cand JOIN zmed USING (zone)"""))
def zone_discount_q(t):
    """Discount of each candidate against its zone's median price per m2."""
    cand = M.candidates_of(t.units, t.rates, t.now, scope_of(t), P)
    j = cand.join(M.zone_medians(cand), "zone")
    return j.select("unit_key", rnd(F.col("zone_median")).alias("zone_median"),
                    rnd((F.col("zone_median") - F.col("price") / F.col("m2")) / F.col("zone_median")).alias("discount"))


@query("cell_join", sql_with(*COMPS, CELLS_SQL, UNITS_SQL, SCOPE_SQL, UNIT_ROWS_SQL, final=f"""
SELECT unit_key, band, n, round(rent_median,6)+0.0 AS rent_median, round(12*rent_median/price,9)+0.0 AS gross_yield
FROM (SELECT *, {band_sql('m2')} AS band FROM cand) c JOIN cells USING (zone, typ, band) WHERE n >= 8"""))
def cell_join_q(t):
    """Units joined to rent cells with enough comparables, and their gross yield."""
    cand = M.candidates_of(t.units, t.rates, t.now, scope_of(t), P).withColumn("band", size_band(F.col("m2"), BANDS))
    c = R.cells(comps_of(t), BANDS).where("sufficient").select("zone", "typ", "band", "n", "rent_median")
    return cand.join(c, ["zone", "typ", "band"]).select(
        "unit_key", "band", "n", rnd(F.col("rent_median")).alias("rent_median"),
        rnd(12 * F.col("rent_median") / F.col("price"), 9).alias("gross_yield"))


GAP_SQL = f"""
gapsd AS (
  SELECT district, zone, typ, band, units, coalesce(c.n, 0) AS have, 60 - coalesce(c.n, 0) AS missing, units::DOUBLE/(60 - coalesce(c.n,0)) AS leverage FROM (
    SELECT district, zone, typ, band, count(*) AS units FROM (SELECT *, {band_sql('m2')} AS band FROM ureasons WHERE row_reason IS NULL OR row_reason = 'implausible') WHERE band IS NOT NULL GROUP BY 1, 2, 3, 4) u
  LEFT JOIN (SELECT zone, typ, band, n FROM cells) c USING (zone, typ, band) WHERE coalesce(c.n,0) < 60)"""
GAPS = (*COMPS, CELLS_SQL, UNITS_SQL, SCOPE_SQL, UNIT_ROWS_SQL, GAP_SQL)


def gaps_of(t):
    return M.gaps(t.units, R.cells(comps_of(t), BANDS), t.rates, t.now, scope_of(t), P.with_(min_comparables=60))


@query("gap_leverage", sql_with(*GAPS, final="SELECT zone, typ, band, units, have, missing, round(leverage,6)+0.0 AS leverage FROM gapsd ORDER BY gapsd.leverage DESC, units DESC, zone, typ, band LIMIT 25"))
def gap_leverage_q(t):
    """Cells that block most units per missing comparable (minimum raised to 60 on this data), top 25."""
    g = gaps_of(t).orderBy(F.desc("leverage"), F.desc("units"), "zone", "typ", "band").limit(25)
    return g.select("zone", "typ", "band", "units", "have", "missing", rnd(F.col("leverage")).alias("leverage"))


@query("gap_by_comuna", sql_with(*GAPS, final="SELECT district, CAST(sum(units) AS BIGINT) AS units, CAST(sum(missing) AS BIGINT) AS missing FROM gapsd GROUP BY 1"))
def gap_by_district_q(t):
    """Blocked units and missing comparables per district."""
    return gaps_of(t).groupBy("district").agg(F.sum("units").alias("units"), F.sum("missing").cast("bigint").alias("missing"))


@query("knn_size_rent", sql_with(*MATCHED, final="""
, nn AS (SELECT s.zone, s.typ, s.m2u, c.rent, abs(c.m2-s.m2u) AS d, row_number() OVER (PARTITION BY s.zone, s.typ, s.m2u ORDER BY abs(c.m2-s.m2u), c.rent, c.comp_id) AS k
  FROM sizes s JOIN wcomps c ON s.zone=c.zone AND s.typ=c.typ)
SELECT zone, typ, m2u, round(quantile_cont(rent, 0.5),6)+0.0 AS knn_rent, max(d) AS reach FROM nn WHERE k <= 8 GROUP BY 1,2,3 HAVING count(*) = 8"""))
def knn_q(t):
    """Median rent of the eight comparables nearest in size."""
    cand, comps, _ = inputs(t)
    out = M.knn_rent(M.sizes_of(cand, P), comps.where(size_band(F.col("m2"), BANDS).isNotNull()), 8)
    return out.select("zone", "typ", "m2u", rnd(F.col("knn_rent")).alias("knn_rent"), "reach")
