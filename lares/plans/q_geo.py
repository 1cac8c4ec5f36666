"""Geography queries and their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import rnd, size_band
from lares.operators import geo as G
from lares.operators import invest as I
from lares.operators import rent as R
from lares.params import DEFAULT
from lares.plans.bindings import NOW, PART_SQL
from lares.plans.q_invest import BASE_SQL, eval_sql, irr_sql, rd, rs, score_sql
from lares.plans.q_rent import BANDS, CELLS_SQL, COMPS, band_sql, comps_of
from lares.plans.registry import query, sql_with

GEO_SQL = f"""
zones AS (SELECT DISTINCT zone, district, brand, -33.55 + (brand*7 % 25)/80.0::DOUBLE AS clat, -70.75 + (brand*11 % 25)/80.0::DOUBLE AS clon FROM part_dims),
blocks AS (SELECT c_custkey AS block, 'c'||(c_nationkey % 5) AS district, -33.6 + (c_custkey*37 % 1000)/2500.0::DOUBLE AS lat, -70.8 + (c_custkey*91 % 1000)/2500.0::DOUBLE AS lon,
  CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 9 END AS vacant, 20 + c_custkey % 50 AS occupied, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 17 END AS rent_contract,
  c_custkey % 5 AS rent_informal, 15 + c_custkey % 40 AS households, c_custkey % 3 = 0 AS has_shape FROM customer),
stations AS (SELECT 's'||n_nationkey AS station_id, CASE WHEN n_nationkey % 7 = 0 THEN 'efe' ELSE 'metro' END AS network, 'l'||(n_nationkey % 6) AS line,
  CASE n_nationkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'building' ELSE 'proposed' END AS status, -33.54 + (n_nationkey*13 % 25)/80.0::DOUBLE AS lat, -70.745 + (n_nationkey*7 % 25)/80.0::DOUBLE AS lon,
  CASE WHEN n_nationkey % 4 <> 0 THEN CAST(2002 + n_nationkey % 5 AS INTEGER) END AS opening_year FROM nation),
lines AS (SELECT 'l'||r_regionkey AS line, CAST(DATE '2002-01-01' + CAST(r_regionkey*400 AS INTEGER) AS DATE) AS opens_on FROM region)"""
DIST = "sqrt(pow((a.lat-b.clat)*111320.0,2) + pow((a.lon-b.clon)*111320.0*cos(radians((a.lat+b.clat)/2)),2))"
DISTC = "sqrt(pow((a.lon-b.clon)*111320.0*cos(radians(a.lat)),2) + pow((a.lat-b.clat)*110540.0,2))"
GEO = (PART_SQL, GEO_SQL)


def zones(t):
    b = F.col("brand")
    return t.part_dims.select("zone", "district", "brand").distinct().select(
        "zone", "district", "brand", (-33.55 + (b * 7 % 25) / 80.0).alias("clat"), (-70.75 + (b * 11 % 25) / 80.0).alias("clon"))


def blocks(t):
    k = F.col("c_custkey")
    return t("customer").select(
        k.alias("block"), F.concat(F.lit("c"), (F.col("c_nationkey") % 5).cast("string")).alias("district"),
        (-33.6 + (k * 37 % 1000) / 2500.0).alias("lat"), (-70.8 + (k * 91 % 1000) / 2500.0).alias("lon"),
        F.when(k % 13 != 0, k % 9).alias("vacant"), (20 + k % 50).alias("occupied"), F.when(k % 11 != 0, k % 17).alias("rent_contract"),
        (k % 5).alias("rent_informal"), (15 + k % 40).alias("households"), (k % 3 == 0).alias("has_shape"))


def stations(t):
    k = F.col("n_nationkey")
    return t("nation").select(
        F.concat(F.lit("s"), k.cast("string")).alias("station_id"), F.when(k % 7 == 0, "efe").otherwise("metro").alias("network"),
        F.concat(F.lit("l"), (k % 6).cast("string")).alias("line"),
        F.when(k % 3 == 0, "open").when(k % 3 == 1, "building").otherwise("proposed").alias("status"),
        (-33.54 + (k * 13 % 25) / 80.0).alias("lat"), (-70.745 + (k * 7 % 25) / 80.0).alias("lon"),
        F.when(k % 4 != 0, (2002 + k % 5).cast("int")).alias("opening_year"))


def lines(t):
    k = F.col("r_regionkey")
    return t("region").select(F.concat(F.lit("l"), k.cast("string")).alias("line"), F.date_add(F.lit("2002-01-01").cast("date"), (k * 400).cast("int")).alias("opens_on"))


def assigned(t):
    return G.nearest(blocks(t), zones(t).select("zone", "district", "clat", "clon"), ["district"], ["zone"])


NEAR_SQL = f"""
near AS (SELECT * FROM (SELECT a.*, b.zone, {DIST} AS distance_m, row_number() OVER (PARTITION BY block ORDER BY {DIST}, b.zone) AS rn FROM blocks a JOIN zones b ON a.district = b.district) WHERE rn = 1)"""


@query("nearest_in_group", sql_with(*GEO, NEAR_SQL, final="SELECT block, zone, round(distance_m,3)+0.0 AS distance_m FROM near"))
def nearest_q(t):
    """Nearest zone centre inside the block's own district."""
    return assigned(t).select("block", "zone", rnd(F.col("distance_m"), 3).alias("distance_m"))


@query("nearest_capped", sql_with(*GEO, final=f"""
SELECT block, zone, round(d,3)+0.0 AS distance_m FROM (SELECT a.block, b.zone, {DISTC} AS d, row_number() OVER (PARTITION BY block ORDER BY {DISTC}, b.zone) AS rn FROM blocks a JOIN zones b ON a.district=b.district) WHERE rn=1 AND d <= 2500"""))
def nearest_capped_q(t):
    """Nearest centre of the district within 2.5 km."""
    n = G.nearest_within(blocks(t), zones(t).select("zone", "district", "clat", "clon"), ["district"], ["zone"])
    return n.where("zone is not null").select("block", "zone", rnd(F.col("distance_m"), 3).alias("distance_m"))


CENSUS_SQL = """
census AS (SELECT zone, count(*) AS n_blocks, CAST(sum(vacant) AS BIGINT) AS vacant, CAST(sum(occupied) AS BIGINT) AS occupied, CAST(sum(rent_contract)+sum(rent_informal) AS BIGINT) AS renters, CAST(sum(households) AS BIGINT) AS households FROM near GROUP BY 1)"""


@query("zone_census", sql_with(*GEO, NEAR_SQL, CENSUS_SQL, final="SELECT * FROM census"))
def census_q(t):
    """Census counts per zone; masked values stay out."""
    return G.zone_census(assigned(t)).select("zone", "n_blocks", "vacant", "occupied", "renters", "households")


RISK_SQL = """
zl AS (SELECT zone, CAST(sum(listings) AS BIGINT) AS n FROM cells GROUP BY 1),
raw AS (SELECT c.*, coalesce(n, 0) AS listings, coalesce(vacant,0)::DOUBLE/nullif(coalesce(vacant,0)+coalesce(occupied,0),0) AS vacancy, coalesce(renters,0)::DOUBLE/nullif(households,0) AS depth,
  coalesce(n,0)::DOUBLE/nullif(coalesce(renters,0),0) AS saturation FROM census c LEFT JOIN zl USING (zone)),
lim AS (SELECT min(vacancy) AS v0, max(vacancy) AS v1, min(depth) AS d0, max(depth) AS d1, min(saturation) AS s0, max(saturation) AS s1 FROM raw),
risk AS (SELECT raw.*, (CASE WHEN vacancy IS NOT NULL THEN 0.5*CASE WHEN v0=v1 THEN 0.5 ELSE (vacancy-v0)/(v1-v0) END ELSE 0 END + CASE WHEN saturation IS NOT NULL THEN 0.3*CASE WHEN s0=s1 THEN 0.5 ELSE (saturation-s0)/(s1-s0) END ELSE 0 END
   + CASE WHEN depth IS NOT NULL THEN 0.2*(1-CASE WHEN d0=d1 THEN 0.5 ELSE (depth-d0)/(d1-d0) END) ELSE 0 END)
   / nullif(CASE WHEN vacancy IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN saturation IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN depth IS NOT NULL THEN 0.2 ELSE 0 END, 0) AS risk FROM raw, lim)"""
RISK = (*COMPS, CELLS_SQL, GEO_SQL, NEAR_SQL, CENSUS_SQL, RISK_SQL)


def zone_listings(t):
    band = size_band(F.col("m2"), BANDS)
    return comps_of(t).where(band.isNotNull()).groupBy("zone").agg(F.sum("listings").alias("n"))


def risk_of(t):
    return G.zone_risk(G.zone_census(assigned(t)), zone_listings(t))


@query("zone_risk", sql_with(*RISK, final=f"SELECT zone, CAST(listings AS BIGINT) AS listings, {rs(['vacancy', 'depth', 'saturation', 'risk'])} FROM risk"))
def risk_q(t):
    """Zone risk from vacancy, saturation and rental depth."""
    return risk_of(t).select("zone", F.col("listings").cast("bigint").alias("listings"), *rd(["vacancy", "depth", "saturation", "risk"]))


CAT_SQL = f"""
st AS (SELECT *, CASE WHEN network='efe' THEN 'excluded' WHEN status='open' THEN 'open' WHEN opens_on IS NOT NULL AND date_diff('day', DATE '{NOW}', opens_on)/365.25 BETWEEN 0 AND 3
   AND NOT coalesce(opening_year > 2004, FALSE) AND NOT (status='proposed' AND opening_year IS NULL) THEN 'building' ELSE 'undated' END AS state FROM stations LEFT JOIN lines USING (line)),
el AS (SELECT lat AS clat, lon AS clon, CASE state WHEN 'open' THEN {{f}} WHEN 'building' THEN 0.7 END AS factor FROM st WHERE state = 'building' OR (state = 'open' AND {{f}} > 0)),
zp AS (SELECT zone, clat AS lat, clon AS lon FROM zones),
cat AS (SELECT zone, min(d) AS distance_m, greatest(0, max(CASE WHEN d <= 400 THEN factor WHEN d >= 1200 THEN 0 ELSE factor*(1200-d)/800 END)) AS catalyst FROM (SELECT a.zone, b.factor, {DIST} AS d FROM zp a, el b) GROUP BY 1)"""


def catalyst_of(t, open_factor=None):
    st = G.eligible_stations(stations(t), lines(t), t.now, open_factor=open_factor)
    pts = zones(t).select("zone", F.col("clat").alias("lat"), F.col("clon").alias("lon"))
    return G.station_catalyst(pts, st)


@query("station_catalyst", sql_with(*GEO, CAT_SQL.format(f="1.0"), final="SELECT zone, round(distance_m,3)+0.0 AS distance_m, round(catalyst,6)+0.0 AS catalyst FROM cat"))
def catalyst_q(t):
    """Distance to the nearest eligible station and the distance-decay score."""
    return catalyst_of(t).select("zone", rnd(F.col("distance_m"), 3).alias("distance_m"), rnd(F.col("catalyst")).alias("catalyst"))


@query("risk_default_count", sql_with(*RISK, CAT_SQL.format(f="1.0"), final="""
SELECT count(r.risk) AS risk_measured, count(*) - count(r.risk) AS risk_default, count(c.catalyst) AS catalyst_measured, count(*) - count(c.catalyst) AS catalyst_default,
 round(avg(coalesce(r.risk, 0.5)),6)+0.0 AS avg_risk FROM part_dims p LEFT JOIN risk r ON p.zone = r.zone LEFT JOIN cat c ON p.zone = c.zone AND c.distance_m < 1200"""))
def default_q(t):
    """Units with measured risk and catalyst against those on the defaults."""
    r = risk_of(t).select("zone", "risk")
    c = catalyst_of(t).where("distance_m < 1200").select("zone", "catalyst")
    j = t.part_dims.join(r, "zone", "left").join(c, "zone", "left")
    n = F.count("*")
    return j.agg(F.count("risk").alias("risk_measured"), (n - F.count("risk")).alias("risk_default"), F.count("catalyst").alias("catalyst_measured"),
                 (n - F.count("catalyst")).alias("catalyst_default"), rnd(F.avg(F.coalesce("risk", F.lit(0.5)))).alias("avg_risk"))


@query("geometry_coverage", sql_with(*GEO, NEAR_SQL, final="""
SELECT count(*) AS zones, count(*) FILTER (shapes > 0) AS with_shape, count(*) FILTER (coalesce(shapes,0) = 0) AS without_shape, count(*) FILTER (shapes IS NULL) AS without_blocks
FROM (SELECT DISTINCT zone FROM zones) z LEFT JOIN (SELECT zone, count(*) FILTER (has_shape) AS shapes FROM near GROUP BY 1) USING (zone)"""))
def coverage_q(t):
    """Zones with and without geometry."""
    return G.geometry_coverage(zones(t), assigned(t))


@query("series_pivot", """
SELECT CAST(day AS VARCHAR) AS day, round(max(v) FILTER (s='HIGH'),4)+0.0 AS high, round(max(v) FILTER (s='LOW'),4)+0.0 AS low, round(max(v) FILTER (s='URGENT'),4)+0.0 AS urgent
FROM (SELECT CAST(o_orderdate AS DATE) AS day, substr(o_orderpriority,3) AS s, max(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1""")
def pivot_q(t):
    """Long series to one column per series."""
    long = t("orders").groupBy(F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 3, 20).alias("s")).agg(F.max("o_totalprice").alias("v"))
    w = long.groupBy("day").pivot("s", ["HIGH", "LOW", "URGENT"]).agg(F.max("v"))
    return w.select(F.col("day").cast("string").alias("day"), *[rnd(F.col(c), 4).alias(c.lower()) for c in ("HIGH", "LOW", "URGENT")])


SUPPLY_SQL = f"""
capped AS (SELECT * FROM (SELECT a.block, b.zone, {DISTC} AS d, row_number() OVER (PARTITION BY block ORDER BY {DISTC}, b.zone) AS rn FROM blocks a JOIN zones b ON a.district=b.district) WHERE rn=1 AND d <= 2500),
sup AS (SELECT p.p_partkey, p.typ, p.district, floor(p_retailprice/10)*10.0::DOUBLE AS price, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS m2, g.zone,
   CASE WHEN p_partkey % 8 <> 0 THEN p.typ END AS typology FROM part_dims p JOIN customer ON c_custkey = p_partkey LEFT JOIN capped g ON g.block = p_partkey),
sup2 AS (SELECT s.*, c.n, c.rent_median, CASE WHEN s.zone IS NULL THEN 'no_geo' WHEN m2 IS NULL THEN 'no_m2' WHEN typology IS NULL THEN 'no_typ' WHEN c.n IS NULL OR c.n < 8 THEN 'no_cell' END AS reason
  FROM (SELECT *, {band_sql('m2')} AS band FROM sup) s LEFT JOIN cells c ON s.zone = c.zone AND s.typology = c.typ AND s.band = c.band),
sunits AS (SELECT 'u'||lpad(CAST(p_partkey AS VARCHAR),9,'0') AS unit_key, zone, district, typ, m2, price, rent_median AS rent, n AS n_comps, CAST(NULL AS BOOLEAN) AS tax_regime, TRUE AS is_new, CAST(NULL AS INTEGER) AS age_years,
  'V' AS price_evidence, FALSE AS is_saturated, 0.5::DOUBLE AS risk, 0.0::DOUBLE AS catalyst, 0.0::DOUBLE AS zone_discount FROM sup2 WHERE reason IS NULL)"""


@query("new_supply_eval", sql_with(*COMPS, CELLS_SQL, GEO_SQL, SUPPLY_SQL, BASE_SQL, eval_sql(src="sunits"), irr_sql(), score_sql(), final="""
SELECT reason, count(*) AS n, round(avg(score),6)+0.0 AS avg_score FROM (SELECT reason, NULL AS score FROM sup2 WHERE reason IS NOT NULL
 UNION ALL SELECT CASE WHEN exclusion IS NULL THEN 'evaluated' ELSE 'excluded' END, NULL FROM ev WHERE exclusion IS NOT NULL UNION ALL SELECT 'evaluated', score FROM ev_scored) GROUP BY 1""", recursive=True))
def supply_q(t):
    """New supply at its "from" price: located, joined to rent cells, evaluated; discards counted."""
    k = F.col("p_partkey")
    located = G.nearest_within(blocks(t), zones(t).select("zone", "district", "clat", "clon"), ["district"], ["zone"]).select(F.col("block").alias("p_partkey"), "zone")
    parts = t.part_dims.drop("zone").join(t("customer").select(F.col("c_custkey").alias("p_partkey")), "p_partkey")
    s = parts.join(located, "p_partkey", "left").select(
        "p_partkey", "district", "zone", "typ", (F.floor(F.col("p_retailprice") / 10) * 10.0).alias("price"),
        F.when(k % 10 != 0, F.col("p_size").cast("double")).alias("m2"), F.when(k % 8 != 0, F.col("typ")).alias("typology"))
    return I.new_supply_summary(s, R.cells(comps_of(t), BANDS), BANDS, I.base_scenario(t.spark))
