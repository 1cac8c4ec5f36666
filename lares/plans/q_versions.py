"""Version history, market change and keyed-sink queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import rnd
from lares.operators import rent as R
from lares.operators import versions as V
from lares.plans.bindings import CAPTURES_SQL, exact_avg
from lares.plans.registry import query, sql_with

CUT = "2024-01-24 00:00:00"

CAPT_RATES_SQL = """
rates AS (SELECT CAST(ts AS DATE) AS day, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*) / 100 * 20 AS rate FROM events GROUP BY 1 HAVING day(CAST(ts AS DATE)) % 5 <> 0),
rate_on AS (SELECT valid_day, arg_max(rate, day) AS rate FROM (SELECT day, rate, CAST(day + CAST(k AS INTEGER) AS DATE) AS valid_day FROM rates, range(0,8) r(k)) GROUP BY 1)"""


def islands(src: str, out: str) -> str:
    return f"""
{out}_u AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY unit_key, captured ORDER BY event_id DESC) AS rn FROM {src}) WHERE rn = 1),
{out}_f AS (SELECT *, CASE WHEN lag(captured) OVER w IS NULL OR lag(price_uf) OVER w IS DISTINCT FROM price_uf OR lag(price_clp) OVER w IS DISTINCT FROM price_clp THEN 1 ELSE 0 END AS chg FROM {out}_u WINDOW w AS (PARTITION BY unit_key ORDER BY captured)),
{out}_v AS (SELECT *, sum(chg) OVER (PARTITION BY unit_key ORDER BY captured) AS ver FROM {out}_f),
{out} AS (SELECT unit_key, price_uf, price_clp, ver, min(zone) AS zone, min(captured) AS valid_from, max(captured) AS fetched_at,
  lead(min(captured)) OVER (PARTITION BY unit_key ORDER BY ver) AS valid_to FROM {out}_v GROUP BY 1, 2, 3, 4)"""


VERS = (CAPTURES_SQL, CAPT_RATES_SQL, islands("captures", "vers"))
TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
ts_sql = lambda c: TS.format(c=c)
ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
VER_COLS_SQL = f"unit_key, price_uf, price_clp, {ts_sql('valid_from')} AS valid_from, {ts_sql('valid_to')} AS valid_to, {ts_sql('fetched_at')} AS fetched_at"


def capture_rates(t):
    day = F.to_date("ts")
    return t("events").groupBy(day.alias("day")).agg((exact_avg("value") * 20).alias("rate")).where(F.dayofmonth("day") % 5 != 0)


def versions_of(t, extra=("zone",)):
    return V.versions(V.one_per_instant(t.captures), list(extra))


def show(v):
    return v.select("unit_key", "price_uf", "price_clp", ts("valid_from").alias("valid_from"), ts("valid_to").alias("valid_to"), ts("fetched_at").alias("fetched_at"))


@query("scd2_build", sql_with(*VERS, final=f"SELECT {VER_COLS_SQL} FROM vers"))
def scd2_build_q(t):
    """Price versions of every unit from all captures."""
    return show(versions_of(t))


@query("scd2_late", sql_with(*VERS, final=f"SELECT {VER_COLS_SQL} FROM vers"))
def scd2_late_q(t):
    """Versions of the odd captures, then the even ones merged late: before, between and after the known ones."""
    c = t.captures.select("unit_key", "captured", "event_id", "price_uf", "price_clp")
    known, late = c.where("event_id % 2 = 1"), c.where("event_id % 2 = 0")
    return show(V.merge_late(V.versions(V.one_per_instant(known)), known, late))


@query("scd2_surface", sql_with(CAPTURES_SQL, """
hasc AS (SELECT DISTINCT unit_key FROM captures WHERE surface = 'card'),
chosen AS (SELECT c.* FROM captures c LEFT JOIN hasc h USING (unit_key) WHERE h.unit_key IS NULL OR surface = 'card'),
attrs AS (SELECT unit_key, coalesce(arg_max(m2, (captured, event_id)) FILTER (surface='card' AND m2 IS NOT NULL), arg_max(m2, (captured, event_id)) FILTER (m2 IS NOT NULL)) AS m2,
   coalesce(arg_max(age_years, (captured, event_id)) FILTER (surface='card' AND age_years IS NOT NULL), arg_max(age_years, (captured, event_id)) FILTER (age_years IS NOT NULL)) AS age_years FROM captures GROUP BY 1)""",
    islands("chosen", "vers"), final=f"SELECT {VER_COLS_SQL}, m2, age_years FROM vers JOIN attrs USING (unit_key)"))
def scd2_surface_q(t):
    """Versions from the canonical surface; the other one only fills attributes."""
    v = V.canonical_versions(t.captures)
    return v.select("unit_key", "price_uf", "price_clp", ts("valid_from").alias("valid_from"), ts("valid_to").alias("valid_to"),
                    ts("fetched_at").alias("fetched_at"), "m2", "age_years")


CHANGES_SQL = f"""
firsts AS (SELECT unit_key, arg_min(price_uf, valid_from) AS u0x, min(valid_from) AS f0 FROM vers WHERE valid_to IS NOT NULL GROUP BY 1),
first AS (SELECT v.unit_key, v.price_uf AS u0, v.price_clp AS c0, v.valid_from AS f0 FROM vers v JOIN firsts f ON v.unit_key = f.unit_key AND v.valid_from = f.f0),
changes AS (SELECT n.unit_key, n.zone, coalesce(u0, c0 / ro.rate) AS before, coalesce(n.price_uf, n.price_clp / rn.rate) AS after
  FROM vers n JOIN first o USING (unit_key) LEFT JOIN rate_on ro ON CAST(o.f0 AS DATE) = ro.valid_day LEFT JOIN rate_on rn ON CAST(n.valid_from AS DATE) = rn.valid_day
  WHERE n.valid_to IS NULL AND n.valid_from >= TIMESTAMP '{CUT}'),
changed AS (SELECT *, before IS NOT NULL AND after IS NOT NULL AS convertible, CASE WHEN before <> 0 THEN (after-before)/before WHEN before = 0 THEN 0.0::DOUBLE END AS change FROM changes)"""


def cut():
    return F.lit(CUT).cast("timestamp_ntz")


@query("price_net_change", sql_with(*VERS, CHANGES_SQL, final="SELECT unit_key, round(before,6)+0.0 AS before, round(after,6)+0.0 AS after, convertible, round(change,6)+0.0 AS change FROM changed"))
def net_change_q(t):
    """Net price change per unit from its oldest closed version to the open one, in UF."""
    ch = V.price_changes(versions_of(t), capture_rates(t), cut())
    return ch.select("unit_key", rnd(F.col("before")).alias("before"), rnd(F.col("after")).alias("after"), "convertible", rnd(F.col("change")).alias("change"))


@query("price_drop_successor", sql_with(*VERS, final=f"""
SELECT v.unit_key, v.price_uf AS before, n.price_uf AS after, {ts_sql('v.valid_to')} AS valid_to, round((n.price_uf-v.price_uf)/v.price_uf,6)+0.0 AS change
FROM vers v JOIN vers n ON v.unit_key=n.unit_key AND n.valid_from=v.valid_to
WHERE CAST(substr(v.unit_key,2) AS BIGINT) % 2 = 0 AND v.valid_to >= TIMESTAMP '{CUT}' AND n.price_uf < v.price_uf"""))
def price_drop_q(t):
    """Drops of "from" prices: a version whose successor is cheaper."""
    v = versions_of(t).withColumn("from_price", F.substring("unit_key", 2, 20).cast("bigint") % 2 == 0)
    d = V.price_drops(v, cut())
    return d.select("unit_key", "before", "after", ts("valid_to").alias("valid_to"), rnd(F.col("change")).alias("change"))


EARLY_SQL = """
firsts0 AS (SELECT min(captured) AS f FROM captures GROUP BY unit_key),
cutoff AS (SELECT epoch_us(min(f)) + (epoch_us(max(f)) - epoch_us(min(f))) // 10 AS until_us FROM firsts0),
early AS (SELECT captures.* FROM captures, cutoff WHERE epoch_us(captured) <= until_us)"""


@query("new_units_antijoin", sql_with(CAPTURES_SQL, CAPT_RATES_SQL, EARLY_SQL, islands("early", "vers"), final=f"""
SELECT unit_key, {ts_sql('valid_from')} AS valid_from FROM vers v WHERE valid_to IS NULL AND valid_from >= TIMESTAMP '2024-01-01' AND fetched_at >= TIMESTAMP '2024-01-01'
AND NOT EXISTS (SELECT 1 FROM vers h WHERE h.unit_key = v.unit_key AND h.valid_to IS NOT NULL)"""))
def new_units_q(t):
    """Units without history as of the time when a tenth of the span of first sightings had passed: then some have one version only."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first = t.captures.groupBy("unit_key").agg(F.min("captured").alias("_f")).agg(F.min(us("_f")).alias("_lo"), F.max(us("_f")).alias("_hi"))
    early = t.captures.crossJoin(F.broadcast(first)).where(us("captured") <= F.expr("_lo + (_hi - _lo) div 10")).drop("_lo", "_hi")  # one row
    v = V.new_units(V.versions(V.one_per_instant(early), ["zone"]), F.lit("2024-01-01").cast("timestamp_ntz"))
    return v.select("unit_key", ts("valid_from").alias("valid_from"))


@query("market_delta", sql_with(*VERS, CHANGES_SQL, final=f"""
, scopez AS (SELECT DISTINCT zone FROM vers WHERE fetched_at >= TIMESTAMP '{CUT}' AND zone IS NOT NULL),
cur AS (SELECT v.*, s.zone IS NOT NULL AS ins, valid_from < TIMESTAMP '{CUT}' AS old, fetched_at >= TIMESTAMP '{CUT}' AS seen FROM vers v LEFT JOIN scopez s USING (zone) WHERE valid_to IS NULL)
SELECT *, CASE WHEN seen_before > 0 THEN seen_now::DOUBLE/seen_before ELSE 1.0 END AS coverage FROM (
 SELECT count(*) FILTER (old AND NOT seen AND ins) AS gone, count(*) FILTER (old AND NOT seen AND NOT ins) AS out_of_scope, count(*) FILTER (old AND seen) AS unchanged,
  count(*) FILTER (old AND ins) AS seen_before, count(*) FILTER (seen AND ins) AS seen_now,
  (SELECT count(*) FROM changed WHERE convertible AND change < 0) AS dropped, (SELECT count(*) FROM changed WHERE convertible AND change > 0) AS raised, (SELECT count(*) FROM changed WHERE NOT convertible) AS not_convertible,
  (SELECT count(*) FROM cur c WHERE NOT old AND seen AND NOT EXISTS (SELECT 1 FROM vers h WHERE h.unit_key=c.unit_key AND h.valid_to IS NOT NULL)) AS new_units,
  (SELECT count(DISTINCT CAST(valid_from AS DATE)) FROM vers WHERE valid_from < TIMESTAMP '{CUT}') AS previous_captures, (SELECT count(*) FROM scopez) AS zones_visited FROM cur)"""))
def market_delta_q(t):
    """Market change counters around a cut date."""
    return V.market_delta(versions_of(t), capture_rates(t), cut())


@query("microunit_sale", sql_with(*VERS, final=f"""
, pu AS (SELECT unit_key, CAST(substr(unit_key,2) AS BIGINT) % 90 + 10 AS m2, min(valid_from) AS f, max(fetched_at) AS l, arg_min(price_uf, valid_from) AS p0, arg_max(price_uf, valid_from) AS p1 FROM vers WHERE price_uf IS NOT NULL GROUP BY 1, 2)
SELECT CASE WHEN m2<25 THEN '<25' WHEN m2<35 THEN '25-35' WHEN m2<50 THEN '35-50' WHEN m2<70 THEN '50-70' ELSE '70+' END AS band, count(*) AS n,
 round(avg(CASE WHEN l < TIMESTAMP '2024-01-30' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6)+0.0 AS share_not_seen, round(avg(CASE WHEN p1 < p0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6)+0.0 AS share_dropped
FROM pu WHERE f < TIMESTAMP '2024-01-10' GROUP BY 1"""))
def microunit_sale_q(t):
    """Sale liquidity of small units by band."""
    v = versions_of(t).withColumn("m2", (F.substring("unit_key", 2, 20).cast("bigint") % 90 + 10).cast("double"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    o = R.microunit_sale(v, at("2024-01-10 00:00:00"), at("2024-01-30 00:00:00"))
    return o.select("band", "n", rnd(F.col("share_not_seen")).alias("share_not_seen"), rnd(F.col("share_dropped")).alias("share_dropped"))


SIGHT_SQL = """
sight AS (SELECT CAST(CASE WHEN day(ts) > 15 THEN ts + INTERVAL 60 DAY ELSE ts END AS DATE) AS day, user_id AS listing_id, 'z'||(user_id % 20) AS zone,
  lower(trim(event_type))||' '||floor(value/15)::BIGINT AS title, floor(value/3)::DOUBLE AS m2 FROM events),
days AS (SELECT DISTINCT day FROM sight),
gaps AS (SELECT day, date_diff('day', lag(day) OVER (ORDER BY day), day) AS gap FROM days),
split AS (SELECT arg_max(day, (gap, day)) AS split_day, max(gap) AS gap_days FROM gaps WHERE gap IS NOT NULL)"""


def sightings(t):
    e = t("events")
    day = F.to_date(F.when(F.dayofmonth("ts") > 15, F.col("ts") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("ts")))
    return e.select(day.alias("day"), F.col("user_id").alias("listing_id"), F.concat(F.lit("z"), (F.col("user_id") % 20).cast("string")).alias("zone"),
                    F.concat(F.lower(F.trim("event_type")), F.lit(" "), F.floor(F.col("value") / 15).cast("string")).alias("title"),
                    F.floor(F.col("value") / 3).cast("double").alias("m2"))


@query("snapshot_split", sql_with(SIGHT_SQL, final="SELECT CAST(split_day AS VARCHAR) AS split_day, CAST(gap_days AS INTEGER) AS gap_days FROM split"))
def split_q(t):
    """Largest gap between capture days."""
    return V.campaign_split(sightings(t)).withColumn("split_day", F.col("split_day").cast("string"))


@query("permanence", sql_with(SIGHT_SQL, final="""
, pl AS (SELECT DISTINCT zone, title, m2, day < split_day AS old, listing_id FROM sight, split WHERE gap_days >= 21),
sig AS (SELECT zone, title, m2, count(*) FILTER (old) AS a, count(*) FILTER (NOT old) AS b FROM pl GROUP BY 1,2,3)
SELECT zone, count(*) FILTER (a=1) AS before, count(*) FILTER (b=1) AS now, count(*) FILTER (a=1 AND b=1) AS remain,
  round(count(*) FILTER (a=1 AND b=1)::DOUBLE/count(*) FILTER (a=1),6)+0.0 AS share FROM sig GROUP BY 1 HAVING count(*) FILTER (a=1) >= 8 AND count(*) FILTER (b=1) >= 8"""))
def permanence_q(t):
    """Listings that stay published between two campaigns, per zone."""
    return V.permanence(sightings(t)).withColumn("share", rnd(F.col("share")))


@query("upsert_last", """
SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_last_q(t):
    """Last write wins per natural key."""
    e = t("events").select("user_id", "event_type", "value", "event_id", "ts")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return V.upsert_last(e.where(half), e.where(~half), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("upsert_earliest", f"""
SELECT user_id, arg_max(value, (ts, event_id)) AS value, {ts_sql('min(ts)')} AS first_seen, CAST(min(CASE WHEN event_type='view' THEN CAST(ts AS DATE) END) AS VARCHAR) AS published_on FROM events GROUP BY 1""")
def upsert_earliest_q(t):
    """Upsert that keeps the earliest known dates, whatever the replay order."""
    e = t("events").withColumn("first_seen", F.col("ts")).withColumn("published_on", F.when(F.col("event_type") == "view", F.to_date("ts")))
    o = V.upsert_earliest(e, "user_id", ["value"], ["first_seen", "published_on"], ["ts", "event_id"])
    return o.select("user_id", "value", ts("first_seen").alias("first_seen"), F.col("published_on").cast("string").alias("published_on"))


TWO_SQL = """
prim AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 100 AS value FROM orders GROUP BY 1 HAVING day(CAST(o_orderdate AS DATE)) % 5 <> 0),
fall AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 100 AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"""


def two_sources(t):
    o = t("orders").withColumn("day", F.to_date("o_orderdate"))
    prim = o.groupBy("day").agg(exact_avg("o_totalprice").alias("value")).where(F.dayofmonth("day") % 5 != 0)
    fall = o.where("o_orderstatus <> 'P'").groupBy("day").agg(exact_avg("o_totalprice").alias("value"))
    return prim, fall


@query("fill_gaps", sql_with(TWO_SQL, final="""
SELECT CAST(day AS VARCHAR) AS day, round(value,6)+0.0 AS value, source FROM (SELECT *, 'primary' AS source FROM prim UNION ALL SELECT *, 'fallback' FROM fall WHERE day NOT IN (SELECT day FROM prim))"""))
def fill_gaps_q(t):
    """Fallback rows only where the primary source has none."""
    a, b = two_sources(t)
    f = V.fill_gaps(a.withColumn("source", F.lit("primary")), b.withColumn("source", F.lit("fallback")), ["day"])
    return f.select(F.col("day").cast("string").alias("day"), rnd(F.col("value")).alias("value"), "source")


@query("source_discrepancy", sql_with(TWO_SQL, final="""
SELECT CAST(day AS VARCHAR) AS day, round(abs(f.value-p.value)/abs(p.value),6)+0.0 AS gap FROM prim p JOIN fall f USING (day) WHERE abs(f.value-p.value)/abs(p.value) > 0.05"""))
def discrepancy_q(t):
    """Days where two sources differ by more than the tolerance."""
    a, b = two_sources(t)
    d = V.source_discrepancies(a, b, ["day"], 0.05)
    return d.select(F.col("day").cast("string").alias("day"), rnd(F.col("gap")).alias("gap"))


@query("dim_merge", """
SELECT coalesce(a.zone, b.zone) AS zone, coalesce(b.name, a.name) AS name, coalesce(b.centre, a.centre) AS centre FROM
 (SELECT s_nationkey AS zone, min(s_name) AS name, round(max(s_acctbal),2) AS centre FROM supplier GROUP BY 1) a FULL JOIN
 (SELECT c_nationkey AS zone, CASE WHEN c_nationkey % 2 = 0 THEN min(c_name) END AS name, CAST(NULL AS DOUBLE) AS centre FROM customer GROUP BY 1) b ON a.zone = b.zone""")
def dim_merge_q(t):
    """Dimension merge: incoming non-NULL values replace, new keys are inserted."""
    a = t("supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(F.min("s_name").alias("name"), F.round(F.max("s_acctbal"), 2).alias("centre"))
    b = t("customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.min("c_name").alias("n")).select(
        "zone", F.when(F.col("zone") % 2 == 0, F.col("n")).alias("name"), F.lit(None).cast("double").alias("centre"))
    return V.update_or_insert(a, b, ["zone"], ["name", "centre"])


@query("best_rate", """
SELECT CAST(day AS VARCHAR) AS day, bank, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS offer, min(o_totalprice) AS rate FROM
 (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, o_orderpriority AS bank, o_orderkey, o_totalprice FROM orders) GROUP BY 1, 2""")
def best_rate_q(t):
    """Cheapest offer per date and bank."""
    o = t("orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("day"), F.col("o_orderpriority").alias("bank"),
                           F.col("o_totalprice").alias("rate"), F.col("o_orderkey").alias("offer"))
    return V.best_rate(o, ["day", "bank"], "rate").withColumn("day", F.col("day").cast("string"))


@query("dim_change_count", """
SELECT count(*) AS compared, count(*) FILTER (seg <> c_mktsegment OR bal IS DISTINCT FROM c_acctbal) AS changed, count(*) FILTER (seg <> c_mktsegment) AS changed_segment, count(*) FILTER (bal IS DISTINCT FROM c_acctbal) AS changed_balance
FROM (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN 'NEW' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)""")
def dim_change_q(t):
    """Dimension rows an incoming batch would change, NULL-safe."""
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    new = c.select("k", F.when(F.col("k") % 9 == 0, "NEW").otherwise(F.col("segment")).alias("segment"), F.when(F.col("k") % 6 != 0, F.col("balance")).alias("balance"))
    return V.changed_dimensions(c, new, "k", ["segment", "balance"])


@query("pending_geocode", """
SELECT s_suppkey AS project, n_name AS place FROM supplier s JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal < 5000 AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.s_suppkey AND c.c_acctbal > 3000)
 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l_returnflag = 'A' AND l_linestatus = 'O')""")
def pending_geocode_q(t):
    """Projects without coordinates, not geocoded yet, that have a current "from" price."""
    proj = t("supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("project"), "s_nationkey")
    done = t("customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("project"))
    live = t("lineitem").where("l_returnflag = 'A' and l_linestatus = 'O'").select(F.col("l_suppkey").alias("project"))
    places = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("place"))
    return proj.join(done, "project", "left_anti").join(live, "project", "left_semi").join(places, "s_nationkey").select("project", "place")
