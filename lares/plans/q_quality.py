"""Quality gates and suspicious-row queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import rnd
from lares.operators import quality as Q
from lares.operators import rent as R
from lares.operators.quantiles import grouped_quantiles
from lares.params import DEFAULT, PRICE_RANGES
from lares.plans.bindings import NOW, PART_SQL, RATES_SQL, RENTS_ONLY_SQL, RENTS_SQL, UNITS_SQL
from lares.plans.q_match import IMPLAUSIBLE
from lares.plans.q_rent import COMPS, comps_of
from lares.plans.registry import query, sql_with

RV_SQL = """
rv AS (SELECT comp_id AS key, zone, m2, rent_clp, coalesce(rent_uf, rent_clp/rate)/m2 AS per_m2 FROM rents LEFT JOIN rate_on ON seen = valid_day
  WHERE active AND zone IS NOT NULL AND m2 > 0 AND coalesce(rent_uf, rent_clp/rate) IS NOT NULL)"""
SV_SQL = """
sv AS (SELECT unit_key AS key, zone, m2, coalesce(price_uf, price_clp/rate)/m2 AS per_m2 FROM units LEFT JOIN rate_on ON seen = valid_day
  WHERE zone IS NOT NULL AND m2 > 0 AND coalesce(price_uf, price_clp/rate) IS NOT NULL)"""


def fence_sql(src: str) -> str:
    return f"""SELECT zone, q1 - mg AS lo, q3 + mg AS hi, n AS n_values FROM (SELECT *, greatest(3*(q3-q1), abs(q2)*0.1) AS mg FROM (
   SELECT zone, quantile_cont(per_m2,0.25) AS q1, quantile_cont(per_m2,0.5) AS q2, quantile_cont(per_m2,0.75) AS q3, count(*) AS n FROM {src} GROUP BY 1)) WHERE n >= 3"""


@query("outlier_fence", sql_with(RENTS_SQL, RATES_SQL, RV_SQL, final=f"SELECT zone, round(lo,6)+0.0 AS lo, round(hi,6)+0.0 AS hi, n_values FROM ({fence_sql('rv')})"))
def fence_q(t):
    """Robust fence of rent per m2 per zone."""
    f = Q.fences(Q.rent_values(t.rents, t.rates), "zone", F.col("per_m2"))
    return f.select("zone", rnd(F.col("lo")).alias("lo"), rnd(F.col("hi")).alias("hi"), "n_values")


PROMO_SQL = """
cl AS (SELECT zone, rent_clp, count(*) AS members, list_sort(list(m2))[count(*)//2+1] AS size, list_sort(list(per_m2))[count(*)//2+1] AS level FROM rv WHERE rent_clp IS NOT NULL GROUP BY 1,2 HAVING count(*) >= 3),
peers AS (SELECT rv.* FROM rv LEFT JOIN cl ON rv.zone=cl.zone AND rv.rent_clp=cl.rent_clp WHERE cl.zone IS NULL),
csz AS (SELECT DISTINCT zone, size FROM cl),
ref AS (SELECT s.zone, s.size, list_sort(list(per_m2))[count(*)//2+1] AS reference, count(*) AS peers FROM csz s JOIN peers p ON s.zone=p.zone AND abs(p.m2-s.size) <= s.size*0.25 GROUP BY 1,2 HAVING count(*) >= 5),
promo AS (SELECT cl.*, reference, peers, level < reference*0.75 AS flagged FROM cl JOIN ref USING (zone, size))"""


@query("promo_cluster", sql_with(RENTS_SQL, RATES_SQL, RV_SQL, PROMO_SQL, final="""
SELECT zone, rent_clp, members, size, round(level,6)+0.0 AS level, round(reference,6)+0.0 AS reference, peers, flagged FROM promo"""))
def promo_q(t):
    """Promotional clusters: exact price repeated, far below similar-size peers."""
    c = Q.promo_clusters(Q.rent_values(t.rents, t.rates))
    return c.select("zone", "rent_clp", "members", "size", rnd(F.col("level")).alias("level"), rnd(F.col("reference")).alias("reference"), "peers", "flagged")


@query("suspicious_rent", sql_with(RENTS_SQL, RATES_SQL, RV_SQL, PROMO_SQL, final=f"""
, pf AS (SELECT zone, rent_clp FROM promo WHERE flagged), rest AS (SELECT rv.* FROM rv LEFT JOIN pf ON rv.zone=pf.zone AND rv.rent_clp=pf.rent_clp WHERE pf.zone IS NULL)
SELECT key, 'promo' AS why FROM rv JOIN pf ON rv.zone=pf.zone AND rv.rent_clp=pf.rent_clp
UNION ALL SELECT key, 'fence' FROM rest JOIN ({fence_sql('rest')}) f ON rest.zone = f.zone WHERE per_m2 < lo OR per_m2 > hi"""))
def suspicious_rent_q(t):
    """Suspicious rent listings: promotional clusters, then fence."""
    return Q.suspicious_rents(t.rents, t.rates)


@query("suspicious_sale", sql_with(PART_SQL, UNITS_SQL, RATES_SQL, SV_SQL, final=f"SELECT key, 'fence' AS why FROM sv JOIN ({fence_sql('sv')}) f ON sv.zone = f.zone WHERE per_m2 < lo OR per_m2 > hi"))
def suspicious_sale_q(t):
    """Suspicious units for sale."""
    return Q.suspicious_sales(t.units, t.rates)


EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]{2,}"


#: Without look-around: the character before and after a hit is part of it. A phone hit may not follow a listing code.
PHONE_HIT = r"(^|[^\d])(\+?56[\s.-]?)?9[\s.-]?\d{4}[\s.-]?\d{4}([^\d]|$)"
TAX_HIT = r"(^|[^\d])(\d{1,2}\.?\d{3}\.?\d{3})[-‐][\dkK]([^\w-]|$)"


@query("pii_scan", f"""
WITH cells AS (SELECT doc_id, unnest([struct_pack("column" := 'text', value := text), struct_pack("column" := 'lang', value := lang), struct_pack("column" := 'source', value := source)], recursive := true) FROM documents)
SELECT doc_id, "column", 'email' AS kind FROM cells WHERE regexp_matches(value, '{EMAIL}')
UNION ALL SELECT doc_id, "column", 'phone' FROM cells WHERE regexp_matches(replace(value, 'MLC-', 'MLC-0'), '{PHONE_HIT}')
UNION ALL SELECT doc_id, "column", 'tax_id' FROM cells WHERE coalesce(TRY_CAST(regexp_replace(nullif(regexp_extract(value, '{TAX_HIT}', 2), ''), '[^0-9]', '', 'g') AS BIGINT) < 60000000, FALSE)""")
def pii_scan_q(t):
    """Rows, columns and kinds of personal data over all string columns; whole texts are read."""
    return Q.pii_rows(t("documents"), "doc_id")


@query("provenance_check", """
SELECT 'provenance' AS "check", CASE WHEN count(*) FILTER (bad) > 0 THEN 'FAIL' ELSE 'OK' END AS severity, count(*) FILTER (bad) AS affected FROM (
 SELECT d.doc_id, (q.doc_id IS NULL OR d.source = '' OR d.lang = '') AS bad FROM documents d LEFT JOIN labels q ON d.doc_id = q.doc_id)""")
def provenance_q(t):
    """Rows with incomplete provenance; the sidecar of a document is its label row."""
    return Q.provenance_check(_with_provenance(t))


def _with_provenance(t):
    side = t("labels").select("doc_id", F.lit("1.0").alias("parser_version"), F.lit("sha").alias("robots_snapshot_sha"))
    return t("documents").join(side, "doc_id", "left").select(
        "doc_id", F.col("source").alias("source_id"), F.col("lang").alias("source_url"), F.lit(NOW).alias("fetched_at"),
        "parser_version", F.concat(F.lit("raw/"), F.col("doc_id")).alias("raw_blob_path"), "robots_snapshot_sha")


@query("coverage_check", sql_with(PART_SQL, UNITS_SQL, final="""
SELECT 'coverage' AS "check", CASE WHEN good::DOUBLE/n < 0.8 THEN 'ALERT' ELSE 'OK' END AS severity, CAST(CASE WHEN good::DOUBLE/n < 0.8 THEN n-good ELSE 0 END AS BIGINT) AS affected
FROM (SELECT count(*) AS n, count(*) FILTER (price_uf <> 0 AND zone IS NOT NULL AND evidence IN ('V','D')) AS good FROM units)"""))
def coverage_q(t):
    """Share of units with price, zone and verified evidence."""
    return Q.coverage_check(t.units)


@query("freshness_check", sql_with(RENTS_SQL, final=f"""
SELECT 'freshness' AS "check", CASE WHEN n > 0 THEN 'ALERT' ELSE 'OK' END AS severity, n AS affected FROM (
 SELECT count(*) FILTER (seen < DATE '{NOW}' - INTERVAL 21 DAY AND district <> 'c0') AS n FROM (SELECT seen, coalesce(district,'c9') AS district FROM rents))"""))
def freshness_check_q(t):
    """Stale rows of live sources; district c0 plays the exempt historical source."""
    r = t.rents.withColumn("source_id", F.coalesce("district", F.lit("c9")))
    return Q.freshness_check(r, t.now, ["c0"])


@query("plausibility_check", sql_with(PART_SQL, UNITS_SQL, final=f"""
SELECT 'plausibility' AS "check", CASE WHEN n > 0 THEN 'ALERT' ELSE 'OK' END AS severity, n AS affected FROM (SELECT count({IMPLAUSIBLE.format(p='price_uf', m='m2')}) AS n FROM units)"""))
def plausibility_q(t):
    """Units outside the plausible ranges."""
    return Q.plausibility_check(t.units)


@query("dup_natural_key", """
SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_key_q(t):
    """Natural keys held by more than one open version (returned lines play closed versions)."""
    li = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("valid_to"))
    return Q.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


@query("dup_within_window", """
WITH l AS (SELECT l_partkey, l_quantity, l_linenumber, CAST(l_shipdate AS DATE) AS d, row_number() OVER (ORDER BY l_partkey, l_quantity, l_linenumber, l_shipdate, l_orderkey, l_suppkey, l_extendedprice) AS id FROM lineitem)
SELECT a.l_partkey, a.l_quantity, a.l_linenumber, count(*) AS pairs FROM l a JOIN l b ON a.l_partkey=b.l_partkey AND a.l_quantity=b.l_quantity AND a.l_linenumber=b.l_linenumber AND a.id < b.id
 AND abs(date_diff('day', a.d, b.d)) <= 30 GROUP BY 1,2,3""")
def dup_window_q(t):
    """Pairs with one key at most thirty days apart, counted without pairing."""
    li = t("lineitem").select("l_partkey", "l_quantity", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    return Q.duplicates_within(li, ["l_partkey", "l_quantity", "l_linenumber"], "day")


ANCHOR_SQL = """
meds AS (SELECT district AS "group", quantile_cont(per_m2, 0.5) AS value FROM (SELECT district, rent/m2 AS per_m2 FROM (SELECT *, split_part(zone,'/',1) AS district FROM comps)) GROUP BY 1),
refs AS (SELECT 'c'||r_regionkey AS "group", 0.08 + 0.02*r_regionkey AS reference FROM region WHERE r_regionkey < 4)"""


def rent_medians(t):
    c = comps_of(t).withColumn("group", F.split("zone", "/")[0])
    return grouped_quantiles(c, ["group"], F.col("rent") / F.col("m2"), {"value": 0.5}).drop("n_values")


def refs(t):
    k = F.col("r_regionkey")
    return t("region").where(k < 4).select(F.concat(F.lit("c"), k.cast("string")).alias("group"), (0.08 + 0.02 * k).alias("reference"))


@query("anchor_check", sql_with(*COMPS, ANCHOR_SQL, final="""
SELECT "group", round(value,6)+0.0 AS value, round(abs(value-reference)/reference,6)+0.0 AS deviation, CASE WHEN reference IS NULL THEN 'unverified' WHEN abs(value-reference)/reference > 0.25 THEN 'deviates' ELSE 'within' END AS state
FROM meds LEFT JOIN refs USING ("group")"""))
def anchor_q(t):
    """Median rent per m2 by district against a published reference."""
    a = Q.anchor_check(rent_medians(t), refs(t), DEFAULT.anchor_rent_max)
    return a.select("group", rnd(F.col("value")).alias("value"), rnd(F.col("deviation")).alias("deviation"), "state")


@query("used_discount", sql_with(PART_SQL, UNITS_SQL, final="""
SELECT m."group", m.value, r.reference, round((m.value-r.reference)/r.reference,6)+0.0 AS spread FROM
 (SELECT district AS "group", list_sort(list(price_uf/m2))[count(*)//2+1] AS value FROM units WHERE NOT is_new AND price_uf IS NOT NULL AND m2 > 0 AND district IS NOT NULL GROUP BY 1) m
 JOIN (SELECT district AS "group", list_sort(list(price_uf/m2))[count(*)//2+1] AS reference FROM units WHERE is_new AND price_uf IS NOT NULL AND m2 > 0 AND district IS NOT NULL GROUP BY 1) r USING ("group")"""))
def used_q(t):
    """Used stock against the new-stock reference per district (upper medians)."""
    from lares.operators.quantiles import upper_median
    u = t.units.where("price_uf is not null and m2 > 0 and district is not null").withColumn("v", F.col("price_uf") / F.col("m2")).withColumnRenamed("district", "group")
    q = lambda cond, name: grouped_quantiles(u.where(cond), ["group"], F.col("v"), {name: upper_median()}).drop("n_values")
    return Q.used_discount(q("not is_new", "value"), q("is_new", "reference")).withColumn("spread", rnd(F.col("spread")))


@query("gate_status", sql_with(PART_SQL, UNITS_SQL, final=f"""
, f AS (SELECT CASE WHEN good::DOUBLE/n < 0.8 THEN 'ALERT' ELSE 'OK' END AS severity, CAST(CASE WHEN good::DOUBLE/n < 0.8 THEN n-good ELSE 0 END AS BIGINT) AS affected FROM (SELECT count(*) AS n, count(*) FILTER (price_uf <> 0 AND zone IS NOT NULL AND evidence IN ('V','D')) AS good FROM units)
 UNION ALL SELECT CASE WHEN n > 0 THEN 'ALERT' ELSE 'OK' END, n FROM (SELECT count({IMPLAUSIBLE.format(p='price_uf', m='m2')}) AS n FROM units)
 UNION ALL SELECT CASE WHEN n > 0 THEN 'ALERT' ELSE 'OK' END, n FROM (SELECT count(*) AS n FROM units WHERE seen < DATE '{NOW}' - INTERVAL 21 DAY)
 UNION ALL SELECT CASE WHEN n > 0 THEN 'FAIL' ELSE 'OK' END, n FROM (SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels q WHERE q.doc_id=d.doc_id))
 UNION ALL SELECT CASE WHEN n > 0 THEN 'FAIL' ELSE 'OK' END, n FROM (SELECT count(*) AS n FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)))
SELECT CASE max(CASE severity WHEN 'FAIL' THEN 4 WHEN 'ALERT' THEN 3 WHEN 'MARK' THEN 2 ELSE 1 END) WHEN 4 THEN 'RED' WHEN 3 THEN 'PARTIAL' ELSE 'GREEN' END AS status,
 count(*) FILTER (severity='OK') AS n_ok, count(*) FILTER (severity='MARK') AS n_mark, count(*) FILTER (severity='ALERT') AS n_alert, count(*) FILTER (severity='FAIL') AS n_fail, CAST(sum(affected) AS BIGINT) AS affected FROM f"""))
def gate_q(t):
    """Roll-up of the gates to one status."""
    u = t.units.withColumn("source_id", F.lit("portal")).withColumn("valid_to", F.lit(None).cast("date"))
    dups = Q.finding_from(Q.duplicate_keys(u, ["unit_key"]), "duplicates", "FAIL")
    return Q.gate_status([Q.coverage_check(u), Q.plausibility_check(u), Q.freshness_check(u, t.now, []), Q.provenance_check(_with_provenance(t)), dups])


RUNS_SQL = """
runs AS (SELECT event_type AS source_id, CAST(ts AS DATE) AS ended, count(*) AS "rows", count(*) % 3 <> 0 AS ok FROM events GROUP BY 1, 2)"""


def runs_of(t):
    return t("events").groupBy(F.col("event_type").alias("source_id"), F.to_date("ts").alias("ended")).agg(
        F.count("*").alias("rows")).withColumn("ok", F.col("rows") % 3 != 0)


@query("run_drop_detector", sql_with(RUNS_SQL, final="""
SELECT source_id, CAST(ended AS VARCHAR) AS ended, "rows", previous, round((previous-"rows")::DOUBLE/previous,6)+0.0 AS "drop", coalesce((previous-"rows")::DOUBLE/previous > 0.3, FALSE) AS alarm FROM (
 SELECT *, last_value(CASE WHEN ok THEN "rows" END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM runs)"""))
def run_drop_q(t):
    """Row-count drop of each run against the last successful one of its source."""
    d = Q.run_drops(runs_of(t))
    return d.select("source_id", F.col("ended").cast("string").alias("ended"), "rows", "previous", rnd(F.col("drop")).alias("drop"), "alarm")


RANGE_SQL = " OR ".join(f"(op='{o}' AND cur='{c}' AND amount BETWEEN {int(lo)} AND {int(hi)})" for o, c, lo, hi in PRICE_RANGES)


@query("range_by_kind", sql_with(PART_SQL, UNITS_SQL, RENTS_ONLY_SQL, final=f"""
SELECT op, cur, count(*) AS n, count(*) FILTER ({RANGE_SQL}) AS plausible FROM (
 SELECT 'sale' AS op, CASE WHEN price_uf IS NOT NULL THEN 'UF' ELSE 'CLP' END AS cur, coalesce(price_uf, price_clp) AS amount FROM units
 UNION ALL SELECT 'rent', CASE WHEN rent_uf IS NOT NULL THEN 'UF' ELSE 'CLP' END, coalesce(rent_uf, rent_clp) FROM rents) GROUP BY 1, 2"""))
def range_q(t):
    """Plausible price range by operation and currency."""
    from lares.functions.exprs import in_kind_range
    s = t.units.select(F.lit("sale").alias("op"), F.when(F.col("price_uf").isNotNull(), "UF").otherwise("CLP").alias("cur"), F.coalesce("price_uf", "price_clp").alias("amount"))
    r = t.rents.select(F.lit("rent").alias("op"), F.when(F.col("rent_uf").isNotNull(), "UF").otherwise("CLP").alias("cur"), F.coalesce("rent_uf", "rent_clp").alias("amount"))
    return s.unionByName(r).groupBy("op", "cur").agg(F.count("*").alias("n"), F.count_if(in_kind_range(F.col("op"), F.col("cur"), F.col("amount"))).alias("plausible"))


SEARCH_SQL = """r AS (SELECT DISTINCT 'q'||(user_id % 45) AS search, floor(value)*3 + user_id % 3 AS id FROM events), sz AS (SELECT search, count(*) AS n FROM r GROUP BY 1)"""


@query("search_overlap", sql_with(SEARCH_SQL, final="""
SELECT a.search AS a, b.search AS b, count(*) AS common, least(any_value(x.n), any_value(y.n)) AS smaller FROM r a JOIN r b ON a.id=b.id AND a.search < b.search JOIN sz x ON x.search=a.search JOIN sz y ON y.search=b.search
GROUP BY 1, 2 HAVING count(*) >= 0.5*least(any_value(x.n), any_value(y.n))"""))
def overlap_q(t):
    """Searches whose results overlap by half of the smaller set."""
    u = F.col("user_id")
    r = t("events").select(F.concat(F.lit("q"), (u % 45).cast("string")).alias("search"), (F.floor("value") * 3 + u % 3).alias("id"))
    return Q.overlapping_searches(r).select("a", "b", "common", "smaller")


@query("content_collision", """
WITH d AS (SELECT sha256(text) AS sha, source AS search, count(*) AS documents FROM documents GROUP BY 1, 2)
SELECT sha, search, documents, searches FROM d JOIN (SELECT sha, count(*) AS searches FROM d GROUP BY 1 HAVING count(*) > 1) USING (sha)""")
def collision_q(t):
    """Identical content served to different searches."""
    return Q.content_collisions(t("documents").select(F.sha2("text", 256).alias("sha"), F.col("source").alias("search")))


@query("key_match_rate", """
WITH a AS (SELECT upper('b-'||p_partkey||'.k') AS k FROM part), b AS (SELECT DISTINCT 'B'||c_custkey||'K' AS k FROM customer)
SELECT count(*) AS n, count(b.k) AS matched, round(count(b.k)::DOUBLE/count(*),6)+0.0 AS rate FROM (SELECT regexp_replace(k,'[^A-Z0-9]','','g') AS k FROM a) a LEFT JOIN b USING (k)""")
def key_match_q(t):
    """Match rate of normalised keys."""
    a = t("part").select(F.concat(F.lit("b-"), F.col("p_partkey").cast("string"), F.lit(".k")).alias("key"))
    b = t("customer").select(F.concat(F.lit("B"), F.col("c_custkey").cast("string"), F.lit("_k")).alias("key"))
    m = Q.key_match_rate(a, b)
    return m.withColumn("rate", rnd(F.col("rate")))
