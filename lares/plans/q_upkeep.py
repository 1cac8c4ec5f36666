"""Replay, table store, incremental versions and streams, with their reference SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lares.functions.exprs import rnd
from lares.operators import compare as C
from lares.operators import rent as R
from lares.operators import quality as Q
from lares.operators import selftest as T
from lares.operators import versions as V
from lares.operators.order import numbered
from lares.operators.quantiles import grouped_quantiles
from lares.plans.bindings import CAPTURES_SQL, PART_SQL, UNITS_SQL
from lares.plans.q_rent import BANDS, CELLS_SQL, COMPS, comps_of
from lares.plans.q_versions import VER_COLS_SQL, islands, show, ts, ts_sql, versions_of
from lares.plans.registry import query, sql_with
from lares.session import cut, shared_dir
from lares.sources import feeds, pages, replay
from lares.sources.store import TableStore
from lares.streaming import captures as S

# ----------------------------------------------------------------- replay

SOURCE_SQL = "CASE WHEN event_type IN ('view', 'click') THEN 'feed_json' WHEN event_type = 'purchase' THEN 'legacy' ELSE 'feed_lines' END"
BLOBS_SQL = f"""
blobs AS (SELECT c.*, {SOURCE_SQL} AS source_id, value > 400 AND value < 410 AS broken, value < 4 AS bare FROM captures c JOIN (SELECT event_id, event_type, value FROM events) e USING (event_id)),
good AS (SELECT * FROM blobs WHERE source_id <> 'legacy' AND NOT broken AND NOT bare)"""


def blobs_of(t):
    """Landed documents, one a capture: JSON from one source, lines from another, a third without extractor; some are cut off, some lack metadata."""
    kinds = t("events").select("event_id", "value", F.when(F.col("event_type").isin("view", "click"), "feed_json").when(F.col("event_type") == "purchase", "legacy").otherwise("feed_lines").alias("source_id"))
    c = t.captures.select("unit_key", "captured", "price_uf", "price_clp", "zone", "event_id").join(kinds, "event_id")
    when = F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.to_json(F.struct("unit_key", when.alias("captured"), "price_uf", "price_clp", "zone", "event_id"))
    line = F.concat_ws("|", "unit_key", when, *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("price_uf", "price_clp", "zone")], F.col("event_id").cast("string"))
    content = F.when(F.col("source_id") == "feed_lines", line).otherwise(text)
    broken = (F.col("value") > 400) & (F.col("value") < 410)
    rows = c.select(F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("blob"), "source_id", F.when(broken, F.substring(content, 1, 12)).otherwise(content).alias("content"), (F.col("value") < 4).alias("_bare"))
    return rows.drop("_bare"), rows.where("NOT _bare").select("blob")


def replayed_of(t):
    blobs, metadata = blobs_of(t)
    return replay.replayed(blobs, metadata, {"feed_json": replay.json_captures, "feed_lines": replay.line_captures})


@query("replay_versions", sql_with(CAPTURES_SQL, BLOBS_SQL, islands("good", "vers"), final=f"""
, o AS (SELECT zone, quantile_cont(price_uf, 0.25) AS q1, quantile_cont(price_uf, 0.5) AS q2, quantile_cont(price_uf, 0.75) AS q3 FROM vers WHERE valid_to IS NULL AND price_uf IS NOT NULL AND zone IS NOT NULL GROUP BY zone HAVING count(*) >= 3)
SELECT {VER_COLS_SQL}, coalesce(valid_to IS NULL AND (price_uf < q1 - greatest(3 * (q3 - q1), abs(q2) * 0.1) OR price_uf > q3 + greatest(3 * (q3 - q1), abs(q2) * 0.1)), FALSE) AS suspicious FROM vers LEFT JOIN o USING (zone)"""))
def replay_versions_q(t):
    """Versions rebuilt from landed documents by each source's extractor, and flagged again."""
    v = replay.rebuilt(replayed_of(t)[0])
    return v.select("unit_key", "price_uf", "price_clp", ts("valid_from").alias("valid_from"), ts("valid_to").alias("valid_to"), ts("fetched_at").alias("fetched_at"), "suspicious")


@query("replay_errors", sql_with(CAPTURES_SQL, BLOBS_SQL, final="""
SELECT source_id, CASE WHEN bare THEN 'no_metadata' WHEN source_id = 'legacy' THEN 'no_parser' ELSE 'unreadable' END AS reason, count(*) AS n FROM blobs WHERE bare OR source_id = 'legacy' OR broken GROUP BY 1, 2"""))
def replay_errors_q(t):
    """Landed documents that can't be rebuilt, by source and reason."""
    return replayed_of(t)[1].groupBy("source_id", "reason").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- table store


def _store(t) -> TableStore:
    return TableStore(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")


@query("derived_refresh", sql_with(*COMPS, CELLS_SQL, final="SELECT zone, typ, band, n, round(rent_median,6)+0.0 AS rent_median FROM cells"))
def derived_refresh_q(t):
    """Rent cells as a derived table: refreshed twice, a third refresh that never commits is not seen."""
    store, cells = _store(t), cut(R.cells(comps_of(t), BANDS).select("zone", "typ", "band", "n", "rent_median"))
    store.put("cells", cells.where("n > 20"))
    store.put("cells", cells)
    store.stage("cells", cells.where("n > 40"))
    return store.get("cells").select("zone", "typ", "band", "n", rnd(F.col("rent_median")).alias("rent_median"))


DAYS = ("2024-01-10", "2024-01-24")
TOP_SQL = "SELECT unit_key, price_uf AS price FROM vers WHERE price_uf IS NOT NULL AND valid_from < TIMESTAMP '{d}' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{d}') ORDER BY price_uf, unit_key LIMIT 60"


def top_on(v, day: str, n: int = 60):
    at = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    live = v.where(F.col("price_uf").isNotNull() & (F.col("valid_from") < at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))
    return live.orderBy("price_uf", "unit_key").limit(n).select("unit_key", F.col("price_uf").alias("price"))


@query("snapshot_changes", sql_with(CAPTURES_SQL, islands("captures", "vers"), final=f"""
, a AS ({TOP_SQL.format(d=DAYS[0])}), b AS ({TOP_SQL.format(d=DAYS[1])})
SELECT coalesce(a.unit_key, b.unit_key) AS unit_key, a.price AS before, b.price AS after,
  CASE WHEN a.unit_key IS NULL THEN 'entered' WHEN b.unit_key IS NULL THEN 'left' WHEN b.price < a.price THEN 'price_cut' ELSE 'same' END AS state FROM a FULL JOIN b ON a.unit_key = b.unit_key"""))
def snapshot_changes_q(t):
    """The cheapest units of two days from the store of dated snapshots; the first day was run twice, a third day is not read."""
    store, v = _store(t), cut(versions_of(t))
    store.put("top", top_on(v, DAYS[0], 5), DAYS[0])
    for day in (*DAYS, "2024-01-28"):
        store.put("top", top_on(v, day), day)
    last = store.before("top", DAYS[1])
    return C.top_diff(store.get("top", last), store.get("top", DAYS[1]))


# ----------------------------------------------------------------- versions batch by batch

BATCHES = 3
_BATCH = "(event_id * 7 + event_id // 10) % 3"


def _fold_sql(b: int) -> str:
    """One batch in SQL: eligible captures behind the open version, islands, then what is closed and what stays open."""
    state = f"open{b - 1}"
    return f"""
e{b} AS (SELECT s.unit_key, s.captured, s.price, s.m2, s.event_id, o.price AS p0, o.valid_from AS f0 FROM (SELECT * FROM singles WHERE batch = {b - 1} QUALIFY row_number() OVER (PARTITION BY unit_key, captured ORDER BY event_id DESC) = 1) s LEFT JOIN {state} o USING (unit_key)),
k{b} AS (SELECT * FROM e{b} WHERE f0 IS NULL OR captured > f0 OR (captured = f0 AND price = p0)),
l{b} AS (SELECT unit_key, valid_from AS captured, price, m2, fetched_at AS seen, 0 AS o FROM {state} UNION ALL SELECT unit_key, captured, price, m2, captured, 1 FROM k{b}),
c{b} AS (SELECT *, CASE WHEN lag(price) OVER w IS NULL OR lag(price) OVER w <> price THEN 1 ELSE 0 END AS chg FROM l{b} WINDOW w AS (PARTITION BY unit_key ORDER BY captured, o)),
n{b} AS (SELECT *, sum(chg) OVER (PARTITION BY unit_key ORDER BY captured, o) AS ver FROM c{b}),
g{b} AS (SELECT unit_key, ver, min(price) AS price, min(captured) AS valid_from, max(seen) AS fetched_at, arg_min(m2, (captured, o)) FILTER (m2 IS NOT NULL) AS m2 FROM n{b} GROUP BY 1, 2),
v{b} AS (SELECT *, lead(valid_from) OVER (PARTITION BY unit_key ORDER BY ver) AS valid_to FROM g{b}),
open{b} AS (SELECT unit_key, price, valid_from, fetched_at, m2 FROM v{b} WHERE valid_to IS NULL)"""


SINGLES_SQL = f"""
singles AS (SELECT unit_key, captured, price_uf AS price, m2, event_id, {_BATCH} AS batch FROM captures WHERE price_uf IS NOT NULL),
open0 AS (SELECT unit_key, price, captured AS valid_from, captured AS fetched_at, m2 FROM singles WHERE FALSE)"""
FOLDS = (CAPTURES_SQL, SINGLES_SQL, *[_fold_sql(b) for b in range(1, BATCHES + 1)])


def folded_of(t):
    c = t.captures.select("unit_key", "captured", F.col("price_uf").alias("price"), "m2", "event_id", F.expr("(event_id * 7 + event_id div 10) % 3").alias("batch"))
    state = c.where("false").select("unit_key", "price", F.col("captured").alias("valid_from"), F.col("captured").alias("fetched_at"), "m2")
    closed, counts = [], []
    for b in range(BATCHES):
        done, state, n = V.fold_batch(state, c.where(F.col("batch") == b).drop("batch"), ["m2"])
        closed.append(done)
        counts.append(n.withColumn("batch", F.lit(b + 1)))
    return closed, state, counts


@query("scd_incremental", sql_with(*FOLDS, final="SELECT unit_key, price, {f} AS valid_from, {t} AS valid_to, {s} AS fetched_at, m2 FROM (".format(f=ts_sql("valid_from"), t=ts_sql("valid_to"), s=ts_sql("fetched_at"))
    + " UNION ALL ".join(f"SELECT unit_key, price, valid_from, valid_to, fetched_at, m2 FROM v{b} WHERE valid_to IS NOT NULL" for b in range(1, BATCHES + 1))
    + f" UNION ALL SELECT unit_key, price, valid_from, NULL, fetched_at, m2 FROM open{BATCHES})"))
def scd_incremental_q(t):
    """Versions of a single surface, kept by folding three batches in mixed order into a state of open versions."""
    closed, state, _ = folded_of(t)
    rows = state.withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    for c in closed:
        rows = rows.unionByName(c)
    return rows.select("unit_key", "price", ts("valid_from").alias("valid_from"), ts("valid_to").alias("valid_to"), ts("fetched_at").alias("fetched_at"), "m2")


@query("scd_batch_counts", sql_with(*FOLDS, final=" UNION ALL ".join(f"""
SELECT {b} AS batch, (SELECT count(*) FROM captures WHERE price_uf IS NULL AND {_BATCH} = {b - 1}) AS no_price, (SELECT count(*) FROM e{b}) - (SELECT count(*) FROM k{b}) AS out_of_order,
 (SELECT count(DISTINCT unit_key) FROM v{b}) - (SELECT count(*) FROM open{b - 1}) AS new_units, (SELECT count(*) FROM v{b}) - (SELECT count(DISTINCT unit_key) FROM v{b}) AS new_versions,
 (SELECT count(*) FROM k{b}) - (SELECT count(*) FROM v{b}) + (SELECT count(*) FROM open{b - 1}) AS confirmed""" for b in range(1, BATCHES + 1))))
def scd_batch_counts_q(t):
    """What each batch did: captures without a price, out of order, new units, new versions, confirmations."""
    _, _, counts = folded_of(t)
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ----------------------------------------------------------------- streams


@query("stream_versions", sql_with(CAPTURES_SQL, islands("captures", "vers"), final=f"SELECT {VER_COLS_SQL} FROM vers"))
def stream_versions_q(t):
    """Versions kept by a stream over files of captures, run until it has seen them all."""
    folder = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    c = t.captures.select("unit_key", "captured", "price_uf", "price_clp", "event_id")
    for half in ("event_id % 2 = 1", "event_id % 2 = 0"):  # captures arrive out of order
        c.where(half).write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(c.schema).parquet(f"{folder}/in")
        S.keep_versions(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return show(S.current_versions(t.spark, f"{folder}/out"))


@query("stream_daily_inventory", sql_with(CAPTURES_SQL, final="""
SELECT strftime(CAST(captured AS DATE), '%Y-%m-%d') AS day, surface, count(*) AS captures FROM captures
WHERE CAST(captured AS DATE) + 1 <= (SELECT max(captured) - INTERVAL 1 DAY FROM captures) GROUP BY 1, 2"""))
def stream_inventory_q(t):
    """Captures per day and surface from a stream: every day that the watermark has closed."""
    folder = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    c = t.captures.select(F.col("captured").cast("timestamp").alias("captured"), "surface")
    c.write.parquet(f"{folder}/in")
    stream = S.daily_inventory(t.spark.readStream.schema(c.schema).parquet(f"{folder}/in"))
    out = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    out.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out").select(F.col("day").cast("string").alias("day"), "surface", "captures")


# ----------------------------------------------------------------- order statistics and positions in huge groups


@query("price_quantiles", """
SELECT l_returnflag, count(*) AS n_values, round(quantile_cont(l_extendedprice, 0.05), 6)+0.0 AS p05, round(quantile_cont(l_extendedprice, 0.5), 6)+0.0 AS median, round(quantile_cont(l_extendedprice, 0.95), 6)+0.0 AS p95 FROM lineitem GROUP BY 1""")
def price_quantiles_q(t):
    """Exact order statistics of three groups that hold all rows, with no more than 2,000 distinct values ranked in one place."""
    q = grouped_quantiles(t("lineitem"), ["l_returnflag"], F.col("l_extendedprice"), {"p05": 0.05, "median": 0.5, "p95": 0.95}, most=2000)
    return q.select("l_returnflag", "n_values", *[rnd(F.col(c)).alias(c) for c in ("p05", "median", "p95")])


@query("size_positions", sql_with(PART_SQL, final="SELECT p_partkey, row_number() OVER (PARTITION BY district ORDER BY p_size, p_partkey) AS position FROM part_dims"))
def size_positions_q(t):
    """Position of every unit by size in its district: few sizes, so long runs of equal ones."""
    return numbered(t.part_dims, [F.col("p_size").asc(), F.col("p_partkey").asc()], ["district"]).select("p_partkey", F.col("position").cast("bigint").alias("position"))


# ----------------------------------------------------------------- self-test and gate

SELF_SQL = """
tested AS (
 SELECT 'required_fields' AS "check", CASE WHEN count(*) FILTER (zone IS NOT NULL AND price_uf IS NOT NULL) >= 0.95 * count(*) AND count(*) > 0 THEN 'OK' ELSE 'FAIL' END AS severity, count(*) - count(*) FILTER (zone IS NOT NULL AND price_uf IS NOT NULL) AS affected FROM good
 UNION ALL SELECT 'plausible_ranges', CASE WHEN count(*) FILTER (price_uf NOT BETWEEN 1 AND 9) > 0 THEN 'FAIL' ELSE 'OK' END, count(*) FILTER (price_uf NOT BETWEEN 1 AND 9) FROM good
 UNION ALL SELECT 'stable_count', CASE WHEN (SELECT count(*) FROM captures) - count(*) > 0.3 * (SELECT count(*) FROM captures) THEN 'FAIL' ELSE 'OK' END, (SELECT count(*) FROM captures) - count(*) FROM good
 UNION ALL SELECT 'duplicates: not evaluable', 'MARK', count(*) FROM good HAVING count(*) > 0)"""


def self_test_of(t):
    """Findings on the replayed captures; their address, part of the duplicates' key, is in no source."""
    rows, findings = T.written_and_observed(replayed_of(t)[0], ["unit_key", "captured", "zone", "price_uf"], {"price_uf": (1, 9)}, t.captures.count())
    rows = rows.withColumn("address", F.lit(None).cast("string")).withColumn("day", F.to_date("captured"))
    key = ["address", "price_uf"]
    return findings.unionByName(T.duplicates_finding(rows, key, Q.duplicates_within(rows, key, "day")))


@query("extractor_selftest", sql_with(CAPTURES_SQL, BLOBS_SQL, SELF_SQL, final="SELECT * FROM tested"))
def selftest_q(t):
    """Required fields, plausible ranges and stable count from the extractor's own write, and duplicates that can't be judged."""
    return self_test_of(t)


@query("gate_overall", sql_with(PART_SQL, UNITS_SQL, CAPTURES_SQL, BLOBS_SQL, SELF_SQL, final="""
, f AS (SELECT severity, affected FROM tested UNION ALL
  SELECT CASE WHEN good::DOUBLE/n < 0.8 THEN 'ALERT' ELSE 'OK' END, CAST(CASE WHEN good::DOUBLE/n < 0.8 THEN n-good ELSE 0 END AS BIGINT) FROM (SELECT count(*) AS n, count(*) FILTER (price_uf <> 0 AND zone IS NOT NULL AND evidence IN ('V','D')) AS good FROM units))
SELECT CASE WHEN count(*) FILTER (severity = 'FAIL') > 0 THEN 'RED' WHEN count(*) FILTER (severity = 'ALERT') > 0 THEN 'PARTIAL' ELSE 'GREEN' END AS status, count(*) FILTER (severity = 'OK') AS n_ok, count(*) FILTER (severity = 'MARK') AS n_mark,
 count(*) FILTER (severity = 'ALERT') AS n_alert, count(*) FILTER (severity = 'FAIL') AS n_fail, CAST(sum(affected) AS BIGINT) AS affected FROM f"""))
def gate_overall_q(t):
    """One status over the extractor's self-test, duplicates and the coverage of units."""
    return Q.gate_status([self_test_of(t), Q.coverage_check(t.units)])


# ----------------------------------------------------------------- stops, developer sites, dossiers

STOP_SQL = """
stops AS (SELECT c_custkey AS id, 'E'||(c_custkey % 40) AS name, CASE WHEN c_custkey % 3 > 0 THEN 'l'||(c_custkey % 3) END AS line, -33.4 + (c_custkey % 40) * 0.01 + (c_custkey % 7) * 0.0011 AS lat,
  -70.6 + (c_custkey % 11) * 0.0013 AS lon, CASE WHEN c_custkey % 4 = 0 THEN 2001 END AS opening_year FROM customer)"""


@query("station_stops", sql_with(STOP_SQL, final="""
SELECT id FROM stops a WHERE NOT EXISTS (SELECT 1 FROM stops b WHERE a.name = b.name AND a.line IS NOT DISTINCT FROM b.line AND abs(a.lat - b.lat) < 0.003 AND abs(a.lon - b.lon) < 0.003
  AND (b.opening_year IS NULL, b.id) < (a.opening_year IS NULL, a.id))"""))
def station_stops_q(t):
    """Physical stops: of stations with one name, line and state within some 300 m the dated, then the first one."""
    k = F.col("c_custkey")
    s = t("customer").select(
        k.alias("id"), F.concat(F.lit("E"), (k % 40).cast("string")).alias("name"), F.lit("metro").alias("network"), F.when(k % 3 > 0, F.concat(F.lit("l"), (k % 3).cast("string"))).alias("line"), F.lit("open").alias("status"),
        (-33.4 + (k % 40) * 0.01 + (k % 7) * 0.0011).alias("lat"), (-70.6 + (k % 11) * 0.0013).alias("lon"), F.when(k % 4 == 0, 2001).alias("opening_year"), F.lit("station").alias("outcome"))
    return feeds.collapse_stations(s).select("id")


@query("developer_site", """
SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 < 2 THEN -33.0 - (c_custkey % 900)/1000.0 END AS lat, CASE WHEN c_custkey % 3 < 2 THEN -70.125 END AS lon, CASE WHEN c_custkey % 4 > 0 THEN 30.5 + c_custkey % 20 END AS size_low, CASE WHEN c_custkey % 4 > 0 THEN 90.0::DOUBLE END AS size_high,
 'comuna '||c_nationkey AS place_slug, CASE WHEN c_custkey % 5 > 0 THEN 'en-verde' END AS status, CAST(1 + c_custkey % 4 AS INTEGER) AS beds FROM customer""")
def developer_site_q(t):
    """Developer pages: coordinates inside the country, size range and class tags."""
    k = F.col("c_custkey")
    dec = lambda x, n: F.format_string(f"%.{n}f", x)
    lat = dec(-33.0 - (k % 900) / 1000.0, 3)
    place = F.when(k % 3 == 0, F.concat(F.lit("<iframe src='m?!2d10.000!3d50.000!2d-70.125!3d"), lat, F.lit("'>"))).when(k % 3 == 1, F.concat(F.lit("<a href='https://waze.com/ul?ll="), lat, F.lit("%2C-70.125'>"))).otherwise("<a href='https://waze.com/ul?ll=48.1,11.5'>")
    size = F.when(k % 4 > 0, F.concat(F.lit("Desde "), F.replace(dec(30.5 + k % 20, 1), F.lit("."), F.lit(",")), F.lit(" | hasta 90 m²"))).otherwise("desde 5 hasta 3 m²")
    rows = t("customer").select(k.alias("page_id"), F.concat(F.lit("<html>"), place, size, F.lit("</html>")).alias("html"), F.array(
        F.lit("post"), F.concat(F.lit("comuna-comuna "), F.col("c_nationkey").cast("string")), F.when(k % 5 > 0, "estado-en-verde").otherwise("otra"), F.lit("estado-vendido"), F.concat(F.lit("tag-"), (1 + k % 4).cast("string"), F.lit("-dormitorios"))).alias("classes"))
    rows = rows.withColumn("classes", F.when(F.col("page_id") % 5 > 0, F.col("classes")).otherwise(F.filter("classes", lambda c: ~c.startswith("estado-"))))
    (la, lo), (a, b), tags = pages.coordinates_from_html(F.col("html")), pages.size_range_from_html(F.col("html")), pages.tags_from_classes(F.col("classes"))
    return rows.select("page_id", la.alias("lat"), lo.alias("lon"), a.alias("size_low"), b.alias("size_high"), *[tags[c].alias(c) for c in ("place_slug", "status", "beds")])


@query("dossier_history", sql_with(PART_SQL, CAPTURES_SQL, islands("captures", "vers"), final="""
, k AS (SELECT *, 'u'||lpad(substr(unit_key, 2), 9, '0') AS key, row_number() OVER (PARTITION BY unit_key ORDER BY valid_from DESC) AS r, count(*) OVER (PARTITION BY unit_key) AS n FROM vers),
h AS (SELECT key, max(n) AS n_versions, string_agg(strftime(valid_from, '%Y-%m-%d')||'='||coalesce(CAST(price_uf AS BIGINT)||' UF', CAST(price_clp AS BIGINT)||' CLP', '-'), '; ' ORDER BY r) AS history FROM k WHERE r <= 6 GROUP BY key)
SELECT 'u'||lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS unit_key, typ, p_size, coalesce(n_versions, 0) AS n_versions, history FROM part_dims LEFT JOIN h ON key = 'u'||lpad(CAST(p_partkey AS VARCHAR), 9, '0')"""))
def dossier_history_q(t):
    """Every unit with the number of its versions and its latest six prices, newest first."""
    h = C.price_history(versions_of(t), 6)
    key = F.concat(F.lit("u"), F.lpad(F.substring("unit_key", 2, 18), 9, "0"))
    price = lambda x: F.coalesce(F.concat(x["price_uf"].cast("bigint").cast("string"), F.lit(" UF")), F.concat(x["price_clp"].cast("bigint").cast("string"), F.lit(" CLP")), F.lit("-"))
    line = F.array_join(F.transform("history", lambda x: F.concat(F.date_format(x["valid_from"], "yyyy-MM-dd"), F.lit("="), price(x))), "; ")
    h = h.select(key.alias("unit_key"), "n_versions", line.alias("history"))
    units = t.part_dims.select(F.concat(F.lit("u"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("unit_key"), "typ", "p_size")
    return units.join(h, "unit_key", "left").fillna({"n_versions": 0})
