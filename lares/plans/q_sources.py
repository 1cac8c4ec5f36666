"""Landing, extraction and feed queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import rnd
from lares.plans.bindings import NOW, PART_SQL, dealt, exact_avg
from lares.plans.registry import query, sql_with
from lares.sources import feeds, landing, pages


@query("bronze_landing", """
SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS bytes, regexp_replace('item_'||doc_id||'_apikey=OCULTA', '[^A-Za-z0-9._-]', '_', 'g') AS name FROM documents""")
def landing_q(t):
    """Documents with content hash, size and a file name free of secrets; whole contents are hashed."""
    d = t("documents").select("doc_id", F.col("source").alias("source_id"), F.concat(F.lit("https://api.example/item?"), F.col("doc_id").cast("string"), F.lit("&apikey=s3cr3t")).alias("source_url"),
                              F.lit(NOW).cast("timestamp").alias("fetched_at"), F.col("text").alias("content"))
    return landing.landed(d).select("doc_id", "sha", F.col("bytes").cast("bigint").alias("bytes"), "name")


@query("bronze_orphans", """
SELECT source, CASE WHEN l.doc_id IS NULL THEN 'no_metadata' WHEN CAST(substr(source,4) AS BIGINT) >= 15 THEN 'no_parser' ELSE 'replayable' END AS status, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def orphans_q(t):
    """Landed blobs that cannot be replayed, by reason."""
    b = t("documents").select(F.col("doc_id").alias("blob"), F.col("source").alias("source_id"))
    parsers = b.select("source_id").distinct().where(F.substring("source_id", 4, 9).cast("bigint") < 15)
    s = landing.replay_status(b, t("labels").select(F.col("doc_id").alias("blob")), parsers)
    return s.groupBy(F.col("source_id").alias("source"), "status").agg(F.count("*").alias("n"))


@query("manifest_promote", """
SELECT action, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'copied' WHEN d.doc_id IS NULL THEN 'landed_only' WHEN l.sha = md5(text) THEN 'already_there' ELSE 'conflict' END AS action
 FROM (SELECT * FROM documents WHERE lang <> 'de') d FULL JOIN (SELECT l.doc_id, CASE WHEN quality = 1 THEN md5(text) ELSE md5('x'||text) END AS sha FROM labels l JOIN documents USING (doc_id)) l ON d.doc_id = l.doc_id) GROUP BY 1""")
def manifest_q(t):
    """Incoming files against the landed manifest: same name with another hash is a conflict."""
    d = t("documents")
    inc = d.where("lang <> 'de'").select(F.col("doc_id").alias("name"), F.md5("text").alias("sha"))
    old = t("labels").join(d, "doc_id").select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, F.md5("text")).otherwise(F.md5(F.concat(F.lit("x"), "text"))).alias("sha"))
    return landing.manifest_actions(inc, old).groupBy("action").agg(F.count("*").alias("n"))


@query("bronze_inventory", """
SELECT event_type AS source_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS documents, count(DISTINCT user_id % 45) AS searches FROM events GROUP BY 1, 2""")
def inventory_q(t):
    """Documents and distinct searches per source and day."""
    d = t("events").select(F.col("event_type").alias("source_id"), F.to_date("ts").alias("day"), (F.col("user_id") % 45).alias("search"))
    return landing.inventory(d).withColumn("day", F.col("day").cast("string"))


@query("census_csv_cast", """
SELECT 'B'||c_custkey AS block, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 400 END AS people, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal, 2) END AS mean_age, c_mktsegment AS place FROM customer""")
def census_q(t):
    """Masked, comma-decimal text columns to typed columns."""
    k = F.col("c_custkey")
    line = F.concat_ws(";", F.concat(F.lit("B"), k.cast("string")), F.when(k % 9 == 0, "*").otherwise((k % 400).cast("string")),
                       F.when(k % 7 == 0, "").otherwise(F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(","))), F.concat(F.lit(" "), "c_mktsegment"))
    rows = t("customer").select(F.from_csv(line, "MANZENT string, n_per string, prom_edad string, COMUNA string", {"sep": ";", "nullValue": "*"}).alias("r")).select("r.*")
    out = feeds.typed(rows, {"MANZENT": ("block", "text"), "n_per": ("people", "int"), "prom_edad": ("mean_age", "decimal"), "COMUNA": ("place", "text")})
    return out.withColumn("people", F.col("people").cast("bigint"))


@query("json_series_explode", """
SELECT series, CAST(day AS VARCHAR) AS day, value, error, count(*) AS n FROM (
 SELECT CASE WHEN m % 3 = 0 THEN 'uf' WHEN m % 3 = 1 THEN 'utm' END AS series, CASE WHEN m % 3 <> 2 THEN day END AS day, CASE WHEN m % 3 <> 2 THEN cents/100.0::DOUBLE END AS value, CASE WHEN m % 3 = 2 THEN 'unknown_envelope' END AS error, m
 FROM (SELECT CAST(o_orderdate AS DATE) AS day, max(CAST(round(o_totalprice*100) AS BIGINT)) AS cents, year(o_orderdate)*12+month(o_orderdate) AS m FROM orders GROUP BY 1, 3)
 QUALIFY m % 3 <> 2 OR row_number() OVER (PARTITION BY m) = 1) GROUP BY 1, 2, 3, 4""")
def series_q(t):
    """Feed documents (one per month, built from the orders) exploded to long rows by envelope key."""
    o = t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    m = F.year("day") * 12 + F.month("day")
    whole = F.replace(F.format_number(F.floor(F.col("cents") / 100), 0), F.lit(","), F.lit("."))
    item = F.struct(F.concat(whole, F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")).alias("Valor"), F.col("day").cast("string").alias("Fecha"))
    docs = o.groupBy(m.alias("doc_id")).agg(F.to_json(F.collect_list(item)).alias("items"))  # at most 31 days per document
    key = F.when(F.col("doc_id") % 3 == 0, "UFs").when(F.col("doc_id") % 3 == 1, "UTMs").otherwise("Dolares")
    docs = docs.select("doc_id", F.concat(F.lit('{"'), key, F.lit('":'), "items", F.lit("}")).alias("body"))
    s = feeds.series_from_envelopes(docs)
    return s.groupBy("series", F.col("day").cast("string").alias("day"), "value", "error").agg(F.count("*").alias("n"))


@query("json_field_tiers", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 8 = 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'uf' ELSE 'utm' END AS series,
 CASE WHEN o_orderkey % 8 IN (3, 4, 5) THEN NULL ELSE v END AS value,
 CASE WHEN o_orderkey % 8 = 6 THEN NULL ELSE strftime(o_orderdate,'%Y-%m-%d') END AS day,
 CASE o_orderkey % 8 WHEN 3 THEN 'missing' WHEN 4 THEN 'ambiguous' WHEN 5 THEN 'bad_number' WHEN 6 THEN 'bad_date' END AS error
FROM (SELECT *, 40000 + CAST(floor(o_totalprice/10) AS DOUBLE) AS v FROM orders)""")
def tiers_q(t):
    """Records with unstable field names and ambiguous numbers, with the reason of each reject."""
    k = F.col("o_orderkey")
    v = F.lit(40000) + F.floor(F.col("o_totalprice") / 10)
    es = F.replace(F.format_number(v, 0), F.lit(","), F.lit("."))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    q = lambda name, val: F.concat(F.lit(f'"{name}":"'), val, F.lit('"'))
    code = F.when(k % 8 == 3, q("Otro", F.lit("UF"))).when(k % 2 == 0, q("Codigo", F.lit("UF"))).otherwise(q("Moneda", F.lit("utm")))
    value = F.when(k % 8 == 4, F.concat(q("Valor", es), F.lit(","), q("Value", es))).when(k % 8 == 5, q("Valor", F.lit("n/d"))).otherwise(q("Monto", es))
    date = F.when(k % 8 == 6, q("Fecha", F.lit("05-08-2026"))).when(k % 8 == 7, q("Fecha Actualizacion", day)).otherwise(q("Date", day))
    docs = t("orders").select(k.alias("doc_id"), F.concat(F.lit("{"), code, F.lit(","), value, F.lit(","), date, F.lit("}")).alias("body"))
    s = feeds.series_from_records(docs)
    return s.select("doc_id", "series", "value", F.col("day").cast("string").alias("day"), "error")


@query("parse_errors", """
SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) END AS k, CASE WHEN event_id % 17 = 0 THEN 'raw/'||event_id END AS raw_blob_path FROM events""".replace("\\\\", "\\"))
def errors_q(t):
    """Documents that do not parse, kept with the reference of their blob."""
    body = F.when(F.col("event_id") % 17 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    p = F.from_json(body, "k bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    d = t("events").select("event_id", p.alias("p"))
    bad = F.col("p._bad").isNotNull()
    return d.select("event_id", F.when(~bad, F.col("p.k")).alias("k"), F.when(bad, F.concat(F.lit("raw/"), F.col("event_id").cast("string"))).alias("raw_blob_path"))


@query("dated_snapshot_scan", """
SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN '2024-0'||(1 + page_id % 9)||'-1'||(page_id % 10) END AS day, CASE WHEN page_id % 4 = 0 THEN 'venta' END AS operation, CASE WHEN page_id % 4 = 0 THEN 'san-miguel' END AS place,
 CASE WHEN page_id % 4 = 0 THEN page_id % 7 END AS page_no, CASE WHEN page_id % 4 = 1 THEN 'https://www.portalinmobiliario.com/MLC-'||page_id END AS url FROM pages""")
def snapshot_q(t):
    """Capture day, search and URL from the file name, never from the clock."""
    k = F.col("page_id")
    day = F.concat(F.lit("20240"), (1 + k % 9).cast("string"), F.lit("1"), (k % 10).cast("string"))
    name = (F.when(k % 4 == 0, F.concat(F.lit("venta_san-miguel_p"), F.lpad((k % 7).cast("string"), 2, "0"), F.lit("_"), day, F.lit(".html")))
            .when(k % 4 == 1, F.concat(F.lit("MLC-"), k.cast("string"), F.lit("_"), day, F.lit(".html")))
            .when(k % 4 == 2, F.concat(F.lit("otra_"), day, F.lit(".html"))).otherwise("sin-fecha.html"))
    op, place, no = landing.listing_page_parts(name)
    return t("pages").select("page_id", landing.snapshot_date(name).cast("string").alias("day"), op.alias("operation"), place.alias("place"),
                             no.cast("bigint").alias("page_no"), landing.detail_page_url(name).alias("url"))


# ----------------------------------------------------------------- listing pages built from the parts


def listing_pages(t):
    """One results page per district and block of keys, as HTML text (at most a few dozen cards each)."""
    k = F.col("p_partkey")
    price = F.replace(F.format_number(F.floor("p_retailprice") * 3, 0), F.lit(","), F.lit("."))
    price_html = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit('<div class="poly-price__current"><span class="andes-money-amount">UF <b>'), price, F.lit("</b></span></div>")))
    m2 = F.when(k % 10 == 0, F.lit("35 - 61 m² útiles")).otherwise(F.concat((F.col("p_size") + 14).cast("string"), F.lit(" m² útiles")))
    card = F.concat(
        F.lit('<div class="poly-card"><img src="x"><a href="https://x.example/MLC-'), (k + 100).cast("string"), F.lit('-depto-_JM?pos=1#s"><h2 class="poly-component__title">Depto '), k.cast("string"),
        F.lit("</h2></a>"), price_html, F.lit('<ul class="poly-attributes_list"><li>'), (k % 4).cast("string"), F.lit(" dormitorios</li><li>1 baño</li><li>"), m2,
        F.lit('</li></ul><span class="poly-component__location">Calle '), k.cast("string"), F.lit(", Barrio "), "typ", F.lit("</span>"),
        F.when(k % 5 == 0, '<span class="poly-component__float-highlight">PUBLICADO HOY</span>').otherwise(""), F.lit("</div>"))
    twice = F.when(k % 13 == 0, F.concat(card, card)).otherwise(card)
    g = t.part_dims.groupBy("district", F.floor(k / 240).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), twice.alias("h")))), lambda x: x["h"]), "").alias("cards"))
    return dealt(g, "district", "block").select(F.concat_ws("-", "district", F.col("block").cast("string")).alias("page_id"),
                    F.concat(F.lit("https://x.example/venta/departamento/propiedades-usadas/"), "district", F.lit("-metropolitana_Desde_1")).alias("url"),
                    F.concat(F.lit("<html><body><section>"), "cards", F.lit("</section></body></html>")).alias("html"))


def cards_of(t):
    c = pages.run_extractor(listing_pages(t), pages.card_extractor, pages.CARD_SCHEMA)
    return c.withColumn("operation", F.lit("sale")).withColumn("fetched_at", F.lit("2024-01-20 02:00:00").cast("timestamp_ntz"))


CARD_SQL = """
pk AS (SELECT *, p_partkey AS k, district||'-'||CAST(p_partkey//240 AS BIGINT) AS page_id FROM part_dims)"""


@query("page_extract", sql_with(PART_SQL, CARD_SQL, final="""
SELECT page_id, 'MLC-'||(k+100) AS listing_id, 'UF' AS currency, floor(p_retailprice)*3 AS amount, k % 4 AS beds, CASE WHEN k % 4 = 0 THEN 'studio' ELSE (k%4)||'D1B' END AS typ,
 CASE WHEN k % 10 <> 0 THEN CAST(p_size + 14 AS DOUBLE) END AS m2, district||'/barrio-'||lower(typ) AS zone, FALSE AS is_new, 'V' AS evidence, 'https://x.example/MLC-'||(k+100)||'-depto-_JM' AS listing_url, 'Depto '||k AS title,
 CASE WHEN k % 5 = 0 THEN '2024-01-19' END AS published_on FROM pk WHERE k % 11 <> 0"""))
def page_extract_q(t):
    """Listing cards of every results page, typed, one row per listing id of a page."""
    p = pages.parse_cards(cards_of(t))
    return p.select("page_id", "listing_id", "currency", "amount", F.col("beds").cast("bigint").alias("beds"), "typ", "m2", "zone", "is_new", "evidence", "listing_url", "title",
                    F.col("published_on").cast("string").alias("published_on"))


@query("extract_coverage", sql_with(PART_SQL, CARD_SQL, final="""
SELECT page_id, sum(CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END)::BIGINT AS candidates, count(*) FILTER (k % 11 <> 0) AS "rows", round(avg(CASE WHEN k % 10 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (k % 11 <> 0),6)+0.0 AS share_m2 FROM pk GROUP BY 1"""))
def extract_coverage_q(t):
    """Parsed rows against candidate cards per page, and field coverage."""
    c = cards_of(t)
    e = pages.extraction_coverage(c, pages.parse_cards(c))
    return e.select("page_id", F.col("candidates").cast("bigint").alias("candidates"), "rows", rnd(F.col("share_m2")).alias("share_m2"))


def detail_pages(t):
    k = F.col("p_partkey")
    crumb = lambda c: F.concat(F.lit('<li class="andes-breadcrumb__item"><a href="/'), F.when(k % 2 == 0, "arriendo").otherwise("venta"), F.lit('/departamento/propiedades-usadas">'), c, F.lit("</a></li>"))
    op = F.when(k % 6 < 2, "...").when(k % 2 == 0, "Arriendo").otherwise("Venta")
    money = F.when(k % 2 == 0, F.concat(F.lit("<span class='andes-money-amount__currency-symbol'>$</span><span class='andes-money-amount__fraction'>"), (400 + k % 300).cast("string"), F.lit(".000</span>"))).otherwise(
        F.concat(F.lit("<span class='andes-money-amount__currency-symbol'>UF</span><span class='andes-money-amount__fraction'>"), F.replace(F.format_number(2000 + k % 900, 0), F.lit(","), F.lit(".")),
                 F.lit("</span><span class='andes-money-amount__cents'>50</span>")))
    row = lambda a, b: F.concat(F.lit("<tr><th>"), F.lit(a), F.lit("</th><td>"), b, F.lit("</td></tr>"))
    html = F.concat(
        F.lit('<html><head><link rel="canonical" href="https://x.example/'), F.when(k % 9 == 0, "proyecto").otherwise(F.concat(F.lit("MLC-"), k.cast("string"))), F.lit('"></head><body><ol>'),
        crumb(op), crumb(F.lit("Departamentos")), crumb(F.lit("Propiedades usadas")), crumb(F.concat(F.lit("Comuna "), "district")), crumb(F.concat(F.lit("Barrio "), F.col("brand").cast("string"))), F.lit("</ol>"), money,
        F.lit('<table class="andes-table">'), row("Superficie útil", F.concat((F.col("p_size") + 14).cast("string"), F.lit(" m²"))), row("Dormitorios", F.when(k % 8 == 0, F.lit("1 a 2")).otherwise((k % 4).cast("string"))),
        row("Baños", F.lit("2")), row("Antiguedad", F.concat((k % 40).cast("string"), F.lit(" años"))), F.lit("</table></body></html>"))
    parts = dealt(t.part_dims, "p_partkey")
    return parts.select(k.cast("string").alias("page_id"), F.concat(F.lit("https://x.example/MLC-"), k.cast("string"), F.lit("-x")).alias("url"), html.alias("html"))


@query("page_detail_extract", sql_with(PART_SQL, final="""
SELECT CAST(p_partkey AS VARCHAR) AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 'rent' ELSE 'sale' END AS operation, CASE WHEN p_partkey % 2 = 0 THEN 'CLP' ELSE 'UF' END AS currency,
 CASE WHEN p_partkey % 2 = 0 THEN (400 + p_partkey % 300)*1000.0::DOUBLE ELSE 2000.5 + p_partkey % 900 END AS amount, 'comuna-'||district||'/barrio-'||brand AS zone, CAST(p_size+14 AS DOUBLE) AS m2,
 CASE WHEN p_partkey % 8 <> 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'studio' ELSE (p_partkey%4)||'D2B' END END AS typ, p_partkey % 40 AS age_years, FALSE AS is_new, p_partkey % 9 = 0 AS is_project FROM part_dims"""))
def detail_q(t):
    """Detail pages: operation, price, place, specification table, project flag."""
    d = pages.parse_details(pages.run_extractor(detail_pages(t), pages.detail_extractor, pages.DETAIL_SCHEMA), min_length=200)
    return d.select("page_id", "operation", "currency", "amount", "zone", "m2", "typ", F.col("age_years").cast("bigint").alias("age_years"), "is_new", "is_project")


@query("jsonld_extract", """
SELECT CAST(c_custkey AS VARCHAR) AS page_id, 'Edificio '||c_custkey AS name, c_mktsegment AS place, CASE WHEN c_custkey % 4 <> 0 THEN -33.0 - (c_custkey % 100)/100.0::DOUBLE END AS lat, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 2000.5 + c_custkey % 500 ELSE 3390 END AS low_price FROM customer""")
def jsonld_q(t):
    """Project name, place, coordinates and lowest price from JSON-LD blocks."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    geo = F.when(k % 4 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"latitude":"'), (-33.0 - (k % 100) / 100.0).cast("string"), F.lit('","longitude":"-70.6"}')))
    cur = F.when(k % 3 == 0, "CLP").when(k % 3 == 1, "CLF").otherwise("UF")
    low = F.when(k % 3 == 2, F.lit('"3.390 UF"')).otherwise(F.concat(F.lit('"'), (2000.5 + k % 500).cast("string"), F.lit('"')))
    graph = F.concat(F.lit('{"@graph":[{"@type":"ApartmentComplex","name":"Edificio '), s, F.lit('","address":{"addressLocality":"'), "c_mktsegment", F.lit('"},"geo":'), geo,
                     F.lit('},{"@type":"Product","offers":{"priceCurrency":"'), cur, F.lit('","lowPrice":'), low, F.lit("}}]}"))
    html = F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), graph, F.lit("</script></html>"))
    p = t("customer").select(s.alias("page_id"), html.alias("html"))
    return pages.project_from_ld(p).select("page_id", "name", "place", "lat", "low_price")


STATION_SQL = """
el AS (SELECT c_custkey AS id, c_custkey % 10 AS m, 2000 + c_custkey % 6 AS y, c_nationkey FROM customer)"""


@query("station_classify", sql_with(STATION_SQL, final="""
SELECT network, line, status, outcome, opening_year, count(*) AS n FROM (
 SELECT CASE m WHEN 6 THEN 'biotren' WHEN 7 THEN 'efe' ELSE 'metro-santiago' END AS network,
  CASE WHEN m IN (2, 3) THEN 'l7' WHEN m IN (0, 1, 5) THEN 'l'||(id % 3 + 1) END AS line,
  CASE m WHEN 0 THEN 'open' WHEN 1 THEN CASE WHEN y > 2001 THEN 'proposed' ELSE 'open' END WHEN 2 THEN 'building' WHEN 3 THEN 'building' WHEN 5 THEN 'building' ELSE 'open' END AS status,
  CASE WHEN m = 8 THEN 'off_network' WHEN m = 9 THEN 'route' WHEN m = 4 THEN 'unclassified' WHEN id % 7 = 0 THEN 'unnamed' ELSE 'station' END AS outcome,
  CASE WHEN m IN (1, 3) THEN CAST(y AS INTEGER) END AS opening_year FROM el) GROUP BY ALL"""))
def station_q(t):
    """Map elements to stations: network, line, status, and what happened to every element."""
    k = F.col("c_custkey")
    m, y = k % 10, (2000 + k % 6).cast("string")
    tags = {0: {"railway": "station", "station": "subway", "ref": None}, 1: {"railway": "station", "station": "subway", "ref": None, "start_date": "Y"},
            2: {"railway": "construction", "construction:station": "subway", "network": "Línea 7", "ref": "6"},
            3: {"proposed:railway": "station", "subway": "yes", "network": "Linea 7", "start_date": "Y"}, 4: {"subway": "yes"},
            5: {"construction": "station", "construction:station": "subway", "ref": None}, 6: {"railway": "station", "network": "Biotrén"},
            7: {"railway": "station", "station": "subway", "train": "yes"}, 8: {"railway": "station", "network": "Tranvía"}, 9: {"route": "subway", "subway": "yes"}}
    line = F.concat(F.lit("L"), (k % 3 + 1).cast("string"))
    col = F.lit(None).cast("map<string,string>")
    for case, tg in tags.items():
        kv = [x for a, b in tg.items() for x in (F.lit(a), line if b is None else (F.concat(y, F.lit("-05-01")) if b == "Y" else F.lit(b)))]
        named = F.when(k % 7 == 0, F.create_map(*kv)).otherwise(F.map_concat(F.create_map(*kv), F.create_map(F.lit("name"), F.concat(F.lit("E"), k.cast("string")))))
        col = F.when(m == case, named).otherwise(col)
    el = t("customer").select(k.alias("id"), F.when(m == 9, "relation").otherwise("node").alias("type"), col.alias("tags"), (-33.4 + (k % 100) / 100.0).alias("lat"), F.lit(-70.6).alias("lon"))
    s = feeds.classify_stations(el, t.now, ["l7"])
    return s.groupBy("network", "line", "status", "outcome", "opening_year").agg(F.count("*").alias("n"))
