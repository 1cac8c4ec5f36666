import datetime as dt
import os
import random

from pyspark.sql import functions as F

from lares.operators import versions as V
from lares.sources import feeds, landing, pages
from lares.streaming import captures as S

CARDS = """<html><ul>
<div class="poly-card"><a href="https://p/MLC-1-depto-992401813?x=1#y"><img></a><h2 class="poly-component__title">Depto 992401813</h2>
 <div class="poly-price__current"><span class="andes-money-amount">UF<b>3.390</b></span></div>
 <ul class="poly-attributes_list"><li>2 dormitorios</li><li>1 baño</li><li>45 m² útiles</li></ul><span class="poly-component__location">Calle 9, El Llano, San Miguel</span>
 <span class="poly-component__float-highlight">PUBLICADO ESTA SEMANA</span></div>
<div class="poly-card"><a href="https://p/MLC-1-depto">again</a><span class="andes-money-amount">UF 3.390</span></div>
<div class="poly-card"><a href="https://p/MLC-2"></a><span class="andes-money-amount">$ 95.000.000</span>Desde <ul class="poly-attributes_list"><li>1 a 2 dormitorios</li><li>35 - 61 m²</li></ul></div>
<div class="poly-card"><a href="https://p/MLC-3"></a></div>
<div class="poly-card"><a href="https://p/MLC-4"></a><span class="andes-money-amount">UF 30</span></div>
<div class="poly-card"><a href="/ads">ad</a><span class="andes-money-amount">UF 3.000</span></div></ul>"""


def test_cards(spark):
    url = "https://p/venta/departamento/propiedades-usadas/san-miguel-metropolitana_Desde_1"
    src = spark.createDataFrame([("p1", url, CARDS), ("p2", url, "<html><p>nothing"), ("p3", url, None)], "page_id string, url string, html string")
    raw = pages.run_extractor(src, pages.card_extractor, pages.CARD_SCHEMA).withColumn("operation", F.lit("sale")).withColumn("fetched_at", F.lit(dt.datetime(2026, 8, 30, 12)))
    assert {(r.page_id, r.n_cards, bool(r.error)) for r in raw.collect()} == {("p1", 6, False), ("p2", 0, False), ("p3", 0, True)}
    got = {r.listing_id: r for r in pages.parse_cards(raw).collect()}
    assert set(got) == {"MLC-1", "MLC-2"}  # no price, implausible price and no id are left out
    a, b = got["MLC-1"], got["MLC-2"]
    assert (a.amount, a.currency, a.typ, a.m2, a.zone, a.is_new, a.evidence) == (3390.0, "UF", "2D1B", 45.0, "san-miguel/el-llano", False, "V")
    assert a.listing_url == "https://www.portalinmobiliario.com/MLC-1" and a.title == "Depto [fono-removido]" and a.published_since == dt.date(2026, 8, 23) and a.published_on is None
    assert (b.amount, b.currency, b.beds, b.m2, b.evidence) == (95e6, "CLP", None, None, "E")
    cov = {r.page_id: (r.candidates, r.rows, r.errors) for r in pages.extraction_coverage(raw, pages.parse_cards(raw)).collect()}
    assert cov == {"p1": (6, 2, 0), "p2": (0, 0, 0), "p3": (0, 0, 1)}


def test_tags_coordinates_and_sizes(spark):
    d = spark.createDataFrame([(["ciudad-nunoa", "tag-2-dormitorio", "tag-1-bano", "estado-en-verde", "ciudad-otra"],)], "c array<string>")
    r = d.select(*[v.alias(k) for k, v in pages.tags_from_classes(F.col("c")).items()]).first()
    assert (r.place_slug, r.beds, r.baths, r.status, r.kind) == ("nunoa", 2, 1, "en-verde", None)
    h = spark.createDataFrame([("x!2d2.3522!3d48.8566 y!2d-70.605!3d-33.457 desde 33,51 | hasta 54,25 m²",), ("waze.com/ul?ll=-33.45%2C-70.61",), ("waze.com/ul?ll=48.85,2.35 desde 90 hasta 20 m²",)], "h string")
    lat, lon = pages.coordinates_from_html(F.col("h"))
    lo, hi = pages.size_range_from_html(F.col("h"))
    assert [tuple(r) for r in h.select(lat, lon, lo, hi).collect()] == [(-33.457, -70.605, 33.51, 54.25), (-33.45, -70.61, None, None), (None, None, None, None)]


def test_census_file_masks_and_commas(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text("MANZENT;n_per;prom_edad;COMUNA\n1101;12;28,8;Iquique\n1102;*;*;Iquique\n1103;;3,0; Alto \n", encoding="utf-8")
    m = {"MANZENT": ("block", "text"), "n_per": ("people", "int"), "prom_edad": ("age", "decimal"), "COMUNA": ("place", "text")}
    got = [tuple(r) for r in feeds.typed(feeds.census_reader(spark, str(f), list(m)), m).collect()]
    assert got == [("1101", 12, 28.8, "Iquique"), ("1102", None, None, "Iquique"), ("1103", None, 3.0, "Alto")]


def test_crawl_rules(spark):
    text = "User-agent: a\nUser-agent: examplebot\nDisallow: /private\nAllow: /private/ok$\n\nUser-agent: *\nDisallow: /\nAllow /general\n"
    files = spark.createDataFrame([("h", text), ("g", "User-agent: *\nDisallow: /x.y\nDisallow:\n")], "host string, text string")
    urls = spark.createDataFrame([("https://h/private", "h"), ("https://h/private/ok", "h"), ("https://h/private/ok?x", "h"), ("https://h/other", "h"), ("https://g/x.y", "g"), ("https://g/xzy", "g"), ("https://n/a", "n")], "url string, host string")
    named = {r.url: r.allowed for r in feeds.url_verdicts(urls, files, "ExampleBot/1.0").collect()}
    assert named == {"https://h/private": False, "https://h/private/ok": True, "https://h/private/ok?x": False, "https://h/other": True, "https://g/x.y": False, "https://g/xzy": True, "https://n/a": True}
    other = {r.url: r.allowed for r in feeds.url_verdicts(urls, files, "Zbot").collect()}
    assert other["https://h/other"] is False


def test_station_twins_collapse(spark):
    rows = [(1, "E", "m", "l1", "open", -33.4, -70.6, None), (2, "E", "m", "l1", "open", -33.4005, -70.6, 2020), (3, "E", "m", "l1", "open", -33.5, -70.6, None), (4, "E", "m", None, "open", -33.4, -70.6, None)]
    d = spark.createDataFrame([(*r, "station") for r in rows], "id int, name string, network string, line string, status string, lat double, lon double, opening_year int, outcome string")
    assert sorted(r.id for r in feeds.collapse_stations(d).collect()) == [2, 3, 4]


def test_landing_same_day_replaces(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    row = lambda n, day: ("s", f"https://x/{n}?apikey=abc", dt.datetime(2026, 8, day), "1", "r", f"body{n}")
    sch = "source_id string, source_url string, fetched_at timestamp, parser_version string, robots_snapshot_sha string, content string"
    out = str(tmp_path / "bronze")
    landing.write_bronze(landing.landed(spark.createDataFrame([row(1, 1), row(2, 2)], sch)), out)
    landing.write_bronze(landing.landed(spark.createDataFrame([row(3, 2)], sch)), out)
    got = sorted((str(r.fetch_date), r.content) for r in spark.read.parquet(out).collect())
    assert got == [("2026-08-01", "body1"), ("2026-08-02", "body3")]
    assert spark.read.parquet(out).where("source_url like '%abc%' or name like '%abc%'").count() == 0


def test_snapshot_folder_scan(spark, tmp_path):
    (tmp_path / "venta_san-miguel_p01_20260504.html").write_text("<p>a", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("x", encoding="utf-8")
    r = landing.scan_snapshots(spark, str(tmp_path)).collect()
    assert [(x.name, x.day, x.html) for x in r] == [("venta_san-miguel_p01_20260504.html", dt.date(2026, 5, 4), "<p>a")]


CAP = "unit_key string, captured timestamp_ntz, price_uf double, price_clp double, event_id long, surface string"


def test_streamed_versions_equal_the_batch_build(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"u{rng.randint(0, 9)}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=6 * i), float(rng.randint(1, 2)), None, i, "card") for i in range(240)]
    src, out = str(tmp_path / "in"), str(tmp_path / "versions")
    for k in (1, 0, 2):  # every third capture at a time, so later batches fall between known captures
        spark.createDataFrame(rows[k::3], CAP).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(CAP).parquet(src)
        S.keep_versions(stream, out, str(tmp_path / "ckpt")).awaitTermination()
    cols = ["unit_key", "price_uf", "price_clp", "valid_from", "valid_to", "fetched_at"]
    show = lambda d: sorted(tuple(str(x) for x in r) for r in d.select(*cols).collect())
    want = show(V.versions(spark.createDataFrame(rows, CAP)))
    assert show(S.current_versions(spark, out)) == want
    S.compact(spark, out, str(tmp_path / "compacted"))
    assert show(S.current_versions(spark, str(tmp_path / "compacted"))) == want


def test_stream_inventory_and_dedup(spark, tmp_path):
    rows = [("u1", dt.datetime(2026, 1, 1, 5), 1.0, None, 1, "card"), ("u1", dt.datetime(2026, 1, 1, 5), 1.0, None, 2, "card"), ("u2", dt.datetime(2026, 1, 2), 1.0, None, 3, "card"), ("u3", dt.datetime(2026, 1, 9), 1.0, None, 4, "detail")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, CAP).withColumn("captured", F.col("captured").cast("timestamp")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = S.deduplicated(stream).writeStream.format("memory").queryName("dedup").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 3
    q = S.daily_inventory(stream).writeStream.format("memory").queryName("inv").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.day), r.captures) for r in spark.table("inv").collect()} >= {("2026-01-01", 2), ("2026-01-02", 1)}
