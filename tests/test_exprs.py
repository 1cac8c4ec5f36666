import datetime as dt

import pytest
from pyspark.sql import functions as F

from lares.functions import exprs as X


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("3.500", 3500.0), ("UF 1.234,5", 1234.5), ("35 - 61 m²", None), ("", None), (None, None), ("sin precio", None), ("113 m² útiles", 113.0)])
def test_parse_number(spark, text, want):
    assert one(spark, X.parse_number(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("39.500", 39500.0), ("39500", 39500.0), ("39.500,25", 39500.25), ("39,500.25", 39500.25), ("1.234.567", 1234567.0), ("39,5", 39.5), ("3.5", None), ("x", None), ("", None)])
def test_parse_number_ranged(spark, text, want):
    assert one(spark, X.parse_number_ranged(F.col("t"), 20000.0, 100000.0), t=text) == want


def test_parse_number_ranged_rejects_two_plausible_readings(spark):
    assert one(spark, X.parse_number_ranged(F.col("t"), 1.0, 100000.0), t="39.500") is None


@pytest.mark.parametrize("text,want", [("2026-08-29", dt.date(2026, 8, 29)), ("2026-08-29T10:00:00Z", dt.date(2026, 8, 29)), ("29/08/2026", dt.date(2026, 8, 29)), ("05-08-2026", None), ("31-02-2026", None), ("2026-02-30", None), ("ayer", None)])
def test_parse_date(spark, text, want):
    assert one(spark, X.parse_date_strict(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("Ñuñoa - Estadio Nacional", "nunoa-estadio-nacional"), ("  San   Miguel ", "san-miguel"), ("plain", "plain"), ("ﬁn…10º", "fin-10o")])
def test_slug(spark, text, want):
    assert one(spark, X.slugify(F.col("t")), t=text) == want


def test_bands_and_plausibility(spark):
    df = spark.createDataFrame([(0.0,), (24.99,), (25.0,), (139.9,), (140.0,), (None,)], "m double")
    assert [r.b for r in df.select(X.size_band(F.col("m")).alias("b")).collect()] == ["0-25", "0-25", "25-35", "100-140", None, None]
    cases = [(2000.0, 40.0, None), (400.0, 40.0, "price_out_of_range"), (2000.0, 10.0, "size_out_of_range"), (600.0, 40.0, "uf_m2_below_minimum"), (9000.0, 40.0, "uf_m2_above_maximum"), (None, 40.0, None)]
    d = spark.createDataFrame([c[:2] for c in cases], "p double, m double")
    assert [r.r for r in d.select(X.implausible_reason(F.col("p"), F.col("m")).alias("r")).collect()] == [c[2] for c in cases]


def test_freshness_is_inclusive_and_null_is_a_reason(spark):
    d = spark.sql("select timestamp'2026-08-10' as s union all select timestamp'2026-08-09 23:59:59' union all select null")
    out = d.select("s", X.freshness_reason(F.col("s"), F.lit("2026-08-31").cast("timestamp")).alias("r")).collect()
    assert {str(r.s)[:10]: r.r for r in out} == {"2026-08-10": None, "2026-08-09": "stale", "None": "no_date"}


def test_text_predicates(spark):
    rows = ["depto-AMOBLADO", "por día", "cocina equipada", "equipado y amoblado", None, "turística"]
    d = spark.createDataFrame([(r,) for r in rows], "t string")
    out = d.select(X.text_not_comparable(F.col("t")).alias("n"), X.text_doubtful(F.col("t")).alias("d")).collect()
    assert [(r.n, r.d) for r in out] == [(True, False), (True, False), (False, True), (True, False), (False, False), (True, False)]


def test_redaction_keeps_ids_and_counts(spark):
    clean, n = X.pii_redact(F.col("t"))
    d = spark.createDataFrame([("a.b@c.cl wa.me/569 tel:123 +56 9 1234 5678 MLC-1859051633_20260504.html",)], "t string").select(clean.alias("c"), n.alias("n")).first()
    assert d.n == 4 and "MLC-1859051633_20260504.html" in d.c and "@" not in d.c
    assert one(spark, X.safe_short_text(F.col("t")), t="llamar 992401813 MLC-998686353") == "llamar [fono-removido] MLC-998686353"


def test_url_sanitize_and_secret(spark):
    bad = "https://p/MLC-3872504748-arriendo-metro-992401813-dueno"
    assert one(spark, X.url_sanitize(F.col("u"), F.lit("MLC-3872504748"), "https://p"), u=bad) == "https://p/MLC-3872504748"
    assert one(spark, X.mask_secret(F.col("u")), u="x?apikey=abc&y=1") == "x?apikey=OCULTA&y=1"


def test_pii_kinds_allows_company_ids(spark):
    f = lambda t: one(spark, X.pii_kinds(F.col("t")), t=t)
    assert f("rut 12.345.678-5") == ["tax_id"] and f("rut 76.123.456-0") == [] and f("MLC-998686353") == []
    assert f("fono 9 8765 4321, a@b.cl") == ["email", "phone"] and f("40804000") == []


def test_location(spark):
    def split(text, place):
        a, b = X.location_split(F.col("t"), F.col("p"))
        r = spark.createDataFrame([(text, place)], "t string, p string").select(a.alias("a"), b.alias("b")).first()
        return r.a, r.b
    assert split("Milán 1242, El Llano, San Miguel", "san-miguel") == ("San Miguel", "El Llano")
    assert split("Apoquindo 4900, Barrio El Golf", "las-condes") == ("Las Condes", "Barrio El Golf")
    assert split("Gran Avenida 5500", "san-miguel") == ("San Miguel", None)
    assert split("El Llano, San Miguel", None) == ("San Miguel", "El Llano") and split(None, None) == (None, None)


def test_publication_uses_the_local_calendar(spark):
    d = spark.sql("select timestamp'2026-08-30 02:00:00' as t")
    a, b = X.publish_bounds(F.col("t"), F.lit("PUBLICADO ESTA SEMANA"))
    assert d.select(a.alias("a"), b.alias("b")).first() == (None, dt.date(2026, 8, 22))


def test_evidence(spark):
    f = lambda *v: spark.range(1).select(X.evidence_worst(*[F.lit(x) for x in v]).alias("x")).first().x
    assert (f("V", "V"), f("V", "E"), f("E", "ND"), f("D", "V")) == ("D", "E", "ND", "D")


def test_geocode(spark):
    assert one(spark, X.geocode_accept(F.col("d"), F.lit("la-cisterna")), d="Calle 1, La Cisterna, Chile") is True
    q = spark.range(1).select(X.geocode_queries(F.lit("Torre"), F.lit(None).cast("string"), F.lit("Macul")).alias("q")).first().q
    assert q == ["Torre, Macul, Chile"]
