"""Text, number, date and URL queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions import exprs as X
from lares.plans.bindings import RENTS_SQL
from lares.plans.q_rent import FURN
from lares.plans.registry import query, sql_with
from lares.sources import feeds, landing, pages


@query("text_not_comparable", sql_with(RENTS_SQL, final=f"SELECT {FURN} AS not_comparable, count(*) AS n FROM rents GROUP BY 1"))
def not_comparable_q(t):
    """Listings whose text says furnished or short stay."""
    return t.rents.groupBy(X.text_not_comparable(F.col("url")).alias("not_comparable")).agg(F.count("*").alias("n"))


@query("text_doubtful", sql_with(RENTS_SQL, final=f"SELECT regexp_matches(lower(url), 'equipad|gc[\\s-]incl|gastos[\\s-]comunes[\\s-]inclu') AND NOT {FURN} AS doubtful, count(*) AS n FROM rents GROUP BY 1"))
def doubtful_q(t):
    """Listings that deserve a look but stay comparable."""
    return t.rents.groupBy(X.text_doubtful(F.col("url")).alias("doubtful")).agg(F.count("*").alias("n"))


@query("slugify", r"""
SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)""")
def slug_q(t):
    """Slug of whole texts: accents folded, other runs to one hyphen."""
    return t("documents").select("doc_id", X.slugify(F.col("text")).alias("s")).select("doc_id", F.length("s").cast("bigint").alias("n"), F.md5("s").alias("digest"))


@query("parse_number", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN floor(o_totalprice) + (o_orderkey % 100)/100.0::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN floor(o_totalprice) WHEN 3 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS value FROM orders""")
def number_q(t):
    """Local-format numbers; a range or no number is NULL."""
    k, whole = F.col("o_orderkey"), F.floor("o_totalprice")
    dotted = F.replace(F.format_number(whole, 0), F.lit(","), F.lit("."))
    text = (F.when(k % 5 == 0, F.concat(F.lit("UF "), dotted, F.lit(","), F.lpad((k % 100).cast("string"), 2, "0")))
            .when(k % 5 == 1, F.concat(F.lit("35 - "), dotted, F.lit(" m²"))).when(k % 5 == 2, F.concat(F.lit("$"), dotted))
            .when(k % 5 == 3, F.lit("a convenir")).otherwise(F.concat((k % 7).cast("string"), F.lit(" dormitorios"))))
    return t("orders").select("o_orderkey", X.parse_number(text).alias("value"))


@query("parse_number_ranged", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v + 0.5 WHEN 3 THEN NULL WHEN 4 THEN v ELSE NULL END AS value FROM (SELECT o_orderkey, 20000 + CAST(floor(o_totalprice/10) AS DOUBLE) AS v FROM orders)""")
def ranged_q(t):
    """Ambiguous separators resolved by the plausible range, else rejected."""
    k, v = F.col("o_orderkey"), F.lit(20000) + F.floor(F.col("o_totalprice") / 10)
    en = F.format_number(v, 0)
    es = F.replace(en, F.lit(","), F.lit("."))
    text = (F.when(k % 6 == 0, es).when(k % 6 == 1, F.concat(es, F.lit(",00"))).when(k % 6 == 2, F.concat(en, F.lit(".5")))
            .when(k % 6 == 3, F.lit("3.5")).when(k % 6 == 4, v.cast("string")).otherwise(F.lit("n/d")))
    return t("orders").select("o_orderkey", X.parse_number_ranged(text, 20000.0, 100000.0).alias("value"))


@query("parse_date_strict", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') END
 WHEN 3 THEN CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') END END AS day FROM orders""")
def date_q(t):
    """Dates; day-month ambiguity and impossible dates are NULL."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00Z")))
            .when(k % 5 == 2, F.date_format(d, "d/M/yyyy")).when(k % 5 == 3, F.date_format(d, "dd-MM-yyyy")).otherwise(F.lit("2001-02-30")))
    return t("orders").select("o_orderkey", X.parse_date_strict(text).cast("string").alias("day"))


@query("location_split", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ñuñoa' WHEN 1 THEN 'San Miguel' WHEN 2 THEN 'San Miguel' ELSE 'Centro' END AS place,
 CASE c_custkey % 4 WHEN 0 THEN 'Plaza '||c_mktsegment WHEN 1 THEN 'Barrio '||c_mktsegment WHEN 2 THEN NULL ELSE 'Barrio '||c_mktsegment END AS hood FROM customer""")
def location_q(t):
    """Location text to municipality and neighbourhood, anchored on the search URL."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    text = (F.when(k % 4 == 0, F.concat(F.lit("Irarrázaval 12, Plaza "), s, F.lit(", Ñuñoa"))).when(k % 4 == 1, F.concat(F.lit("Calle 9, Barrio "), s))
            .when(k % 4 == 2, F.concat(F.lit("Gran Avenida 5500, San Miguel"))).otherwise(F.concat(F.lit("Barrio "), s, F.lit(", Centro"))))
    url = (F.when(k % 4 == 0, "nunoa").when(k % 4 == 3, "").otherwise("san-miguel"))
    place, hood = X.location_split(text, url)
    return t("customer").select("c_custkey", place.alias("place"), hood.alias("hood"))


@query("publish_bounds", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) END AS published_on,
 CASE event_id % 3 WHEN 0 THEN CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) WHEN 1 THEN CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) - 7 AS VARCHAR) END AS published_since FROM events""")
def publish_q(t):
    """Relative publication label to exact and earliest local dates (Santiago is three hours behind UTC all through the data)."""
    k = F.col("event_id")
    label = F.when(k % 3 == 0, "Publicado hoy").when(k % 3 == 1, " publicado esta semana ").otherwise("Destacado")
    exact, since = X.publish_bounds(F.col("ts"), label)
    return t("events").select("event_id", exact.cast("string").alias("published_on"), since.cast("string").alias("published_since"))


MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CHAT = r"""(?:wa\.me|api\.whatsapp\.com)[^"''>\s]*"""
TEL = r"""tel:[^"''>\s]*"""
P56 = r"\+\s?56[\s.\-]?9?[\s.\-]?\d[\d\s.\-]{5,10}\d"


@query("pii_redact", f"""
WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '{MAIL}')) AS n1, regexp_replace(text, '{MAIL}', '[correo-removido]', 'g') AS t FROM documents),
b AS (SELECT doc_id, n1, len(regexp_extract_all(t, '{CHAT}')) AS n2, regexp_replace(t, '{CHAT}', '[whatsapp-removido]', 'g') AS t FROM a),
c AS (SELECT doc_id, n1, n2, len(regexp_extract_all(t, '{TEL}')) AS n3, regexp_replace(t, '{TEL}', 'tel:[removido]', 'g') AS t FROM b)
SELECT doc_id, n1+n2+n3+len(regexp_extract_all(t, '{P56}')) AS removed, md5(regexp_replace(t, '{P56}', '[fono-removido]', 'g')) AS digest FROM c""")
def redact_q(t):
    """Redaction of whole texts with the number of removals."""
    clean, n = X.pii_redact(F.col("text"))
    return t("documents").select("doc_id", n.cast("bigint").alias("removed"), F.md5(clean).alias("digest"))


@query("url_sanitize", """
SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 2) THEN 'https://x.example/MLC-'||(900000000 + c_custkey) ELSE 'https://x.example/MLC-'||(900000000 + c_custkey)||'-depto-'||CASE c_custkey % 5 WHEN 1 THEN 'luminoso' WHEN 3 THEN '1992401813000' ELSE 'norte' END||'-_JM' END AS url FROM customer""")
def sanitize_q(t):
    """Listing URLs cut to canonical form when the slug carries a phone or mail."""
    k = F.col("c_custkey")
    lid = F.concat(F.lit("MLC-"), (900000000 + k).cast("string"))
    tail = F.when(k % 5 == 0, "992401813-dueno").when(k % 5 == 1, "luminoso").when(k % 5 == 2, "a.b@mail.cl").when(k % 5 == 3, "1992401813000").otherwise("norte")
    url = F.concat(F.lit("https://x.example/"), lid, F.lit("-depto-"), tail, F.lit("-_JM"))
    return t("customer").select("c_custkey", X.url_sanitize(url, lid, "https://x.example").alias("url"))


@query("geocode_accept", """
SELECT s_suppkey, s_suppkey % 3 <> 2 AS accepted, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS queries FROM supplier""")
def geocode_q(t):
    """A geocoder result is accepted only if it names the declared municipality; query variants."""
    k = F.col("s_suppkey")
    display = F.when(k % 3 == 0, "Irarrázaval 100, Ñuñoa, Chile").when(k % 3 == 1, "Edificio, NUNOA, Santiago").otherwise("Calle 1, La Florida")
    q = X.geocode_queries(F.col("s_name"), F.when(k % 2 == 0, "Irarrázaval 100").otherwise("  "), F.lit("Ñuñoa"))
    return t("supplier").select("s_suppkey", X.geocode_accept(display, F.lit("Ñuñoa")).alias("accepted"), F.size(q).alias("queries"))


ROBOTS = """User-agent: otherbot
Disallow: /
# general rules
User-agent: *
Disallow: /en/
Allow: /en/*.html$
Disallow: /*?page=
Allow /fr/
Disallow:
Allow: /de/
Disallow: /de/"""
RULES_SQL = "(VALUES ('/en/', '^/en/', FALSE), ('/en/*.html$', '^/en/.*\\.html$', TRUE), ('/*?page=', '^/.*\\?page=', FALSE), ('/de/', '^/de/', TRUE), ('/de/', '^/de/', FALSE)) r(pattern, regex, allow)"


@query("url_policy_match", f"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#.*$', '') AS path, row_number() OVER () AS rid FROM pages),
m AS (SELECT rid, r.*, row_number() OVER (PARTITION BY rid ORDER BY length(pattern) DESC, allow DESC) AS k FROM p JOIN {RULES_SQL} ON regexp_matches(path, regex))
SELECT page_id, coalesce(allow, TRUE) AS allowed, pattern AS rule FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)""")
def policy_q(t):
    """Crawl permission of every page URL by its host's rules: longest pattern wins, tie allows."""
    p = t("pages").withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1))
    files = p.select("host").distinct().withColumn("text", F.lit(ROBOTS))
    return feeds.url_verdicts(p.select("page_id", "url", "host"), files, "ExampleBot/1.0").select("page_id", "allowed", "rule")


@query("month_windows", """
SELECT o_orderpriority AS series, CAST(w AS VARCHAR) AS window_start, CAST(least(CAST(w + INTERVAL 4 MONTH AS DATE), e) AS VARCHAR) AS window_end FROM (
 SELECT o_orderpriority, e, CAST(unnest(generate_series(s, e, INTERVAL 5 MONTH)) AS DATE) AS w FROM (
  SELECT o_orderpriority, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS s, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS e FROM orders GROUP BY 1))""")
def windows_q(t):
    """Month ranges split into windows of five months."""
    m = lambda f: F.to_date(F.date_trunc("month", f("o_orderdate")))
    r = t("orders").groupBy(F.col("o_orderpriority").alias("series")).agg(m(F.min).alias("start"), m(F.max).alias("end"))
    w = feeds.month_windows(r, 5)
    return w.select("series", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query("text_grep", r"""
SELECT doc_id, len(regexp_extract_all(text, '@mail[0-9]+[.a-z]+')) AS hits, substr(text, greatest(p-30,1), p - greatest(p-30,1) + length(f) + 30) AS snippet FROM (
 SELECT *, strpos(text, f) AS p FROM (SELECT doc_id, text, regexp_extract(text, '@mail[0-9]+[.a-z]+', 0) AS f FROM documents WHERE regexp_matches(text, '@mail[0-9]+[.a-z]+')))""")
def grep_q(t):
    """Pattern search over whole texts with hit counts and context."""
    return landing.text_grep(t("documents"), r"@mail[0-9]+[.a-z]+", 30).withColumn("hits", F.col("hits").cast("bigint"))


@query("page_shape_profile", r"""
SELECT contains(html,'<urlset') OR contains(html,'<sitemapindex') AS is_sitemap, substr(ltrim(html),1,1) IN ('{','[') AS is_json, len(regexp_extract_all(html, '(?i)<script[^>]+type=["'']application/ld\+json')) AS n_ld,
 regexp_matches(html, '__NEXT_DATA__|window\.__NUXT__|data-page=') AS has_state, regexp_matches(html, '\$\s?[\d.]{6,}') AS has_pesos, regexp_matches(html, '\bUF\s?[\d.,]+') AS has_uf, count(*) AS n FROM pages GROUP BY ALL""")
def shape_q(t):
    """Shape of whole documents: sitemap, JSON, JSON-LD, embedded state, amounts."""
    s = pages.page_shape(F.col("html"))
    keys = ["is_sitemap", "is_json", "n_ld", "has_state", "has_pesos", "has_uf"]
    d = t("pages").select(*[s[k].cast("bigint").alias(k) if k == "n_ld" else s[k].alias(k) for k in keys])
    return d.groupBy(*keys).agg(F.count("*").alias("n"))
