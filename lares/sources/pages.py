"""Extraction of listing cards and detail pages from raw HTML, and page-shape profiling.

Only the tag structure is read in Python (standard ``html.parser``, one Arrow batch of pages
at a time); every value is then parsed with built-in expressions. An extractor is a function
from an iterator of pandas frames to an iterator of pandas frames; a page that cannot be read
yields a row with ``error`` instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.functions.exprs import (in_kind_range, is_new_from_path, location_split, parse_number, publish_bounds,
                                   safe_short_text, slugify, typology, url_sanitize)
from lares.params import DEFAULT, Params
from lares.session import settle

# --- fixed values: class names and labels of the listing pages
CARD_CLASS = "poly-card"
FALLBACK_CARD_CLASS = "ui-search-layout__item"
CARD_FIELDS = {
    "poly-price__current": "price", "andes-money-amount": "price",
    "poly-component__location": "location", "poly-component__float-highlight": "highlight",
    "poly-component__title": "title",
}
ATTRIBUTE_LISTS = ("poly-attributes_list", "poly-attributes-list")
PROJECT_WORDS = r"Desde|unidades disponibles|(?i:PROYECTO)"
REGIONS = ("metropolitana", "bio-bio", "biobio", "coquimbo", "antofagasta", "valparaiso", "bernardo-ohiggins")
CRUMB_NOISE = ("arriendo", "venta", "departamentos", "...", "propiedades usadas", "propiedades nuevas", "proyectos nuevos", "proyectos")
USED_CRUMB = "propiedades usadas"
NEW_CRUMBS = ("propiedades nuevas", "proyectos nuevos", "proyectos")
BASE_URL = "https://www.portalinmobiliario.com"
#: Pages (and bytes of them) handed to an extractor at a time; with its rows they bound a worker's memory.
BATCH_PAGES, BATCH_BYTES = 256, 8 << 20

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Walker(HTMLParser):
    """Keeps the open-element stack; subclasses see opened and closed elements and text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str]]] = []
        self.within: dict[str, int] = {}  # open elements per class

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs} if attrs else {}
        classes = a["class"].split() if "class" in a else []
        if tag not in _VOID:
            self.stack.append((tag, classes))
            for c in set(classes):
                self.within[c] = self.within.get(c, 0) + 1
        self.opened(tag, classes, a)

    def handle_startendtag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.opened(tag, a.get("class", "").split(), a)

    def handle_endtag(self, tag):
        if not (self.stack and self.stack[-1][0] == tag) and tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            t, classes = self.stack.pop()
            for c in set(classes):
                self.within[c] -= 1
            self.closed(t, len(self.stack))
            if t == tag:
                break

    def updatepos(self, i, j):  # nobody asks for line numbers
        return j

    def opened(self, tag, classes, attrs): ...

    def closed(self, tag, depth): ...


class _Cards(_Walker):
    def __init__(self, marker: str):
        super().__init__()
        self.marker, self.cards, self.card, self.at, self.fields = marker, [], None, -1, []

    def opened(self, tag, classes, attrs):
        if self.card is None and self.marker in classes:
            self.card = {"href": None, "price": "", "location": "", "highlight": "", "title": "", "attrs": [], "text": ""}
            self.at, self.fields, self.done = len(self.stack) - 1, [], set()
        if self.card is None:
            return
        if tag == "a" and self.card["href"] is None and "href" in attrs:
            self.card["href"] = attrs["href"]
        depth = len(self.stack) - 1
        for c in classes:
            name = CARD_FIELDS.get(c)
            if name and name not in self.done and not any(n == name for n, _ in self.fields):
                self.fields.append((name, depth))
        item = tag == "li" and any(x in cl for _, cl in self.stack[:-1] for x in ATTRIBUTE_LISTS)
        if item or "poly-attributes-list__item" in classes:
            self.card["attrs"].append("")
            self.fields.append(("attrs", depth))

    def handle_data(self, data):
        if self.card is None:
            return
        self.card["text"] += data
        for name, _ in self.fields:
            if name == "attrs":
                self.card["attrs"][-1] += data
            else:
                self.card[name] += data

    def closed(self, tag, depth):
        if self.card is None:
            return
        self.done |= {n for n, d in self.fields if d >= depth and n != "attrs"}
        self.fields = [(n, d) for n, d in self.fields if d < depth]
        if depth <= self.at:
            self.cards.append(self.card)
            self.card = None


def cards_of(html: str) -> list[dict]:
    for marker in (CARD_CLASS, FALLBACK_CARD_CLASS):
        if marker in html:
            w = _Cards(marker)
            w.feed(html)
            w.close()
            if w.cards:
                return w.cards
    return []


CARD_SCHEMA = (
    "page_id string, url string, card_no int, n_cards int, href string, price_text string, location string, "
    "highlight string, title string, attrs array<string>, project_text boolean, error string")


def card_extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """page_id, url, html -> one row per card, or one row with n_cards 0 or an error."""
    import re
    project = re.compile(PROJECT_WORDS)
    for pdf in batches:
        rows = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            try:
                cards = cards_of(html)
                error = None
            except Exception as exc:  # noqa: BLE001 - reported as a parse-error row
                cards, error = [], f"{type(exc).__name__}: {exc}"
            if not cards:
                rows.append((page_id, url, None, 0, None, None, None, None, None, None, None, error))
            for i, c in enumerate(cards):
                rows.append((page_id, url, i, len(cards), c["href"], c["price"].strip(), c["location"].strip(), c["highlight"].strip(),
                             c["title"].strip(), [a.strip() for a in c["attrs"]], bool(project.search(c["text"])), None))
        yield pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in CARD_SCHEMA.split(",")])


def run_extractor(pages: DataFrame, extractor: Callable, schema: str) -> DataFrame:
    """Rows of an extractor; pages come in small batches, since a page of cards is large and its rows are larger."""
    conf = pages.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_PAGES))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return pages.mapInPandas(extractor, schema)


def place_from_url(url: Column) -> Column:
    return F.regexp_extract(url, r"/([a-z0-9-]+)-(?:" + "|".join(REGIONS) + ")_Desde_", 1)


def _attribute(attrs: Column, pattern: str) -> Column:
    return F.get(F.filter(attrs, lambda a: F.lower(a).rlike(pattern)), F.lit(0))


def parse_cards(cards: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Typed listing rows: one per (page, listing id), implausible ones left out.

    Input: extractor rows plus ``operation`` and ``fetched_at``.
    """
    c = F.col
    lid = F.regexp_extract("href", r"/(MLC-\d+)", 1)
    rows = cards.where(c("error").isNull() & (lid != "")).withColumn("listing_id", lid)
    first = rows.groupBy("page_id", "listing_id").agg(F.min_by(F.struct(*[x for x in rows.columns if x not in ("page_id", "listing_id")]), "card_no").alias("r"))
    rows = first.select("page_id", "listing_id", "r.*")
    currency = F.when(F.upper("price_text").contains("UF"), "UF").otherwise("CLP")
    amount = parse_number(c("price_text"))
    beds = parse_number(F.lower(_attribute(c("attrs"), "dormitorio"))).cast("int")
    baths = parse_number(F.lower(_attribute(c("attrs"), "ba[ñn]o"))).cast("int")
    m2 = parse_number(F.regexp_replace(_attribute(c("attrs"), "m²|m2"), "m2", "m²"))
    place, hood = location_split(c("location"), place_from_url(c("url")))
    exact, since = publish_bounds(c("fetched_at"), c("highlight"))
    clean_url = F.split(F.split("href", "#")[0], r"\?")[0]
    # values are fixed before others are derived from them, else each use repeats the parsing
    rows = settle(rows.withColumns({"currency": currency, "amount": amount, "beds": beds, "baths": baths, "m2": m2, "place": place, "hood": hood}))
    out = rows.select(
        "page_id", "listing_id", "operation", "currency", "amount", "beds", "baths", typology(c("beds"), c("baths")).alias("typ"), "m2", "place", "hood",
        F.when(c("place").isNotNull() & c("hood").isNotNull(), F.concat(slugify(c("place")), F.lit("/"), slugify(c("hood")))).alias("zone"),
        url_sanitize(clean_url, c("listing_id"), BASE_URL).alias("listing_url"), safe_short_text(c("title")).alias("title"),
        F.when(c("project_text"), "E").otherwise("V").alias("evidence"), is_new_from_path(c("url")).alias("is_new"),
        exact.alias("published_on"), since.alias("published_since"))
    ok = c("amount").isNotNull() & in_kind_range(c("operation"), c("currency"), c("amount")) & (c("m2").isNull() | c("m2").between(*p.m2_range))
    return out.where(ok)


def extraction_coverage(cards: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per page: candidate cards, parsed rows, and non-NULL shares of the main fields over the parsed rows."""
    cand = cards.groupBy("page_id").agg(F.max("n_cards").alias("candidates"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    share = lambda x: F.avg(F.col(x).isNotNull().cast("double")).alias(f"share_{x}")
    got = parsed.groupBy("page_id").agg(F.count("*").alias("rows"), share("m2"), share("typ"), share("zone"))
    return cand.join(got, "page_id", "left").fillna({"rows": 0})


# ----------------------------------------------------------------- detail pages

DETAIL_SCHEMA = (
    "page_id string, url string, canonical string, crumbs array<string>, crumb_paths array<string>, symbol string, "
    "fraction string, cents string, specs map<string,string>, length int, error string")


MONEY_CLASSES = {"andes-money-amount__currency-symbol": "symbol", "andes-money-amount__fraction": "fraction", "andes-money-amount__cents": "cents"}


class _Detail(_Walker):
    def __init__(self):
        super().__init__()
        self.canonical, self.crumbs, self.paths, self.specs = "", [], [], {}
        self.money: dict[str, str | None] = {"symbol": None, "fraction": None, "cents": None}
        self.open: list[tuple[str, int]] = []
        self.row: dict[str, str] = {}

    def _inside(self, cls):
        return self.within.get(cls, 0) > 0

    def opened(self, tag, classes, attrs):
        depth = len(self.stack) - 1
        if tag == "link" and attrs.get("rel") == "canonical" and not self.canonical:
            self.canonical = attrs.get("href", "")
        if "andes-breadcrumb__item" in classes:
            self.crumbs.append("")
            self.open.append(("crumb", depth))
        if tag == "a" and self._inside("andes-breadcrumb__item"):
            self.paths.append(attrs.get("href", ""))
        for key in [MONEY_CLASSES[x] for x in MONEY_CLASSES if x in classes] if classes else ():
            if self.money[key] is None:
                self.money[key] = ""
                self.open.append((key, depth))
        if self._inside("andes-table"):
            if tag == "tr":
                self.row = {}
            elif tag in ("th", "td") and tag not in self.row:
                self.row[tag] = ""
                self.open.append((tag, depth))

    def handle_data(self, data):
        for key, _ in self.open:
            if key == "crumb":
                self.crumbs[-1] += data
            elif key in ("th", "td"):
                self.row[key] += data
            else:
                self.money[key] += data

    def closed(self, tag, depth):
        if self.open:
            self.open = [(k, d) for k, d in self.open if d < depth]
        if tag == "tr" and {"th", "td"} <= self.row.keys():
            self.specs[self.row["th"].strip()] = self.row["td"].strip()
            self.row = {}


def detail_extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            try:
                w = _Detail()
                w.feed(html)
                w.close()
                rows.append((page_id, url, w.canonical, [c.strip() for c in w.crumbs if c.strip()], w.paths, w.money["symbol"], w.money["fraction"],
                             w.money["cents"], w.specs, len(html), None))
            except Exception as exc:  # noqa: BLE001 - reported as a parse-error row
                rows.append((page_id, url, None, None, None, None, None, None, None, len(html or ""), f"{type(exc).__name__}: {exc}"))
        yield pd.DataFrame(rows, columns=["page_id", "url", "canonical", "crumbs", "crumb_paths", "symbol", "fraction", "cents", "specs", "length", "error"])


def parse_details(raw: DataFrame, min_length: int = 100_000, p: Params = DEFAULT) -> DataFrame:
    """Typed detail rows; pages too short to be a listing or without operation or price are left out."""
    c = F.col
    lid = F.regexp_extract("url", r"/(MLC-\d+)", 1)
    # values are fixed before others are derived from them, else each use repeats the parsing
    rows = settle(raw.where(c("error").isNull() & (c("length") >= min_length) & (lid != "")).withColumns({
        "_lid": lid, "_low": F.transform("crumbs", lambda x: F.lower(x)), "_paths": F.array_join("crumb_paths", " ")}))
    lid, low, paths = c("_lid"), c("_low"), c("_paths")
    operation = (F.when(F.array_contains(low, "arriendo"), "rent").when(F.array_contains(low, "venta"), "sale")
                 .when(paths.contains("/arriendo/"), "rent").when(paths.contains("/venta/"), "sale"))
    project = (F.coalesce(c("canonical"), F.lit("")) != "") & ~F.contains("canonical", lid)
    noise = F.array(*[F.lit(x) for x in CRUMB_NOISE])
    places = F.filter("crumbs", lambda x: ~F.array_contains(noise, F.lower(x)) & ~F.lower(x).contains("metropolitana"))
    cents = F.regexp_replace(F.trim("cents"), r"^,", "")
    amount = parse_number(F.concat(F.trim("fraction"), F.when(c("cents").isNotNull(), F.concat(F.lit(","), F.trim(cents))).otherwise("")))
    spec = lambda *names: F.coalesce(*[F.element_at("specs", F.lit(x)) for x in names])
    number = lambda *names: parse_number(spec(*names))
    rows = settle(rows.withColumns({
        "_places": places, "operation": operation, "currency": F.when(F.upper(F.coalesce("symbol", F.lit(""))).contains("UF"), "UF").otherwise("CLP"), "amount": amount,
        "m2": number("Superficie útil", "Superficie util"), "beds": number("Dormitorios").cast("int"), "baths": number("Baños", "Banos").cast("int"), "is_project": project}))
    n = F.size("_places")
    place = F.when(n >= 2, F.element_at("_places", -2)).when(n == 1, F.element_at("_places", -1))
    hood = F.when(n >= 2, F.element_at("_places", -1))
    new = (F.when(F.array_contains(low, USED_CRUMB) | paths.contains("propiedades-usadas"), False)
           .when(F.arrays_overlap(low, F.array(*[F.lit(x) for x in NEW_CRUMBS])) | paths.contains("propiedades-nuevas") | c("is_project"), True))
    out = rows.select(
        "page_id", lid.alias("listing_id"), "operation", "currency", "amount", place.alias("place"), hood.alias("hood"),
        F.when(place.isNotNull() & hood.isNotNull(), F.concat(slugify(place), F.lit("/"), slugify(hood))).alias("zone"),
        "m2", "beds", "baths", typology(c("beds"), c("baths")).alias("typ"),
        number("Antigüedad", "Antiguedad").cast("int").alias("age_years"), number("Gastos comunes").alias("fees_clp"),
        new.alias("is_new"), "is_project",
        url_sanitize(F.when(F.coalesce("canonical", F.lit("")) != "", c("canonical")).otherwise(c("url")), lid, BASE_URL).alias("listing_url"))
    ok = (c("operation").isNotNull() & in_kind_range(c("operation"), c("currency"), c("amount"))
          & (c("m2").isNull() | c("m2").between(*p.m2_range)) & (c("beds").isNull() | c("beds").between(0, 6)))
    return out.where(ok)


# ----------------------------------------------------------------- structured data inside pages

_LD = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
LD_SCHEMA = (
    "struct<`@type`:string,name:string,address:struct<addressLocality:string,streetAddress:string>,"
    "geo:struct<latitude:string,longitude:string>,offers:struct<lowPrice:string,priceCurrency:string>>")


def ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_LD), F.lit(1))


def project_from_ld(pages: DataFrame) -> DataFrame:
    """page_id, name, place, address, lat, lon, low_price from JSON-LD nodes (last non-NULL wins)."""
    graph = F.from_json(F.col("block"), f"struct<`@graph`:array<{LD_SCHEMA}>>")["@graph"]
    single = F.array(F.from_json(F.col("block"), LD_SCHEMA))
    b = pages.select("page_id", F.posexplode(ld_blocks(F.col("html"))).alias("i", "block"))
    n = b.select("page_id", "i", F.posexplode(F.coalesce(graph, single)).alias("j", "node"))
    c = lambda x: F.col(f"node.{x}")
    complex_, product = c("`@type`") == "ApartmentComplex", c("`@type`") == "Product"
    last = lambda v, cond: F.max_by(v, F.when(cond & v.isNotNull(), F.struct("i", "j")))
    raw = c("offers.lowPrice")
    price = F.coalesce(raw.try_cast("double"), parse_number(raw))
    return n.groupBy("page_id").agg(
        last(c("name"), complex_).alias("name"), last(c("address.addressLocality"), complex_).alias("place"),
        last(c("address.streetAddress"), complex_).alias("address"), last(c("geo.latitude").try_cast("double"), complex_).alias("lat"),
        last(c("geo.longitude").try_cast("double"), complex_).alias("lon"),
        last(price, product & c("offers.priceCurrency").isin("UF", "CLF")).alias("low_price"))


def coordinates_from_html(html: Column) -> tuple[Column, Column]:
    """(lat, lon) from an embedded map or a navigation link, only inside the country's box."""
    from lares.functions.exprs import in_chile
    lons = F.regexp_extract_all(html, F.lit(r"!2d(-?\d{1,3}\.\d{3,})!3d(-?\d{1,3}\.\d{3,})"), F.lit(1))
    lats = F.regexp_extract_all(html, F.lit(r"!2d(-?\d{1,3}\.\d{3,})!3d(-?\d{1,3}\.\d{3,})"), F.lit(2))
    pairs = F.zip_with(lats, lons, lambda a, o: F.struct(a.cast("double").alias("lat"), o.cast("double").alias("lon")))
    embed = F.get(F.filter(pairs, lambda x: in_chile(x["lat"], x["lon"])), F.lit(0))
    link = r"(?i)waze\.com/ul\?ll=(-?\d{1,3}\.\d+)(?:%2C|,)(-?\d{1,3}\.\d+)"
    wlat, wlon = (F.regexp_extract(html, link, i).try_cast("double") for i in (1, 2))
    ok = in_chile(wlat, wlon)
    return F.coalesce(embed["lat"], F.when(ok, wlat)), F.coalesce(embed["lon"], F.when(ok, wlon))


def size_range_from_html(html: Column) -> tuple[Column, Column]:
    pat = r"(?i)desde\s*([\d.,]+)\s*(?:\|\s*)?hasta\s*([\d.,]+)\s*m²"
    lo, hi = (parse_number(F.regexp_extract(html, pat, i)) for i in (1, 2))
    ok = lo.between(10, 500) & (hi >= lo)
    return F.when(ok, lo), F.when(ok, hi)


def tags_from_classes(classes: Column) -> dict[str, Column]:
    """Developer-site class tags to fields; the first tag of each taxonomy wins."""
    first = lambda prefix: F.get(F.transform(F.filter(classes, lambda c: c.startswith(prefix)), lambda c: F.substr(c, F.lit(len(prefix) + 1))), F.lit(0))
    num = lambda pat: F.element_at(F.filter(F.transform(classes, lambda c: F.regexp_extract(c, pat, 1)), lambda v: v != ""), -1).try_cast("int")
    return {
        "place_slug": F.coalesce(first("ciudad-"), first("comuna-"), first("sector-departamento-en-")),
        "status": F.coalesce(first("estado-"), first("categoria-")), "kind": first("tipologia-"), "availability": first("disponibilidad-"),
        "beds": num(r"^tag-(\d+)-dormitorio"), "baths": num(r"^tag-(\d+)-bano")}


def page_shape(html: Column) -> dict[str, Column]:
    """Shape flags of a document: sitemap, JSON, JSON-LD blocks, embedded state, visible amounts."""
    sitemap = html.contains("<urlset") | html.contains("<sitemapindex")
    head = F.substring(F.ltrim(html), 1, 1)
    return {
        "is_sitemap": sitemap, "n_loc": F.when(sitemap, F.regexp_count(html, F.lit(r"<loc>\s*[^<\s]+\s*</loc>"))).otherwise(0),
        "is_json": head.isin("{", "["), "n_ld": F.size(ld_blocks(html)),
        "has_state": html.rlike(r"__NEXT_DATA__|window\.__NUXT__|data-page="),
        "has_pesos": html.rlike(r"\$\s?[\d.]{6,}"), "has_uf": html.rlike(r"\bUF\s?[\d.,]+")}
