"""Column builders for listing data: bands, parsing, text predicates, geography.

Every function takes Columns and returns a Column made of built-in expressions, so the
whole projection stays inside code generation and Catalyst can push filters through it.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lares import params as P


def lit_or(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def rnd(c: Column, digits: int = 6) -> Column:
    """Round and drop the sign of a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


# ----------------------------------------------------------------- bands and predicates


def size_band(m2: Column, bands=P.RENT_BANDS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in reversed(tuple(bands)):
        out = F.when((m2 >= float(lo)) & (m2 < float(hi)), F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def micro_band(m2: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(P.MICRO_BANDS):
        out = F.when((m2 >= lo) & (m2 < hi), F.lit(name)).otherwise(out)
    return out


def typology(beds: Column, baths: Column) -> Column:
    return F.when(beds.isNotNull() & baths.isNotNull(),
                  F.when(beds == 0, F.lit("studio"))
                  .otherwise(F.concat(beds.cast("string"), F.lit("D"), baths.cast("string"), F.lit("B"))))


def implausible_reason(price: Column, m2: Column, p: P.Params = P.DEFAULT) -> Column:
    """First violated plausibility rule, NULL when the row is plausible or incomplete."""
    ratio = price / m2
    return (
        F.when(price.isNull() | m2.isNull(), F.lit(None).cast("string"))
        .when(~price.between(*p.price_range), F.lit("price_out_of_range"))
        .when(~m2.between(*p.m2_range), F.lit("size_out_of_range"))
        .when(ratio < p.uf_m2_range[0], F.lit("uf_m2_below_minimum"))
        .when(ratio > p.uf_m2_range[1], F.lit("uf_m2_above_maximum"))
    )


def in_kind_range(operation: Column, currency: Column, amount: Column) -> Column:
    """Is the amount plausible for its (operation, currency)? Unknown kinds are not."""
    tests = [
        (operation == op) & (currency == cur) & amount.between(lo, hi)
        for op, cur, lo, hi in P.PRICE_RANGES
    ]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def text_not_comparable(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + P.NOT_COMPARABLE_PATTERN)


def text_doubtful(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + P.DOUBTFUL_PATTERN) & ~text_not_comparable(text)


def freshness_reason(seen: Column, now, days: int = P.DEFAULT.fresh_days) -> Column:
    """NULL = fresh. A row without a date cannot prove freshness and gets its own reason."""
    now = lit_or(now)
    return F.when(seen.isNull(), F.lit("no_date")).when(
        seen < now - F.expr(f"INTERVAL {days} DAYS"), F.lit("stale"))


def is_new_from_path(url: Column) -> Column:
    return (
        F.when(url.contains("/propiedades-usadas/"), F.lit(False))
        .when(url.contains("/propiedades-nuevas/") | url.contains("/proyectos/"), F.lit(True))
    )


def evidence_worst(*levels: Column) -> Column:
    """Level of a derived value: unknown beats assumption beats derived."""
    any_of = lambda v: reduce(lambda a, b: a | b, [F.coalesce(c == v, F.lit(False)) for c in levels])
    return F.when(any_of("ND"), "ND").when(any_of("E"), "E").otherwise("D")


# ----------------------------------------------------------------- text normalisation


# Latin supplement and extensions, letter-like symbols and ligatures
_FOLD_RANGES = ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2190), (0xFB00, 0xFB07))


def _accent_rules():
    """Single-letter folds and multi-letter folds of accented Latin letters, by Unicode rule."""
    one_from, one_to, many = [], [], []
    for code in [c for lo, hi in _FOLD_RANGES for c in range(lo, hi)]:
        ch = chr(code)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one_from.append(ch)
            one_to.append(folded)
        elif len(folded) > 1:
            many.append((ch, folded))
    return "".join(one_from), "".join(one_to), many


_ACC_FROM, _ACC_TO, _ACC_MANY = _accent_rules()


def strip_accents(text: Column) -> Column:
    single = F.translate(text, _ACC_FROM, _ACC_TO)
    many = single
    for ch, rep in _ACC_MANY:
        many = F.replace(many, F.lit(ch), F.lit(rep))
    rare = "[" + "".join(ch for ch, _ in _ACC_MANY) + "]"
    folded = F.regexp_replace(F.when(text.rlike(rare), many).otherwise(single), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def slugify(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def flat_text(text: Column) -> Column:
    """Lower case, no accents, hyphens as blanks."""
    return F.replace(F.lower(strip_accents(text)), F.lit("-"), F.lit(" "))


# ----------------------------------------------------------------- numbers and dates


def parse_number(text: Column) -> Column:
    """Local-format number: dot groups thousands, comma is decimal. Not exactly one number -> NULL."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.NUMBER_PATTERN), F.lit(0))
    raw = F.replace(F.replace(F.get(found, F.lit(0)), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(F.size(found) == 1, raw.try_cast("double"))


def parse_number_ranged(text: Column, lo, hi) -> Column:
    """Ambiguous separators resolved only when exactly one reading falls in [lo, hi]."""
    t = F.regexp_replace(F.trim(text), r"[\s ]", "")
    lo, hi = lit_or(lo), lit_or(hi)
    n_dot = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    last = lambda ch: F.length(t) - F.instr(F.reverse(t), ch)
    no_dots = F.replace(t, F.lit("."), F.lit(""))
    comma_decimal = F.replace(no_dots, F.lit(","), F.lit(".")).try_cast("double")
    dot_decimal = F.replace(t, F.lit(","), F.lit("")).try_cast("double")
    thousands, decimal = no_dots.try_cast("double"), t.try_cast("double")
    fits_t, fits_d = thousands.between(lo, hi), decimal.between(lo, hi)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("double"))
        .when(t.contains(",") & t.contains("."),
              F.when(last(",") > last("."), comma_decimal).otherwise(dot_decimal))
        .when(t.contains(","), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))
        .when(n_dot == 0, F.when(t.rlike(r"^-?\d+$"), t.try_cast("double")))
        .when(n_dot > 1, thousands)
        .when(thousands == decimal, thousands)
        .when(fits_t & ~fits_d, thousands)
        .when(fits_d & ~fits_t, decimal)
    )


def parse_date_strict(text: Column) -> Column:
    """ISO always; day-first only when the first part cannot be a month; else NULL."""
    t = F.trim(text)
    head = F.split(F.split(F.replace(t, F.lit("Z"), F.lit("")), "T")[0], " ")[0]
    local = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    part = lambda i: F.regexp_extract(t, local, i)
    d, m, y = (F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3))
    return (
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))
        .when(t.rlike(local) & (part(1).try_cast("int") > 12),
              F.concat_ws("-", y, m, d).try_cast("date"))
    )


def publish_bounds(captured_utc: Column, label: Column) -> tuple[Column, Column]:
    """(exact date, earliest date) from a relative label, on the local calendar."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Santiago"), captured_utc.cast("timestamp_ntz"))
    local_day = local.cast("date")
    plain = F.upper(F.trim(label))
    exact = F.when(plain == "PUBLICADO HOY", local_day)
    since = F.when(plain == "PUBLICADO HOY", local_day).when(
        plain == "PUBLICADO ESTA SEMANA", F.date_sub(local_day, 7))
    return exact, since


def location_split(text: Column, url_place: Column) -> tuple[Column, Column]:
    """(municipality, neighbourhood): the search filter in the URL anchors the municipality."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    written = F.get(F.filter(parts, lambda x: slugify(x) == url_place), F.lit(0))
    others = F.filter(parts, lambda x: slugify(x) != url_place)
    anchored_place = F.coalesce(written, F.initcap(F.replace(url_place, F.lit("-"), F.lit(" "))))
    last_other = F.when(F.size(others) > 0, F.element_at(others, -1))
    anchored_hood = F.when(~last_other.rlike(r"\d"), last_other)
    n = F.size(parts)
    loose_place = F.when(n >= 1, F.element_at(parts, -1))
    loose_hood = F.when(n >= 2, F.element_at(parts, -2))
    has_url = url_place.isNotNull() & (url_place != "")
    return (
        F.when(has_url, anchored_place).otherwise(loose_place),
        F.when(has_url, anchored_hood).otherwise(loose_hood),
    )


# ----------------------------------------------------------------- personal data and secrets


def pii_redact(text: Column) -> tuple[Column, Column]:
    """(clean text, number of removals) applying each pattern to the previous result."""
    clean, total = text, F.when(text.isNotNull(), 0)
    for _, pattern, replacement, needles in P.REDACTION_PATTERNS:
        # a plain substring test first: most texts hold no candidate and skip the pattern
        may = reduce(lambda a, b: a | b, [F.contains(clean, F.lit(n)) for n in needles])
        total = total + F.when(may, F.regexp_count(clean, F.lit(pattern))).otherwise(0)
        clean = F.when(may, F.regexp_replace(clean, pattern, replacement)).otherwise(clean)
    return clean, total


def safe_short_text(text: Column) -> Column:
    """Titles and URLs: redaction plus bare nine-digit mobile numbers."""
    return F.regexp_replace(pii_redact(text)[0], P.LOOSE_PHONE_PATTERN, "[fono-removido]")


def url_sanitize(url: Column, listing_id: Column, base: Column | str) -> Column:
    """Cut the URL to its canonical form when its slug carries contact data."""
    dirty = reduce(lambda a, b: a | b,
                   [url.rlike(pat) for _, pat, _, _ in P.REDACTION_PATTERNS] + [url.rlike(P.LOOSE_PHONE_PATTERN)])
    return F.when(dirty & listing_id.isNotNull(), F.concat(lit_or(base), F.lit("/"), listing_id)).otherwise(url)


def mask_secret(text: Column) -> Column:
    return F.regexp_replace(text, r"(apikey=)[^&\s]+", "$1OCULTA")


def pii_kinds(value: Column) -> Column:
    """Array of personal-data kinds found in one string; company tax ids are allowed."""
    tests = []
    for kind, pattern in P.PII_SCAN_PATTERNS:
        hit = value.rlike(pattern)
        if kind == "tax_id":
            digits = F.regexp_replace(
                F.split(F.regexp_extract(value, pattern, 0), "-")[0], r"[^\d]", "")
            hit = hit & ~F.coalesce(digits.try_cast("bigint") >= P.COMPANY_TAX_ID_FROM, F.lit(False))
        tests.append(F.when(hit, F.lit(kind)))
    return F.array_compact(F.array(*tests))


# ----------------------------------------------------------------- geography


def in_chile(lat: Column, lon: Column) -> Column:
    return lat.between(-56.5, -17.0) & lon.between(-76.0, -66.0)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, longitude scaled at the mean latitude."""
    k = 111_320.0
    klon = F.cos(F.radians((lat1 + lat2) / 2.0)) * k
    return F.sqrt(F.pow((lat1 - lat2) * k, F.lit(2.0)) + F.pow((lon1 - lon2) * klon, F.lit(2.0)))


def distance_capped_m(lat: Column, lon: Column, clat: Column, clon: Column) -> Column:
    """Variant scaled at the project's own latitude, with a separate metre per degree of latitude."""
    dx = (lon - clon) * 111_320.0 * F.cos(F.radians(lat))
    dy = (lat - clat) * 110_540.0
    return F.sqrt(dx * dx + dy * dy)


def geocode_accept(display: Column, place: Column) -> Column:
    return F.contains(flat_text(display), flat_text(place))


def geocode_queries(name: Column, address: Column, place: Column) -> Column:
    """Address first, then name; blanks dropped, duplicates dropped."""
    q = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "",
                         F.concat(F.trim(c), F.lit(", "), place, F.lit(", Chile")))
    return F.array_distinct(F.array_compact(F.array(q(address), q(name))))
