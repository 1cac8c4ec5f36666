"""Versioned price history (slowly changing, interval rows) and what changed in it.

Versions are built set-wise from all captures of a key, so the result does not depend on the
order in which captures arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lares.functions.exprs import lit_or
from lares.operators.asof import rate_by_day
from lares.operators.ordered import with_neighbour
from lares.operators.ranges import _running
from lares.params import DEFAULT, Params
from lares.session import cut as written

PRICE = ["price_uf", "price_clp"]


def one_per_instant(captures: DataFrame, tie: str = "event_id") -> DataFrame:
    """A second capture of a unit at the same instant replaces the first."""
    rest = [c for c in captures.columns if c not in ("unit_key", "captured")]
    return (
        captures.groupBy("unit_key", "captured").agg(F.max_by(F.struct(*rest), tie).alias("_c"))
        .select("unit_key", "captured", "_c.*")
    )


def versions(captures: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """unit_key, price_uf, price_clp, valid_from, valid_to, fetched_at (+ ``extra`` of the first capture).

    A new version starts where the price pair differs from the previous capture's (NULL-safe,
    so a change of currency is a change); a run of equal prices is one version from its first
    to its last sighting. The open version has a NULL ``valid_to``.
    """
    extra = extra or []
    captures = written(captures.select("unit_key", "captured", *PRICE, *extra))  # feeds every lookup below
    day = F.to_date("captured")
    c = with_neighbour(captures.select("unit_key", "captured", *PRICE, *extra), ["unit_key"], day, "captured",
                       F.struct("captured", *PRICE), "_prev")
    same = F.lit(True)
    for x in PRICE:
        same = same & F.col(x).eqNullSafe(F.col(f"_prev.{x}"))
    starts = c.where(F.col("_prev").isNull() | ~same)
    s = with_neighbour(starts, ["unit_key"], day, "captured", F.struct(
        F.col("captured").alias("at"), F.col("_prev.captured").alias("last_before")), "_next", previous=False)
    last = captures.groupBy("unit_key").agg(F.max("captured").alias("_last"))
    return s.join(last, "unit_key").select(
        "unit_key", *PRICE, F.col("captured").alias("valid_from"), F.col("_next.at").alias("valid_to"),
        F.coalesce("_next.last_before", "_last").alias("fetched_at"), *extra)


def merge_late(existing: DataFrame, known: DataFrame, late: DataFrame) -> DataFrame:
    """Existing versions plus captures that arrived late, recomputed for the touched units only.

    ``known`` are the captures behind ``existing``. A late capture may fall before, after or
    inside a version; it splits the version where its price differs, so the result is the same
    as if all captures had been there at once.
    """
    touched = late.select("unit_key").distinct()
    cols = ["unit_key", "captured", *PRICE, *[c for c in ("event_id",) if c in late.columns]]
    every = known.join(touched, "unit_key", "left_semi").select(*cols).unionByName(late.select(*cols))
    once = one_per_instant(every) if "event_id" in cols else every.dropDuplicates(cols)
    merged = versions(once)
    out = ["unit_key", *PRICE, "valid_from", "valid_to", "fetched_at"]
    return existing.join(touched, "unit_key", "left_anti").select(*out).unionByName(merged.select(*out))


def canonical_versions(captures: DataFrame, canonical: str = "card") -> DataFrame:
    """Versions from the canonical surface where a unit has one, else from the other surface.

    The other surface never opens a version; it only fills attributes the canonical surface
    does not give (latest non-NULL value of each).
    """
    has = captures.where(F.col("surface") == canonical).select("unit_key").distinct().withColumn("_has", F.lit(True))
    c = captures.join(has, "unit_key", "left")
    chosen = c.where(F.col("_has").isNull() | (F.col("surface") == canonical)).drop("_has")
    at = F.struct("captured", "event_id")
    own = F.col("surface") == canonical
    pick = lambda col: F.coalesce(
        F.max_by(F.col(col), F.when(own & F.col(col).isNotNull(), at)),
        F.max_by(F.col(col), F.when(F.col(col).isNotNull(), at)))
    attrs = captures.groupBy("unit_key").agg(pick("m2").alias("m2"), pick("age_years").alias("age_years"))
    return versions(one_per_instant(chosen)).join(attrs, "unit_key")


#: Microseconds of a day: the slice of time in which lookups of a unit's versions meet.
_DAY = 86_400_000_000.0


def fold_batch(open_: DataFrame, batch: DataFrame, attrs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of a source with a single surface folded into its state: (closed versions, open versions, counts).

    ``open_`` is the state, a row per unit: unit_key, price, valid_from, fetched_at and ``attrs``;
    ``batch``: unit_key, captured, price, event_id and ``attrs``. A capture older than the start of
    its unit's open version changes nothing and is counted, as is one without a price. The same
    price confirms the version and fills attributes that are still missing, never ones that are
    there; another price closes it and opens the next, with the capture's own attributes. Captures
    of a batch are taken in the order of time. The state is all that is kept between batches.
    """
    cols = ["unit_key", "captured", "price", "event_id", *attrs]
    known = open_.select("unit_key", F.col("price").alias("_p"), F.col("valid_from").alias("_f"))
    rows = written(one_per_instant(batch.where("price IS NOT NULL").select(*cols)).join(known, "unit_key", "left"))
    late = (F.col("captured") < F.col("_f")) | ((F.col("captured") == F.col("_f")) & (F.col("price") != F.col("_p")))
    kept = rows.where(~F.coalesce(late, F.lit(False)))
    own = open_.select("unit_key", F.col("valid_from").alias("captured"), "price", F.lit(None).cast("bigint").alias("event_id"), *attrs)
    # what the open version began with stands for all that was seen of it; a capture of that very instant only fills attributes
    line = written(own.unionByName(kept.where("_f IS NULL OR captured > _f").select(*cols)))
    day, seen = F.to_date("captured"), F.struct("captured", "price")
    before = with_neighbour(line, ["unit_key"], day, "captured", seen, "_prev")
    starts = written(before.where(F.col("_prev").isNull() | (F.col("_prev.price") != F.col("price"))).drop("_prev"))
    spans = with_neighbour(starts, ["unit_key"], day, "captured", F.struct("captured"), "_next", previous=False)

    at = F.unix_micros(F.col("captured").cast("timestamp")).cast("double")
    cells = starts.select("unit_key", at.alias("_x"), at.alias("start"))
    every = own.unionByName(kept.select(*cols)).withColumn("_row", F.monotonically_increasing_id())
    every = written(every)
    asks = every.select("unit_key", at.alias("_x"), F.lit(2).alias("_o"), "_row", F.lit("at").alias("_e"))
    found = _running(cells, asks, ["unit_key"], ["_row"], ["start"], _DAY, keep_greatest=True).where("_e IS NOT NULL").select("_row", "start")
    # the state's own row comes first: attributes that are there stay
    order = F.struct("captured", F.col("event_id").isNotNull(), "event_id")
    facts = every.join(found, "_row").groupBy("unit_key", "start").agg(
        F.max("captured").alias("_seen"), *[F.min_by(F.col(a), F.when(F.col(a).isNotNull(), order)).alias(a) for a in attrs])
    v = spans.drop(*attrs).withColumn("start", at).join(facts, ["unit_key", "start"]).select(
        "unit_key", "price", F.col("captured").alias("valid_from"), F.col("_next.captured").alias("valid_to"), F.col("_seen").alias("fetched_at"), *attrs)
    # an open version that nothing confirmed keeps the time it was last seen
    v = v.join(open_.select("unit_key", F.col("valid_from").alias("_f"), F.col("fetched_at").alias("_was")), "unit_key", "left")
    v = written(v.withColumn("fetched_at", F.when(F.col("valid_from") == F.col("_f"), F.greatest("fetched_at", "_was")).otherwise(F.col("fetched_at"))).drop("_f", "_was"))
    closed = v.where("valid_to IS NOT NULL")
    counts = batch.agg(F.count_if(F.col("price").isNull()).alias("no_price")).crossJoin(rows.agg(F.count_if(late).alias("out_of_order"), F.count("*").alias("_all")))
    counts = counts.crossJoin(v.join(open_.select("unit_key", F.col("valid_from").alias("_f")), "unit_key", "left").agg(
        F.count_if(F.col("_f").isNull() | (F.col("valid_from") > F.col("_f"))).alias("_opened"), F.countDistinct(F.when(F.col("_f").isNull(), F.col("unit_key"))).alias("new_units")))
    counts = counts.select("no_price", "out_of_order", "new_units", (F.col("_opened") - F.col("new_units")).alias("new_versions"), (F.col("_all") - F.col("out_of_order") - F.col("_opened")).alias("confirmed"))
    return closed, v.where("valid_to IS NULL").drop("valid_to"), counts


def overlaps(v: DataFrame) -> DataFrame:
    """Versions whose interval reaches into the next one (should be empty)."""
    w = with_neighbour(v, ["unit_key"], F.to_date("valid_from"), "valid_from", F.struct("valid_from"), "_n", previous=False)
    return w.where(F.col("valid_to") > F.col("_n.valid_from")).drop("_n")


def price_changes(v: DataFrame, rates: DataFrame, cut, p: Params = DEFAULT) -> DataFrame:
    """Net change per unit: oldest closed version against the open one, both in UF of their day.

    Units that cannot be converted on either side come back with ``convertible`` false.
    """
    daily = F.broadcast(rate_by_day(rates, p))
    uf = lambda price_uf, price_clp, rate: F.coalesce(price_uf, price_clp / rate)
    first = (
        v.where("valid_to is not null").groupBy("unit_key")
        .agg(F.min_by(F.struct("price_uf", "price_clp", "valid_from"), "valid_from").alias("o")))
    now = v.where(F.col("valid_to").isNull() & (F.col("valid_from") >= lit_or(cut)))
    j = now.join(first, "unit_key")
    old_day, new_day = F.to_date("o.valid_from"), F.to_date("valid_from")
    j = j.withColumn("_od", old_day).withColumn("_nd", new_day)
    j = j.join(daily.select(F.col("valid_day").alias("_od"), F.col("rate").alias("_or")), "_od", "left")
    j = j.join(daily.select(F.col("valid_day").alias("_nd"), F.col("rate").alias("_nr")), "_nd", "left")
    before, after = uf(F.col("o.price_uf"), F.col("o.price_clp"), F.col("_or")), uf(F.col("price_uf"), F.col("price_clp"), F.col("_nr"))
    out = j.select("unit_key", *[c for c in ("zone", "m2") if c in v.columns], before.alias("before"), after.alias("after"))
    return (
        out.withColumn("convertible", F.col("before").isNotNull() & F.col("after").isNotNull())
        .withColumn("change", F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before"))
                    .when(F.col("before") == 0, F.lit(0.0)))
    )


def price_drops(v: DataFrame, cut) -> DataFrame:
    """Closed "from" prices whose successor starts where they end and is cheaper."""
    a = v.where(F.col("from_price") & (F.col("valid_to") >= lit_or(cut)))
    b = v.select("unit_key", F.col("valid_from").alias("valid_to"), F.col("price_uf").alias("after"))
    j = a.join(b, ["unit_key", "valid_to"]).where(F.col("after") < F.col("price_uf"))
    return j.select("unit_key", F.col("price_uf").alias("before"), "after", "valid_to",
                    ((F.col("after") - F.col("price_uf")) / F.col("price_uf")).alias("change"))


def new_units(v: DataFrame, cut) -> DataFrame:
    """Open versions born after the cut of units without any closed version."""
    closed = v.where("valid_to is not null").select("unit_key").distinct()
    born = v.where(F.col("valid_to").isNull() & (F.col("valid_from") >= lit_or(cut)) & (F.col("fetched_at") >= lit_or(cut)))
    return born.join(closed, "unit_key", "left_anti")


def market_delta(v: DataFrame, rates: DataFrame, cut, p: Params = DEFAULT) -> DataFrame:
    """One row of counters before and after the cut, inside the re-visited zones only."""
    v, cut = written(v), lit_or(cut)  # read eight times below
    zones = v.where((F.col("fetched_at") >= cut) & F.col("zone").isNotNull()).select("zone").distinct().withColumn("_in", F.lit(True))
    cur = v.where("valid_to is null").join(zones, "zone", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    old, seen = F.col("valid_from") < cut, F.col("fetched_at") >= cut
    counts = cur.agg(
        F.count_if(old & ~seen & F.col("_in")).alias("gone"),
        F.count_if(old & ~seen & ~F.col("_in")).alias("out_of_scope"),
        F.count_if(old & seen).alias("unchanged"),
        F.count_if(old & F.col("_in")).alias("seen_before"),
        F.count_if(seen & F.col("_in")).alias("seen_now"))
    ch = price_changes(v, rates, cut, p).agg(
        F.count_if(F.col("convertible") & (F.col("change") < 0)).alias("dropped"),
        F.count_if(F.col("convertible") & (F.col("change") > 0)).alias("raised"),
        F.count_if(~F.col("convertible")).alias("not_convertible"))
    fresh = new_units(v, cut).agg(F.count("*").alias("new_units"))
    days = v.where(old).select(F.to_date("valid_from").alias("d")).distinct().agg(F.count("*").alias("previous_captures"))
    nz = zones.agg(F.count("*").alias("zones_visited"))
    out = counts
    for one_row in (ch, fresh, days, nz):
        out = out.crossJoin(one_row)
    return out.withColumn("coverage", F.when(F.col("seen_before") > 0, F.col("seen_now") / F.col("seen_before")).otherwise(1.0))


# ----------------------------------------------------------------- snapshots over time


def campaign_split(days: DataFrame) -> DataFrame:
    """The largest gap between consecutive capture days: split_day, gap_days.

    The input is reduced to distinct calendar days first, so the ordered step works on at
    most one row per day.
    """
    d = days.select("day").distinct()
    g = d.withColumn("gap_days", F.datediff("day", F.lag("day").over(Window.orderBy("day"))))
    best = F.max(F.struct("gap_days", "day")).alias("b")
    return g.where("gap_days is not null").agg(best).select(F.col("b.day").alias("split_day"), F.col("b.gap_days").alias("gap_days"))


def permanence(sightings: DataFrame, minimum: int = 8, min_gap: int = 21) -> DataFrame:
    """Share of old-campaign listings still present in the new campaign, per zone.

    ``sightings``: day, listing_id, zone, title, m2. A signature (zone, title, m2) shared by
    more than one listing inside a campaign identifies nobody and is left out. Listings are
    counted by distinct id, so the same listing seen on two days of a campaign counts once.
    """
    split = campaign_split(sightings).where(F.col("gap_days") >= min_gap)
    s = sightings.crossJoin(F.broadcast(split)).withColumn("old", F.col("day") < F.col("split_day"))
    per_listing = s.select("zone", "title", "m2", "old", "listing_id").distinct()
    sig = per_listing.groupBy("zone", "title", "m2").agg(
        F.count_if("old").alias("n_old"), F.count_if(~F.col("old")).alias("n_new"))
    return (
        sig.groupBy("zone").agg(
            F.count_if(F.col("n_old") == 1).alias("before"), F.count_if(F.col("n_new") == 1).alias("now"),
            F.count_if((F.col("n_old") == 1) & (F.col("n_new") == 1)).alias("remain"))
        .where((F.col("before") >= minimum) & (F.col("now") >= minimum))
        .withColumn("share", F.col("remain") / F.col("before"))
    )


# ----------------------------------------------------------------- keyed sinks as set operations


def upsert_last(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins per natural key."""
    rest = [c for c in existing.columns if c not in key]
    both = existing.unionByName(incoming)
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def upsert_earliest(rows: DataFrame, key: str, latest: list[str], earliest: list[str], order: list[str]) -> DataFrame:
    """Latest value of ``latest`` columns and the earliest known value of ``earliest`` columns."""
    return rows.groupBy(key).agg(
        F.max_by(F.struct(*latest), F.struct(*order)).alias("_l"), *[F.min(c).alias(c) for c in earliest]
    ).select(key, "_l.*", *earliest)


def fill_gaps(primary: DataFrame, fallback: DataFrame, key: list[str]) -> DataFrame:
    """Primary rows plus fallback rows for keys the primary lacks; nothing is overwritten."""
    return primary.unionByName(fallback.join(primary.select(*key), key, "left_anti"))


def source_discrepancies(primary: DataFrame, fallback: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    a = primary.select(*key, F.col("value").alias("value"))
    b = fallback.select(*key, F.col("value").alias("other"))
    gap = F.when(F.col("value") == 0, 0.0).otherwise(F.abs(F.col("other") - F.col("value")) / F.abs("value"))
    return a.join(b, key).withColumn("gap", gap).where(F.col("gap") > tolerance)


def insert_absent(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows plus one incoming row per absent key: the smallest of its rows, column by column."""
    rest = [c for c in incoming.columns if c not in key]
    one = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else incoming.distinct()
    new = one.join(existing.select(*key), key, "left_anti")
    return existing.unionByName(new)


def update_or_insert(existing: DataFrame, incoming: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Incoming non-NULL values replace, others keep; new keys are inserted."""
    a, b = existing.alias("a"), incoming.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    return a.join(b, cond, "full").select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in cols])


def best_rate(offers: DataFrame, key: list[str], rate: str) -> DataFrame:
    rest = [c for c in offers.columns if c not in key]
    return offers.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(rate, *[c for c in rest if c != rate])).alias("_r")).select(*key, "_r.*")


def changed_dimensions(existing: DataFrame, incoming: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """How many frozen dimension rows the incoming batch would change, per column."""
    a, b = existing.alias("a"), incoming.alias("b")
    j = a.join(b, key)
    diff = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    anyd = F.lit(False)
    for c in cols:
        anyd = anyd | diff(c)
    return j.agg(F.count("*").alias("compared"), F.count_if(anyd).alias("changed"),
                 *[F.count_if(diff(c)).alias(f"changed_{c}") for c in cols])
