"""Rent side: comparables, furnished pool, cells, audits and simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.functions.exprs import (freshness_reason, lit_or, micro_band, size_band, text_doubtful,
                                   text_not_comparable)
from lares.operators.asof import with_rate
from lares.operators.quantiles import grouped_quantiles
from lares.params import DEFAULT, Params
from lares.session import cut, settle

SIGNATURE = ["zone", "typ", "m2", "rent_uf", "rent_clp"]


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def row_reasons(rents: DataFrame, rates: DataFrame, now=None, p: Params = DEFAULT) -> DataFrame:
    """Active, unsuspicious listings with ``rent`` in UF and the one reason that discards them.

    Reasons are one ordered CASE, so the counts of all reasons and of the kept rows add up.
    """
    base = rents.where(F.col("active") & ~F.coalesce(F.col("suspicious"), F.lit(False)))
    base = with_rate(base, rates, "seen", p)
    rent = F.coalesce(F.col("rent_uf"), F.col("rent_clp") / F.col("rate"))
    reason = F.lit(None).cast("string")
    reason = F.when(rent.isNull(), "no_uf_rate").otherwise(reason)
    reason = F.when(~F.coalesce(_truthy(F.col("m2")), F.lit(False)), "no_m2").otherwise(reason)
    reason = F.when(F.coalesce(F.col("typ"), F.lit("")) == "", "no_typ").otherwise(reason)
    reason = F.when(F.coalesce(F.col("zone"), F.lit("")) == "", "no_zone").otherwise(reason)
    reason = F.when(text_not_comparable(F.col("url")), "furnished").otherwise(reason)
    if now is not None:
        stale = freshness_reason(F.col("seen"), now, p.fresh_days)
        reason = F.when(stale.isNotNull(), stale).otherwise(reason)
    return base.withColumn("rent", rent).withColumn("reason", reason)


def _signatures(rows: DataFrame, ids: bool = False, unpriced: bool = False) -> DataFrame:
    """One row per exact (zone, type, size, price) with furnished and clean counts.

    A plain aggregation instead of a window: copies of one listing may be a third of the
    table, and partial aggregation reduces them before the shuffle. Units of a multifamily
    building are exempt from collapsing, so their own id joins the key. Without ``ids`` all
    aggregation buffers are fixed-width, which keeps the hash aggregate.
    """
    furnished = (F.col("reason") == "furnished") & F.col("zone").isNotNull() & F.col("typ").isNotNull() & _truthy(F.col("m2"))
    if not unpriced:
        furnished = furnished & (F.col("rent_uf").isNotNull() | F.col("rent_clp").isNotNull())
    furnished = F.coalesce(furnished, F.lit(False))
    clean = F.col("reason").isNull()
    solo = F.when(clean & F.coalesce(F.col("multifamily"), F.lit(False)), F.col("comp_id"))
    aggs = [F.count_if(~F.col("_clean")).alias("n_furnished"), F.count_if("_clean").alias("n_clean"),
            F.max(F.when(F.col("_clean"), F.col("seen"))).alias("seen")]
    if ids:
        aggs.append(F.max(F.when(F.col("_clean"), F.struct("seen", "comp_id"))).alias("_best"))
    out = rows.where(furnished | clean).withColumn("_clean", clean).withColumn("solo", solo).groupBy(*SIGNATURE, "solo").agg(*aggs)
    return out.withColumn("comp_id", F.col("_best.comp_id")).drop("_best") if ids else out


def comparables(rents: DataFrame, rates: DataFrame, now=None, p: Params = DEFAULT, collapse: bool = True, ids: bool = False) -> DataFrame:
    """Clean comparables: zone, typ, m2, rent, listings, seen (and comp_id with ``ids``).

    Order: row filters, rate conversion, removal of twins of furnished listings, collapse of
    relistings to their latest sighting. The rent of a collapsed group is its price at the
    rate of that latest day, so the rate is looked up again once per group.
    """
    rows = row_reasons(rents, rates, now, p)
    sig = _signatures(rows, ids)
    id_cols = ["comp_id"] if ids else []
    if collapse:
        return _collapsed(sig, rates, id_cols, p)
    twins = sig.where((F.col("n_clean") > 0) & (F.col("n_furnished") > 0)).select(*SIGNATURE)
    plain = rows.where(F.col("reason").isNull())
    cond = [plain[c].eqNullSafe(twins[c]) for c in SIGNATURE]
    cond.append(~F.coalesce(plain["multifamily"], F.lit(False)))
    return plain.join(twins, cond, "left_anti").select(
        *id_cols, "zone", "typ", "m2", "rent", F.lit(1).cast("bigint").alias("listings"), "seen")


def _collapsed(sig: DataFrame, rates: DataFrame, id_cols: list[str], p: Params) -> DataFrame:
    kept = with_rate(sig.where((F.col("n_clean") > 0) & (F.col("n_furnished") == 0)), rates, "seen", p)
    return kept.select(*id_cols, "zone", "typ", "m2", F.coalesce("rent_uf", F.col("rent_clp") / F.col("rate")).alias("rent"),
                       F.col("n_clean").alias("listings"), "seen")


def comparables_and_furnished(rents: DataFrame, rates: DataFrame, now=None, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``comparables`` and ``furnished_sizes`` from one pass over the listings: both read the written signatures.

    The reason is a column of its own before the rows are filtered and counted by it, else its
    text search is repeated for each use.
    """
    rows = row_reasons(rents, rates, now, p).select(*SIGNATURE, "comp_id", "multifamily", "seen", "reason")
    sig = cut(_signatures(settle(rows), unpriced=True))
    priced = F.col("rent_uf").isNotNull() | F.col("rent_clp").isNotNull()
    furnished = (
        sig.where((F.col("n_furnished") > 0) & (F.col("m2") < p.furnished_max_m2))
        .withColumn("n", F.when(priced, 1).otherwise(F.col("n_furnished")))
        .groupBy("zone", "typ", "m2").agg(F.sum("n").cast("bigint").alias("n")))
    return _collapsed(sig, rates, [], p), furnished


def counted(comps: DataFrame) -> DataFrame:
    """Comparables as zone, typ, m2, rent, n, listings: the reduced table every later step reads."""
    return comps.groupBy("zone", "typ", "m2", "rent").agg(F.count("*").alias("n"), F.sum("listings").cast("bigint").alias("listings"))


def discard_counts(rents: DataFrame, rates: DataFrame, now=None, p: Params = DEFAULT) -> DataFrame:
    """reason, n: every input listing is counted exactly once, kept rows under ``kept``."""
    rows = row_reasons(rents, rates, now, p)
    direct = rows.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
    twin = F.col("n_furnished") > 0
    sig = (
        _signatures(rows).where(F.col("n_clean") > 0)
        .select(F.explode(F.array(
            F.struct(F.lit("furnished_twin").alias("reason"), F.when(twin, F.col("n_clean")).otherwise(0).alias("n")),
            F.struct(F.lit("relisting").alias("reason"), F.when(twin, 0).otherwise(F.col("n_clean") - 1).alias("n")),
            F.struct(F.lit("kept").alias("reason"), F.when(twin, 0).otherwise(1).alias("n")))).alias("x"))
        .select("x.*"))
    return direct.unionByName(sig).groupBy("reason").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")


def furnished_sizes(rents: DataFrame, now=None, p: Params = DEFAULT) -> DataFrame:
    """zone, typ, m2, n: furnished listings per size, relistings counted once.

    Rows without any price have no signature to collapse on and count one each.
    """
    rows = rents.where(
        F.col("active") & ~F.coalesce(F.col("suspicious"), F.lit(False)) & F.col("zone").isNotNull()
        & F.col("typ").isNotNull() & _truthy(F.col("m2")) & (F.col("m2") < p.furnished_max_m2)
        & text_not_comparable(F.col("url")))
    if now is not None:
        rows = rows.where(freshness_reason(F.col("seen"), now, p.fresh_days).isNull())
    priced = F.col("rent_uf").isNotNull() | F.col("rent_clp").isNotNull()
    per_sig = rows.groupBy(*SIGNATURE).agg(F.count("*").alias("k"))
    return (
        per_sig.withColumn("n", F.when(priced, 1).otherwise(F.col("k")))
        .groupBy("zone", "typ", "m2").agg(F.sum("n").cast("bigint").alias("n"))
    )


def cells(comps: DataFrame, bands=DEFAULT.bands, keys=("zone", "typ"), p: Params = DEFAULT) -> DataFrame:
    """Rent per (zone, type, size band): counts, quartiles, price per m2, typical size."""
    keys = [*keys, "band"]
    banded = cut(counted(comps)).withColumn("band", size_band(F.col("m2"), bands)).where(F.col("band").isNotNull())
    counts = banded.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("listings").alias("listings"))
    measures = banded.select(*keys, "n", F.explode(F.array(
        F.struct(F.lit("rent").alias("what"), F.col("rent").alias("v")),
        F.struct(F.lit("per_m2").alias("what"), (F.col("rent") / F.col("m2")).alias("v")),
        F.struct(F.lit("m2").alias("what"), F.col("m2").alias("v")))).alias("x")).select(*keys, "n", "x.what", "x.v")
    q = grouped_quantiles(measures, [*keys, "what"], F.col("v"), {"p25": 0.25, "median": 0.5, "p75": 0.75}, F.col("n"))
    pick = lambda what, col: F.max(F.when(F.col("what") == what, F.col(col)))
    wide = q.groupBy(*keys).agg(
        pick("rent", "p25").alias("rent_p25"), pick("rent", "median").alias("rent_median"),
        pick("rent", "p75").alias("rent_p75"), pick("per_m2", "median").alias("rent_m2_median"),
        pick("m2", "median").alias("m2_median"))
    return (
        counts.join(wide, keys)
        .withColumn("sufficient", F.col("n") >= p.min_comparables)
        .withColumn("dispersion", F.when(F.col("rent_median") != 0,
                                         (F.col("rent_p75") - F.col("rent_p25")) / F.col("rent_median")).otherwise(0.0))
    )


def audit(rents: DataFrame, rates: DataFrame, now, p: Params = DEFAULT) -> DataFrame:
    """Every active listing behind each cell with one status; relistings keep the latest."""
    rows = (
        rents.where(F.col("active") & F.col("rent_clp").isNotNull() & F.col("zone").isNotNull())
        .withColumn("_fresh", freshness_reason(F.col("seen"), now, p.fresh_days).isNull())
        .withColumn("_furn", text_not_comparable(F.col("url"))))
    enters = F.col("_fresh") & ~F.col("_furn")
    multi = F.coalesce(F.col("multifamily"), F.lit(False))
    sig = ["zone", "typ", "m2", "rent_clp", "rent_uf"]
    latest = (
        rows.where(enters & ~multi).groupBy(*sig)
        .agg(F.max(F.struct("seen", "comp_id")).alias("latest")))
    cond = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in sig]
    status = (
        F.when(F.col("r._furn"), "furnished").when(~F.col("r._fresh"), "stale")
        .when(~F.coalesce(F.col("r.multifamily"), F.lit(False)) & (F.col("s.latest.comp_id") != F.col("r.comp_id")), "relisting")
        .when(text_doubtful(F.col("r.url")), "doubtful").otherwise("used"))
    return rows.alias("r").join(latest.alias("s"), cond, "left").select(
        "r.comp_id", "r.zone", "r.typ", "r.m2", "r.rent_clp", status.alias("status"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """Counts per status and the median of the rows that feed it, per (zone, type)."""
    keys = ["zone", "typ"]
    feeds = F.col("status").isin("used", "doubtful")
    counts = audited.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "furnished").alias("n_furnished"),
        F.count_if(F.col("status") == "stale").alias("n_stale"),
        F.count_if(F.col("status") == "relisting").alias("n_relisting"),
        F.count_if(F.col("status") == "doubtful").alias("n_doubtful"), F.count_if(feeds).alias("n_used"))
    med = grouped_quantiles(audited.where(feeds), keys, F.col("rent_clp"), {"median_clp": 0.5}).drop("n_values")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return counts.alias("a").join(med.alias("b"), cond, "left").select("a.*", "b.median_clp")


def microunit_rent(rents: DataFrame, now, p: Params = DEFAULT) -> DataFrame:
    """Age, price and fees per m2 by analysis band, over all active unfurnished listings."""
    now = lit_or(now)
    rows = (
        rents.where(F.col("active") & ~F.coalesce(F.col("suspicious"), F.lit(False))
                    & ~text_not_comparable(F.col("url")) & (F.col("m2") > 0))
        .withColumn("band", micro_band(F.col("m2"))).where(F.col("band").isNotNull()))
    seen = F.col("seen").cast("date")
    first = F.coalesce(F.col("first_seen"), F.col("seen")).cast("date")
    declared = F.when((F.col("published_on") < seen) & (F.col("published_on") <= first),
                      F.datediff(seen, F.col("published_on")))
    fees = F.when(F.col("fees_clp") > 0, F.col("fees_clp") / F.col("m2"))
    rows = rows.select("band", "published_since", declared.alias("age"), F.datediff(now, first).alias("age_floor"),
                       (F.col("rent_uf") / F.col("m2")).alias("per_m2"), fees.alias("fees"))
    counts = rows.groupBy("band").agg(
        F.count("*").alias("n"), F.count("age").alias("n_dated"), F.count("fees").alias("n_fees"),
        F.avg(F.col("published_since").isNotNull().cast("double")).alias("share_seen_fresh"),
        F.count("published_since").alias("n_labelled"))
    stack = rows.select("band", F.explode(F.array(*[
        F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("v"))
        for c in ("age", "age_floor", "per_m2", "fees")])).alias("x")).select("band", "x.*")
    q = grouped_quantiles(stack, ["band", "what"], F.col("v"), {"med": 0.5})
    wide = q.groupBy("band").agg(*[
        F.max(F.when(F.col("what") == c, F.col("med"))).alias(f"{c}_median")
        for c in ("age", "age_floor", "per_m2", "fees")])
    return counts.join(wide, "band", "left")


def microunit_sale(versions: DataFrame, first_before, recent_after) -> DataFrame:
    """Per band: share of units not seen again and share whose price fell."""
    per_unit = (
        versions.where((F.col("m2") > 0) & F.col("price_uf").isNotNull())
        .withColumn("band", micro_band(F.col("m2")))
        .groupBy("unit_key", "band")
        .agg(F.min("valid_from").alias("first"), F.max("fetched_at").alias("last"),
             F.min_by("price_uf", "valid_from").alias("p0"), F.max_by("price_uf", "valid_from").alias("p1")))
    return (
        per_unit.where((F.col("first") < first_before) & F.col("band").isNotNull())
        .groupBy("band").agg(
            F.count("*").alias("n"),
            F.avg((F.col("last") < recent_after).cast("double")).alias("share_not_seen"),
            F.avg((F.col("p1") < F.col("p0")).cast("double")).alias("share_dropped"))
    )


def band_simulation(comps: DataFrame, units: DataFrame, current, proposed, p: Params = DEFAULT) -> DataFrame:
    """What changing the size bands does: usable cells, and units lost, gained, well matched."""
    comps = cut(comps.select("zone", "typ", "m2", "rent", "listings"))
    a = cells(comps, current, p=p).where("sufficient").select("zone", "typ", F.col("band").alias("band_a"), F.lit(True).alias("in_a"))
    b = cells(comps, proposed, p=p).where("sufficient").select(
        "zone", "typ", F.col("band").alias("band_b"), F.lit(True).alias("in_b"), F.col("m2_median").alias("typical"))
    u = units.withColumn("band_a", size_band(F.col("m2"), current)).withColumn("band_b", size_band(F.col("m2"), proposed))
    j = u.join(a, ["zone", "typ", "band_a"], "left").join(b, ["zone", "typ", "band_b"], "left")
    before, after = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    close = F.abs(F.col("m2") - F.col("typical")) / F.col("typical") < 0.15
    moved = j.agg(F.count_if(before & ~after).alias("units_lost"), F.count_if(after & ~before).alias("units_gained"),
                  F.count_if(before & after & F.coalesce(close, F.lit(False))).alias("units_well_matched"))
    return moved.crossJoin(a.agg(F.count("*").alias("cells_now"))).crossJoin(b.agg(F.count("*").alias("cells_proposed")))
