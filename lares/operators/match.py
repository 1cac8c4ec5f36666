"""Matching of units for sale to rent comparables by guarded size windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.functions.exprs import freshness_reason, implausible_reason, size_band
from lares.operators.asof import with_rate
from lares.operators.quantiles import grouped_quantiles
from lares.operators.ranges import joined_on, middle, positions_at, range_quantiles, running_sums
from lares.params import DEFAULT, Params
from lares.session import cut

_TOL = 1e-9  # window edges are decimal values; binary products may miss them by an ulp


def scope_reason(district: Column, in_scope: Column, why_excluded: Column) -> Column:
    """NULL = in scope. Districts outside every list are out, with their own reason."""
    return (
        F.when(in_scope, F.lit(None).cast("string"))
        .when(why_excluded.isNotNull(), F.concat(F.lit("excluded: "), why_excluded))
        .otherwise(F.concat(F.lit("not declared: "), F.coalesce(district, F.lit("?"))))
    )


def with_scope(df: DataFrame, scope: DataFrame, excluded: DataFrame, saturated: DataFrame) -> DataFrame:
    """Adds ``scope_reason`` and ``is_saturated``. An exclusion beats a phase listing.

    The lists are configuration (districts of a country); they are joined as plain tables
    and the optimizer broadcasts them while they are under its size threshold.
    """
    listed = scope.join(excluded, "district", "left_anti").select("district", F.lit(True).alias("_in"))
    return (
        df.join(listed, "district", "left")
        .join(excluded.select("district", F.col("why").alias("_why")), "district", "left")
        .join(saturated.select("zone", F.lit(True).alias("_sat")).distinct(), "zone", "left")
        .withColumn("scope_reason", scope_reason(F.col("district"), F.coalesce(F.col("_in"), F.lit(False)), F.col("_why")))
        .withColumn("is_saturated", F.coalesce(F.col("_sat"), F.lit(False)))
        .drop("_in", "_why", "_sat")
    )


def unit_reasons(units: DataFrame, rates: DataFrame, now=None, scope: tuple | None = None, p: Params = DEFAULT) -> DataFrame:
    """Rankable units with ``price`` in UF and the first row-level discard reason.

    ``scope`` is (scope, excluded, saturated); without it nothing is dropped for scope.
    """
    priced = units.where(
        (F.col("evidence") == "V") & ~F.coalesce(F.col("from_price"), F.lit(False))
        & (F.col("price_uf").isNotNull() | F.col("price_clp").isNotNull()))
    base = with_rate(priced, rates, "seen", p)
    if scope is not None:
        base = with_scope(base, *scope)
    else:
        base = base.withColumn("scope_reason", F.lit(None).cast("string")).withColumn("is_saturated", F.lit(False))
    price = F.coalesce(F.col("price_uf"), F.col("price_clp") / F.col("rate"))
    reason = F.when(implausible_reason(price, F.col("m2"), p).isNotNull(), "implausible")
    reason = F.when(F.coalesce(F.col("m2"), F.lit(0.0)) == 0, "no_m2").otherwise(reason)
    reason = F.when(F.coalesce(F.col("typ"), F.lit("")) == "", "no_typ").otherwise(reason)
    reason = F.when(F.col("scope_reason").isNotNull(), "out_of_scope").otherwise(reason)
    reason = F.when(F.col("is_saturated"), "saturated").otherwise(reason)
    reason = F.when(F.coalesce(F.col("zone"), F.lit("")) == "", "no_zone").otherwise(reason)
    reason = F.when(price.isNull(), "no_uf_rate").otherwise(reason)
    if now is not None:
        stale = freshness_reason(F.col("seen"), now, p.fresh_days)
        reason = F.when(stale.isNotNull(), stale).otherwise(reason)
    return base.withColumn("price", price).withColumn("row_reason", reason)


def zone_medians(candidates: DataFrame) -> DataFrame:
    """Median price per m2 of each zone's candidates, suspicious ones left out."""
    ok = candidates.where(~F.coalesce(F.col("suspicious"), F.lit(False)))
    return grouped_quantiles(ok, ["zone"], F.col("price") / F.col("m2"), {"zone_median": 0.5}).drop("n_values")


# ----------------------------------------------------------------- size lattice


def window_edges(factor: float, p: Params = DEFAULT) -> tuple[tuple, tuple]:
    """Lower and upper edge of the sizes at most max(floor, factor * m2u) from ``m2u``."""
    width = F.greatest(F.lit(p.window_floor_m2), F.col("m2u") * factor) + _TOL
    return (F.col("m2u") - width, False), (F.col("m2u") + width, True)


def window_counts(sizes: DataFrame, cells: DataFrame, factors: dict[str, float], sums: list[str], p: Params = DEFAULT, more: dict | None = None, group=("zone", "typ")) -> tuple[DataFrame, DataFrame]:
    """Running sums of ``cells`` at the edges lo_<name>, hi_<name> of every size's windows (and at the edges ``more``), and the cells in order."""
    edges = {}
    for name, f in factors.items():
        edges[f"lo_{name}"], edges[f"hi_{name}"] = window_edges(f, p)
    return running_sums(cells, sizes, list(group), ["m2u"], "m2", sums, edges | (more or {}))


def _inside(name: str, what: str) -> Column:
    return F.col(f"hi_{name}.{what}") - F.col(f"lo_{name}.{what}")


def _counted(comps: DataFrame, value: Column) -> DataFrame:
    return comps.groupBy("zone", "typ", "m2", value.cast("double").alias("_v")).agg(F.count("*").alias("_n"))


def window_stats(sizes: DataFrame, comps: DataFrame, furnished: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per distinct (zone, typ, m2u): counts, median size and median rent in each window.

    Columns n_0..n_2, m2_0..m2_2, rent_0..rent_2, furn_0..furn_2, smaller_n, smaller_m2.
    Everything a unit needs depends only on its zone, type and size, so the work is done once
    per distinct size, and no size meets the sizes of its window: counts are differences of
    running sums, median sizes are looked up by rank, and rents are read from at most
    ``2 log2`` aligned runs of sizes per window.
    """
    key, k = ["zone", "typ", "m2u"], len(p.window_factors)
    freq, sizes = cut(_counted(comps, F.col("rent"))), cut(sizes)
    cells = freq.groupBy("zone", "typ", "m2").agg(F.sum("_n").alias("n")).join(furnished.select("zone", "typ", "m2", F.col("n").alias("nf")), ["zone", "typ", "m2"], "full")
    names = {str(i): f for i, f in enumerate(p.window_factors)}
    at, ordered = window_counts(sizes, cells, names, ["n", "nf"], p, {"small": (F.col("m2u") * p.smaller_factor + _TOL, True)})
    at = cut(at)
    counts = at.select(*key, *[_inside(i, "n").alias(f"n_{i}") for i in names], *[_inside(i, "nf").alias(f"furn_{i}") for i in names], F.col("small.n").alias("smaller_n"))
    ranks = {}
    for i in names:
        for end, r in zip("ab", middle(_inside(i, "n")), strict=True):
            ranks[f"{end}_{i}"] = F.when(_inside(i, "n") > 0, F.col(f"lo_{i}.n") + r).otherwise(-1)
    size = positions_at(ordered, at, ["zone", "typ"], ["m2u"], "m2", ranks)
    size = size.select(*key, *[((F.col(f"a_{i}") + F.col(f"b_{i}")) / 2).alias(f"m2_{i}") for i in names])

    # w 0 to k-1: rents in the windows; w = k: rents per m2 of the smaller ones
    asked = [F.struct(F.lit(i).alias("w"), F.lit(0).alias("kind"), F.col(f"lo_{i}.rank").alias("low"), F.col(f"hi_{i}.rank").alias("high")) for i in range(k)]
    asked.append(F.struct(F.lit(k).alias("w"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("low"), F.col("small.rank").alias("high")))
    ranges = at.select(*key, F.explode(F.array(*asked)).alias("_q")).select(*key, "_q.*")
    ranked = freq.join(ordered.select("zone", "typ", "m2", "rank"), ["zone", "typ", "m2"])
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("_v")), F.struct(F.lit(1).alias("kind"), (F.col("_v") / F.col("m2")).alias("_v"))))
    values = cut(ranked.select("zone", "typ", "rank", "_n", kinds.alias("_k")).select("zone", "typ", "rank", "_k.kind", "_k._v", "_n"))
    med = range_quantiles(ranges, values, ["zone", "typ", "kind"], ["m2u", "w"], {"med": 0.5})
    rents = med.groupBy(*key).agg(*[F.max(F.when(F.col("w") == i, F.col("med"))).alias(name) for i, name in enumerate([*[f"rent_{i}" for i in names], "smaller_m2"])])
    zero = [*[f"n_{i}" for i in names], *[f"furn_{i}" for i in names], "smaller_n"]
    return joined_on([sizes, counts, size, rents], key).fillna(dict.fromkeys(zero, 0))


def decide(stats: DataFrame, p: Params = DEFAULT, seasonal_max=None, shift_max=None, elasticity=None) -> DataFrame:
    """The guarded cascade over window widths as one CASE.

    Adds ``match`` (accepted width index or NULL), ``match_reason``, ``rent``, ``n_comps``,
    ``typical_m2`` and the two provenance marks.
    """
    seasonal_max = F.lit(p.seasonal_max) if seasonal_max is None else seasonal_max
    shift_max = F.lit(p.wide_shift_max) if shift_max is None else shift_max
    beta = F.lit(p.yardstick_elasticity) if elasticity is None else elasticity
    c, m2u = F.col, F.col("m2u")
    k = len(p.window_factors)
    adjust = F.least(F.lit(1.0), F.pow(m2u / c("m2_0"), beta))
    yard = F.when((c("rent_0") != 0) & (c("m2_0") != 0), c("rent_0") * adjust).otherwise(c("rent_0"))
    seasonal, off, shifted, accept = [], [], [], []
    for i in range(k):
        s = (c(f"furn_{i}") >= p.seasonal_min_count) & (
            c(f"furn_{i}") / (c(f"furn_{i}") + c(f"n_{i}")) >= seasonal_max)
        enough = c(f"n_{i}") >= p.min_comparables
        o = enough & (F.abs(c(f"m2_{i}") - m2u) > m2u * p.off_centre_max + _TOL)
        if i == 0:
            d = F.lit(False)
        else:
            d = enough & ~o & (c("n_0") >= p.core_min) & (yard != 0) & ((c(f"rent_{i}") - yard) / yard > shift_max)
        no = F.lit(False)
        s, o, d = (F.coalesce(x, no) for x in (s, o, d))
        seasonal.append(s)
        off.append(o)
        shifted.append(d)
        accept.append(enough & ~s & ~o & ~d)
    state = F.lit("no_comparables")
    state = F.when(off[0] | off[1] | off[2], "off_centre").otherwise(state)
    state = F.when(shifted[1] | shifted[2], "wide_shifted").otherwise(state)
    for i in reversed(range(k)):
        state = F.when(seasonal[i], "seasonal").when(accept[i], f"w{i}").otherwise(state)
    out = stats.withColumn("_state", state)
    width = F.when(c("_state").startswith("w") & (F.length("_state") == 2), F.substring("_state", 2, 1).cast("int"))
    out = out.withColumn("match", width).withColumn("match_reason", F.when(c("match").isNull(), c("_state"))).drop("_state")
    at = lambda name: F.coalesce(*[F.when(c("match") == i, c(f"{name}_{i}")) for i in range(k)])
    out = (
        out.withColumn("rent", at("rent")).withColumn("n_comps", at("n")).withColumn("typical_m2", at("m2")))
    size_factor = F.when(c("typical_m2") != 0, F.pow(m2u / c("typical_m2"), beta)).otherwise(1.0)
    return (
        out.withColumn("mark_above_smaller",
                       F.coalesce((c("smaller_n") >= p.smaller_min) & (c("rent") / m2u > c("smaller_m2")), F.lit(False)))
        .withColumn("mark_size_shift", F.coalesce(size_factor < 1 - p.size_shift_mark, F.lit(False)))
    )


def candidates_of(units: DataFrame, rates: DataFrame, now=None, scope=None, p: Params = DEFAULT) -> DataFrame:
    return unit_reasons(units, rates, now, scope, p).where(F.col("row_reason").isNull())


def sizes_of(candidates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    banded = candidates.where(size_band(F.col("m2"), p.bands).isNotNull())
    return banded.select("zone", "typ", F.col("m2").alias("m2u")).distinct()


def decisions(candidates: DataFrame, comps: DataFrame, furnished: DataFrame, p: Params = DEFAULT) -> DataFrame:
    inside = comps.where(size_band(F.col("m2"), p.bands).isNotNull())
    return decide(window_stats(sizes_of(candidates, p), inside, furnished, p), p)


def match_units(candidates: DataFrame, decided: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Candidates with their match decision; ``match_reason`` also covers out-of-band sizes."""
    j = candidates.join(
        decided.withColumnRenamed("m2u", "m2"), ["zone", "typ", "m2"], "left")
    return j.withColumn("match_reason", F.when(size_band(F.col("m2"), p.bands).isNull(), "out_of_band").otherwise(F.col("match_reason")))


UNIT_COLUMNS = ["district", "is_new", "age_years", "tax_regime", "price_clp", "suspicious"]


def collapse_duplicates(matched: DataFrame) -> DataFrame:
    """One accepted unit per (zone, type, size, price): the smallest key, with its copies counted.

    An aggregation with map-side combine, so a unit advertised a billion times costs no more
    than its partial results.
    """
    ok = matched.where(F.col("match").isNotNull())
    keep = ["unit_key", "rent", "n_comps", "match", "typical_m2", "mark_above_smaller", "mark_size_shift"] + UNIT_COLUMNS
    return (
        ok.groupBy("zone", "typ", "m2", "price")
        .agg(F.min_by(F.struct(*keep), "unit_key").alias("u"), F.count("*").alias("copies"))
        .select("zone", "typ", "m2", "price", "u.*", "copies")
    )


def rankable(units, rates, comps, furnished, now=None, scope=None, risk: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """Units ready for evaluation: matched rent, zone discount, zone risk and catalyst."""
    cand = cut(candidates_of(units, rates, now, scope, p))
    return rankable_from(cand, match_units(cand, decisions(cand, comps, furnished, p), p), risk)


def rankable_from(candidates: DataFrame, matched: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """Zones without a measured risk or catalyst take the defaults 0.5 and 0; two flags say which."""
    out = collapse_duplicates(matched).join(zone_medians(candidates), "zone", "left").withColumn(
        "zone_discount",
        F.when(F.coalesce(F.col("zone_median"), F.lit(0.0)) != 0,
               (F.col("zone_median") - F.col("price") / F.col("m2")) / F.col("zone_median")).otherwise(0.0))
    if risk is None:
        out = out.withColumn("risk", F.lit(None).cast("double")).withColumn("catalyst", F.lit(None).cast("double"))
    else:
        out = out.join(risk.select("zone", "risk", "catalyst"), "zone", "left")
    return (
        out.withColumn("risk_measured", F.col("risk").isNotNull())
        .withColumn("catalyst_measured", F.col("catalyst").isNotNull())
        .withColumn("risk", F.coalesce("risk", F.lit(0.5)))
        .withColumn("catalyst", F.coalesce("catalyst", F.lit(0.0)))
        .withColumn("price_evidence", F.when(F.col("price_clp").isNotNull(), "D").otherwise("V"))
    )


def discard_counts(units, rates, comps, furnished, now=None, scope=None, p: Params = DEFAULT) -> DataFrame:
    """district, reason, n for every rankable-by-price unit, ``ranks`` for the kept ones."""
    rows = unit_reasons(units, rates, now, scope, p)
    none = F.lit("(no zone)")
    first = rows.where(F.col("row_reason").isNotNull()).groupBy(
        F.coalesce("district", none).alias("district"), F.col("row_reason").alias("reason")).agg(F.count("*").alias("n"))
    cand = rows.where(F.col("row_reason").isNull())
    matched = match_units(cand, decisions(cand, comps, furnished, p), p)
    second = matched.where(F.col("match").isNull()).groupBy(
        F.coalesce("district", none).alias("district"), F.col("match_reason").alias("reason")).agg(F.count("*").alias("n"))
    kept = (
        matched.where(F.col("match").isNotNull()).groupBy("district", "zone", "typ", "m2", "price").agg(F.count("*").alias("k"))
        .select("district", F.explode(F.array(
            F.struct(F.lit("ranks").alias("reason"), F.lit(1).cast("bigint").alias("n")),
            F.struct(F.lit("duplicate").alias("reason"), (F.col("k") - 1).alias("n")))).alias("x"))
        .groupBy("district", "x.reason").agg(F.sum("x.n").alias("n")).where("n > 0"))
    return first.unionByName(second).unionByName(kept)


def funnel(counts: DataFrame, reasons: list[str], districts: DataFrame) -> DataFrame:
    """One row per district, one column per reason; districts without any unit show zeros."""
    wide = counts.groupBy("district").pivot("reason", reasons).agg(F.sum("n"))
    return districts.select("district").join(wide, "district", "full").fillna(0)


def gaps(units, rents_cells: DataFrame, rates, now=None, scope=None, p: Params = DEFAULT) -> DataFrame:
    """Cells that block units: blocked units, comparables at hand, missing, leverage."""
    rows = unit_reasons(units, rates, now, scope, p).where(
        F.col("row_reason").isNull() | (F.col("row_reason") == "implausible"))
    banded = rows.withColumn("band", size_band(F.col("m2"), p.bands)).where(F.col("band").isNotNull())
    need = banded.groupBy("district", "zone", "typ", "band").agg(F.count("*").alias("units"))
    j = need.join(rents_cells.select("zone", "typ", "band", F.col("n").alias("have")), ["zone", "typ", "band"], "left").fillna({"have": 0})
    return (
        j.where(F.col("have") < p.min_comparables)
        .withColumn("missing", p.min_comparables - F.col("have"))
        .withColumn("leverage", F.col("units") / F.col("missing"))
    )


def knn_rent(sizes: DataFrame, comps: DataFrame, k: int = 8) -> DataFrame:
    """Median rent of the k comparables nearest in size, per distinct (zone, typ, m2u).

    Ties in distance are taken by lower rent. Every size that occurs holds a listing, so the k
    nearest are within the k sizes on either side, which are met by their rank. Sizes nearer than
    the deciding distance hold fewer than k listings in total, and the deciding distance
    contributes at most k, so keeping the k cheapest of each size loses nothing.
    """
    from pyspark.sql import Window
    comps = cut(comps.select("zone", "typ", "m2", "rent"))
    per_size = Window.partitionBy("zone", "typ", "m2").orderBy("rent")
    head = comps.withColumn("_r", F.row_number().over(per_size)).where(F.col("_r") <= k).select("zone", "typ", "m2", "rent")
    counts = comps.groupBy("zone", "typ", "m2").agg(F.count("*").alias("n"))
    key = ["zone", "typ", "m2u"]
    at, ordered = running_sums(counts, sizes, ["zone", "typ"], ["m2u"], "m2", ["n"], {"here": (F.col("m2u"), True)})
    beside = at.select(*key, F.explode(F.sequence(F.col("here.rank") - k, F.col("here.rank") + k - 1)).alias("rank"))
    pairs = cut(beside.join(ordered.select("zone", "typ", "rank", "m2", "n"), ["zone", "typ", "rank"]).drop("rank").withColumn("d", F.abs(F.col("m2") - F.col("m2u"))))
    rings = pairs.groupBy(*key, "d").agg(F.sum("n").alias("n"))
    cum = rings.withColumn("_before", F.sum("n").over(
        Window.partitionBy(*key).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    limit = cum.where(F.col("_before") < k).groupBy(*key).agg(F.max("d").alias("reach"))
    near = pairs.join(limit, key).where("d <= reach").join(head, ["zone", "typ", "m2"])
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("d", "rent"))).where(F.col("_k") <= k)
    return ranked.groupBy(*key).agg(
        F.count("*").alias("k"), F.percentile("rent", F.lit(0.5)).alias("knn_rent"), F.max("d").alias("reach"),
    ).where(F.col("k") == k)


def seasonal_share(sizes: DataFrame, comps: DataFrame, furnished: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Furnished and clean counts in the narrow window of each distinct size."""
    cells = comps.groupBy("zone", "typ", "m2").agg(F.count("*").alias("n")).join(furnished.select("zone", "typ", "m2", F.col("n").alias("nf")), ["zone", "typ", "m2"], "full")
    at, _ = window_counts(sizes, cells, {"0": p.window_factors[0]}, ["n", "nf"], p)
    out = at.select("zone", "typ", "m2u", _inside("0", "n").alias("n_clean"), _inside("0", "nf").alias("n_furnished"))
    share = F.when(F.col("n_furnished") + F.col("n_clean") > 0,
                   F.col("n_furnished") / (F.col("n_furnished") + F.col("n_clean")))
    return out.withColumn("share", share).withColumn(
        "contaminated", F.coalesce((F.col("n_furnished") >= p.seasonal_min_count) & (share >= p.seasonal_max), F.lit(False)))
