"""Comparisons between two runs: rank shifts, top changes, relisting effect, threshold and weight sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lares.operators import invest as I
from lares.operators import match as M
from lares.operators.order import numbered
from lares.params import DEFAULT, Params
from lares.session import cut


def rank_shift(a: DataFrame, b: DataFrame, share: float = 0.10, top: int = 5) -> DataFrame:
    """One row: how the ranking ``b`` differs from ``a`` (both: unit_key, score).

    Positions come from score buckets, so no ranking is sorted in one task.
    """
    pa = cut(I.global_position(a.select("unit_key", "score")).select("unit_key", F.col("position").alias("pa")))
    pb = cut(I.global_position(b.select("unit_key", "score")).select("unit_key", F.col("position").alias("pb")))
    j = pa.join(pb, "unit_key", "full")
    both = F.col("pa").isNotNull() & F.col("pb").isNotNull()
    common = j.agg(F.count_if(both).alias("common"))
    # one-row table
    j = j.crossJoin(F.broadcast(common))
    moved = both & (F.abs(F.col("pa") - F.col("pb")) > F.col("common") * share)
    out = j.agg(
        F.count_if(F.col("pa").isNotNull()).alias("before"), F.count_if(F.col("pb").isNotNull()).alias("after"),
        F.count_if(F.col("pa").isNull()).alias("entered"), F.count_if(F.col("pb").isNull()).alias("left"),
        F.max("common").alias("common"), F.count_if(moved).alias("moved"),
        (F.count_if((F.col("pa") <= top) & ~F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))) > 0).alias("top_changed"))
    return out.withColumn("moved_share", F.when(F.col("common") > 0, F.col("moved") / F.col("common")).otherwise(0.0))


def top_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entered, left and price-cut rows between two top snapshots (unit_key, price)."""
    a, b = old.alias("a"), new.alias("b")
    state = (F.when(F.col("a.unit_key").isNull(), "entered").when(F.col("b.unit_key").isNull(), "left")
             .when(F.col("b.price") < F.col("a.price"), "price_cut").otherwise("same"))
    return a.join(b, F.col("a.unit_key") == F.col("b.unit_key"), "full").select(
        F.coalesce("a.unit_key", "b.unit_key").alias("unit_key"), F.col("a.price").alias("before"), F.col("b.price").alias("after"), state.alias("state"))


def collapse_effect(with_collapse: DataFrame, without: DataFrame, big: float = 0.10) -> DataFrame:
    """Effect of collapsing relistings on the assigned rents (both: unit_key, rent)."""
    a, b = without.alias("a"), with_collapse.alias("b")
    d = (F.col("b.rent") - F.col("a.rent")) / F.col("a.rent")
    both = F.col("a.rent").isNotNull() & F.col("b.rent").isNotNull()
    return a.join(b, F.col("a.unit_key") == F.col("b.unit_key"), "full").agg(
        F.count_if(both & (d > 1e-12)).alias("up"), F.count_if(both & (d < -1e-12)).alias("down"), F.count_if(both & (F.abs(d) <= 1e-12)).alias("equal"),
        F.count_if(F.col("b.rent").isNull()).alias("now_unassigned"), F.count_if(F.col("a.rent").isNull()).alias("only_collapsed"),
        F.count_if(both & (F.abs(d) > big)).alias("over_ten_percent"))


def guard_sweep(candidates: DataFrame, stats: DataFrame, thresholds: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Units per outcome for each shift threshold (``thresholds``: shift_max; a parameter grid).

    The window statistics are computed once; only the decision is repeated.
    """
    d = M.decide(stats.crossJoin(F.broadcast(thresholds)), p, shift_max=F.col("shift_max"))
    n = candidates.groupBy("zone", "typ", F.col("m2").alias("m2u")).agg(F.count("*").alias("units"))
    return d.join(n, ["zone", "typ", "m2u"]).groupBy("shift_max").agg(*[
        F.sum(F.when(c, F.col("units")).otherwise(0)).alias(name) for name, c in (
            ("ranks", F.col("match").isNotNull()), ("wide_shifted", F.col("match_reason") == "wide_shifted"),
            ("seasonal", F.col("match_reason") == "seasonal"), ("no_comparables", F.col("match_reason") == "no_comparables"))])


def core_shift(stats: DataFrame, decided: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Distinct sizes matched in a wide window whose narrow core sits more than 10 % off their size."""
    core = F.col("n_0").between(p.core_min, p.min_comparables - 1)
    off = (F.col("m2_0") - F.col("m2u")) / F.col("m2u")
    return decided.where(core & F.col("match").isNotNull()).agg(
        F.count("*").alias("measurable"), F.count_if(F.abs(off) > 0.10).alias("shifted"),
        F.count_if(off > 0.10).alias("larger_core"), F.count_if(off < -0.10).alias("smaller_core"))


def catalyst_sweep(live: DataFrame, catalysts: DataFrame, base_factor: float, share: float = 0.10, p: Params = DEFAULT) -> DataFrame:
    """Share of the ranking that moves for each factor (``catalysts``: factor, zone, catalyst)."""
    factors = catalysts.select("factor").distinct()
    live = cut(live.select("unit_key", "zone", *[x for x in I.SCORED_BY if x != "catalyst"]))  # evaluated once, not per factor
    u = live.crossJoin(F.broadcast(factors)).join(catalysts, ["factor", "zone"], "left").fillna({"catalyst": 0.0})
    s = I.score(u.drop("zone"), p, by=("factor",)).select("factor", "unit_key", "score", "catalyst")
    pos = cut(positions_by(s, "factor").select("factor", "unit_key", "position", "catalyst"))
    base = pos.where(F.col("factor") == base_factor).select("unit_key", F.col("position").alias("p0"))
    n = base.agg(F.count("*").alias("n"))
    j = pos.join(base, "unit_key").crossJoin(F.broadcast(n))
    limit = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return j.groupBy("factor").agg(F.count_if(F.abs(F.col("position") - F.col("p0")) > limit).alias("moved"), F.max("n").alias("n"),
                                   F.avg("catalyst").alias("mean_catalyst"))


def positions_by(scored: DataFrame, group: str) -> DataFrame:
    """Position by descending score inside each parameter set."""
    return numbered(scored, [F.round("score", 9).desc(), F.col("unit_key").asc()], [group])


def reconfirm_state(top: DataFrame, visited: DataFrame, today) -> DataFrame:
    """Was each top row seen again today? TRUE, FALSE, or NULL where its district was not visited."""
    v = visited.select("district", F.lit(True).alias("_v")).distinct()
    return top.join(v, "district", "left").withColumn("reconfirmed", F.when(F.col("_v"), F.coalesce(F.col("seen") == today, F.lit(False)))).drop("_v")


def groups_in_order(top: DataFrame, group: str, limit: int = 8) -> DataFrame:
    """Distinct groups of a top list in rank order."""
    return top.groupBy(group).agg(F.min("position").alias("first_position")).orderBy("first_position").limit(limit)


def cheapest_in_scope(units: DataFrame, scope: DataFrame, n: int = 12) -> DataFrame:
    """Cheapest open "from" prices in the districts in scope."""
    return units.where(F.col("from_price") & F.col("price_uf").isNotNull()).join(scope, "district", "left_semi").orderBy("price_uf", "unit_key").limit(n)


def dossiers(units: DataFrame, reasons: DataFrame, matched: DataFrame, positions: DataFrame) -> DataFrame:
    """Everything known about each unit: reason or match, peers by window width, position and score."""
    m = matched.select("unit_key", "match_reason", "match", "rent", "n_comps", "n_0", "n_1", "n_2")
    return (
        units.select("unit_key", "zone", "typ", "m2")
        .join(reasons.select("unit_key", "row_reason"), "unit_key", "left").join(m, "unit_key", "left")
        .join(positions.select("unit_key", "position", "score"), "unit_key", "left")
        .withColumn("state", F.coalesce("row_reason", "match_reason", F.when(F.col("position").isNotNull(), "ranked"), F.when(F.col("match").isNotNull(), "not_ranked"), F.lit("not_priced"))))


def price_history(versions: DataFrame, most: int = 12) -> DataFrame:
    """unit_key, n_versions, history: the latest ``most`` versions of each unit, newest first, as an array of intervals."""
    count = versions.groupBy("unit_key").agg(F.count("*").alias("n_versions"))
    newest = F.row_number().over(Window.partitionBy("unit_key").orderBy(F.desc("valid_from")))
    some = versions.withColumn("_r", newest).where(F.col("_r") <= most)
    line = F.transform(F.array_sort(F.collect_list(F.struct("_r", "valid_from", "valid_to", "price_uf", "price_clp"))), lambda x: x.dropFields("_r"))  # at most ``most``
    return count.join(some.groupBy("unit_key").agg(line.alias("history")), "unit_key")
