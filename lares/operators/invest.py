"""Mortgage cash-flow evaluation of units x scenarios, score and ranking.

Every figure is a column expression over the unit x scenario rows; parameters are literals.
Rows are independent until the score, which needs only the minimum and maximum of six
components per scenario.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lares.functions import finance as fin
from lares.operators.order import numbered
from lares.params import DEFAULT, Params
from lares.session import cut, settle

SCENARIO_SCHEMA = (
    "scenario_id string, with_subsidy boolean, down double, regime boolean, vacancy double, "
    "rate double, rate_plain double, guarantee boolean")
COMPONENTS = ("holding_cost", "breakeven_down", "irr_10y", "zone_risk", "catalyst", "zone_discount")
HIGHER_IS_BETTER = {"holding_cost": True, "breakeven_down": False, "irr_10y": True, "zone_risk": False,
                    "catalyst": True, "zone_discount": True}


def base_scenario(spark: SparkSession, p: Params = DEFAULT) -> DataFrame:
    row = ("base", p.qualifies_subsidy, p.down_base, p.require_tax_regime, p.vacancy_individual,
           p.rate_subsidised, p.rate_best_plain, True)
    return spark.createDataFrame([row], SCENARIO_SCHEMA)


def scenario_grid(spark: SparkSession, p: Params = DEFAULT) -> DataFrame:
    """Subsidy x down payment x tax regime x vacancy; best case pairs with best case."""
    regimes = [True] if p.require_tax_regime else [True, False]
    rows = []
    for sub, down, regime, vac in product([True, False], p.down_options, regimes, [p.vacancy_individual, p.vacancy_professional]):
        rate = p.rate_subsidised if sub else p.rate_plain_average
        sid = (f"{'sub' if sub else 'nosub'}_pie{round(down * 100)}_{'dfl2' if regime else 'nodfl2'}_"
               f"{'prof' if vac == p.vacancy_professional else 'indiv'}")
        rows.append((sid, sub, down, regime, vac, rate, p.rate_best_plain if sub else rate, True))
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def cross_scenarios(units: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every unit under every scenario; the scenario table is a parameter grid of a dozen rows."""
    return units.crossJoin(F.broadcast(scenarios))


# ----------------------------------------------------------------- rules


def with_benefits(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rate subsidy, guarantee and tax regime as value + reason, decided by the property."""
    c = F.col
    used = ~c("is_new")
    over = c("price") > p.subsidy_price_cap
    sub = c("with_subsidy") & ~used & ~over
    no_sub = F.when(~c("with_subsidy"), F.lit(None).cast("string")).when(used, "used_home").when(over, "over_price_cap")
    guar = c("guarantee") & (c("is_new") | F.lit(p.guarantee_covers_used))
    no_guar = F.when(c("guarantee") & ~guar, "used_home")
    probable = F.lit(p.regime_probable) & (c("m2") <= p.regime_max_m2)
    regime = c("regime") & F.when(c("tax_regime").isNull(), probable).otherwise(c("tax_regime"))
    assumed = c("regime") & c("tax_regime").isNull() & probable
    no_regime = F.when(~c("regime"), F.lit(None).cast("string")).when(
        c("tax_regime").isNull() & ~probable, "unconfirmed").when(~F.coalesce(c("tax_regime"), F.lit(True)), "not_covered")
    years = F.lit(p.regime_window_years[-1][1])
    for m2, y in reversed(p.regime_window_years[:-1]):
        years = F.when(c("m2") <= m2, F.lit(y)).otherwise(years)
    window = F.when(c("age_years").isNull(), F.when(c("regime_assumed"), c("is_new")).otherwise(True)).otherwise(c("age_years") < years)
    return (
        df.withColumns({
            "subsidy_applied": sub, "no_subsidy_reason": no_sub,
            "rate_applied": F.when(c("with_subsidy") & ~sub, F.coalesce("rate_plain", "rate")).otherwise(c("rate")),
            "guarantee_applied": guar, "no_guarantee_reason": no_guar,
            "regime_applied": regime, "regime_assumed": assumed, "no_regime_reason": no_regime,
            "down_required": F.when(guar, 1.0 - p.ltv_guaranteed).otherwise(1.0 - p.ltv_plain)})
        .withColumns({"tax_window_open": window, "down_effective": F.greatest("down", "down_required")})
    )


def exclusion_reason(p: Params = DEFAULT) -> Column:
    """First hard exclusion of a unit, NULL when none applies."""
    c = F.col
    r = F.when(F.lit(p.require_tax_regime) & (F.coalesce(c("tax_regime"), F.lit(True)) == F.lit(False)), "no_tax_regime")
    r = F.when(F.lit(p.exclude_estimated) & ~c("price_evidence").isin("V", "D"), "estimated_price").otherwise(r)
    r = F.when(F.lit(p.exclude_saturated) & c("is_saturated"), "saturated").otherwise(r)
    r = F.when(c("n_comps") < p.min_comparables, "few_comparables").otherwise(r)
    r = F.when(c("m2") > p.m2_max, "size_over_cap").otherwise(r)
    r = F.when(F.lit(p.only_new) & ~c("is_new"), "used_home").otherwise(r)
    return F.when(c("price") > p.price_max_uf, "price_over_cap").otherwise(r)


def property_tax(price: Column, rebate: Column, p: Params = DEFAULT) -> Column:
    assessed = price * p.uf_clp * p.assessed_ratio
    cut = p.property_tax_cut_clp
    low = F.greatest(F.lit(0.0), assessed - p.property_tax_exempt_clp) * p.property_tax_low
    high = (cut - min(cut, p.property_tax_exempt_clp)) * p.property_tax_low + (assessed - cut) * p.property_tax_high
    clp = F.when(assessed <= cut, low).otherwise(high)
    return clp * F.when(rebate, 1.0 - p.regime_tax_rebate).otherwise(1.0) / p.uf_clp


def fees_per_m2(district: Column, p: Params = DEFAULT) -> Column:
    pairs = [F.lit(x) for kv in p.fees_by_municipality.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[district], F.lit(p.fees_default))


# ----------------------------------------------------------------- evaluation


def with_income(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Gross and effective income, running costs and net operating income."""
    c = F.col
    egi = fin.effective_income(c("rent"), c("vacancy"), p.bad_debt, p.erosion)
    df = df.withColumns({
        "pgi": c("rent") * 12.0, "egi": egi,
        "property_tax": property_tax(c("price"), c("regime_applied") & c("tax_window_open"), p),
        "fees_vacant": fees_per_m2(c("district"), p) * c("m2") * 12.0 * c("vacancy") / p.uf_clp})
    income_tax = F.when(c("regime_applied"), 0.0).otherwise(
        F.greatest(F.lit(0.0), c("egi") - c("property_tax")) * p.income_tax_marginal)
    df = df.withColumn("income_tax", income_tax)
    opex = (c("property_tax") + c("fees_vacant") + c("egi") * p.management_pct
            + c("rent") * p.letting_fee_months / p.tenant_years + c("pgi") * p.upkeep_pct + c("income_tax"))
    return df.withColumn("opex", opex).withColumn("noi", c("egi") - c("opex"))


def with_metrics(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Loan, cash flow and ratio metrics (everything but the time-value figures)."""
    c = F.col
    df = df.withColumn("credit", c("price") * (1.0 - c("down_effective")))
    df = df.withColumn("instalment", fin.instalment(c("credit"), c("rate_applied"), p.loan_years))
    df = df.withColumns({
        "instalment_total": c("instalment") + c("credit") * p.life_insurance_monthly + c("price") * p.fire_insurance_monthly,
        "closing_costs": c("credit") * p.stamp_tax + (p.closing_fixed_uf + p.closing_fixed_clp / p.uf_clp),
        "principal_monthly": fin.principal_paid(c("credit"), c("rate_applied"), p.loan_years, 0, 12) / 12.0})
    df = df.withColumns({
        "debt_service": c("instalment_total") * 12.0,
        "cash_flow": c("noi") / 12.0 - c("instalment_total"),
        "capital": c("price") * c("down_effective") + c("closing_costs") + p.fitting_out_uf})
    simple_rent = fin.breakeven_rent_simple(c("debt_service"), c("opex"), c("vacancy"), p.bad_debt, p.erosion)
    return df.withColumns({
        "gross_yield": c("pgi") / c("price"),
        "cap_rate": c("noi") / (c("price") + c("closing_costs")),
        "grm": c("price") / c("pgi"),
        "dscr": c("noi") / c("debt_service"),
        "holding_cost": c("cash_flow") + c("principal_monthly"),
        "savings_share": F.when(c("cash_flow") < 0, F.least(F.lit(1.0), c("principal_monthly") / -c("cash_flow"))).otherwise(0.0),
        "cash_on_cash": c("cash_flow") * 12.0 / c("capital"),
        "breakeven_rent_simple": simple_rent,
        "breakeven_down_simple": fin.breakeven_down_simple(c("pgi") / c("price"), c("rate_applied"), p.loan_years, c("opex") / c("pgi")),
        "breakeven_occupancy": (c("opex") + c("debt_service")) / c("pgi")})


def _exit_value(n: int, p: Params) -> Column:
    """Extra flow of the sale year: price net of fees, loan balance and gains tax."""
    c = F.col
    sale = c("price") * (1.0 + p.appreciation) ** n
    gain = F.greatest(F.lit(0.0), sale - c("price") - p.gain_exempt_uf)
    fee = p.sale_fee_pct * (1.0 + p.vat)
    return sale * (1.0 - fee) - fin.balance(c("credit"), c("rate_applied"), p.loan_years, n * 12) - gain * p.gain_tax


def with_returns(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """irr_<n> per horizon (NULL = not defined), npv_10, and which horizons are not defined."""
    c = F.col
    yearly = c("cash_flow_year")
    df = settle(df.withColumns({f"exit_{n}": _exit_value(n, p) for n in p.irr_horizons}).withColumn("cash_flow_year", c("cash_flow") * 12.0))
    df = df.select("*", fin.irr_levels(c("capital"), yearly, {n: c(f"exit_{n}") for n in p.irr_horizons}, p.irr_bounds).alias("_irr"))
    df = df.select("*", "_irr.*").drop("_irr")
    missing = F.concat_ws(",", *[F.when(c(f"irr_{n}").isNull(), F.lit(str(n))) for n in p.irr_horizons])
    return df.withColumn("npv_10", fin.npv_level(c("capital"), yearly, c("exit_10"), 10, F.lit(p.discount_rate))).withColumn(
        "irr_missing", F.when(missing != "", missing))


def breakeven_down(p: Params = DEFAULT) -> Column:
    """Down payment at which the full model's cash flow reaches zero, on the search grid.

    The flow is flat below the bank's minimum and linear above it, so the root is explicit;
    the published value is the upper end of the bisection cell that holds it. NULL = never.
    """
    c = F.col
    per_credit = fin.instalment(F.lit(1.0), c("rate_applied"), p.loan_years) + p.life_insurance_monthly
    affordable = (c("noi") / 12.0 - c("price") * p.fire_insurance_monthly) / per_credit
    root = 1.0 - affordable / c("price")
    top = p.down_search_max
    halvings = math.ceil(math.log2(top / p.down_search_tol))
    return (
        F.when(F.greatest(F.lit(top), c("down_required")) < root, F.lit(None).cast("double"))
        .when(c("down_required") >= root, 0.0)
        .otherwise(fin.grid_up(root, F.lit(0.0), F.lit(top), F.lit(halvings)))
    )


def breakeven_rent(p: Params = DEFAULT) -> Column:
    """Monthly rent at which the full model's cash flow reaches zero at the scenario's down payment.

    Piecewise linear with one kink (income tax starts once income exceeds the property tax).
    """
    c = F.col
    k = 12.0 * (1.0 - c("vacancy")) * (1.0 - p.bad_debt) * p.erosion
    fixed = c("property_tax") + c("fees_vacant") + c("debt_service")
    slope = k * (1.0 - p.management_pct) - p.letting_fee_months / p.tenant_years - 12.0 * p.upkeep_pct
    tax = F.when(c("regime_applied"), 0.0).otherwise(p.income_tax_marginal)
    plain = fixed / slope
    taxed = (fixed - tax * c("property_tax")) / (slope - tax * k)
    root = F.when((tax == 0) | (k * plain <= c("property_tax")), plain).otherwise(taxed)
    lo = p.rent_search_tol
    hi = F.greatest(c("rent"), F.lit(1.0)) * p.rent_search_factor
    width = hi - lo
    halvings = F.ceil(F.log2(width / p.rent_search_tol))
    return F.when(root > hi, F.lit(None).cast("double")).when(root <= lo, 0.0).otherwise(fin.grid_up(root, F.lit(lo), width, halvings))


def evaluate(units: DataFrame, scenarios: DataFrame, p: Params = DEFAULT, returns: bool = True) -> DataFrame:
    """Full evaluation with exclusion reasons; excluded rows keep all their figures."""
    df = with_metrics(with_income(with_benefits(cross_scenarios(units, scenarios), p), p), p)
    df = df.withColumn("breakeven_down", breakeven_down(p))
    hard = exclusion_reason(p)
    late = []
    if p.deficit_max_uf is not None:
        late.append(F.when(-F.col("cash_flow") > p.deficit_max_uf, "cash_deficit"))
    if returns:
        df = settle(with_returns(df, p))
        late.append(F.when(F.col("irr_10").isNull(), "irr_undefined"))
    after = F.concat_ws(" · ", *late) if late else F.lit("")
    reason = F.coalesce(hard, F.when(after != "", after))
    df = df.withColumn("exclusion", reason)
    return settle(df) if returns else df


def _components() -> dict[str, Column]:
    c = F.col
    down = F.coalesce(c("breakeven_down"), F.when(c("cash_flow") < 0, 1.0).otherwise(c("breakeven_down_simple")))
    return {"holding_cost": c("holding_cost"), "breakeven_down": down, "irr_10y": c("irr_10"), "zone_risk": c("risk"),
            "catalyst": c("catalyst"), "zone_discount": c("zone_discount")}


#: Columns of an evaluated unit that its score depends on.
SCORED_BY = ("holding_cost", "breakeven_down", "cash_flow", "breakeven_down_simple", "irr_10", "risk", "catalyst", "zone_discount")


def ranges(live: DataFrame, by=("scenario_id",)) -> DataFrame:
    comps = _components()
    return live.groupBy(*by).agg(
        F.count("*").alias("n_live"), *[F.min(e).alias(f"lo_{k}") for k, e in comps.items()],
        *[F.max(e).alias(f"hi_{k}") for k, e in comps.items()])


def inert_components(live: DataFrame, p: Params = DEFAULT, by=("scenario_id",)) -> DataFrame:
    """Per scenario: components that do not vary, and the weight they leave to the others."""
    r = ranges(live, by)
    flags = [F.when((F.col("n_live") > 1) & (F.col(f"lo_{k}") == F.col(f"hi_{k}")), F.lit(k)) for k in sorted(COMPONENTS)]
    weight = sum([F.when((F.col("n_live") > 1) & (F.col(f"lo_{k}") == F.col(f"hi_{k}")), F.lit(p.score_weights[k])).otherwise(0.0)
                  for k in COMPONENTS], F.lit(0.0))
    return r.select(*by, F.array_join(F.array_compact(F.array(*flags)), ",").alias("inert"), weight.alias("inert_weight"))


def score(live: DataFrame, p: Params = DEFAULT, by=("scenario_id",)) -> DataFrame:
    """0-100 score: min-max per scenario, constant components dropped, weights redistributed.

    The ranges table has one row per scenario (a parameter grid), hence the broadcast.
    """
    live = cut(live)  # read twice: once for the ranges, once for the rows
    r = F.broadcast(ranges(live, by))
    j = live.join(r, list(by))
    comps = _components()
    active = {k: ~((F.col("n_live") > 1) & (F.col(f"lo_{k}") == F.col(f"hi_{k}"))) for k in COMPONENTS}
    total = sum([F.when(active[k], F.lit(p.score_weights[k])).otherwise(0.0) for k in COMPONENTS], F.lit(0.0))
    parts = {}
    for k in COMPONENTS:
        lo, hi = F.col(f"lo_{k}"), F.col(f"hi_{k}")
        raw = (comps[k] - lo) / (hi - lo) if HIGHER_IS_BETTER[k] else (hi - comps[k]) / (hi - lo)
        norm = F.when(lo == hi, 0.5).otherwise(raw)
        parts[f"part_{k}"] = F.when(active[k] & (total > 0), norm * p.score_weights[k] / total * 100.0)
    j = j.withColumns(parts)
    s = sum([F.coalesce(F.col(f"part_{k}"), F.lit(0.0)) for k in COMPONENTS], F.lit(0.0))
    drop = [f"{x}_{k}" for k in COMPONENTS for x in ("lo", "hi")] + ["n_live"]
    return j.withColumn("score", s).drop(*drop)


def live_of(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col("exclusion").isNull())


def top_n(scored: DataFrame, n: int, by: str = "score") -> DataFrame:
    """The n best rows with their position; only n rows per task reach the final ordering."""
    key = F.round(by, 9).desc()
    best = scored.orderBy(key, "unit_key").limit(n)
    return best.withColumn("position", F.row_number().over(Window.orderBy(key, "unit_key")))


def global_position(scored: DataFrame, by: str = "score") -> DataFrame:
    """Position of every row by descending score, ties by key."""
    return numbered(scored, [F.round(by, 9).desc(), F.col("unit_key").asc()])


def score_drivers(scored: DataFrame, k: int = 2) -> DataFrame:
    """Per unit the k components that stand out most against the live set's upper median."""
    from lares.operators.quantiles import grouped_quantiles, upper_median
    long = scored.select("unit_key", F.explode(F.array(*[
        F.struct(F.lit(c).alias("component"), F.round(F.col(f"part_{c}"), 9).alias("part")) for c in COMPONENTS])).alias("x")).select("unit_key", "x.*")
    long = long.where("part is not null")
    med = grouped_quantiles(long, ["component"], F.col("part"), {"typical": upper_median()}).drop("n_values")
    # six rows at most: one per component
    lead = long.join(F.broadcast(med), "component").withColumn("lead", F.col("part") - F.col("typical"))
    w = Window.partitionBy("unit_key").orderBy(F.desc(F.round("lead", 6)), "component")
    return lead.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def max_ticket(applicants: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Largest price by the two income rules; NULL when other debts use up the capacity."""
    c = F.col
    by_income = c("income_clp") * p.income_share_max
    by_debt = c("income_clp") * p.debt_share_max - c("other_debt_clp")
    cap = F.least(by_income, by_debt)
    credit = cap / p.uf_clp / fin.instalment(F.lit(1.0), F.lit(p.rate_subsidised), p.loan_years)
    ok = cap > 0
    return applicants.withColumns({
        "instalment_max_clp": F.when(ok, cap), "credit_max": F.when(ok, credit),
        "ticket_max": F.when(ok, F.least(credit / p.ltv_guaranteed, F.lit(p.price_max_uf))),
        "debt_rule_binds": F.when(ok, by_debt < by_income)})


def zone_summary(scored: DataFrame) -> DataFrame:
    """Per zone: units, upper-median price per m2, lowest break-even down payment (NULL last)."""
    from lares.operators.quantiles import grouped_quantiles, upper_median
    agg = scored.groupBy("zone").agg(F.count("*").alias("n"), F.min("breakeven_down").alias("best_down"))
    med = grouped_quantiles(scored, ["zone"], F.col("price") / F.col("m2"), {"price_m2": upper_median()}).drop("n_values")
    return agg.join(med, "zone").orderBy(F.asc_nulls_last("best_down"), "zone")


def new_supply_units(supply: DataFrame, cells: DataFrame, bands) -> DataFrame:
    """Projects at their "from" price joined to the rent cell of their located zone, with a reason.

    ``supply``: p_partkey, district, zone, typ, typology, price, m2. Never falls back to the
    district: no zone, size, type or cell means no rent.
    """
    from lares.functions.exprs import size_band
    c = F.col
    j = supply.withColumn("band", size_band(c("m2"), bands)).join(
        cells.where("sufficient").select("zone", c("typ").alias("typology"), "band", c("rent_median").alias("rent"), c("n").alias("n_comps")),
        ["zone", "typology", "band"], "left")
    reason = (F.when(c("zone").isNull(), "no_geo").when(c("m2").isNull(), "no_m2").when(c("typology").isNull(), "no_typ")
              .when(c("rent").isNull(), "no_cell"))
    return j.withColumn("reason", reason)


def new_supply_summary(supply: DataFrame, cells: DataFrame, bands, scenarios: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Discards by reason plus evaluated and excluded counts with the mean score."""
    rows = cut(new_supply_units(supply, cells, bands))
    units = rows.where("reason is null").select(
        F.concat(F.lit("u"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("unit_key"), "zone", "district", "typ", "m2", "price",
        "rent", "n_comps", F.lit(None).cast("boolean").alias("tax_regime"), F.lit(True).alias("is_new"),
        F.lit(None).cast("int").alias("age_years"), F.lit("V").alias("price_evidence"), F.lit(False).alias("is_saturated"),
        F.lit(0.5).alias("risk"), F.lit(0.0).alias("catalyst"), F.lit(0.0).alias("zone_discount"))
    ev = cut(evaluate(units, scenarios, p))
    no_score = F.lit(None).cast("double")
    parts = rows.where("reason is not null").select("reason", no_score.alias("score"))
    parts = parts.unionByName(ev.where("exclusion is not null").select(F.lit("excluded").alias("reason"), no_score.alias("score")))
    parts = parts.unionByName(score(live_of(ev), p).select(F.lit("evaluated").alias("reason"), "score"))
    return parts.groupBy("reason").agg(F.count("*").alias("n"), (F.round(F.avg("score"), 6) + F.lit(0.0)).alias("avg_score"))
