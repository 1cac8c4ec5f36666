"""Evaluation, score and ranking queries with their reference SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lares.functions import finance as fin
from lares.functions.exprs import evidence_worst, rnd
from lares.operators import invest as I
from lares.params import DEFAULT, Params
from lares.plans.bindings import PART_SQL, dealt
from lares.plans.registry import query, sql_with

D = DEFAULT


def eval_units(t):
    """All parts as units ready for evaluation, with a rent that depends on the key."""
    k = F.col("p_partkey")
    price = F.floor(F.col("p_retailprice") / 10) * 10.0 * (1 + k % 7)
    return dealt(t.part_dims, "p_partkey").select(
        F.concat(F.lit("u"), F.lpad(k.cast("string"), 9, "0")).alias("unit_key"), "zone", "district", "typ",
        (F.col("p_size") * 2.5 + 10.0).alias("m2"), price.alias("price"),
        (price * (25 + k % 40) / 10000.0).alias("rent"), (5 + k % 20).alias("n_comps"),
        F.when(k % 7 == 0, F.lit(False)).when(k % 7 == 1, F.lit(True)).alias("tax_regime"),
        (k % 4 == 0).alias("is_new"), F.when(k % 5 != 0, (k % 30).cast("int")).alias("age_years"),
        F.when(k % 41 == 0, "E").when(k % 3 == 0, "D").otherwise("V").alias("price_evidence"),
        (F.col("brand") % 12 == 0).alias("is_saturated"), ((F.col("brand") % 10) / 10.0).alias("risk"),
        ((F.col("brand") % 4) / 4.0).alias("catalyst"), ((k % 21 - 10) / 100.0).alias("zone_discount"))


EUNITS_SQL = """
eunits AS (
  SELECT 'u'||lpad(CAST(p_partkey AS VARCHAR),9,'0') AS unit_key, zone, district, typ, p_size*2.5::DOUBLE + 10 AS m2,
    floor(p_retailprice/10)*10.0::DOUBLE*(1 + p_partkey % 7) AS price,
    floor(p_retailprice/10)*10.0::DOUBLE*(1 + p_partkey % 7)*(25 + p_partkey % 40)/10000.0::DOUBLE AS rent, 5 + p_partkey % 20 AS n_comps,
    CASE WHEN p_partkey % 7 = 0 THEN FALSE WHEN p_partkey % 7 = 1 THEN TRUE END AS tax_regime, p_partkey % 4 = 0 AS is_new,
    CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 30 AS INTEGER) END AS age_years,
    CASE WHEN p_partkey % 41 = 0 THEN 'E' WHEN p_partkey % 3 = 0 THEN 'D' ELSE 'V' END AS price_evidence,
    brand % 12 = 0 AS is_saturated, (brand % 10)/10.0::DOUBLE AS risk, (brand % 4)/4.0::DOUBLE AS catalyst, (p_partkey % 21 - 10)/100.0::DOUBLE AS zone_discount
  FROM part_dims)"""

BASE_SQL = "scen AS (SELECT 'base' AS scenario_id, TRUE AS with_subsidy, 0.10::DOUBLE AS down, TRUE AS regime, 0.08::DOUBLE AS vacancy, 0.0330::DOUBLE AS rate, 0.0429::DOUBLE AS rate_plain, TRUE AS guarantee)"
GRID_SQL = """
scen AS (SELECT CASE WHEN s THEN 'sub' ELSE 'nosub' END||'_pie'||CAST(round(d*100) AS INTEGER)||'_dfl2_'||CASE WHEN v < 0.05 THEN 'prof' ELSE 'indiv' END AS scenario_id,
  s AS with_subsidy, d AS down, TRUE AS regime, v AS vacancy, CASE WHEN s THEN 0.0330::DOUBLE ELSE 0.0397::DOUBLE END AS rate, CASE WHEN s THEN 0.0429::DOUBLE ELSE 0.0397::DOUBLE END AS rate_plain, TRUE AS guarantee
  FROM (VALUES (TRUE),(FALSE)) a(s), (VALUES (0.10::DOUBLE),(0.15::DOUBLE),(0.20::DOUBLE)) b(d), (VALUES (0.08::DOUBLE),(0.045::DOUBLE)) c(v))"""


def fees_case(col="district"):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}::DOUBLE" for k, v in D.fees_by_municipality.items()) + f" ELSE {D.fees_default}::DOUBLE END"


def inst(credit, rate):
    return f"({credit} * (({rate}/12.0) * pow(1+{rate}/12.0, 360)) / (pow(1+{rate}/12.0, 360) - 1))"


def bal(credit, rate, months):
    return f"({credit} * (pow(1+{rate}/12.0, 360) - pow(1+{rate}/12.0, {months})) / (pow(1+{rate}/12.0, 360) - 1))"


def eval_sql(p: Params = D, src: str = "eunits", out: str = "ev", scen: str = "scen") -> str:
    er = repr(p.erosion)
    closing = repr(p.closing_fixed_uf + p.closing_fixed_clp / p.uf_clp)
    uf = repr(p.uf_clp)
    halv = math.ceil(math.log2(p.down_search_max / p.down_search_tol))
    exits = ", ".join(
        f"price*pow(1+{p.appreciation}, {n})*(1-{p.sale_fee_pct}*1.19) - {bal('credit', 'rate_applied', n * 12)} - greatest(0, price*pow(1+{p.appreciation}, {n}) - price - {p.gain_exempt_uf})*{p.gain_tax} AS exit_{n}"
        for n in p.irr_horizons)
    return f"""
{out}_b AS (SELECT u.*, s.*, (with_subsidy AND is_new AND price <= {p.subsidy_price_cap}) AS subsidy_applied,
   CASE WHEN NOT with_subsidy THEN NULL WHEN NOT is_new THEN 'used_home' WHEN price > {p.subsidy_price_cap} THEN 'over_price_cap' END AS no_subsidy_reason,
   CASE WHEN with_subsidy AND NOT (is_new AND price <= {p.subsidy_price_cap}) THEN rate_plain ELSE rate END AS rate_applied,
   (guarantee AND is_new) AS guarantee_applied, CASE WHEN guarantee AND NOT is_new THEN 'used_home' END AS no_guarantee_reason,
   (regime AND CASE WHEN tax_regime IS NULL THEN m2 <= 140 ELSE tax_regime END) AS regime_applied,
   (regime AND tax_regime IS NULL AND m2 <= 140) AS regime_assumed,
   CASE WHEN NOT regime THEN NULL WHEN tax_regime IS NULL AND m2 > 140 THEN 'unconfirmed' WHEN tax_regime = FALSE THEN 'not_covered' END AS no_regime_reason,
   CASE WHEN guarantee AND is_new THEN 1.0::DOUBLE - {p.ltv_guaranteed}::DOUBLE ELSE 1.0::DOUBLE - {p.ltv_plain}::DOUBLE END AS down_required FROM {src} u, {scen} s),
{out}_c AS (SELECT *, CASE WHEN age_years IS NULL THEN CASE WHEN regime_assumed THEN is_new ELSE TRUE END ELSE age_years < CASE WHEN m2 <= 70 THEN 20 WHEN m2 <= 100 THEN 15 ELSE 10 END END AS tax_window_open,
   greatest(down, down_required) AS down_effective, rent*12.0 AS pgi, rent*12.0*(1-vacancy)*(1-{p.bad_debt})*{er}::DOUBLE AS egi, price*{uf}::DOUBLE*{p.assessed_ratio} AS assessed FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN assessed <= {p.property_tax_cut_clp} THEN greatest(0, assessed-{p.property_tax_exempt_clp})*{p.property_tax_low} ELSE ({p.property_tax_cut_clp}-{p.property_tax_exempt_clp})*{p.property_tax_low} + (assessed-{p.property_tax_cut_clp})*{p.property_tax_high} END
   * CASE WHEN regime_applied AND tax_window_open THEN 0.5 ELSE 1.0 END / {uf}::DOUBLE AS property_tax,
   {fees_case()}*m2*12.0*vacancy/{uf}::DOUBLE AS fees_vacant FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN regime_applied THEN 0 ELSE greatest(0, egi-property_tax)*{p.income_tax_marginal} END AS income_tax, price*(1-down_effective) AS credit FROM {out}_d),
{out}_f AS (SELECT *, property_tax+fees_vacant+egi*{p.management_pct}+rent*{p.letting_fee_months}/{p.tenant_years}+pgi*{p.upkeep_pct}+income_tax AS opex, {inst('credit', 'rate_applied')} AS instalment FROM {out}_e),
{out}_g AS (SELECT *, egi-opex AS noi, instalment+credit*{p.life_insurance_monthly}+price*{p.fire_insurance_monthly} AS instalment_total, credit*{p.stamp_tax}+{closing}::DOUBLE AS closing_costs, (credit-{bal('credit', 'rate_applied', 12)})/12.0 AS principal_monthly FROM {out}_f),
{out}_h AS (SELECT *, instalment_total*12 AS debt_service, noi/12.0-instalment_total AS cash_flow, price*down_effective+closing_costs+{p.fitting_out_uf} AS capital,
   ({inst('1.0', 'rate_applied')}+{p.life_insurance_monthly}) AS per_credit FROM {out}_g),
{out}_i AS (SELECT *, cash_flow+principal_monthly AS holding_cost, 1.0-((noi/12.0-price*{p.fire_insurance_monthly})/per_credit)/price AS droot,
   1.0-(1.0-opex/pgi)*(pgi/price)/(12*{inst('1.0', 'rate_applied')}) AS breakeven_down_simple,
   12*(1-vacancy)*(1-{p.bad_debt})*{er}::DOUBLE AS rk, property_tax+fees_vacant+debt_service AS rfixed, CASE WHEN regime_applied THEN 0.0 ELSE {p.income_tax_marginal} END AS rtax, {exits} FROM {out}_h),
{out}_j AS (SELECT *, CASE WHEN greatest({p.down_search_max}, down_required) < droot THEN NULL WHEN down_required >= droot THEN 0.0 ELSE ceil(droot/{p.down_search_max}*pow(2,{halv}))*{p.down_search_max}/pow(2,{halv}) END AS breakeven_down,
   rk*(1-{p.management_pct})-{p.letting_fee_months}/{p.tenant_years}-12*{p.upkeep_pct} AS rslope, greatest(rent,1.0)*{p.rent_search_factor} AS rhi FROM {out}_i),
{out}_k AS (SELECT *, CASE WHEN rtax = 0 OR rk*rfixed/rslope <= property_tax THEN rfixed/rslope ELSE (rfixed-rtax*property_tax)/(rslope-rtax*rk) END AS rroot, rhi-0.01 AS rw FROM {out}_j),
{out}_l AS (SELECT *, CASE WHEN rroot > rhi THEN NULL WHEN rroot <= 0.01 THEN 0.0 ELSE 0.01+rw*ceil((rroot-0.01)/rw*pow(2,ceil(log2(rw/0.01))))/pow(2,ceil(log2(rw/0.01))) END AS breakeven_rent,
   CASE WHEN price > {p.price_max_uf} THEN 'price_over_cap' WHEN m2 > 140 THEN 'size_over_cap' WHEN n_comps < 8 THEN 'few_comparables' WHEN is_saturated THEN 'saturated' WHEN price_evidence NOT IN ('V','D') THEN 'estimated_price' WHEN tax_regime = FALSE THEN 'no_tax_regime' END AS hard FROM {out}_k)"""


def npv_sql(r, n):
    return f"(-capital + cash_flow*12*CASE WHEN abs({r}) < 1e-9 THEN {n} ELSE (1-pow(1+{r},-{n}))/({r}) END + exit_{n}*pow(1+{r},-{n}))"


def irr_sql(out="ev", horizons=D.irr_horizons) -> str:
    """Bisection as a recursive query: sixty halvings of every defined row at once."""
    case = lambda r: "CASE n " + " ".join(f"WHEN {n} THEN {npv_sql(r, n)}" for n in horizons) + " END"
    ch = lambda n: (f"((CASE WHEN cash_flow <> 0 AND cash_flow > 0 THEN 1 ELSE 0 END) + CASE WHEN cash_flow <> 0 AND cash_flow*12+exit_{n} <> 0 AND (cash_flow > 0) <> (cash_flow*12+exit_{n} > 0) THEN 1 "
                    f"WHEN cash_flow = 0 AND exit_{n} > 0 THEN 1 ELSE 0 END)")
    hs = ", ".join(f"({n})" for n in horizons)
    ok = "CASE n " + " ".join(f"WHEN {n} THEN {ch(n)} = 1 AND {npv_sql('-0.9999', n)} * {npv_sql('10.0', n)} <= 0" for n in horizons) + " END"
    vlo = "CASE n " + " ".join(f"WHEN {n} THEN {npv_sql('-0.9999', n)} > 0" for n in horizons) + " END"
    return f"""
{out}_flows AS (SELECT unit_key, scenario_id, capital, cash_flow, {', '.join(f'exit_{n}' for n in horizons)}, n FROM {out}_l, (VALUES {hs}) h(n)),
{out}_ok AS (SELECT *, {vlo} AS up FROM {out}_flows WHERE {ok}),
{out}_bis AS (
  SELECT *, -0.9999::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS step FROM {out}_ok
  UNION ALL SELECT * REPLACE (CASE WHEN (({case('((lo+hi)/2)')}) < 0) = up THEN lo ELSE (lo+hi)/2 END AS lo, CASE WHEN (({case('((lo+hi)/2)')}) < 0) = up THEN (lo+hi)/2 ELSE hi END AS hi, step+1 AS step) FROM {out}_bis WHERE step < 60),
{out}_irr AS (SELECT unit_key, scenario_id, {', '.join(f'max(CASE WHEN n={n} THEN (lo+hi)/2 END) AS irr_{n}' for n in horizons)} FROM {out}_bis WHERE step = 60 GROUP BY 1, 2),
{out} AS (SELECT l.*, {', '.join(f'irr_{n}' for n in horizons)}, {npv_sql(repr(D.discount_rate), 10)} AS npv_10,
  coalesce(hard, nullif(concat_ws(' · ', CASE WHEN -cash_flow > {D.deficit_max_uf!r}::DOUBLE THEN 'cash_deficit' END, CASE WHEN irr_10 IS NULL THEN 'irr_undefined' END), '')) AS exclusion
  FROM {out}_l l LEFT JOIN {out}_irr USING (unit_key, scenario_id))"""


def score_sql(out="ev", weights=D.score_weights) -> str:
    comp = {"holding_cost": "holding_cost", "breakeven_down": "coalesce(breakeven_down, CASE WHEN cash_flow < 0 THEN 1.0 ELSE breakeven_down_simple END)", "irr_10y": "irr_10",
            "zone_risk": "risk", "catalyst": "catalyst", "zone_discount": "zone_discount"}
    sel = ", ".join(f"{e} AS c_{k}" for k, e in comp.items())
    mm = ", ".join(f"min(c_{k}) AS lo_{k}, max(c_{k}) AS hi_{k}" for k in comp)
    act = {k: f"CASE WHEN NOT (n_live > 1 AND lo_{k} = hi_{k}) THEN {weights[k]}::DOUBLE ELSE 0 END" for k in comp}
    tot = "(" + " + ".join(act.values()) + ")"
    norm = lambda k: f"CASE WHEN lo_{k} = hi_{k} THEN 0.5 ELSE " + (f"(c_{k}-lo_{k})" if I.HIGHER_IS_BETTER[k] else f"(hi_{k}-c_{k})") + f"/(hi_{k}-lo_{k}) END"
    parts = ", ".join(f"CASE WHEN NOT (n_live > 1 AND lo_{k} = hi_{k}) AND {tot} > 0 THEN {norm(k)}*{weights[k]}::DOUBLE/{tot}*100 END AS part_{k}" for k in comp)
    return f"""
{out}_live AS (SELECT *, {sel} FROM {out} WHERE exclusion IS NULL),
{out}_rng AS (SELECT scenario_id, count(*) AS n_live, {mm} FROM {out}_live GROUP BY 1),
{out}_parts AS (SELECT l.*, n_live, {parts} FROM {out}_live l JOIN {out}_rng USING (scenario_id)),
{out}_scored AS (SELECT *, {' + '.join(f'coalesce(part_{k}, 0)' for k in comp)} AS score FROM {out}_parts)"""


EV = (PART_SQL, EUNITS_SQL, BASE_SQL, eval_sql())
EVR = (*EV, irr_sql())
EVS = (*EVR, score_sql())
rs = lambda names, d=6: ", ".join(f"round({n},{d})+0.0 AS {n}" for n in names)
rd = lambda names, d=6: [rnd(F.col(n), d).alias(n) for n in names]


def evaluated(t, p: Params = D, scen=None, returns=True):
    return I.evaluate(eval_units(t), scen if scen is not None else I.base_scenario(t.spark, p), p, returns)


def scored_of(t, p: Params = D):
    return I.score(I.live_of(evaluated(t, p)), p)


@query("loan_metrics", sql_with(PART_SQL, EUNITS_SQL, final=f"""
SELECT unit_key, {rs(['inst', 'f', 'b60', 'b360', 'paid'])} FROM (SELECT unit_key, {inst('price', '0.0429')} AS inst, 12*{inst('1.0', '0.0429')} AS f, {bal('price', '0.0429', 60)} AS b60, {bal('price', '0.0429', 360)} AS b360, ({bal('price', '0.0429', 12)} - {bal('price', '0.0429', 24)})/12 AS paid FROM eunits)"""))
def loan_q(t):
    """Instalment, debt factor, balances and principal paid."""
    c, r = F.col("price"), F.lit(0.0429)
    u = eval_units(t).select(
        "unit_key", fin.instalment(c, r, 30).alias("inst"), fin.annual_debt_factor(r, 30).alias("f"), fin.balance(c, r, 30, 60).alias("b60"),
        fin.balance(c, r, 30, 360).alias("b360"), (fin.principal_paid(c, r, 30, 12, 24) / 12).alias("paid"))
    return u.select("unit_key", *rd(["inst", "f", "b60", "b360", "paid"]))


NOI = ["pgi", "egi", "property_tax", "fees_vacant", "income_tax", "opex", "noi"]


@query("noi_metrics", sql_with(*EV, final=f"SELECT unit_key, {rs(NOI)} FROM ev_l"))
def noi_q(t):
    """Income, running costs and net operating income."""
    return evaluated(t, returns=False).select("unit_key", *rd(NOI))


BEN = ["subsidy_applied", "no_subsidy_reason", "guarantee_applied", "no_guarantee_reason", "regime_applied", "regime_assumed", "no_regime_reason", "tax_window_open"]


@query("benefit_rules", sql_with(*EV, final=f"SELECT unit_key, {', '.join(BEN)}, rate_applied, {rs(['down_effective'])} FROM ev_l"))
def benefit_q(t):
    """Eligibility for subsidy, guarantee and tax regime with reasons."""
    return evaluated(t, returns=False).select("unit_key", *BEN, "rate_applied", *rd(["down_effective"]))


@query("exclusion_rules", sql_with(*EVR, final="SELECT unit_key, exclusion FROM ev", recursive=True))
def exclusion_q(t):
    """First hard exclusion, then liquidity cap and undefined return."""
    return evaluated(t).select("unit_key", "exclusion")


@query("exclusion_counts", sql_with(*EVR, final="SELECT split_part(coalesce(exclusion, 'ranks'), ' · ', 1) AS reason, count(*) AS n FROM ev GROUP BY 1", recursive=True))
def exclusion_counts_q(t):
    """Units per exclusion reason."""
    r = F.split(F.coalesce("exclusion", F.lit("ranks")), " · ")[0]
    return evaluated(t).groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


MET = ["credit", "instalment_total", "closing_costs", "capital", "cash_flow", "principal_monthly", "holding_cost", "breakeven_down_simple"]
RATIO_SQL = "round(pgi/price,6)+0.0 AS gross_yield, round(noi/(price+closing_costs),6)+0.0 AS cap_rate, round(price/pgi,6)+0.0 AS grm, round(noi/debt_service,6)+0.0 AS dscr, round(CASE WHEN cash_flow < 0 THEN least(1.0, principal_monthly/-cash_flow) ELSE 0 END,6)+0.0 AS savings_share, round(cash_flow*12/capital,6)+0.0 AS cash_on_cash, round((debt_service+opex)/rk,6)+0.0 AS breakeven_rent_simple, round((opex+debt_service)/pgi,6)+0.0 AS breakeven_occupancy"


@query("unit_metrics", sql_with(*EV, final=f"SELECT unit_key, {rs(MET)}, {RATIO_SQL} FROM ev_l"))
def metrics_q(t):
    """Yield, cap rate, coverage, cash flow, break-even figures."""
    return evaluated(t, returns=False).select("unit_key", *rd(MET + ["gross_yield", "cap_rate", "grm", "dscr", "savings_share", "cash_on_cash", "breakeven_rent_simple", "breakeven_occupancy"]))


@query("irr", sql_with(*EVR, final=f"SELECT unit_key, {rs(['irr_10', 'irr_20', 'irr_30'])} FROM ev", recursive=True))
def irr_q(t):
    """Internal rate of return at 10, 20 and 30 years; NULL when not defined or not unique."""
    return evaluated(t).select("unit_key", *rd(["irr_10", "irr_20", "irr_30"]))


@query("npv", sql_with(*EVR, final=f"SELECT unit_key, {rs(['npv_10'])} FROM ev", recursive=True))
def npv_q(t):
    """Net present value of the ten-year flows."""
    return evaluated(t).select("unit_key", *rd(["npv_10"]))


@query("breakeven_pie", sql_with(*EV, final="SELECT unit_key, CAST(round(breakeven_down/0.95*2048) AS BIGINT) AS grid_step FROM ev_l"))
def breakeven_down_q(t):
    """Break-even down payment on the full model, as its step on the search grid."""
    return evaluated(t, returns=False).select("unit_key", F.round(F.col("breakeven_down") / 0.95 * 2048).cast("bigint").alias("grid_step"))


@query("breakeven_rent", sql_with(*EV, final=f"SELECT unit_key, {rs(['breakeven_rent'])} FROM ev_l"))
def breakeven_rent_q(t):
    """Break-even rent on the full model."""
    return evaluated(t, returns=False).select("unit_key", rnd(I.breakeven_rent()).alias("breakeven_rent"))


@query("scenario_grid", sql_with(PART_SQL, EUNITS_SQL, GRID_SQL, eval_sql(), final="""
SELECT scenario_id, count(*) AS n, round(avg(cash_flow),6)+0.0 AS cash_flow, round(avg(capital),6)+0.0 AS capital, count(breakeven_down) AS reachable FROM ev_l GROUP BY 1"""))
def scenario_grid_q(t):
    """Every unit under every scenario of the grid."""
    e = evaluated(t, scen=I.scenario_grid(t.spark), returns=False)
    return e.groupBy("scenario_id").agg(F.count("*").alias("n"), rnd(F.avg("cash_flow")).alias("cash_flow"), rnd(F.avg("capital")).alias("capital"), F.count("breakeven_down").alias("reachable"))


PARTS = [f"part_{k}" for k in I.COMPONENTS]


@query("score", sql_with(*EVS, final=f"SELECT unit_key, {rs(['score'] + PARTS)} FROM ev_scored", recursive=True))
def score_q(t):
    """Score of the live units with its breakdown."""
    return scored_of(t).select("unit_key", *rd(["score"] + PARTS))


INERT_UNITS_SQL = EUNITS_SQL.replace("(brand % 4)/4.0::DOUBLE AS catalyst", "0.0::DOUBLE AS catalyst").replace("(brand % 10)/10.0::DOUBLE AS risk", "0.5::DOUBLE AS risk")


@query("score_inert", sql_with(PART_SQL, INERT_UNITS_SQL, BASE_SQL, eval_sql(), irr_sql(), score_sql(), final="""
SELECT 'catalyst,zone_risk' AS inert, 0.25::DOUBLE AS inert_weight, count(*) AS n, round(avg(score),6)+0.0 AS avg_score, round(max(score),6)+0.0 AS max_score FROM ev_scored""", recursive=True))
def score_inert_q(t):
    """Score when two components do not vary: they leave and their weight is shared out."""
    u = eval_units(t).withColumn("catalyst", F.lit(0.0)).withColumn("risk", F.lit(0.5))
    live = I.live_of(I.evaluate(u, I.base_scenario(t.spark)))
    s = I.score(live).groupBy("scenario_id").agg(F.count("*").alias("n"), rnd(F.avg("score")).alias("avg_score"), rnd(F.max("score")).alias("max_score"))
    return s.join(I.inert_components(live), "scenario_id").select("inert", rnd(F.col("inert_weight")).alias("inert_weight"), "n", "avg_score", "max_score")


@query("ranking_filter", sql_with(*EVS, final=f"""
SELECT unit_key, {rs(['score', 'breakeven_down'])} FROM ev_scored WHERE district = 'c1' AND m2 >= 30 AND m2 <= 110 AND price >= 1000 AND price <= 5500 AND breakeven_down <= 0.9 ORDER BY ev_scored.score DESC, unit_key LIMIT 20""", recursive=True))
def ranking_filter_q(t):
    """Ranking view: district, size range, price band, reachable break-even (NULL fails), top 20."""
    s = scored_of(t).where("district = 'c1' and m2 >= 30 and m2 <= 110 and price >= 1000 and price <= 5500 and breakeven_down <= 0.9")
    return I.top_n(s, 20).select("unit_key", *rd(["score", "breakeven_down"]))


@query("zone_summary", sql_with(*EVS, final="""
SELECT zone, count(*) AS n, list_sort(list(price/m2))[count(*)//2+1] AS price_m2, round(min(breakeven_down),6)+0.0 AS best_down FROM ev_scored GROUP BY 1""", recursive=True))
def zone_summary_q(t):
    """Ranked units per zone: count, upper-median price per m2, lowest break-even down payment."""
    return I.zone_summary(scored_of(t)).select("zone", "n", "price_m2", rnd(F.col("best_down")).alias("best_down"))


DRIVERS_SQL = """
, longp AS (SELECT unit_key, component, round(part,9) AS part FROM ev_scored UNPIVOT (part FOR component IN (""" + ", ".join(PARTS) + """))),
med AS (SELECT component, list_sort(list(part))[count(*)//2+1] AS typical FROM longp GROUP BY 1),
lead AS (SELECT unit_key, substr(component, 6) AS component, part - typical AS lead, row_number() OVER (PARTITION BY unit_key ORDER BY round(part-typical,6) DESC, component) AS place FROM longp JOIN med USING (component))
SELECT unit_key, place, component, round(lead,6)+0.0 AS lead FROM lead WHERE place <= 2"""


@query("score_drivers", sql_with(*EVS, final=DRIVERS_SQL, recursive=True))
def drivers_q(t):
    """The two components in which each unit stands out against the live set's median."""
    d = I.score_drivers(scored_of(t))
    return d.select("unit_key", F.col("place").cast("bigint").alias("place"), "component", rnd(F.col("lead")).alias("lead"))


@query("max_ticket", f"""
SELECT c_custkey, {rs(['instalment_max_clp', 'ticket_max'])}, debt_rule_binds FROM (
 SELECT c_custkey, CASE WHEN cap > 0 THEN cap END AS instalment_max_clp, CASE WHEN cap > 0 THEN least(cap/40804.0/{inst('1.0', '0.0330')}/0.9, 6000) END AS ticket_max, CASE WHEN cap > 0 THEN CAST(b < a AS VARCHAR) END AS debt_rule_binds
 FROM (SELECT c_custkey, least(a, b) AS cap, a, b FROM (SELECT c_custkey, c_acctbal*500*0.25 AS a, c_acctbal*500*0.45 - (c_custkey % 10)*50000 AS b FROM customer)))""")
def max_ticket_q(t):
    """Largest price an applicant can carry by income and debt rules."""
    a = t("customer").select("c_custkey", (F.col("c_acctbal") * 500).alias("income_clp"), ((F.col("c_custkey") % 10) * 50000).alias("other_debt_clp"))
    return I.max_ticket(a).select("c_custkey", *rd(["instalment_max_clp", "ticket_max"]), F.col("debt_rule_binds").cast("string").alias("debt_rule_binds"))


@query("evidence_worst", sql_with(PART_SQL, EUNITS_SQL, final="""
SELECT level, count(*) AS n FROM (SELECT CASE WHEN price_evidence = 'ND' OR r = 'ND' THEN 'ND' WHEN price_evidence = 'E' OR r = 'E' THEN 'E' ELSE 'D' END AS level
 FROM (SELECT price_evidence, CASE WHEN n_comps < 8 THEN 'ND' WHEN n_comps < 12 THEN 'E' ELSE 'V' END AS r FROM eunits)) GROUP BY 1"""))
def evidence_q(t):
    """Evidence level of a value derived from price and rent."""
    r = F.when(F.col("n_comps") < 8, "ND").when(F.col("n_comps") < 12, "E").otherwise("V")
    return eval_units(t).groupBy(evidence_worst(F.col("price_evidence"), r).alias("level")).agg(F.count("*").alias("n"))
