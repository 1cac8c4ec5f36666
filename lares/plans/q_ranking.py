"""Ranking of the whole universe, with the measured risk and catalyst of every zone, and its reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.functions.exprs import size_band
from lares.operators import geo as G
from lares.operators import invest as I
from lares.operators import match as M
from lares.operators import rent as R
from lares.plans.q_geo import CAT_SQL, CENSUS_SQL, GEO_SQL, NEAR_SQL, RISK_SQL, assigned, catalyst_of
from lares.plans.q_invest import BASE_SQL, eval_sql, irr_sql, rd, rs, score_sql
from lares.plans.q_match import MATCHED, P as MP, scope_of
from lares.plans.q_rent import BANDS, CELLS_SQL, comps_and_furnished_of, comps_of
from lares.plans.registry import query, sql_with
from lares.session import cut

RUNITS_SQL = """
runits AS (SELECT unit_key, zone, k.district, typ, m2, price, rent, n_comps, tax_regime, is_new, age_years, CASE WHEN price_clp IS NOT NULL THEN 'D' ELSE 'V' END AS price_evidence, FALSE AS is_saturated,
  coalesce(zr.risk, 0.5::DOUBLE) AS risk, coalesce(zc.catalyst, 0.0::DOUBLE) AS catalyst, CASE WHEN zone_median <> 0 THEN (zone_median - price/m2)/zone_median ELSE 0 END AS zone_discount
  FROM kept k LEFT JOIN zmed USING (zone) LEFT JOIN (SELECT zone, risk FROM risk) zr USING (zone) LEFT JOIN (SELECT zone, catalyst FROM cat) zc USING (zone) WHERE dup = 1)"""
RANKED = (*MATCHED, CELLS_SQL, GEO_SQL, NEAR_SQL, CENSUS_SQL, RISK_SQL, CAT_SQL.format(f="1.0"), RUNITS_SQL, BASE_SQL, eval_sql(src="runits"), irr_sql(), score_sql())


def zone_facts(t, comps: DataFrame) -> DataFrame:
    """zone, risk, catalyst: one row per zone, measured where census, listings and stations allow."""
    listings = comps.where(size_band(F.col("m2"), BANDS).isNotNull()).groupBy("zone").agg(F.sum("listings").alias("n"))
    risk = G.zone_risk(G.zone_census(assigned(t)), listings).select("zone", "risk")
    return cut(risk.join(catalyst_of(t).select("zone", "catalyst"), "zone", "full"))


def ranked_units_from(t, candidates: DataFrame, matched: DataFrame, comps: DataFrame) -> DataFrame:
    return M.rankable_from(candidates, matched, zone_facts(t, comps)).withColumn("is_saturated", F.lit(False))


def ranked_units(t) -> DataFrame:
    """Comparables and candidates are written once and feed matching, zone medians and zone risk."""
    comps, furnished = comps_and_furnished_of(t)
    comps = cut(comps)
    candidates = cut(M.candidates_of(t.units, t.rates, t.now, scope_of(t), MP))
    matched = M.match_units(candidates, M.decisions(candidates, comps, furnished, MP), MP)
    return ranked_units_from(t, candidates, matched, comps)


@query("ranking", sql_with(*RANKED, final=f"""
SELECT row_number() OVER (ORDER BY score DESC, unit_key) AS position, unit_key, zone, {rs(['score', 'price', 'rent', 'cash_flow', 'breakeven_down', 'irr_10'])} FROM ev_scored ORDER BY ev_scored.score DESC, unit_key LIMIT 50""", recursive=True))
def ranking_q(t):
    """Flagship: comparables to match to evaluation to score, with zone risk and catalyst; the fifty best units."""
    s = I.score(I.live_of(I.evaluate(ranked_units(t), I.base_scenario(t.spark))))
    top = I.top_n(s, 50)
    return top.select(F.col("position").cast("bigint").alias("position"), "unit_key", "zone", *rd(["score", "price", "rent", "cash_flow", "breakeven_down", "irr_10"]))
