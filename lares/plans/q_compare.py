"""Comparison and view queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import rnd, size_band
from lares.operators import compare as C
from lares.operators import invest as I
from lares.operators import match as M
from lares.operators import rent as R
from lares.params import DEFAULT
from lares.plans.bindings import NOW, PART_SQL, SCOPE_SQL, UNITS_SQL
from lares.plans.q_geo import CAT_SQL, GEO_SQL, catalyst_of
from lares.plans.q_invest import (BASE_SQL, EUNITS_SQL, EV, EVS, eval_sql, eval_units, evaluated, irr_sql, rd, rs, score_sql, scored_of)
from lares.plans.q_match import MATCH_SQL, MATCHED, P, UNIT_ROWS_SQL, WINDOW_SQL, decide_sql, inputs, scope_of
from lares.plans.q_ranking import RANKED, ranked_units_from
from lares.plans.q_rent import COMPS, comps_and_furnished_of, comps_of
from lares.plans.registry import query, sql_with
from lares.session import cut

CHEAP = DEFAULT.with_(life_insurance_monthly=0.0002, fire_insurance_monthly=0.0002)
POS = "row_number() OVER (ORDER BY round(score,9) DESC, unit_key)"


@query("rank_shift", sql_with(*EVS, eval_sql(CHEAP, out="cv"), irr_sql("cv"), score_sql("cv"), final=f"""
, pa AS (SELECT unit_key, {POS} AS pa FROM ev_scored), pb AS (SELECT unit_key, {POS} AS pb FROM cv_scored),
j AS (SELECT pa, pb, (SELECT count(*) FROM pa JOIN pb USING (unit_key)) AS common FROM pa FULL JOIN pb USING (unit_key))
SELECT count(pa) AS before, count(pb) AS after, count(*) FILTER (pa IS NULL) AS entered, count(*) FILTER (pb IS NULL) AS "left", max(common) AS common,
 count(*) FILTER (abs(pa-pb) > common*0.1) AS moved, count(*) FILTER (pa <= 5 AND pa IS DISTINCT FROM pb) > 0 AS top_changed, round(count(*) FILTER (abs(pa-pb) > common*0.1)::DOUBLE/max(common),6)+0.0 AS moved_share FROM j""", recursive=True))
def rank_shift_q(t):
    """Ranking under two parameter sets: insurance premiums as assumed and as quoted."""
    s = C.rank_shift(scored_of(t), scored_of(t, CHEAP))
    return s.withColumn("moved_share", rnd(F.col("moved_share")))


@query("top_diff", sql_with(*EVS, eval_sql(CHEAP, out="cv"), irr_sql("cv"), score_sql("cv"), final="""
, o AS (SELECT unit_key, price*CASE WHEN CAST(substr(unit_key,2) AS BIGINT) % 3 = 0 THEN 1.02 ELSE 1 END AS price FROM cv_scored ORDER BY round(score,9) DESC, unit_key LIMIT 60),
n AS (SELECT unit_key, price FROM ev_scored ORDER BY round(score,9) DESC, unit_key LIMIT 60)
SELECT coalesce(o.unit_key, n.unit_key) AS unit_key, round(o.price,6)+0.0 AS before, round(n.price,6)+0.0 AS after, CASE WHEN o.unit_key IS NULL THEN 'entered' WHEN n.unit_key IS NULL THEN 'left' WHEN n.price < o.price THEN 'price_cut' ELSE 'same' END AS state
FROM o FULL JOIN n ON o.unit_key = n.unit_key""", recursive=True))
def top_diff_q(t):
    """Two top-60 snapshots compared: entered, left, price cuts."""
    old = I.top_n(scored_of(t, CHEAP), 60)
    k = F.substring("unit_key", 2, 20).cast("bigint")
    old = old.select("unit_key", (F.col("price") * F.when(k % 3 == 0, 1.02).otherwise(1.0)).alias("price"))
    d = C.top_diff(old, I.top_n(scored_of(t), 60).select("unit_key", "price"))
    return d.select("unit_key", *rd(["before", "after"]), "state")


NOCOL = (COMPS[0], COMPS[1], COMPS[2], """
ncomps AS (SELECT comp_id, zone, typ, m2, rent FROM clean WHERE multifamily OR NOT twin)""")
NSTATS = WINDOW_SQL.replace("sizes AS (", "nsizes AS (").replace("wcomps AS (SELECT * FROM comps", "nwcomps AS (SELECT * FROM ncomps")
for _a in ("sizes", "wcomps", "wpairs", "wstats", "wfurn", "wall"):
    NSTATS = NSTATS.replace(f"FROM {_a} ", f"FROM n{_a} ").replace(f"JOIN {_a} ", f"JOIN n{_a} ").replace(f"{_a} AS (", f"n{_a} AS (").replace("nnsizes", "nsizes").replace("nnwcomps", "nwcomps")


@query("collapse_effect", sql_with(*MATCHED, NOCOL[3], NSTATS, decide_sql("ndecided", "nwall"), MATCH_SQL.replace("matched AS", "nmatched AS").replace("FROM matched", "FROM nmatched").replace("kept AS", "nkept AS").replace("decided d", "ndecided d").split("zmed AS")[0].rstrip().rstrip(","), final="""
SELECT count(*) FILTER (d > 1e-12) AS up, count(*) FILTER (d < -1e-12) AS down, count(*) FILTER (abs(d) <= 1e-12) AS equal, count(*) FILTER (b IS NULL) AS now_unassigned, count(*) FILTER (a IS NULL) AS only_collapsed, count(*) FILTER (abs(d) > 0.1) AS over_ten_percent
FROM (SELECT n.rent AS a, k.rent AS b, (k.rent-n.rent)/n.rent AS d FROM (SELECT * FROM nkept WHERE dup=1) n FULL JOIN (SELECT * FROM kept WHERE dup=1) k ON n.unit_key=k.unit_key)"""))
def collapse_effect_q(t):
    """Assigned rents with and without the relisting collapse."""
    cand = cut(M.candidates_of(t.units, t.rates, t.now, scope_of(t), P))
    furn = R.furnished_sizes(t.rents, t.now)
    kept = lambda c: M.collapse_duplicates(M.match_units(cand, M.decisions(cand, comps_of(t, collapse=c), furn, P), P)).select("unit_key", "rent")
    return C.collapse_effect(kept(True), kept(False))


@query("guard_sweep", sql_with(*COMPS, UNITS_SQL, SCOPE_SQL, UNIT_ROWS_SQL, WINDOW_SQL, "thr AS (SELECT unnest([0.10::DOUBLE, 0.15::DOUBLE, 0.20::DOUBLE, 99.0::DOUBLE]) AS shift_max)", "wsweep AS (SELECT * FROM wall, thr)",
    decide_sql("swept", "wsweep", shift="shift_max", minn=60), final="""
SELECT shift_max, CAST(coalesce(sum(units) FILTER (match IS NOT NULL),0) AS BIGINT) AS ranks, CAST(coalesce(sum(units) FILTER (match_reason='wide_shifted'),0) AS BIGINT) AS wide_shifted,
 CAST(coalesce(sum(units) FILTER (match_reason='seasonal'),0) AS BIGINT) AS seasonal, CAST(coalesce(sum(units) FILTER (match_reason='no_comparables'),0) AS BIGINT) AS no_comparables
FROM swept JOIN (SELECT zone, typ, m2 AS m2u, count(*) AS units FROM cand GROUP BY 1,2,3) USING (zone, typ, m2u) GROUP BY 1"""))
def guard_sweep_q(t):
    """Outcomes for four values of the wide-window shift threshold (minimum raised to 60 on this data)."""
    cand, comps, furn = inputs(t)
    cand = cut(cand)
    stats = M.window_stats(M.sizes_of(cand, P), comps.where(size_band(F.col("m2"), P.bands).isNotNull()), furn, P)
    thr = t.spark.createDataFrame([(0.10,), (0.15,), (0.20,), (99.0,)], "shift_max double")
    return C.guard_sweep(cand, stats, thr, P.with_(min_comparables=60))


FACTORS = (1.0, 0.5, 0.25, 0.0)


def _cat(f):
    i = str(f).replace(".", "")
    text = CAT_SQL.format(f=f)
    for name in ("st", "el", "zp", "cat"):
        text = text.replace(f"{name} AS (", f"{name}{i} AS (").replace(f"FROM {name} ", f"FROM {name}{i} ").replace(f", {name} b)", f", {name}{i} b)")
    return text.replace("FROM zp a", f"FROM zp{i} a"), i


_CATS = [_cat(f) for f in FACTORS]
SWEEP_UNION = "cats AS (" + " UNION ALL ".join(f"SELECT {f}::DOUBLE AS factor, zone, catalyst FROM cat{i}" for f, (_, i) in zip(FACTORS, _CATS)) + ")"
SWEEP_SCORE = score_sql("sw").replace("scenario_id", "factor")


@query("catalyst_sweep", sql_with(PART_SQL, GEO_SQL, *[x for x, _ in _CATS], SWEEP_UNION, EUNITS_SQL, BASE_SQL, eval_sql(), irr_sql(),
    "sw AS (SELECT e.* EXCLUDE (catalyst), factor, coalesce(c.catalyst, 0) AS catalyst FROM ev e CROSS JOIN (SELECT DISTINCT factor FROM cats) f LEFT JOIN cats c USING (factor, zone))", SWEEP_SCORE, final="""
, ps AS (SELECT factor, unit_key, catalyst, row_number() OVER (PARTITION BY factor ORDER BY round(score,9) DESC, unit_key) AS pos FROM sw_scored),
b AS (SELECT unit_key, pos AS p0, count(*) OVER () AS n FROM ps WHERE factor = 1.0)
SELECT factor, count(*) FILTER (abs(pos-p0) > greatest(1, floor(n*0.1))) AS moved, max(n) AS n, round(avg(catalyst),6)+0.0 AS mean_catalyst FROM ps JOIN b USING (unit_key) GROUP BY 1""", recursive=True))
def catalyst_sweep_q(t):
    """How much of the ranking moves as open stations count less."""
    live = I.live_of(evaluated(t))
    cats = None
    for f in FACTORS:
        c = catalyst_of(t, f).select(F.lit(f).alias("factor"), "zone", "catalyst").where("catalyst is not null")
        cats = c if cats is None else cats.unionByName(c)
    return C.catalyst_sweep(live, cut(cats), 1.0).withColumn("mean_catalyst", rnd(F.col("mean_catalyst")))


@query("reconfirm_state", sql_with(*EVS, final=f"""
SELECT s.unit_key, CASE WHEN district IN ('c0','c2') THEN CAST(CAST(substr(s.unit_key,2) AS BIGINT) % 25 = 0 AS VARCHAR) END AS reconfirmed FROM ev_scored s ORDER BY round(score,9) DESC, s.unit_key LIMIT 60""", recursive=True))
def reconfirm_q(t):
    """Top rows seen again today, not seen, or in a district that was not visited."""
    top = I.top_n(scored_of(t), 60)
    visited = t("region").where("r_regionkey in (0, 2)").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("district"))
    k = F.substring("unit_key", 2, 20).cast("bigint")
    top = top.withColumn("seen", F.date_sub(t.now, (k % 25).cast("int")))
    return C.reconfirm_state(top, visited, t.now).select("unit_key", F.col("reconfirmed").cast("string").alias("reconfirmed"))


@query("cheapest_in_scope", sql_with(PART_SQL, UNITS_SQL, SCOPE_SQL, final="SELECT unit_key, u.district, price_uf FROM units u JOIN scope USING (district) WHERE from_price AND price_uf IS NOT NULL ORDER BY price_uf, unit_key LIMIT 12"))
def cheapest_q(t):
    """Lowest "from" prices in scope."""
    return C.cheapest_in_scope(t.units, t.scope).select("unit_key", "district", "price_uf")


@query("top_groups_in_order", sql_with(*EVS, final=f"""
SELECT zone, min(p) AS first_position FROM (SELECT zone, {POS} AS p FROM ev_scored) WHERE p <= 100 GROUP BY 1 ORDER BY 2 LIMIT 8""", recursive=True))
def top_groups_q(t):
    """Zones of the top hundred in rank order, at most eight."""
    return C.groups_in_order(I.top_n(scored_of(t), 100), "zone").withColumn("first_position", F.col("first_position").cast("bigint"))


@query("unit_dossier", sql_with(*RANKED, final=f"""
, pos AS (SELECT unit_key, {POS} AS position, score FROM ev_scored)
SELECT u.unit_key, coalesce(r.row_reason, m.match_reason, CASE WHEN p.position IS NOT NULL THEN 'ranked' END, CASE WHEN m.match IS NOT NULL THEN 'not_ranked' END, 'not_priced') AS state,
 d.n_0, d.n_1, d.n_2, round(m.rent,6)+0.0 AS rent, p.position, round(p.score,6)+0.0 AS score
FROM units u LEFT JOIN ureasons r USING (unit_key) LEFT JOIN matched m USING (unit_key) LEFT JOIN decided d ON m.zone=d.zone AND m.typ=d.typ AND m.m2=d.m2u LEFT JOIN pos p USING (unit_key)""", recursive=True))
def dossier_q(t):
    """Reason or match, peers by width, rent, position and score of every unit."""
    comps, furn = comps_and_furnished_of(t)
    comps = cut(comps)
    needed = ["unit_key", "zone", "typ", "m2", "price", *[c for c in M.UNIT_COLUMNS], "row_reason"]
    reasons = cut(M.unit_reasons(t.units, t.rates, t.now, scope_of(t), P).select(*needed))
    cand = reasons.where("row_reason is null")
    found = ["match", "match_reason", "rent", "n_comps", "typical_m2", "mark_above_smaller", "mark_size_shift", "n_0", "n_1", "n_2"]
    matched = cut(M.match_units(cand, M.decisions(cand, comps, furn, P), P).select(*cand.columns, *found))
    scored = I.score(I.live_of(I.evaluate(ranked_units_from(t, cand, matched, comps), I.base_scenario(t.spark))))
    d = C.dossiers(t.units, reasons, matched, I.global_position(scored.select("unit_key", "score")))
    return d.select("unit_key", "state", "n_0", "n_1", "n_2", rnd(F.col("rent")).alias("rent"), "position", rnd(F.col("score")).alias("score"))
