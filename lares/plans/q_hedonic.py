"""Rent-model queries and their reference SQL (alternating means unrolled)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lares.functions.exprs import rnd
from lares.operators import graph
from lares.operators import hedonic as H
from lares.operators import match as M
from lares.operators import rent as R
from lares.plans.bindings import SCOPE_SQL, UNITS_SQL
from lares.plans.q_geo import GEO, NEAR_SQL, CENSUS_SQL, GEO_SQL, risk_of, RISK_SQL
from lares.plans.q_invest import rd, rs
from lares.plans.q_match import MATCH_SQL, P, UNIT_ROWS_SQL, WINDOW_SQL, decide_sql, inputs, scope_of
from lares.plans.q_rent import CELLS_SQL, COMPS, comps_and_furnished_of, comps_of
from lares.plans.registry import query, sql_with

STEPS = 14

OBS_SQL = """
elig AS MATERIALIZED (SELECT comp_id, zone, typ, m2, rent FROM comps WHERE rent > 0 AND m2 > 0 AND m2 < 51),
esz AS (SELECT zone, typ, m2, count(*) AS k FROM elig GROUP BY 1,2,3),
season AS MATERIALIZED (SELECT a.zone, a.typ, a.m2, coalesce((SELECT sum(n) FROM fsizes f WHERE f.zone=a.zone AND f.typ=a.typ AND abs(f.m2-a.m2) <= greatest(3, a.m2*0.2)+1e-9), 0) AS nf,
  (SELECT sum(k) FROM esz b WHERE b.zone=a.zone AND b.typ=a.typ AND abs(b.m2-a.m2) <= greatest(3, a.m2*0.2)+1e-9) AS pool FROM esz a),
hobs AS MATERIALIZED (SELECT e.*, ln(e.m2) AS x, ln(rent) AS y FROM elig e JOIN season USING (zone, typ, m2) WHERE NOT (nf >= 2 AND nf::DOUBLE/(nf+pool) >= 0.3)),
hcells AS MATERIALIZED (SELECT zone, typ, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy FROM hobs GROUP BY 1, 2)"""


def fit_sql(src: str, pre: str) -> str:
    """Fit of every exam in ``src`` (exam, zone, typ, n, sx, sy, sxx, sxy) by unrolled alternating means."""
    out = [f"""
{pre}ws AS MATERIALIZED (SELECT exam, typ, sum(n) AS nt, sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS wn, sum(CASE WHEN n >= 2 THEN sxx-sx*sx/n ELSE 0 END) AS wxx, sum(CASE WHEN n >= 2 THEN sxy-sx*sy/n ELSE 0 END) AS wxy FROM {src} GROUP BY 1, 2),
{pre}b AS MATERIALIZED (SELECT exam, sum(wxy)/sum(wxx) AS beta FROM {pre}ws GROUP BY 1),
{pre}bt AS MATERIALIZED (SELECT exam, typ, nt, beta, CASE WHEN raw > 0 AND raw <= 1 THEN raw ELSE beta END AS bt FROM (SELECT *, CASE WHEN wn >= 30 AND wxx > 1e-9 THEN wxy/wxx ELSE beta END AS raw FROM {pre}ws JOIN {pre}b USING (exam))),
{pre}r AS MATERIALIZED (SELECT exam, zone, typ, n, (sy-bt*sx)/n AS r FROM {src} JOIN {pre}bt USING (exam, typ)),
{pre}mu AS MATERIALIZED (SELECT exam, sum(r*n)/sum(n) AS mu FROM {pre}r GROUP BY 1),
{pre}c AS MATERIALIZED (SELECT exam, zone, typ, n, r-mu AS d FROM {pre}r JOIN {pre}mu USING (exam)),
{pre}t0 AS MATERIALIZED (SELECT exam, typ, sum(d*n)/sum(n) AS t FROM {pre}c GROUP BY 1, 2),
{pre}z0 AS MATERIALIZED (SELECT exam, zone, sum((d-t)*n)/sum(n) AS z FROM {pre}c JOIN {pre}t0 USING (exam, typ) GROUP BY 1, 2)"""]
    for i in range(1, STEPS + 1):
        out.append(f"""
{pre}a{i} AS MATERIALIZED (SELECT exam, typ, sum((d-z)*n)/sum(n) AS t, sum(n) AS nt FROM {pre}c JOIN {pre}z{i - 1} USING (exam, zone) GROUP BY 1, 2),
{pre}t{i} AS MATERIALIZED (SELECT a.exam, typ, t - sh AS t FROM {pre}a{i} a JOIN (SELECT exam, sum(t*nt)/sum(nt) AS sh FROM {pre}a{i} GROUP BY 1) s USING (exam)),
{pre}z{i} AS MATERIALIZED (SELECT exam, zone, sum((d-t)*n)/sum(n) AS z FROM {pre}c JOIN {pre}t{i} USING (exam, typ) GROUP BY 1, 2)""")
    out.append(f"""
{pre}te AS MATERIALIZED (SELECT exam, typ, bt, nt, t*nt/(nt+8) AS effect, t AS raw FROM {pre}t{STEPS} JOIN {pre}bt USING (exam, typ)),
{pre}ze AS MATERIALIZED (SELECT exam, zone, nz, z*nz/(nz+8) AS effect, z AS raw FROM {pre}z{STEPS} JOIN (SELECT exam, zone, sum(n) AS nz FROM {src} GROUP BY 1, 2) USING (exam, zone))""")
    return ",".join(out)


BASE = (*COMPS, OBS_SQL, "bcells AS MATERIALIZED (SELECT 'base' AS exam, * FROM hcells)", fit_sql("bcells", "b_"))
RES_SQL = """
hres AS MATERIALIZED (SELECT h.*, y - bt*x - mu - t.effect - z.effect AS e FROM hobs h JOIN b_te t USING (typ) JOIN b_ze z USING (zone), b_mu),
hq AS (SELECT quantile_cont(e, 0.25) AS q25, quantile_cont(e, 0.75) AS q75 FROM hres),
hadj AS (SELECT zone, typ, count(*) AS n_cell, sum(e)/(count(*)+8) AS adjust FROM hres GROUP BY 1, 2)"""


def obs_of(t):
    return H.observations(*comps_and_furnished_of(t), P)


def cells_of(t):
    from lares.session import cut
    return cut(H.cell_table(obs_of(t)))


@query("hedonic_obs", sql_with(*COMPS, OBS_SQL, final="SELECT zone, typ, count(*) AS n, round(avg(x),6)+0.0 AS mean_x, round(avg(y),6)+0.0 AS mean_y FROM hobs GROUP BY 1, 2"))
def obs_q(t):
    """Training observations per cell after the per-listing seasonal exclusion."""
    o = obs_of(t)
    return o.groupBy("zone", "typ").agg(F.sum("n").alias("n"), rnd(F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean_x"), rnd(F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("mean_y"))


@query("hedonic_beta", sql_with(*BASE, final="SELECT typ, CAST(nt AS BIGINT) AS n, round(beta,6)+0.0 AS beta, round(bt,6)+0.0 AS beta_typ FROM b_bt"))
def beta_q(t):
    """Within-cell size elasticity, global and per type."""
    types, _, s = H.train(cells_of(t), P)
    return types.select("typ", F.col("n_typ").cast("bigint").alias("n"), rnd(F.lit(s["beta"])).alias("beta"), rnd(F.col("beta")).alias("beta_typ"))


@query("hedonic_effects", sql_with(*BASE, final="""
SELECT 'typ' AS kind, typ AS name, round(raw,6)+0.0 AS raw, round(effect,6)+0.0 AS effect FROM b_te UNION ALL SELECT 'zone', zone, round(raw,6)+0.0, round(effect,6)+0.0 FROM b_ze
UNION ALL SELECT 'mu', 'mu', round(mu,6)+0.0, round(mu,6)+0.0 FROM b_mu"""))
def effects_q(t):
    """Two-way additive effects with their shrunken values, and the level."""
    types, zones, s = H.train(cells_of(t), P)
    row = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), rnd(F.col("raw")).alias("raw"), rnd(F.col("effect")).alias("effect"))
    mu = types.limit(1).select(F.lit("mu").alias("kind"), F.lit("mu").alias("name"), rnd(F.lit(s["mu"])).alias("raw"), rnd(F.lit(s["mu"])).alias("effect"))
    return row(types, "typ", "typ").unionByName(row(zones, "zone", "zone")).unionByName(mu)


@query("hedonic_residuals", sql_with(*BASE, RES_SQL, final="""
SELECT zone, typ, CAST(n_cell AS BIGINT) AS n_cell, round(adjust,6)+0.0 AS adjust, round(q25,6)+0.0 AS q25, round(q75,6)+0.0 AS q75 FROM hadj, hq"""))
def residuals_q(t):
    """Residual quartiles and the shrunken adjustment of each cell."""
    from lares.session import cut
    obs = cut(obs_of(t))
    model = H.train(cut(H.cell_table(obs)), P)
    q, adj = H.residuals(obs, model, P)
    return adj.crossJoin(F.broadcast(q)).select("zone", "typ", "n_cell", *rd(["adjust", "q25", "q75"]))


PREDICT_SQL = """
pred AS (SELECT u.unit_key, u.zone, u.typ, u.m2, u.price_uf, round(exp(mu + bt*ln(u.m2) + t.effect + z.effect + coalesce(a.adjust,0)),4) AS model_rent
  FROM units u JOIN b_te t USING (typ) JOIN b_ze z USING (zone) LEFT JOIN hadj a ON a.zone=u.zone AND a.typ=u.typ, b_mu WHERE u.m2 > 0 AND nt >= 8 AND nz >= 8)"""


@query("hedonic_predict", sql_with(*BASE, RES_SQL, UNITS_SQL, PREDICT_SQL, final="SELECT unit_key, round(model_rent,3)+0.0 AS model_rent FROM pred"))
def predict_q(t):
    """Modelled median rent of every unit the model may speak about."""
    from lares.session import cut
    obs = cut(obs_of(t))
    model = H.train(cut(H.cell_table(obs)), P)
    _, adj = H.residuals(obs, model, P)
    out = H.predict(t.units.select("unit_key", "zone", "typ", "m2"), model, adj, P).where("model_rent is not null")
    return out.select("unit_key", rnd(F.col("model_rent"), 3).alias("model_rent"))


EXAM_SQL = """
truth AS (SELECT zone, typ, count(*) AS n_own, quantile_cont(m2, 0.5) AS m2, quantile_cont(rent, 0.5) AS real FROM elig GROUP BY 1, 2),
dense AS MATERIALIZED (SELECT zone, typ, n_own, truth.m2, real FROM truth JOIN hcells USING (zone, typ) WHERE hcells.n >= 8),
rest AS (SELECT d.zone AS ez, d.typ AS et, e.* FROM dense d JOIN elig e ON e.zone = d.zone AND e.typ <> d.typ),
first8 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ez, et ORDER BY typ, m2, rent, comp_id) AS k, count(*) OVER (PARTITION BY ez, et) AS total FROM rest) WHERE total > 8 AND k <= 8),
thin_obs AS (SELECT f.*, (SELECT count(*) FROM first8 g WHERE g.ez=f.ez AND g.et=f.et AND g.typ=f.typ AND abs(g.m2-f.m2) <= greatest(3, f.m2*0.2)+1e-9) AS pool2, s.nf FROM first8 f JOIN season s ON s.zone=f.zone AND s.typ=f.typ AND s.m2=f.m2),
thin_cells AS (SELECT ez, et, typ, count(*)::DOUBLE AS n, sum(ln(m2)) AS sx, sum(ln(rent)) AS sy, sum(ln(m2)*ln(m2)) AS sxx, sum(ln(m2)*ln(rent)) AS sxy FROM thin_obs WHERE NOT (nf >= 2 AND nf::DOUBLE/(nf+pool2) >= 0.3) GROUP BY 1,2,3),
ex AS MATERIALIZED (SELECT zone||'|'||typ||'|loco' AS exam, 'loco' AS variant, * FROM dense UNION ALL SELECT zone||'|'||typ||'|thin_zone', 'thin_zone', d.* FROM dense d WHERE EXISTS (SELECT 1 FROM first8 f WHERE f.ez=d.zone AND f.et=d.typ)),
xc AS MATERIALIZED (SELECT e.exam, c.* FROM ex e JOIN hcells c ON (e.variant='loco' AND NOT (c.zone=e.zone AND c.typ=e.typ)) OR (e.variant='thin_zone' AND c.zone <> e.zone)
  UNION ALL SELECT e.exam, e.zone, t.typ, t.n, t.sx, t.sy, t.sxx, t.sxy FROM ex e JOIN thin_cells t ON t.ez=e.zone AND t.et=e.typ WHERE e.variant='thin_zone')"""
SCORED_SQL = """
done AS MATERIALIZED (SELECT e.*, CASE WHEN nt >= 8 AND nz >= 8 THEN round(exp(mu + bt*ln(e.m2) + t.effect + z.effect),4) END AS model FROM ex e LEFT JOIN x_te t ON t.exam=e.exam AND t.typ=e.typ LEFT JOIN x_ze z ON z.exam=e.exam AND z.zone=e.zone LEFT JOIN x_mu m ON m.exam=e.exam),
errs AS (SELECT *, (model-real)/real AS error FROM done)"""
LOCO = (*COMPS, OBS_SQL, EXAM_SQL, fit_sql("xc", "x_"), SCORED_SQL)


def exams_done(t):
    rows, cells = H.exams(*comps_and_furnished_of(t), P)
    return H.run_exams(rows, cells, P)


@query("hedonic_loco", sql_with(*LOCO, final="SELECT zone, typ, variant, n_own, round(real,6)+0.0 AS real, round(model,3)+0.0 AS model FROM errs"))
def loco_q(t):
    """Leave-one-cell-out back-test, with the cell's zone as it is and thinned to eight listings."""
    return exams_done(t).select("zone", "typ", "variant", "n_own", rnd(F.col("real")).alias("real"), rnd(F.col("model"), 3).alias("model"))


SUM_SQL = """
bsum AS (SELECT count(error) AS n, count(*)-count(error) AS not_predictable, quantile_cont(abs(error),0.5) AS median_abs, quantile_cont(abs(error),0.75) AS p75_abs, quantile_cont(error,0.25) AS q25b, quantile_cont(error,0.75) AS q75b FROM errs),
gate AS (SELECT *, n >= 40 AND median_abs <= 0.10 AND p75_abs <= 0.15 AS passes FROM bsum)"""


@query("backtest_summary", sql_with(*LOCO, SUM_SQL, final="SELECT n, not_predictable, round(median_abs,5)+0.0 AS median_abs, round(p75_abs,5)+0.0 AS p75_abs, round(q25b,5)+0.0 AS q25, round(q75b,5)+0.0 AS q75, passes FROM gate"))
def summary_q(t):
    """Back-test error quantiles and the publish gate."""
    s = H.backtest_summary(exams_done(t), P)
    return s.select("n", "not_predictable", *rd(["median_abs", "p75_abs", "q25", "q75"], 5), "passes")


SHRINKS = [4.0, 8.0, 16.0]


@query("shrinkage_sweep", sql_with(*LOCO, f"""
swept AS (SELECT k AS shrink, (round(exp(mu + bt*ln(e.m2) + t.raw*t.nt/(t.nt+k) + z.raw*z.nz/(z.nz+k)),4) - e.real)/e.real AS error FROM ex e, (SELECT unnest({SHRINKS})::DOUBLE AS k) LEFT JOIN x_te t ON t.exam=e.exam AND t.typ=e.typ LEFT JOIN x_ze z ON z.exam=e.exam AND z.zone=e.zone LEFT JOIN x_mu m ON m.exam=e.exam WHERE nt >= 8 AND nz >= 8)""",
    final="SELECT shrink, count(error) AS n, round(quantile_cont(abs(error),0.5),5)+0.0 AS median_abs, round(quantile_cont(abs(error),0.75),5)+0.0 AS p75_abs FROM swept GROUP BY 1"))
def sweep_q(t):
    """Back-test errors at three strengths of shrinkage, from one pass over the exams."""
    rows, cells = H.exams(*comps_and_furnished_of(t), P)
    return H.shrinkage_sweep(H.run_exams(rows, cells, P, SHRINKS)).select("shrink", "n", *rd(["median_abs", "p75_abs"], 5))


P60 = P.with_(min_comparables=60)
THIN_SQL = """
nd AS (SELECT min(unit_key) AS unit_key, zone, typ, m2, price FROM matched WHERE match_reason = 'no_comparables' AND price <= 6000 GROUP BY 2,3,4,5),
ivl AS (SELECT least(exp(q25), 1+q25b) AS low, greatest(exp(q75), 1+q75b) AS high FROM gate, hq WHERE passes),
tyd AS (SELECT list_sort(list(depth))[count(*)//2+1] AS typical FROM risk WHERE depth IS NOT NULL),
est AS (SELECT nd.*, round(exp(mu + bt*ln(nd.m2) + t.effect + z.effect + coalesce(a.adjust,0)),4) AS model_rent, low, high, k.depth, typical FROM nd JOIN b_te t USING (typ) JOIN b_ze z USING (zone) LEFT JOIN hadj a ON a.zone=nd.zone AND a.typ=nd.typ LEFT JOIN risk k ON k.zone=nd.zone, b_mu, ivl, tyd)"""


@query("thin_cell_estimates", sql_with(*LOCO, SUM_SQL, "bcells AS MATERIALIZED (SELECT 'base' AS exam, * FROM hcells)", fit_sql("bcells", "b_"), RES_SQL, CELLS_SQL, GEO_SQL, NEAR_SQL, CENSUS_SQL, RISK_SQL,
    UNITS_SQL, SCOPE_SQL, UNIT_ROWS_SQL, WINDOW_SQL, decide_sql(minn=60), MATCH_SQL, THIN_SQL, final="""
SELECT unit_key, zone, typ, m2, round(model_rent,3)+0.0 AS model_rent, round(model_rent*low,3)+0.0 AS rent_low, round(model_rent*high,3)+0.0 AS rent_high, round(model_rent*12/price,5)+0.0 AS yield_model, coalesce(depth >= typical, FALSE) AS deep_demand
FROM est ORDER BY model_rent*12/price DESC, unit_key LIMIT 12"""))
def thin_q(t):
    """Estimates for units without comparables (minimum raised to 60 on this data), gated by the back-test."""
    from lares.session import cut
    cand, comps, furn = inputs(t)
    cand, comps, furn = cut(cand), cut(comps), cut(furn)
    obs = cut(H.observations(comps, furn, P))
    model = H.train(cut(H.cell_table(obs)), P)
    q, adj = H.residuals(obs, model, P)
    rows, cells = H.exams(comps, furn, P)
    summary = H.backtest_summary(H.run_exams(rows, cells, P), P)
    nd = M.match_units(cand, M.decisions(cand, comps, furn, P60), P60).where("match_reason = 'no_comparables'")
    out = H.thin_cell_estimates(nd, model, adj, q, summary, risk_of(t).select("zone", "depth").where("depth is not null"), 12, P60)
    return out.select("unit_key", "zone", "typ", "m2", *rd(["model_rent", "rent_low", "rent_high"], 3), rnd(F.col("yield_model"), 5).alias("yield_model"), "deep_demand")


GRAPH_SQL = """
ed AS (SELECT 'a'||o_custkey AS a, 'w'||CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))//7 AS BIGINT) AS b, count(*) AS n FROM orders GROUP BY 1, 2),
nodes AS (SELECT a AS node FROM ed UNION SELECT b FROM ed),
el AS (SELECT a, b FROM ed WHERE n >= 2 UNION ALL SELECT b, a FROM ed WHERE n >= 2),
reach AS (SELECT node, node AS root FROM nodes UNION SELECT el.b, reach.root FROM reach JOIN el ON el.a = reach.node)"""


@query("cell_components", sql_with(GRAPH_SQL, final="SELECT node, min(root) AS component FROM reach GROUP BY 1", recursive=True))
def components_q(t):
    """Connected components of a bipartite graph whose edges need two rows (customers and weeks)."""
    week = F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) / 7).cast("bigint")
    ed = t("orders").groupBy(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("w"), week.cast("string")).alias("b")).agg(F.count("*").alias("n"))
    nodes = ed.select(F.col("a").alias("node")).union(ed.select("b"))
    return graph.components(nodes, ed.where("n >= 2").select("a", "b"))
