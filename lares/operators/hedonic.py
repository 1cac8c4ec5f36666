"""Rent model for thin cells: within-cell elasticity, two-way effects, components, back-test.

The model is ``log rent = mu + beta_typ * log m2 + t_typ + z_zone``. Listings are reduced to
additive statistics per (zone, typ) cell. The alternating-means fit is carried out on the
types only: eliminating the zone effects leaves sums over zones of type-by-type products, so
one aggregation of the cell table yields everything the iteration needs (a dozen types, a
few hundred numbers). Holding a cell out changes the products of its own zone and nothing
else, so each back-test exam is the base sums minus one zone plus that zone as it would be.
No exam ever re-reads the other zones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lares.functions.exprs import size_band
from lares.operators.match import window_counts
from lares.operators.quantiles import grouped_quantiles
from lares.params import DEFAULT, Params
from lares.session import cut

STATS = ["n", "sx", "sy", "sxx", "sxy"]
#: Entries of the type-by-type matrices of the exams that are solved together.
STACK = 4_000_000


# ----------------------------------------------------------------- observations


def eligible(comps: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Counted comparables that may train: zone, typ, m2, rent, n."""
    ok = (F.col("rent") > 0) & (F.col("m2") > 0) & size_band(F.col("m2"), p.bands).isNotNull()
    return comps.where(ok).groupBy("zone", "typ", "m2", "rent").agg(F.count("*").alias("n"))


def seasonal_sizes(counted: DataFrame, furnished: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """zone, typ, m2u, n_furnished, excluded: is the narrow size window contaminated?"""
    sizes = counted.select("zone", "typ", F.col("m2").alias("m2u")).distinct()
    cells = counted.groupBy("zone", "typ", "m2").agg(F.sum("n").alias("pool")).join(furnished.select("zone", "typ", "m2", F.col("n").alias("n_furnished")), ["zone", "typ", "m2"], "full")
    at, _ = window_counts(sizes, cells, {"0": p.window_factors[0]}, ["pool", "n_furnished"], p)
    j = at.select("zone", "typ", "m2u", *[(F.col(f"hi_0.{c}") - F.col(f"lo_0.{c}")).alias(c) for c in ("pool", "n_furnished")])
    return j.withColumn("excluded", (F.col("n_furnished") >= p.seasonal_min_count)
                        & (F.col("n_furnished") / (F.col("n_furnished") + F.col("pool")) >= p.seasonal_max))


def observations(comps: DataFrame, furnished: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Counted training rows with log size ``x`` and log rent ``y``; contaminated sizes left out."""
    counted = cut(eligible(comps, p))
    bad = seasonal_sizes(counted, furnished, p).where("excluded").select("zone", "typ", F.col("m2u").alias("m2"))
    kept = counted.join(bad, ["zone", "typ", "m2"], "left_anti")
    return kept.withColumns({"x": F.ln("m2"), "y": F.ln("rent")})


def cell_table(obs: DataFrame) -> DataFrame:
    """Sufficient statistics per (zone, typ)."""
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    return obs.groupBy("zone", "typ").agg(
        F.sum(n).cast("double").alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"),
        F.sum(n * x * x).alias("sxx"), F.sum(n * x * y).alias("sxy"))


# ----------------------------------------------------------------- type-space sums


class TypeSums:
    """Sums over zones of per-zone products of type columns; additive, so zones can be swapped."""

    def __init__(self, types: list[str]):
        self.types = types
        k = len(types)
        self.at = {t: i for i, t in enumerate(types)}
        self.vec = {c: np.zeros(k) for c in ("n", "sx", "sy", "wxx", "wxy", "wn", "yz")}
        self.nn, self.nx = np.zeros((k, k)), np.zeros((k, k))  # n_t n_u / n_zone and n_t sx_u / n_zone
        self.adj = np.zeros((k, k))
        self.cells = 0.0

    @staticmethod
    def _dense(types_at: dict, cells: list[dict]) -> np.ndarray:
        m = np.zeros((5, len(types_at)))
        for c in cells:
            m[:, types_at[c["typ"]]] = [c[s] for s in STATS]
        return m

    def add_zone(self, cells: list[dict], sign: float = 1.0) -> None:
        if not cells:
            return
        n, sx, sy, sxx, sxy = m = self._dense(self.at, cells)
        total = n.sum()
        if total <= 0:
            return
        multi = n >= 2
        safe = np.where(n > 0, n, 1.0)
        v = self.vec
        v["n"] += sign * n
        v["sx"] += sign * sx
        v["sy"] += sign * sy
        v["wxx"] += sign * np.where(multi, sxx - sx * sx / safe, 0.0)
        v["wxy"] += sign * np.where(multi, sxy - sx * sy / safe, 0.0)
        v["wn"] += sign * np.where(multi, n, 0.0)
        v["yz"] += sign * n * (sy.sum() / total)
        self.nn += sign * np.outer(n, n) / total
        self.nx += sign * np.outer(n, sx) / total
        self.adj += sign * np.outer(multi, multi)
        self.cells += sign * (n > 0).sum()

    def copy(self) -> "TypeSums":
        o = TypeSums(self.types)
        o.vec = {c: a.copy() for c, a in self.vec.items()}
        o.nn, o.nx, o.adj, o.cells = self.nn.copy(), self.nx.copy(), self.adj.copy(), self.cells
        return o

    def fit(self, p: Params = DEFAULT) -> dict | None:
        """Elasticities, level and centred type effects; None when the model is not determined."""
        v, n = self.vec, np.round(self.vec["n"], 6)
        live = n > 0
        total = n.sum()
        if total < p.hedonic_min_obs or self.cells < p.hedonic_min_cells:
            return None
        wxx, wxy = v["wxx"].sum(), v["wxy"].sum()
        if wxx <= 1e-9:
            return None
        beta = wxy / wxx
        if not 0 < beta <= 1:
            return None
        own = (v["wn"] >= p.hedonic_min_obs_typ - 1e-6) & (v["wxx"] > 1e-9)
        bt = np.where(own, v["wxy"] / np.where(own, v["wxx"], 1.0), beta)
        bt = np.where((bt > 0) & (bt <= 1), bt, beta)
        nt = np.where(live, n, 1.0)
        mean_t = (v["sy"] - bt * v["sx"]) / nt
        zone_part = (v["yz"] - self.nx @ bt) / nt  # mean over the type's listings of its zones' means
        mu0 = float((v["sy"] - bt * v["sx"]).sum() / total)
        t = np.where(live, mean_t - mu0, 0.0)
        t = np.where(live, t - (t * n).sum() / total, 0.0)
        done = False
        steps = 1
        for steps in range(2, p.hedonic_max_iter + 1):
            new = np.where(live, mean_t - zone_part + (self.nn @ t) / nt, 0.0)
            new = np.where(live, new - (new * n).sum() / total, 0.0)
            change = float(np.abs(new - t).max())
            t = new
            if change < p.hedonic_tol:
                done = True
                break
        if not done:
            return None
        return {"beta": beta, "beta_typ": bt, "n_typ": n, "t": t, "mu": mu0, "total": total, "steps": steps}

    def components(self) -> np.ndarray:
        """Component label of each type; types are linked through a zone where both hold two rows."""
        k = len(self.types)
        link = np.round(self.adj) > 0
        label = np.arange(k)
        for _ in range(k):
            spread = np.array([label[link[i]].min() if link[i].any() else label[i] for i in range(k)])
            new = np.minimum(label, spread)
            if (new == label).all():
                break
            label = new
        return label


def type_sums(cells: DataFrame) -> TypeSums:
    """Collects only type-by-type sums (the number of types squared, an enumeration), never cells."""
    s = TypeSums([r.typ for r in cells.select("typ").distinct().orderBy("typ").collect()])
    zone = cells.groupBy("zone").agg(F.sum("n").alias("nz"), F.sum("sy").alias("syz"))
    c = cells.join(zone, "zone")
    multi, n = F.col("n") >= 2, F.col("n")
    within = lambda a: F.sum(F.when(multi, a).otherwise(0.0))
    for r in c.groupBy("typ").agg(
            F.sum(n).alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"),
            within(F.col("sxx") - F.col("sx") * F.col("sx") / n).alias("wxx"), within(F.col("sxy") - F.col("sx") * F.col("sy") / n).alias("wxy"),
            within(n).alias("wn"), F.sum(n * F.col("syz") / F.col("nz")).alias("yz"), F.count("*").alias("cells")).collect():
        i = s.at[r.typ]
        for k in s.vec:
            s.vec[k][i] = r[k]
        s.cells += r.cells
    a = c.select("zone", "nz", F.col("typ").alias("ta"), F.col("n").alias("na"))
    b = cells.select("zone", F.col("typ").alias("tb"), F.col("n").alias("nb"), F.col("sx").alias("sxb"))
    for r in a.join(b, "zone").groupBy("ta", "tb").agg(
            F.sum(F.col("na") * F.col("nb") / F.col("nz")).alias("nn"), F.sum(F.col("na") * F.col("sxb") / F.col("nz")).alias("nx"),
            F.sum(((F.col("na") >= 2) & (F.col("nb") >= 2)).cast("double")).alias("adj")).collect():
        i, j = s.at[r.ta], s.at[r.tb]
        s.nn[i, j], s.nx[i, j], s.adj[i, j] = r.nn, r.nx, r.adj
    return s


# ----------------------------------------------------------------- trained model as tables


def train(cells: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame, dict] | None:
    """(type table, zone table, scalars) or None when the model is not determined.

    type: typ, beta, effect (shrunk), raw, n_typ, comp. zone: zone, effect (shrunk), n_zone, comp.
    """
    spark = cells.sparkSession
    sums = type_sums(cells)
    fit = sums.fit(p)
    if fit is None:
        return None
    comp = sums.components()
    k = p.hedonic_shrink
    types = spark.createDataFrame(
        [(t, float(fit["beta_typ"][i]), float(fit["t"][i] * fit["n_typ"][i] / (fit["n_typ"][i] + k)), float(fit["t"][i]),
          float(fit["n_typ"][i]), int(comp[i])) for i, t in enumerate(sums.types)],
        "typ string, beta double, effect double, raw double, n_typ double, comp int")
    j = cells.join(types, "typ")  # a row per type; the optimizer broadcasts it while it is small
    r = (F.col("sy") - F.col("beta") * F.col("sx")) - F.col("n") * (F.lit(fit["mu"]) + F.col("raw"))
    z = j.groupBy("zone").agg(F.sum("n").alias("n_zone"), (F.sum(r) / F.sum("n")).alias("raw"), F.min(F.when(F.col("n") >= 2, F.col("comp"))).alias("comp"))
    z = cut(z)
    anchor = z.agg((F.sum(F.col("raw") * F.col("n_zone")) / F.sum("n_zone")).alias("a")).first().a
    z = z.withColumn("raw", F.col("raw") - anchor)
    zones = z.withColumn("effect", F.col("raw") * F.col("n_zone") / (F.col("n_zone") + k))
    scalars = {"mu": fit["mu"] + anchor, "beta": fit["beta"], "n_obs": fit["total"], "n_cells": sums.cells, "steps": fit["steps"]}
    return types, zones, scalars


def residuals(obs: DataFrame, model, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(q25, q75 of the training residuals as one row, shrunken adjustment per observed cell)."""
    types, zones, s = model
    e = obs.join(types.select("typ", "beta", F.col("effect").alias("_t")), "typ").join(
        zones.select("zone", F.col("effect").alias("_z")), "zone")
    e = e.withColumn("e", F.col("y") - F.col("beta") * F.col("x") - F.lit(s["mu"]) - F.col("_t") - F.col("_z"))
    q = grouped_quantiles(e.withColumn("_all", F.lit(1)), ["_all"], F.col("e"), {"q25": 0.25, "q75": 0.75}, F.col("n")).drop("_all", "n_values")
    k = p.hedonic_shrink
    adj = e.groupBy("zone", "typ").agg(F.sum("n").alias("n_cell"), F.sum(F.col("e") * F.col("n")).alias("_s")).withColumn(
        "adjust", F.col("_s") / (F.col("n_cell") + k)).drop("_s")
    return q, adj


def predict(units: DataFrame, model, adjust: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Modelled median rent per unit (zone, typ, m2), NULL where the model must not speak."""
    types, zones, s = model
    j = (
        units.join(F.broadcast(types.select("typ", "beta", F.col("effect").alias("_t"), "n_typ", F.col("comp").alias("_ct"))), "typ", "left")
        .join(zones.select("zone", F.col("effect").alias("_z"), "n_zone", F.col("comp").alias("_cz")), "zone", "left")
        .join(adjust.select("zone", "typ", "adjust", "n_cell"), ["zone", "typ"], "left"))
    y = F.lit(s["mu"]) + F.col("beta") * F.ln("m2") + F.col("_t") + F.col("_z") + F.coalesce("adjust", F.lit(0.0))
    ok = (F.col("m2") > 0) & (F.col("n_typ") >= p.hedonic_min_support) & (F.col("n_zone") >= p.hedonic_min_support) & (F.col("_ct") == F.col("_cz"))
    return j.withColumn("model_rent", F.when(ok, F.round(F.exp(y), 4))).drop("_t", "_z", "_ct", "_cz", "beta", "adjust")


# ----------------------------------------------------------------- back-test

_CELLS = "array<struct<typ:string,n:double,sx:double,sy:double,sxx:double,sxy:double>>"


def _zone_arrays(cells: DataFrame) -> DataFrame:
    return cells.groupBy("zone").agg(F.collect_list(F.struct("typ", *STATS)).alias("cells"))


def exams(comps: DataFrame, furnished: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(exam rows, cell table). One exam holds a dense cell out; the second also thins its zone.

    Each row carries its zone's cells as trained and as they would be: at most one entry per
    type, so a row stays small whatever the number of listings.
    """
    counted = cut(eligible(comps, p))
    season = cut(seasonal_sizes(counted, furnished, p))
    bad = season.where("excluded").select("zone", "typ", F.col("m2u").alias("m2"))
    obs = counted.join(bad, ["zone", "typ", "m2"], "left_anti").withColumns({"x": F.ln("m2"), "y": F.ln("rent")})
    cells = cut(cell_table(obs))
    measures = counted.select("zone", "typ", "n", F.explode(F.array(
        F.struct(F.lit("m2").alias("what"), F.col("m2").alias("v")), F.struct(F.lit("rent").alias("what"), F.col("rent").alias("v")))).alias("x")
    ).select("zone", "typ", "n", "x.*")
    q = grouped_quantiles(measures, ["zone", "typ", "what"], F.col("v"), {"med": 0.5}, F.col("n"))
    truth = q.groupBy("zone", "typ").agg(
        F.max(F.when(F.col("what") == "m2", F.col("med"))).alias("m2"), F.max(F.when(F.col("what") == "rent", F.col("med"))).alias("real"),
        F.max("n_values").alias("n_own"))
    dense = cells.where(F.col("n") >= p.min_comparables).select("zone", "typ").join(truth, ["zone", "typ"])
    arrays = _zone_arrays(cells)
    loco = dense.join(arrays, "zone").select(
        "zone", "typ", F.lit("loco").alias("variant"), "m2", "real", "n_own", "cells",
        F.filter("cells", lambda c: c["typ"] != F.col("typ")).alias("trained"))

    # thinned zone: its first eight remaining listings by (type, size, rent)
    keep = p.hedonic_min_support
    expand = counted.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(keep)).cast("int"))))
    head = expand.withColumn("_r", F.row_number().over(Window.partitionBy("zone", "typ").orderBy("m2", "rent", "_i"))).where(F.col("_r") <= keep)
    per_cell = counted.groupBy("zone", "typ").agg(F.sum("n").alias("nc"))
    per_zone = per_cell.groupBy("zone").agg(F.sum("nc").alias("nz"))
    big = dense.join(per_cell, ["zone", "typ"]).join(per_zone, "zone").where(F.col("nz") - F.col("nc") > keep)
    h = head.select("zone", F.col("typ").alias("htyp"), F.col("m2").alias("hm2"), F.col("rent").alias("hrent"), "_r")
    first = big.select("zone", "typ").join(h, "zone").where(F.col("htyp") != F.col("typ"))
    w = Window.partitionBy("zone", "typ").orderBy("htyp", "hm2", "hrent", "_r")
    first = first.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep)
    # contamination is judged against the thinned pool (at most eight rows per exam)
    f8 = first.join(season.select("zone", F.col("typ").alias("htyp"), F.col("m2u").alias("hm2"), "n_furnished"), ["zone", "htyp", "hm2"], "left").fillna({"n_furnished": 0})
    pool = F.struct("htyp", "hm2")
    per_exam = f8.groupBy("zone", "typ").agg(F.collect_list(pool).alias("pool"))
    f8 = f8.join(per_exam, ["zone", "typ"])
    reach = F.greatest(F.lit(p.window_floor_m2), F.col("hm2") * p.window_factors[0]) + 1e-9
    k = F.size(F.filter("pool", lambda r: (r["htyp"] == F.col("htyp")) & (F.abs(r["hm2"] - F.col("hm2")) <= reach)))
    dirty = (F.col("n_furnished") >= p.seasonal_min_count) & (F.col("n_furnished") / (F.col("n_furnished") + k) >= p.seasonal_max)
    x, y = F.ln("hm2"), F.ln("hrent")
    thin_cells = f8.where(~dirty).groupBy("zone", "typ", "htyp").agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    thin = thin_cells.groupBy("zone", "typ").agg(F.collect_list(F.struct(F.col("htyp").alias("typ"), *STATS)).alias("trained"))
    small = (
        big.select("zone", "typ", "m2", "real", "n_own").join(arrays, "zone").join(thin, ["zone", "typ"], "left")
        .select("zone", "typ", F.lit("thin_zone").alias("variant"), "m2", "real", "n_own", "cells",
                F.coalesce("trained", F.array().cast(_CELLS)).alias("trained")))
    return loco.unionByName(small), cells


class ExamStack:
    """Type sums of many exams at once: a row per exam, each the base with one zone taken out and put back as trained."""

    def __init__(self, base: TypeSums, out: np.ndarray, back: np.ndarray):
        """``out``, ``back``: [exam][statistic][type] of the zone as it is and as trained."""
        gone, new = self._zone(out), self._zone(back)
        self.v = {c: base.vec[c] - gone[0][c] + new[0][c] for c in base.vec}
        self.nn, self.nx, self.adj = (b - g + a for b, g, a in zip((base.nn, base.nx, base.adj), gone[1:4], new[1:4], strict=True))
        self.cells = base.cells - gone[4] + new[4]
        self.back = back

    @staticmethod
    def _zone(m: np.ndarray):
        n, sx, sy, sxx, sxy = (m[:, i] for i in range(5))
        total = n.sum(axis=1)
        safe_total = np.where(total > 0, total, 1.0)[:, None]
        multi, safe = n >= 2, np.where(n > 0, n, 1.0)
        vec = {"n": n, "sx": sx, "sy": sy, "wxx": np.where(multi, sxx - sx * sx / safe, 0.0), "wxy": np.where(multi, sxy - sx * sy / safe, 0.0),
               "wn": np.where(multi, n, 0.0), "yz": n * (sy.sum(axis=1)[:, None] / safe_total)}
        outer = lambda a, b: a[:, :, None] * b[:, None, :]
        return vec, outer(n, n) / safe_total[:, :, None], outer(n, sx) / safe_total[:, :, None], outer(multi, multi).astype(float), (n > 0).sum(axis=1)

    def fit(self, p: Params) -> dict:
        """The fits of all exams, ``ok`` where the model is determined. Each stops at its own step, as if it were alone."""
        v, n = self.v, np.round(self.v["n"], 6)
        live, total = n > 0, n.sum(axis=1)
        wxx, wxy = v["wxx"].sum(axis=1), v["wxy"].sum(axis=1)
        beta = wxy / np.where(wxx > 1e-9, wxx, 1.0)
        ok = (total >= p.hedonic_min_obs) & (self.cells >= p.hedonic_min_cells) & (wxx > 1e-9) & (beta > 0) & (beta <= 1)
        own = (v["wn"] >= p.hedonic_min_obs_typ - 1e-6) & (v["wxx"] > 1e-9)
        bt = np.where(own, v["wxy"] / np.where(own, v["wxx"], 1.0), beta[:, None])
        bt = np.where((bt > 0) & (bt <= 1), bt, beta[:, None])
        nt, safe_total = np.where(live, n, 1.0), np.where(total > 0, total, 1.0)
        mean_t = (v["sy"] - bt * v["sx"]) / nt
        zone_part = (v["yz"] - np.einsum("etu,eu->et", self.nx, bt)) / nt
        mu = (v["sy"] - bt * v["sx"]).sum(axis=1) / safe_total
        centred = lambda t, at: np.where(live[at], t - ((t * n[at]).sum(axis=1) / safe_total[at])[:, None], 0.0)
        t = centred(np.where(live, mean_t - mu[:, None], 0.0), slice(None))
        going = np.flatnonzero(ok)
        for _ in range(2, p.hedonic_max_iter + 1):
            if not len(going):
                break
            new = centred(np.where(live[going], mean_t[going] - zone_part[going] + np.einsum("etu,eu->et", self.nn[going], t[going]) / nt[going], 0.0), going)
            change = np.abs(new - t[going]).max(axis=1)
            t[going] = new
            going = going[change >= p.hedonic_tol]
        ok[going] = False
        return {"ok": ok, "bt": bt, "t": t, "mu": mu, "n": n}

    def linked(self, typ: np.ndarray) -> np.ndarray:
        """Is the exam's type in one component with a type of which its trained zone holds two rows?"""
        link = np.round(self.adj) > 0
        at = np.arange(len(typ))
        reach = np.zeros(link.shape[:2], bool)
        reach[at, typ] = True
        for _ in range(link.shape[1]):
            more = reach | np.einsum("et,etu->eu", reach.astype(float), link.astype(float)).astype(bool)
            if (more == reach).all():
                break
            reach = more
        return (reach & (self.back[:, 0] >= 2)).any(axis=1)

    def models(self, typ: np.ndarray, m2: np.ndarray, shrinks: list[float], p: Params) -> tuple[np.ndarray, np.ndarray]:
        """([exam][shrinkage] rents, states)."""
        f, at = self.fit(p), np.arange(len(typ))
        n, sx, sy = (self.back[:, i] for i in range(3))
        n_typ, n_zone = f["n"][at, typ], n.sum(axis=1)
        can = (n_typ >= p.hedonic_min_support) & (n_zone >= p.hedonic_min_support) & self.linked(typ)
        z = (sy - f["bt"] * sx - n * (f["mu"][:, None] + f["t"])).sum(axis=1) / np.where(n_zone > 0, n_zone, 1.0)
        level, effect = f["mu"] + f["bt"][at, typ] * np.log(m2), f["t"][at, typ]
        y = np.stack([level + effect * n_typ / (n_typ + k) + z * n_zone / (n_zone + k) for k in shrinks], axis=1)
        state = np.where(~f["ok"], "no_model", np.where(can, "scored", "not_predictable"))
        return np.where((state == "scored")[:, None], np.round(np.exp(np.where((state == "scored")[:, None], y, 0.0)), 4), np.nan), state


def run_exams(rows: DataFrame, cells: DataFrame, p: Params = DEFAULT, shrinks: list[float] | None = None) -> DataFrame:
    """zone, typ, variant, n_own, real, model, state, error; every exam is reported, none dropped.

    The exams of a batch are solved as one stack of matrices. With ``shrinks`` each exam is a row per
    shrinkage (column ``shrink``): the fit doesn't depend on it, so a sweep costs one pass.
    """
    base, ks = type_sums(cells), shrinks or [p.hedonic_shrink]
    some = max(1, STACK // max(1, len(base.types)) ** 2)

    def dense(column: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(column), len(STATS), len(base.types)))
        v = column.flatten()
        row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        at = np.array([base.at[t] for t in v.field("typ").to_pylist()], np.int64)
        for i, c in enumerate(STATS):
            out[row, i, at] = v.field(c).to_numpy(zero_copy_only=False)
        return out

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, some):
                b = whole.slice(start, some)
                col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
                stack = ExamStack(base, dense(col["cells"]), dense(col["trained"]))
                model, state = stack.models(np.array([base.at[t] for t in col["typ"].to_pylist()], np.int64), col["m2"].to_numpy(zero_copy_only=False).astype(float), ks, p)
                for j, k in enumerate(ks):
                    yield pa.RecordBatch.from_arrays([*(col[c] for c in ("zone", "typ", "variant", "n_own", "real")), pa.array(model[:, j], from_pandas=True), pa.array(state.tolist(), pa.string()), pa.array(np.full(b.num_rows, float(k)))],
                                                     names=["zone", "typ", "variant", "n_own", "real", "model", "state", "shrink"])

    schema = "zone string, typ string, variant string, n_own long, real double, model double, state string, shrink double"
    done = rows.repartition("zone", "typ", "variant").mapInArrow(solve, schema)
    done = done.withColumn("error", (F.col("model") - F.col("real")) / F.col("real"))
    return done if shrinks else done.drop("shrink")


def shrinkage_sweep(done: DataFrame) -> DataFrame:
    """Per shrinkage: exams with a model, median and upper quartile of the absolute error."""
    n = done.groupBy("shrink").agg(F.count("error").alias("n"))
    q = grouped_quantiles(done, ["shrink"], F.abs("error"), {"median_abs": 0.5, "p75_abs": 0.75}).drop("n_values")
    return n.join(q, "shrink", "left")


def backtest_summary(done: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row: counts, median and p75 of |error|, signed quartiles, and the publish gate."""
    one = done.withColumn("_all", F.lit(1))
    counts = one.groupBy("_all").agg(F.count_if(F.col("state") == "scored").alias("n"), F.count_if(F.col("state") == "not_predictable").alias("not_predictable"),
                                     F.count_if(F.col("state") == "no_model").alias("no_model"))
    a = grouped_quantiles(one, ["_all"], F.abs("error"), {"median_abs": 0.5, "p75_abs": 0.75}).drop("n_values")
    b = grouped_quantiles(one, ["_all"], F.col("error"), {"q25": 0.25, "q75": 0.75}).drop("n_values")
    out = counts.join(a, "_all", "left").join(b, "_all", "left").drop("_all")
    ok = (F.col("n") >= p.backtest_min_cells) & (F.col("median_abs") <= p.backtest_median_max) & (F.col("p75_abs") <= p.backtest_p75_max)
    return out.withColumn("passes", F.coalesce(ok, F.lit(False)))


def thin_cell_estimates(units: DataFrame, model, adjust: DataFrame, residual_q: DataFrame, summary: DataFrame, depth: DataFrame,
                        top: int = 12, p: Params = DEFAULT) -> DataFrame:
    """Estimates for units without comparables; empty unless the back-test passes.

    ``units``: unit_key, zone, typ, m2, price. The published interval is the wider of the
    training residuals and the out-of-sample errors. ``depth``: zone, depth.
    """
    from lares.operators.quantiles import upper_median
    u = units.where(F.col("price") <= p.price_max_uf)
    u = u.groupBy("zone", "typ", "m2", "price").agg(F.min("unit_key").alias("unit_key"))
    pr = predict(u, model, adjust, p).where("model_rent is not null")
    gate = summary.where("passes").select(F.col("q25").alias("_b25"), F.col("q75").alias("_b75")).crossJoin(residual_q)
    gate = gate.select(F.least(F.exp("q25"), 1 + F.col("_b25")).alias("low"), F.greatest(F.exp("q75"), 1 + F.col("_b75")).alias("high"))
    typical = grouped_quantiles(depth.withColumn("_a", F.lit(1)), ["_a"], F.col("depth"), {"typical_depth": upper_median()}).select("typical_depth")
    # one-row tables: the gate and the typical depth
    out = pr.crossJoin(F.broadcast(gate)).crossJoin(F.broadcast(typical)).join(depth.select("zone", "depth"), "zone", "left")
    out = out.withColumns({
        "rent_low": F.col("model_rent") * F.col("low"), "rent_high": F.col("model_rent") * F.col("high"),
        "yield_model": F.col("model_rent") * 12 / F.col("price"),
        "deep_demand": F.coalesce(F.col("depth") >= F.col("typical_depth"), F.lit(False))})
    return out.orderBy(F.desc("yield_model"), "unit_key").limit(top)
