import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lares.operators import geo as G
from lares.operators import graph
from lares.operators import hedonic as H
from lares.params import DEFAULT


def dist(a, b, c, d):
    k = 111_320.0
    return math.hypot((a - c) * k, (b - d) * k * math.cos(math.radians((a + c) / 2)))


def test_nearest_matches_brute_force_near_and_far(spark):
    rng = random.Random(7)
    cs = [(f"z{i}", "d1" if i % 3 else "d2", -33.4 + rng.uniform(-0.2, 0.2), -70.6 + rng.uniform(-0.2, 0.2)) for i in range(60)]
    ps = [(i, ("d1", "d2", "d3")[i % 3], -33.4 + rng.uniform(-3, 3) * (i % 5 == 0) + rng.uniform(-0.2, 0.2), -70.6 + rng.uniform(-0.3, 0.3)) for i in range(200)]
    c = spark.createDataFrame(cs, "zone string, g string, clat double, clon double")
    p = spark.createDataFrame(ps, "id int, g string, lat double, lon double")
    got = {r.id: (r.zone, r.distance_m) for r in G.nearest(p, c, ["g"], ["zone"]).collect()}
    assert len(got) == 200
    for i, g, la, lo in ps:
        cand = [(dist(la, lo, x[2], x[3]), x[0]) for x in cs if x[1] == g]
        if not cand:
            assert got[i] == (None, None)
        else:
            d, z = min(cand)
            assert got[i][0] == z and abs(got[i][1] - d) < 1e-6
    capped = {r.id: r.zone for r in G.nearest_within(p, c, ["g"], ["zone"], 2500.0).collect()}
    assert any(v is None for v in capped.values()) and any(v for v in capped.values())


def test_risk_redistributes_missing_components(spark):
    census = spark.createDataFrame([("a", 10, 90, 30, 100), ("b", 0, 100, None, 50), ("c", 50, 50, 10, 100)], "zone string, vacant long, occupied long, renters long, households long")
    listings = spark.createDataFrame([("a", 15), ("c", 20)], "zone string, n long")
    got = {r.zone: r for r in G.zone_risk(census, listings).collect()}
    # b: no renters -> no saturation; depth 0 over households
    assert got["b"].saturation is None and abs(got["b"].risk - (0.5 * 0 + 0.2 * 1) / 0.7) < 1e-12
    assert abs(got["a"].risk - (0.5 * 0.2 + 0.3 * 0 + 0.2 * 0)) < 1e-12
    assert abs(got["c"].risk - (0.5 * 1 + 0.3 * 1 + 0.2 * (1 - 0.1 / 0.3))) < 1e-12


def test_station_rules(spark):
    now = F.lit(dt.date(2026, 9, 1))
    st = spark.createDataFrame([
        ("open", "metro", "l1", "open", None), ("efe", "efe", None, "open", None), ("b7", "metro", "l7", "building", None), ("far", "metro", "l7", "building", 2035),
        ("prop", "metro", "l7", "proposed", None), ("dated", "metro", "l7", "proposed", 2028), ("l9", "metro", "l9", "building", 2033), ("noline", "metro", None, "building", None)],
        "station_id string, network string, line string, status string, opening_year int").withColumn("lat", F.lit(-33.4)).withColumn("lon", F.lit(-70.6))
    lines = spark.createDataFrame([("l7", dt.date(2028, 6, 1)), ("l9", dt.date(2033, 1, 1))], "line string, opens_on date")
    got = {r.station_id: (r.state, r.factor) for r in G.eligible_stations(st, lines, now).collect()}
    assert got == {"open": ("open", 1.0), "efe": ("excluded", None), "b7": ("building", 0.7), "far": ("undated", None), "prop": ("undated", None), "dated": ("building", 0.7),
                   "l9": ("undated", None), "noline": ("undated", None)}


def test_catalyst_decay_and_best_score(spark):
    deg = 1 / 111_320.0
    z = spark.createDataFrame([("at", -33.4, -70.6), ("mid", -33.4 + 800 * deg, -70.6), ("off", -33.4 + 5000 * deg, -70.6)], "zone string, lat double, lon double")
    s = spark.createDataFrame([("a", -33.4, -70.6, 0.7), ("b", -33.4 - 300 * deg, -70.6, 1.0)], "station_id string, lat double, lon double, factor double")
    got = {r.zone: (r.distance_m, r.catalyst) for r in G.station_catalyst(z, s).collect()}
    assert got["at"][0] == 0 and got["at"][1] == 1.0  # the better score is not the nearest station
    assert abs(got["mid"][1] - 0.7 * 400 / 800) < 1e-6 and got["off"][1] == 0.0 and abs(got["off"][0] - 5000) < 1


BETA, TYPES = 0.6, {"1D1B": -0.1, "2D1B": 0.0, "2D2B": 0.1, "3D2B": 0.2}
ZONES = {f"c/z{i}": (i - 2.5) * 0.1 for i in range(6)}


def market(n=10, skip=(), noise=0.02, seed=1):
    """Known truth: log rent = -0.2 + 0.6 log m2 + type + zone + noise."""
    rng = random.Random(seed)
    rows = []
    for z, ze in ZONES.items():
        for i, (t, te) in enumerate(TYPES.items()):
            if (z, t) in skip:
                continue
            for k in range(n):
                m2 = 30.0 + 15 * i + 2 * k
                rows.append((z, t, m2, math.exp(-0.2 + BETA * math.log(m2) + te + ze + rng.gauss(0, noise)), f"{z}{t}{k}"))
    return rows


SCHEMA = "zone string, typ string, m2 double, rent double, comp_id string"
NO_FURN = "zone string, typ string, m2 double, n long"


def fit(spark, rows, furn=()):
    c, f = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(furn), NO_FURN)
    obs = H.observations(c, f)
    return obs, H.train(H.cell_table(obs))


def test_model_recovers_the_truth_and_predicts_a_missing_cell(spark):
    obs, model = fit(spark, market(skip={("c/z3", "2D2B")}))
    types, zones, s = model
    assert abs(s["beta"] - BETA) < 0.05
    # a type's own elasticity and level trade off: compare the levels at the types' typical sizes
    level = {r.typ: r.raw + r.beta * math.log(m) for r in types.collect() for t, m in zip(TYPES, (39, 54, 69, 84)) if r.typ == t}
    assert abs((level["3D2B"] - level["1D1B"]) - (0.3 + BETA * math.log(84 / 39))) < 0.05
    _, adj = H.residuals(obs, model)
    u = spark.createDataFrame([("c/z3", "2D2B", 62.0), ("c/z9", "2D2B", 62.0), ("c/z3", "9D9B", 62.0)], "zone string, typ string, m2 double")
    got = {(r.zone, r.typ): r.model_rent for r in H.predict(u, model, adj).collect()}
    # shrinking pulls effects to the mean by n/(n+8): stay within that
    assert abs(got[("c/z3", "2D2B")] / math.exp(-0.2 + BETA * math.log(62) + 0.1 + ZONES["c/z3"]) - 1) < 0.06
    assert got[("c/z9", "2D2B")] is None and got[("c/z3", "9D9B")] is None


def test_model_is_not_determined_with_little_or_flat_data(spark):
    assert fit(spark, market(n=4))[1] is None  # under the minimum of observations
    flat = [(z, t, 50.0, r, c) for z, t, m, r, c in market()]
    assert fit(spark, flat)[1] is None  # no size variation inside the cells


def test_disconnected_markets_do_not_borrow(spark):
    left = [r for r in market() if r[0] in ("c/z0", "c/z1", "c/z2") and r[1] in ("1D1B", "2D1B")]
    right = [r for r in market() if r[0] in ("c/z3", "c/z4", "c/z5") and r[1] in ("2D2B", "3D2B")]
    obs, model = fit(spark, left + right)
    _, adj = H.residuals(obs, model)
    u = spark.createDataFrame([("c/z0", "1D1B", 40.0), ("c/z0", "2D2B", 62.0)], "zone string, typ string, m2 double")
    got = {r.typ: r.model_rent for r in H.predict(u, model, adj).collect()}
    assert got["1D1B"] is not None and got["2D2B"] is None
    bridge = [("c/z0", "2D2B", 62.0, 11.0, "weak")]  # one listing does not join two markets
    obs, model = fit(spark, left + right + bridge)
    assert H.predict(u, model, H.residuals(obs, model)[1]).where("typ = '2D2B'").first().model_rent is None


def test_contaminated_sizes_do_not_train(spark):
    obs, _ = fit(spark, market(), [("c/z0", "1D1B", 34.0, 9)])
    kept = obs.where("zone = 'c/z0' and typ = '1D1B'").agg(F.min("m2")).first()[0]
    assert kept is None or kept > 40.0
    assert obs.where("zone = 'c/z1'").agg(F.sum("n")).first()[0] == 40


def naive_loco(rows, hold):
    """Reference fit by alternating means over plain lists."""
    rows = [r for r in rows if (r[0], r[1]) != hold]
    x, y = np.log([r[2] for r in rows]), np.log([r[3] for r in rows])
    cells = {}
    for i, r in enumerate(rows):
        cells.setdefault((r[0], r[1]), []).append(i)
    per = {}
    for (z, t), ix in cells.items():
        dx, dy = x[ix] - x[ix].mean(), y[ix] - y[ix].mean()
        a = per.setdefault(t, [0, 0, 0])
        a[0] += dx @ dx
        a[1] += dx @ dy
        a[2] += len(ix)
    beta = sum(a[1] for a in per.values()) / sum(a[0] for a in per.values())
    bt = {t: a[1] / a[0] if a[2] >= 30 and 0 < a[1] / a[0] <= 1 else beta for t, a in per.items()}
    r = {c: (y[ix] - bt[c[1]] * x[ix]).mean() for c, ix in cells.items()}
    n = {c: len(ix) for c, ix in cells.items()}
    mu = sum(r[c] * n[c] for c in r) / sum(n.values())
    t, z = dict.fromkeys(bt, 0.0), {c[0]: 0.0 for c in r}
    avg = lambda pick, f: sum(f(c) * n[c] for c in r if pick(c)) / sum(n[c] for c in r if pick(c))
    for _ in range(200):
        for k in t:
            t[k] = avg(lambda c: c[1] == k, lambda c: r[c] - mu - z[c[0]])
        s = sum(t[c[1]] * n[c] for c in r) / sum(n.values())
        mu += s
        t = {k: v - s for k, v in t.items()}
        for k in z:
            z[k] = avg(lambda c: c[0] == k, lambda c: r[c] - mu - t[c[1]])
        s = sum(z[c[0]] * n[c] for c in r) / sum(n.values())
        mu += s
        z = {k: v - s for k, v in z.items()}
    nt = {k: sum(n[c] for c in r if c[1] == k) for k in t}
    nz = {k: sum(n[c] for c in r if c[0] == k) for k in z}
    m2 = float(np.median([q[2] for q in market_all if (q[0], q[1]) == hold]))
    return math.exp(mu + bt[hold[1]] * math.log(m2) + t[hold[1]] * nt[hold[1]] / (nt[hold[1]] + 8) + z[hold[0]] * nz[hold[0]] / (nz[hold[0]] + 8))


market_all = market(n=12, noise=0.08, seed=11)


def test_backtest_equals_a_full_refit_per_cell(spark):
    rows, cells = H.exams(spark.createDataFrame(market_all, SCHEMA), spark.createDataFrame([], NO_FURN))
    done = H.run_exams(rows, cells).collect()
    assert len(done) == 48 and {r.state for r in done} == {"scored"}
    for r in done:
        if r.variant == "loco":
            assert abs(r.model - naive_loco(market_all, (r.zone, r.typ))) < 1e-3
    thin = [r for r in done if r.variant == "thin_zone"]
    assert len(thin) == 24 and any(abs(a.model - b.model) > 1e-6 for a in thin for b in done if b.variant == "loco" and (a.zone, a.typ) == (b.zone, b.typ))
    s = H.backtest_summary(H.run_exams(rows, cells)).first()
    assert s.n == 48 and abs(s.median_abs - np.median([abs(r.error) for r in done])) < 1e-9


def test_components_on_chains_stars_and_singles(spark):
    rng = random.Random(2)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100, 180)] + [("hub", f"s{i}") for i in range(200)] + [(f"r{rng.randint(0, 60)}", f"q{rng.randint(0, 60)}") for _ in range(40)]
    nodes = {x for e in edges for x in e} | {"alone"}
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_nearest_in_a_group_of_many_centres(spark):
    """A hundred thousand centres in one group, dense ones, far points, ties and points without a place: equal to brute force."""
    import numpy as np

    r = np.random.default_rng(5)
    n = 100_000
    lat, lon = np.round(r.uniform(-34, -33, n), 4), np.round(r.uniform(-71, -70, n), 4)
    lat[:20_000], lon[:20_000] = np.round(r.normal(-33.4, 0.003, 20_000), 6), np.round(r.normal(-70.5, 0.003, 20_000), 6)
    centres = spark.createDataFrame(list(zip(["g"] * n, [f"z{i:06d}" for i in range(n)], lat.tolist(), lon.tolist())) + [("h", "only", 60.0, 100.0)], "g string, zone string, clat double, clon double")
    pts = [(-33.4, -70.5), (-33.41, -70.49), (-33.5, -70.2), (-30.0, -70.5), (10.0, 20.0), (80.0, 170.0), (-33.9999, -70.0001), (-36.0, -69.0), (float(lat[7]), float(lon[7]))]
    pts += list(zip(r.uniform(-34.2, -32.8, 200).tolist(), r.uniform(-71.2, -69.8, 200).tolist()))
    rows = [(i, "g", a, b) for i, (a, b) in enumerate(pts)] + [(1000, "h", -33.0, -70.0), (1001, "none", -33.0, -70.0), (1002, "g", None, -70.0), (1003, None, -33.0, -70.0)]
    got = {x.id: (x.zone, x.distance_m) for x in G.nearest(spark.createDataFrame(rows, "id int, g string, lat double, lon double"), centres, ["g"], ["zone"]).collect()}
    assert len(got) == len(rows)
    for i, (a, b) in enumerate(pts):
        d = np.hypot((a - lat) * 111_320.0, (b - lon) * np.cos(np.radians((a + lat) / 2)) * 111_320.0)
        at = np.flatnonzero(d <= d.min() * (1 + 1e-13))
        assert abs(got[i][1] - d.min()) < 1e-6 and got[i][0] in {f"z{j:06d}" for j in at}
    assert got[1000][0] == "only" and [got[i] for i in (1001, 1002, 1003)] == [(None, None)] * 3
