"""Ranges over sorted sizes, and order statistics of crowded values, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from lares.operators import match as M
from lares.operators import quantiles as Q
from lares.operators import ranges as R
from lares.params import DEFAULT as P

SIZE = "zone string, typ string, "


def _two_decimals(seed, n, queries):
    r = np.random.default_rng(seed)
    sizes = np.round(r.uniform(15, 139, n), 2)
    comps = [("z", "t", float(s), float(np.round(8 + s / 8 + r.normal(), 2))) for s in sizes] + [("y", "t", 40.0, float(x)) for x in range(9)]
    furn = {("z", "t", float(np.round(x, 2))): int(r.integers(1, 4)) for x in r.uniform(15, 139, n // 20)}
    asked = sorted({("z", "t", float(np.round(x, 2))) for x in r.uniform(10, 139, queries)} | {("z", "t", float(s)) for s in sizes[:20]} | {("y", "t", 40.0), ("x", "t", 30.0)})
    return comps, [(*k, v) for k, v in furn.items()], asked


def test_windows_of_two_decimal_sizes(spark):
    comps, furn, asked = _two_decimals(1, 1500, 120)
    got = M.window_stats(spark.createDataFrame(asked, SIZE + "m2u double"), spark.createDataFrame(comps, SIZE + "m2 double, rent double"), spark.createDataFrame(furn, SIZE + "m2 double, n long"))
    rows = {(r["zone"], r["m2u"]): r for r in got.collect()}
    assert len(rows) == len(asked)
    for zone, typ, m in asked:
        row, mine = rows[(zone, m)], [(s, x) for z, _, s, x in comps if z == zone]
        for i, f in enumerate(P.window_factors):
            w = max(P.window_floor_m2, f * m) + 1e-9
            inside = [(s, x) for s, x in mine if abs(s - m) <= w]
            assert row[f"n_{i}"] == len(inside)
            assert row[f"furn_{i}"] == sum(n for z, _, s, n in furn if z == zone and abs(s - m) <= w)
            if inside:
                np.testing.assert_allclose((row[f"m2_{i}"], row[f"rent_{i}"]), np.median(inside, axis=0))
            else:
                assert row[f"m2_{i}"] is None and row[f"rent_{i}"] is None
        small = [x / s for s, x in mine if s <= m * P.smaller_factor + 1e-9]
        assert row["smaller_n"] == len(small)
        assert (row["smaller_m2"] is None) == (not small) and (not small or abs(row["smaller_m2"] - np.median(small)) < 1e-9)


def test_a_range_is_a_few_nodes(spark):
    """Every range is covered exactly once, by at most two nodes a level, whatever it holds."""
    ranges = [(0, 1), (0, 0), (3, 3), (1, 2), (0, 1024), (1, 1023), (5, 12), (7, 4096), (1000, 1001), (123, 99991)]
    rows = R.nodes_of(spark.createDataFrame(ranges, "low long, high long"), "low", "high").collect()
    for a, b in ranges:
        nodes = [(r["_node"] // 64, r["_node"] % 64) for r in rows if (r["low"], r["high"]) == (a, b)]
        held = sorted(x for n, level in nodes for x in range(n << level, (n + 1) << level))
        assert held == list(range(a, b))
        assert len(nodes) <= 2 * max(b - a, 1).bit_length()


def test_crowded_values_are_split(spark):
    """A million values within one per cent, in one group, and a group far closer than that: exact, and no bucket above the bound is ranked."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("a").alias("g"), (F.lit(1000.0) + (F.col("id") * 7919 % n) / n * 10).alias("v"))
    rows = rows.union(spark.range(3000).select(F.lit("b"), F.lit(5.0) + F.col("id") * 1e-12)).union(spark.range(7).select(F.lit(None).cast("string"), F.lit(2.0)))
    seen, finish = [], Q._finish
    Q._finish = lambda rows, keys, specs: seen.append(rows.groupBy(*keys, "_b").count().agg(F.max("count")).first()[0]) or finish(rows, keys, specs)
    try:
        got = {r["g"]: r for r in Q.grouped_quantiles(rows, ["g"], F.col("v"), {"q1": 0.25, "med": 0.5, "up": Q.upper_median()}, most=500).collect()}
    finally:
        Q._finish = finish
    assert max(seen) <= 500
    v = 1000.0 + np.arange(n) / n * 10
    np.testing.assert_allclose([got["a"][c] for c in ("q1", "med", "up")], [np.quantile(v, 0.25), np.quantile(v, 0.5), v[n // 2]], rtol=1e-14)
    w = 5.0 + np.arange(3000) * 1e-12
    np.testing.assert_allclose([got["b"][c] for c in ("q1", "med", "up")], [np.quantile(w, 0.25), np.quantile(w, 0.5), w[1500]], rtol=1e-15)
    assert got[None]["med"] == 2.0 and got[None]["n_values"] == 7
