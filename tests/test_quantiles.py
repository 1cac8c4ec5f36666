import random

import numpy as np
from pyspark.sql import functions as F

from lares.operators.ordered import with_neighbour
from lares.operators.quantiles import grouped_quantiles, upper_median
from lares.operators.ranges import range_quantiles, running_sums


def test_grouped_quantiles_match_numpy_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", round(rng.gauss(0, 50), 2)) for _ in range(3000)] + [(f"g{i % 40}", float(rng.randint(-3, 3))) for i in range(1500)]
    rows += [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = {r.g: r for r in grouped_quantiles(df, ["g"], F.col("v"), {"a": 0.25, "b": 0.5, "c": 0.9, "u": upper_median()}).collect()}
    assert "none" not in out
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for g, vs in groups.items():
        vs = sorted(vs)
        assert out[g].n_values == len(vs)
        for k, p in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
            assert abs(out[g][k] - np.quantile(vs, p)) < 1e-9
        assert out[g].u == vs[len(vs) // 2]


def test_grouped_quantiles_with_null_group_and_weights(spark):
    df = spark.createDataFrame([(None, 1.0, 3), (None, 5.0, 1), ("a", 2.0, 2)], "g string, v double, w int")
    out = {r.g: r.m for r in grouped_quantiles(df, ["g"], F.col("v"), {"m": 0.5}, F.col("w")).collect()}
    assert out == {None: 1.0, "a": 2.0}


def test_windowed_quantiles_match_brute_force(spark):
    rng = random.Random(2)
    rows = [("z", float(rng.randint(20, 60)), float(rng.randint(1, 400)) / 8) for _ in range(600)]
    comps = spark.createDataFrame(rows, "g string, m double, _v double")
    freq = comps.groupBy("g", "m", "_v").agg(F.count("*").alias("_n"))
    q = spark.createDataFrame([("z", 25.0), ("z", 40.0), ("z", 58.0)], "g string, q double")
    cells = freq.groupBy("g", "m").agg(F.sum("_n").alias("n"))
    at, ordered = running_sums(cells, q, ["g"], ["q"], "m", ["n"], {"lo": (F.col("q") - 5, False), "hi": (F.col("q") + 5, True)})
    ranges = at.select("g", "q", F.col("lo.rank").alias("low"), F.col("hi.rank").alias("high"))
    found = range_quantiles(ranges, freq.join(ordered.select("g", "m", "rank"), ["g", "m"]), ["g"], ["q"], {"med": 0.5})
    out = {r.q: (r.med, r.n_values) for r in found.collect()}
    for x in (25.0, 40.0, 58.0):
        vs = [v for _, m, v in rows if abs(m - x) <= 5]
        assert out[x] == (float(np.median(vs)), len(vs))


def test_neighbour_across_chunks(spark):
    rows = [("k", float(i), i * i) for i in range(50)] + [("s", 3.0, 9)]
    df = spark.createDataFrame(rows, "k string, t double, v int").repartition(4)
    prev = with_neighbour(df, ["k"], F.floor(F.col("t") / 7), "t", F.struct("v"), "p")
    got = {(r.k, r.t): (r.p.v if r.p else None) for r in prev.collect()}
    assert all(got[("k", float(i))] == ((i - 1) ** 2 if i else None) for i in range(50)) and got[("s", 3.0)] is None
    nxt = with_neighbour(df, ["k"], F.floor(F.col("t") / 7), "t", F.struct("v"), "p", previous=False)
    got = {(r.k, r.t): (r.p.v if r.p else None) for r in nxt.collect()}
    assert all(got[("k", float(i))] == ((i + 1) ** 2 if i < 49 else None) for i in range(50))
