import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from lares.operators import compare as C
from lares.operators import quality as Q
from lares.operators import versions as V

T0 = dt.datetime(2026, 5, 4)
CAP = "unit_key string, captured timestamp_ntz, price_uf double, price_clp double, event_id long, surface string, m2 double, age_years int"


def caps(spark, rows):
    full = [(u, T0 + dt.timedelta(days=d), uf, clp, i, s, None, None) for i, (u, d, uf, clp, s) in enumerate(rows)]
    return spark.createDataFrame(full, CAP)


def table(v):
    return sorted((r.unit_key, (r.valid_from - T0).days, (r.valid_to - T0).days if r.valid_to else None, (r.fetched_at - T0).days, r.price_uf, r.price_clp) for r in v.collect())


def test_price_return_makes_three_versions_in_any_order(spark):
    rows = [("u", 0, 100.0, None, "card"), ("u", 3, 100.0, None, "card"), ("u", 5, 90.0, None, "card"), ("u", 9, 100.0, None, "card"), ("u", 12, 100.0, None, "card")]
    want = [("u", 0, 5, 3, 100.0, None), ("u", 5, 9, 5, 90.0, None), ("u", 9, None, 12, 100.0, None)]
    for perm in itertools.islice(itertools.permutations(rows), 0, 120, 29):
        assert table(V.versions(V.one_per_instant(caps(spark, perm)))) == want
    assert V.overlaps(V.versions(caps(spark, rows))).count() == 0


def test_currency_change_is_a_change_and_nulls_are_equal(spark):
    rows = [("u", 0, 100.0, None, "card"), ("u", 1, None, 5.0, "card"), ("u", 2, None, 5.0, "card"), ("w", 0, None, None, "card"), ("w", 4, None, None, "card")]
    assert table(V.versions(caps(spark, rows))) == [("u", 0, 1, 0, 100.0, None), ("u", 1, None, 2, None, 5.0), ("w", 0, None, 4, None, None)]


def test_late_captures_give_the_same_table(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randint(0, 5)}", d, float(rng.randint(1, 2)), None, "card") for d in range(0, 60)]
    full = table(V.versions(V.one_per_instant(caps(spark, rows))))
    shuffled = list(rows)
    rng.shuffle(shuffled)
    early, newer = [r for r in rows if r[1] < 30], [r for r in rows if r[1] >= 30]
    odd, even = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]  # late captures fall inside known versions
    for known, late in ((newer, early), (early, newer), (odd, even), (shuffled[:20], shuffled[20:]), (rows, early)):
        assert table(V.merge_late(V.versions(caps(spark, known)), caps(spark, known), caps(spark, late))) == full


def test_interior_late_capture_splits_its_version(spark):
    known = [("u", 0, 100.0, None, "card"), ("u", 3, 100.0, None, "card"), ("u", 7, 100.0, None, "card"), ("u", 10, 90.0, None, "card")]
    got = table(V.merge_late(V.versions(caps(spark, known)), caps(spark, known), caps(spark, [("u", 5, 95.0, None, "card")])))
    assert got == [("u", 0, 5, 3, 100.0, None), ("u", 5, 7, 5, 95.0, None), ("u", 7, 10, 7, 100.0, None), ("u", 10, None, 10, 90.0, None)]


def test_other_surface_never_opens_a_version(spark):
    rows = [(u, T0 + dt.timedelta(days=d), p, None, i, s, m, a) for i, (u, d, p, s, m, a) in enumerate([
        ("u", 0, 100.0, "card", None, None), ("u", 0, 120.0, "detail", 55.0, 9), ("u", 4, 100.0, "card", 50.0, None), ("w", 1, 80.0, "detail", 40.0, 3)])]
    out = V.canonical_versions(spark.createDataFrame(rows, CAP)).collect()
    got = {r.unit_key: (r.price_uf, r.m2, r.age_years) for r in out}
    assert len(out) == 2 and got == {"u": (100.0, 50.0, 9), "w": (80.0, 40.0, 3)}


def test_hot_unit_matches_plain_lag(spark):
    rng = random.Random(9)
    rows = [("hot", d / 24, float(rng.randint(1, 3)), None, "card") for d in range(2000)]
    full = [(u, T0 + dt.timedelta(days=d), uf, c, i, s, None, None) for i, (u, d, uf, c, s) in enumerate(rows)]
    n = 1 + sum(1 for a, b in zip(rows, rows[1:]) if a[2] != b[2])
    v = V.versions(spark.createDataFrame(full, CAP).repartition(6))
    assert v.count() == n and v.where("valid_to is null").count() == 1


def test_delta_counts(spark):
    rows = [("gone", 0, 10.0, None, "card"), ("same", 0, 10.0, None, "card"), ("same", 20, 10.0, None, "card"), ("drop", 0, 10.0, None, "card"), ("drop", 20, 8.0, None, "card"),
            ("new", 20, 5.0, None, "card"), ("far", 0, 5.0, None, "card"), ("clp", 0, None, 100.0, "card"), ("clp", 20, None, 90.0, "card")]
    v = V.versions(caps(spark, rows)).withColumn("zone", F.when(F.col("unit_key") == "far", "z2").otherwise("z1"))
    rates = spark.createDataFrame([(T0.date(), 10.0)], "day date, rate double")
    d = V.market_delta(v, rates, F.lit(T0 + dt.timedelta(days=10)).cast("timestamp_ntz")).first()
    assert (d.gone, d.out_of_scope, d.unchanged, d.dropped, d.raised, d.not_convertible, d.new_units, d.previous_captures, d.zones_visited) == (1, 1, 1, 1, 0, 1, 1, 1, 1)


def test_permanence_ignores_ambiguous_and_repeated_sightings(spark):
    d0, d1 = dt.date(2026, 5, 4), dt.date(2026, 8, 29)
    rows = [(d, i, "z", f"t{i}", 50.0) for i in range(10) for d in (d0, d0 + dt.timedelta(days=1))]  # seen on two days of one campaign
    rows += [(d1, 100 + i, "z", f"t{i}", 50.0) for i in range(4)] + [(d1, 200 + i, "z", f"n{i}", 50.0) for i in range(5)]
    rows += [(d0, 300, "z", "generic", 40.0), (d0, 301, "z", "generic", 40.0), (d1, 302, "z", "generic", 40.0)]
    r = V.permanence(spark.createDataFrame(rows, "day date, listing_id long, zone string, title string, m2 double")).first()
    assert (r.before, r.now, r.remain, r.share) == (10, 10, 4, 0.4)


def test_sinks(spark):
    s = "k string, v double, t int"
    a, b = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 5)], s), spark.createDataFrame([("a", 9.0, 2), ("b", 8.0, 3), ("c", 7.0, 1)], s)
    assert sorted((r.k, r.v) for r in V.upsert_last(a, b, ["k"], ["t"]).collect()) == [("a", 9.0), ("b", 2.0), ("c", 7.0)]
    assert sorted((r.k, r.v) for r in V.fill_gaps(a, b, ["k"]).collect()) == [("a", 1.0), ("b", 2.0), ("c", 7.0)]
    assert sorted((r.k, r.v) for r in V.insert_absent(a, b, ["k"]).collect()) == [("a", 1.0), ("b", 2.0), ("c", 7.0)]


def test_duplicate_pairs_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"a{rng.randint(0, 3)}", dt.date(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 90))) for _ in range(120)] + [("a0", None), (None, dt.date(2026, 1, 1))]
    got = {r.k: r.pairs for r in Q.duplicates_within(spark.createDataFrame(rows, "k string, d date"), ["k"], "d").collect()}
    want = {}
    for (ka, da), (kb, db) in itertools.combinations(rows, 2):
        if ka and ka == kb and da and db and abs((da - db).days) <= 30:
            want[ka] = want.get(ka, 0) + 1
    assert got == want


def test_overlapping_searches_match_brute_force(spark):
    rng = random.Random(6)
    sets = {f"s{i}": {rng.randint(0, 25) for _ in range(rng.randint(1, 12))} | {99} for i in range(25)}  # id 99 is in every search
    rows = [(s, i) for s, ids in sets.items() for i in ids]
    got = {(r.a, r.b, r.common, r.smaller) for r in Q.overlapping_searches(spark.createDataFrame(rows, "search string, id int")).collect()}
    want = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        c, m = len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))
        if c >= m * 0.5:
            want.add((a, b, c, m))
    assert got == want


def test_promo_cluster_found_and_legitimate_repeats_kept(spark):
    rows = [(f"p{i}", "z", 25.0 + i % 3, 150000.0, 150000 / 40000 / (25.0 + i % 3)) for i in range(10)] + [(f"n{i}", "z", 24.0 + i % 4, 260000.0 + 1000 * i, (260000 + 1000 * i) / 40000 / (24.0 + i % 4)) for i in range(8)]
    rows += [(f"m{i}", "z", 60.0, 500000.0, 500000 / 40000 / 60.0) for i in range(4)]  # no peers of its size: abstain
    d = spark.createDataFrame(rows, "key string, zone string, m2 double, rent_clp double, per_m2 double")
    got = {(r.rent_clp, r.flagged) for r in Q.promo_clusters(d).collect()}
    assert got == {(150000.0, True)}


def test_fence_has_a_floor_and_needs_three(spark):
    d = spark.createDataFrame([("z", 26.0)] * 10 + [("z", 27.0), ("z", 40.0), ("w", 1.0), ("w", 900.0)], "zone string, v double")
    assert sorted(r.v for r in Q.outside_fence(d, "zone", "v").collect()) == [40.0]


def test_gates(spark):
    docs = spark.createDataFrame([(1, "ok", "a@b.cl"), (2, "rut 12.345.678-5", None)], "id int, a string, b string")
    assert {(r.id, r["column"], r.kind) for r in Q.pii_rows(docs, "id").collect()} == {(1, "b", "email"), (2, "a", "tax_id")}
    f = Q.gate_status([Q.pii_check(docs, "id"), Q.coverage_check(spark.createDataFrame([], "price_uf double, zone string, evidence string"))]).first()
    assert f.status == "RED" and f.n_fail == 1 and f.n_alert == 1


def test_run_drop_compares_with_last_successful_run(spark):
    d = dt.date(2026, 1, 1)
    runs = [("s", d + dt.timedelta(days=i), n, ok) for i, (n, ok) in enumerate([(100, True), (10, False), (95, True), (60, True)])]
    got = [(r["previous"], r.alarm) for r in Q.run_drops(spark.createDataFrame(runs, "source_id string, ended date, rows long, ok boolean")).orderBy("ended").collect()]
    assert got == [(None, False), (100, True), (100, False), (95, True)]


def test_top_diff_and_reconfirm(spark):
    s = "unit_key string, price double"
    d = {r.unit_key: r.state for r in C.top_diff(spark.createDataFrame([("a", 10.0), ("b", 5.0)], s), spark.createDataFrame([("a", 9.0), ("c", 1.0)], s)).collect()}
    assert d == {"a": "price_cut", "b": "left", "c": "entered"}
