"""Store, replay, incremental versions, positions and exams of the rent model against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lares.operators import hedonic as H
from lares.operators import versions as V
from lares.operators.order import numbered
from lares.params import DEFAULT as P
from lares.sources import replay
from lares.sources.store import TableStore


def test_a_refresh_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    with pytest.raises(KeyError):
        store.get("t")
    store.put("t", spark.range(5))
    version = store.stage("t", spark.range(100))  # the job dies here
    assert store.get("t").count() == 5
    store.commit("t", version)
    assert store.get("t").count() == 100
    store.put("t", spark.range(3))
    assert {r["id"] for r in store.get("t").collect()} == {0, 1, 2}


def test_parts_are_replaced_and_read_alone(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for day, n in (("2026-01-01", 4), ("2026-01-02", 5), ("2026-01-03", 6), ("2026-01-02", 2)):
        store.put("top", spark.range(n), day)
    assert {r["part"]: r["count"] for r in store.get("top").groupBy("part").count().collect()} == {"2026-01-01": 4, "2026-01-02": 2, "2026-01-03": 6}
    two = store.get("top", "2026-01-01", "2026-01-02")
    assert two.count() == 6 and len(two.inputFiles()) < len(store.get("top").inputFiles())
    assert store.before("top", "2026-01-03") == "2026-01-02" and store.before("top", "2026-01-01") is None
    with pytest.raises(KeyError):
        store.get("top", "2026-02-01")


def test_replay_reports_every_blob(spark):
    good = '{"unit_key":"u1","captured":"2026-01-01T05:00:00.000001","price_uf":10.0,"price_clp":null,"zone":"z","event_id":1}'
    two = "u2|2026-01-02T00:00:00|11.5||z|2\nu2|2026-01-03T00:00:00||900|z|3\n"
    rows = [("a", "json", good), ("b", "json", f"[{good},{good}]"), ("c", "json", good[:30]), ("d", "json", "[]"), ("e", "lines", two), ("f", "lines", two + "u3|x"), ("g", "lines", ""), ("h", "other", good), ("i", "json", good), ("j", "json", None)]
    blobs = spark.createDataFrame(rows, "blob string, source_id string, content string")
    metadata = blobs.where("blob <> 'i'").select("blob")
    got, errors = replay.replayed(blobs, metadata, {"json": replay.json_captures, "lines": replay.line_captures})
    assert sorted((r["blob"], r["unit_key"], r["event_id"]) for r in got.collect()) == [("a", "u1", 1), ("b", "u1", 1), ("b", "u1", 1), ("e", "u2", 2), ("e", "u2", 3)]
    assert {(r["blob"], r["reason"]) for r in errors.collect()} == {("c", "unreadable"), ("d", "unreadable"), ("f", "unreadable"), ("g", "unreadable"), ("j", "unreadable"), ("h", "no_parser"), ("i", "no_metadata")}
    v = replay.rebuilt(got)
    assert {(r["unit_key"], r["price_uf"], r["price_clp"], r["suspicious"]) for r in v.collect()} == {("u1", 10.0, None, False), ("u2", None, 900.0, False), ("u2", 11.5, None, False)}


def _fold(state, batch, counts):
    """The same batch in plain Python: state {unit: [price, from, seen, m2]}, captures one by one in order of time."""
    closed = []
    priced = {}
    for unit, at, price, event, m2 in batch:
        if price is None:
            counts["no_price"] += 1
        elif (unit, at) not in priced or priced[(unit, at)][3] < event:
            priced[(unit, at)] = (unit, at, price, event, m2)
    for unit, at, price, _, m2 in sorted(priced.values(), key=lambda r: r[:2]):
        now = state.get(unit)
        if now and (at < now[1] or (at == now[1] and price != now[0])):
            counts["out_of_order"] += 1
        elif now and now[0] == price:
            counts["confirmed"] += 1
            now[2] = max(now[2], at)
            now[3] = m2 if now[3] is None else now[3]
        else:
            counts["new_versions" if now else "new_units"] += 1
            if now:
                closed.append((unit, now[0], now[1], at, now[2], now[3]))
            state[unit] = [price, at, at, m2]
    return closed


def test_batches_folded_one_by_one(spark):
    r = random.Random(4)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(f"u{r.randrange(6)}", t0 + dt.timedelta(hours=r.randrange(400)), r.choice([None, 1.0, 2.0, 2.0]), i, r.choice([None, 30.0, 40.0])) for i in range(400)]
    schema = "unit_key string, captured timestamp_ntz, price double, event_id long, m2 double"
    state_df = spark.createDataFrame([], "unit_key string, price double, valid_from timestamp_ntz, fetched_at timestamp_ntz, m2 double")
    state = {}
    for k in range(4):
        counts = dict.fromkeys(("no_price", "out_of_order", "new_units", "new_versions", "confirmed"), 0)
        want = _fold(state, rows[k::4], counts)
        closed, state_df, n = V.fold_batch(state_df, spark.createDataFrame(rows[k::4], schema), ["m2"])
        assert sorted(tuple(x) for x in closed.select("unit_key", "price", "valid_from", "valid_to", "fetched_at", "m2").collect()) == sorted(want)
        assert {x["unit_key"]: [x["price"], x["valid_from"], x["fetched_at"], x["m2"]] for x in state_df.collect()} == state
        got = n.first().asDict()
        # a version opened and closed in one batch, and a unit's first one, count as opened
        assert got["no_price"] == counts["no_price"] and got["out_of_order"] == counts["out_of_order"] and got["new_units"] == counts["new_units"]
        assert got["new_versions"] == counts["new_versions"] and got["confirmed"] == counts["confirmed"]


def test_a_million_equal_scores(spark):
    """Equal scores spread over tasks: the greatest share of one task is a small part of them."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("g").alias("g"), F.lit(50.0).alias("score"), F.col("id")).union(spark.range(10).select(F.lit(None).cast("string"), F.col("id").cast("double"), F.col("id") + n))
    out = numbered(rows, [F.desc("score"), F.asc("id")], ["g"])
    big = out.where("g = 'g'")
    assert big.where("position <> id + 1").count() == 0 and big.count() == n
    assert sorted((r["id"] - n, r["position"]) for r in out.where("g IS NULL").collect()) == [(i, 10 - i) for i in range(10)]


def test_stacked_exams_equal_single_fits(spark):
    """Two hundred and fifty types; every exam of a stack gives what its own sums give."""
    r = np.random.default_rng(3)
    types, zones = [f"t{i:03d}" for i in range(250)], [f"z{i}" for i in range(40)]
    rows = []
    for z in zones:
        for t in r.choice(types, 30, replace=False):
            n = int(r.integers(1, 14))
            x, y = np.log(r.uniform(20, 120, n)), r.normal(2, 0.3, n)
            y = y + 0.45 * x
            rows.append((z, str(t), float(n), float(x.sum()), float(y.sum()), float((x * x).sum()), float((x * y).sum())))
    cells = spark.createDataFrame(rows, "zone string, typ string, n double, sx double, sy double, sxx double, sxy double")
    base = H.type_sums(cells)
    assert len(base.types) > 200
    by = {}
    for z, *c in rows:
        by.setdefault(z, []).append(dict(zip(("typ", *H.STATS), c, strict=True)))
    held = [(z, c["typ"]) for z in zones[:12] for c in by[z][:3]]

    def dense(cell_lists):
        out = np.zeros((len(cell_lists), 5, len(base.types)))
        for i, cs in enumerate(cell_lists):
            out[i] = H.TypeSums._dense(base.at, cs)
        return out

    trained = [[c for c in by[z] if c["typ"] != t] for z, t in held]
    stack = H.ExamStack(base, dense([by[z] for z, _ in held]), dense(trained))
    model, state = stack.models(np.array([base.at[t] for _, t in held]), np.full(len(held), 60.0), [4.0, 8.0], P)
    assert (state == "scored").any()
    for i, (z, t) in enumerate(held):
        s = base.copy()
        s.add_zone(by[z], -1.0)
        s.add_zone(trained[i])
        fit = s.fit(P)
        if fit is None:
            assert state[i] == "no_model"
            continue
        j, n_zone = s.at[t], sum(c["n"] for c in trained[i])
        rest = sum(c["sy"] - fit["beta_typ"][s.at[c["typ"]]] * c["sx"] - c["n"] * (fit["mu"] + fit["t"][s.at[c["typ"]]]) for c in trained[i]) / n_zone
        for m, k in enumerate((4.0, 8.0)):
            y = fit["mu"] + fit["beta_typ"][j] * np.log(60.0) + fit["t"][j] * fit["n_typ"][j] / (fit["n_typ"][j] + k) + rest * n_zone / (n_zone + k)
            assert state[i] != "scored" or abs(model[i, m] - np.exp(y)) < 2e-4
