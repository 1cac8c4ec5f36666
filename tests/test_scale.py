"""What large tables need: narrow tables between steps, work dealt over tasks, one pass over the listings."""


from pyspark.sql import functions as F

from lares.operators import compare as C
from lares.operators import invest as I
from lares.operators import order
from lares.operators import rent as R
from lares.plans.bindings import Tables
from lares.plans.q_invest import eval_units
from lares.plans.q_sources import detail_pages
from lares.sources import pages

SF = "/root/testdata/sf0.001"


def test_catalyst_sweep_writes_only_what_scores_need(spark, monkeypatch):
    wide = []
    for module in (C, I, order):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: (wide.append(set(df.columns)), cut(df))[1])
    rows = [(f"u{i}", f"z{i % 2}", "base", 1.0, 0.5, -1.0, 0.4, i / 100.0, 0.5, 0.0, 0.1, 1.0) for i in range(20)]
    live = spark.createDataFrame(rows, "unit_key string, zone string, scenario_id string, holding_cost double, breakeven_down double, cash_flow double, breakeven_down_simple double, irr_10 double, risk double, catalyst double, zone_discount double, noise double")
    cats = spark.createDataFrame([(1.0, "z0", 1.0), (0.0, "z0", 0.0)], "factor double, zone string, catalyst double")
    out = {r["factor"]: (r["moved"], r["n"], r["mean_catalyst"]) for r in C.catalyst_sweep(live, cats, 1.0).collect()}
    assert out == {1.0: (0, 20, 0.5), 0.0: (out[0.0][0], 20, 0.0)} and out[0.0][0] > 0
    assert wide and all("noise" not in columns and "scenario_id" not in columns for columns in wide)


def test_units_are_dealt_by_key_before_evaluation(spark):
    plan = eval_units(Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_extractors_get_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield b.assign(n=len(b))[["n"]]

    some = spark.range(0, 1000, 1, 1).selectExpr("cast(id AS string) AS page_id", "'u' AS url", "'<html>' AS html")
    assert pages.run_extractor(some, sizes, "n long").groupBy().max("n").first()[0] <= 256


def test_detail_pages_are_dealt_over_all_tasks(spark):
    assert detail_pages(Tables(spark, SF)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_comparables_and_furnished_sizes_come_from_one_pass(spark):
    t = Tables(spark, SF)
    kinds = dict(t.rents.dtypes)
    bare = t.rents.where("url LIKE '%amoblado%'").limit(40).withColumns({c: F.lit(None).cast(kinds[c]) for c in ("rent_uf", "rent_clp")})
    rents = t.rents.unionByName(bare).localCheckpoint()
    both = R.comparables_and_furnished(rents, t.rates, t.now)
    for got, want in zip(both, (R.comparables(rents, t.rates, t.now), R.furnished_sizes(rents, t.now)), strict=True):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    assert "lineitem" not in "".join(both[0].inputFiles() + both[1].inputFiles())
