"""Status operators on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from lares.operators import status as S


def test_heading_dates(spark):
    rows = [("Fecha de la consulta: 22 al 26 de mayo de 2006",), ("3 de Agosto de 2026",), ("31 de febrero de 2020",), ("2 de brumario de 2006",), ("",), (None,)]
    d = spark.createDataFrame(rows, "text string").select(S.heading_date(F.col("text")).alias("d"), S.age_months(S.heading_date(F.col("text")), F.lit("2026-09-01").cast("date")).alias("m"))
    assert [tuple(r) for r in d.collect()] == [(dt.date(2006, 5, 26), 244), (dt.date(2026, 8, 3), 1), (None, None), (None, None), (None, None), (None, None)]


def test_last_runs_and_empty_series(spark):
    runs = spark.createDataFrame([("a", i, 5) for i in range(30)] + [("b", 1, 2)], "source_id string, ended int, rows int")
    got = sorted((r.source_id, r.ended, r.back) for r in S.last_runs(runs, 2).collect())
    assert got == [("a", 28, 2), ("a", 29, 1), ("b", 1, 1)]
    assert tuple(S.series_status(spark.createDataFrame([], "day date, rate double")).first()) == (0, None, None)


def test_run_gain_counts_units_per_cell(spark):
    units = spark.createDataFrame([("z", "t", "s")] * 5 + [("z", "t", "m")] * 3 + [("y", "t", "s")], "zone string, typ string, band string")
    comps = spark.createDataFrame([("z", "t", "s", 1 if i < 8 else 9) for i in range(9)] + [("z", "t", "m", 1 if i < 7 else 9) for i in range(8)], "zone string, typ string, band string, seen int")
    assert tuple(S.run_gain(units, comps, F.lit(5)).first()) == (5, 8, 3, 1)
