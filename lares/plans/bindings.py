"""How the domain inputs (listings, units, rates, captures, ...) are read from the given tables.

Each binding exists twice: as a DataFrame and as SQL text for the same rows, so a query and
its reference SQL start from the same data. Bindings cover whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-01"
CUTOFF = "2024-01-16"


def exact_avg(c: str):
    """Average of a two-decimal column through whole cents: the same in any order of addition."""
    return F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double") / F.count(c) / 100


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over all shuffle partitions: for steps that cost far more than their few bytes suggest."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Tables:
    """Lazy access to the parquet tables of one scale directory and the bindings on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def now(self):
        return F.lit(NOW).cast("date")

    @cached_property
    def part_dims(self) -> DataFrame:
        brand = F.substring("p_brand", 7, 9).cast("bigint")
        return self("part").select(
            "p_partkey", "p_size", "p_retailprice", F.col("p_type").alias("typ"), brand.alias("brand"),
            F.concat(F.lit("c"), (brand % 5).cast("string")).alias("district"),
            F.concat(F.lit("c"), (brand % 5).cast("string"), F.lit("/b"), brand.cast("string")).alias("zone"),
        )

    @cached_property
    def rents(self) -> DataFrame:
        """Rent listings: lineitem with zone and type from part."""
        li = self("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
        d = li.join(self.part_dims, li.l_partkey == F.col("p_partkey"))
        v = (F.floor(F.col("l_extendedprice") * F.sqrt("l_quantity") / 10000) + 1) / F.lit(8.0)
        furnished = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 6 < F.col("brand") % 7)
        in_clp = F.col("l_linenumber") % 3 == 0
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
        seen = F.date_sub(self.now, (day % 30).cast("int"))
        nul = lambda c, cond: F.when(~cond, c)
        return d.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("comp_id"),
            nul(F.col("zone"), F.col("l_suppkey") % 53 == 7).alias("zone"),
            nul(F.col("district"), F.col("l_suppkey") % 53 == 7).alias("district"),
            nul(F.col("typ"), F.col("l_partkey") % 59 == 7).alias("typ"),
            nul(F.col("l_quantity"), F.col("l_orderkey") % 61 == 3).alias("m2"),
            F.when(~in_clp, v).alias("rent_uf"),
            F.when(in_clp, v * 250000.0).alias("rent_clp"),
            nul(seen, F.col("l_orderkey") % 71 == 5).alias("seen"),
            F.concat(
                F.lit("https://inmuebles.example/"),
                F.when(furnished, "depto-amoblado-").when(F.col("l_linenumber") == 5, "cocina-equipada-").otherwise("depto-"),
                F.col("l_orderkey").cast("string")).alias("url"),
            (F.col("l_suppkey") % 37 == 0).alias("multifamily"),
            (~((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7))).alias("active"),
            (F.col("l_partkey") % 97 == 0).alias("suspicious"),
            F.when(F.col("l_discount") > 0.02, F.round(F.col("l_discount") * 1000000.0)).alias("fees_clp"),
            F.date_sub(seen, (F.col("l_orderkey") % 40).cast("int")).alias("first_seen"),
            F.when(F.col("l_linenumber") < 4, F.date_sub(seen, (F.col("l_orderkey") % 45).cast("int"))).alias("published_on"),
            F.when(F.col("l_linenumber") < 3, F.date_sub(seen, 7)).alias("published_since"),
        )

    @cached_property
    def units(self) -> DataFrame:
        """Units for sale: part."""
        k = F.col("p_partkey")
        base = F.floor(F.col("p_retailprice") / 10) * 10.0
        in_clp = k % 3 == 0
        nul = lambda c, cond: F.when(~cond, c)
        return self.part_dims.select(
            F.concat(F.lit("u"), F.lpad(k.cast("string"), 9, "0")).alias("unit_key"),
            nul(F.col("zone"), k % 67 == 5).alias("zone"),
            nul(F.col("district"), k % 67 == 5).alias("district"),
            nul(F.col("typ"), k % 71 == 5).alias("typ"),
            nul(F.col("p_size").cast("double"), k % 73 == 5).alias("m2"),
            F.when(~in_clp, base).alias("price_uf"),
            F.when(in_clp, base * 250000.0).alias("price_clp"),
            nul(F.date_sub(self.now, (k % 25).cast("int")), k % 83 == 1).alias("seen"),
            (k % 4 == 0).alias("is_new"),
            F.when(k % 5 != 0, (k % 30).cast("int")).alias("age_years"),
            F.when(k % 7 == 0, F.lit(False)).when(k % 7 == 1, F.lit(True)).alias("tax_regime"),
            F.when(k % 41 == 0, "E").otherwise("V").alias("evidence"),
            (k % 43 == 0).alias("from_price"),
            (k % 89 == 0).alias("suspicious"),
        )

    @cached_property
    def rates(self) -> DataFrame:
        """Daily rate with holes: every fifth day of the month and ten days of July 2001."""
        day = F.col("o_orderdate").cast("date")
        return (
            self("orders").groupBy(day.alias("day")).agg(exact_avg("o_totalprice").alias("rate"))
            .where((F.dayofmonth("day") % 5 != 0)
                   & ~F.col("day").between(F.lit("2001-07-10").cast("date"), F.lit("2001-07-20").cast("date")))
        )

    @cached_property
    def scope(self) -> DataFrame:
        """Districts in scope with their phase; supplier nations stand for the list."""
        return (
            self("region").where("r_regionkey < 4")
            .select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("district"),
                    (F.col("r_regionkey") % 3 + 1).cast("int").alias("phase"))
        )

    @cached_property
    def excluded(self) -> DataFrame:
        return self("region").where("r_regionkey = 4").select(
            F.lit("c4").alias("district"), F.lower("r_name").alias("why"))

    @cached_property
    def saturated(self) -> DataFrame:
        """Saturated zones: nations 1 and 6 (by key) name one zone each."""
        k = F.col("n_nationkey")
        return self("nation").where(k.isin(11, 16)).select(
            F.concat(F.lit("c"), (k % 5).cast("string"), F.lit("/b"), k.cast("string")).alias("zone"))

    @cached_property
    def captures(self) -> DataFrame:
        """Price captures of sale units: events."""
        return self("events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("unit_key"),
            F.col("ts").alias("captured"),
            F.when(F.col("event_type") != "error", F.floor(F.col("value") / 50)).cast("double").alias("price_uf"),
            F.when(F.col("event_type") == "error", F.floor(F.col("value") / 50) * 1000).cast("double").alias("price_clp"),
            F.concat(F.lit("z"), (F.col("user_id") % 20).cast("string")).alias("zone"),
            F.when(F.col("event_type").isin("view", "click", "error"), "card").otherwise("detail").alias("surface"),
            F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 90 + 20).cast("double").alias("m2"),
            F.when(F.col("event_id") % 4 == 0, F.col("user_id") % 40).cast("int").alias("age_years"),
            "event_id",
        )


# ----------------------------------------------------------------- the same rows as SQL

PART_SQL = """
part_dims AS (
  SELECT p_partkey, p_size, p_retailprice, p_type AS typ, CAST(substr(p_brand,7) AS BIGINT) AS brand,
         'c'||(CAST(substr(p_brand,7) AS BIGINT) % 5) AS district,
         'c'||(CAST(substr(p_brand,7) AS BIGINT) % 5)||'/b'||CAST(substr(p_brand,7) AS BIGINT) AS zone
  FROM part)"""

RENTS_ONLY_SQL = f"""
rents0 AS (
  SELECT *, (floor(l_extendedprice * sqrt(l_quantity) / 10000) + 1) / 8.0::DOUBLE AS v,
         CAST(DATE '{NOW}' - CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) % 30 AS INTEGER) AS DATE) AS sd,
         (l_returnflag = 'R' AND l_suppkey % 6 < brand % 7) AS furn
  FROM lineitem JOIN part_dims ON l_partkey = p_partkey),
rents AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS comp_id,
         CASE WHEN l_suppkey % 53 <> 7 THEN zone END AS zone,
         CASE WHEN l_suppkey % 53 <> 7 THEN district END AS district,
         CASE WHEN l_partkey % 59 <> 7 THEN typ END AS typ,
         CASE WHEN l_orderkey % 61 <> 3 THEN l_quantity END AS m2,
         CASE WHEN l_linenumber % 3 <> 0 THEN v END AS rent_uf,
         CASE WHEN l_linenumber % 3 = 0 THEN v * 250000.0::DOUBLE END AS rent_clp,
         CASE WHEN l_orderkey % 71 <> 5 THEN sd END AS seen,
         'https://inmuebles.example/' || CASE WHEN furn THEN 'depto-amoblado-' WHEN l_linenumber = 5 THEN 'cocina-equipada-' ELSE 'depto-' END || l_orderkey AS url,
         (l_suppkey % 37 = 0) AS multifamily,
         NOT (l_linestatus = 'F' AND l_linenumber = 7) AS active,
         (l_partkey % 97 = 0) AS suspicious,
         CASE WHEN l_discount > 0.02 THEN round(l_discount * 1000000.0::DOUBLE) END AS fees_clp,
         CAST(sd - CAST(l_orderkey % 40 AS INTEGER) AS DATE) AS first_seen,
         CASE WHEN l_linenumber < 4 THEN CAST(sd - CAST(l_orderkey % 45 AS INTEGER) AS DATE) END AS published_on,
         CASE WHEN l_linenumber < 3 THEN CAST(sd - 7 AS DATE) END AS published_since,
         regexp_matches(lower(CASE WHEN furn THEN 'amoblado' ELSE '' END), 'amoblad') AS furnished
  FROM rents0)"""

RENTS_SQL = PART_SQL.rstrip() + "," + RENTS_ONLY_SQL

RATES_SQL = """
rates AS (
  SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 100 AS rate FROM orders
  GROUP BY 1 HAVING day(CAST(o_orderdate AS DATE)) % 5 <> 0
     AND CAST(o_orderdate AS DATE) NOT BETWEEN DATE '2001-07-10' AND DATE '2001-07-20'),
rate_on AS (
  SELECT valid_day, arg_max(rate, day) AS rate, max(day) AS rate_day
  FROM (SELECT day, rate, CAST(day + CAST(k AS INTEGER) AS DATE) AS valid_day FROM rates, range(0, 8) r(k) WHERE rate > 0)
  GROUP BY 1)"""

UNITS_SQL = f"""
units AS (
  SELECT 'u'||lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS unit_key,
         CASE WHEN p_partkey % 67 <> 5 THEN zone END AS zone,
         CASE WHEN p_partkey % 67 <> 5 THEN district END AS district,
         CASE WHEN p_partkey % 71 <> 5 THEN typ END AS typ,
         CASE WHEN p_partkey % 73 <> 5 THEN CAST(p_size AS DOUBLE) END AS m2,
         CASE WHEN p_partkey % 3 <> 0 THEN floor(p_retailprice/10)*10.0::DOUBLE END AS price_uf,
         CASE WHEN p_partkey % 3 = 0 THEN floor(p_retailprice/10)*10.0::DOUBLE*250000.0::DOUBLE END AS price_clp,
         CASE WHEN p_partkey % 83 <> 1 THEN CAST(DATE '{NOW}' - CAST(p_partkey % 25 AS INTEGER) AS DATE) END AS seen,
         (p_partkey % 4 = 0) AS is_new,
         CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 30 AS INTEGER) END AS age_years,
         CASE WHEN p_partkey % 7 = 0 THEN FALSE WHEN p_partkey % 7 = 1 THEN TRUE END AS tax_regime,
         CASE WHEN p_partkey % 41 = 0 THEN 'E' ELSE 'V' END AS evidence,
         (p_partkey % 43 = 0) AS from_price,
         (p_partkey % 89 = 0) AS suspicious
  FROM part_dims)"""

SCOPE_SQL = """
scope AS (SELECT 'c'||r_regionkey AS district, CAST(r_regionkey % 3 + 1 AS INTEGER) AS phase FROM region WHERE r_regionkey < 4),
excluded AS (SELECT 'c4' AS district, lower(r_name) AS why FROM region WHERE r_regionkey = 4),
saturated AS (SELECT 'c'||(n_nationkey % 5)||'/b'||n_nationkey AS zone FROM nation WHERE n_nationkey IN (11, 16))"""

CAPTURES_SQL = """
captures AS (
  SELECT 'u'||user_id AS unit_key, ts AS captured,
         CASE WHEN event_type <> 'error' THEN floor(value/50) END AS price_uf,
         CASE WHEN event_type = 'error' THEN floor(value/50)*1000 END AS price_clp,
         'z'||(user_id % 20) AS zone,
         CASE WHEN event_type IN ('view','click','error') THEN 'card' ELSE 'detail' END AS surface,
         CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 90 + 20 AS DOUBLE) END AS m2,
         CASE WHEN event_id % 4 = 0 THEN CAST(user_id % 40 AS INTEGER) END AS age_years, event_id
  FROM events)"""
