"""Data-quality gates and suspicious-row flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lares.functions.exprs import freshness_reason, implausible_reason, lit_or, pii_kinds
from lares.operators.asof import with_rate
from lares.operators.quantiles import grouped_quantiles, upper_median
from lares.operators.ranges import range_quantiles, running_sums
from lares.params import DEFAULT, PROVENANCE_COLUMNS, Params
from lares.session import cut

SEVERITIES = ("OK", "MARK", "ALERT", "FAIL")


# ----------------------------------------------------------------- suspicious rows


def fences(df: DataFrame, group: str, value, p: Params = DEFAULT) -> DataFrame:
    """group, lo, hi: quartiles widened by max(3 IQR, 10 % of the median); groups under three values have none."""
    q = grouped_quantiles(df, [group], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    margin = F.greatest(p.fence_iqr * (F.col("q3") - F.col("q1")), F.abs(F.col("q2")) * p.fence_floor)
    return q.where(F.col("n_values") >= p.fence_min).select(
        group, (F.col("q1") - margin).alias("lo"), (F.col("q3") + margin).alias("hi"), "n_values")


def outside_fence(df: DataFrame, group: str, value: str, p: Params = DEFAULT) -> DataFrame:
    f = fences(df, group, F.col(value), p)
    return df.join(f, group).where((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi")))


def rent_values(rents: DataFrame, rates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Active listings with zone, size and price: key, zone, m2, rent_clp, per_m2 in UF."""
    base = rents.where(F.col("active") & F.col("zone").isNotNull() & (F.col("m2") > 0))
    j = with_rate(base, rates, "seen", p)
    rent = F.coalesce(F.col("rent_uf"), F.col("rent_clp") / F.col("rate"))
    return j.select(F.col("comp_id").alias("key"), "zone", "m2", "rent_clp", (rent / F.col("m2")).alias("per_m2")).where("per_m2 is not null")


def sale_values(units: DataFrame, rates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    base = units.where(F.col("zone").isNotNull() & (F.col("m2") > 0))
    j = with_rate(base, rates, "seen", p)
    price = F.coalesce(F.col("price_uf"), F.col("price_clp") / F.col("rate"))
    return j.select(F.col("unit_key").alias("key"), "zone", "m2", (price / F.col("m2")).alias("per_m2")).where("per_m2 is not null")


def promo_clusters(values: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(zone, rent_clp) whose exact price repeats and sits far below peers of similar size.

    The reference is the upper median of rows of +-25 % size that belong to no cluster, at
    least five of them. Everything past the first aggregation is per cluster or per
    (zone, size, value), never a pair of listings.
    """
    zone_n = values.groupBy("zone").agg(F.count("*").alias("zone_n")).where(F.col("zone_n") >= p.promo_min)
    counted = values.where("rent_clp is not null").groupBy("zone", "rent_clp").agg(F.count("*").alias("members"))
    clusters = counted.where(F.col("members") >= p.promo_min).join(zone_n.select("zone"), "zone", "left_semi")
    member_rows = values.join(clusters, ["zone", "rent_clp"])
    spec = {"mid": upper_median()}
    size = grouped_quantiles(member_rows, ["zone", "rent_clp"], F.col("m2"), spec).select("zone", "rent_clp", F.col("mid").alias("size"))
    level = grouped_quantiles(member_rows, ["zone", "rent_clp"], F.col("per_m2"), spec).select("zone", "rent_clp", F.col("mid").alias("level"))
    in_cluster = clusters.select("zone", "rent_clp")
    peers = values.join(in_cluster, ["zone", "rent_clp"], "left_anti")
    freq = cut(peers.groupBy("zone", "m2", F.col("per_m2").alias("_v")).agg(F.count("*").alias("_n")))
    sizes = size.select("zone", "size").distinct()
    cells = freq.groupBy("zone", "m2").agg(F.sum("_n").alias("n"))
    reach = F.col("size") * p.promo_peer_band
    at, ordered = running_sums(cells, sizes, ["zone"], ["size"], "m2", ["n"], {"lo": (F.col("size") - reach, False), "hi": (F.col("size") + reach, True)})
    ranges = at.select("zone", "size", F.col("lo.rank").alias("low"), F.col("hi.rank").alias("high"))
    ref = range_quantiles(ranges, cut(freq.join(ordered.select("zone", "m2", "rank"), ["zone", "m2"])), ["zone"], ["size"], {"reference": upper_median()})
    ref = ref.where(F.col("n_values") >= p.promo_min_peers).select("zone", "size", "reference", F.col("n_values").alias("peers"))
    return (
        clusters.join(size, ["zone", "rent_clp"]).join(level, ["zone", "rent_clp"]).join(ref, ["zone", "size"])
        .withColumn("flagged", F.col("level") < F.col("reference") * p.promo_factor)
    )


def suspicious_rents(rents: DataFrame, rates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """key, why: promotional clusters first, then the fence over what remains."""
    values = cut(rent_values(rents, rates, p))
    promo = cut(promo_clusters(values, p).where("flagged").select("zone", "rent_clp"))
    flagged = values.join(promo, ["zone", "rent_clp"]).select("key", F.lit("promo").alias("why"))
    rest = values.join(promo, ["zone", "rent_clp"], "left_anti")
    return flagged.unionByName(outside_fence(rest, "zone", "per_m2", p).select("key", F.lit("fence").alias("why")))


def suspicious_sales(units: DataFrame, rates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return outside_fence(sale_values(units, rates, p), "zone", "per_m2", p).select("key", F.lit("fence").alias("why"))


# ----------------------------------------------------------------- gates


def _finding(check: str, severity, affected):
    return F.lit(check).alias("check"), severity.alias("severity"), affected.cast("bigint").alias("affected")


def pii_rows(df: DataFrame, id_col: str) -> DataFrame:
    """id, column, kind for every string value that holds personal data; whole texts are read."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != id_col]
    cells = df.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("x")).select(id_col, "x.*")
    return cells.select(id_col, "column", F.explode(pii_kinds(F.col("value"))).alias("kind"))


def pii_check(df: DataFrame, id_col: str) -> DataFrame:
    n = F.count("*")
    return pii_rows(df, id_col).agg(*_finding("personal_data", F.when(n > 0, "FAIL").otherwise("OK"), n))


def provenance_check(df: DataFrame) -> DataFrame:
    """Rows where any of the six provenance columns is NULL or empty."""
    missing = F.lit(False)
    for c in PROVENANCE_COLUMNS:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    n = F.count_if(missing)
    return df.agg(*_finding("provenance", F.when(n > 0, "FAIL").otherwise("OK"), n))


def coverage_check(units: DataFrame, p: Params = DEFAULT) -> DataFrame:
    good = (F.coalesce(F.col("price_uf"), F.lit(0.0)) != 0) & F.col("zone").isNotNull() & F.col("evidence").isin("V", "D")
    ok = F.coalesce(F.sum(F.coalesce(good, F.lit(False)).cast("bigint")), F.lit(0))
    n = F.count("*")
    bad = (n == 0) | (ok / n < p.coverage_min)
    return units.agg(*_finding("coverage", F.when(bad, "ALERT").otherwise("OK"), F.when(bad, n - ok).otherwise(0)))


def freshness_check(rows: DataFrame, now, historical: list[str], p: Params = DEFAULT) -> DataFrame:
    """Stale rows of live sources; rows without a date are judged by provenance, not here."""
    stale = F.coalesce(freshness_reason(F.col("seen"), now, p.fresh_days) == "stale", F.lit(False))
    n = F.count_if(stale & ~F.col("source_id").isin(historical))
    return rows.agg(*_finding("freshness", F.when(n > 0, "ALERT").otherwise("OK"), n))


def plausibility_check(units: DataFrame, p: Params = DEFAULT) -> DataFrame:
    n = F.count_if(implausible_reason(F.col("price_uf"), F.col("m2"), p).isNotNull())
    return units.agg(*_finding("plausibility", F.when(n > 0, "ALERT").otherwise("OK"), n))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Natural keys held by more than one open version."""
    full = rows.where("valid_to is null")
    for k in key:
        full = full.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return full.groupBy(*key).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def duplicates_within(rows: DataFrame, key: list[str], day: str, p: Params = DEFAULT) -> DataFrame:
    """Pairs of rows of one key published at most ``dedup_days`` apart, counted without pairing.

    Rows are first counted per (key, day); a range frame over those counts gives, for each
    day, the rows of the preceding days in reach. No pair is ever materialised.
    """
    full = rows
    for k in [*key, day]:
        full = full.where(F.col(k).isNotNull())
    per_day = full.groupBy(*key, F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("_d")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_d").rangeBetween(-p.dedup_days, -1)
    pairs = F.col("_n") * (F.col("_n") - 1) / 2 + F.col("_n") * F.coalesce(F.sum("_n").over(before), F.lit(0))
    return per_day.withColumn("_p", pairs).groupBy(*key).agg(F.sum("_p").cast("bigint").alias("pairs")).where("pairs > 0")


def anchor_check(medians: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """Each group against its published reference; groups without one are ``unverified``."""
    j = medians.join(reference, "group", "left")
    dev = F.when((F.col("reference").isNotNull()) & (F.col("reference") != 0),
                 F.abs(F.col("value") - F.col("reference")) / F.col("reference"))
    return j.withColumn("deviation", dev).withColumn(
        "state", F.when(dev.isNull(), "unverified").when(dev > tolerance, "deviates").otherwise("within"))


def used_discount(medians_used: DataFrame, reference: DataFrame) -> DataFrame:
    """Spread of used stock against the published new-stock reference; a measurement, not a gate."""
    j = medians_used.join(reference.where("reference <> 0"), "group")
    return j.withColumn("spread", (F.col("value") - F.col("reference")) / F.col("reference"))


def finding_from(df: DataFrame, check: str, severity: str) -> DataFrame:
    n = F.count("*")
    return df.agg(*_finding(check, F.when(n > 0, severity).otherwise("OK"), n))


def gate_status(findings: list[DataFrame]) -> DataFrame:
    """Overall status from the worst finding, with the findings counted per severity."""
    allf = findings[0]
    for f in findings[1:]:
        allf = allf.unionByName(f)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    worst = F.max(rank)
    return allf.agg(
        F.when(worst == 4, "RED").when(worst == 3, "PARTIAL").otherwise("GREEN").alias("status"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES],
        F.sum("affected").cast("bigint").alias("affected"))


# ----------------------------------------------------------------- run log


def run_drops(runs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each run against the last successful run of its source: drop share and alarm.

    A failed run never becomes the reference. The run log has one row per run.
    """
    w = Window.partitionBy("source_id").orderBy("ended").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("ok"), F.col("rows")), ignorenulls=True).over(w)
    drop = F.when(F.coalesce(F.col("previous"), F.lit(0)) != 0, (F.col("previous") - F.col("rows")) / F.col("previous"))
    return runs.withColumn("previous", prev).withColumn("drop", drop).withColumn(
        "alarm", F.coalesce(F.col("drop") > p.drop_trigger, F.lit(False)))


def field_coverage(rows: DataFrame, fields: list[str], minimum: float = 0.95) -> DataFrame:
    """field, share of non-NULL values, and whether it meets the minimum."""
    shares = rows.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in fields])
    return shares.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in fields])).alias("x")).select(
        "x.*", (F.col("x.share") >= minimum).alias("ok"))


# ----------------------------------------------------------------- searches that return the same thing


def overlapping_searches(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of searches sharing at least ``threshold`` of the smaller result set.

    ``results``: search, id (distinct). Only a prefix of each search's rarest ids is paired:
    two sets that share ceil(t*n) of the smaller set's n ids must share one of its first
    n - ceil(t*n) + 1 ids in any fixed order. With the rarest ids first, an id that shows up
    in a great many searches is not in the prefixes, so it does not multiply pairs. The exact
    overlap is then counted for the candidate pairs only.
    """
    r = results.select("search", "id").distinct()
    size = r.groupBy("search").agg(F.count("*").alias("n"))
    rarity = r.groupBy("id").agg(F.count("*").alias("f"))
    ranked = r.join(rarity, "id").withColumn("_k", F.row_number().over(Window.partitionBy("search").orderBy("f", "id")))
    ranked = ranked.join(size, "search")
    prefix = ranked.where(F.col("_k") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select(
        F.col("search").alias("s1"), "id", F.col("n").alias("n1"))
    other = r.join(size, "search").select(F.col("search").alias("s2"), "id", F.col("n").alias("n2"))
    cand = (
        prefix.join(other, "id").where((F.col("s1") != F.col("s2")) & (F.col("n1") <= F.col("n2")))
        .select(F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b"), F.least("n1", "n2").alias("smaller")).distinct())
    common = (
        cand.join(r.withColumnRenamed("search", "a"), "a")
        .join(r.withColumnRenamed("search", "b"), ["b", "id"])
        .groupBy("a", "b", "smaller").agg(F.count("*").alias("common")))
    return common.where(F.col("common") >= F.col("smaller") * threshold)


def content_collisions(docs: DataFrame) -> DataFrame:
    """Documents with identical content served to different searches: sha, search rows."""
    pairs = docs.groupBy("sha", "search").agg(F.count("*").alias("documents"))
    shared = pairs.groupBy("sha").agg(F.count("*").alias("searches")).where("searches > 1")
    return pairs.join(shared, "sha")


def key_match_rate(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of left keys found on the right after normalising separators and case."""
    norm = lambda c: F.regexp_replace(F.upper(F.col(c).cast("string")), r"[^A-Z0-9]", "")
    a = left.select(norm("key").alias("k"))
    b = right.select(norm("key").alias("k")).distinct().withColumn("_hit", F.lit(1))
    return a.join(b, "k", "left").agg(F.count("*").alias("n"), F.count("_hit").alias("matched")).withColumn(
        "rate", F.when(F.col("n") > 0, F.col("matched") / F.col("n")))
