"""Nearest-centre assignment, census sums, zone risk and station catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.functions.exprs import distance_capped_m, distance_m
from lares.params import DEFAULT, Params
from lares.session import cut

_POLE = 89.9  # columns are sized by their row's latitude up to here
#: Rings beyond the first reach, the last one without limit; the finest cells are 8 ** 2 times finer than the reach.
_RINGS, _FINEST = 5, -2


def _row(lat: Column, reach_m: float) -> Column:
    return F.floor(lat / (reach_m / 110_000.0)).cast("bigint")


def _column(lon: Column, row: Column, reach_m: float) -> Column:
    """Column of a longitude in a row of cells; a row's columns are ``reach_m`` wide where the row is narrowest."""
    dy = reach_m / 110_000.0
    edge = F.least(F.greatest(F.abs(row * dy), F.abs((row + 1) * dy)), F.lit(_POLE))
    return F.floor(lon / (reach_m / (110_000.0 * F.cos(F.radians(edge))))).cast("bigint")


def _cell(lat: Column, lon: Column, reach_m: float) -> tuple[Column, Column]:
    row = _row(lat, reach_m)
    return row, _column(lon, row, reach_m)


def _index(centres: DataFrame, group: list[str], reach_m: float, name: str, attrs: list[str]) -> DataFrame:
    """Centres of each grid cell and its eight neighbours, as one array per (group, cell)."""
    rows = centres.withColumn("_y", F.explode(F.array(*[_row(F.col("clat"), reach_m) + d for d in (-1, 0, 1)])))
    # a neighbouring row has columns of its own width
    near = rows.withColumn("_x", F.explode(F.array(*[_column(F.col("clon"), F.col("_y"), reach_m) + d for d in (-1, 0, 1)])))
    return near.groupBy(*group, F.col("_y").alias(f"_y{name}"), F.col("_x").alias(f"_x{name}")).agg(
        F.collect_list(F.struct("clat", "clon", *attrs)).alias(f"_c{name}"))


def _bounds(box: Column) -> tuple[Column, Column]:
    """Least and greatest distance that a place in ``box`` can have from the point."""
    lat, lon, k = F.col("lat"), F.col("lon"), 111_320.0
    scale = [F.greatest(F.cos(F.radians((lat + box[x]) / 2)), F.lit(0.0)) for x in ("s", "n")]
    straddles = ((lat + box["s"]) <= 0) & ((lat + box["n"]) >= 0)
    dy, dx = (F.greatest(F.lit(0.0), box[lo] - v, v - box[hi]) for v, lo, hi in ((lat, "s", "n"), (lon, "w", "e")))
    fy, fx = (F.greatest(F.abs(v - box[lo]), F.abs(v - box[hi])) for v, lo, hi in ((lat, "s", "n"), (lon, "w", "e")))
    far = F.when(straddles, 1.0).otherwise(F.greatest(*scale))
    return F.hypot(dy * k, dx * k * F.least(*scale)) * (1 - 1e-9), F.hypot(fy * k, fx * k * far) * (1 + 1e-9)


_BOX = {"s": F.min, "n": F.max, "w": F.min, "e": F.max}


def _boxed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One box per (keys, cell _y, _x) around its centres, as an array per ``keys``: a bounded number of cells."""
    at = {"s": "clat", "n": "clat", "w": "clon", "e": "clon"}
    boxes = rows.groupBy(*keys, "_y", "_x").agg(*[f(at[k]).alias(k) for k, f in _BOX.items()])
    return boxes.groupBy(*keys).agg(F.collect_list(F.struct("_y", "_x", *_BOX)).alias("_boxes"))


def _opened(frontier: DataFrame) -> DataFrame:
    """A row per box that can hold the nearest centre of its point (``_pid``); boxes farther than another's far side go."""
    measured = F.transform("_boxes", lambda b: F.struct(b["_y"].alias("_y"), b["_x"].alias("_x"), _bounds(b)[0].alias("near"), _bounds(b)[1].alias("far")))
    rows = frontier.withColumn("_m", measured).withColumn("_far", F.array_min(F.transform("_m", lambda b: b["far"])))
    rows = rows.withColumn("_far", F.min("_far").over(Window.partitionBy("_pid")))
    some = F.filter("_m", lambda b: b["near"] <= F.col("_far"))
    return rows.withColumn("_m", F.explode(some)).drop("_y", "_x", "_boxes", "_far").select("*", "_m._y", "_m._x").drop("_m").distinct()


def _ring(points: DataFrame, centres: DataFrame, group: list[str], reach_m: float, k: int, last: bool) -> DataFrame:
    """_pid, _best: the nearest centre in the cells around each point at the ``k``-th reach (in the whole group at the last).

    From cells of an eighth of that reach the search goes down, eightfold finer each time. At each
    level only boxes around the centres of a cell are looked at, and only those that can hold the
    nearest; centres themselves are met in the finest cells.
    """
    side = lambda level: reach_m * 8.0 ** level
    inner = lambda level: dict(zip(("_y", "_x"), _cell(F.col("clat"), F.col("clon"), side(level)), strict=True))
    pts = points.select("_pid", "lat", "lon", *group)
    if last:
        frontier = pts.join(_boxed(centres.withColumns(inner(k - 1)), group), group)
    else:
        rows = centres.withColumn("_cy", F.explode(F.array(*[_row(F.col("clat"), side(k)) + d for d in (-1, 0, 1)])))
        rows = rows.withColumn("_cx", F.explode(F.array(*[_column(F.col("clon"), F.col("_cy"), side(k)) + d for d in (-1, 0, 1)])))
        y, x = _cell(F.col("lat"), F.col("lon"), side(k))
        keys = [*group, "_cy", "_cx"]
        frontier = pts.withColumn("_cy", y).withColumn("_cx", x).join(_boxed(rows.withColumns(inner(k - 1)), keys), keys).drop("_cy", "_cx")
    frontier = _opened(frontier)
    for level in range(k - 2, _FINEST - 1, -1):
        y, x = _cell(F.col("clat"), F.col("clon"), side(level + 1))
        below = _boxed(centres.withColumn("_cy", y).withColumn("_cx", x).withColumns(inner(level)), [*group, "_cy", "_cx"])
        frontier = _opened(frontier.withColumnsRenamed({"_y": "_cy", "_x": "_cx"}).join(below, [*group, "_cy", "_cx"]).drop("_cy", "_cx"))
    met = frontier.join(centres.withColumns(inner(_FINEST)), [*group, "_y", "_x"])
    return met.groupBy("_pid").agg(F.min(F.struct(distance_m(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")).alias("distance_m"), "_a")).alias("_best"))


def nearest(points: DataFrame, centres: DataFrame, group: list[str], attrs: list[str], reach_m: float = 2500.0, most: int = 256) -> DataFrame:
    """Adds ``distance_m`` and the ``attrs`` of the nearest centre of the point's group (ties by attrs).

    Exact. A centre at most ``reach_m`` away lies in the point's grid cell or a neighbouring one, so
    nearly all points are settled by a join with a cell's centres, inside that row's array, or with
    those of a coarser cell. Only points without such a centre, or with more than ``most`` around
    them, go on: to rings of eight times the reach each, until their nearest centre is within the
    ring. Nothing ever gathers the centres of a group. The result is written.
    """
    one = cut(centres.where("clat IS NOT NULL AND clon IS NOT NULL").groupBy(*group, "clat", "clon").agg(F.min(F.struct(*attrs)).alias("_a")))
    rows = points.withColumn("_pid", F.monotonically_increasing_id()).withColumn("_best", F.lit(None))
    for reach in (reach_m, 12 * reach_m):
        idx = _index(one, group, reach, "a", ["_a"]).where(F.size("_ca") <= most)
        y, x = _cell(F.col("lat"), F.col("lon"), reach)
        best = F.array_min(F.transform("_ca", lambda c: F.struct(distance_m(F.col("lat"), F.col("lon"), c["clat"], c["clon"]).alias("distance_m"), c["_a"].alias("_a"))))
        rows = rows.withColumn("_ya", y).withColumn("_xa", x).join(idx, [*group, "_ya", "_xa"], "left").withColumn("_new", best)
        rows = rows.withColumn("_best", F.coalesce("_best", F.when(F.col("_new.distance_m") <= reach, F.col("_new")))).drop("_ya", "_xa", "_ca", "_new")
    rows = cut(rows)
    open_ = "_best IS NULL AND lat IS NOT NULL AND lon IS NOT NULL"
    parts, left = [rows.where(f"NOT ({open_})")], rows.where(open_)
    for k in range(1, _RINGS + 1):
        if left.isEmpty():
            break
        last = k == _RINGS
        tried = cut(left.drop("_best").join(_ring(left, one, group, reach_m, k, last), "_pid", "left"))
        found = F.lit(True) if last else F.coalesce(F.col("_best.distance_m") <= reach_m * 8.0 ** k, F.lit(False))
        parts.append(tried.where(found))
        left = tried.where(~found)
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*points.columns, "_best.distance_m", *[F.col(f"_best._a.{a}").alias(a) for a in attrs])


def nearest_within(points: DataFrame, centres: DataFrame, group: list[str], attrs: list[str], cap_m: float = DEFAULT.zone_max_distance_m) -> DataFrame:
    """Nearest centre of the group at most ``cap_m`` away; others stay unassigned (NULL)."""
    idx = _index(centres, group, cap_m * 1.05, "a", attrs)
    y, x = _cell(F.col("lat"), F.col("lon"), cap_m * 1.05)
    j = points.withColumn("_ya", y).withColumn("_xa", x).join(idx, [*group, "_ya", "_xa"], "left")
    b = F.array_min(F.transform("_ca", lambda c: F.struct(
        distance_capped_m(F.col("lat"), F.col("lon"), c["clat"], c["clon"]).alias("distance_m"), *[c[a].alias(a) for a in attrs])))
    j = j.withColumn("_best", F.when(b["distance_m"] <= cap_m, b))
    return j.select("*", "_best.*").drop("_best", "_ya", "_xa", "_ca")


# ----------------------------------------------------------------- census and risk

CENSUS = ["vacant", "occupied", "rent_contract", "rent_informal", "households"]


def zone_census(blocks: DataFrame) -> DataFrame:
    """Sums per zone over what is known; masked counts stay out of each sum."""
    s = blocks.groupBy("zone").agg(F.count("*").alias("n_blocks"), *[F.sum(c).alias(c) for c in CENSUS])
    return s.withColumn("renters", F.col("rent_contract") + F.col("rent_informal"))


def zone_risk(census: DataFrame, listings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """vacancy, depth, saturation and the 0-1 risk: min-max components, missing weight shared out.

    ``listings``: zone, n. Works on the zone table; the ranges are one row, joined by broadcast.
    """
    c = F.col
    z0 = lambda x: F.coalesce(c(x), F.lit(0))
    j = census.join(listings.select("zone", c("n").alias("listings")), "zone", "left").fillna({"listings": 0})
    homes = z0("vacant") + z0("occupied")
    j = j.withColumns({
        "vacancy": F.when(homes != 0, z0("vacant") / homes),
        "depth": F.when(z0("households") != 0, z0("renters") / c("households")),
        "saturation": F.when(z0("renters") != 0, c("listings") / c("renters"))})
    names = ["vacancy", "saturation", "depth"]
    lim = j.agg(*[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    j = j.crossJoin(F.broadcast(lim))
    num, den = F.lit(0.0), F.lit(0.0)
    for n, w in zip(names, p.risk_weights):
        lo, hi = c(f"_lo_{n}"), c(f"_hi_{n}")
        v = F.when(lo == hi, 0.5).otherwise((c(n) - lo) / (hi - lo))
        v = 1.0 - v if n == "depth" else v
        known = c(n).isNotNull()
        num = num + F.when(known, v * w).otherwise(0.0)
        den = den + F.when(known, w).otherwise(0.0)
    return j.withColumn("risk", F.when(den > 0, num / den)).drop(*[f"_{k}_{n}" for n in names for k in ("lo", "hi")])


# ----------------------------------------------------------------- stations


def eligible_stations(stations: DataFrame, lines: DataFrame, now: Column, p: Params = DEFAULT, open_factor: float | None = None) -> DataFrame:
    """Stations that count, with their factor, and the state of the others.

    Open stations count fully; stations being built count when their line has a credible
    date inside the horizon, the station itself does not contradict it, and a mere proposal
    declares its own date.
    """
    c = F.col
    open_factor = p.catalyst_open if open_factor is None else open_factor
    j = stations.join(lines, "line", "left")
    years = F.datediff(c("opens_on"), now) / 365.25
    contradicts = F.coalesce(c("opening_year") > F.year(now) + p.catalyst_horizon_years, F.lit(False))
    undated = (c("status") == "proposed") & c("opening_year").isNull()
    credible = c("opens_on").isNotNull() & (years >= 0) & (years <= p.catalyst_horizon_years) & ~contradicts & ~undated
    return j.withColumn("state", F.when(c("network") == "efe", "excluded").when(c("status") == "open", "open")
                        .when(F.coalesce(credible, F.lit(False)), "building").otherwise("undated")).withColumn(
        "factor", F.when((c("state") == "open") & F.lit(open_factor > 0), open_factor).when(c("state") == "building", p.catalyst_building))


def station_catalyst(centres: DataFrame, stations: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """zone, distance to the nearest eligible station, best distance-decay score.

    The score is zero beyond ``catalyst_max_m``, so it only looks at neighbouring grid cells;
    the nearest distance uses the two-level search. ``stations``: lat, lon, factor.
    """
    st = stations.where("factor is not null").select(
        F.lit(1).alias("_g"), F.col("lat").alias("clat"), F.col("lon").alias("clon"), "factor", "station_id")
    pts = centres.withColumn("_g", F.lit(1))
    near = nearest(pts, st, ["_g"], ["station_id"], p.catalyst_max_m).drop("_g", "station_id")
    idx = _index(st, ["_g"], p.catalyst_max_m, "s", ["factor"])
    y, x = _cell(F.col("lat"), F.col("lon"), p.catalyst_max_m)

    def points_of(s):
        d = distance_m(F.col("lat"), F.col("lon"), s["clat"], s["clon"])
        span = p.catalyst_max_m - p.catalyst_full_m
        return F.when(d <= p.catalyst_full_m, s["factor"]).when(d >= p.catalyst_max_m, 0.0).otherwise(
            s["factor"] * (p.catalyst_max_m - d) / span)

    j = near.withColumn("_g", F.lit(1)).withColumn("_ys", y).withColumn("_xs", x).join(idx, ["_g", "_ys", "_xs"], "left")
    best = F.coalesce(F.array_max(F.transform("_cs", points_of)), F.lit(0.0))
    return j.select("zone", "distance_m", F.when(F.col("distance_m").isNotNull(), best).alias("catalyst"))


def geometry_coverage(zones: DataFrame, blocks: DataFrame) -> DataFrame:
    """Counts of zones with a shape, without one, and without any assigned block."""
    have = blocks.groupBy("zone").agg(F.count_if(F.col("has_shape")).alias("shapes"))
    j = zones.select("zone").distinct().join(have, "zone", "left")
    return j.agg(F.count("*").alias("zones"), F.count_if(F.col("shapes") > 0).alias("with_shape"),
                 F.count_if(F.coalesce("shapes", F.lit(0)) == 0).alias("without_shape"),
                 F.count_if(F.col("shapes").isNull()).alias("without_blocks"))
