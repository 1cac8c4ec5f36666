"""Range questions over sorted positions, without pairing questions and positions.

Counts and sums of a range are differences of running sums. Order statistics of the values in a
range come from a hierarchy: positions are numbered, every aligned run of 1, 2, 4, ... positions is
a node, and a range of k positions is at most ``2 log2(k)`` nodes. So a question costs its nodes,
however many positions (sizes with two decimals, say) its range holds.

Running sums carry a step of the position in their key: rows are added up inside a step, and only
one row per step meets the others of its group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.operators.quantiles import _COARSE, _finish, _pick, value_bucket
from lares.session import cut

#: Counted rows per step where positions are ranks.
RANKS = 1 << 16


def _running(cells: DataFrame, asks: DataFrame, group: list[str], qid: list[str], values: list[str], step: float, keep_greatest: bool = False) -> DataFrame:
    """``values`` added up (or their greatest) over the cells up to each row. Both inputs: group, _x, _o (order at equal _x), values; ``asks`` also qid and _e (the question's name)."""
    kinds = dict(asks.dtypes)
    cells = cells.select(*group, "_x", F.lit(1).alias("_o"), *values, *[F.lit(None).cast(kinds[c]).alias(c) for c in [*qid, "_e"]])
    zero = F.lit(None if keep_greatest else 0)
    asks = asks.select(*group, "_x", "_o", *[zero.cast(dict(cells.dtypes)[c]).alias(c) for c in values], *qid, "_e")
    both = cells.unionByName(asks).withColumn("_c", F.floor(F.col("_x") / step))
    total = F.max if keep_greatest else F.sum
    inside = Window.partitionBy(*group, "_c").orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    steps = both.groupBy(*group, "_c").agg(*[total(c).alias(f"_t_{c}") for c in values])
    steps = steps.select(*group, "_c", *[total(f"_t_{c}").over(before).alias(f"_b_{c}") for c in values])
    rows = both.select(*group, "_x", "_c", *qid, "_e", *values, *[total(c).over(inside).alias(f"_i_{c}") for c in values]).join(steps, [*group, "_c"])
    joined = (lambda c: F.coalesce(f"_i_{c}", f"_b_{c}")) if keep_greatest else (lambda c: F.col(f"_i_{c}") + F.coalesce(f"_b_{c}", F.lit(0)))
    return rows.select(*group, "_x", *qid, "_e", *[F.col(c).alias(f"_own_{c}") for c in values], *[joined(c).alias(c) for c in values])


def _asked(queries: DataFrame, group: list[str], qid: list[str], edges: dict[str, tuple[Column, bool]]) -> DataFrame:
    each = [F.struct(x.cast("double").alias("_x"), F.lit(2 if inclusive else 0).alias("_o"), F.lit(name).alias("_e")) for name, (x, inclusive) in edges.items()]
    return queries.select(*group, *qid, F.explode(F.array(*each)).alias("_a")).select(*group, *qid, "_a._x", "_a._o", "_a._e")


def _wide(rows: DataFrame, keys: list[str], names, values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("_e") == n, F.struct(*values))).alias(n) for n in names])


def running_sums(cells: DataFrame, queries: DataFrame, group: list[str], qid: list[str], position: str, sums: list[str], edges: dict[str, tuple[Column, bool]], step: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(queries with a struct per edge, cells in order).

    An edge is (position, inclusive): its struct holds ``sums`` over the cells before it and ``rank``,
    their number. The cells come back with ``rank`` (from 0) and ``start`` (the first sum before them).
    ``position`` is distinct within a group.
    """
    c = cells.select(*group, F.col(position).cast("double").alias("_x"), *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in sums], F.lit(1).cast("long").alias("rank"))
    rows = cut(_running(c, _asked(queries, group, qid, edges), group, qid, [*sums, "rank"], step))
    ordered = rows.where("_e IS NULL").select(*group, F.col("_x").alias(position), (F.col("rank") - 1).alias("rank"), (F.col(sums[0]) - F.col(f"_own_{sums[0]}")).alias("start"), F.col(f"_own_{sums[0]}").alias(sums[0]))
    return _wide(rows.where("_e IS NOT NULL"), [*group, *qid], edges, [*sums, "rank"]), ordered


def positions_at(ordered: DataFrame, queries: DataFrame, group: list[str], qid: list[str], position: str, ranks: dict[str, Column]) -> DataFrame:
    """Queries with a column per entry of ``ranks``: the position of the counted row of that number in its group."""
    first = ordered.columns[-1]
    c = ordered.where(F.col(first) > 0).select(*group, F.col("start").cast("double").alias("_x"), F.col(position).cast("double").alias("_v"))
    rows = _running(c, _asked(queries, group, qid, {n: (r, True) for n, r in ranks.items()}), group, qid, ["_v"], RANKS, keep_greatest=True)
    wide = _wide(rows.where("_e IS NOT NULL"), [*group, *qid], ranks, ["_v"])
    return wide.select(*group, *qid, *[F.col(f"{n}._v").alias(n) for n in ranks])


def nodes_of(queries: DataFrame, low: str, high: str) -> DataFrame:
    """A row per node of the range ``low`` to below ``high`` of ranks: ``_node``."""
    a, b, level = F.col(low).cast("long"), F.col(high).cast("long"), F.col("_level")
    some = queries.where(a < b).withColumn("_level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(b - a + 1)).cast("int"))))
    left, right = F.expr(f"shiftright({low} + shiftleft(1L, _level) - 1, _level)"), F.expr(f"shiftright({high}, _level)")
    some = some.withColumn("_l", left).withColumn("_r", right).where("_l < _r")
    odd = lambda c: F.col(c) % 2 == 1
    two = F.array(F.when(odd("_l"), F.col("_l")), F.when(odd("_r") & (F.col("_r") - 1 >= F.col("_l") + F.col("_l") % 2), F.col("_r") - 1))
    return some.withColumn("_n0", F.explode(F.filter(two, lambda x: x.isNotNull()))).withColumn("_node", F.col("_n0") * 64 + level).drop("_level", "_l", "_r", "_n0")


def _rolled(rows: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Counts ``_n`` of rows with a ``rank``, for every node that holds the rank."""
    up = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return up.withColumn("_node", F.expr("shiftright(rank, _level)") * 64 + F.col("_level")).groupBy(*keys, "_node").agg(F.sum("_n").alias("_n"))


def range_quantiles(ranges: DataFrame, freq: DataFrame, group: list[str], query: list[str], specs: dict) -> DataFrame:
    """Quantiles of the values in ranges of ranks. ``ranges``: group, query, low, high; ``freq``: group, rank, _v, _n.

    As for plain groups, counts per value bucket locate the bucket of each wanted rank, and only
    the values of these buckets are read again; here both come from nodes.
    """
    keys = [*group, *query]
    freq = freq.withColumn("_b", value_bucket(F.col("_v"), _COARSE))
    widest = ranges.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 1
    levels = int(widest).bit_length()
    pieces = cut(nodes_of(ranges, "low", "high").select(*keys, "_node"))
    hist = _rolled(freq.groupBy(*group, "rank", "_b").agg(F.sum("_n").alias("_n")), [*group, "_b"], levels)
    found = pieces.join(hist, [*group, "_node"]).groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    need = cut(_pick(found, keys, specs))
    some = freq.join(need.select(*group, "_b").distinct(), [*group, "_b"], "left_semi")
    values = _rolled(some, [*group, "_b", "_v"], levels)
    rows = need.join(pieces, keys).join(values, [*group, "_node", "_b"]).groupBy(*keys, "_b", "_before", "_total", "_v").agg(F.sum("_n").alias("_n"))
    return _finish(rows, keys, specs)


def middle(n: Column) -> tuple[Column, Column]:
    """Numbers of the two middle rows of ``n`` (the same for odd n)."""
    return F.floor((n - 1) / 2), F.ceil((n - 1) / 2)


def joined_on(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)
