"""Previous-row and next-row lookups that stay parallel inside one huge key.

A plain ``lag`` over a key sends the whole key to one task. Here rows are ranked inside
(key, chunk), where the chunk is a slice of the order column (a day), and only one row per
chunk takes part in the lookup across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbour(df: DataFrame, key: list[str], chunk: Column, order: str, value: Column, name: str, previous: bool = True) -> DataFrame:
    """Adds ``name`` = ``value`` of the previous (or next) row of the key in ``order``.

    ``order`` must be unique within the key. ``value`` must be a struct, so that a missing
    neighbour (NULL) differs from a neighbour whose fields are NULL.
    """
    d = df.withColumn("_chunk", chunk).withColumn("_val", value)
    inside = Window.partitionBy(*key, "_chunk").orderBy(order)
    shift = F.lag if previous else F.lead
    d = d.withColumn("_near", shift("_val").over(inside))
    edge = (F.max_by if previous else F.min_by)("_val", order)
    edges = d.groupBy(*key, "_chunk").agg(edge.alias("_edge"))
    across = Window.partitionBy(*key).orderBy("_chunk")
    edges = edges.withColumn("_far", shift("_edge").over(across)).drop("_edge")
    return (
        d.join(edges, [*key, "_chunk"])
        .withColumn(name, F.coalesce("_near", "_far"))
        .drop("_chunk", "_val", "_near", "_far")
    )
