"""Approximate nearest neighbours with a permutation index (operator 2).

A vector is represented by the order of its nearest pivots. The index is cut into shards; each
shard posts its vectors in one inverted file per pivot (vector, place of the pivot in its order).
A query opens the files of its own nearest pivots only and adds up, for every vector found there,
the footrule distance of the two orders (pivots missing from an order count as placed after its
end). The vectors of least footrule are reranked by their exact distance, and the best of all
shards are merged.

Queries meet shards in blocks: a block of queries and a shard are one task of bounded size, so
neither a common vector nor a large query set gathers in one place. Pivots are a bounded sample
(``PIVOTS`` distinct vectors with the smallest hashes); every row is indexed.

Defined results: vectors that are null, all zero, of another dimension than most, or that hold a
null or non-finite component take no part, neither as query nor as candidate; rows that share a
query's vec_id are its own; null vec_ids are candidates with a null name, placed first among equal
distances; repeated rows are candidates as often; with fewer candidates than ``k``, all; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.session import cut

#: Pivots in all, nearest pivots that represent a vector, and the share of a shard that is reranked (at least LEAST vectors).
PIVOTS, NEAREST, RERANK, LEAST = 128, 64, 0.08, 256
#: Vectors of a shard, queries of a block.
SHARD, BLOCK = 8192, 4096


def valid(column: str = "embedding") -> Column:
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(valid())
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (dims["d"] if dims else 0)).withColumnRenamed("embedding", "v")


def pick_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """The ``pivots`` distinct vectors of smallest hash, however often each occurs."""
    h = F.xxhash64("v")
    least = [r["h"] for r in rows.select(h.alias("h")).distinct().orderBy("h").limit(pivots).collect()]
    some = rows.where(h.isin(least)).groupBy(h.alias("h")).agg(F.min("v").alias("v")).orderBy("h").collect()
    return np.array([tuple(r["v"]) for r in some])


def orders(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of every vector, nearest first; equal distances by pivot number."""
    d = (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :nearest]


class InvertedFiles:
    """Postings of one shard: per pivot, the vectors that hold it and its place in their orders."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.m = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.start = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.row, self.place = np.divmod(by, self.m)
        self.n = n

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of a query's order to every vector's; what shares no pivot has the greatest."""
        m = self.m
        out = np.full(self.n, m * (m + 1), dtype=np.int64)
        for at, p in enumerate(query.tolist()):
            here = slice(self.start[p], self.start[p + 1])
            place = self.place[here]
            out[self.row[here]] += np.abs(place - at) - (m - at) - (m - place)
        return out


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, nearest: int, rerank: float, least: int) -> list[tuple[int, int, float]]:
    """(query, vector, distance): the best ``k`` of the shard for every query. Rows of the shard are in vec_id order."""
    m = min(nearest, len(pivots))
    files = InvertedFiles(orders(x, pivots, m), len(pivots))
    most = min(len(x), max(least, k, int(rerank * len(x))))
    out = []
    for qid, v, order in zip(qids.tolist(), q, orders(q, pivots, m), strict=True):
        own = ids == qid
        key = files.footrule(order) * len(x) + np.arange(len(x))
        key[own] = np.iinfo(np.int64).max
        near = np.argpartition(key, most - 1)[:most] if most < len(x) else np.arange(len(x))
        near = np.sort(near[~own[near]])
        d = np.sqrt(((x[near] - v) ** 2).sum(axis=1))
        best = np.argsort(d, kind="stable")[:k]
        out += [(qid, i, s) for i, s in zip(ids[near[best]].tolist(), d[best].tolist(), strict=True)]
    return out


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, pivots: int = PIVOTS, nearest: int = NEAREST, rerank: float = RERANK, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean) for the rows of ``vectors`` that meet ``queries``."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors))
    n, n_queries = rows.count(), rows.where(queries).count()
    chosen = pick_pivots(rows, pivots)
    sent = spark.sparkContext.broadcast(chosen)  # ``pivots`` vectors
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // BLOCK))
    hashed = F.xxhash64("vec_id", "v")
    base = rows.withColumn("s", F.pmod(hashed, F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.where(queries).where("vec_id IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(hashed, F.lit(blocks)).cast("int").alias("qb"),
                                                                   F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("qs"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left = left.assign(_v=left["vec_id"].astype("float64").fillna(-np.inf)).sort_values("_v", kind="stable")
            ids = np.where(np.isneginf(left["_v"]), np.iinfo(np.int64).min, left["vec_id"].fillna(0).astype("int64"))
            order = np.argsort(ids, kind="stable")
            x = np.array(left["v"].tolist(), dtype=np.float64)
            found = search_shard(ids[order], x[order], right["query_id"].astype("int64").to_numpy(), np.array(right["q"].tolist(), dtype=np.float64), sent.value, k, nearest, rerank, least)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    each = base.groupBy("s", "b").cogroup(asked.groupBy("qs", "qb")).applyInPandas(cell, "query_id long, vec_id long, score double")
    named = each.withColumn("vec_id", F.when(F.col("vec_id") != -(1 << 63), F.col("vec_id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", F.asc_nulls_first("vec_id")))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
