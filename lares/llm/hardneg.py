"""Hard negatives with Four-Russians scoring (operator 13).

Every vector is quantised to integers, and an anchor's score of a row is the integer inner product
of both. Scores are looked up, not multiplied. A row's integers are cut into bit planes (two's
complement), and eight dimensions of one plane are one byte. For an anchor and a group of eight
dimensions a table holds the sums of all 256 subsets of the anchor's eight components, so the byte
of a row indexes the share of these eight dimensions in the plane; planes are added by shifts
(``acc = 2 * acc + share``), the sign plane first and negative. The result is the exact product.

Anchors meet rows in cells: a block of anchors and a shard of rows are one task of bounded size.
Rows of an anchor's label are scored in the first pass, which gives its positives, all others in
the second, where the positives' scores bound the negatives; so each pair is scored once. Per cell
only the best rows leave; the bests of the shards are merged by rank. The anchors are a stated
query set, which meets all rows.

Defined results: rows with a null label, a null vector, or any null or non-finite component, or of
another dimension than most, take no part; a null vec_id takes part as a row that is no anchor and
comes first among equal scores; every row is a row of its own, so rows that share a vec_id are
other rows to each other, and an anchor that occurs twice is reported twice; an anchor without
positives, or a positive without negatives in its range, gives no rows; components so large that
a score passes 64 bits end the job with an error, never with a wrong score; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.session import cut

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is at least LOW and at most HIGH per cent of the positive's.
LOW, HIGH = 50, 95
#: Rows of a shard, anchors of a block; rows and anchors whose partial scores are held at a time.
SHARD, BLOCK, ROWS, ANCHORS = 8192, 2048, 1024, 128

_NO_ID = -(1 << 63)


def quantised(vectors: DataFrame, label: Column) -> DataFrame:
    """r (row number), vec_id, label, q (integers) of the rows that take part. To be written: rows are numbered as they come."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), v.cast("array<double>").alias("v")).where("label IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (dims["d"] if dims else 0))
    return rows.select(F.monotonically_increasing_id().alias("r"), "vec_id", "label", F.transform("v", lambda x: F.floor(SCALE * x)).alias("q"))


def planes_of(q: np.ndarray, planes: int) -> np.ndarray:
    """Bytes [plane][group][row] of integers [row][dimension]: bit d of a byte is the plane's bit of dimension d of the group."""
    n, dims = q.shape
    wide = np.zeros((n, -(-dims // 8) * 8), dtype=np.int64)
    wide[:, :dims] = q
    out = [np.packbits(((wide >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(planes)]
    return np.ascontiguousarray(np.stack(out))


def subset_sums(q: np.ndarray, dtype) -> np.ndarray:
    """Tables [group][byte][anchor] of integers [anchor][dimension]: each sum is a smaller subset's and one component."""
    n, dims = q.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), dtype=dtype)
    wide[:, :dims] = q
    out = np.zeros((groups, 256, n), dtype=dtype)
    for g in range(groups):
        for d in range(8):
            out[g, 1 << d : 2 << d] = out[g, : 1 << d] + wide[:, 8 * g + d]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [row][anchor]."""
    n, anchors = planes.shape[2], tables.shape[2]
    out = np.empty((n, anchors), dtype=tables.dtype)
    for a in range(0, anchors, ANCHORS):
        t = np.ascontiguousarray(tables[:, :, a : a + ANCHORS])
        for i in range(0, n, ROWS):
            here = planes[:, :, i : i + ROWS]
            acc = np.zeros((here.shape[2], t.shape[2]), dtype=tables.dtype)
            for b in range(len(here) - 1, -1, -1):
                share = t[0].take(here[b, 0], axis=0)
                for g in range(1, len(t)):
                    share += t[g].take(here[b, g], axis=0)
                if b == len(here) - 1:
                    np.negative(share, out=acc)
                else:
                    acc += acc
                    acc += share
            out[i : i + ROWS, a : a + ANCHORS] = acc
    return out


def best(score: np.ndarray, ok: np.ndarray, k: int):
    """(column, row) of the ``k`` greatest allowed scores of every column, greatest first, ties by the earlier row."""
    least = np.iinfo(score.dtype).min
    left = np.where(ok, score, least)
    for _ in range(min(k, len(score))):
        row = left.argmax(axis=0)
        column = np.flatnonzero(left[row, np.arange(left.shape[1])] != least)
        if not len(column):
            return
        yield column, row[column]
        left[row[column], column] = least


class _Shard:
    """The rows of a shard in vec_id order, nulls first, with their bit planes."""

    def __init__(self, rows: pd.DataFrame, planes: int):
        ids = rows["vec_id"].astype("Int64").fillna(_NO_ID).astype("int64").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.r, self.label = ids[order], rows["r"].to_numpy()[order], rows["label"].to_numpy()[order]
        q = np.frombuffer(b"".join(rows["q"].tolist()), dtype=np.int64).reshape(len(rows), -1)[order]
        self.planes = planes_of(q, planes)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors`` that meet ``anchors``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, F.col("label") if label is None else label)

    def packed(batches):
        for b in batches:
            q = [np.asarray(x, dtype=np.int64).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(q, pa.binary())], names=["r", "vec_id", "label", "q"])

    reach = F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))
    both = cut(rows.withColumn("reach", reach).withColumn("dims", F.size("q")))
    facts = both.agg(F.count("*").alias("n"), F.max("reach").alias("reach"), F.max("dims").alias("dims"), F.count(F.when(anchors, 1)).alias("anchors")).first()
    greatest = int(facts["reach"] or 0)
    planes = greatest.bit_length() + 1
    bound = 2 * (facts["dims"] or 1) * (greatest + 1) ** 2
    if bound >> 62 and facts["dims"]:
        raise OverflowError("components are too large for exact 64-bit scores")
    dtype = np.int32 if bound < 1 << 31 else np.int64
    shards, blocks = max(1, -(-facts["n"] // SHARD)), max(1, -(-facts["anchors"] // BLOCK))
    kept = cut(both.select("r", "vec_id", "label", "q").mapInArrow(packed, "r long, vec_id long, label int, q binary"))
    base = kept.withColumn("s", F.pmod(F.xxhash64("r"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("s", "b")
    asked = cut(kept.where(anchors).where("vec_id IS NOT NULL").withColumn("b", F.pmod(F.xxhash64("r", F.lit(1)), F.lit(blocks)).cast("int")))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s")

    def found(cell, columns):
        return pd.DataFrame({c: np.concatenate([x[i] for x in cell]) if cell else np.empty(0, dtype=np.int64) for i, c in enumerate(columns)}).astype("int64")

    def same_label(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cell = []
        if len(left) and len(right):
            x = _Shard(left, planes)
            q = np.frombuffer(b"".join(right["q"].tolist()), dtype=np.int64).reshape(len(right), -1)
            ar, labels = right["r"].to_numpy(), right["label"].to_numpy()
            for label in np.unique(labels):
                here, mine = np.flatnonzero(x.label == label), np.flatnonzero(labels == label)
                if len(here):
                    s = scores(subset_sums(q[mine], dtype), x.planes[:, :, here])
                    for column, row in best(s, x.r[here][:, None] != ar[mine][None, :], positives):
                        cell.append((ar[mine[column]], x.ids[here[row]], s[row, column]))
        return found(cell, ["ar", "positive_id", "positive_score"])

    def other_labels(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cell = []
        if len(left) and len(right):
            x = _Shard(left, planes)
            q = np.frombuffer(b"".join(right["q"].tolist()), dtype=np.int64).reshape(len(right), -1)
            ar, labels = right["r"].to_numpy(), right["label"].to_numpy()
            most = right["scores"].map(len).max()
            held = np.full((most, len(right)), -1, dtype=np.int64)  # a negative score bounds nothing: its range is empty
            for j, p in enumerate(right["scores"]):
                held[: len(p), j] = p
            for a in range(0, len(right), ANCHORS):
                part = slice(a, a + ANCHORS)
                for label in np.unique(labels[part]):
                    here, mine = np.flatnonzero(x.label != label), a + np.flatnonzero(labels[part] == label)
                    if not len(here):
                        continue
                    s = scores(subset_sums(q[mine], dtype), x.planes[:, :, here])
                    for j in range(most):
                        p = held[j, mine]
                        low, high = -((-LOW * p) // 100), (HIGH * p) // 100
                        for column, row in best(s, (s >= low) & (s <= high) & (p >= 0), negatives):
                            cell.append((ar[mine[column]], np.full(len(column), j + 1), x.ids[here[row]], s[row, column]))
        return found(cell, ["ar", "j", "negative_id", "negative_score"])

    first = base.cogroup(asked.select("r", "label", "q", "b", everywhere).groupBy("s", "b")).applyInPandas(same_label, "ar long, positive_id long, positive_score long")
    j = F.row_number().over(Window.partitionBy("ar").orderBy(F.desc("positive_score"), "positive_id"))
    pos = cut(first.withColumn("j", j).where(F.col("j") <= positives))
    with_scores = asked.join(pos.groupBy("ar").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "positive_score"))), lambda x: x["positive_score"]).alias("scores")), F.col("r") == F.col("ar"))
    second = base.cogroup(with_scores.select("r", "label", "q", "b", "scores", everywhere).groupBy("s", "b")).applyInPandas(other_labels, "ar long, j long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("ar", "j").orderBy(F.desc("negative_score"), "negative_id"))
    neg = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = neg.join(pos.withColumn("j", F.col("j").cast("long")), ["ar", "j"]).join(asked.select(F.col("r").alias("ar"), F.col("vec_id").alias("anchor_id")), "ar")
    named = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")
