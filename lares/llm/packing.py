"""Best-fit packing by linear grouping (operator 1).

Lengths are bounded by the sequence size, so everything that has to be decided together is a
histogram of at most ``size`` counts, however many documents there are. From the histogram a
plan is made in four steps:

1. the large lengths are sorted and split into few groups of equal cardinality, and every length
   of a group is rounded up to the group's largest;
2. the fractional optimum over configurations (ways to fill a sequence with group sizes) is found
   by column generation, rounded down, and the rest is filled with the fullest configurations;
3. real lengths take the places of their group's size, largest first;
4. small lengths, largest first, go to the fullest sequence that still takes them.

Sequences with the same content are one *run* of the plan, so the plan stays at a few thousand
rows. A plan row says: the pieces of one length with ranks ``r0 ... r1 - 1`` go to sequences from
``bin0`` on, ``per_bin`` in each, from offset ``at``. Ranking the pieces of a length is the only
distributed ordering; it runs per (length, salt) with counted offsets, so a length shared by a
third of all pieces is spread over all tasks.

Defined results: null text is the empty text, whose document is the closing id alone; null or
repeated doc_ids are packed row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lares.llm.common import bounded_batches
from lares.llm.tokens import default_vocabulary, word_encoder
from lares.session import cut

SIZE, CLOSING = 2048, 0
#: Pieces of one length that are ranked by one task.
PER_SALT = 200_000
#: Lengths over ``SIZE // SMALL`` are large; they form one of ``GROUPS`` many groups, whichever gives the fewest sequences.
SMALL, GROUPS = 8, (12, 24, 48, 96)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, r0 long, r1 long, bin0 long, per_bin long, at long"


def pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, closing: int = CLOSING) -> DataFrame:
    """One row per piece of every document: its ids then ``closing``, cut only where longer than ``size``."""
    bounded_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary("word_bpe_49k.json")
    end = closing.to_bytes(4, "little")

    def cut_up(batches):
        encoder = word_encoder(path)
        for b in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode_all([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                for i, start in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[start : start + 4 * size]
                    out.append((doc_id, i, start // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, PIECES)


def _groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count), ...] largest first) per group; groups hold equally many items."""
    total = int(counts.sum())
    out: list[list[tuple[int, int]]] = [[]]
    room = share = -(-total // groups)
    for length, count in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while count:
            take = min(count, room)
            out[-1].append((length, take))
            count, room = count - take, room - take
            if not room:
                out.append([])
                room = share
    merged: dict[int, list[tuple[int, int]]] = {}
    for g in out:
        if g:
            merged.setdefault(g[0][0], []).extend(g)
    return sorted(merged.items(), reverse=True)


def _fullest(sizes: list[int], values: list[float], limits: list[int], size: int) -> tuple[int, ...]:
    """How many of each size give the greatest total value within ``size`` (bounded multiples)."""
    best, taken = np.zeros(size + 1), np.zeros((len(sizes), size + 1), dtype=np.int32)
    for i, (s, v, most) in enumerate(zip(sizes, values, limits, strict=True)):
        top = best.copy()
        for k in range(1, min(most, size // s) + 1):
            with_k = best[: size + 1 - k * s] + k * v
            better = with_k > top[k * s :] + 1e-12
            top[k * s :][better] = with_k[better]
            taken[i, k * s :][better] = k
        best = top
    room, out = size, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = int(taken[i, room])
        room -= out[i] * sizes[i]
    return tuple(out)


def configurations(sizes: list[int], need: list[int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, times): sequences that together have a place for every item of every size."""
    left, plan = list(need), []
    if sizes:
        basis = [tuple(size // s if i == j else 0 for j in range(len(sizes))) for i, s in enumerate(sizes)]
        demand = np.array(need, dtype=float)
        for _ in range(20 * len(sizes)):
            a = np.array(basis, dtype=float).T
            price = np.linalg.solve(a.T, np.ones(len(sizes)))
            new = _fullest(sizes, price.tolist(), [size] * len(sizes), size)
            if float(np.dot(new, price)) <= 1 + 1e-7:
                break
            step, now = np.linalg.solve(a, np.array(new, dtype=float)), np.linalg.solve(a, demand)
            ratios = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
            basis[int(np.argmin(ratios))] = new
        for c, x in zip(basis, np.linalg.solve(np.array(basis, dtype=float).T, demand), strict=True):
            times = int(x + 1e-9)
            times = min([times, *(left[i] // k for i, k in enumerate(c) if k)])
            if times > 0:
                plan.append((c, times))
                left = [n - k * times for n, k in zip(left, c, strict=True)]
    while any(left):
        c = _fullest(sizes, [float(s) for s in sizes], left, size)
        times = min(left[i] // k for i, k in enumerate(c) if k)
        plan.append((c, times))
        left = [n - k * times for n, k in zip(left, c, strict=True)]
    return plan


class _Runs:
    """Runs of sequences with equal content, found by the room they have left."""

    def __init__(self, size: int):
        self.size, self.bins = size, 0
        self.by_room: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, sequences)]
        self.rooms: list[int] = []
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.rank: Counter[int] = Counter()

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def put(self, first: int, n: int, room: int, length: int, each: int, items: int | None = None) -> int:
        """Place ``each`` pieces in each of ``n`` sequences (``items`` in all, if the last gets fewer); the room left."""
        items = n * each if items is None else items
        r0 = self.rank[length]
        self.rows.append((length, r0, r0 + items, first, each, self.size - room))
        self.rank[length] += items
        return room - each * length

    def keep(self, first: int, n: int, room: int) -> None:
        if n and room:
            if room not in self.by_room:
                self.by_room[room] = []
                self.rooms.insert(bisect_left(self.rooms, room), room)
            self.by_room[room].append((first, n))

    def take(self, length: int) -> tuple[int, int, int]:
        """The run with the least room for ``length``; new sequences are opened by the caller if there is none."""
        i = bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return -1, 0, self.size
        room = self.rooms[i]
        first, n = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[i]
        return first, n, room


def plan(histogram: dict[int, int], size: int = SIZE, groups: tuple[int, ...] = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, ...]], int]:
    """Plan rows (see PLAN) and the number of sequences for a histogram of lengths: the best over the numbers of groups."""
    return min((grouped_plan(histogram, size, g, small) for g in groups), key=lambda p: p[1])


def grouped_plan(histogram: dict[int, int], size: int, groups: int, small: int) -> tuple[list[tuple[int, ...]], int]:
    runs = _Runs(size)
    for length, count in list(histogram.items()):
        if length == size:
            runs.put(runs.open(count), count, size, size, 1)
    large = {k: v for k, v in histogram.items() if size // small < k < size}
    grouped = _groups(np.array(list(large), dtype=np.int64), np.array(list(large.values()), dtype=np.int64), groups) if large else []
    sizes, stock = [s for s, _ in grouped], [list(items) for _, items in grouped]
    for c, times in configurations(sizes, [sum(n for _, n in items) for items in stock], size):
        places = [i for i, k in enumerate(c) for _ in range(k)]
        while times:
            # as long as no place runs out of its present length, sequences are alike
            heads = [(i, stock[i][-1]) for i in places]
            n = min([times, *(stock[i][-1][1] // places.count(i) for i in places)])
            single = n == 0
            n = max(n, 1)
            first, room = runs.open(n), size
            if single:
                for i in places:
                    length, have = stock[i][-1]
                    room = runs.put(first, 1, room, length, 1)
                    stock[i][-1] = (length, have - 1)
                    if have == 1:
                        stock[i].pop()
            else:
                for i in dict.fromkeys(places):
                    k, (length, have) = places.count(i), dict(heads)[i]
                    room = runs.put(first, n, room, length, k)
                    stock[i][-1] = (length, have - n * k)
                    if have == n * k:
                        stock[i].pop()
            runs.keep(first, n, room)
            times -= n
    for length in sorted((k for k in histogram if k <= size // small), reverse=True):
        count = histogram[length]
        while count:
            first, n, room = runs.take(length)
            each = room // length
            if first < 0:
                n = -(-count // each)
                first = runs.open(n)
            whole = min(n, count // each)
            if whole:
                runs.keep(first, whole, runs.put(first, whole, room, length, each))
                count -= whole * each
            rest = first + whole
            if whole < n and count:
                runs.keep(rest, 1, runs.put(rest, 1, room, length, count, count))
                rest, count = rest + 1, 0
            runs.keep(rest, first + n - rest, room)
    return runs.rows, runs.bins


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut_pieces`` is read more than once: give a written table."""
    spark = cut_pieces.sparkSession
    total = cut_pieces.groupBy("length").count()  # at most ``size`` rows
    salts = F.ceil(F.col("count") / PER_SALT).cast("int")
    salted = cut_pieces.join(F.broadcast(total.select("length", salts.alias("_salts"))), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).cast("int"))
    counts = salted.groupBy("length", "_salt").count().collect()  # ``size`` rows, and one for every PER_SALT pieces
    histogram: Counter[int] = Counter()
    before = []
    for r in sorted(counts, key=lambda r: (r["length"], r["_salt"])):
        before.append((r["length"], r["_salt"], histogram[r["length"]]))
        histogram[r["length"]] += r["count"]
    rows, _ = plan(dict(histogram), size)
    offsets = spark.createDataFrame(before, "length long, _salt int, _before long")
    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    # few rows: of counted offsets, and of the plan
    ranked = salted.withColumn("_row", F.row_number().over(w)).join(F.broadcast(offsets), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    p = F.broadcast(spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "_length"))
    there = ranked.join(p, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("r0")) & (F.col("_rank") < F.col("r1")))
    k = F.col("_rank") - F.col("r0")
    return there.select(*[F.col(c) for c in cut_pieces.columns], (F.col("bin0") + F.floor(k / F.col("per_bin"))).alias("sequence_id"),
                        (F.col("at") + (k % F.col("per_bin")) * F.col("length")).alias("offset"))


def packed(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    return pack(cut(pieces(docs, vocabulary, size)), size)
