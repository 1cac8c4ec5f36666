"""Token ids in training order as fixed-stride binary shards (operator 3).

Documents become sequences of ``SEQUENCE`` tokens (a closing id after each document, the last
sequence of a document padded). The sequences are counted per input partition, which gives every
sequence a dense number; a keyed Feistel permutation over the next even power of two, walked along
its cycle until it falls below the number of sequences, turns the number into the sequence's slot
in training order. Slots are dealt to shards by range, sorted, and written by Spark's own text
writer, so a lost task leaves no half shard: a record has a header of 16 bytes (doc_id, piece,
length), the padded ids (unsigned 16-bit, little-endian) and a line break as guard, always
``STRIDE`` bytes. Slot s is record s % SHARD of shard s // SHARD, so a reader that stopped after
any slot seeks to the next one; ``read_from`` skips whole shards by their folder.

Tokens are found twice, once to count and once to write, instead of keeping a copy of all ids.
Both passes must see the same partitions: ``docs`` has to be a table that is read, not a plan
with a shuffle. A partition that differs between the passes ends the job with an error.

Defined results: null text is the empty text (one sequence: the closing id); a special token's string
inside a text is ordinary text; null doc_id is
written as the least long; repeated rows are written as often; an empty table writes no shard;
other columns are ignored. The vocabulary must have at most 65,536 ids.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lares.llm.common import bounded_batches
from lares.llm.tokens import default_vocabulary, rank_encoder
from lares.session import shared_dir

SEQUENCE, CLOSING, HEADER = 256, 50_256, 16
CLOSING_ID = np.array([CLOSING], dtype="<u2")
STRIDE = HEADER + 2 * SEQUENCE + 1
#: Sequences of a shard; rounds of the permutation.
SHARD, ROUNDS = 16_384, 4
NO_ID = -(1 << 63)


class Feistel:
    """A keyed bijection of 0 ... n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(31)) & self.mask

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ self._round(right, k)
        return right << np.uint64(self.half) | left  # halves swapped, so that the same walk with reversed keys undoes it

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        x = self._once(x.astype(np.uint64), keys)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


def _sequences(n_ids: int) -> int:
    return -(-n_ids // SEQUENCE)


def write(docs: DataFrame, folder: str, key: int = 1, vocabulary: str | None = None) -> int:
    """Write the shards under ``folder``; the number of sequences."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or default_vocabulary("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def texts(b):
        return [t or "" for t in b.column(1).to_pylist()]

    def count(batches):
        from pyspark import TaskContext

        encode, n = rank_encoder(path), 0
        for b in batches:
            n += sum(_sequences(len(encode(t)) + 1) for t in texts(b))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], names=["part", "n"])

    counted = sorted((r["part"], r["n"]) for r in rows.mapInArrow(count, "part long, n long").collect())  # one row per partition
    first, total = {}, 0
    for part, n in counted:
        first[part] = (total, n)
        total += n
    if not total:
        return 0
    order = Feistel(total, key)

    def records(batches):
        from pyspark import TaskContext

        encode = rank_encoder(path)
        part = TaskContext.get().partitionId()
        number, due = first[part]
        due += number
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                short = np.append(encode(text).astype("<u2"), CLOSING_ID).tobytes()
                head = np.int64(NO_ID if doc_id is None else doc_id).tobytes()
                for piece, start in enumerate(range(0, len(short), 2 * SEQUENCE)):
                    s = short[start : start + 2 * SEQUENCE]
                    out.append(head + piece.to_bytes(4, "little") + (len(s) // 2).to_bytes(4, "little") + s)
            slots = order.slots(np.arange(number, number + len(out)))
            number += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(out, pa.binary())], names=["slot", "record"])
        if number != due:
            raise RuntimeError("the partitions of the table changed between counting and writing")

    found = rows.mapInArrow(records, "slot long, record binary").withColumn("shard", F.expr(f"slot div {SHARD}"))
    n_shards = -(-total // SHARD)
    padded = F.rpad("record", STRIDE - 1, F.lit(b"\0"))
    dealt = found.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot")
    dealt.select("shard", padded.cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(folder)
    return total


def read_from(spark: SparkSession, folder: str, slot: int = 0) -> DataFrame:
    """slot, doc_id, piece, ids from ``slot`` on: whole shards before it aren't opened, records before it are skipped by position."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    shard = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long")
    at = files.select(shard.alias("shard"), "content").where(F.col("shard") >= slot // SHARD)

    def run(batches):
        for b in batches:
            for s, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), dtype=np.uint8)
                if len(data) % STRIDE:
                    raise RuntimeError(f"shard {s} does not consist of whole records")
                begin = max(0, slot - s * SHARD)
                rec = data.reshape(-1, STRIDE)[begin:]
                head = np.ascontiguousarray(rec[:, :HEADER])
                length = head[:, 12:16].copy().view("<u4")[:, 0]
                body = np.ascontiguousarray(rec[:, HEADER:-1]).view("<u2")
                ids = head[:, :8].copy().view("<i8")[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(s * SHARD + begin, s * SHARD + begin + len(rec))), pa.array(ids, mask=ids == NO_ID), pa.array(head[:, 8:12].copy().view("<i4")[:, 0]),
                     pa.array([r[:n].tobytes() for r, n in zip(body, length, strict=True)], pa.binary())], names=["slot", "doc_id", "piece", "ids"])

    return at.mapInArrow(run, "slot long, doc_id long, piece int, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """slot, doc_id, piece, length, ids_crc32 (of 16-bit ids) read back from the shards."""

    def run(batches):
        for b in batches:
            ids = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())],
                                             names=["slot", "doc_id", "piece", "length", "ids_crc32"])

    return read_from(spark, folder).mapInArrow(run, "slot long, doc_id long, piece int, length long, ids_crc32 long")
