"""Phrase collocations by dynamic itemset counting (operator 12).

Phrases of up to ``LONGEST`` words are counted while the shards of the corpus are scanned in a
cycle. All words are counted from the first shard on. A longer phrase becomes active at the next
shard border after both of its subphrases (without the last word, without the first) have reached
the threshold, and is counted until every shard has been seen since, so lengths interleave and
scans end one cycle after the last phrase has reached the threshold.

How Spark does it:

* Texts are read once and written as word hashes, by shard; a scan reads one shard's folder. The
  words themselves go to a dictionary table that only the result meets; their hashes are Spark's
  ``xxhash64``, so the dictionary does without them.
* Which phrases have reached the threshold, and when, is a table of ``SLOTS`` bytes that is
  broadcast whatever the corpus; a slot holds the last step of the phrases that share it. So a task
  counts each phrase that is active, and perhaps some that aren't. A phrase carries the set of
  shards that have counted it and takes no shard twice, so that every count is exact: what should
  be active is counted in all shards, and what shouldn't can't reach the threshold.
* A task hands on counts of distinct phrases, packed by bucket of phrases. A bucket is a range of
  names, so the distances between its names shrink as buckets multiply. Buckets merge them with
  what they have; phrases that complete their cycle below the threshold are dropped.

Phrases are named by 64-bit hashes while they are counted. Scores are integers in 38-digit
decimals, so they are exact.

Defined results: null texts are empty; a null lang is ``und`` and shares its counts with that name;
repeated rows count as often; null doc_ids take part; texts without words add nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lares.llm.common import WordHashes, bounded_batches
from lares.session import cut, shared_dir, shuffles_dropped

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Shards of a cycle (at most 8), bytes of the table of phrases that have reached the threshold.
SHARDS, SLOTS = 3, 1 << 24
#: Words that a task gathers before it hands their counts on; phrases of a bucket.
GATHER, PHRASES_OF_BUCKET = 4_000_000, 2_000_000

_SEED = np.uint64(0x165667B19E3779F9)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHARD_SCHEMA = "lang string, words array<long>, n long, word string, shard int"
_BREAK = b"\xff"
#: Upper case to lower case, ends of pieces to a byte that no UTF-8 text holds, tabs to spaces.
_TABLE = bytes(ord(_BREAK) if chr(i) in ".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else 32 if i == 9 else i for i in range(256))


def pieces(text: str | None) -> list[bytes]:
    """The words of a text with a break behind each piece."""
    return ((text or "").encode().translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ") + b" " + _BREAK).split()


class _Words(WordHashes):
    """Word hashes as ``hash_of`` gives them, none 0; new words are kept until they are taken."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > self.most:
            self.clear()
        value = self[word] = xxh64_intdigest(word, 42) | 1
        self[_BREAK] = 0
        self.new.append(word)
        return value

    def taken(self) -> pa.Array:
        """The new words in order, so that a file holds like words together."""
        words, self.new = sorted(self.new), []
        return pa.array(words, pa.binary()).cast(pa.string())


def hash_of(word: str) -> Column:
    """A word's hash in Spark: ``xxhash64`` begins with 42."""
    return F.xxhash64(word).bitwiseOR(F.lit(1).cast("long"))


def folder_of(docs: DataFrame, shards: int = SHARDS) -> str:
    """Writes lang, words (hashes, 0 between pieces), n by shard, and shard -1: word."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches):
        seen = _Words()
        kinds = {"lang": pa.string(), "words": pa.list_(pa.int64()), "n": pa.int64(), "word": pa.string(), "shard": pa.int32()}

        def rows(size, **columns):
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, kind)) for c, kind in kinds.items()], names=list(kinds))

        def dictionary():
            words = seen.taken()
            return rows(len(words), word=words, shard=pa.array(np.full(len(words), -1, np.int32)))

        for b in batches:
            langs, texts, shard = b.columns
            out = []
            for t in texts.to_pylist():
                w = pieces(t)
                h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
                out.append(h[(h != 0) | np.concatenate(([False], h[:-1] != 0))].view(np.int64))  # one break between pieces
            n = [int(np.count_nonzero(x)) for x in out]
            yield rows(len(out), lang=langs.cast(pa.string()), words=pa.array(out, kinds["words"]), n=pa.array(n, pa.int64()), shard=shard)
            if len(seen.new) > seen.most:
                yield dictionary()
        if seen.new:
            yield dictionary()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(shards)).cast("int").alias("shard"))
    path = f"{shared_dir(spark)}/lares-phrases-{uuid.uuid4().hex}"
    rows.mapInArrow(run, _SHARD_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.dictionary.page.size", 4 << 20).partitionBy("shard").parquet(path)
    return path


def _lang_seed(lang: str) -> np.uint64:
    from xxhash import xxh3_64_intdigest

    return np.uint64(xxh3_64_intdigest(lang.encode()))


def phrase_keys(words: np.ndarray, seeds: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the phrases of 1, 2, ... words that begin at every place (whatever they run across)."""
    keys, x = [], seeds ^ _SEED
    for k in range(longest):
        n = max(len(words) - k, 0)
        x = (x[:n] + words[k:]) * _A
        x ^= x >> np.uint64(29)
        x *= _B
        x ^= x >> np.uint64(32)
        keys.append(x)
    return keys


def phrase_keys_of(words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Names of the beginnings of phrases [phrase][word]; the last is the phrase's own."""
    n, k = words.shape
    flat = phrase_keys(words.ravel(), np.repeat(seeds, k), k) if n else []
    return np.stack([flat[j][::k][:n] if n else np.empty(0, np.uint64) for j in range(k)], 1)


def _joined(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows of a batch (lang, words) behind one another, a break behind each, and the seed of each one's language."""
    flat = b.column(1).flatten().to_numpy().view(np.uint64)
    lens = np.diff(b.column(1).offsets.to_numpy())
    seeds = {x: _lang_seed(x) for x in set(b.column(0).to_pylist())}
    seed = np.repeat(np.array([seeds[x] for x in b.column(0).to_pylist()], np.uint64), lens + 1)
    out = np.zeros(len(flat) + len(lens), np.uint64)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)] = flat
    return out, seed


def _active(words: np.ndarray, keys: list[np.ndarray], reached: np.ndarray, step: int, shards: int, levels: list[int]):
    """(length, places) of the phrases to count in a step; a slot holds the first step in which longer phrases may count."""
    inside = words != 0
    for k in range(1, LONGEST + 1):
        if k > 1:
            n = max(len(words) - k + 1, 0)
            inside = inside[:n] & (words[k - 1 :] != 0)
        if k not in levels:
            continue
        at = np.flatnonzero(inside)
        if k > 1:
            left, right = (reached[keys[k - 2][at + d] & np.uint64(len(reached) - 1)] for d in (0, 1))
            since = np.maximum(left, right).astype(np.int64)
            at = at[(left > 0) & (right > 0) & (step < since + shards)]
        yield k, at


#: A phrase of a bucket: name, count, shards that have counted it, first step, length.
_STATE = np.dtype([("key", "u8"), ("n", "i8"), ("shards", "u1"), ("first", "u1"), ("k", "u1")])


def packed(s: np.ndarray) -> bytes:
    """Phrases in the order of their names, byte by byte of the distances between names and of each field, in zstd: Spark's shuffle codec finds repeats only, and fields are few bits without repeats."""
    gaps = np.diff(s["key"], prepend=np.uint64(0))
    data = b"".join(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(s), x.itemsize).T).tobytes() for x in (gaps, s["n"], s["shards"], s["first"], s["k"]))
    return len(s).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(blob: pa.Buffer) -> np.ndarray:
    size = int.from_bytes(blob.slice(0, 8).to_pybytes(), "little")
    data = np.frombuffer(pa.decompress(blob.slice(8), size * _STATE.itemsize, "zstd"), np.uint8).reshape(_STATE.itemsize, size)
    s = np.empty(size, _STATE)
    field = lambda a, kind: np.ascontiguousarray(data[a : a + 8].T).view(kind).ravel()
    s["key"], s["n"], s["shards"], s["first"], s["k"] = np.cumsum(field(0, np.uint64), dtype=np.uint64), field(8, np.int64), data[16], data[17], data[18]
    return s


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of names, in their order."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _sent(spark: SparkSession, reached: np.ndarray) -> Broadcast:
    """The table as a broadcast: SLOTS bytes at most, far fewer while most are 0."""
    return spark.sparkContext.broadcast(zlib.compress(reached.tobytes(), 1))


def _received(sent: Broadcast) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sent.value), np.uint8)


def counted_step(shard: DataFrame, state: DataFrame | None, sent: Broadcast, slots: int, step: int, shards: int, levels: list[int], buckets: int, least: int) -> DataFrame:
    """bucket, blob (phrases so far), fresh (slot and length of the phrases that reach ``least`` in this step). To be written."""

    def scan(batches):
        held, size, reached = [], 0, _received(sent)

        def out():
            key, k, which = np.concatenate([x for x, _, _ in held]), np.concatenate([np.full(len(x), k, np.uint8) for x, k, _ in held]), np.concatenate([n for _, _, n in held])
            order = np.argsort(key, kind="stable")
            key, k, n = key[order], k[order], which[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            state = np.zeros(len(start), _STATE)
            state["key"], state["k"], state["n"], state["shards"], state["first"] = key[start], k[start], np.add.reduceat(n, start), 1 << step % shards, step
            edges = np.searchsorted(bucket_of(state["key"], buckets), np.arange(buckets + 1))
            some = [(i, packed(state[a:b])) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            words, seeds = _joined(b)
            keys = phrase_keys(words, seeds, max(levels))
            for k, at in _active(words, keys, reached, step, shards, levels):
                if len(at):
                    key, n = np.unique(keys[k - 1][at], return_counts=True)
                    held.append((key, k, n))
            size += len(words)
            if size > GATHER and held:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def merge(batches):
        """One bucket or more: phrases of this step joined with those before it."""
        by: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by.setdefault(bucket, []).append(unpacked(blob.as_buffer()))
        for bucket in list(by):
            s = np.concatenate(by.pop(bucket))
            s = s[np.lexsort((s["first"], s["key"]))]
            new = (s["first"] == step) & (s["shards"] == 1 << step % shards)  # just counted; older rows of the phrase come first
            start = np.flatnonzero(np.concatenate(([True], s["key"][1:] != s["key"][:-1])))
            which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(s))))
            old = np.where(new[start], 0, s["n"][start])
            had = np.where(new[start], 0, s["shards"][start])
            add = np.bincount(which, weights=np.where(new, s["n"], 0), minlength=len(start)).astype(np.int64)
            twice = (had & (1 << step % shards)) > 0
            out = s[start]
            out["n"] = old + np.where(twice, 0, add)
            out["shards"] = had | np.where(add > 0, 1 << step % shards, 0)
            fresh = out[(out["n"] >= least) & (old < least)]
            out = out[(out["n"] >= least) | (step < out["first"].astype(np.int64) + shards - 1)]
            marks = (fresh["key"] & np.uint64(slots - 1)).astype(np.int64) * 8 + fresh["k"]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed(out)], pa.binary()), pa.array([np.unique(marks)], pa.list_(pa.int64()))], names=["bucket", "blob", "fresh"])

    rows = shard.select("lang", "words").mapInArrow(scan, "bucket int, blob binary")
    if state is not None:
        rows = rows.unionByName(state.select("bucket", "blob"))
    return rows.repartition(buckets, "bucket").mapInArrow(merge, "bucket int, blob binary, fresh array<long>")


def _entered(table: np.ndarray, slots: DataFrame, value: int) -> None:
    """Enters ``value`` at the ``slots`` (one column). The driver gets a bit map of at most SLOTS bits."""
    slot = slots.toDF("_s")
    words = slot.groupBy(F.shiftright("_s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, (_s % 64)::int))").alias("b")).toArrow()
    bits = np.unpackbits(words.column("b").to_numpy().view(np.uint8), bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(bits)
    table[words.column("w").to_numpy()[row] * 64 + bit] = value


def _mark(reached: np.ndarray, state: DataFrame, step: int) -> set[int]:
    """Enters the phrases that have just reached the threshold; their lengths."""
    fresh = state.select(F.explode("fresh").alias("_f"))
    _entered(reached, fresh.select(F.shiftright("_f", 3)), step + 1)
    return {r["k"] for r in fresh.select((F.col("_f") % 8).alias("k")).distinct().collect()}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def counts(spark: SparkSession, folder: str, words: int, shards: int = SHARDS, least: int = LEAST, slots: int = SLOTS) -> DataFrame:
    """key, k, n of every phrase that occurs ``least`` times or more in its language."""
    reached = np.zeros(slots, np.uint8)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // PHRASES_OF_BUCKET))
    shard_of = lambda t: spark.read.schema(_SHARD_SCHEMA).parquet(folder).where(F.col("shard") == t % shards)
    last, state, step = {}, None, 0
    while True:
        levels = [k for k in range(1, LONGEST + 1) if (step < shards if k == 1 else k - 1 in last and step <= last[k - 1] + shards)]
        if not levels:
            break
        sent = _sent(spark, reached)
        step_folder = f"{folder}-states/{step}"
        next_state = counted_step(shard_of(step), state, sent, slots, step, shards, levels, buckets, least)
        with shuffles_dropped(spark):
            next_state.write.option("compression", "zstd").parquet(step_folder)
        sent.destroy()  # what it was for is written
        state = spark.read.schema(next_state.schema).parquet(step_folder)
        if step:
            _delete(spark, f"{folder}-states/{step - 1}")  # nothing reads it any more
        for k in _mark(reached, state, step):
            last[k] = step
        step += 1

    def unpack(batches):
        for b in batches:
            for blob in b.column(0):
                s = unpacked(blob.as_buffer())
                s = s[s["n"] >= least]
                yield pa.RecordBatch.from_arrays([pa.array(s["key"].view(np.int64) if len(s) else np.empty(0, np.int64)), pa.array(s["k"].astype(np.int32)), pa.array(s["n"].astype(np.int64))], names=["key", "k", "n"])

    return state.select("blob").mapInArrow(unpack, "key long, k int, n long")


def _occurring(shard: DataFrame, sent: Broadcast, parts: int) -> DataFrame:
    """key, lang, k, words, left, right of the phrases of two words or more whose slot is taken: word hashes, names of all beginnings and all ends. Distinct by key."""

    def find(batches):
        seen, wanted = np.empty(0, np.uint64), _received(sent)
        for b in batches:
            words, seeds = _joined(b)
            keys = phrase_keys(words, seeds, LONGEST)
            inside, rows = words != 0, []
            for k in range(2, LONGEST + 1):
                n = max(len(words) - k + 1, 0)
                inside = inside[:n] & (words[k - 1 :] != 0)
                at = np.flatnonzero(inside)
                at = at[wanted[keys[k - 1][at] & np.uint64(len(wanted) - 1)] > 0]
                key, first = np.unique(keys[k - 1][at], return_index=True)
                new = ~np.isin(key, seen)
                at, key = at[first[new]], key[new]
                row = np.zeros((len(at), LONGEST + 2), np.uint64)
                row[:, 0], row[:, 1] = key, seeds[at]
                for j in range(k):
                    row[:, 2 + j] = words[at + j]
                rows.append(row)
            row = np.concatenate(rows)
            seen = np.union1d(seen if len(seen) < GATHER else seen[:0], row[:, 0])
            bucket = ((row[:, 0] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(parts + 1))
            some = [(i, row[order[x:y]].tobytes()) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["bucket", "blob"])

    def once(batches):
        seen = np.empty(0, np.uint64)
        for b in batches:
            row = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, LONGEST + 2) for x in b.column(1)])
            key, first = np.unique(row[:, 0], return_index=True)
            row = row[first[~np.isin(key, seen)]]
            seen = np.union1d(seen, key)
            out = []
            length = np.count_nonzero(row[:, 2:], axis=1)
            for k in range(2, LONGEST + 1):
                r = row[length == k]
                ends = [phrase_keys_of(r[:, 2 + j : 2 + k], r[:, 1]) for j in range(k)]
                left, right = np.stack([ends[0][:, j] for j in range(k - 1)], 1), np.stack([ends[j][:, -1] for j in range(1, k)], 1)
                out.append((r, k, left, right))
            cols = [[x for r, *_ in out for x in r[:, 0].view(np.int64).tolist()], [x for r, *_ in out for x in r[:, 1].view(np.int64).tolist()], [k for r, k, *_ in out for _ in r],
                    [x for r, k, *_ in out for x in r[:, 2 : 2 + k].view(np.int64).tolist()], [x for *_, le, _ in out for x in le.view(np.int64).tolist()], [x for *_, ri in out for x in ri.view(np.int64).tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3), strict=True)], names=["key", "seed", "k", "words", "left", "right"])

    found = shard.select("lang", "words").mapInArrow(find, "bucket int, blob binary")
    return found.repartition(parts, "bucket").mapInArrow(once, "key long, seed long, k int, words array<long>, left array<long>, right array<long>")


def phrases(spark: SparkSession, folder: str, frequent: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """key, seed, k, words, left, right, a of the phrases of ``frequent`` (key, k, n) with two words or more.

    A frequent phrase nearly always occurs in the first shard; the others are looked through only for what is still missing.
    """
    missing, found = cut(frequent.where("k > 1").select("key", F.col("n").alias("a"))), None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for t in range(shards):
        if found is not None and missing.isEmpty():
            break
        wanted = np.zeros(slots, np.uint8)
        _entered(wanted, missing.select(F.col("key").bitwiseAND(F.lit(slots - 1))), 1)
        sent = _sent(spark, wanted)
        shard = spark.read.schema(_SHARD_SCHEMA).parquet(folder).where(F.col("shard") == t)
        here = cut(_occurring(shard, sent, parts).join(missing, "key"))
        sent.destroy()
        found = here if found is None else found.unionByName(here)
        missing = cut(missing.join(here.select("key"), "key", "left_anti"))
    return found


def _seeds(batches):
    for b in batches:
        seeds = [int(_lang_seed(x).view(np.int64)) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seeds, pa.int64())], names=["lang", "seed"])


def mined(docs: DataFrame, shards: int = SHARDS, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best collocations."""
    spark = docs.sparkSession
    folder = folder_of(docs, shards)
    everything = spark.read.schema(_SHARD_SCHEMA).parquet(folder)
    total = cut(everything.where("shard >= 0").groupBy("lang").agg(F.sum("n").alias("n")))
    words = total.agg(F.sum("n")).first()[0] or 0
    frequent = cut(counts(spark, folder, words, shards, least))
    # languages are few; their names are hashed once to meet the seeds
    seeds = total.select("lang").mapInArrow(_seeds, "lang string, seed long")
    found = cut(phrases(spark, folder, frequent, shards).join(seeds, "seed").drop("seed"))
    # a phrase goes when one that is longer by a word occurs as often; longer ones can't without such a one between
    longer = found.where("k > 2").select(F.explode(F.array(F.element_at("left", -1), F.element_at("right", 1))).alias("key"), "a").groupBy("key").agg(F.max("a").alias("_longer"))
    kept = cut(found.join(longer, "key", "left").where("_longer IS NULL OR 100 * a > 100 * _longer").select("key", "lang", "words", "a", "left", "right"))
    cuts = kept.select("key", "lang", "a", F.posexplode(F.arrays_zip("left", "right")).alias("_j", "_c")).select("key", "lang", "a", "_j", "_c.left", "_c.right")
    part = lambda name, side: frequent.select(F.col("key").alias(side), F.col("n").alias(name))
    cuts = cuts.join(part("l", "left"), "left").join(part("r", "right"), "right").join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_x", wide("a") * wide("n")).withColumn("_y", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("(1000 * cast(_x AS decimal(34,0))) div cast(_y AS decimal(38,0))"))
    least_cut = cuts.groupBy("key").agg(F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "_j")).alias("_b")).select("key", "_b.*")
    named = kept.select("key", F.posexplode("words").alias("_j", "hash"))
    needed = named.select("hash").distinct()
    dictionary = everything.where("shard = -1").select(hash_of("word").alias("hash"), "word").join(needed, "hash", "left_semi").groupBy("hash").agg(F.min("word").alias("word"))
    phrase = named.join(dictionary, "hash").groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_j", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # at most LONGEST words
    scored = kept.select("key", "lang", "a").join(least_cut, "key").join(phrase, "key")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
