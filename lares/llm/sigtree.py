"""Exact n-gram Jaccard join with signature trees (operator 8).

Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of
at least ``PER_CENT`` per cent. The result names each document's component of links. The join is
exact: pruning only removes pairs that can't reach the similarity.

1. *Which documents can have a partner.* Linked sets of sizes a and b share at least three quarters
   of the larger one. So in the shingles' hash order, the first quarter plus an eighth of a set
   holds at least 3/32 of the set that some other such head holds too. Documents below that share
   are out. Only heads are shuffled, as packed postings by shingle; what meets inside a task is
   settled there and sent on as one mark.
2. *Few meetings.* The sets of the others are ordered by rising document frequency; two linked
   sets share a shingle within their first quarter plus one (prefix filter). Frequent shingles come
   last, so passages that many documents share bring only documents together that consist of them.
   Shingles with the same documents are one group.
3. *Uniform nodes.* Every document is compared with three leaders of its groups (linear in the
   group), and what links becomes one class.
4. *Signature trees.* The documents of a group, cut into blocks by size class and salt, are leaves
   of a tree whose nodes hold the OR of the leaves' token bitmaps, the range of sizes and the class
   if it is one. Two trees are traversed together, level by level; a pair of nodes is dropped when
   its sizes can't match, when all leaves are of one class, or when the bitmaps leave too small a
   maximum overlap. Only leaves with a pair left get their whole sets; the cell is traversed again and
   verifies pairs of classes that aren't joined yet, so it gives fewer edges than it has leaves. A pair
   that meets in several groups is the smallest one's, as far as both leaves show their groups.

Equal sets (exact copies) are one node from the start, so copies never meet.

Defined results: null and empty texts and texts without words have no shingles and link with
nothing, not even each other; a text of fewer words than a shingle is one shingle; repeated rows
and rows sharing a doc_id are separate rows of the result; the smallest non-null doc_id names a
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.llm.common import bounded_batches
from lares.operators.graph import components
from lares.session import cut

WORDS, PER_CENT = 5, 75
#: Bits of a signature, children of a tree node, leaves and tokens of a block, tokens by which a leaf shows its groups.
BITS, FANOUT, BLOCK, BLOCK_TOKENS, SHOWN = 2048, 8, 2048, 2_000_000, 16
#: Bits of the filter that spares documents without partner a second computation; the exact join follows.
FILTER_BITS = 1 << 24
#: Head shingles that a task gathers before it hands them on; documents among them are numbered in 16 bits.
HELD_TOKENS, MARK = 2_000_000, 0xFFFF
#: Word hashes remembered per worker.
CACHE = 500_000

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes (signed 64-bit) of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=WORDS)], dtype=np.uint64).view(np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    s = h[:n] * _MULTIPLIERS[0]
    for j in range(1, WORDS):
        s += h[j : j + n] * _MULTIPLIERS[j]
    s ^= s >> np.uint64(31)
    s *= _MULTIPLIERS[1]
    s ^= s >> np.uint64(29)
    return np.unique(s.view(np.int64))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _head(n: int) -> int:
    return min(n, n - (PER_CENT * n + 99) // 100 + (n + 7) // 8)


def _packed_heads(first_row: int, n_docs: int, sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Hits of each document within these documents, and the postings for each bucket of tokens.

    A token that several of the documents hold needs no posting of any of them, only one mark that
    it is here, so a token that most documents share is one posting, not thousands.
    """
    tokens = np.concatenate(sets)
    if not len(tokens):
        return np.zeros(n_docs, dtype=np.int64), []
    owner = np.repeat(np.arange(n_docs), [len(s) for s in sets])
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    times = np.diff(np.append(start, len(tokens)))
    several = np.repeat(times > 1, times)
    hits = np.bincount(owner[several], minlength=n_docs)
    tokens, owner = tokens[start], np.where(times > 1, MARK, owner[start]).astype(np.uint16)
    which = tokens % buckets
    order = np.argsort(which, kind="stable")
    tokens, owner = tokens[order], owner[order]
    edges = np.searchsorted(which[order], np.arange(buckets + 1))
    head = np.int64(first_row).tobytes()
    return hits, [(b, head + tokens[i:j].tobytes() + owner[i:j].tobytes()) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]


def heads(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest, hits of every row of ``docs``: how many shingles of the head of its set are in the head of another row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * HELD_TOKENS)))  # a head is a part of its text's shingles, of six bytes or more each
    buckets = 4 * parts
    # rows of two kinds: documents (with a digest), and packed postings or hits of a run of documents that begins at ``base``
    names = ["blob", "base", "row", "doc_id", "n", "digest", "hits"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    schema = "blob binary, base long, row long, doc_id long, n long, digest binary, hits long"

    def cut_up(batches):
        from pyspark import TaskContext

        row, held = TaskContext.get().partitionId() << 40, []

        def out():
            sets = [s for _, s in held]
            n = len(held)
            hits, blobs = _packed_heads(row, n, [s[: _head(len(s))] for s in sets], buckets)
            null = [None] * len(blobs)
            cols = [[x for _, x in blobs] + [None] * n, [row] * (len(blobs) + n), null + list(range(row, row + n)), null + [d for d, _ in held], null + [len(s) for s in sets],
                    null + [_digest(s) for s in sets], null + hits.tolist()]
            bucket = [b for b, _ in blobs] + [(row + i) % buckets for i in range(n)]
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["bucket", *names])

        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((doc_id, shingles(text)))
                size += _head(len(held[-1][1]))
                if size > HELD_TOKENS or len(held) == MARK:
                    yield out()
                    row, held, size = row + len(held), [], 0
        if held:
            yield out()

    def meet(batches):
        """Hits of the tokens of some buckets: one packed row per run of documents."""
        tokens, owners, first = [], [], []
        for b in batches:
            whole = b.filter(b.column(6).is_valid())
            yield pa.RecordBatch.from_arrays(whole.columns[1:], names=names)
            for blob in b.column(1).drop_null():
                data = blob.as_buffer()
                n = (len(data) - 8) // 10
                first.append(np.frombuffer(data, dtype=np.int64, count=1)[0])
                tokens.append(np.frombuffer(data, dtype=np.int64, count=n, offset=8).copy())
                owners.append(np.frombuffer(data, dtype=np.uint16, count=n, offset=8 + 8 * n).copy())
        if tokens:
            sizes = [len(t) for t in tokens]
            t, o, base = np.concatenate(tokens), np.concatenate(owners), np.repeat(np.array(first), sizes)
            order = np.argsort(t)
            t = t[order]
            new = np.concatenate(([True], t[1:] != t[:-1], [True]))
            hit = order[~(new[:-1] & new[1:])]
            hit = hit[o[hit] != MARK]
            order = np.argsort(base[hit], kind="stable")
            runs, at = np.unique(base[hit][order], return_index=True)
            packed = [x.tobytes() for x in np.split(o[hit][order], at[1:])] if len(runs) else []
            none = [pa.nulls(len(runs), k) for k in kinds[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(runs, pa.int64()), *none], names=names)

    def total(batches):
        """All hits of the documents of some runs."""
        hits, docs_of = {}, []
        for b in batches:
            for blob, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if blob is not None:
                    hits[base] = hits.get(base, 0) + np.bincount(np.frombuffer(blob, dtype=np.uint16), minlength=MARK)
            docs_of.append(b.filter(b.column(5).is_valid()))
        for b in docs_of:
            more = [int(hits[base][row - base]) if base in hits else 0 for base, row in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), b.column(5), pa.array(np.array(more, dtype=np.int64) + b.column(6).to_numpy())], names=["doc_id", "n", "digest", "hits"])

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, "bucket int, " + schema)
    met = sent.repartition(parts, "bucket").mapInArrow(meet, schema)
    return met.repartition(parts, "base").mapInArrow(total, "doc_id long, n long, digest binary, hits long")


def candidates(found: DataFrame) -> DataFrame:
    """digest of the sets that may have a partner (equal sets count as partners)."""
    return found.where((F.col("hits") > 0) & (100 * 8 * F.col("hits") >= PER_CENT * F.col("n"))).select("digest").distinct()


def _filter_words(digests: DataFrame) -> np.ndarray:
    """A bit array of fixed size in which a bit of every digest is set."""
    bit = digests.select(F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(FILTER_BITS)).cast("int").alias("_bit"))
    words = bit.groupBy(F.shiftright("_bit", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, _bit % 32))").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 32, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def sets_of(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """node, digest, n, tokens, sig of every distinct set whose digest is in ``digests``. To be written: nodes are numbered as they come."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_words(digests))  # FILTER_BITS / 4 bytes, whatever the input

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if len(s):
                    d = _digest(s)
                    at = int.from_bytes(d[:4], "big") % FILTER_BITS
                    if bits.value[at >> 5] >> (at & 31) & 1:
                        out.append((d, s))
            packed = [np.packbits(np.bincount(s % BITS, minlength=BITS) > 0, bitorder="little").tobytes() for _, s in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in out], pa.binary()), pa.array([len(s) for _, s in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["digest", "n", "tokens", "sig"])

    some = docs.select("text").mapInArrow(run, "digest binary, n long, tokens array<long>, sig binary")
    one = some.dropDuplicates(["digest"]).join(digests, "digest", "left_semi")
    return one.withColumn("node", F.monotonically_increasing_id())


def groups(sets: DataFrame) -> DataFrame:
    """token, node, n, low, high, any: prefix postings of the groups with two sets or more, and three leaders of each."""
    rows = sets.select("node", F.explode("tokens").alias("token"))
    df = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    by_set = rows.join(df, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("_t")).join(sets.select("node", "n"), "node")
    room = F.expr(f"n - ({PER_CENT} * n + 99) div 100 + 1 - (n - size(_t))")  # shingles of one document come first
    posted = by_set.where(room > 0).select("node", "n", F.explode(F.slice("_t", F.lit(1), room.cast("int"))).alias("_p"))
    posted = cut(posted.select("node", "n", F.col("_p.token").alias("token")))
    seen = posted.groupBy("token").agg(
        F.count("*").alias("_c"), F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("node", F.xxhash64("node")).alias("any"),
        F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y")).where("_c > 1")
    one = seen.groupBy("_c", "low", "high", "any", "_x", "_y").agg(F.min("token").alias("token")).select("token", "low", "high", "any")
    return posted.join(one, "token")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the similarity."""
    whole = sets.select("node", "n", "tokens")
    j = pairs.join(whole.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    j = j.join(whole.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return j.select("a", "b", (100 * both >= PER_CENT * (F.col("na") + F.col("nb") - both)).alias("_ok")).where("_ok").select("a", "b")


def leader_pairs(posted: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) distinct: every set with the leaders of its groups, where sizes allow a link."""
    pairs = posted.select("node", "n", F.explode(F.array("low", "high", "any")).alias("b")).where("node <> b")
    pairs = pairs.groupBy(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).agg(F.lit(1).alias("_1"))
    sizes = sets.select("node", "n")
    pairs = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("_na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("_nb")), "b")
    return pairs.where((100 * F.least("_na", "_nb")) >= (PER_CENT * F.greatest("_na", "_nb"))).select("a", "b")


class Tree:
    """Levels of nodes over leaves: level 0 are the leaves, each next level joins FANOUT neighbours."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, cls: np.ndarray):
        pop = np.bitwise_count(sig).sum(axis=1).astype(np.int64)
        self.levels = [(sig, n, n, n - pop, cls)]
        while len(self.levels[-1][1]) > FANOUT:
            sig, low, high, extra, cls = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            first, last = np.minimum.reduceat(cls, at), np.maximum.reduceat(cls, at)
            self.levels.append((np.bitwise_or.reduceat(sig, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at),
                                np.where((first == last), first, -1)))


def _may_link(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs can hold a link of two classes."""
    (sx, lx, hx, ex, cx), (sy, ly, hy, ey, cy) = x, y
    ok = (100 * hx[i] >= PER_CENT * ly[j]) & (100 * hy[j] >= PER_CENT * lx[i]) & ((cx[i] != cy[j]) | (cx[i] < 0))
    i, j = i[ok], j[ok]
    # a common token sets a common bit; tokens beyond a set's bits share one
    most = np.bitwise_count(sx[i] & sy[j]).sum(axis=1).astype(np.int64) + np.minimum(ex[i], ey[j])
    most = np.minimum(most, np.minimum(hx[i], hy[j]))
    ok[ok] = (100 + PER_CENT) * most >= PER_CENT * (lx[i] + ly[j])
    return ok


def traverse(x: Tree, y: Tree, same: bool, chunk: int = 1 << 14):
    """Leaf pairs that may link, by a traversal of both trees at once. ``same``: one tree with itself, each pair once."""
    top = max(len(x.levels), len(y.levels)) - 1
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    i, j = np.divmod(np.arange(len(level(x, top)[1]) * len(level(y, top)[1])), len(level(y, top)[1]))
    stack = [(top, i, j)]
    while stack:
        k, i, j = stack.pop()
        if len(i) > chunk:
            stack += [(k, i[a : a + chunk], j[a : a + chunk]) for a in range(0, len(i), chunk)]
            continue
        if same:
            keep = i <= j if k else i < j
            i, j = i[keep], j[keep]
        ok = _may_link(level(x, k), level(y, k), i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k == 0:
            yield i, j
            continue
        grow = []
        for t, nodes in ((x, i), (y, j)):
            f = FANOUT if k < len(t.levels) else 1  # a lower tree waits at its top
            below = nodes[:, None] * f + np.arange(f)
            grow.append(np.where(below < len(level(t, k - 1)[1]), below, -1))
        a, b = np.broadcast_arrays(grow[0][:, :, None], grow[1][:, None, :])
        good = (a >= 0) & (b >= 0)
        stack.append((k - 1, a[good], b[good]))


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (token, node, n, cls) of each group with the cell of every two blocks that can hold a link: _cell, l, r (of its left, its right block)."""
    rows = rows.withColumn("c", F.floor(F.log("n") / F.log(F.lit(100 / PER_CENT)) + 1e-9).cast("int"))
    # linked sets are of one size class or of two neighbours; classes of a group are cut into salted blocks
    blocks = rows.groupBy("token", "c").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("b"))
    near = lambda d, name: blocks.select("token", (F.col("c") + d).alias("c"), F.col("b").alias(name))
    size = blocks.join(near(-1, "up"), ["token", "c"], "left").join(near(1, "down"), ["token", "c"], "left").na.fill(0, ["up", "down"])
    placed = rows.join(size, ["token", "c"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    cells = F.expr("""concat(
        transform(sequence(0, b - 1), x -> struct(c AS c1, least(k, x) AS k1, c AS c2, greatest(k, x) AS k2)),
        CASE WHEN up > 0 THEN transform(sequence(0, up - 1), x -> struct(c AS c1, k AS k1, c + 1 AS c2, x AS k2)) ELSE array() END,
        CASE WHEN down > 0 THEN transform(sequence(0, down - 1), x -> struct(c - 1 AS c1, x AS k1, c AS c2, k AS k2)) ELSE array() END)""")
    spread = placed.withColumn("_cell", F.explode(cells))
    return spread.withColumn("l", (F.col("c") == F.col("_cell.c1")) & (F.col("k") == F.col("_cell.k1"))).withColumn("r", (F.col("c") == F.col("_cell.c2")) & (F.col("k") == F.col("_cell.k2")))


class _Cell:
    """At most two blocks of leaves of one group, with their trees."""

    def __init__(self, members):
        n, cls = members.field("n").to_numpy(), np.unique(members.field("cls").to_numpy(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(members.field("sig").to_pylist()), dtype=np.uint64).reshape(len(n), -1)
        self.order = np.lexsort((n, cls))
        n, self.cls, sig = n[self.order], cls[self.order], sig[self.order]
        least, many = members.field("least"), members.field("token").to_pylist()
        # the smallest tokens whose groups a leaf is in: a pair is for the group of the smallest that both show
        self.least = [frozenset(x for x in least[i].as_py() if x < many[i]) for i in self.order.tolist()]
        l, r = (members.field(x).to_numpy(zero_copy_only=False)[self.order] for x in "lr")
        self.left, self.right = np.flatnonzero(l), np.flatnonzero(r)
        self.same = bool((l == r).all())
        if len(self.left) and len(self.right):
            x = Tree(sig[self.left], n[self.left], self.cls[self.left])
            self.trees = x, x if self.same else Tree(sig[self.right], n[self.right], self.cls[self.right])

    def pairs(self):
        """Places of leaves that the trees can't rule out and that no smaller group is known to have."""
        if not (len(self.left) and len(self.right)):
            return
        for i, j in traverse(*self.trees, self.same):
            a, b = self.left[i], self.right[j]
            new = np.fromiter((self.least[x].isdisjoint(self.least[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
            yield a[new], b[new]


def _gathered(rows: DataFrame, *more: str) -> DataFrame:
    """token, _cell, m: the leaves of every cell (at most two blocks)."""
    return rows.groupBy("token", "_cell").agg(F.collect_list(F.struct("token", "node", "n", "cls", "sig", "least", "l", "r", *more)).alias("m")).where("size(m) > 1")


def open_leaves(posted: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """token, _cell, node, l, r, least: the leaves of each cell for which some pair of different classes can't be ruled out. At most one row a leaf and cell."""
    rows = posted.select("token", "node", "n").join(classes.withColumnRenamed("component", "cls"), "node")
    mixed = rows.groupBy("token").agg(F.min("cls").alias("_a"), F.max("cls").alias("_b")).where("_a <> _b").select("token")
    rows = rows.join(mixed, "token", "left_semi")
    # rows of a node in one place: its smallest tokens
    least = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("token")), 1, SHOWN).alias("least"))
    spread = _blocks(rows).join(least, "node").join(sets.select("node", "sig"), "node")

    def run(batches):
        for b in batches:
            out = []
            for token, cell, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                c, names = _Cell(m.values), m.values.field("node").to_numpy()
                left, right = np.zeros(len(names), bool), np.zeros(len(names), bool)
                for i, j in c.pairs():
                    left[i] = right[j] = True
                for x in np.flatnonzero(left | right).tolist():
                    y = c.order[x]
                    out.append((token, cell, int(names[y]), bool(left[x] or c.same), bool(right[x] or c.same)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.struct([(f, pa.int32()) for f in ("c1", "k1", "c2", "k2")]), pa.int64(), pa.bool_(), pa.bool_()), strict=True)],
                                             names=["token", "_cell", "node", "l", "r"])

    found = _gathered(spread).mapInArrow(run, "token long, _cell struct<c1: int, k1: int, c2: int, k2: int>, node long, l boolean, r boolean")
    return found.join(least, "node")


def tree_edges(posted: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) distinct: verified links that join all sets of different classes that link. A cell gives fewer edges than it has leaves."""
    left = cut(open_leaves(posted, classes, sets))
    rows = left.join(classes.withColumnRenamed("component", "cls"), "node").join(sets.select("node", "n", "sig", "tokens"), "node")

    def run(batches):
        for b in batches:
            lefts, rights = [], []
            for m in b.column(0):
                c, names, tokens = _Cell(m.values), m.values.field("node").to_numpy(), m.values.field("tokens")
                root = list(range(int(c.cls.max()) + 1))

                def find(x):
                    while root[x] != x:  # noqa: B023
                        root[x] = root[root[x]]  # noqa: B023
                        x = root[x]  # noqa: B023
                    return x

                whole = {}
                for i, j in c.pairs():
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        p, q = find(int(c.cls[x])), find(int(c.cls[y]))
                        if p == q:
                            continue
                        for z in (x, y):
                            if z not in whole:
                                whole[z] = tokens[int(c.order[z])].values.to_numpy()
                        both = len(np.intersect1d(whole[x], whole[y], assume_unique=True))
                        if 100 * both >= PER_CENT * (len(whole[x]) + len(whole[y]) - both):
                            root[p] = q
                            lefts.append(int(names[c.order[x]]))
                            rights.append(int(names[c.order[y]]))
            yield pa.RecordBatch.from_arrays([pa.array(lefts, pa.int64()), pa.array(rights, pa.int64())], names=["p", "q"])

    found = _gathered(rows, "tokens").select("m").mapInArrow(run, "p long, q long")
    return found.groupBy(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).agg(F.lit(1).alias("_1")).select("a", "b")


def links(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (digest, component: a node) of the sets that can have partners, and the verified links between nodes."""
    sets = cut(sets_of(docs, cut(candidates(found))))
    posted = cut(groups(sets))
    nodes = posted.select("node").distinct()
    first = cut(verified(leader_pairs(posted, sets), sets))
    classes = cut(components(nodes, first))
    second = cut(tree_edges(posted, classes, sets))
    edges = first.unionByName(second)
    return components(nodes, edges).join(sets.select("node", "digest"), "node").select("digest", "component"), edges


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    found = cut(heads(docs))
    classes, _ = links(docs, found)
    small = found.select("doc_id", "n", "digest")
    group = F.struct(F.col("component").alias("c"), F.when(F.col("component").isNull(), F.col("digest")).alias("d"))
    named = cut(small.join(classes, "digest", "left").select("doc_id", "n", F.when(F.col("n") > 0, group).alias("_g")))
    least = named.where(F.col("_g").isNotNull()).groupBy("_g").agg(F.min("doc_id").alias("_m"))
    return named.join(least, "_g", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_m", "doc_id").alias("component_id"))
