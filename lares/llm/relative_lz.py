"""Removal of repeated passages by relative Lempel-Ziv parsing (operator 11).

A word goes when some window of ``WINDOW`` consecutive words covers it whose word sequence also
starts earlier: in a smaller doc_id, or earlier in the same document. Documents are factored
against reference blocks: a factor is a longest piece of a document that stands in the reference
text, and every factor of a window or more is a duplicate span.

1. *Which passages can repeat.* The anchor of a window is the eight-word piece of least hash in it,
   so equal windows have equal anchors, and a text has an anchor about every seven words. Only
   anchors are counted, as packed postings; what meets inside a task is one mark.
2. *Reference blocks.* A block owns the anchors of a hash range, so every text that could match a
   block's reference is factored against it, and no other. Documents with repeated anchors send
   each block the stretches of windows around its anchors, as sequences of window fingerprints.
   Stretches of an anchor that is common (``HOT``) go by window instead, which deals a passage
   that a third of the documents hold to many blocks. Before that, a task factors its documents
   against a block of their own, so that a common passage leaves a task once.
3. *Factors.* A block takes stretches in document order. From the left it looks up the window,
   follows the reference as far as both agree, and emits a factor; a window that is not there
   becomes reference text, so the reference holds each window once, where it first occurs. After a
   factor the parse goes on with the window across its end, so boundaries are checked too.
4. *Removal.* Factors return to their documents packed by run of documents.

Equality of windows is equality of their 64-bit fingerprints inside a block. Partition numbers
follow the counted size of the texts and anchors, so what a task holds does not grow.

Defined results: null and empty texts and texts without words have no words and the digest of the
empty text; texts of fewer words than a window stay whole; rows that share a doc_id are documents
of their own, ordered by a hash of their text, and of equal rows one counts as first; a null
doc_id comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lares.llm.common import WordHashes, bounded_batches
from lares.session import cut

WINDOW, ANCHOR = 20, 8
#: Occurrences from which an anchor's windows are dealt out one by one.
HOT = 4096
#: Words and documents of a run; documents in a run are numbered in 16 bits.
RUN_WORDS, MARK = 1_000_000, 0xFFFF
#: Anchors of a task that counts them, windows of a block.
ANCHORS_OF_TASK, WINDOWS_OF_BLOCK = 2_000_000, 1_000_000

_NO_ID = -(1 << 63)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_HASHES = WordHashes()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b * _B
    x ^= x >> np.uint64(31)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def windows_of(texts: list[np.ndarray], fingerprints: bool = True):
    """Document, start, anchor's place, anchor and fingerprint of every window of texts given as word hashes."""
    h = np.concatenate([*texts, np.empty(0, np.uint64)])
    count = len(h) - WINDOW + 1
    if count < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    lens = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), lens)
    two = _mix(h[:-1], h[1:])
    four = _mix(two[:-2], two[2:])
    eight = _mix(four[:-4], four[4:])
    least, place = eight[:count].copy(), np.zeros(count, np.int64)
    for j in range(1, WINDOW - ANCHOR + 1):
        lower = eight[j : j + count] < least
        place[lower] = j
        np.minimum(least, eight[j : j + count], out=least)
    at = np.flatnonzero(doc[:count] == doc[WINDOW - 1 :])
    whole = _mix(_mix(eight[:-8], eight[8:])[:count], four[16 : 16 + count])[at] if fingerprints else np.empty(0, np.uint64)
    begin = np.cumsum(lens) - lens
    return doc[at], at - begin[doc[at]], (at + place[at]), least[at].view(np.int64), whole.view(np.int64)


class Reference:
    """Reference text of a block: window fingerprints, each once, where they first occurred."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.text: list[int | None] = []

    def factors(self, windows: list[int]) -> list[tuple[int, int]]:
        """Greedy factors (first window, window after the last); what no factor covers becomes reference text."""
        at, text, out = self.at, self.text, []
        i, n, open_ = 0, len(windows), False
        while i < n:
            p = at.get(windows[i])
            if p is None:
                if not open_:
                    text.append(None)  # no factor runs from one piece of text into another
                    open_ = True
                at[windows[i]] = len(text)
                text.append(windows[i])
                i += 1
                continue
            first, open_ = i, False
            while i < n and p < len(text) and text[p] == windows[i]:
                i, p = i + 1, p + 1
            out.append((first, i))
        return out


def _word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("h"), "text")


def _split_by(which: np.ndarray, n: int):
    """Order by bucket, and (bucket, slice) of every bucket that has something."""
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(n + 1))
    return order, [(b, slice(i, j)) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]


def _default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_anchors(docs: DataFrame, hot: int = HOT, run_words: int = RUN_WORDS) -> DataFrame:
    """key, h, shared, hot of the documents with anchors that occur twice or more, anywhere: the packed anchors, and those of them that are common. Distinct by (key, h)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(_default_partitions(spark), -(-size // (40 * ANCHORS_OF_TASK)))  # an anchor each 40 bytes or more
    names = ["blob", "base", "row", "key", "h"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = "blob binary, base long, row long, key long, h long"

    def batch(columns, extra=(), extra_names=()):
        return pa.RecordBatch.from_arrays([*extra, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*extra_names, *names])

    def post(batches):
        """Packed postings of the anchors of runs of documents, and a row of each document with the anchors that its own run repeats."""
        from pyspark import TaskContext

        row, held, words = TaskContext.get().partitionId() << 40, [], 0

        def out():
            doc, _, place, anchor, _ = windows_of([t for _, _, t in held], fingerprints=False)
            new = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, bool)
            doc, anchor = doc[new], anchor[new]
            order = np.argsort(anchor, kind="stable")
            doc, anchor = doc[order], anchor[order]
            start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(doc) else np.empty(0, np.int64)
            times = np.diff(np.append(start, len(anchor)))
            again = np.repeat(times > 1, times)
            by_doc, own = _split_by(doc[again], len(held))
            repeated = anchor[again][by_doc]
            local = {d: np.unique(repeated[s]).tobytes() for d, s in own}
            anchor, owner = anchor[start], np.where(times > 1, MARK, doc[start]).astype(np.uint16)
            order, slices = _split_by(anchor % parts, parts)
            anchor, owner, times = anchor[order], owner[order], np.minimum(times[order], MARK).astype(np.uint16)
            blobs = [anchor[s].tobytes() + owner[s].tobytes() + times[s].tobytes() for _, s in slices]
            n, k = len(held), len(blobs)
            return batch([blobs + [local.get(i, b"") for i in range(n)], [row] * (k + n), [-1] * k + list(range(row, row + n)), [None] * k + [d for d, _, _ in held], [None] * k + [x for _, x, _ in held]],
                         [pa.array([b for b, _ in slices] + [(row + i) % parts for i in range(n)], pa.int32())], ["bucket"])

        for b in batches:
            for key, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held.append((key, h, _word_hashes(text)))
                words += len(held[-1][2])
                if words > run_words or len(held) == MARK:
                    yield out()
                    row, held, words = row + len(held), [], 0
        if held:
            yield out()

    def meet(batches):
        """Of the anchors of a partition: who holds one that occurs twice or more, and in which runs a common one is; packed by run."""
        anchors, owners, times, bases = [], [], [], []
        for b in batches:
            is_doc = pc.greater_equal(b.column(3), 0)
            yield pa.RecordBatch.from_arrays(b.filter(is_doc).columns[1:], names=names)
            posted = b.filter(pc.invert(is_doc))
            for blob, base in zip(posted.column(1), posted.column(2).to_pylist(), strict=True):
                data = blob.as_buffer()
                n = len(data) // 12
                anchors.append(np.frombuffer(data, np.int64, n).copy())
                owners.append(np.frombuffer(data, np.uint16, n, 8 * n).copy())
                times.append(np.frombuffer(data, np.uint16, n, 10 * n).copy())
                bases.append(np.full(n, base))
        if anchors:
            t, o, m, base = (np.concatenate(x) for x in (anchors, owners, times, bases))
            order = np.argsort(t, kind="stable")
            t, o, m, base = t[order], o[order], m[order].astype(np.int64), base[order]
            start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            total = np.repeat(np.add.reduceat(m, start), np.diff(np.append(start, len(t))))
            common = total >= hot
            told = (total > 1) & ((o != MARK) | common)
            t, o, base, common = t[told], o[told], base[told], common[told]
            order = np.argsort(base, kind="stable")
            runs, at = np.unique(base[order], return_index=True)
            packed = [t[i].tobytes() + o[i].tobytes() + common[i].tobytes() for i in np.split(order, at[1:])] if len(runs) else []
            yield batch([packed, runs, [-1] * len(runs), [None] * len(runs), [None] * len(runs)])

    def total(batches):
        """The repeated anchors of every document; what ``meet`` says of a run comes before the run's documents."""
        base, told = None, []
        for b in batches:
            out = []
            for blob, run, row, key, h in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if run != base:
                    base, told, facts = run, [], None
                if row < 0:
                    told.append(blob)
                    continue
                if facts is None:
                    n = [len(x) // 11 for x in told]
                    t = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, np.int64, k) for x, k in zip(told, n, strict=True)]])
                    o = np.concatenate([np.empty(0, np.uint16), *[np.frombuffer(x, np.uint16, k, 8 * k) for x, k in zip(told, n, strict=True)]])
                    common = np.concatenate([np.empty(0, bool), *[np.frombuffer(x, bool, k, 10 * k) for x, k in zip(told, n, strict=True)]])
                    order = np.argsort(o, kind="stable")
                    facts = t[order], o[order], np.unique(t[common])
                t, o, common = facts
                i, j = np.searchsorted(o, [row - base, row - base + 1])
                mine = np.unique(np.concatenate((t[i:j], np.frombuffer(blob, np.int64))))
                if len(mine):
                    out.append((key, h, mine.tobytes(), mine[np.isin(mine, common)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["key", "h", "shared", "hot"])

    met = docs.select("key", "h", "text").mapInArrow(post, "bucket int, " + schema).repartition(parts, "bucket").mapInArrow(meet, schema)
    found = met.repartition(parts, "base").sortWithinPartitions("base", "row").mapInArrow(total, "key long, h long, shared binary, hot binary")
    return found.groupBy("key", "h").agg(F.max("shared").alias("shared"), F.max("hot").alias("hot"))  # equal rows hold the same anchors


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


#: What a stretch carries besides its fingerprints: order of its document, its document in the run, first window, number of windows.
_STRETCH = np.dtype([("key", "i8"), ("h", "i8"), ("owner", "u2"), ("start", "i4"), ("n", "i4")])


def stretched(docs: DataFrame, shared: DataFrame, blocks: int, run_words: int = RUN_WORDS) -> DataFrame:
    """Rows of two kinds, to be written: documents (row >= 0; finished ones with their digest, others with text and the factors found in their run), and packed stretches for a block (row -1)."""
    names = ["block", "blob", "base", "row", "doc_id", "text", "n_words", "sha"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        from pyspark import TaskContext

        row, held, words = TaskContext.get().partitionId() << 40, [], 0

        def out():
            docs_out, stretches, prints, blocks_of = [], [], [], []
            waiting = [i for i, d in enumerate(held) if d[3] is not None]
            doc, start, _, anchor, whole = windows_of([held[i][3] for i in waiting])
            edges = np.searchsorted(doc, np.arange(len(waiting) + 1))
            reference, local = Reference(), {}
            for w in sorted(range(len(waiting)), key=lambda w: (held[waiting[w]][0], held[waiting[w]][1], waiting[w])):
                i, s = waiting[w], slice(edges[w], edges[w + 1])
                key, h, _, _, _, shared, hot = held[i]
                a, f, p = anchor[s], whole[s], start[s]
                live = np.isin(a, shared)
                if not live.any():
                    continue
                a, f, p = a[live], f[live], p[live]
                a = np.where(np.isin(a, hot), f, a)
                cuts = np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)) + 1
                spans, fl = [], f.tolist()
                for x, y in zip(np.append(0, cuts).tolist(), np.append(cuts, len(a)).tolist(), strict=True):
                    done = x
                    for m, n in [*reference.factors(fl[x:y]), (y - x, y - x)]:
                        if x + m > done:  # no earlier text of this run: for the block
                            stretches.append((key, h, i, p[done], x + m - done))
                            prints.append(f[done : x + m])
                            blocks_of.append(int(a[x]) % blocks)
                        if n > m:
                            spans.append((int(p[x + m]), int(p[x + m]) + n - m + WINDOW - 1))
                        done = x + n
                local[i] = np.array(spans, np.int32).tobytes()
            for i, (_, _, text, h, doc_id, _, _) in enumerate(held):
                split = text.encode().split() if h is None else ()
                docs_out.append((None, local.get(i), row, row + i, doc_id, text if h is not None else None, len(split) if h is None else len(h), _sha(split) if h is None else None))
            order, slices = _split_by(np.array(blocks_of, np.int64), blocks)
            packed = []
            for b, s in slices:
                these = order[s]
                head = np.array([stretches[x] for x in these], _STRETCH)
                packed.append((b, np.int64(len(head)).tobytes() + head.tobytes() + np.concatenate([prints[x] for x in these]).tobytes(), row, -1, None, None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(docs_out + packed), strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for doc_id, key, h, text, shared, hot in zip(*[c.to_pylist() for c in b.columns], strict=True):
                none = shared is None
                held.append((key, h, text, None if none else _word_hashes(text), doc_id, None if none else np.frombuffer(shared, np.int64), None if none else np.frombuffer(hot, np.int64)))
                words += len(text) // 32 if none else len(held[-1][3])
                if words > run_words or len(held) == MARK:
                    yield out()
                    row, held, words = row + len(held), [], 0
        if held:
            yield out()

    joined = docs.join(shared, ["key", "h"], "left").select("doc_id", "key", "h", "text", "shared", "hot")
    return joined.mapInArrow(run, "block int, blob binary, base long, row long, doc_id long, text string, n_words long, sha string")


def block_factors(stretches: DataFrame, blocks: int) -> DataFrame:
    """base, blob: the factors found in every block, packed by run of documents."""

    def run(batches):
        heads, prints, bases = [], [], []
        for b in batches:
            for blob, base in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data = blob.as_buffer()
                n = int(np.frombuffer(data, np.int64, 1)[0])
                heads.append(np.frombuffer(data, _STRETCH, n, 8).copy())
                prints.append(np.frombuffer(data, np.int64, -1, 8 + n * _STRETCH.itemsize).copy())
                bases.append(np.full(n, base))
        if not heads:
            return
        head, f, base = np.concatenate(heads), np.concatenate(prints), np.concatenate(bases)
        end = np.cumsum(head["n"].astype(np.int64))
        order = np.lexsort((head["start"], head["owner"], base, head["h"], head["key"]))
        reference, out = Reference(), []
        for x, e, n, start in zip(order.tolist(), end[order].tolist(), head["n"][order].tolist(), head["start"][order].tolist(), strict=True):
            out += [(x, start + m, start + last + WINDOW - 1) for m, last in reference.factors(f[e - n : e].tolist())]
        if not out:
            return
        x, first, last = np.array(out, np.int64).T
        by = np.argsort(base[x], kind="stable")
        x, first, last = x[by], first[by].astype(np.int32), last[by].astype(np.int32)
        runs, at = np.unique(base[x], return_index=True)
        packed = [head["owner"][x[i]].tobytes() + first[i].tobytes() + last[i].tobytes() for i in np.split(np.arange(len(x)), at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(packed, pa.binary())], names=["base", "blob"])

    return stretches.select("block", "blob", "base").repartition(blocks, "block").mapInArrow(run, "base long, blob binary")


def finished(waiting: DataFrame, factors: DataFrame, parts: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the documents that had repeated anchors."""

    def run(batches):
        base, told, facts = None, [], None
        for b in batches:
            out = []
            for blob, run_, row, doc_id, text in zip(b.column(0), *[c.to_pylist() for c in b.columns[1:]], strict=True):
                if run_ != base:
                    base, told, facts = run_, [], None
                if row < 0:
                    told.append(blob.as_py())
                    continue
                if facts is None:
                    n = [len(x) // 10 for x in told]
                    parts_of = lambda kind, at: np.concatenate([np.empty(0, kind), *[np.frombuffer(x, kind, k, at * k) for x, k in zip(told, n, strict=True)]])  # noqa: B023, E731
                    owner, first, last = parts_of(np.uint16, 0), parts_of(np.int32, 2), parts_of(np.int32, 6)
                    order = np.argsort(owner, kind="stable")
                    facts = owner[order], first[order], last[order]
                owner, first, last = facts
                i, j = np.searchsorted(owner, [row - base, row - base + 1])
                own = np.frombuffer(blob.as_py() or b"", np.int32).reshape(-1, 2)
                words = text.encode().split()
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, np.concatenate((first[i:j], own[:, 0])), 1)
                np.add.at(depth, np.concatenate((last[i:j], own[:, 1])), -1)
                kept = (np.cumsum(depth)[:-1] == 0).tolist()
                left = [w for w, k in zip(words, kept, strict=True) if k]
                out.append((doc_id, len(words), len(words) - len(left), _sha(left)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = waiting.select("blob", "base", "row", "doc_id", "text").unionByName(factors.select("blob", "base", F.lit(-1).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    return rows.repartition(parts, "base").sortWithinPartitions("base", "row").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, hot: int = HOT, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs``."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    shared = cut(shared_anchors(keyed, hot, run_words))
    anchors = shared.agg(F.sum(F.octet_length("shared"))).first()[0] or 0
    parts = _default_partitions(docs.sparkSession)
    blocks = max(parts, -(-(anchors // 8 * (WINDOW - ANCHOR)) // WINDOWS_OF_BLOCK))
    both = cut(stretched(keyed, shared, blocks, run_words))
    done = both.where("row >= 0 AND sha IS NOT NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    factors = block_factors(both.where("row < 0"), blocks)
    return done.unionByName(finished(both.where("row >= 0 AND sha IS NULL"), factors, max(parts, blocks)))
