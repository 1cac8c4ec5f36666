"""Language-model scores with a log-bilinear model (operator 6).

Words are predicted in two steps. A log-bilinear neural model gives the probability of the next
*class* from the two classes before it: the context vectors, weighted per position, are added,
and their product with a class's output vector plus its bias is the class's score. The commonest
words of the training texts are classes of their own, the end of a text is one, and all other
words share class 0. Within class 0 a word has its smoothed share of that class's tokens.

What training needs from the corpus is gathered from all training texts: the count of every word,
and the count of every class triple. Triples are trained on by noise-contrastive estimation in
numpy: in each round every trainer passes over its whole part of the triples, so that each triple
takes part with its whole count, and the trainers' parameters are averaged. The trainers grow with
the triples. The class probabilities are then normalised exactly:
batched matrix products over all pairs of context classes give a table of log normalisers, so a
token's log probability is four table look-ups.

Sizes: classes (``CLASSES``) bound the triples, all tables and what the driver holds. Counts of the
``FREQUENT`` commonest words are broadcast; tokens beyond them are joined with the whole count
table, so no count is ever left out.

Defined results: null text is the empty text, whose only token is the end; a table without
training texts scores every token as unseen; repeated rows are scored (and trained on) as often as
they occur; null doc_ids count as the empty text in the fold; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lares.llm.common import bounded_batches, crc_fold
from lares.session import cut

FOLDS, HELD_OUT = 7, 2
#: Classes (class 0: all other words), width of the vectors, commonest words whose counts are broadcast.
CLASSES, WIDTH, FREQUENT = 1024, 32, 1 << 16
#: Training: least workers, rounds of averaging, examples per step, noise classes per step, step size.
TRAINERS, ROUNDS, STEP, NOISE, RATE = 32, 4, 1024, 128, 0.15
#: Triples that a trainer passes over at a time; counts up to which every token is an example of its own.
PART, SINGLY = 1 << 21, 1 << 18
#: The end token has a name that no word can have.
END = ""
#: Distinct entries gathered in a worker before they are handed on.
HOLD = 400_000


def words(text: str | None) -> list[str]:
    """The tokens of a whole text without its end."""
    return [w.decode() for w in (text or "").encode().lower().split()]


def word_counts(train: DataFrame) -> DataFrame:
    """word, c: counts of all tokens of all rows of ``train`` (text), the end included."""
    bounded_batches(train.sparkSession)

    def run(batches):
        seen: Counter[bytes] = Counter()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update((t or "").encode().lower().split())
            seen[b""] += b.num_rows
            if len(seen) > HOLD:
                yield out()
        yield out()

    return train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def class_words(counts: DataFrame, classes: int = CLASSES) -> dict[bytes, int]:
    """Class numbers: 1 is the end, the commonest words follow."""
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(classes - 2).collect()
    return {END.encode(): 1} | {r["word"].encode(): i for i, r in enumerate(top, 2)}


def _class_rows(texts: list[str | None], classes: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Tokens of each text; the classes of all texts behind one another, with two ends before each; where each text's tokens begin."""
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    get, at, out = classes.get, [], []
    for ts in tokens:
        out += (1, 1)
        at.append(len(out))
        out += [get(w, 0) for w in ts]
    return tokens, np.array(out, dtype=np.int64), np.array(at, dtype=np.int64)


def _predicted(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the tokens that are predicted (not the ends put before a text)."""
    put = np.zeros(len(ids), dtype=bool)
    put[at - 1] = put[at - 2] = True
    return np.flatnonzero(~put)


def triples(train: DataFrame, classes: dict[bytes, int], size: int = CLASSES) -> DataFrame:
    """code, n: how often each triple of classes (two before, then one) occurs in ``train``."""
    known = train.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        held, rows = [], 0

        def out():
            code, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for b in batches:
            _, ids, at = _class_rows(b.column(0).to_pylist(), known.value)
            p = _predicted(ids, at)
            held.append(np.unique((ids[p - 2] * size + ids[p - 1]) * size + ids[p], return_counts=True))
            rows += len(held[-1][0])
            if rows > 4 * HOLD:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return train.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Parameters:
    """in1, in2: context vectors per position; out, bias: of the class predicted."""

    NAMES = ("base", "w1", "w2", "out", "bias")

    def __init__(self, unigram: np.ndarray, width: int = WIDTH, seed: int = 1):
        r = np.random.default_rng(seed)
        n = len(unigram)
        self.base = (r.standard_normal((n, width)) * 0.1).astype(np.float32)
        self.w1, self.w2 = np.ones(width, dtype=np.float32) * 0.5, np.ones(width, dtype=np.float32)
        self.out = (r.standard_normal((n, width)) * 0.1).astype(np.float32)
        self.bias = np.log(unigram).astype(np.float32)

    def packed(self) -> bytes:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES]).astype(np.float32).tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            v = getattr(self, k)
            setattr(self, k, flat[at : at + v.size].reshape(v.shape).astype(np.float32))
            at += v.size


def _add_rows(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """target[rows] += values, rows repeated."""
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    target[r[first]] += np.add.reduceat(values[order], first, axis=0)


def examples(n: np.ndarray, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A pass over all triples in random order: their places, and weights that add up to each triple's count.

    A triple with a great count is repeated, so that no example outweighs a step; there are at
    most about twice as many examples as triples (or as tokens, where these are few).
    """
    times = np.ceil(n / max(1.0, n.sum() / max(len(n), SINGLY))).astype(np.int64)
    order = r.permutation(np.repeat(np.arange(len(n), dtype=np.int32), times))
    return order, (n / times).astype(np.float32)[order]


def fresh_sums(p: Parameters) -> dict[str, np.ndarray]:
    """Sums of squared gradients before the first step."""
    return {k: np.full_like(getattr(p, k), 1e-2) for k in Parameters.NAMES}


def train_part(p: Parameters, codes: np.ndarray, n: np.ndarray, unigram: np.ndarray, seed: int, rate: float, sums: dict[str, np.ndarray] | None = None) -> None:
    """Noise-contrastive estimation in one pass over all triples, weighted by count; changes ``p`` and ``sums``."""
    size, r = len(unigram), np.random.default_rng(seed)
    order, weights = examples(n, r)
    share = weights / np.float32(weights.mean(dtype=np.float64) * min(STEP, len(order)))
    cdf = np.cumsum(unigram)
    log_noise = np.log(NOISE * unigram).astype(np.float32)
    sums = fresh_sums(p) if sums is None else sums

    def step(k: str, g: np.ndarray) -> None:
        sums[k] += g * g
        v = getattr(p, k)
        v -= rate * g / np.sqrt(sums[k])

    for start in range(0, len(order), STEP):
        code, part = codes[order[start : start + STEP]], share[start : start + STEP, None]
        c1, c2, w = code // (size * size), code // size % size, code % size
        noise = np.minimum(np.searchsorted(cdf, r.random(NOISE) * cdf[-1], side="right"), size - 1)
        e1, e2 = p.base[c1], p.base[c2]
        q = e1 * p.w1 + e2 * p.w2
        real = np.einsum("ij,ij->i", q, p.out[w]) + p.bias[w] - log_noise[w]
        fake = q @ p.out[noise].T + p.bias[noise] - log_noise[noise]
        g_real = (1 / (1 + np.exp(-real)) - 1)[:, None] * part
        g_fake = 1 / (1 + np.exp(-fake)) * part
        g_q = g_real * p.out[w] + g_fake @ p.out[noise]
        g_out, g_bias, g_base = np.zeros_like(p.out), np.zeros_like(p.bias), np.zeros_like(p.base)
        _add_rows(g_out, np.concatenate((w, noise)), np.concatenate((g_real * q, g_fake.T @ q)))
        _add_rows(g_bias, np.concatenate((w, noise)), np.concatenate((g_real[:, 0], g_fake.sum(axis=0))))
        _add_rows(g_base, np.concatenate((c1, c2)), np.concatenate((g_q * p.w1, g_q * p.w2)))
        for k, g in (("out", g_out), ("bias", g_bias), ("base", g_base), ("w1", (g_q * e1).sum(axis=0)), ("w2", (g_q * e2).sum(axis=0))):
            step(k, g.astype(np.float32))


def fitted(spark: SparkSession, table: DataFrame, unigram: np.ndarray, most: int) -> Parameters:
    """Parameters after ROUNDS of training on all parts of ``table`` (code, n; at most ``most`` rows) and averaging."""
    p = Parameters(unigram)
    parts = cut(table.repartition(max(TRAINERS, -(-most // PART)), "code").select("code", "n"))

    def rounds(now: bytes, number: int):
        def run(batches):
            mine = Parameters(unigram)
            mine.unpack(np.frombuffer(now, dtype=np.float32))
            sums, held, rows, seen = fresh_sums(mine), [], 0, 0

            def train():
                codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
                train_part(mine, codes, n, unigram, seed=int(codes[0]) + number, rate=RATE / (1 + number), sums=sums)
                return int(n.sum())

            for b in batches:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                rows += b.num_rows
                if rows >= PART:
                    seen += train()
                    held, rows = [], 0
            if rows:
                seen += train()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([mine.packed()], pa.binary())], names=["n", "p"])

        return run

    for number in range(ROUNDS):
        got = parts.mapInArrow(rounds(p.packed(), number), "n long, p binary").collect()  # one small row per trainer
        if got:
            p.unpack(np.average([np.frombuffer(r["p"], dtype=np.float32) for r in got], axis=0, weights=[r["n"] for r in got]))
    return p


def normalisers(spark: SparkSession, p: Parameters) -> np.ndarray:
    """log of the sum over all classes of exp(score), for every pair of context classes."""
    sent, size = spark.sparkContext.broadcast(p), len(p.bias)

    def run(batches):
        m = sent.value
        second = m.base * m.w2
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                s = (m.base[i] * m.w1 + second) @ m.out.T + m.bias
                top = s.max(axis=1, keepdims=True)
                rows.append((top[:, 0] + np.log(np.exp(s - top).sum(axis=1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["id", "z"])

    table = np.empty((size, size), dtype=np.float32)
    for r in spark.range(size).mapInArrow(run, "id long, z binary").collect():  # CLASSES squared numbers
        table[r["id"]] = np.frombuffer(r["z"], dtype=np.float32)
    return table


class Tables:
    """The model as look-ups: log10 probability of a class after two classes."""

    def __init__(self, p: Parameters, z: np.ndarray):
        self.first = ((p.base * p.w1) @ p.out.T).astype(np.float32)
        self.second = ((p.base * p.w2) @ p.out.T + p.bias).astype(np.float32)
        self.z = z

    def log10(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.first[c1, w].astype(np.float64) + self.second[c2, w] - self.z[c1, c2]) / np.log(10)


def scored(docs: DataFrame, classes: int = CLASSES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held_out = crc_fold(FOLDS) == HELD_OUT
    train = docs.where(~held_out).select("text")
    counts = cut(word_counts(train))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"], total["v"]
    numbers = class_words(counts, classes)
    top = counts.orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    common = dict(zip(top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_pylist(), strict=True))
    of_class = np.zeros(classes)
    for w, i in numbers.items():
        of_class[i] = common.get(w, 0)
    n_rest, v_rest = n_all - int(of_class.sum()), v_all - int((of_class > 0).sum())
    of_class[0] = n_rest
    unigram = (of_class + 1) / (of_class + 1).sum()
    p = fitted(spark, triples(train, numbers, classes), unigram, min(n_all, classes**3))
    tables = Tables(p, normalisers(spark, p))
    sent = spark.sparkContext.broadcast((numbers, {w: float(np.log10(c + 1)) for w, c in common.items()}, tables))
    base_each, rest_each = float(np.log10(n_all + v_all + 1)), float(np.log10(n_rest + v_rest + 1))
    schema = "row long, doc_id long, held_out boolean, n long, known long, logs double, rest_logs double, rest long, model double, words array<string>, times array<int>"

    def run(batches):
        from pyspark import TaskContext

        cls, logs, lm = sent.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            tokens, ids, at = _class_rows(b.column(2).to_pylist(), cls)
            each = np.zeros(len(ids))
            put = _predicted(ids, at)
            each[put] = lm.log10(ids[put - 2], ids[put - 1], ids[put])
            model = np.add.reduceat(each, at - 2) if len(at) else np.empty(0)
            cols: list[list] = [[] for _ in range(8)]
            for k, ts in enumerate(tokens):
                got = list(map(logs.get, ts))
                c = ids[at[k] : at[k] + len(ts)]
                v = np.array([0.0 if x is None else x for x in got])
                rare = Counter(w for w, x in zip(ts, got, strict=True) if x is None) if None in got else {}
                for col, value in zip(cols, (len(ts), len(ts) - sum(rare.values()), float(v.sum()), float(v[c == 0].sum()), int((c == 0).sum()), float(model[k]),
                                             [w.decode() for w in rare], list(rare.values())), strict=True):
                    col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + b.num_rows), pa.int64()), b.column(0), b.column(1), *[pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]],
                                             names=[f.split()[0] for f in schema.split(", ")])
            row += b.num_rows

    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, schema))
    rare = rows.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times")))).toDF("row", "word", "times")
    more = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("_k"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_l"))
    back = rows.drop("words", "times").join(more, "row", "left").na.fill(0, ["_k", "_l"])
    return back.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.col("_k")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                       (F.col("logs") + F.col("_l") - F.col("n") * base_each).alias("base_score"),
                       (F.col("model") + F.col("rest_logs") + F.col("_l") - F.col("rest") * rest_each).alias("score"))
