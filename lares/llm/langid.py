"""Language identification by nearest centroid (operator 5).

A text is a vector of hashed byte trigrams of its lower-cased letters (everything ASCII that is
no letter is one separator), weighted by TF-IDF with logarithmic counts and scaled to length one.
Each language has several centroids, found by spherical k-means among its training texts, so
that a language with unlike kinds of text is not one blurred mean. The prediction is the language
of the centroid with the greatest cosine, which is also the score. A text is *rejected* when its
distance to that centroid is out of reach of training texts of its length.

The model is fitted on a bounded sample: at most ``PER_LANGUAGE`` labelled texts of each language,
those with the smallest hash of their id among a thinned share. Only their sparse counts come to
the driver. Every row is predicted on its whole text, in batches.

Defined results: null text, or text without a letter: ``und``, score 0, rejected; a table without
any labelled training text: every text is ``und``; rows with null language don't train; null and
repeated doc_ids are rows like others; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lares.llm.common import bounded_batches, crc_fold

FOLDS, HELD_OUT = 4, 2
#: Bound of the training sample per language; hashed dimensions; centroids per language.
PER_LANGUAGE, DIMS, CENTROIDS = 400, 1 << 14, 4
#: A text is rejected when its cosine is below this share of the low percentile of training texts of its length.
LENIENCE, LOW = 0.25, 0.01
UND = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[b for b in range(128) if not 97 <= b <= 122]] = 32


def counts(text: str) -> np.ndarray:
    """Trigram counts of a whole text in hashed dimensions."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    if len(b) < 3:
        return np.zeros(DIMS, dtype=np.float32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _size_class(totals: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(totals, 1)).astype(np.int64), 31)


class Centroids:
    """languages, centroids, idf, and the least cosine per length class."""

    def __init__(self, samples: dict[str, list[tuple[np.ndarray, np.ndarray]]], k: int = CENTROIDS):
        df, total = np.zeros(DIMS), 0
        for rows in samples.values():
            for index, _ in rows:
                df[index] += 1
                total += 1
        self.idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
        self.languages = sorted(samples)
        centres, owner, near = [], [], []
        for number, lang in enumerate(self.languages):
            x = np.zeros((len(samples[lang]), DIMS), dtype=np.float32)
            for i, (index, n) in enumerate(samples[lang]):
                x[i, index] = n
            sizes, v = x.sum(axis=1), self.weighted(x)
            c = self._cluster(v, k)
            centres.append(c)
            owner += [number] * len(c)
            near.append((_size_class(sizes), (v @ c.T).max(axis=1)))
        self.centres, self.owner = np.concatenate(centres), np.array(owner)
        classes, best = (np.concatenate(p) for p in zip(*near, strict=True))
        # shorter texts have lower cosines, so a class takes over the floor of a longer one if it is lower;
        # classes above the longest populated one have that one's floor (without any populated class nothing is rejected)
        self.floor, last = np.zeros(32, dtype=np.float32), np.inf
        for c in range(31, -1, -1):
            own = best[classes == c]
            last = min(last, float(np.quantile(own, LOW))) if len(own) >= 20 else last * (0.7 if np.isfinite(last) and c < classes.min() + 1 else 1)
            if np.isfinite(last):
                self.floor[c if self.floor.any() else slice(c, None)] = LENIENCE * last

    def weighted(self, x: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(x) * self.idf)

    @staticmethod
    def _cluster(v: np.ndarray, k: int) -> np.ndarray:
        """Spherical k-means from far-apart starts."""
        centres = [v.mean(axis=0)]
        while len(centres) < min(k, len(v)):
            centres.append(v[int(np.argmin((v @ _unit(np.array(centres)).T).max(axis=1)))])
        c = _unit(np.array(centres))
        for _ in range(10):
            mine = (v @ c.T).argmax(axis=1)
            c = _unit(np.array([v[mine == j].mean(axis=0) if (mine == j).any() else c[j] for j in range(len(c))]))
        return c.astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine, rejected; for count rows."""
        cos = self.weighted(x) @ self.centres.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(x)), best], 0, 1)
        return self.owner[best], score, score < self.floor[_size_class(x.sum(axis=1))]


def training(docs: DataFrame) -> DataFrame:
    """lang, text of the rows that may train."""
    return docs.where((crc_fold(FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Centroids | None:
    rows = training(docs)
    total = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    order = F.xxhash64("doc_id", "text", F.lit(5))  # of the whole row: rows that share an id, or have none, don't stand or fall together
    share = F.pmod(order, F.lit(1_000_000)) < 1_000_000 * (3.0 * per_language) / F.col("_n")
    # the languages are as many as the model has; thinned to about three times the bound, then cut exactly
    thin = rows.join(F.broadcast(total), "lang").where(share).select("lang", "doc_id", "text", order.alias("_o"))
    kept = thin.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_o", "text"))).where(F.col("_r") <= per_language).select("lang", "text")

    def sparse(batches):
        for b in batches:
            langs, index, n = [], [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if _LETTER.search(text):
                    x = counts(text)
                    at = np.flatnonzero(x).astype(np.int32)
                    langs.append(lang)
                    index.append(at)
                    n.append(x[at])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(index, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["lang", "i", "n"])

    samples: dict[str, list] = {}
    for b in kept.mapInArrow(sparse, "lang string, i array<int>, n array<float>").toArrow().to_batches():
        for lang, i, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            samples.setdefault(lang, []).append((i.values.to_numpy(), n.values.to_numpy()))
    return Centroids(samples) if samples else None


def predicted(docs: DataFrame, per_language: int = PER_LANGUAGE, row: str = "doc_id") -> DataFrame:
    """doc_id (or the column ``row`` in its place), held_out, lang_pred, score, rejected: one row per row of ``docs``."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))  # languages x CENTROIDS x DIMS

    def run(batches):
        m = model.value
        for b in batches:
            texts = b.column(2).to_pylist()
            langs, scores, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            spoken = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if m else []
            for start in range(0, len(spoken), 128):
                part = spoken[start : start + 128]
                owner, score, out = m.predict(np.stack([counts(texts[i]) for i in part]))
                for i, o in zip(part, owner, strict=True):
                    langs[i] = m.languages[o]
                scores[part], rejected[part] = score, out
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)],
                                             names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(row).cast("long").alias("doc_id"), (crc_fold(FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
