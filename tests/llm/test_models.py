"""Language ID, language model and nearest neighbours against brute force and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lares.llm import langid, lbl_lm, permindex


def _held(doc_id, folds):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % folds == 2


def test_language_id_on_held_out_documents(corpus):
    got = {r["doc_id"]: r for r in langid.predicted(corpus).collect()}
    truth = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    held = [d for d in truth if _held(d, 4)]
    assert all(got[d]["held_out"] == _held(d, 4) for d in truth)
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.95 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 0.03 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_odd_rows(spark, odd_docs, no_docs, corpus):
    rows = {r["doc_id"]: r for r in langid.predicted(odd_docs).collect()}
    assert len(langid.predicted(odd_docs).collect()) == odd_docs.count()
    for d in (4, 5, 8, 12):
        assert (rows[d]["lang_pred"], rows[d]["score"], rows[d]["rejected"]) == ("und", 0.0, True)
    assert all(r["lang_pred"] in ("en", "fr", "de", "und") for r in rows.values())
    assert langid.predicted(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predicted(unlabelled).collect()} == {"und"}
    # far from every language
    docs = corpus.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**6, "漢字仮名交文" * 60, None)], "doc_id long, text string, lang string"))
    assert langid.predicted(docs).where(f"doc_id = {10**6}").first()["rejected"]


def test_long_texts_can_be_rejected(spark, corpus):
    """A foreign script is rejected at every length, also above the longest training texts; long prose of the corpus stays."""
    prose = " ".join(r["text"] for r in corpus.where("lang = 'en'").orderBy("doc_id").collect())
    rows = [(10**6 + i, "漢字仮名交文" * n, None) for i, n in enumerate((60, 3_000, 40_000))] + [(10**6 + 3, prose * (1 + 200_000 // len(prose)), None)]
    docs = corpus.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"] - 10**6: r["rejected"] for r in langid.predicted(docs).where(f"doc_id >= {10**6}").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False}


def _plain_trigrams(text):
    """Hashed trigram counts, a byte at a time."""
    folded = []
    for b in f" {text.lower()} ".encode():
        b = b if 97 <= b <= 122 or b >= 128 else 32
        if not (b == 32 and folded and folded[-1] == 32):
            folded.append(b)
    out = {}
    for x, y, z in zip(folded, folded[1:], folded[2:], strict=False):
        h = ((x << 16 | y << 8 | z) * 2654435761 % 2**32) // (2**32 // langid.DIMS)
        out[h] = out.get(h, 0) + 1
    return out


def _plain_unit(v):
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else v


def _plain_mean(vs):
    out = {}
    for v in vs:
        for k, x in v.items():
            out[k] = out.get(k, 0.0) + x / len(vs)
    return out


def _cosine(v, c):
    return sum(x * c.get(k, 0.0) for k, x in v.items())


def _plain_centroids(vs, k):
    centres = [_plain_unit(_plain_mean(vs))]
    while len(centres) < min(k, len(vs)):
        centres.append(min(vs, key=lambda v: max(_cosine(v, c) for c in centres)))
    for _ in range(10):
        mine = [max(range(len(centres)), key=lambda j: _cosine(v, centres[j])) for v in vs]  # noqa: B023
        centres = [_plain_unit(_plain_mean([v for v, m in zip(vs, mine, strict=True) if m == j])) if j in mine else c for j, c in enumerate(centres)]
    return centres


def test_language_id_equals_brute_force(corpus):
    """Counts, weights, clusters and cosines again in plain Python, on every document of the smallest table."""
    docs = corpus.select("doc_id", "text", "lang").collect()
    train = {}
    for r in docs:
        if r.text is not None and r.lang is not None and not _held(r.doc_id, langid.FOLDS) and any(c.isalpha() for c in r.text):
            train.setdefault(r.lang, []).append(_plain_trigrams(r.text))
    assert max(map(len, train.values())) <= langid.PER_LANGUAGE  # all of them train
    every = [v for vs in train.values() for v in vs]
    df = {}
    for v in every:
        for k in v:
            df[k] = df.get(k, 0) + 1
    weighted = lambda v: _plain_unit({k: math.log1p(n) * (math.log((1 + len(every)) / (1 + df.get(k, 0))) + 1) for k, n in v.items()})
    centres = {lang: _plain_centroids([weighted(v) for v in vs], langid.CENTROIDS) for lang, vs in train.items()}
    got = {r.doc_id: r for r in langid.predicted(corpus).collect()}
    assert len(got) == len(docs)
    for r in docs:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (langid.UND, 0.0)
            continue
        v = weighted(_plain_trigrams(r.text))
        best = {lang: max(_cosine(v, c) for c in cs) for lang, cs in centres.items()}
        top = max(best.values())
        assert abs(got[r.doc_id].score - top) < 1e-4 and best[got[r.doc_id].lang_pred] > top - 1e-4


def test_prediction_reads_the_text_only(corpus):
    changed = corpus.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in df.collect())
    assert key(langid.predicted(corpus)) == key(langid.predicted(changed.withColumn("source", F.lit("z"))))


def _tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_base_scores_equal_brute_force(odd_docs, corpus, no_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(corpus.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = docs.collect()
    counts = Counter()
    for r in rows:
        if not _held(r["doc_id"], 7):
            counts.update(_tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r["doc_id"] or -1, _held(r["doc_id"], 7), len(t), sum(counts[x] > 0 for x in t), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)) for r in rows for t in [_tokens(r["text"])])
    for frequent in (20, 1 << 16):
        got = lbl_lm.scored(docs, classes=64, frequent=frequent).collect()
        assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    assert lbl_lm.scored(no_docs).count() == 0


def test_class_probabilities_are_normalised(spark):
    r = np.random.default_rng(1)
    p = lbl_lm.Parameters(np.full(40, 1 / 40))
    p.base, p.out = r.standard_normal((40, 32)).astype(np.float32), r.standard_normal((40, 32)).astype(np.float32)
    t = lbl_lm.Tables(p, lbl_lm.normalisers(spark, p))
    c1, c2 = r.integers(0, 40, 50), r.integers(0, 40, 50)
    sums = sum(10 ** t.log10(c1, c2, np.full(50, w)) for w in range(40))
    assert np.allclose(sums, 1, atol=1e-4)


def test_training_learns_from_context():
    """Class c is mostly followed by c + 1: the model must beat the unigram clearly."""
    size, r = 24, np.random.default_rng(2)
    seq = [0]
    for _ in range(40_000):
        seq.append((seq[-1] + 1) % size if r.random() < 0.8 else int(r.integers(size)))
    s = np.array(seq)
    codes, n = np.unique((s[:-2] * size + s[1:-1]) * size + s[2:], return_counts=True)
    unigram = np.bincount(s, minlength=size) / len(s)
    p = lbl_lm.Parameters(unigram)
    for number in range(3):
        lbl_lm.train_part(p, codes, n, unigram, seed=number, rate=lbl_lm.RATE)
    scores = (p.base[s[:-2]] * p.w1 + p.base[s[1:-1]] * p.w2) @ p.out.T + p.bias
    logp = scores[np.arange(len(scores)), s[2:]] - np.log(np.exp(scores).sum(axis=1))
    assert logp.mean() > np.log(unigram[s[2:]]).mean() + 1.0


def test_training_passes_over_every_triple():
    """Contexts that occur once beside one very common triple are trained on, and each triple has its whole count."""
    size = 500
    code = lambda a, b, c: (a * size + b) * size + c
    codes = np.array([0] + [code(c, c, 1) for c in range(2, size)])
    n = np.array([1 << 26] + [1] * (size - 2))
    p = lbl_lm.Parameters(np.full(size, 1 / size))
    before = p.base.copy()
    lbl_lm.train_part(p, codes, n, np.full(size, 1 / size), seed=1, rate=lbl_lm.RATE)
    assert (p.base[2:] != before[2:]).any(axis=1).all()
    order, weights = lbl_lm.examples(n, np.random.default_rng(1))
    assert np.allclose(np.bincount(order, weights=weights), n)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, s string")


def test_neighbours_recall_and_exact_scores(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 24)).astype(np.float32)
    x[500:700] = x[500]  # many copies of one vector: ties go to the smaller id
    got = permindex.nearest_neighbours(_vectors(spark, [(i, v.tolist(), 0, "a", "b") for i, v in enumerate(x)]), F.col("vec_id") % 100 == 0).collect()
    d64, hit = x.astype(np.float64), 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        mine = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == d[m[1]] for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hit += len(set(want) & {m[1] for m in mine})
        if q in (500, 600):
            assert [m[1] for m in mine] == want
    assert hit >= 0.9 * 300


@pytest.mark.parametrize("shard,block", [(4, 2), (8192, 4096)])
def test_neighbours_odd_rows(spark, monkeypatch, shard, block):
    monkeypatch.setattr(permindex, "SHARD", shard)
    monkeypatch.setattr(permindex, "BLOCK", block)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0, "", ""), (1, [1.0, 1.0], 0, "", ""), (2, None, 0, "", ""), (3, [0.0, 0.0], 0, "", ""), (4, [nan, 1.0], 0, "", ""), (5, [inf, 1.0], 0, "", ""), (6, [1.0, None], 0, "", ""),
            (7, [1.0, 1.0], 0, "", ""), (100, [1.0, 0.5], None, "", ""), (200, None, 0, "", ""), (0, [1.0, 0.0], 0, "", ""), (8, [1.0], 0, "", ""), (300, [], 0, "", "")]
    got = permindex.nearest_neighbours(_vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    mine = sorted({(g["query_id"], g["rank"], g["vec_id"]) for g in got})
    assert [m for m in mine if m[0] == 100] == [(100, 1, 0), (100, 2, 0), (100, 3, 1), (100, 4, 7)]
    assert {m[2] for m in mine if m[0] == 0} == {1, 7, 100} and {m[0] for m in mine} == {0, 100}
    assert permindex.nearest_neighbours(_vectors(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0
