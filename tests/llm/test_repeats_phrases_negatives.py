"""Substring removal, collocations and hard negatives against brute force and odd rows."""

import glob
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lares.llm import collocations, hardneg, relative_lz

# ----------------------------------------------------------------- operator 11


def _removed(rows):
    """Brute force: (doc_id, n_words, n_removed, sha) of rows (doc_id, text), sorted."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    words = [(t or "").encode().split() for _, t in rows]
    seen, out = set(), []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            v = tuple(w[p : p + 20])
            if v in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(v)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def _key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def _passages(seed, n):
    r = random.Random(seed)
    word = lambda k=3000: f"w{r.randrange(k)}"
    shared = [[word() for _ in range(r.choice([19, 20, 21, 60]))] for _ in range(4)]
    docs = []
    for i in range(n):
        kind = r.randrange(5)
        if kind == 0 and docs:
            t = list(docs[r.randrange(len(docs))])  # a copy, perhaps with an edit
            if r.random() < 0.6 and t:
                t[r.randrange(len(t))] = word()
        elif kind == 1:
            t = ["same"] * r.choice([10, 20, 21, 90])
        else:
            t = [word() for _ in range(r.choice([0, 5, 30, 120]))]
            for _ in range(r.choice([0, 1, 1, 2])):
                s = r.choice(shared)
                a = r.randrange(len(t) + 1)
                t[a:a] = s[r.randrange(2) :]
        docs.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,hot,run", [(1, relative_lz.HOT, relative_lz.RUN_WORDS), (2, 3, 400), (3, 2, 2000)])
def test_removal_equals_brute_force(spark, seed, hot, run):
    """Also with small runs and nearly every anchor dealt out by window."""
    rows = _passages(seed, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in relative_lz.deduplicated(docs, hot, run).collect()]
    assert sorted(got, key=_key) == sorted(_removed(rows), key=_key)


def test_removal_on_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in relative_lz.deduplicated(odd_docs).collect()]
    assert sorted(got, key=_key) == sorted(_removed(rows), key=_key)
    assert relative_lz.deduplicated(no_docs).count() == 0


def test_removal_of_equal_rows_and_null_ids(spark):
    """Of equal rows one stays; a null id comes before all others; different texts under one id are documents of their own."""
    text = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (5, text), (None, text), (9, other), (9, other + " tail")], "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in relative_lz.deduplicated(docs).collect())
    assert got[(None, 40, 0)] == 1 and got[(5, 40, 40)] == 3
    assert {k for k in got if k[0] == 9} in ({(9, 30, 0), (9, 31, 30)}, {(9, 30, 30), (9, 31, 0)})


def test_reference_holds_each_window_once():
    ref = relative_lz.Reference()
    assert ref.factors([1, 2, 3, 4]) == []
    assert ref.factors([9, 2, 3, 8, 4, 1]) == [(1, 3), (4, 5), (5, 6)]  # no factor runs across unlike neighbours
    assert ref.factors([9, 8, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 6)]


# ----------------------------------------------------------------- operator 12


def _collocations(rows, least, first=2000):
    import re

    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", x):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    by = defaultdict(list)
    for (lang, p), a in f.items():
        if a < least or len(p) < 2:
            continue
        if any(f[(lang, q)] >= a for q in by_sub(f, lang, p)):
            continue
        score, k = min(((1000 * a * n[lang]) // (f[(lang, p[:k])] * f[(lang, p[k:])]), k) for k in range(1, len(p)))
        by[lang].append((-score, -a, " ".join(p).encode(), f[(lang, p[:k])], f[(lang, p[k:])]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in by.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:first], 1))


def by_sub(f, lang, p):
    """Phrases of up to five words that hold ``p`` and occur."""
    return [q for x, q in f if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]


def _prose(seed, n):
    r = random.Random(seed)
    phrases = ["new york city", "machine learning", "a b c d e f g", "in the long run", "Große Straße"]
    out = []
    for _ in range(n):
        t = []
        for _ in range(r.randrange(30)):
            t.append(r.choice(phrases) if r.random() < 0.2 else r.choice(["the", "of", "x", "y", "z", "New", "York", "run", "ü", "\x00", "\xa0"]))
            t.append(r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?"]))
        out.append((r.choice(["en", "de", None, "und"]), "".join(t)))
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations_equal_brute_force(spark, shards):
    rows = _prose(shards, 160) + [("en", None), ("en", ""), (None, " \t\n"), ("xx", "one"), ("en", "same row twice"), ("en", "same row twice")]
    docs = spark.createDataFrame([(i, x, t, 1, "w", 2) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, n long, words string, shard int").repartition(4)
    got = sorted(tuple(r) for r in collocations.mined(docs, shards, 12).collect())
    want = _collocations(rows, 12)
    assert len(want) > 20 and got == want
    assert sorted(tuple(r) for r in collocations.mined(docs, shards, 12, 3).collect()) == _collocations(rows, 12, 3)


def test_collocations_with_few_slots(spark):
    """Where many phrases share a slot more is counted than need be, and every count stays exact."""
    rows = _prose(7, 60)
    docs = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string").repartition(2)
    folder = collocations.folder_of(docs, 3)
    frequent = collocations.counts(spark, folder, 1, 3, 8, 64)
    f = Counter()
    import re

    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", text.lower()):
            w = re.findall(r"[^ \t]+", piece)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert sorted((r["k"], r["n"]) for r in frequent.collect()) == sorted((len(p), a) for (_, p), a in f.items() if a >= 8)


@pytest.mark.parametrize("size", [0, 1, 50_000])
def test_packed_phrases_take_few_bytes(size):
    """Names of a bucket lie close together, so a phrase takes less than its name alone."""
    g, buckets = np.random.default_rng(1), 64
    key = np.unique(g.integers(0, 2**64, size * buckets, np.uint64))
    bucket = collocations.bucket_of(key, buckets)
    assert (np.diff(bucket) >= 0).all() and (not size or set(bucket.tolist()) <= set(range(buckets)))
    key = key[bucket == bucket[:1]]
    s = np.zeros(len(key), collocations._STATE)
    s["key"], s["n"], s["shards"], s["first"], s["k"] = key, g.geometric(0.8, len(key)), 1, 2, g.integers(1, 6, len(key))
    blob = collocations.packed(s)
    assert (collocations.unpacked(pa.py_buffer(blob)) == s).all()
    assert size < 1000 or len(blob) < 6.5 * len(s)


def test_dictionary_of_words_without_hashes(spark):
    """Spark finds a word's hash from the word, so that the dictionary holds words alone."""
    words = ["a", "größe", "漢字🙂", "\x00", "x" * 200, "new-york", "ſ", "abcd" * 8]
    folder = collocations.folder_of(spark.createDataFrame([(1, "en", " ".join(words))], "doc_id long, lang string, text string"), 2)
    table = spark.read.parquet(folder)
    assert "hash" not in table.columns
    hashes = {h for r in table.where("shard >= 0").collect() for h in r["words"]} - {0}
    got = {r["word"]: r["h"] for r in table.where("shard = -1").select("word", collocations.hash_of("word").alias("h")).collect()}
    assert set(got) == set(words) and set(got.values()) == hashes


def test_shuffles_go_with_the_write(spark, tmp_path):
    """What a step has shuffled leaves the disk when its table is written, not when the driver's memory is cleaned."""
    from lares.session import shuffles_dropped

    def held():
        return {f for top in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{top}/*/shuffle_*.data")}

    def write(name):
        spark.range(1000).repartition(3, "id").write.parquet(f"{tmp_path}/{name}")

    before, setting = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with shuffles_dropped(spark):
        write("a")
    assert held() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    write("b")
    assert not held() <= before  # the files are looked for in the right place


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.mined(no_docs).count() == 0


def test_collocations_of_rare_words(spark):
    """Buckets whose phrases are all dropped."""
    docs = spark.createDataFrame([(1, "en", "one"), (2, None, "two three")], "doc_id long, lang string, text string")
    assert collocations.mined(docs, 1).count() == 0


# ----------------------------------------------------------------- operator 13


def _hard(rows):
    """Brute force on rows (vec_id, vector, label), anchors divisible by 50."""
    keep = [(i, np.floor(256 * np.array(v, float)).astype(int), x) for i, v, x in rows if v is not None and x is not None and all(c is not None and np.isfinite(c) for c in v)]
    out, order = [], lambda i: (i is not None, i or 0)
    for a, (ai, av, al) in enumerate(keep):
        if ai is None or ai % 50:
            continue
        s = [(-int(av @ v), order(i), i, x) for b, (i, v, x) in enumerate(keep) if b != a]
        for p in sorted(t for t in s if t[3] == al)[:5]:
            fit = sorted(t for t in s if t[3] != al and 50 * -p[0] <= 100 * -t[0] <= 95 * -p[0])[:3]
            out += [(ai, p[2], k, t[2], -p[0], -t[0]) for k, t in enumerate(fit, 1)]
    return out


def _sort(rows):
    return sorted(tuple((v is not None, v or 0) for v in r) for r in rows)


@pytest.mark.parametrize("shard,block,scale,dims", [(hardneg.SHARD, hardneg.BLOCK, 1.0, 16), (37, 2, 1.0, 13), (64, 3, 40000.0, 8)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shard, block, scale, dims):
    monkeypatch.setattr(hardneg, "SHARD", shard)
    monkeypatch.setattr(hardneg, "BLOCK", block)
    r = np.random.default_rng(dims)
    centres = r.normal(size=(4, dims))
    rows = [(i, [float(x) for x in scale * (centres[i % 4] + 0.7 * r.normal(size=dims)).round(2)], int(i % 4) if r.random() < 0.8 else int(r.integers(4))) for i in range(420)]
    rows += [rows[50], rows[51], rows[52], (None, rows[3][1], 1), (1000, None, 1), (1001, [None] * dims, 1), (1002, [float("nan")] * dims, 1), (1003, [float("inf")] + [0.0] * (dims - 1), 2), (1050, rows[0][1], None), (1100, [0.0] * dims, 2)]
    docs = spark.createDataFrame([(i, v, x, 7, "x") for i, v, x in rows], "vec_id long, embedding array<double>, label int, r long, q string").repartition(4)
    from pyspark.sql import functions as F

    got = [tuple(x) for x in hardneg.hard_negatives(docs, F.col("vec_id") % 50 == 0).collect()]
    assert got and _sort(got) == _sort(_hard(rows))


def test_scores_are_inner_products():
    r = np.random.default_rng(1)
    for dims, most in ((1, 1), (7, 300), (8, 300), (21, 30000)):
        a, x = r.integers(-most, most + 1, (9, dims)), r.integers(-most, most + 1, (33, dims))
        planes = int(most).bit_length() + 1
        assert (hardneg.scores(hardneg.subset_sums(a, np.int64), hardneg.planes_of(x, planes)) == x @ a.T).all()


def test_hard_negatives_of_nothing(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(50, [1e15, 1.0], 1), (51, [1e15, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(OverflowError):
        hardneg.hard_negatives(big, F.col("vec_id") % 50 == 0)
