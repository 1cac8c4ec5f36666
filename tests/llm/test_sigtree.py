"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from lares.llm import sigtree


def _brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((rows[i][0] if rows[i][0] is not None else -1, len(sets[i]), -1 if least[find(i)] is None else least[find(i)]) for i in range(len(rows)))


def _got(docs):
    return sorted(tuple(-1 if v is None else v for v in r) for r in sigtree.joined(docs).select("doc_id", "n_shingles", "component_id").collect())


def _near_duplicates(seed, n=260):
    """Families of edited copies about the threshold, a passage many documents share, exact copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(30)]
    texts = []
    while len(texts) < n:
        base = [word() for _ in range(r.choice([3, 6, 20, 60, 150]))]
        for _ in range(r.choice([1, 1, 2, 9, 25])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = word()
            if r.random() < 0.3:
                t += passage
            texts.append(" ".join(t).upper() if r.random() < 0.1 else " ".join(t))
    return [(i * 3, t) for i, t in enumerate(texts[:n])]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(sigtree, "BLOCK", block)
    rows = _near_duplicates(seed)
    random.Random(seed).shuffle(rows)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == _brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert _got(odd_docs) == _brute(rows)
    assert sigtree.joined(no_docs).count() == 0


def test_traversal_loses_no_pair():
    """Every pair of leaves of different classes that reaches the similarity survives both trees."""
    r = np.random.default_rng(4)
    sets, cls = [], []
    for family in range(40):
        base = r.integers(0, 1 << 40, r.integers(5, 200))
        for _ in range(r.integers(1, 6)):
            s = np.where(r.random(len(base)) < 0.06, r.integers(0, 1 << 40, len(base)), base)
            sets.append(np.unique(s))
            cls.append(len(sets))
    order = r.permutation(len(sets))
    sets, cls = [sets[i] for i in order], np.array(cls)[order]
    sig = np.stack([np.packbits(np.bincount(s % sigtree.BITS, minlength=sigtree.BITS) > 0, bitorder="little").view(np.uint64) for s in sets])
    n = np.array([len(s) for s in sets])
    tree = sigtree.Tree(sig, n, cls)
    found = {(int(a), int(b)) for i, j in sigtree.traverse(tree, tree, True) for a, b in zip(i, j, strict=True)}
    half = len(sets) // 2
    x, y = sigtree.Tree(sig[:5], n[:5], cls[:5]), sigtree.Tree(sig[half:], n[half:], cls[half:])
    across = {(int(a), int(b) + half) for i, j in sigtree.traverse(x, y, False) for a, b in zip(i, j, strict=True)}
    pairs = 0
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                pairs += 1
                assert (i, j) in found
                assert not (i < 5 and j >= half) or (i, j) in across
    assert pairs and len(found) < len(sets) * (len(sets) - 1) / 2 / 3
    same = sigtree.Tree(sig, n, np.zeros(len(n), dtype=np.int64))
    assert not list(sigtree.traverse(same, same, True))
