"""The corpus pipeline, stage by stage, against brute force."""

import pytest

import corpus_pipeline
from lares.llm import langid, packing, quality
from test_sigtree import _brute  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, corpus):
    from lares.session import cut

    # prose in the corpus' own words, with a secret in the middle
    words = sorted({w for r in corpus.where("lang = 'en'").limit(40).collect() for w in r["text"].split() if w.isalpha()})
    rows = []
    for i in range(3):
        text = " ".join(words[i::7][:60]) + ' token = "0123456789abcdef0123456789abcdef" ' + " ".join(words[i + 3 :: 7][:60])
        rows.append((100_000 + i, text, "en", "src0", len(text)))
    docs = cut(corpus.unionByName(spark.createDataFrame(rows, corpus.schema)))
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = out[name] = cut(stage(spark, docs, ""))
        assert docs.columns == COLUMNS
    return out


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]


def test_decisions_take_effect(spark, kept):
    assert _ids(kept["quality_rules"]) == _ids(quality.judged(kept["documents"]).where("kept"))
    assert _ids(kept["language_id"]) == _ids(langid.predicted(kept["quality_rules"]).where("NOT rejected"))
    rows = [(r["doc_id"], r["text"]) for r in kept["language_id"].collect()]
    assert _ids(kept["ngram_jaccard_join"]) == sorted(d for d, _, c in _brute(rows) if d == c)
    before = {r["doc_id"]: r["text"] for r in kept["ngram_jaccard_join"].collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept["secret_scans"].collect()}
    assert set(before) == set(after) and all("[SECRET]" in after[100_000 + i][0] and "0123456789abcdef" not in after[100_000 + i][0] for i in range(3))
    assert all(t == before[d] or "[SECRET]" in t for d, (t, _) in after.items()) and all(len(t) == n for t, n in after.values())


def test_clean_documents_stay(kept):
    """Quality rules take junk, not prose: most documents without repeats or symbols stay."""
    clean = [r["doc_id"] for r in kept["documents"].collect() if not set(r["text"]) & set("#*$%&|<>!=") and len(set(r["text"].split())) > 0.3 * len(r["text"].split()) > 6]
    stay = set(_ids(kept["quality_rules"]))
    assert sum(d in stay for d in clean) >= 0.98 * len(clean)


def test_packing_is_the_last_stage(spark, kept):
    got = corpus_pipeline.STAGES[-1][1](spark, kept["secret_scans"], "").collect()
    assert sorted({r["doc_id"] for r in got}) == _ids(kept["secret_scans"])
    assert max(r["offset"] + r["length"] for r in got) <= packing.SIZE


def test_rows_that_share_an_id(spark, corpus):
    """Decisions are a row's own: different texts under one id stay, a bad text goes though a good one has its id."""
    words = sorted({w for r in corpus.where("lang = 'en'").limit(40).collect() for w in r["text"].split() if w.isalpha()})
    good = [" ".join(words[i::9][:80]) for i in range(4)]
    rows = [(7, good[0]), (7, good[1]), (7, good[2]), (8, good[3]), (8, "bad short text"), (None, good[0] + " tail"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], corpus.schema)
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == sorted((i or -1, t) for i, t in rows if t and "bad" not in t)
    got = corpus_pipeline.ngram_jaccard_join(spark, got, "")
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(7, t) for t in sorted(good[:3])] + [(8, good[3])]


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    """Every stage on its own: which rows of the odd table it keeps."""
    texts = {r["text"] for r in odd_docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "").count() == 0
        got = stage(spark, odd_docs, "")
        if name == "best_fit_packing":
            assert got.select("doc_id", "piece").distinct().count() >= 11
            continue
        assert got.columns == odd_docs.columns
        rows = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert all(t in texts for _, t in rows)
        ids = sorted((i is not None, i or 0) for i, _ in rows)
        if name == "secret_scans":
            assert len(rows) == 13
        if name == "ngram_jaccard_join":  # 1 to 3 are near copies, the two rows of 7 equal; what has no words links with nothing
            assert ids == [(False, 0), *[(True, i) for i in (1, 4, 5, 7, 8, 9, 10, 11, 12)]]
        if name == "quality_rules":
            assert not {4, 5, 7, 8, 9} & {i for i, _ in rows}
        if name == "language_id":
            assert not {4, 5, 8, 12} & {i for i, _ in rows}
