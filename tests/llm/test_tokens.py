"""Packing, shards and byte-pair encoding against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest

from lares.llm import packing, shards, tokens, trie_bpe
from lares.llm.tokens import WordEncoder, default_vocabulary

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "\x1c", "\x85", "\xa0", "é", "é", "Σ", "ΑΣ", "漢字", "🙂", "<|endoftext|>", "<|startoftext|>", "1", "2³", "!!", "...", "‍", "İ", "ª", "\r\n", "ing", "tion", "aaaaaaaa",
            "ababab", "zzzz", "----", "\xad", "\x00", "\x7f", "ﬁ", "'S", "_"]


def _library(name):
    return tokenizers.Tokenizer.from_file(default_vocabulary(name))


def _texts(n=1500):
    r = random.Random(3)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(200)]


def test_trie_encoding_equals_library():
    lib, ours, texts = _library("byte_bpe_50k.json"), trie_bpe.TrieEncoder(default_vocabulary("byte_bpe_50k.json")), _texts()
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert list(array("I", ids)) == want, text
        assert ours.decode(ids) == lib.decode(want, skip_special_tokens=False)


def _long_words(n):
    r = random.Random(5)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    return [letters, letters + "x", letters[: n // 2] + "Q", "a" * n, "-" * (n // 8), "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n // 3)), "é" * n]


def test_long_words_cost_what_their_length_is():
    """Runs of letters, unspaced ideographs and long words that share a beginning: equal to the library, memory linear, none remembered."""
    lib, ours, texts = _library("byte_bpe_50k.json"), trie_bpe.TrieEncoder(default_vocabulary("byte_bpe_50k.json")), _long_words(30_000)
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert list(array("I", ids)) == lib.encode(text, add_special_tokens=False).ids
    assert not set(texts) & set(ours.known.now)
    tracemalloc.start()
    ours.encode(_long_words(150_000)[:1])
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_trie_branches_anywhere():
    """Words that are beginnings of others, and control characters on both sides of a branch."""
    words = ["\x01\x01", "\x01", "\x01\x00", "\x00", "\x00\x01\x01", "!!", "!", "!!!\x01", "abc", "ab", "abd", "a", "abcde"]
    lib = _library("byte_bpe_50k.json")
    for order in (words, words[::-1], sorted(words)):
        ours = trie_bpe.TrieEncoder(default_vocabulary("byte_bpe_50k.json"))
        ours._learn(order)
        assert {w: list(array("I", ours.known.now[w])) for w in words} == {w: lib.encode(w, add_special_tokens=False).ids for w in words}


def test_trie_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    lib, ours, texts = _library("byte_bpe_50k.json"), trie_bpe.TrieEncoder(default_vocabulary("byte_bpe_50k.json")), _texts(60)
    word_lib, word_ours = _library("word_bpe_49k.json"), WordEncoder(default_vocabulary("word_bpe_49k.json"))
    for text in texts:
        assert list(array("I", ours.encode([text])[0])) == lib.encode(text, add_special_tokens=False).ids
        assert list(array("I", word_ours.encode(text))) == word_lib.encode(text, add_special_tokens=False).ids
        assert len(ours.known.now) + len(ours.known.before) < 300


def test_word_encoding_equals_library():
    lib, ours, texts = _library("word_bpe_49k.json"), WordEncoder(default_vocabulary("word_bpe_49k.json")), _texts()
    for text, ids in zip(texts, ours.encode_all(texts), strict=True):
        assert list(array("I", ids)) == lib.encode(text, add_special_tokens=False).ids, text


def test_bpe_operator_on_odd_rows(odd_docs, no_docs):
    lib = _library("byte_bpe_50k.json")
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in trie_bpe.encoded(odd_docs).collect())
    want = []
    for r in odd_docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"] or -1, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert trie_bpe.encoded(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_packing(seed):
    r = random.Random(seed)
    size = r.choice([64, 2048])
    histogram = defaultdict(int)
    for _ in range(r.choice([3, 40, 400])):
        histogram[min(size, int(r.lognormvariate(5 if size > 100 else 2.5, 1.2)) + 1)] += r.choice([1, 2, 30])
    rows, bins = packing.plan(dict(histogram), size)
    inside, placed = defaultdict(list), defaultdict(int)
    for length, r0, r1, bin0, per_bin, at in rows:
        assert r0 == placed[length]
        placed[length] = r1
        for k in range(r1 - r0):
            inside[bin0 + k // per_bin].append((at + k % per_bin * length, length))
    assert dict(placed) == dict(histogram) and len(inside) == bins
    for items in inside.values():
        end = 0
        for at, length in sorted(items):
            assert at == end
            end += length
        assert end <= size


def test_plan_is_close_to_the_bound():
    r = random.Random(0)
    histogram = defaultdict(int)
    for _ in range(50_000):
        histogram[min(2048, int(r.lognormvariate(6, 1)) + 1)] += 1
    _, bins = packing.plan(dict(histogram), 2048)
    assert bins <= 1.005 * -(-sum(k * v for k, v in histogram.items()) // 2048)
    assert packing.plan({}, 2048) == ([], 0)


def _check_packed(docs, rows, size):
    lib = _library("word_bpe_49k.json")
    want = sorted((d or -1, i, s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size].tobytes())) for d, ids in
                  ((r["doc_id"], np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")) for r in docs.collect())
                  for i, s in enumerate(range(0, len(ids), size)))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        end = 0
        for at, length in sorted(items):
            assert at == end
            end += length
        assert end <= size


def test_packing_operator(odd_docs, no_docs, corpus):
    for docs, size in ((odd_docs, 2048), (odd_docs, 16), (corpus, 2048)):
        _check_packed(docs, packing.packed(docs, size=size).collect(), size)
    assert packing.packed(no_docs).count() == 0


def test_packing_with_salted_ranks(odd_docs, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 3)
    _check_packed(odd_docs, packing.packed(odd_docs, size=16).collect(), 16)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1000, 65_537])
def test_feistel_is_a_keyed_bijection(n):
    f = shards.Feistel(n, 7)
    slots = f.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (f.numbers(slots) == np.arange(n)).all()
    if n == 1000:
        assert (shards.Feistel(n, 8).slots(np.arange(n)) != slots).any() and (slots != np.arange(n)).mean() > 0.9


def test_shards_round_trip_and_resume(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    lib = _library("byte_bpe_50k.json")
    lib.encode_special_tokens = True
    table = str(tmp_path / "docs")
    odd_docs.write.parquet(table)
    docs = spark.read.parquet(table)
    total = shards.write(docs, str(tmp_path / "out"))
    got = shards.read_from(spark, str(tmp_path / "out")).collect()
    assert sorted(r["slot"] for r in got) == list(range(total))
    want = sorted((d if d is not None else -1, p, ids[s : s + 256].tobytes()) for d, ids in
                  ((r["doc_id"], np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 50256], dtype="<u2")) for r in docs.collect()) for p, s in enumerate(range(0, len(ids), 256)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], bytes(r["ids"])) for r in got) == want
    later = shards.read_from(spark, str(tmp_path / "out"), slot=5).collect()
    assert sorted(later) == sorted(r for r in got if r["slot"] >= 5)
    assert len(shards.listed(spark, str(tmp_path / "out")).collect()) == total
    assert shards.write(no_docs, str(tmp_path / "none")) == 0
