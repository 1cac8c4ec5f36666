"""Byte-pair encoding of whole texts by a traversal of a prefix trie, and decoding (operator 4).

Encoding a word greedily by merge rank has a useful property: the encoding of a prefix is fixed
by its *last token* and the encoding of what comes before that token. So each trie node (a
prefix) needs one state, its last token: the longest token that ends there and may follow the
last token of the node where it begins. Whether two tokens may be neighbours is decided by
undoing their merges along the seam, and remembered.

Per batch, the distinct words not yet known are inserted in a trie, a depth-first walk carries
the states down, and a prefix shared by many words is worked out once. A word's ids follow from
its node by stepping back over last tokens. Decoding goes from ids to token bytes to text.

Each batch of documents is independent: no shuffle, and nothing is lost with an executor but its
memory of words, which is bounded.

Defined results: null text is the empty text (no ids, empty decoding); the special token's string
inside a text becomes its id, as in the library; ids of documents are passed through, null or
repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.llm.common import bounded_batches
from lares.llm.tokens import Recent, default_vocabulary

#: The most pairs of tokens whose seam is remembered.
SEAMS = 2_000_000

#: Longer words (in characters) are not remembered.
LONG = 1_000

#: White space and the byte-level split of texts in words.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 byte values: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


def _trie(words: list[str]) -> dict[int, tuple[bytes, dict]]:
    """Edges by first byte: (label, node below); an edge is as long as no word ends or branches off inside. ``-1`` holds the word that ends at a node."""
    root: dict = {}
    for w in words:
        rest, node = w.encode(), root
        while rest:
            label, below = node.get(rest[0], (b"", None))
            if below is None:
                node[rest[0]] = (rest, below := {})
                node, rest = below, b""
            elif rest.startswith(label):
                node, rest = below, rest[len(label) :]
            else:
                same = len(commonprefix([label, rest]))
                middle = {label[same]: (label[same:], below)}
                node[rest[0]] = (label[:same], middle)
                node, rest = middle, rest[same:]
        node[-1] = w
    return root


class TrieEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: as_bytes(t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        special_ids = set(self.special.values())
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in special_ids}
        # rank and parts of every merged token; single bytes have rank -1
        self.rank: dict[int, int] = {i: -1 for b, i in self.id_of.items() if len(b) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, token = (self.id_of[a], self.id_of[b]), self.id_of[a + b]
            self.merged.setdefault(pair, rank)
            if token not in self.rank:
                self.rank[token], self.parts[token] = rank, pair
        self.seams: dict[tuple[int, int], bool] = {}
        # a token that the merges never give for its own bytes can't occur
        for t in sorted(self.parts, key=self.rank.__getitem__):
            a, b = self.parts[t]
            if not (a in self.rank and b in self.rank and self._seam(a, b, self.rank[t])):
                del self.id_of[self.bytes_of[t]]
        self.seams.clear()
        self.longest = max(map(len, self.id_of))
        #: every suffix of a token: the token it is, or -1
        self.ends: dict[bytes, int] = {b[k:]: -1 for b in self.id_of for k in range(1, len(b))} | self.id_of
        self.known = Recent()

    def _seam(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """May ``left`` be followed by ``right``: does no merge across the seam come before ``limit`` or before a merge inside that it would break?

        The merges inside the two tokens are undone latest first. Whatever stands at the seam
        then must not have a merge of a rank below that of the merge undone last.
        """
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # of equal ranks the leftmost is merged first: the seam comes after the left token and before the right one
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def _learn(self, words: list[str]) -> None:
        """Encode new words: one trie, one depth-first walk. Time and memory are linear in the bytes of the trie."""
        seams, known, longest = self.seams, self.known.now, self.longest
        if len(seams) > SEAMS:
            seams.clear()
        ends = self.ends
        last, begins = array("i", [-1]), array("i", [0])  # states of the places on the present path: last token, where it begins
        stack = [(0, b"", edge) for edge in _trie(words).values()]
        while stack:
            depth, tail, (label, node) = stack.pop()
            del last[depth + 1 :], begins[depth + 1 :]
            path = tail + label  # as much of the path as a token can reach back
            before = depth - len(tail)
            for end in range(len(tail) + 1, len(path) + 1):
                # tokens that end here: longer and longer suffixes, while some token has them at its end
                fitting = []
                for begin in range(end - 1, -1, -1):
                    token = ends.get(path[begin:end])
                    if token is None:
                        break
                    if token >= 0:
                        fitting.append((before + begin, token))
                for begin, token in reversed(fitting):
                    if begin:
                        pair = (last[begin], token)
                        fits = seams.get(pair)
                        if fits is None:
                            fits = seams[pair] = self._seam(*pair)
                        if not fits:
                            continue
                    last.append(token)
                    begins.append(begin)
                    break
            depth, tail = before + len(path), path[-longest:]
            for byte, edge in node.items():
                if byte == -1:
                    known[edge] = self._ids(last, begins, depth)
                else:
                    stack.append((depth, tail, edge))

    @staticmethod
    def _ids(last: array, begins: array, at: int) -> bytes:
        """The ids of the path up to ``at``, by stepping back over last tokens."""
        out = []
        while at:
            out.append(last[at])
            at = begins[at]
        return array("I", out[::-1]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        marks = self.special
        pieces: list[list[str]] = []
        for text in texts:
            if any(m in text for m in marks):
                split = regex.split("(" + "|".join(map(regex.escape, marks)) + ")", text)
                pieces.append([w for part in split for w in ([part] if part in marks else WORDS.findall(part))])
            else:
                pieces.append(WORDS.findall(text))
        new = self.known.unknown({w for p in pieces for w in p}.difference(marks))
        known = self.known.now
        for m, i in marks.items():
            known[m] = i.to_bytes(4, "little")
        if new:
            self._learn(new)
        out = [b"".join(map(known.__getitem__, p)) for p in pieces]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, vocabulary: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; with ``keep`` also ids (binary) and decoded text."""
    bounded_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary("byte_bpe_50k.json")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")

    def run(batches):
        encoder = trie_encoder(path)
        for b in batches:
            ids = encoder.encode([t or "" for t in b.column(1).to_pylist()])
            texts = [encoder.decode(i) for i in ids]
            cols = [b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
            if keep:
                cols += [pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
