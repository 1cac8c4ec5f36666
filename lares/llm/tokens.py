"""Token ids of whole texts under the word vocabulary, with the tokenizers library.

The library splits a normalised text into pieces and encodes each on its own, so the ids of a
text are the ids of its pieces, joined. Each distinct piece is encoded once by the library and
remembered, and so are the words that pieces make up (bounded, see ``Recent``). Texts outside plain Latin letters, where normalisation may
join characters, are given to the library whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import partial

#: Entries of one generation of a worker's memory of words or pieces.
CACHE = 200_000
#: New pieces given to the library in one call.
JOINED = 4096

#: Characters for which normalisation is lower-casing alone, and the vocabulary's own piece pattern on them.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """A bounded memory of results by word: two generations, so that what is in use is kept and the rest forgotten."""

    def __init__(self, limit: int | None = None):
        self.limit = limit or CACHE
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def unknown(self, words: set[str]) -> list[str]:
        """Brings known ``words`` into the present generation; returns the others. Begins a new generation when one is full."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        out = []
        for w in words.difference(self.now):
            old = self.before.get(w)
            if old is None:
                out.append(w)
            else:
                self.now[w] = old
        return out


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._ends = {i for t, i in self._library.get_vocab(False).items() if t.endswith("</w>")}
        self._pieces, self._words = Recent(), Recent()

    def _whole(self, text: str) -> bytes:
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces in one call, a space between them; the ids of a piece end with a word-end token."""
        ids, at, out = self._library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, 0, []
        for i, token in enumerate(ids, 1):
            if token in self._ends:
                out.append(array("I", ids[at:i]).tobytes())
                at = i
        if len(out) != len(pieces) or at != len(ids):
            out = [array("I", e.ids).tobytes() for e in self._library.encode_batch(pieces, add_special_tokens=False)]
        self._pieces.now.update(zip(pieces, out, strict=True))

    def _split(self, words: list[str]) -> None:
        """Encode new words by their pieces."""
        pieces = [PIECE.findall(w) for w in words]
        new = self._pieces.unknown({p for ps in pieces for p in ps})
        for i in range(0, len(new), JOINED):
            self._learn(new[i : i + JOINED])
        known = self._pieces.now
        self._words.now.update((w, b"".join([known[p] for p in ps])) for w, ps in zip(words, pieces, strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """No piece holds white space, so the ids of a plain text are those of its words."""
        words: list[list[str] | None] = [t.lower().split() if PLAIN.fullmatch(t) and not any(s in t for s in self._special) else None for t in texts]
        new = self._words.unknown({w for ws in words if ws for w in ws})
        if new:
            self._split(new)
        known = self._words.now
        return [self._whole(t) if ws is None else b"".join(map(known.__getitem__, ws)) for t, ws in zip(texts, words, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def rank_encoder(path: str):
    """text -> its ids as an array, by a tiktoken encoder of a rank file, one per worker process.

    The library's buffer of ids becomes an array without a Python integer per id. It wants a special
    token; none is allowed in a text, so its string is ordinary text.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": max(ranks.values()) + 1})
        _ENCODERS[path] = partial(encoding.encode_to_numpy, allowed_special=set(), disallowed_special=())
    return _ENCODERS[path]
