"""Ids as arrays, equal to the library's for ordinary text."""

import base64

import numpy as np

from lares.llm.tokens import default_vocabulary, rank_encoder


def test_ids_are_arrays_equal_to_the_librarys():
    import public_tokenizers
    import tiktoken

    path = default_vocabulary("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("", "a b  c\n", "<|endoftext|>", "x<|endoftext|>é<|endof", "日本語 ñandú 12345"):
        ids = rank_encoder(path)(text)
        assert isinstance(ids, np.ndarray) and ids.tolist() == plain.encode_ordinary(text)
