"""Token ids of whole texts, as used by packing and token counts.

The ids are those that the ``tokenizers`` library gives with ``byte_bpe_50k.json``. They are made by
``tiktoken`` from the same vocabulary given as ranks, which takes a sixth of the time; the tests hold
both to be equal. Added tokens of the vocabulary, read from the JSON file beside the ranks, are matched inside
texts if ``encode_special_tokens`` is false, which is the library's own default and what packing and
token counts use. ``tiktoken`` refuses texts with very long runs of white space; their ids are made by
``tokenizers`` itself. The path is a parameter; nothing of the vocabulary is kept here.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np

END_OF_DOCUMENT = 1


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(ranks: str) -> dict[str, int]:
    """Tokens beside the ranks that the library matches inside texts; none without a JSON file."""
    path = os.path.splitext(ranks)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that look at the text around them are not supported")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=2)
def encoder(ranks: str | None = None):
    import public_tokenizers
    import tiktoken

    ranks = ranks or default_ranks()
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added_tokens(ranks)
    )


@lru_cache(maxsize=2)
def library(ranks: str, encode_special_tokens: bool):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(os.path.splitext(ranks)[0] + ".json")
    own.encode_special_tokens = encode_special_tokens
    return own


def token_ids(
    text: str | None, ranks: str | None = None, end: int = END_OF_DOCUMENT, encode_special_tokens: bool = True
) -> np.ndarray:
    """Ids of one text and an end-of-document id, as little-endian unsigned 32-bit numbers.

    ``encode_special_tokens`` is the library's switch: if false, an added token in the text is its own id.
    """
    try:
        if not text:
            own = []
        elif encode_special_tokens:
            own = encoder(ranks).encode_ordinary(text)
        else:
            own = encoder(ranks).encode(text, allowed_special="all", disallowed_special=())
    except ValueError:  # a run of white space beyond the stack of its pattern matcher
        own = library(ranks or default_ranks(), encode_special_tokens).encode(text, add_special_tokens=False).ids
    own.append(end)
    return np.array(own, dtype="<u4")
