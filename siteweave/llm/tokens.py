"""Byte-level BPE ids from public vocabulary files.

Ids are those of the ``tokenizers`` library for the JSON file.  The same
vocabulary also comes as ranks, which ``tiktoken`` encodes several times
faster to the same ids; texts for which the two might differ (the special
token's string, letters outside the scripts both were checked on) and texts
that the fast path refuses go to ``tokenizers``.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

JSON_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Texts with a byte from here on hold code points beyond U+027F.
FIRST_UNCHECKED_BYTE = 0xCA
#: A longer run without white space is left to ``tokenizers``, whose merge is not quadratic in it.
LONGEST_RUN = 20_000


def _path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def exact(json_file: str = JSON_FILE):
    """The reference encoder; ids of these texts hold by definition."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_path(json_file))


@lru_cache(maxsize=2)
def fast(ranks_file: str = RANKS_FILE):
    import public_tokenizers
    import tiktoken

    with open(_path(ranks_file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("siteweave", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _checked(text: str) -> bool:
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return True
    if raw.max() >= FIRST_UNCHECKED_BYTE or "<|" in text:
        return False
    if len(raw) <= LONGEST_RUN:
        return True
    solid = raw > 0x20
    breaks = np.flatnonzero(np.diff(np.concatenate([[not solid[0]], solid, [not solid[-1]]]).astype(np.int8)))
    return int(np.diff(breaks).max()) <= LONGEST_RUN


def encode(text: str | None, json_file: str = JSON_FILE, ranks_file: str | None = RANKS_FILE) -> np.ndarray:
    """Ids of a whole text as uint32; none for a null or empty one."""
    if not text:
        return np.zeros(0, np.uint32)
    if ranks_file and _checked(text):
        return np.asarray(fast(ranks_file).encode_to_numpy(text, disallowed_special=()), np.uint32)
    return np.array(exact(json_file).encode(text, add_special_tokens=False).ids, np.uint32)
