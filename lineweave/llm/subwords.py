"""Public tokenizers; the folder that holds their files is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

FOLDER = "/opt/tokenizers"
#: The splitting pattern that goes with byte_bpe_50k (a fixed value of that tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken"):  # noqa: ANN201
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def characters_per_subword(text: str, folder: str = FOLDER) -> float:
    """How many characters a subword covers on average: about 4 for words, under 2 for random strings; 0 for an empty text."""
    return len(text) / len(encoding(folder).encode_ordinary(text)) if text else 0.0
