"""Token counts under a public byte-level BPE vocabulary.

The vocabulary's path is a parameter.  A byte-level vocabulary keeps the whole
text and never makes more tokens than the text has bytes; callers use that bound
to skip short texts without changing any result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pre-token pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = DEFAULT_VOCABULARY):
    """The encoder of a rank file, loaded once per Python worker."""
    import tiktoken

    ranks = {}
    with open(vocabulary, "rb") as lines:
        for line in lines:
            piece, _, rank = line.partition(b" ")
            if rank:
                ranks[base64.b64decode(piece)] = int(rank)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of ``text`` as a bigint; null and empty texts have none."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
