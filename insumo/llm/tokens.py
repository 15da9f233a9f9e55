"""Token counts by a public tokenizer's rank file."""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank file of a public byte-level tokenizer; a parameter everywhere.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of such a file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker; when full, the memory starts anew (the counts don't change).
PIECES = 500_000


@cache
def _splitter() -> re.Pattern:
    """PATTERN for the standard library, several times as fast: letters are word characters that are no number and no underscore."""
    numbers = "".join(map(chr, (c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Nl", "No"))))
    number = rf"\d{re.escape(numbers)}"
    return re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", f"[^\\W_{number}]").replace(r"\p{N}", f"[{number}]"))


class Counter(dict):
    """Tokens of each piece, computed when first asked for."""

    def __init__(self, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= PIECES:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, _splitter().findall(text))) if text else 0


@lru_cache(2)
def counter(ranks: str) -> Counter:
    """One counter of a rank file in each worker."""
    return Counter(ranks)


def token_count(text: Column, ranks: str = RANKS) -> Column:
    """Tokens of a text, 0 for null and ''."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        c = counter(ranks)
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    return count(text)
