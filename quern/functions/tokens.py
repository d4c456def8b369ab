"""Tokenising in Python, for operators that need Unicode normalisation or a vocabulary."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

_RUN = regex.compile(r"\p{Han}+|[\p{L}\p{N}]+")
_HAN = regex.compile(r"\p{Han}+")

# Fixed values: (offset basis, multiplier) of the two rolling hashes of a term.
ROLLING = ((0x811C9DC5, 0x01000193), (0x9E3779B9, 0x85EBCA6B))


def tokenize(text: str) -> list[str]:
    """NFKC, lower case; words of letters and digits; a run of Han gives its characters, then its bigrams."""
    out: list[str] = []
    for run in _RUN.findall(unicodedata.normalize("NFKC", text).lower()):
        if _HAN.fullmatch(run):
            out += [*run, *map("".join, zip(run, run[1:], strict=False))]
        else:
            out.append(run)
    return out


@lru_cache(maxsize=200_000)
def place_and_sign(term: str, dimension: int) -> tuple[int, int]:
    """Place: upper half of the first hash, modulo the dimension. Sign: negative where bit 24 of the second is set."""
    hashes = []
    for value, times in ROLLING:
        for c in map(ord, term):
            value = (value ^ c) * times & 0xFFFFFFFF
        hashes.append(value)
    return (hashes[0] >> 16) % dimension, -1 if hashes[1] >> 24 & 1 else 1


@F.pandas_udf(ArrayType(StringType()))
def tokenize_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: tokenize(t or ""))


def bpe_counter(path: str, pattern: str):
    """A column function that counts BPE tokens by a rank file."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(_encoding(path, pattern).encode_ordinary(t or "")))

    return count


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str, pattern: str) -> int:
    return len(_encoding(path, pattern).encode_ordinary(text))


def truncate_tokens(text: str, most: int, path: str, pattern: str) -> str:
    e = _encoding(path, pattern)
    return e.decode(e.encode_ordinary(text)[:most], errors="ignore")


def chat_tokens(texts: list[str], count) -> int:
    """With framing: 4 a message and 2 for the reply."""
    return sum(count(t) + 4 for t in texts) + 2
