"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public tokenizer cuts a text before merging bytes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(path: str = DEFAULT_RANKS):
    """The encoding in a rank file, kept per worker process."""
    import tiktoken

    cache = load_encoding.__dict__.setdefault("cache", {})
    if path not in cache:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        cache[path] = tiktoken.Encoding(os.path.basename(path), pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[path]


def _pieces(text: str, limit: int = 20_000) -> Iterator[str]:
    """A text in pieces that begin where the tokenizer begins a word anyway.

    A piece ends before a blank that follows a non-blank, so the pieces'
    tokens are those of the whole text.  A run without such a place stays
    whole.
    """
    start = 0
    while len(text) - start > limit:
        cut = text.find(" ", start + limit)
        while cut > 0 and (text[cut - 1].isspace() or cut + 1 >= len(text) or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(text: str, path: str = DEFAULT_RANKS) -> list[int]:
    """Token ids of a whole text; text of special tokens is ordinary text."""
    encoding = load_encoding(path)
    return [t for piece in _pieces(text) for t in encoding.encode_ordinary(piece)]


def with_token_counts(documents: DataFrame, text: str = "text", path: str = DEFAULT_RANKS, output: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of a text column; null and empty texts have 0.

    Whole texts are tokenised, in Arrow batches.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if not t else len(encode(t, path))).astype("int64")

    return documents.withColumn(output, count(F.col(text)))
