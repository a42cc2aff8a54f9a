"""Sizes of texts in tokens of a public tokenizer, whose file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how texts are cut before byte pairs are merged, as published with this vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, path: str = DEFAULT_RANKS, out: str = "n_tokens") -> DataFrame:
    """``df`` with the tokens of each text; null and empty texts have 0. Long texts are counted whole."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(path)
        for batch in batches:
            yield batch.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    size = F.pandas_udf(count, "long")
    return df.withColumn(out, size(F.col(text)))
