"""Token counts by a public tokenizer whose files lie outside the repository; their folder is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = os.environ.get("INKGROVE_TOKENIZERS", "/opt/tokenizers")
#: How byte-level vocabularies of this family cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def counter(folder: str, name: str):
    """A function text -> number of tokens, by the file's kind."""
    path = os.path.join(folder, name)
    if name.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encode = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: len(encode(text))
    if name.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(piece.encode(text))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


def token_count(text: Column, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> Column:
    """Number of tokens of a text column; null counts 0."""
    where = folder or FOLDER

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(where, name)
        for batch in batches:
            yield pd.Series([of(t) if t else 0 for t in batch], dtype="int64")

    return count(text)
