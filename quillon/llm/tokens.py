"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Folder of the vocabulary files and the file used where none is named.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The split pattern of the byte-level vocabularies, where their package can't be imported.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def default_path() -> str:
    return os.path.join(os.environ.get("QUILLON_TOKENIZERS", FOLDER), VOCABULARY)


def encoder(path: str):
    """Byte-level BPE encoder of a ``.tiktoken`` file, one per process."""
    if path not in _loaded:
        import tiktoken

        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = _PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a whole text; null and empty texts have 0."""
    path = path or default_path()

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) for t in texts], dtype="int64")

    # null texts don't reach Python as None in a string column's fast path
    return count(F.coalesce(text, F.lit("")))
