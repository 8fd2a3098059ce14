"""Sizes of texts in tokens of a public byte-level BPE vocabulary, whose path is a parameter."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("PARTWISE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-token pattern that belongs to the vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer, read once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("partwise", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the pattern sees it; runs from LONG_BLANKS characters on can exhaust the tokenizer's pattern matcher.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_BLANKS = 10_000
_LONG_RUN = re.compile(f"[{_WHITE}]{{{LONG_BLANKS},}}")


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Tokens of a text of any length and content.

    The tokenizer gives up on runs of very many blanks. Such a run is one pre-token,
    but for its last character where a word follows, so it is encoded as one.
    """
    enc = encoding(path)
    try:
        return enc.encode_ordinary(text)
    except BaseException as e:  # the tokenizer's panic is no Exception
        if type(e).__name__ != "PanicException":
            raise
    return _by_runs(enc, text, _LONG_RUN)


def _by_runs(enc, text: str, runs: re.Pattern) -> list[int]:
    out, at = [], 0
    for run in runs.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def byte_lengths(path: str = VOCABULARY) -> np.ndarray:
    """Bytes of each token by its number."""
    enc = encoding(path)
    out = np.zeros(enc.n_vocab, np.int64)
    for token, rank in enc._mergeable_ranks.items():
        out[rank] = len(token)
    return out


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t, path)) if t else 0 for t in texts], dtype="int64")

    return count(text)
