"""Token counters by name."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column

from seekmill.functions import pieces, text as T

ENCODINGS = ("cl100k_base", "o200k_base", "p50k_base", "r50k_base")
_MODELS = (("text-embedding-3-", "cl100k_base"), ("text-embedding-ada", "cl100k_base"), ("bge", "cl100k_base"), ("nomic-embed", "cl100k_base"), ("e5", "cl100k_base"), ("embed-", "cl100k_base"))
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def resolve(encoding: str | None = None, model: str | None = None) -> str:
    """An encoding that is named, else that of the model's family, else 'heuristic'."""
    if encoding:
        if encoding not in (*ENCODINGS, "heuristic"):
            raise ValueError(f"unknown encoding {encoding}")
        return encoding
    name = (model or "").lower()
    return next((e for prefix, e in _MODELS if prefix in name), "heuristic")


def _encoder(ranks_path: str):
    if ranks_path not in _loaded:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _loaded[ranks_path] = tiktoken.Encoding(ranks_path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[ranks_path]


def token_count(text: Column, name: str = "heuristic", ranks_path: str | None = None) -> Column:
    """The heuristic runs inside the JVM; an encoding needs the path of its ranks (vocabularies aren't part of this package)."""
    if name == "heuristic" or not ranks_path:
        return T.heuristic_tokens(text)

    def run(texts: pd.Series) -> pd.Series:
        enc = _encoder(ranks_path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return pieces.udf(run, "bigint", text)
