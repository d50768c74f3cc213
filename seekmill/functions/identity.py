"""Document identity: content hash, SimHash, Hamming distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seekmill.functions import text as T


def content_hash(text: Column) -> Column:
    """B2: hex SHA-256 of the normalised text."""
    return F.sha2(T.normalize(text), 256)


def _md5_64(features: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.md5(f).digest()[:8] for f in features), ">u8")


def _xxh3_64(features: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(f) for f in features], np.uint64)


_HASHES = {"md5": _md5_64, "xxh3": _xxh3_64}


def simhash_of(words: list[str], hash_name: str = "md5", n: int = 3) -> int:
    """The signed 64-bit SimHash of word n-grams: a bit is 1 where more hashes have it than not; 0 without words."""
    feats = words if len(words) < n else [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    if not feats:
        return 0
    hashes = _HASHES[hash_name]([f.encode() for f in feats])
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(0, dtype=np.int64) * 2 > len(feats)
    return int(np.packbits(votes).view(">i8")[0])


def simhash(text: Column, hash_name: str = "md5", raw: bool = False) -> Column:
    """SimHash of the normalised text's word 3-grams as a BIGINT bit pattern; raw=True (B7): of the text as it is.

    One Arrow UDF a row set: exploding 64 votes a gram would multiply the rows by 64.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash_of([w for w in t.split(" ") if w], hash_name) for t in texts], dtype="int64")

    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{T.SPACE}+", " ")) if raw else T.normalize(text)
    return F.pandas_udf(run, LongType())(clean)


def content_id(sim: Column) -> Column:
    """16 hex digits of a SimHash."""
    return F.lpad(F.lower(F.hex(sim)), 16, "0")


def parse_content_id(text: Column) -> Column:
    """The SimHash of 16 hex digits of either case; NULL for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """B6."""
    return F.bit_count(a.bitwiseXOR(b))


def fast_hash(text: Column) -> Column:
    """XXH3-64 as a BIGINT bit pattern."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_xxh3_64([t.encode() for t in texts]).view(np.int64) if len(texts) else [], dtype="int64")

    return F.pandas_udf(run, LongType())(F.coalesce(text, F.lit("")))
