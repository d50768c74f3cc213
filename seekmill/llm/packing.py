"""Best-fit packing by the sum-of-squares rule (operator 3)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.llm.common import Scratch, word_count

_BIG = np.iinfo(np.int64).max


def sum_of_squares(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length (1..capacity), placed one after another.

    With N[g] the number of open bins whose gap is g (0 < g < capacity), an item goes where the sum of N[g] ** 2
    becomes smallest: into a bin of gap g >= s, or into a new one. Ties: an open bin before a new one, the
    smallest gap, and of its bins the one that reached the gap last.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    of_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    offsets: list[int] = []
    bins = 0
    for s in lengths:
        gap, left = capacity, capacity - s
        if s < capacity or open_bins[s]:
            there = open_bins[s:capacity]
            change = 2 * (open_bins[:left] - there) + 2
            if left:
                change[0] = 1 - 2 * there[0]  # a perfect fit closes the bin
                change[there == 0] = _BIG
                at = int(change.argmin())
                if change[at] <= 2 * open_bins[left] + 1:
                    gap = at + s
        if gap == capacity:
            b, bins = bins, bins + 1
        else:
            b = of_gap[gap].pop()
            open_bins[gap] -= 1
        used.append(b)
        offsets.append(capacity - gap)
        if 0 < gap - s:
            of_gap[gap - s].append(b)
            open_bins[gap - s] += 1
    return used, offsets


def _pack_shard(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"], na_position="first", kind="stable").reset_index(drop=True)
        full = (pdf.n // capacity).to_numpy()
        rest = (pdf.n % capacity).to_numpy()
        pieces = full + (rest > 0)
        row = np.repeat(np.arange(len(pdf)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < full[row], capacity, rest[row])
        bins, offsets = sum_of_squares(size.tolist(), capacity)
        return pd.DataFrame({"doc_id": pdf.doc_id.array[row], "piece": piece, "start": piece * capacity, "n_tokens": size, "bin_id": (int(key[0]) << 32) + np.array(bins, np.int64), "bin_offset": offsets})

    return run


def pack(docs: DataFrame, capacity: int = 2048, shard_tokens: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_offset): the place of every piece of every document.

    A document longer than capacity is cut into full pieces, each a bin of its own, and a rest; rests and
    shorter documents are packed online in doc_id order. The rule is sequential, so documents are hashed to
    shards of about shard_tokens tokens, packed side by side; what a shard leaves open is below capacity
    bins, which shard_tokens makes small. tokens measures a document (whole words by default).
    Only ids and counts are shuffled, never texts. Repeated rows are packed each; documents without tokens
    (NULL or empty text) need no place and give no row; a NULL id is packed and stays NULL; other columns are
    ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    n = tokens if tokens is not None else word_count(F.col(f"`{text_col}`"))
    sized = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), n.cast("bigint").alias("n"))
    sized = scratch.table(sized.filter("n > 0"), "sizes")
    total = sized.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "n"), F.lit(shards)).cast("int")
    schema = "doc_id bigint, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint"
    return sized.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack_shard(capacity), schema)
