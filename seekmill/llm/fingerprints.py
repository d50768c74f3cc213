"""Document fingerprints by content-defined chunking (operator 5).

A gear hash of the last 32 bytes of UTF-8 text is computed for all bytes at once by doubling
(the hash of 2w bytes from two hashes of w bytes). A chunk ends where the hash has zero bits under
a mask, a strict one before the normal size and a loose one after it (normalised chunking), and
at MAX_BYTES at the latest. Boundaries depend on nearby bytes only, so an insertion changes the chunks
around it and no others. A document's fingerprint is its set of chunk digests, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekmill.llm.common import Scratch

MIN_BYTES, NORMAL_BYTES, MAX_BYTES = 64, 256, 1024
STRICT_BITS, LOOSE_BITS = 9, 7
_GEAR = np.random.default_rng(20250713).integers(0, 1 << 32, 256, dtype=np.uint32)
_LOOSE = np.uint32(((1 << LOOSE_BITS) - 1) << (32 - LOOSE_BITS))
_STRICT = np.uint32(((1 << STRICT_BITS) - 1) << (32 - STRICT_BITS))
_BLOCK = 1 << 18


def gear_candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (index of the last byte) where the loose mask is met, and whether the strict one is."""
    places, strict = [], []
    for at in range(0, len(data), _BLOCK):  # blocks that fit the cache, with the 31 bytes before them
        lead = min(at, 31)
        h = _GEAR[data[at - lead : at + _BLOCK]]
        for w in (1, 2, 4, 8, 16):
            h[w:] += h[:-w] << np.uint32(w)  # the right side is evaluated first
        found = np.flatnonzero((h[lead:] & _LOOSE) == 0)
        places.append(found + at)
        strict.append((h[lead:][found] & _STRICT) == 0)
    return (np.concatenate(places), np.concatenate(strict)) if places else (np.empty(0, np.int64), np.empty(0, bool))


def cut_points(begin: int, end: int, places: list[int], strict: list[bool], k: int) -> tuple[list[int], int]:
    """Ends of the chunks of data[begin:end]; places[k:] are the candidates from there on."""
    cuts, n = [], len(places)
    while end - begin > MIN_BYTES:
        low, normal, high = begin + MIN_BYTES - 1, begin + NORMAL_BYTES - 1, min(begin + MAX_BYTES, end) - 1
        while k < n and places[k] < low:
            k += 1
        j = k
        while j < n and places[j] < high and not (strict[j] or places[j] >= normal):
            j += 1
        cut = (places[j] if j < n and places[j] < high else high) + 1
        cuts.append(cut)
        begin, k = cut, j
    if end > begin:
        cuts.append(end)
    return cuts, k


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(document number, digest, length) of every chunk of the texts, in order."""
    data = b"".join(texts)
    places, strict = (x.tolist() for x in gear_candidates(np.frombuffer(data, np.uint8)))
    owner, digests, lengths = [], [], []
    begin = k = 0
    view = memoryview(data)
    digest = xxhash.xxh3_64_intdigest
    for i, t in enumerate(texts):
        end = begin + len(t)
        while k < len(places) and places[k] < begin:
            k += 1
        cuts, k = cut_points(begin, end, places, strict, k)
        for cut in cuts:
            owner.append(i)
            digests.append(digest(view[begin:cut]))
            lengths.append(cut - begin)
            begin = cut
    return np.array(owner, np.int64), digests, np.array(lengths, np.int64)


def chunk_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, weight): each document's distinct chunks; weight is the chunk's length in bytes. One scan, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                owner, digests, lengths = chunks_of([t.encode() for t in part["text"]])
                out = pd.DataFrame({"doc_id": part["doc_id"].array[owner], "row": owner, "digest": np.array(digests, np.uint64).view(np.int64), "weight": lengths})
                yield out.drop_duplicates(["row", "digest"])[["doc_id", "digest", "weight"]]

    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text <> ''")
    return slim.mapInPandas(run, "doc_id bigint, digest bigint, weight bigint")


def corpus_containment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunks: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_chunks, n_bytes, shared, earlier): how far each document is contained in the others.

    n_bytes is the weight of its distinct chunks; shared the part of it in chunks that another document has as well,
    earlier the part in chunks of a document with a smaller id; both from 0 to 1, rounded to 6 places.
    Linear in the chunks whatever their multiplicity: a chunk's holders are counted, never paired. The
    chunks of a digest meet in partial aggregates; only digests with several holders are joined back, and
    AQE splits that join where a digest is hot. The corpus is chunked once, into a table.

    Rows with the same id are one document (repeated rows change nothing). NULL ids are one document of that id.
    NULL and empty texts have no chunks and give no row; very long texts are chunked whole. Ties of ids are repeated rows. Other columns are ignored; an empty table gives none.
    """
    if chunks is None:
        chunks = (scratch or Scratch(docs.sparkSession, "chunks")).table(chunk_digests(docs, id_col, text_col), "chunks")
    each = chunks.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "digest", "weight").distinct()
    held = each.groupBy("digest").agg(F.count(F.lit(1)).alias("holders"), F.min("doc_id").alias("first")).filter("holders > 1")
    joined = each.join(held.hint("merge"), "digest", "left")
    share = lambda cond: F.round(F.sum(F.when(cond, F.col("weight")).otherwise(0)) / F.sum("weight"), 6)
    return (
        joined.groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_chunks"),
            F.sum("weight").alias("n_bytes"),
            share(F.col("holders").isNotNull()).alias("shared"),
            share(F.col("first") < F.col("doc_id")).alias("earlier"),
        )
        .withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
    )


def containment_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(left_id, right_id, containment): pairs of two sets of chunk_digests() where at least threshold of the left
    document's weight is in the right one. Exact, by prefix filtering: a pair that reaches the threshold shares
    one of the left document's rarest chunks, so only those weighing just over 1 - threshold look for partners.

    Rows that are there twice count once; NULL ids must be replaced before (corpus_pairs() does), as they equal nothing. Pairs that tie with
    the threshold are results. A document is paired with itself if it is on both sides. Other columns are ignored; if either side is empty there are no pairs.
    """
    left, right = (x.select("doc_id", "digest", "weight") for x in (left, right))
    left, right = left.distinct(), right.distinct()
    freq = right.groupBy("digest").agg(F.count(F.lit(1)).alias("f"))
    by_rarity = Window.partitionBy("doc_id").orderBy("f", "digest").rowsBetween(Window.unboundedPreceding, -1)
    ranked = left.join(freq.hint("merge"), "digest", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    ranked = ranked.withColumn("total", F.sum("weight").over(Window.partitionBy("doc_id"))).withColumn("before", F.coalesce(F.sum("weight").over(by_rarity), F.lit(0)))
    probe = ranked.filter((F.col("f") > 0) & (F.col("before") <= F.col("total") * (1 - threshold)))
    pairs = probe.select(F.col("doc_id").alias("left_id"), "digest").join(right.select(F.col("doc_id").alias("right_id"), "digest"), "digest").select("left_id", "right_id").distinct()
    l = ranked.select(F.col("doc_id").alias("left_id"), "digest", "weight", "total")
    both = pairs.join(l, "left_id").join(right.select(F.col("doc_id").alias("right_id"), "digest"), ["right_id", "digest"])
    share = F.round(F.sum("weight") / F.first("total"), 6)
    return both.groupBy("left_id", "right_id").agg(share.alias("containment")).filter(F.col("containment") >= threshold)


def corpus_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, other_id, containment): which document holds at least threshold of the weight of which.

    Documents with equal chunk sets are a group, named by its smallest id: its other members are paired with that one only, at 1.0,
    and pairs of different groups are those of their first documents. So copies cost one row each. NULL ids, equal
    ids and empty texts as in corpus_containment(); an empty table gives none.
    """
    scratch = scratch or Scratch(docs.sparkSession, "containment")
    each = chunk_digests(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "digest", "weight").distinct()
    each = scratch.table(each, "chunks")
    # a set is known by its number of chunks and two sums of their hashes
    wide = lambda seed: F.sum(F.xxhash64("digest", F.lit(seed)).cast("decimal(38,0)"))
    sets = each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), wide(1).alias("a"), wide(2).alias("b"))
    groups = sets.groupBy("n", "a", "b").agg(F.min("doc_id").alias("first"))
    named = scratch.table(sets.join(groups, ["n", "a", "b"]).select("doc_id", "first"), "groups")
    copies = named.filter("doc_id <> first").select("doc_id", F.col("first").alias("other_id"), F.lit(1.0).alias("containment"))
    firsts = scratch.table(each.join(named.filter("doc_id = first").select("doc_id"), "doc_id", "left_semi"), "firsts")
    held = firsts.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest")
    # a chunk of one group alone finds no partner, but counts in the weight of its document
    pairs = containment_pairs(firsts, firsts.join(held, "digest", "left_semi"), threshold).filter("left_id <> right_id")
    out = copies.union(pairs.select("left_id", "right_id", "containment"))
    known = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    return out.select(known("doc_id"), known("other_id"), "containment")
