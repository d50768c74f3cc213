"""Dense retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekmill.functions import identity, text as T

LSH_BITS, LSH_SEED = 128, 42
#: Vectors and queries in a block of the exact batch search.
QUERY_BLOCK = 4096
#: Queries of a block whose similarities are held at once.
QUERY_ROWS = 512


def embed(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray], text_col: str = "content", batch: int = 100, dims: int | None = None) -> DataFrame:
    """Chunks with an L2-normalised embedding from any embedder of lists of texts, in batches; a wrong number of vectors
    or of dimensions is an error."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema)}, embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch].copy()
                v = np.asarray(embedder([t or "" for t in part[text_col]]), np.float64)
                if v.shape[0] != len(part) or (dims and v.shape[1] != dims):
                    raise ValueError(f"the embedder gave {v.shape} for {len(part)} texts")
                n = np.linalg.norm(v, axis=1, keepdims=True)
                part["embedding"] = list((v / np.where(n > 0, n, 1)).astype(np.float32))
                yield part

    return chunks.mapInPandas(run, schema)


def _similarity(vec: Column, query: list[float]) -> Column:
    """Cosine with a query that is normalised here, once."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    sim = T.let(T.norm(vec), lambda n: F.when(n > 0, T.dot(vec, F.lit([float(x) for x in q])) / n).otherwise(0.0))
    return F.when(F.size(vec) == len(q), sim).otherwise(F.raise_error(F.lit(f"a vector hasn't the query's {len(q)} dimensions")))


def vector_search(vectors: DataFrame, query: list[float], top_k: int = 10, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The exact top_k by cosine similarity clamped to [0, 1], ties by id. The query is a literal of the plan; each
    task keeps top_k rows (TakeOrderedAndProject)."""
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _similarity(F.col(vec_col), query))), 6)
    return vectors.select(F.col(id_col).alias("chunk_id"), score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def _blocks(rows: DataFrame, id_col: str, vec_col: str, n: int, *more: str) -> DataFrame:
    """(block, ids, vectors, more): rows in n blocks by the hash of their ids; rows without a vector are left out."""
    keyed = rows.select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("block"), F.struct(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), *more).alias("x")).filter("x.v IS NOT NULL")
    return keyed.groupBy("block").agg(F.collect_list("x").alias("x")).select("block", F.col("x.id").alias("ids"), F.col("x.v").alias("vectors"), *(F.col(f"x.{c}").alias(c) for c in more))


def _unit(v: np.ndarray) -> np.ndarray:
    return (a := np.vstack(v).astype(np.float64)) / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def _best(q: np.ndarray, v: np.ndarray, place: np.ndarray, k: int, allowed: Callable[[int, int], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of queries, of vectors, scores) of the k nearest of the unit vectors v to each of q, ties by place; QUERY_ROWS queries at a time.
    A score of six decimals and a place are one whole number, so the best are found without a sort. allowed(low, high): which vectors count for these queries."""
    n, k = len(v), min(k, len(v))
    at = np.argsort(place)
    for low in range(0, len(q), QUERY_ROWS):
        key = q[low : low + QUERY_ROWS] @ v.T
        np.clip(key, 0, 1, out=key)
        np.rint(np.multiply(key, 1e6, out=key), out=key)
        key[np.isnan(key)] = -1  # after all others
        key *= n
        key += n - 1 - place
        if allowed is not None:
            key[~allowed(low, low + len(key))] = -np.inf
        key.partition(n - k, axis=1)
        row, column = np.nonzero(np.isfinite(key[:, n - k :]))
        found = key[:, n - k :][row, column].astype(np.int64)
        score = found // n
        yield row + low, at[n - 1 - found % n], np.where(score < 0, np.nan, score / 1e6)


def _block_search(vectors: DataFrame, queries: DataFrame, top_k: int, id_col: str, vec_col: str, bands: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): blocks of QUERY_BLOCK queries meet blocks of as many vectors as matrices; each pair of blocks keeps top_k a
    query, and only those are shuffled. bands: the keys of signatures, a row a band; only vectors that share one with the query count."""
    kind = vectors.schema[id_col].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    n, m = (max(1, -(-x.count() // QUERY_BLOCK)) for x in (vectors, queries))
    more = ["signature"] if bands else []
    left = _blocks(vectors, id_col, vec_col, n, *more)
    # every block of queries goes to every block of vectors, by an equality join on the latter's number
    asked = _blocks(queries, "query_id", "embedding", m, *more).select(F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), *(F.col(c).alias(f"q_{c}") for c in more))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, asked_ids, allowed = np.asarray(row.ids), np.asarray(row.q_ids), None
                place = np.argsort(np.argsort(ids, kind="stable"))
                if bands:
                    a, b = bands(np.vstack(row.q_signature)), bands(np.vstack(row.signature))

                    def allowed(low: int, high: int) -> np.ndarray:
                        shared = np.zeros((high - low, b.shape[1]), bool)
                        for x, y in zip(a, b):
                            shared |= x[low:high, None] == y
                        return shared

                for q, v, score in _best(_unit(row.q), _unit(row.vectors), place, top_k, allowed):
                    yield pd.DataFrame({"query_id": asked_ids[q], "chunk_id": ids[v], "score": score})

    found = left.join(asked.hint("merge"), "block").drop("block").mapInPandas(kernel, f"query_id {qkind}, chunk_id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def vector_search_batch(vectors: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """E7 for many queries(query_id, embedding): (query_id, chunk_id, score, rank), exactly, of all pairs, in bounded memory. Nothing goes through the
    driver but the two counts."""
    return _block_search(vectors, queries, top_k, id_col, vec_col)


def lsh_search_batch(vectors: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "chunk_id", vec_col: str = "embedding", dims: int = 64, width: int = 5, bits: int = LSH_BITS) -> DataFrame:
    """E7 approximately: (query_id, chunk_id, score, rank). Vectors and queries that agree on any band of width bits of their signatures (G1) are
    compared exactly. Every vector is indexed; those of other than dims dimensions aren't compared. The narrower the bands, the higher the recall: at 5
    bits above 0.9 even for vectors whose neighbours are hardly nearer than chance (cosines of 0.3), where half of all are compared; so pairs are
    tried in blocks, as a row for each would be more work than the exact search."""

    def bands(signatures: np.ndarray) -> np.ndarray:
        bit = np.unpackbits(signatures.astype(">i8").view(np.uint8), axis=1)[:, : bits // width * width]
        return (bit.reshape(len(bit), -1, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(2, dtype=np.uint32).T.astype(np.uint8 if width <= 8 else np.uint32, order="C")

    sign = lambda rows, c: lsh_signature(rows.filter(F.size(c) == dims), dims, bits, vec_col=c)
    left = sign(vectors.select(F.col(id_col).alias("chunk_id"), F.col(vec_col).alias("v")), "v")
    return _block_search(left, sign(queries.select("query_id", "embedding"), "embedding"), top_k, "chunk_id", "v", bands)


def plane_matrix(dims: int, bits: int = LSH_BITS, seed: int = LSH_SEED) -> np.ndarray:
    """G1: random hyperplanes, uniform in [-1, 1)."""
    return np.random.default_rng(seed).uniform(-1, 1, (bits, dims))


def lsh_signature(vectors: DataFrame, dims: int, bits: int = LSH_BITS, seed: int = LSH_SEED, vec_col: str = "embedding", out: str = "signature") -> DataFrame:
    """G1: vectors with a signature of bits / 64 BIGINT words, first plane first; all zero for a vector of other dimensions."""
    w = plane_matrix(dims, bits, seed)

    def run(vs: pd.Series) -> pd.Series:
        zero = np.zeros(bits // 64, np.int64)
        return pd.Series([zero if v is None or len(v) != dims else np.packbits(w @ np.asarray(v, np.float64) > 0).view(">i8").astype(np.int64) for v in vs], dtype="object")

    return vectors.withColumn(out, F.pandas_udf(run, "array<bigint>")(F.col(vec_col)))


def signature_distance(a: Column, b: Column) -> Column:
    """Hamming distance of signatures; 64 bits a word of the longer one where their sizes differ."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: identity.hamming(x, y)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d).otherwise(64 * F.greatest(F.size(a), F.size(b)))


def signature_similarity(a: Column, b: Column) -> Column:
    return 1 - signature_distance(a, b) / (64.0 * F.greatest(F.size(a), F.size(b)))
