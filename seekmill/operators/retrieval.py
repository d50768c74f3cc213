"""Fusion, filters, scoring, grouping and hybrid search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekmill.functions import snippet as S, text as T
from seekmill.operators import lexical, vector

RRF_K = 60
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were what when where which who will with how why do does did can could should would"
).split()
Stage = Callable[[DataFrame], DataFrame]


def to_ranked(hits: DataFrame, method: str, top_k: int) -> DataFrame:
    """F1: (chunk_id, rank, original_score, method) of a result list, which has at most top_k rows; ties by chunk_id."""
    top = hits.orderBy(F.desc("score"), "chunk_id").limit(top_k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # top_k rows, so one task does
    return top.select("chunk_id", rank.alias("rank"), F.col("score").alias("original_score"), F.lit(method).alias("method"))


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """reciprocal-rank fusion, divided by the most that the non-empty lists could give; a union and one aggregate in place of a
    full outer join."""
    most = ranked.agg((F.count_distinct("method") / F.lit(k + 1.0)).alias("most"))
    fused = ranked.groupBy("chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("raw"), F.array_sort(F.collect_set("method")).alias("methods"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "rank")))).alias("ranks")
    )
    return fused.crossJoin(F.broadcast(most)).select("chunk_id", F.round(F.col("raw") / F.col("most"), 6).alias("score"), "methods", "ranks")  # most is one row


def minmax(hits: DataFrame, score_col: str = "score") -> DataFrame:
    """scores scaled to [0, 1]; all 1.0 where they are equal."""
    ends = hits.agg(F.min(score_col).alias("_lo"), F.max(score_col).alias("_hi"))
    scaled = F.when(F.col("_hi") - F.col("_lo") <= 1.2e-7, 1.0).otherwise((F.col(score_col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return hits.crossJoin(F.broadcast(ends)).withColumn(score_col, F.round(scaled, 6)).drop("_lo", "_hi")


@dataclass
class Filters:
    """all that are given must hold."""

    document_ids: list[str] | None = None
    url_prefix: str | None = None
    min_ts: datetime | None = None
    max_ts: datetime | None = None
    metadata_equals: dict[str, str] = field(default_factory=dict)
    metadata_contains: dict[str, list[str]] = field(default_factory=dict)

    def column(self) -> Column:
        extra = lambda k: F.try_element_at("extra", F.lit(k))
        tests = [F.lit(True)]
        if self.document_ids is not None:
            tests.append(F.col("document_id").isin(self.document_ids))
        if self.url_prefix is not None:
            tests.append(F.coalesce(F.startswith(F.col("url"), F.lit(self.url_prefix)), F.lit(False)))
        if self.min_ts is not None:
            tests.append(F.col("ts") >= F.lit(self.min_ts))
        if self.max_ts is not None:
            tests.append(F.col("ts") <= F.lit(self.max_ts))
        tests += [F.coalesce(extra(k) == v, F.lit(False)) for k, v in self.metadata_equals.items()]
        for k, allowed in self.metadata_contains.items():
            mine = F.transform(F.split(extra(k), ","), lambda x: F.trim(x))
            tests.append(F.coalesce(F.arrays_overlap(mine, F.lit(list(allowed))), F.lit(False)))
        return reduce(lambda a, b: a & b, tests)

    @property
    def empty(self) -> bool:
        return self == Filters()


def aggregator_demotion(min_multiplier: float = 0.5) -> Stage:
    """score times 1 - a (1 - min_multiplier), where the extra field aggregator_score is a number a. Doesn't sort."""

    def stage(hits: DataFrame) -> DataFrame:
        a = F.try_element_at("extra", F.lit("aggregator_score")).try_cast("double")
        return hits.withColumn("score", F.when(a.isNotNull(), F.col("score") * (1 - a * (1 - min_multiplier))).otherwise(F.col("score")))

    return stage


def overlap_rerank(query: str, score_weight: float = 0.7, overlap_weight: float = 0.3, stop_words: list[str] | tuple[str, ...] = STOP_WORDS) -> Stage:
    """a weighted sum of the score and the share of query terms that are words of the content. F8 is this without stop words."""
    terms = sorted(set(query.lower().split()) - set(stop_words))

    def stage(hits: DataFrame) -> DataFrame:
        if not terms:
            return hits
        mine = F.array_distinct(T.words(T.normalize(F.col("content"))))
        overlap = F.size(F.array_intersect(mine, F.lit(terms))) / float(len(terms))
        return hits.withColumn("score", score_weight * F.col("score") + overlap_weight * overlap)

    return stage


def pipeline(*stages: Stage, explain: bool = False) -> Stage:
    """stages one after another; explain keeps the score before each in score_0, score_1, ... The final score is within [0, 1]."""

    def run(hits: DataFrame) -> DataFrame:
        for n, stage in enumerate(stages):
            if explain:
                hits = hits.withColumn(f"score_{n}", F.col("score"))
            hits = hits.transform(stage)
        return hits.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), 6))

    return run


def hybrid_search(
    index: lexical.LexicalIndex, vectors: DataFrame | None, chunks: DataFrame, query: str, embedding: list[float] | None = None, top_k: int = 10,
    filters: Filters | None = None, candidates: int = 50, rerank: bool = True, mode: str = "post", explain: bool = False, rrf_k: int = 60, min_multiplier: float = 0.5,
) -> DataFrame:
    """BM25 and vector candidates, fused by rank, joined to their chunks (unknown ones vanish), filtered, scored and cut to top_k.
    mode="post" filters the fused list (of three times as many candidates); mode="pre" filters the chunks first, so
    that filtered searches find all there is; the filter then prunes the scan."""
    filters = filters or Filters()
    if not query.strip() or top_k <= 0:
        return chunks.limit(0).withColumn("score", F.lit(0.0))
    wide = 1 if filters.empty or mode == "pre" else 3
    n = candidates * wide
    if mode == "pre" and not filters.empty:
        chunks = chunks.filter(filters.column())
        ids = chunks.select("chunk_id")
        scores = lexical.bm25_scores(index, query).join(ids, "chunk_id", "left_semi")
        vectors = vectors.join(ids, "chunk_id", "left_semi") if vectors is not None else None
    else:
        scores = lexical.bm25_scores(index, query)
    ranked = to_ranked(scores.select("chunk_id", F.round("score", 6).alias("score")), "bm25", n)
    if embedding is not None and vectors is not None:
        ranked = ranked.unionByName(to_ranked(vector.vector_search(vectors, embedding, n), "dense", n))
    fused = rrf(ranked, rrf_k).orderBy(F.desc("score"), "chunk_id").limit(top_k * wide)
    hits = chunks.join(F.broadcast(fused), "chunk_id")  # at most 3 top_k rows
    if mode != "pre":
        hits = hits.filter(filters.column())
    hits = hits.orderBy(F.desc("score"), "chunk_id").limit(top_k)
    stages = [aggregator_demotion(min_multiplier), *([overlap_rerank(query)] if rerank else [])]
    return hits.transform(pipeline(*stages, explain=explain)).orderBy(F.desc("score"), "chunk_id")


def group_results(hits: DataFrame, top_k: int = 10) -> DataFrame:
    """hits of one document, or of one URL, as a group: its best score, its chunks from the best on, in order; (citation 1..n,
    document_id, url, title, score, n_chunks, chunks)."""
    key = F.coalesce(F.concat(F.lit("u:"), F.col("url")), F.concat(F.lit("d:"), F.col("document_id")))
    chunk = F.struct((-F.col("score")).alias("neg"), F.col("chunk_id"), F.col("content"))
    best = lambda c: F.min_by(c, F.struct((-F.col("score")).alias("n"), "chunk_id")).alias(c)
    groups = hits.groupBy(key.alias("key")).agg(best("document_id"), best("url"), best("title"), F.max("score").alias("score"), F.array_sort(F.collect_set(chunk)).alias("c"))
    groups = groups.withColumn("n_chunks", F.size("c"))
    top = groups.orderBy(F.desc("score"), F.desc("n_chunks"), "key").limit(top_k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("n_chunks"), "key"))  # top_k rows
    chunks = F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), (-x["neg"]).alias("score"), x["content"].alias("content")))
    return top.select(rank.alias("citation"), "document_id", "url", "title", "score", "n_chunks", chunks.alias("chunks"))


def citations(groups: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """(index, title, url, snippet of the best chunk)."""
    return groups.select(F.col("citation").alias("index"), F.coalesce("title", "document_id").alias("title"), "url", S.snippet(F.lit(query), F.col("chunks")[0]["content"], limit).alias("snippet"))
