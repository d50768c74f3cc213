"""Lexical index and BM25 retrieval.

The inverted index is postings, which carry the length of their chunk, and a row of statistics. It is built by one
explode + partial aggregation, so it is as wide as the cluster and needs no driver state, and stored in order of
its terms, so that a search reads the row groups of the query's terms only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
MAX_TOKEN_BYTES = 40
#: Postings of a file, files of a commit, postings beyond which a file is too long to sort in one task; chunks from which the bounds of files are estimated.
FILE_ROWS, MAX_FILES, MOST_ROWS, SAMPLED = 1_000_000, 64, 16_000_000, 1000
#: Terms of a batch of queries that are broadcast, counted once a query.
MOST_TERMS = 100_000


@dataclass
class LexicalIndex:
    postings: DataFrame  # term, chunk_id, tf, dl
    lengths: DataFrame  # chunk_id, dl
    stats: DataFrame  # n, avgdl (one row)


def tokens(col: Column) -> Column:
    """Lower-cased runs of letters and digits shorter than 40 bytes."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(words, lambda t: F.octet_length(t) < MAX_TOKEN_BYTES)


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> LexicalIndex:
    """Postings by explode + groupBy. Texts are brought together by their chunk, which moves less than their postings would, and which
    the groups need no further shuffle for; lengths need none at all. (explode_outer: a filter inferred for explode() would find the tokens twice.)"""
    named = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    found = lambda rows: rows.select("chunk_id", tokens(F.col("text")).alias("toks"))
    dl = F.size("toks").cast("bigint").alias("dl")
    spread = named.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
    rows = found(spread).select("chunk_id", dl, F.explode_outer("toks").alias("term")).filter("term IS NOT NULL")
    postings = rows.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    lengths = found(named).select("chunk_id", dl)
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return LexicalIndex(postings, lengths, stats)


def _key(term: Column, chunk_id: Column) -> Column:
    """Sorts as (term, chunk_id) does; a term has no character zero."""
    return F.concat(term, F.lit("\0"), chunk_id)


def _bounds(chunks: DataFrame, id_col: str, text_col: str) -> tuple[list[str], int]:
    """(the keys at which files begin, the postings of a file), as estimated from some chunks."""
    n = chunks.count()
    some = chunks.sample(min(1.0, SAMPLED / max(n, 1)), 42).select(F.col(id_col).alias("chunk_id"), F.array_distinct(tokens(F.col(text_col))).alias("toks"))
    keys = some.select(F.col("chunk_id"), F.explode_outer("toks").alias("term")).select("chunk_id", "term", _key(F.col("term"), F.coalesce("chunk_id", F.lit(""))).alias("key"))
    found = keys.agg(F.count("term").alias("n"), F.count_distinct("chunk_id").alias("chunks"), F.collect_list(F.when(F.pmod(F.xxhash64("key"), F.lit(16)) == 0, F.col("key"))).alias("keys")).first()
    postings = found.n * n / max(found.chunks, 1)
    files = min(MAX_FILES, max(1, math.ceil(postings / FILE_ROWS)))
    at = sorted(found.keys)
    return sorted({at[len(at) * i // files] for i in range(1, files)} if at else set()), math.ceil(postings / files)


def ordered_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> LexicalIndex:
    """E4 with the postings in order of (term, chunk_id), over partitions as well as within them; chunks is stored. Spark's own sort would find all
    postings twice, the first time for the bounds of its partitions; here these come from SAMPLED chunks or so, and all that depends on them is
    where a file ends."""
    built = build_index(chunks, id_col, text_col)
    bounds, rows = _bounds(chunks, id_col, text_col)
    if rows > MOST_ROWS:
        return LexicalIndex(built.postings.orderBy("term", "chunk_id"), built.lengths, built.stats)
    key = _key(F.col("term"), F.coalesce("chunk_id", F.lit("")))

    def place(low: int, high: int) -> Column:
        """The number of bounds[low:high] up to the key, and low."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bounds[mid], place(low, mid)).otherwise(place(mid + 1, high))

    postings = built.postings.repartitionById(len(bounds) + 1, place(0, len(bounds))).sortWithinPartitions("term", "chunk_id")
    return LexicalIndex(postings, built.lengths, built.stats)


def statistics(spark: SparkSession, chunks: int, tokens_: int) -> DataFrame:
    """The row (n, avgdl) of an index of so many chunks and tokens; avgdl is NULL without chunks."""
    return spark.createDataFrame([(chunks, tokens_ / chunks if chunks else None)], "n bigint, avgdl double")


def stored_index(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "content") -> LexicalIndex:
    """E4 written under path, in order of (term, chunk_id): texts are read once, and searches read a few row groups."""
    spark, built = chunks.sparkSession, ordered_index(chunks, id_col, text_col)
    built.postings.write.mode("overwrite").parquet(path)
    postings = spark.read.schema("term string, chunk_id string, tf bigint, dl bigint").parquet(path)
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    return LexicalIndex(postings, built.lengths, statistics(spark, chunks.count(), total))


@dataclass
class ParsedQuery:
    should: list[str]
    must: list[str]
    must_not: list[str]
    phrases: list[list[str]]

    @property
    def scoring(self) -> list[str]:
        return sorted({*self.should, *self.must, *(t for p in self.phrases for t in p)})


def parse_query(text: str) -> ParsedQuery:
    """Lenient syntax. +must, -not, AND/OR/NOT, "phrases" and field: prefixes; never fails."""
    should: list[str] = []
    must: list[str] = []
    must_not: list[str] = []
    phrases: list[list[str]] = []
    words = lambda s: [w for w in re.findall(r"[^\W_]+", s.lower()) if len(w.encode()) < MAX_TOKEN_BYTES]
    rest = re.sub(r'"([^"]*)"', lambda m: phrases.append(words(m[1])) or " ", text or "")
    rest = re.sub(r"\b(?:content|title|chunk_id|document_id):", " ", rest)
    pending, optional = "", False  # optional: the last term was
    for raw in rest.split():
        if raw in ("AND", "OR", "NOT"):
            if raw == "AND" and optional:
                must.append(should.pop())
                optional = False
            pending = raw
            continue
        found = words(raw)
        if raw.startswith("-") or pending == "NOT":
            must_not += found
        elif raw.startswith("+") or pending == "AND":
            must += found
        else:
            should += found
        optional = bool(found) and should[-1:] == found[-1:] and pending not in ("NOT", "AND") and raw[0] not in "+-"
        pending = ""
    return ParsedQuery(should, must, must_not, [p for p in phrases if p])


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / avgdl))


def score_terms(index: LexicalIndex, terms: list[str]) -> DataFrame:
    """(chunk_id, term, tf, score): one row per matching posting. The term filter reaches the scan of
    a stored postings table, and df comes from the filtered postings only."""
    hits = index.postings.filter(F.col("term").isin(terms) if terms else F.lit(False))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (
        hits.join(F.broadcast(df), "term")  # at most one row per query term
        .crossJoin(F.broadcast(index.stats))  # one row
        .select("chunk_id", "term", "tf", (idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))
    )


def bm25_scores(index: LexicalIndex, query: str) -> DataFrame:
    """All matching chunks with their BM25 score (unsorted)."""
    q = parse_query(query)
    scored = score_terms(index, sorted({*q.scoring, *q.must_not}))
    must = sorted({*q.must, *(t for p in q.phrases for t in p)})
    keep = F.lit(True)
    if must:
        keep = keep & (F.count_distinct(F.when(F.col("term").isin(must), F.col("term"))) == len(must))
    if q.must_not:
        keep = keep & (F.count(F.when(F.col("term").isin(q.must_not), 1)) == 0)
    return (
        scored.groupBy("chunk_id")
        .agg(F.sum(F.when(F.col("term").isin(q.scoring or [""]), F.col("score")).otherwise(0.0)).alias("score"), keep.alias("_keep"))
        .filter("_keep")
        .drop("_keep")
    )


def bm25_search(index: LexicalIndex, query: str, top_k: int = 10) -> DataFrame:
    """E5: top-k chunks, score rounded to 6 places before ranking, ties by chunk_id."""
    return bm25_scores(index, query).select("chunk_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def bm25_batch(index: LexicalIndex, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """Many queries in one job: queries(query_id, text). The distinct query terms prune the postings
    by a join. Up to MOST_TERMS terms of queries are broadcast to the postings, which are brought together by chunk first, so that the sums, a row
    for each query and chunk that share a term, stay where they are made; only the top_k of a task are shuffled. Beyond that all joins are shuffled (the query set may be as large as it likes)."""
    from pyspark.sql import Window

    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    few = q.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    small = F.broadcast if few else lambda rows: rows
    df = index.postings.join(small(q.select("term").distinct()), "term", "left_semi")
    dfs = df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    per_term = df.join(small(dfs), "term").crossJoin(F.broadcast(index.stats)).select("term", "chunk_id", weight.alias("w"))
    if few:
        per_term = per_term.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
    scores = per_term.join(small(q), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select("query_id", "chunk_id", "score", "rank")
