"""Lexical, dense and hybrid search over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.config import Config
from seekmill.functions import text as T
from seekmill.operators import lexical, retrieval, vector
from seekmill.plans import sql as Q
from seekmill.plans.engine import Engine
from seekmill.plans.registry import query, table
from seekmill.sources.store import Scratch

TEXT = "thing ing hand"
TERMS = TEXT.split()

POST = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents),
    post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM tok WHERE strlen(term) < 40 GROUP BY ALL),
    len AS MATERIALIZED (SELECT d.doc_id, coalesce(sum(p.tf), 0) AS dl FROM documents d LEFT JOIN post p USING (doc_id) GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    w AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM post JOIN dfs USING (term) JOIN len USING (doc_id), st)"""
BM25 = f"""{POST}, bm25 AS (SELECT doc_id::VARCHAR AS chunk_id, round(sum(w), 6) AS score FROM w WHERE term IN ({", ".join(f"'{t}'" for t in TERMS)}) GROUP BY 1),
    bm25_top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 50)"""
DENSE = f"""q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
    dense AS (SELECT vec_id::VARCHAR AS chunk_id, round(greatest(0, least(1, {Q.cosine("embedding", "e")})), 6) AS score FROM embeddings, q),
    dense_top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM dense QUALIFY rank <= 50)"""
RRF = """fused AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)) / (2 / 61.0::DOUBLE), 6) AS score FROM (SELECT chunk_id, rank FROM bm25_top UNION ALL SELECT chunk_id, rank FROM dense_top) GROUP BY 1)"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))


def _index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """The index, written once in order of its terms; searches read it."""
    return lexical.stored_index(_texts(spark, sf), Scratch(spark, "lexical").path("postings"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks with metadata; labels give some of them an aggregator score."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    x = d.join(lab, "doc_id", "left")
    extra = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("tags"), F.concat_ws(", ", "lang", "source"), F.lit("aggregator_score"), F.when(F.col("quality") == 0, "0.8")), lambda k, v: v.isNotNull())
    return x.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 3).cast("string")).alias("document_id"), F.col("text").alias("content"), F.col("source").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://a.example/"), F.floor(F.col("doc_id") / 10).cast("string"))).alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("ts"), extra.alias("extra"),
    )


CHUNKS = """chunks AS (SELECT doc_id::VARCHAR AS chunk_id, 'd' || (doc_id // 3) AS document_id, text AS content, source, lang, quality, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/' || (doc_id // 10) END AS url FROM documents LEFT JOIN labels USING (doc_id))"""


@query("e4_postings", r"SELECT term, doc_id::VARCHAR AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents) WHERE strlen(term) < 40 GROUP BY ALL")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.build_index(_texts(spark, sf)).postings.select("term", "chunk_id", "tf")


@query("e5_bm25_search", f"WITH {BM25} SELECT chunk_id, score FROM bm25_top WHERE rank <= 10")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25_search(_index(spark, sf), TEXT, top_k=10)


@query("e5_bm25_all", f"WITH {BM25} SELECT chunk_id, score FROM bm25")
def e5_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every matching document's score."""
    return lexical.bm25_scores(_index(spark, sf), TEXT).select("chunk_id", F.round("score", 6).alias("score"))


@query(
    "e5_bm25_batch",
    rf"""WITH {POST}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
    s AS (SELECT query_id, doc_id::VARCHAR AS chunk_id, round(sum(w), 6) AS score FROM q JOIN w USING (term) WHERE strlen(term) < 40 GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10""",
)
def e5_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The whole benchmark as queries, in one job."""
    return lexical.bm25_batch(_index(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


@query(
    "e6_query_syntax",
    f"""WITH {POST} SELECT doc_id::VARCHAR AS chunk_id, round(sum(CASE WHEN term IN ('hand', 'thing', 'ing') THEN w ELSE 0 END), 6) AS score FROM w WHERE term IN ('hand', 'thing', 'ing', 'and')
    GROUP BY 1 HAVING count(*) FILTER (term = 'hand') > 0 AND count(*) FILTER (term = 'and') = 0""",
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25_scores(_index(spark, sf), "+hand thing title:ing -and").select("chunk_id", F.round("score", 6).alias("score"))


@query("e7_vector_search", f"WITH {DENSE} SELECT chunk_id, score FROM dense_top WHERE rank <= 10")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    return vector.vector_search(_vectors(spark, sf), _query_vector(spark, sf))


@query(
    "e7_vector_batch",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(greatest(0, least(1, {Q.cosine("a.embedding", "b.embedding")})), 6) AS score FROM embeddings a, embeddings b)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 5""",
)
def e7_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's nearest ones."""
    v = table(spark, sf, "embeddings")
    return vector.vector_search_batch(v, v.select(F.col("vec_id").alias("query_id"), "embedding"), 5, "vec_id")


@query("e9_rebuild_lexical", f"WITH {POST} SELECT (SELECT count(*) FROM post) AS n_postings, (SELECT sum(dl)::BIGINT FROM len) AS n_tokens, n AS n_chunks, round(avgdl, 6) AS avgdl FROM st")
def e9(spark: SparkSession, sf: str) -> DataFrame:
    """An engine whose postings were lost builds them from its chunks."""
    engine = Engine(spark, Scratch(spark, "rebuild").path("index"), Config(), "create")
    engine.store.append("chunks", _texts(spark, sf))
    engine.rebuild_lexical()
    index = engine.lexical_index()
    sums = index.postings.agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"))
    return sums.crossJoin(index.stats.select(F.col("n").alias("n_chunks"), F.round("avgdl", 6).alias("avgdl")))  # one row each


@query("e7_lsh_recall", "SELECT count(*) AS n, true AS enough FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0), range(10)")
def e7_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """Of the ten nearest vectors of every 50th vector, whether the approximate search finds 9 in 10."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vector.vector_search_batch(v, q, 10, "vec_id").select("query_id", "chunk_id")
    near = vector.lsh_search_batch(v, q, 10, "vec_id").select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = exact.join(near, ["query_id", "chunk_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("f1_to_ranked", f"WITH {BM25} SELECT chunk_id, rank::INT AS rank, score AS original_score, 'bm25' AS method FROM bm25_top")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.to_ranked(e5_all(spark, sf), "bm25", 50)


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    dense = vector.vector_search(_vectors(spark, sf), _query_vector(spark, sf), 50)
    return f1(spark, sf).unionByName(retrieval.to_ranked(dense, "dense", 50))


@query("f2_rrf", f"WITH {BM25}, {DENSE}, {RRF} SELECT * FROM fused")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rrf(_ranked(spark, sf)).select("chunk_id", "score")


@query("f3_minmax", f"WITH {BM25} SELECT chunk_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM bm25")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.minmax(e5_all(spark, sf))


FINAL = f"""hits AS (SELECT c.*, f.score FROM fused f JOIN chunks c USING (chunk_id)),
    demoted AS (SELECT *, CASE WHEN quality = 0 THEN score * (1 - 0.8::DOUBLE * 0.5) ELSE score END AS s1 FROM picked),
    scored AS (SELECT *, round(greatest(0, least(1, 0.7::DOUBLE * s1 + 0.3::DOUBLE * len(list_intersect(list_distinct({Q.words(Q.norm("content"))}), ['hand', 'ing', 'thing'])) / 3.0::DOUBLE)), 6) AS s2 FROM demoted)"""


def _final(picked: str) -> str:
    head, tail = FINAL.split("demoted AS", 1)
    return f"{head} picked AS ({picked}), demoted AS{tail}"


@query("f4_hybrid_search", f"WITH {BM25}, {DENSE}, {RRF}, {CHUNKS}, {_final('SELECT * FROM hits WHERE chunk_id IN (SELECT chunk_id FROM fused ORDER BY score DESC, chunk_id LIMIT 10)')} SELECT chunk_id, s2 AS score FROM scored")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(_index(spark, sf), _vectors(spark, sf), _chunks(spark, sf), TEXT, _query_vector(spark, sf)).select("chunk_id", "score")


PRE = f"""WITH {POST}, ok AS (SELECT doc_id FROM documents WHERE lang = 'en'), bm25 AS (SELECT doc_id::VARCHAR AS chunk_id, round(sum(w), 6) AS score FROM w SEMI JOIN ok USING (doc_id) WHERE term IN ('thing', 'ing', 'hand') GROUP BY 1),
    bm25_top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 50), q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
    dense AS (SELECT vec_id::VARCHAR AS chunk_id, round(greatest(0, least(1, {Q.cosine("embedding", "e")})), 6) AS score FROM embeddings SEMI JOIN ok ON vec_id = doc_id, q),
    dense_top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM dense QUALIFY rank <= 50), {RRF}, {CHUNKS}, {_final("SELECT * FROM hits WHERE chunk_id IN (SELECT chunk_id FROM fused ORDER BY score DESC, chunk_id LIMIT 10)")} SELECT chunk_id, s2 AS score FROM scored"""


@query("f4_hybrid_prefilter", PRE)
def f4_pre(spark: SparkSession, sf: str) -> DataFrame:
    f = retrieval.Filters(metadata_equals={"lang": "en"})
    return retrieval.hybrid_search(_index(spark, sf), _vectors(spark, sf), _chunks(spark, sf), TEXT, _query_vector(spark, sf), filters=f, mode="pre").select("chunk_id", "score")


@query("f5_filters", "SELECT doc_id::VARCHAR AS chunk_id FROM documents WHERE doc_id % 2 = 0 AND doc_id BETWEEN 100 AND 900 AND lang IN ('en', 'de') AND source IN ('src0', 'src2', 'src4') AND 'https://a.example/' || (doc_id // 10) LIKE 'https://a.example/%'")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import datetime, timezone

    at = lambda n: datetime.fromtimestamp(1_700_000_000 + 3600 * n, timezone.utc)
    f = retrieval.Filters(url_prefix="https://a.example/", min_ts=at(100), max_ts=at(900), metadata_contains={"tags": ["src0", "src2", "src4"], "lang": ["en", "de"]})
    return _chunks(spark, sf).filter(f.column()).select("chunk_id")


@query("f6_aggregator_demotion", f"WITH {BM25} SELECT chunk_id, round(CASE WHEN quality = 0 THEN score * 0.6 ELSE score END, 6) AS score FROM bm25 LEFT JOIN labels ON doc_id::VARCHAR = chunk_id")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    hits = e5_all(spark, sf).join(_chunks(spark, sf).select("chunk_id", "extra"), "chunk_id")
    return hits.transform(retrieval.aggregator_demotion()).select("chunk_id", F.round("score", 6).alias("score"))


def _overlap(*terms: str) -> str:
    return f"len(list_intersect(list_distinct({Q.words(Q.norm('text'))}), [{', '.join(repr(t) for t in terms)}]))"


@query("f7_overlap_rerank", f"SELECT doc_id::VARCHAR AS chunk_id, round(0.35::DOUBLE + 0.3::DOUBLE * {_overlap('hand', 'thing')} / 2.0::DOUBLE, 6) AS score FROM documents")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    hits = _chunks(spark, sf).withColumn("score", F.lit(0.5))
    return hits.transform(retrieval.overlap_rerank("the thing of hand")).select("chunk_id", F.round("score", 6).alias("score"))


@query("f8_simple_rerank", f"SELECT doc_id::VARCHAR AS chunk_id, round(0.35::DOUBLE + 0.3::DOUBLE * {_overlap('hand', 'of', 'the', 'thing')} / 4.0::DOUBLE, 6) AS score FROM documents")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    hits = _chunks(spark, sf).withColumn("score", F.lit(0.5))
    return hits.transform(retrieval.overlap_rerank("the thing of hand", stop_words=())).select("chunk_id", F.round("score", 6).alias("score"))


@query("f9_scoring_pipeline", f"WITH {BM25} SELECT chunk_id, score AS score_0, round(least(1, CASE WHEN quality = 0 THEN score * 0.6 ELSE score END), 6) AS score FROM bm25 LEFT JOIN labels ON doc_id::VARCHAR = chunk_id")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    """with the scores before each stage."""
    hits = e5_all(spark, sf).join(_chunks(spark, sf).select("chunk_id", "extra"), "chunk_id")
    return hits.transform(retrieval.pipeline(retrieval.aggregator_demotion(), explain=True)).select("chunk_id", "score_0", "score")


GROUPS = f"""WITH {BM25}, {CHUNKS}, h AS (SELECT c.*, b.score, coalesce('u:' || url, 'd:' || document_id) AS key FROM bm25 b JOIN chunks c USING (chunk_id)),
    g AS (SELECT key, max(score) AS score, count(*) AS n, arg_min(chunk_id, (-score, chunk_id)) AS best FROM h GROUP BY 1)
    SELECT row_number() OVER (ORDER BY score DESC, n DESC, key)::INT AS citation, score, n::INT AS n_chunks, best AS best_chunk FROM g ORDER BY 1 LIMIT 10"""


@query("f11_group_results", GROUPS.replace("(-score, chunk_id)", "[printf('%020.6f', 1000 - score), chunk_id]"))
def f11(spark: SparkSession, sf: str) -> DataFrame:
    hits = e5_all(spark, sf).join(_chunks(spark, sf), "chunk_id")
    return retrieval.group_results(hits, 10).select("citation", "score", "n_chunks", F.col("chunks")[0]["chunk_id"].alias("best_chunk"))


@query("f12_citations")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    hits = e5_all(spark, sf).join(_chunks(spark, sf), "chunk_id")
    return retrieval.citations(retrieval.group_results(hits, 10), TEXT)


@query("b29_quality_snippets")
def b29_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of the citations of a query that no document holds: the sentence most like prose."""
    from seekmill.functions import snippet

    return table(spark, sf, "documents").select("doc_id", snippet.snippet(F.lit("qzx"), F.col("text")).alias("snippet"), T.heuristic_tokens(F.col("text")).alias("n_tokens"))
