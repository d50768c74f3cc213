"""Chunking, dedup, storage and clustering over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekmill.config import Config
from seekmill.functions import identity, urls
from seekmill.operators import chunking, clustering, dedup, vector
from seekmill.plans import sql as Q
from seekmill.plans.engine import Engine
from seekmill.plans.registry import query, table
from seekmill.plans.text_queries import SIM_SQL
from seekmill.sources import files, store as S, wiki


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("title"), "lang")


# A: storage


@query("a2_page_filter")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages with markup before their text: those without text are redirects, those of source src1 talk pages."""
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("A \'\'\'page\'\'\' of [[Category:All]][[Main page|the main page]].\n== Text ==\n"), F.col("text"))
    pages = d.select(F.lit("enwiki.xml").alias("file"), F.col("doc_id").alias("id"), F.when(F.col("source") == "src1", 1).otherwise(0).alias("ns"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), (F.coalesce("text", F.lit("")) == "").alias("redirect"), text.alias("wikitext"), F.lit(None).cast("timestamp").alias("modified"))
    return wiki.page_documents(pages).select("id", F.element_at(F.split("url", "/"), -1).alias("title"), F.md5("content").alias("digest"))


@query("a9_pdf_text", rf"SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{Q.S}+|{Q.S}+$', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM documents")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", files.clean_pdf_text(F.col("text")).alias("text"))


@query("a11_export", "SELECT conv_id, turn, strlen(text)::BIGINT AS bytes, role FROM conversations")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    """The exported JSON lines, read back."""
    path = S.Scratch(spark, "export").path("chunks")
    S.export(table(spark, sf, "conversations"), path)
    back = spark.read.schema("conv_id bigint, turn bigint, role string, text string").json(path)
    return back.select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("bytes"), "role")


@query("a12_url_index", f"SELECT url, arg_max(page_id, page_id)::VARCHAR AS document_id FROM (SELECT page_id, {Q.norm_url('url')} AS url FROM pages) GROUP BY 1")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(urls.normalize_url(F.col("url")).alias("url"), F.col("page_id").cast("string").alias("document_id"), F.col("page_id").alias("ts"))
    return S.url_index(p)


@query("a12_store_put", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents")
def a12_put(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.put(d, d.filter("doc_id % 10 = 0").withColumn("lang", F.upper("lang")), "doc_id")


# C: chunks


@query("c1_sections")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).withColumn("content", F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.regexp_replace("content", "\n", "\n## part\n")))
    c = chunking.chunk_documents(d, chunking.ChunkConfig(min_size=0))
    return c.select("chunk_id", F.array_join("section_hierarchy", "/").alias("path"), "token_count")


@query("c3_chunks")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf)).select("document_id", "chunk_id", "ordinal", "token_count", F.round("position", 6).alias("position"), "preceding_chunk_id", "following_chunk_id")


@query("c6_link_chunks", "SELECT conv_id || '_' || turn AS chunk_id, lag(conv_id || '_' || turn) OVER w AS preceding_chunk_id, lead(conv_id || '_' || turn) OVER w AS following_chunk_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def c6(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"))
    return chunking.link_chunks(t, "conv_id", "turn").select("chunk_id", "preceding_chunk_id", "following_chunk_id")


@query("c7_chunk_metadata", "SELECT doc_id::VARCHAR AS document_id, lang, source AS title FROM documents WHERE text <> ''")
def c7(spark: SparkSession, sf: str) -> DataFrame:
    """What chunks carry of their documents, once a document."""
    c = chunking.chunk_documents(_docs(spark, sf), chunking.ChunkConfig(min_size=0), keep=("lang", "title"))
    return c.filter("ordinal = 0").select("document_id", "lang", "title")


@query("c8_whole_chunks", "SELECT doc_id::VARCHAR || '_0' AS chunk_id, coalesce(text, '') AS content, 0 AS token_count FROM documents")
def c8(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf), mode="whole").select("chunk_id", "content", "token_count")


# D: dedup

IDS = f"(SELECT doc_id, text, sha256({Q.norm('text')}) AS hash, simhash FROM documents JOIN ({SIM_SQL}) USING (doc_id))"
NEAR = f"ids AS MATERIALIZED {IDS}, nodes AS MATERIALIZED (SELECT simhash, min(doc_id) AS first FROM ids GROUP BY 1)"


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.with_identity(table(spark, sf, "documents")).select("doc_id", "content_hash", "simhash")


@query("d1_exact_duplicates", f"SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({Q.norm('text')})) AS first_id FROM documents) WHERE doc_id > first_id")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"))
    return dedup.exact_duplicates(d)


def _pairs_sql(t: int) -> str:
    return f"WITH {NEAR} SELECT a.simhash AS a, b.simhash AS b, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM nodes a JOIN nodes b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= {t}"


@query("d2_near_pairs", _pairs_sql(3))
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_pairs(_identified(spark, sf)).withColumn("distance", F.col("distance").cast("int"))


@query("d2_near_pairs_10", _pairs_sql(10))
def d2_10(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_pairs(_identified(spark, sf), 10).withColumn("distance", F.col("distance").cast("int"))


@query("d2_banded_pairs", _pairs_sql(7))
def d2_banded(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.banded_pairs(_identified(spark, sf), 7).withColumn("distance", F.col("distance").cast("int"))


@query(
    "d3_classify",
    f"""WITH {NEAR}, texts AS (SELECT hash, min(doc_id) AS first_text FROM ids GROUP BY 1),
    best AS (SELECT i.doc_id, min([bit_count(xor(i.simhash, n.simhash))::BIGINT, n.first]) AS b FROM ids i JOIN nodes n ON n.first < i.doc_id AND n.simhash <> i.simhash AND bit_count(xor(i.simhash, n.simhash)) <= 3 GROUP BY 1)
    SELECT doc_id, CASE WHEN first_text < doc_id THEN 'exact' WHEN first < doc_id OR b IS NOT NULL THEN 'near' ELSE 'new' END AS status,
      CASE WHEN first_text < doc_id THEN first_text WHEN first < doc_id THEN first ELSE b[2] END AS match_id, CASE WHEN first < doc_id THEN 0 ELSE b[1] END::INT AS distance
    FROM ids JOIN texts USING (hash) JOIN nodes USING (simhash) LEFT JOIN best USING (doc_id)""",
)
def d3(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.classify(_identified(spark, sf))


def process_sql(least: int, source: str = IDS) -> str:
    return f"""WITH RECURSIVE ids AS MATERIALIZED (SELECT * FROM {source} WHERE strlen(coalesce(text, '')) >= {least}), nodes AS MATERIALIZED (SELECT simhash, min(doc_id) AS first FROM ids GROUP BY 1),
    e AS MATERIALIZED (SELECT a.first AS early, b.first AS late, b.simhash AS s, bit_count(xor(a.simhash, b.simhash))::INT AS dist FROM nodes a JOIN nodes b ON a.first < b.first AND bit_count(xor(a.simhash, b.simhash)) <= 3),
    walk AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS found UNION ALL
      SELECT n.first, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.late = n.first AND list_contains(w.found, e.early)) THEN w.found ELSE list_append(w.found, n.first) END
      FROM walk w JOIN (SELECT first, lag(first, 1, 0::BIGINT) OVER (ORDER BY first) AS prev FROM nodes WHERE first IN (SELECT late FROM e) OR first IN (SELECT early FROM e)) n ON n.prev = w.pos),
    entry AS (SELECT unnest(found) AS first FROM (SELECT found FROM walk ORDER BY pos DESC LIMIT 1) UNION SELECT first FROM nodes WHERE first NOT IN (SELECT late FROM e) AND first NOT IN (SELECT early FROM e)),
    own AS (SELECT simhash, first FROM nodes SEMI JOIN entry USING (first)),
    best AS (SELECT i.doc_id, min([bit_count(xor(i.simhash, o.simhash))::BIGINT, o.first]) AS b FROM ids i JOIN own o ON o.first <= i.doc_id AND bit_count(xor(i.simhash, o.simhash)) <= 3 GROUP BY 1),
    placed AS (SELECT doc_id, hash, b[2] AS entry_id, b[1]::INT AS distance FROM ids JOIN best USING (doc_id))
    SELECT doc_id, CASE WHEN doc_id = entry_id THEN 'indexed' WHEN hash = lag(hash) OVER (PARTITION BY entry_id ORDER BY doc_id) THEN 'metadata_updated' ELSE 'content_updated' END AS status, entry_id, distance FROM placed
    UNION ALL SELECT doc_id, 'skipped', NULL, NULL FROM documents WHERE strlen(coalesce(text, '')) < {least}"""


PROCESS_SQL = process_sql(100)


@query("d4_process", PROCESS_SQL)
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.process(table(spark, sf, "documents"))


@query("d5_registry_stats", "SELECT source AS source_type, count(*) AS documents, sum(1 + doc_id % 3)::BIGINT AS chunks, sum(1)::BIGINT AS urls FROM (SELECT DISTINCT ON (text) doc_id, source FROM documents ORDER BY text, doc_id) GROUP BY 1")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("text").agg(F.min_by("source", "doc_id").alias("source_type"), F.min("doc_id").alias("i"))
    chunks = F.transform(F.sequence(F.lit(0), F.col("i") % 3), lambda n: F.concat_ws("_", F.col("i").cast("string"), n.cast("string")))
    r = d.select(F.col("i").cast("string").alias("content_id"), "source_type", F.array(F.concat(F.lit("u"), F.col("i").cast("string"))).alias("urls"), chunks.alias("chunk_ids"))
    return dedup.registry_stats(r)


@query("d5_register", "SELECT lang AS content_id, max_by(source, doc_id) AS source_type, count(DISTINCT source) AS n_urls FROM documents GROUP BY 1")
def d5_register(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rows = d.groupBy("lang", (F.col("doc_id") % 4).alias("k")).agg(F.collect_set("source").alias("urls"), F.max("doc_id").alias("last"), F.max_by("source", "doc_id").alias("source_type"))
    rows = rows.select(F.col("lang").alias("content_id"), "source_type", "urls", F.array(F.col("last").cast("string")).alias("chunk_ids"), "k", "last")
    newest = F.max("last").over(Window.partitionBy("content_id"))
    rows = rows.withColumn("new", F.col("last") == newest).drop("k", "last")
    r = dedup.register(rows.filter("NOT new").drop("new"), rows.filter("new").drop("new"))
    return r.select("content_id", "source_type", F.size("urls").cast("bigint").alias("n_urls"))


@query("d7_url_dedup", f"SELECT min(page_id) AS page_id, norm_url FROM (SELECT page_id, {Q.norm_url('url')} AS norm_url FROM pages) GROUP BY 2")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.url_dedup(table(spark, sf, "pages").select("page_id", "url")).select("page_id", "norm_url")


@query(
    "d8_crawl_dedup",
    f"""WITH ws AS (SELECT page_id, {Q.words(Q.norm('html'))} AS ws FROM pages),
    ids AS MATERIALIZED (SELECT p.page_id, sha256({Q.norm('html')}) AS hash, coalesce(s.simhash, 0) AS simhash FROM pages p LEFT JOIN ({Q.simhash('ws', 'page_id')}) s USING (page_id)),
    nodes AS MATERIALIZED (SELECT simhash, min(page_id) AS first FROM ids GROUP BY 1)
    SELECT page_id FROM ids i WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.first < i.page_id AND bit_count(xor(i.simhash, n.simhash)) <= 3)
      AND NOT EXISTS (SELECT 1 FROM ids o WHERE o.hash = i.hash AND o.page_id < i.page_id)""",
)
def d8(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose text is neither an earlier one's nor near it."""
    p = dedup.with_identity(table(spark, sf, "pages").select("page_id", "html"), "html")
    return dedup.classify(p, id_col="page_id").filter("status = 'new'").select("page_id")


@query("d6_content_lru", "SELECT page_id, CASE WHEN before IS NULL OR n - before > 500 THEN 'new' ELSE 'seen' END AS status FROM (SELECT page_id, n, lag(n) OVER (PARTITION BY hash ORDER BY n) AS before FROM (SELECT page_id, hash, row_number() OVER (ORDER BY page_id) AS n FROM (SELECT page_id, sha256(" + Q.norm("html") + ") AS hash FROM pages)))")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    """Page texts against a window of the 500 pages before."""
    p = table(spark, sf, "pages").select("page_id", identity.content_hash(F.col("html")).alias("content_hash"))
    return dedup.recent_duplicates(p, "page_id", 500).select("page_id", "status")


@query("d9_replace_by_url", "SELECT page_id + CASE WHEN page_id % 2 = 0 THEN 1000000 ELSE 0 END AS page_id, url FROM pages WHERE page_id % 2 = 0 OR url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def d9(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url")
    return dedup.replace_by_url(p, p.filter("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 1000000))


@query("d10_migrate_registry", "SELECT conv_id, sha256(trim(regexp_replace(lower(string_agg(text || ' ', '' ORDER BY turn)), '" + Q.S + "+', ' ', 'g'))) AS content_hash FROM conversations GROUP BY 1")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    m = dedup.migrate_registry(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return m.select("conv_id", identity.content_hash(F.col("text")).alias("content_hash"))


@query("d11_seen_urls", f"SELECT DISTINCT {Q.norm_url('u')} AS norm_url FROM (SELECT url AS u FROM pages UNION ALL SELECT regexp_replace(url, '[?#].*$', '') FROM pages)")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("url", F.regexp_replace("url", "[?#].*$", "").alias("canonical_url"))
    return dedup.seen_urls(p)


# H: clusters


@query("h1_kmeans")
def h1(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.kmeans(table(spark, sf, "embeddings"), 10)[0]


CENTROIDS = f"""avgs AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
    cents AS (SELECT label, {Q.unit("v")} AS c FROM (SELECT label, list(m ORDER BY i) AS v FROM avgs GROUP BY 1))"""


@query("h2_assign", f"WITH {CENTROIDS}, d AS (SELECT vec_id, min([round(1 - {Q.cosine('embedding', 'c')}, 9), cents.label]) AS b FROM embeddings, cents GROUP BY 1) SELECT vec_id, b[2]::INT AS centroid_id, round(b[1], 6) AS distance FROM d")
def h2(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return clustering.assign(v, clustering.mean_vectors(v, "label").withColumnRenamed("label", "centroid_id"))


@query("h3_inertia", f"WITH {CENTROIDS}, d AS (SELECT vec_id, min(round(1 - {Q.cosine('embedding', 'c')}, 9)) AS d FROM embeddings, cents GROUP BY 1) SELECT round(sum(pow(round(d, 6), 2)), 6) AS inertia FROM d")
def h3(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.inertia(h2(spark, sf))


@query("h4_document_vectors", f"WITH {CENTROIDS} SELECT label, list_transform(c, lambda x: CASE WHEN round(x, 5) = 0 THEN 0 ELSE round(x, 5) END) AS centroid FROM cents")
def h4(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.mean_vectors(table(spark, sf, "embeddings"), "label").select("label", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"))


@query("h5_unmatched_urls", f"SELECT DISTINCT {Q.norm_url('url')} AS url FROM pages EXCEPT SELECT {Q.norm_url('url')} FROM pages SEMI JOIN embeddings ON page_id = vec_id")
def h5_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return _clustered(spark, sf)[1]


@query("h5_cluster_documents")
def h5(spark: SparkSession, sf: str) -> DataFrame:
    return _clustered(spark, sf)[0]


def _clustered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "pages").withColumn("url", urls.normalize_url(F.col("url")))
    chunks = p.select(F.col("page_id").cast("string").alias("chunk_id"), F.col("page_id").cast("string").alias("document_id"), "url", urls.path(F.col("url")).alias("title"))
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return clustering.cluster_documents(p.select("url"), chunks, vecs, 8)


# E: storage of indexes


@query("e2_embed", f"""WITH h AS (SELECT item_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h FROM benchmark)
    SELECT item_id, list_transform({Q.unit("list_transform(range(16), lambda i: ((h + i) % 1000) / 500.0 - 1.0)")}, lambda x: CASE WHEN round(x, 4) = 0 THEN 0 ELSE round(x, 4) END) AS v FROM h""")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    import hashlib

    import numpy as np

    def embedder(texts: list[str]) -> np.ndarray:
        h = np.array([int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in texts])
        return (h[:, None] + np.arange(16)) % 1000 / 500.0 - 1.0

    b = vector.embed(table(spark, sf, "benchmark"), embedder, "text", dims=16)
    return b.select("item_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("v"))


@query("e3_remove_documents", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return S.remove(table(spark, sf, "documents").select("doc_id", "lang"), gone, "doc_id")


@query("e8_vector_keys", "SELECT label, count(*) AS n, count(*) FILTER (vec_id % 2 = 0) AS removed FROM embeddings GROUP BY 1")
def e8(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    left = S.remove(v, v.filter("vec_id % 2 = 0"), "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("kept"))
    whole = v.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(left, "label", "left")
    return whole.select("label", "n", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"))


@query("e10_index_stats", "SELECT count(DISTINCT conv_id) AS documents, count(*) AS chunks, sum(strlen(text))::BIGINT AS bytes FROM conversations")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(spark, S.Scratch(spark, "stats").path("index"), Config(), "create")
    c = table(spark, sf, "conversations")
    engine.store.append("chunks", c.select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("document_id"), F.col("text").alias("content")))
    return engine.stats()
