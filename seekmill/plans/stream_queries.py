"""Streams, ingestion, metrics and the engine over whole tables. Streams run until what there is, is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.config import Config
from seekmill.operators import dedup, lexical, metrics
from seekmill.plans import sql as Q
from seekmill.plans.document_queries import IDS, PROCESS_SQL, process_sql
from seekmill.plans.engine import Engine
from seekmill.plans.registry import query, table
from seekmill.plans.search_queries import BM25
from seekmill.sources import files, store as S, wiki
from seekmill.streaming import ingest


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("a1_wiki_import")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as a wiki dump and imported again."""
    path = S.Scratch(spark, "wiki").path("enwiki.xml")
    d = table(spark, sf, "documents")
    text = F.struct(F.col("text").alias("_VALUE"), F.lit("preserve").alias("_space"))
    pages = d.select(F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), (F.col("doc_id") % 2).alias("ns"), F.col("doc_id").alias("id"), F.struct((F.col("doc_id") + 1).alias("id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), text.alias("text")).alias("revision"))
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").mode("overwrite").save(path)
    return wiki.page_documents(wiki.read_pages(spark, path)).select("id", "title", "url", F.octet_length("content").alias("bytes"))


@query("a6_files", "SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    """A folder tree of text files, one for each document's line table; counted by folder."""
    path = S.Scratch(spark, "files").path("tree")
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    d.select("lang", F.to_json(F.struct("doc_id", "text")).alias("value")).write.partitionBy("lang").text(path)
    read = files.read_files(spark, path).select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.explode(F.split(F.rtrim(F.col("content"), F.lit("\n")), "\n")).alias("x"))
    return read.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("a13_store_round_trip", "SELECT conv_id || '_' || turn AS chunk_id, strlen(text)::BIGINT AS bytes FROM conversations")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    store = S.Store(spark, S.Scratch(spark, "store").path("index"), "create")
    c = table(spark, sf, "conversations")
    chunks = c.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    store.append("chunks", chunks)
    return S.Store(spark, store.path, "read").read("chunks").select("chunk_id", F.octet_length("content").cast("bigint").alias("bytes"))


@query("j1_stream_ingest", r"SELECT count(*) AS n_chunks, sum(strlen(text))::BIGINT AS bytes, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn, term FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations WHERE trim(text) <> '') WHERE strlen(term) < 40)) AS n_postings FROM conversations WHERE trim(text) <> ''")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    scratch = S.Scratch(spark, "ingest")
    store = S.Store(spark, scratch.path("index"), "create")
    c = table(spark, sf, "conversations").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("ordinal"), F.col("text").alias("content"))
    for name, kind in (x.split(" ", 1) for x in S.CHUNKS.split(", ")):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    ingest.ingest(ingest.stream_parquet(spark, c, scratch.path("in"), 3), store, scratch.path("log")).awaitTermination()
    chunks = store.read("chunks").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.octet_length("content")).alias("bytes"))
    return chunks.crossJoin(store.read("postings").agg(F.count(F.lit(1)).alias("n_postings")))


@query("j2_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    s = ingest.sessions(_events(spark, sf), "6 hours")
    return s.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("j4_import_dedup", f"SELECT status, count(*) AS n FROM ({PROCESS_SQL}) GROUP BY 1")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of what a deduplicating import does with the documents."""
    return dedup.process(table(spark, sf, "documents")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _padded(spark: SparkSession, sf: str, prefix: str = "") -> DataFrame:
    """Documents with ids that sort as their numbers do."""
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit(prefix), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), F.col("text").alias("content"), F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string")).alias("url"))


@query(
    "j4_registry",
    f"SELECT entry_id, arg_max(hash, doc_id) FILTER (status <> 'metadata_updated') AS content_hash, count(*) AS n_urls FROM ({process_sql(0)}) JOIN (SELECT doc_id, sha256({Q.norm('text')}) AS hash FROM documents) USING (doc_id) GROUP BY 1",
)
def j4_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The stored registry after all documents came in."""
    engine = Engine(spark, S.Scratch(spark, "engine").path("index"), Config(), "create")
    engine.index(_padded(spark, sf))
    return engine.store.read("registry").select(F.col("entry_id").cast("bigint").alias("entry_id"), "content_hash", F.size("urls").cast("bigint").alias("n_urls"))


@query(
    "j4_import_twice",
    f"""WITH docs AS MATERIALIZED {IDS}, once AS MATERIALIZED ({process_sql(0)}),
    known AS MATERIALIZED (SELECT entry_id, arg_max(hash, doc_id) FILTER (status <> 'metadata_updated') AS hash, arg_max(simhash, doc_id) FILTER (status <> 'metadata_updated') AS simhash FROM once JOIN docs USING (doc_id) GROUP BY 1),
    other AS MATERIALIZED (SELECT * FROM docs WHERE hash NOT IN (SELECT hash FROM known)),
    near AS MATERIALIZED (SELECT doc_id, arg_min(entry_id, [bit_count(xor(o.simhash, k.simhash))::BIGINT, entry_id]) AS entry_id FROM other o JOIN known k ON bit_count(xor(o.simhash, k.simhash)) <= 3 GROUP BY 1),
    rest AS MATERIALIZED (SELECT * FROM other WHERE doc_id NOT IN (SELECT doc_id FROM near))
    SELECT (SELECT count(*) FROM known) + (SELECT count(DISTINCT entry_id) FROM ({process_sql(0, "rest")})) AS entries, (SELECT count(*) FROM docs) * 2 AS urls, (SELECT count(*) FROM known WHERE entry_id NOT IN (SELECT entry_id FROM near)) AS unchanged""",
)
def j4_twice(spark: SparkSession, sf: str) -> DataFrame:
    """All documents come again under other ids and URLs: those whose text an entry has add their URL, the others change the entry they are near, as it
    had the content of a later one, or are new. Counts of the entries, of their URLs and of the entries that are as they were but for their URLs."""
    engine = Engine(spark, S.Scratch(spark, "engine").path("index"), Config(), "create")
    engine.index(_padded(spark, sf))
    first = S.Scratch(spark, "registry").table(engine.store.read("registry").select("entry_id", "content_hash"), "first")
    engine.index(_padded(spark, sf, "again").withColumn("url", F.concat("url", F.lit("#again"))))
    now = S.Scratch(spark, "registry").table(engine.store.read("registry").select("entry_id", "content_hash", F.size("urls").alias("n")), "now")
    same = now.join(first, ["entry_id", "content_hash"], "left_semi").agg(F.count(F.lit(1)).alias("unchanged"))
    return now.agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("urls")).crossJoin(same)  # one row each


@query("j5_import_plain", "SELECT count(*) AS documents, count(*) AS chunks, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE trim(text) <> ''")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    """An import without dedup: every document that has text is indexed, whole."""
    engine = Engine(spark, S.Scratch(spark, "engine").path("index"), Config(), "create")
    engine.index(_padded(spark, sf), whole=True, deduplicate=False)
    return engine.stats()


@query("j7_latest_status", "SELECT user_id, arg_max(event_type, [epoch_us(ts), event_id]) AS event_type, max(ts) AS ts, arg_max(event_id, [epoch_us(ts), event_id]) AS event_id FROM events GROUP BY 1")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.latest_status(table(spark, sf, "events"))


@query("j7_event_counters", "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def j7_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.event_counters(table(spark, sf, "events"))


LE = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}" for b in metrics.BOUNDS) + " ELSE 'inf'::DOUBLE END"
HIST = f"""WITH p AS (SELECT event_type, {LE}::DOUBLE AS le, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2)
    SELECT event_type, le, n, sum(n) OVER (PARTITION BY event_type ORDER BY le)::BIGINT AS cumulative, sum(n) OVER (PARTITION BY event_type)::BIGINT AS total, round(sum(s) OVER (PARTITION BY event_type) / sum(n) OVER (PARTITION BY event_type), 4) AS mean FROM p"""


@query("j8_histogram", HIST)
def j8(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(table(spark, sf, "events"), "value", ["event_type"])


@query("j8_prometheus", f"""SELECT 'latency_bucket{{type="' || event_type || '",le="' || CASE WHEN isinf(le) THEN '+Inf' ELSE le::BIGINT::VARCHAR END || '"}} ' || cumulative AS line FROM ({HIST})""")
def j8_prometheus(spark: SparkSession, sf: str) -> DataFrame:
    h = j8(spark, sf).withColumnRenamed("event_type", "type")
    return metrics.prometheus(h, "latency", "type")


@query("j8_stream_windows", "WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def j8_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows that the watermark has closed."""
    scratch = S.Scratch(spark, "windows")
    stream = ingest.stream_parquet(spark, _events(spark, sf).select("event_id", "ts", "event_type", "value"), scratch.path("in"), 1)
    return ingest.drain(ingest.event_windows(stream), scratch.path("out"), scratch.path("log")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("j10_engine_search")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    """The engine from documents to grouped results."""
    engine = Engine(spark, S.Scratch(spark, "engine").path("index"), Config(), "create")
    engine.index(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("title")))
    groups, _ = engine.answer("thing ing hand")
    return groups.select("citation", "document_id", "score", "n_chunks")


@query("j10_stored_search", f"WITH {BM25} SELECT chunk_id, score FROM bm25_top WHERE rank <= 10")
def j10_stored(spark: SparkSession, sf: str) -> DataFrame:
    """E1, E5 over a stored index: documents written in two commits, of which the second replaces some chunks of the first, then searched."""
    store = S.Store(spark, S.Scratch(spark, "engine").path("index"), "create")
    chunks = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"), (F.col("doc_id") % 3).alias("k"))
    empty = chunks.filter("trim(coalesce(content, '')) = ''").select("chunk_id", F.lit(0).cast("bigint").alias("dl"))
    ingest.write_chunks(store, chunks.filter("k < 2").withColumn("content", F.when(F.col("k") == 0, "an old version").otherwise(F.col("content"))).drop("k"))
    ingest.write_chunks(store, chunks.filter("k <> 1").drop("k"), dead=chunks.filter("k = 0").select("chunk_id"), add={})
    store.append("lengths", empty)  # documents without text count in the mean length
    index = lexical.LexicalIndex(store.read("postings"), store.read("lengths"), lexical.statistics(spark, *store.size()))
    return lexical.bm25_search(index, "thing ing hand", 10)


@query("j14_cache_eviction", "SELECT event_id FROM (SELECT event_id, sum(1 + event_id % 5) OVER (ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS used, ts FROM events) WHERE used <= 5000 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAYS")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    from seekmill.operators import cache

    e = table(spark, sf, "events").select("event_id", "ts", (1 + F.col("event_id") % 5).alias("size"))
    return cache.keep(e, "event_id", "ts", "size", 5000, 20 * 86400).select("event_id")
