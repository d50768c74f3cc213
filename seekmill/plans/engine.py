"""The engine: one object with all that a client may ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.config import Config
from seekmill.functions import robots, text as T
from seekmill.operators import chunking, clustering, crawl, dedup, lexical, retrieval, routing
from seekmill.sources import store as S
from seekmill.streaming import ingest

MAX_QUERY_BYTES = 10_000


class Engine:
    """Index, search, delete and inspect a corpus that is stored as Parquet tables under path. An engine's tables are append-only segments under numbered manifests."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, mode: str = "open", embedder: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.config = spark, (config or Config()).validate()
        self.store = S.Store(spark, path, mode)
        dims = self.config.index.dims
        self.embedder = embedder or (lambda chunks: chunks.withColumn("embedding", T.hash_embedding(F.col("content"), dims)))

    # writing

    def index(self, docs: DataFrame, whole: bool = False, deduplicate: bool | None = None) -> int:
        """Chunk and index docs(id, content, title, url, ts, metadata). Gives the number of chunks.

        With dedup on (the default of the configuration, or deduplicate) documents meet the registry of all there are (D4): copies of an
        entry add their URL to it, near copies replace its content (update_near) or are skipped, others become entries.
        Documents whose id or URL is indexed already are replaced (D9). Deletions, chunks, postings, vectors and registry entries are one commit.
        With dedup off (J5) everything is indexed as it comes.
        """
        scratch = S.Scratch(self.spark, "index")
        for name, kind in (("title", "string"), ("url", "string"), ("ts", "timestamp"), ("metadata", "map<string,string>")):
            if name not in docs.columns:
                docs = docs.withColumn(name, F.lit(None).cast(kind))
        registry, dead = {}, None
        if self.config.dedup.enabled if deduplicate is None else deduplicate:
            docs, registry["registry"], dead = self._register(docs.withColumn("id", F.col("id").cast("string")), scratch)
        c = self.config.chunking
        chunks = chunking.chunk_documents(docs, chunking.ChunkConfig(c.chunk_size, c.overlap, c.min_size), mode="whole" if whole else "sections", keep=("title", "url", "ts", "metadata"))
        chunks = scratch.table(chunks.withColumn("extra", F.coalesce("metadata", F.create_map().cast("map<string,string>"))).drop("metadata"), "chunks")
        gone = self._keys(docs.select(F.col("id").cast("string").alias("document_id")), "document_id").union(self._keys(docs.filter("url IS NOT NULL").select("url"), "url"))
        ingest.write_chunks(self.store, chunks, self.embedder, gone.union(dead) if dead is not None else gone, registry)
        n = chunks.count()
        scratch.drop()
        return n

    def _register(self, docs: DataFrame, scratch: S.Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(the documents to index, under the ids of their entries; the registry's new rows; the keys of its rows that go)."""
        d = self.config.dedup
        known = self.store.read("registry")
        ids = scratch.table(dedup.with_identity(docs, "content").select("id", "content_hash", "simhash", "url"), "ids")
        steps = S.Scratch(self.spark, "registry")
        found = scratch.table(dedup.against_registry(ids, known, d.threshold, d.update_near, steps), "found")
        steps.drop()
        row = ids.join(found, "id")
        key = lambda c: F.concat(F.lit("entry:"), F.col(c))
        # an entry's content is that of the last document that changed it
        fresh = row.filter("status IN ('indexed', 'content_updated')").groupBy("entry_id").agg(F.max_by(F.struct("id", "content_hash", "simhash"), "id").alias("l"))
        fresh = scratch.table(fresh.select("entry_id", "l.*"), "fresh")
        urls = row.filter("status <> 'skipped' AND url IS NOT NULL").select("entry_id", "url").unionByName(known.select("entry_id", F.explode("urls").alias("url")).join(row.select("entry_id").distinct(), "entry_id", "left_semi"))
        urls = urls.groupBy("entry_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
        touched = row.filter("status <> 'skipped'").select("entry_id").distinct()
        old = known.join(touched, "entry_id", "left_semi").select("entry_id", F.col("content_hash").alias("h"), F.col("simhash").alias("s"))
        rows = touched.join(old, "entry_id", "left").join(fresh.drop("id"), "entry_id", "left").join(urls, "entry_id", "left")
        none = F.array().cast("array<string>")
        rows = rows.select(key("entry_id").alias("chunk_id"), "entry_id", F.coalesce("content_hash", "h").alias("content_hash"), F.coalesce("simhash", "s").alias("simhash"), F.coalesce("urls", none).alias("urls"))
        named = fresh.select("id", "entry_id").hint("merge")
        left = docs.join(named, "id").withColumn("id", F.col("entry_id")).drop("entry_id").dropDuplicates(["id"])
        return scratch.table(left, "docs"), scratch.table(rows, "registry"), scratch.table(touched.select(key("entry_id").alias("chunk_id")), "old")

    def _keys(self, keys: DataFrame, key: str) -> DataFrame:
        """The keys of the chunks of these documents or URLs."""
        return S.get_batch(self.store.read("chunks"), keys, key).select("chunk_id")

    def _drop(self, keys: DataFrame, key: str) -> int:
        scratch = S.Scratch(self.spark, "drop")
        gone = scratch.table(S.get_batch(self.store.read("chunks"), keys, key).select("chunk_id", "document_id"), "gone")
        names = gone.select("document_id").distinct()
        n = names.count()
        if n:
            self.store.commit(dead=gone.select("chunk_id").union(names.select(F.concat(F.lit("entry:"), "document_id"))))
        scratch.drop()
        return n

    def delete(self, document_ids: list[str]) -> int:
        """Gives the number of documents that had chunks."""
        return self._drop(self.spark.createDataFrame([(d,) for d in document_ids], "document_id string"), "document_id")

    def clear(self) -> None:
        self.store.commit({name: self.spark.createDataFrame([], schema) for name, schema in S.TABLES.items()}, replace=True)

    def rebuild_lexical(self) -> None:
        """E9."""
        index = lexical.ordered_index(self.store.read("chunks"))
        self.store.commit({"postings": self.store.stage("postings", index.postings, ordered=True)[0], "lengths": index.lengths}, replace=True)

    # reading

    def lexical_index(self) -> lexical.LexicalIndex:
        return lexical.LexicalIndex(self.store.read("postings"), self.store.read("lengths"), lexical.statistics(self.spark, *self.store.size()))

    def search(self, query: str, top_k: int = 10, filters: retrieval.Filters | None = None, embedding: list[float] | None = None, mode: str = "post", explain: bool = False) -> DataFrame:
        if len(query.encode()) > MAX_QUERY_BYTES:
            raise ValueError("the query is too long")
        if embedding is None:
            row = self.spark.range(1).select(F.lit(query).alias("content"))
            embedding = self.embedder(row).first()["embedding"]
        r = self.config.retrieval
        return retrieval.hybrid_search(self.lexical_index(), self.store.read("vectors"), self.store.read("chunks"), query, embedding, top_k, filters, r.candidates, r.rerank, mode, explain, r.rrf_k, r.min_multiplier)

    def answer(self, query: str, top_k: int = 10, **kw) -> tuple[DataFrame, DataFrame]:
        """Grouped results and their citations."""
        groups = retrieval.group_results(self.search(query, top_k, **kw), top_k)
        return groups, retrieval.citations(groups, query)

    def stats(self) -> DataFrame:
        """E10."""
        return self.store.read("chunks").agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))

    def cluster(self, urls: list[str], k: int) -> tuple[DataFrame, DataFrame]:
        if not 1 <= len(urls) <= 1000:
            raise ValueError("from 1 to 1000 URLs")
        return clustering.cluster_documents(self.spark.createDataFrame([(u,) for u in urls], "url string"), self.store.read("chunks"), self.store.read("vectors"), k)

    # crawling

    def discover(self, found: DataFrame, seen: DataFrame, ring: DataFrame | None = None) -> DataFrame:
        """I1 within the configured depth and number of URLs a host."""
        c = self.config.crawl
        return crawl.add_discovered(found.filter(F.col("depth") <= c.max_depth), seen, ring, c.per_domain)

    def delay(self, crawl_delay: Column) -> Column:
        """The seconds between requests to a host."""
        c = self.config.crawl
        return robots.delay_seconds(crawl_delay, c.default_delay, c.min_delay, c.max_delay)

    # advertisements

    def advertise(self, node_id: str, centroids: int = 4) -> None:
        """Publish the k-means centroids of this index as those of a node, in place of its former ones."""
        vectors = self.store.read("vectors").withColumn("node_id", F.lit(node_id))
        ads = routing.advertise_clusters(vectors, centroids, id_col="chunk_id")
        rows = ads.select(F.concat_ws(":", F.lit("ad"), "node_id", "centroid_id").alias("chunk_id"), "node_id", F.col("centroid_id").cast("int").alias("centroid_id"), "centroid", "size", F.current_timestamp().alias("last_updated"))
        self.store.commit({"ads": rows}, dead=self.store.read("ads").filter(F.col("node_id") == node_id).select("chunk_id"))

    def candidates(self, query: list[float], top: int = 5, max_age: int = 3600) -> DataFrame:
        """The nodes to ask, by their fresh advertisements."""
        ads = routing.fresh_ads(self.store.read("ads"), F.current_timestamp(), max_age)
        return routing.find_candidates(ads.select("node_id", "centroid_id", "centroid"), query, top)

    def export(self, path: str, fmt: str = "jsonl") -> None:
        S.export(self.store.read("chunks"), path, fmt)
