"""Crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekmill.functions import urls
from seekmill.operators import routing
from seekmill.sources.store import Scratch


def add_discovered(found: DataFrame, seen: DataFrame, ring: DataFrame | None = None, per_domain: int = 10_000) -> DataFrame:
    """The new URLs of found(url, depth), one for each normalised form, with their host's peer, at most per_domain a host (the least
    deep, then the first). Hosts without an owner stay local (peer NULL)."""
    x = found.withColumn("norm_url", urls.normalize_url(F.col("url"))).join(seen.select("norm_url").distinct(), "norm_url", "left_anti")
    first = x.groupBy("norm_url").agg(F.min_by(F.struct("url", "depth"), F.struct("depth", "url")).alias("p"))
    x = first.select("norm_url", "p.url", "p.depth").withColumn("host", urls.host(F.col("norm_url")))
    w = Window.partitionBy("host").orderBy("depth", "norm_url")
    kept = x.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_domain).drop("_n")
    return routing.assign_domains(kept, ring) if ring is not None else kept.withColumn("peer", F.lit(None).cast("string"))


def with_priority(frontier: DataFrame) -> DataFrame:
    """B20 for frontier(url, depth, inlinks, fresh)."""
    return frontier.withColumn("priority", F.round(urls.priority(F.col("depth"), F.col("inlinks"), F.col("fresh"), urls.is_listing(F.col("url"))), 6))


def pop_next(frontier: DataFrame, domains: DataFrame | None = None, now: Column | None = None, per_host: int = 1, limit: int | None = None) -> DataFrame:
    """For every host that is ready (domains(host, ready_at) says no later, or nothing) its best URLs, by priority, then age, then URL.
    Top-k by host; limit takes the best of all."""
    if domains is not None:
        busy = domains.filter(F.col("ready_at") > (now if now is not None else F.current_timestamp())).select("host")
        frontier = frontier.join(busy, "host", "left_anti")
    w = Window.partitionBy("host").orderBy(F.desc("priority"), "discovered_at", "url")
    best = frontier.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_host).drop("_n")
    return best.orderBy(F.desc("priority"), "discovered_at", "url").limit(limit) if limit else best


def outbound_batches(frontier: DataFrame, size: int = 1000) -> DataFrame:
    """(peer, n, batches): peers for which a full batch waits."""
    return frontier.filter("peer IS NOT NULL").groupBy("peer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= size).withColumn("batches", F.floor(F.col("n") / size))


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int, scratch: Scratch) -> DataFrame:
    """(url, depth) of all that is reached from seeds(url) over links(url, target) in up to max_depth steps: breadth first, a join and an
    anti-join a level, each level written to the shared folder."""
    level = scratch.table(seeds.select("url", F.lit(0).alias("depth")).distinct(), "level0")
    seen = level
    for d in range(1, max_depth + 1):
        found = level.join(links, "url").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        level = scratch.table(found.select("url", F.lit(d).alias("depth")), f"level{d}")
        if not level.take(1):
            break
        seen = seen.unionByName(level)
    return seen


def to_documents(extracted: DataFrame) -> DataFrame:
    """Documents of extracted pages; what is known of a page goes to the metadata map, without empty entries."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("author", "author"), ("published_date", "published"), ("language", "language"), ("word_count", "word_count"), ("reading_time", "reading_time"), ("domain", "domain"), ("aggregator_score", "aggregator_score"))))
    return extracted.select(F.col("url").alias("id"), "content", "title", "url", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("metadata"))
