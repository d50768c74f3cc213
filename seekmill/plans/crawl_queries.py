"""Frontier and politeness over whole tables. Links between pages follow from their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.functions import html, robots, urls
from seekmill.operators import crawl, routing
from seekmill.plans import sql as Q
from seekmill.plans.registry import query, table
from seekmill.sources.store import Scratch
from seekmill.streaming import ingest


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 4).alias("depth"))


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").filter("page_id % 5 = 0").select(urls.normalize_url(F.col("url")).alias("norm_url"))


NEW = f"""found AS (SELECT page_id, url, page_id % 4 AS depth, {Q.norm_url("url")} AS norm_url FROM pages),
    new AS (SELECT norm_url, min(depth) AS depth FROM found WHERE norm_url NOT IN (SELECT norm_url FROM found WHERE page_id % 5 = 0) GROUP BY 1),
    capped AS (SELECT norm_url, depth, {Q.host("norm_url")} AS host, row_number() OVER (PARTITION BY {Q.host("norm_url")} ORDER BY depth, norm_url) AS n FROM new QUALIFY n <= 10000)"""


@query(
    "i1_add_discovered",
    f"""WITH {NEW}, ring AS (SELECT n_name AS peer, ('0x' || substr(sha256('peer:' || n_name || ':' || i), 1, 15))::BIGINT AS pos FROM nation, range(150) t(i)),
    k AS (SELECT *, ('0x' || substr(sha256(host), 1, 15))::BIGINT AS key FROM capped)
    SELECT norm_url, depth, host, coalesce(r.peer, (SELECT arg_min(peer, pos) FROM ring)) AS peer FROM k ASOF LEFT JOIN ring r ON k.key <= r.pos""",
)
def i1(spark: SparkSession, sf: str) -> DataFrame:
    ring = routing.ring(table(spark, sf, "nation").select(F.col("n_name").alias("peer")))
    return crawl.add_discovered(_found(spark, sf), _seen(spark, sf), ring).select("norm_url", "depth", "host", "peer")


def _frontier(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    f = table(spark, sf, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"), (i % 4).alias("depth"), (i % 13).alias("inlinks"), (i % 2 == 0).alias("fresh"), F.timestamp_seconds(F.lit(1_700_000_000) + i).alias("discovered_at"))
    return crawl.with_priority(f)


POP = f"""f AS (SELECT page_id, url, {Q.host("url")} AS host, round(1.2::DOUBLE - 0.1::DOUBLE * (page_id % 4) + 0.2::DOUBLE * least(page_id % 13, 10) + CASE WHEN page_id % 2 = 0 THEN 0.5 ELSE 0 END - CASE WHEN {Q.listing("url")} THEN 0.5 ELSE 0 END, 6) AS priority FROM pages)"""


@query("i2_pop_next", f"WITH {POP} SELECT page_id, host, priority FROM f WHERE host NOT LIKE 'm.%' QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id, url) = 1")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    """The next URL of every ready host."""
    f = _frontier(spark, sf)
    busy = f.select("host").distinct().filter("host LIKE 'm.%'").withColumn("ready_at", F.lit("2030-01-01").cast("timestamp"))
    return crawl.pop_next(f, busy, F.lit("2025-01-01").cast("timestamp")).select("page_id", "host", "priority")


@query("i2_pop_best", f"WITH {POP}, one AS (SELECT page_id, url, priority FROM f QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id, url) = 1) SELECT page_id, priority FROM one ORDER BY priority DESC, page_id LIMIT 10")
def i2_best(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.pop_next(_frontier(spark, sf), limit=10).select("page_id", "priority")


@query("i3_outbound_batches", f"WITH {POP} SELECT host AS peer, count(*) AS n, count(*) // 5 AS batches FROM f GROUP BY 1 HAVING count(*) >= 5")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.outbound_batches(_frontier(spark, sf).withColumnRenamed("host", "peer"), 5)


@query("i4_url_filter", rf"SELECT page_id FROM pages WHERE {Q.host('url')} LIKE '%.example.com' AND {Q.host('url')} LIKE 'th%' AND NOT regexp_matches(url, '.pdf') AND NOT regexp_matches(url, '\?page=') AND (regexp_matches(url, '/en/') OR regexp_matches(url, '/fr/'))")
def i4(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    hosts = [r.h for r in p.select(urls.host(F.col("url")).alias("h")).distinct().filter("h LIKE 'th%' AND h LIKE '%.example.com'").collect()]  # seeds: a few names
    return p.filter(urls.url_allowed(F.col("url"), hosts, exclude=(".pdf", r"\?page="), include=("/en/", "/fr/"))).select("page_id")


def _like(p: str) -> str:
    body = p.rstrip("$").replace(".", "\\.").replace("*", ".*")
    return f"CASE WHEN regexp_matches({Q.path('url')}, '^{body}{'$' if p.endswith('$') else ''}') THEN {len(p)} ELSE 0 END"


ALLOW, DISALLOW = ("/en", "/fr/8", "/*.html$"), ("/", "/fr/", "/de/*5", "/en/6")


@query("i5_robots_decision", f"SELECT page_id, {Q.host('url')} NOT LIKE '%.com' OR greatest({', '.join(map(_like, ALLOW))}) >= greatest({', '.join(map(_like, DISALLOW))}) AS allowed FROM pages")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    rules = p.select(urls.host(F.col("url")).alias("host")).distinct().filter("host LIKE '%.com'").select("host", F.lit(list(ALLOW)).alias("allow"), F.lit(list(DISALLOW)).alias("disallow"))
    return robots.allowed(p.select("page_id", "url"), rules).select("page_id", "allowed")


@query(
    "i6_delays",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE greatest(0.5, least(30.0, event_id % 50)) END::DOUBLE AS delay, least(30.0 * pow(2, least(1 + event_id % 6, 4) - 1), 600.0)::DOUBLE AS backoff,
    CASE WHEN event_id % 5 = 0 THEN 'rate_limited' WHEN value < CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE greatest(0.5, least(30.0, event_id % 50)) END THEN 'wait' ELSE 'allowed' END AS decision FROM events""",
)
def i6(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    delay = robots.delay_seconds(F.when(i % 7 != 0, (i % 50).cast("double")))
    left = F.when(i % 5 == 0, 3.0)
    return table(spark, sf, "events").select("event_id", delay.alias("delay"), robots.backoff_seconds(1 + i % 6).alias("backoff"), robots.fetch_decision(F.col("value"), delay, left).alias("decision"))


@query(
    "i6_rate_limit_log",
    "SELECT request_id, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host ORDER BY ts, request_id) >= 3600000000, true) THEN 'allowed' ELSE 'wait' END AS decision FROM (SELECT event_id AS request_id, user_id::VARCHAR AS host, ts FROM events)",
)
def i6_log(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("host"), "ts")
    return ingest.politeness(r, 3600.0).select("request_id", "decision")


@query("i7_ready_domains", f"SELECT {Q.host('url')} AS host, count(*) AS n FROM pages WHERE {Q.host('url')} NOT LIKE 'm.%' GROUP BY 1")
def i7(spark: SparkSession, sf: str) -> DataFrame:
    f = _frontier(spark, sf)
    busy = f.select("host").distinct().filter("host LIKE 'm.%'").withColumn("ready_at", F.lit("2030-01-01").cast("timestamp"))
    ready = crawl.pop_next(f, busy, F.lit("2025-01-01").cast("timestamp"), per_host=1 << 30)
    return ready.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("i8_process_pages")
def i8(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched pages that robots.txt allows, extracted, as documents."""
    p = table(spark, sf, "pages")
    rules = p.select(urls.host(F.col("url")).alias("host")).distinct().select("host", F.lit(["/en"]).alias("allow"), F.lit(["/fr/"]).alias("disallow"))
    ok = robots.allowed(p, rules).filter("allowed").drop("allowed")
    return crawl.to_documents(html.extract_pages(ok)).select("id", "title", F.octet_length("content").alias("bytes"), F.to_json("metadata").alias("metadata"))


@query(
    "i9_crawl",
    """WITH RECURSIVE l AS (SELECT page_id::VARCHAR AS url, unnest([page_id * 2, page_id * 2 + 1, page_id * 3])::VARCHAR AS target FROM pages),
    walk AS (SELECT '1' AS url, 0 AS depth UNION SELECT l.target, depth + 1 FROM walk JOIN l USING (url) WHERE depth < 5) SELECT url, min(depth) AS depth FROM walk GROUP BY 1""",
)
def i9(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    links = table(spark, sf, "pages").select(i.cast("string").alias("url"), F.explode(F.array(i * 2, i * 2 + 1, i * 3).cast("array<string>")).alias("target"))
    return crawl.crawl(spark.createDataFrame([("1",)], "url string"), links, 5, Scratch(spark, "crawl"))


@query("i10_documents", f"SELECT url AS id, to_json({{'language': 'xx', 'word_count': page_id::VARCHAR, 'domain': {Q.host('url')}}}) AS metadata FROM pages")
def i10(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    x = table(spark, sf, "pages").select("url", F.col("html").alias("content"), F.lit("t").alias("title"), none.alias("author"), none.alias("published"), F.lit("xx").alias("language"), F.col("page_id").alias("word_count"), none.alias("reading_time"), urls.host(F.col("url")).alias("domain"), none.alias("aggregator_score"))
    return crawl.to_documents(x).select("id", F.to_json("metadata").alias("metadata"))
