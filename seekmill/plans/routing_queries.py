"""Routing, merging and quality over whole tables; a node is a label of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.functions import urls
from seekmill.operators import routing, vector
from seekmill.plans import sql as Q
from seekmill.plans.registry import query, table

DIMS = 64


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("node_id"), "embedding")


def _query(spark: SparkSession, sf: str) -> list[float]:
    return list(table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def _lsh_sql() -> str:
    """Signatures with the planes written out as data."""
    planes = ", ".join(f"({i}, {[float(x) for x in row]})" for i, row in enumerate(vector.plane_matrix(DIMS)))
    word = lambda n: f"sum(CASE WHEN p < {64 * n} OR p >= {64 * n + 64} OR NOT up THEN 0::HUGEINT WHEN p = {64 * n} THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << ({64 * n + 63} - p)::INT END)::BIGINT"
    return f"WITH planes(p, w) AS (VALUES {planes}), s AS (SELECT vec_id, p, list_inner_product(embedding::DOUBLE[], w) > 0 AS up FROM embeddings, planes) SELECT vec_id, [{word(0)}, {word(1)}] AS signature FROM s GROUP BY 1"


@query("g1_lsh_signature", _lsh_sql())
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return vector.lsh_signature(_vectors(spark, sf), DIMS).select("vec_id", "signature")


def _hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures that SQL has as well: two words of the md5 of a document."""
    word = lambda at: F.conv(F.substring(F.md5("text"), at, 16), 16, -10).cast("bigint")
    return table(spark, sf, "documents").select("doc_id", "source", F.array(word(1), word(17)).alias("signature"))


HEX = "SELECT doc_id, source, md5(text) AS m FROM documents"


@query(
    "g2_signature_similarity",
    f"WITH h AS ({HEX}), f AS (SELECT arg_min(m, doc_id) AS f FROM h) SELECT doc_id, d::INT AS distance, round(1 - d / 128.0, 6) AS similarity FROM (SELECT doc_id, bit_count(xor(('0x' || left(m, 16))::UBIGINT, ('0x' || left(f, 16))::UBIGINT)) + bit_count(xor(('0x' || right(m, 16))::UBIGINT, ('0x' || right(f, 16))::UBIGINT)) AS d FROM h, f)",
)
def g2(spark: SparkSession, sf: str) -> DataFrame:
    h = _hashes(spark, sf)
    first = h.agg(F.min_by("signature", "doc_id").alias("f"))
    both = h.crossJoin(F.broadcast(first))  # one row
    return both.select("doc_id", vector.signature_distance(F.col("signature"), F.col("f")).cast("int").alias("distance"), F.round(vector.signature_similarity(F.col("signature"), F.col("f")), 6).alias("similarity"))


@query(
    "g3_bloom_filters",
    f"""WITH b AS (SELECT DISTINCT source, i AS band, substr(m, (i * 4 + 1)::INT, 4) AS key FROM ({HEX}), range(8) t(i)), n AS (SELECT source, count(*) AS items FROM b GROUP BY 1)
    SELECT source, items, (16 + ceil(greatest(8, ceil(items * -ln(0.01) / pow(ln(2), 2))) / 8))::INT AS bytes FROM n""",
)
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return routing.bloom_filters(routing.band_index(_hashes(spark, sf), "source"), "source").select("source", "items", F.octet_length("bloom").alias("bytes"))


@query(
    "g4_matching_bands",
    f"WITH b AS (SELECT doc_id, source, i AS band, substr(m, (i * 4 + 1)::INT, 4) AS key FROM ({HEX}), range(8) t(i)) SELECT q.doc_id AS query_id, b.source, count(DISTINCT b.band) AS bands FROM b q JOIN (SELECT DISTINCT source, band, key FROM b) b USING (band, key) GROUP BY 1, 2",
)
def g4(spark: SparkSession, sf: str) -> DataFrame:
    h = _hashes(spark, sf)
    return routing.matching_bands(routing.band_index(h, "source"), h.select(F.col("doc_id").alias("query_id"), "signature"), "source")


ADS = f"""avgs AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding[1:32])::DOUBLE AS x, generate_subscripts(embedding[1:32], 1) AS i FROM embeddings) GROUP BY 1, 2),
    ads AS (SELECT label AS node_id, {Q.unit("v")} AS c FROM (SELECT label, list(m ORDER BY i) AS v FROM avgs GROUP BY 1)), q AS (SELECT embedding[1:32] AS e FROM embeddings ORDER BY vec_id LIMIT 1),
    cand AS (SELECT node_id, round(greatest(0, {Q.cosine("c", "e")}), 6) AS similarity FROM ads, q ORDER BY similarity DESC, node_id LIMIT 5)"""


@query("g5_advertise", f"WITH {ADS} SELECT node_id, list_transform(c, lambda x: CASE WHEN round(x, 5) = 0 THEN 0 ELSE round(x, 5) END) AS centroid, (SELECT count(*) FROM embeddings WHERE label = node_id) AS size FROM ads")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return routing.advertise(_vectors(spark, sf), 32).select("node_id", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"), "size")


@query("g6_find_candidates", f"WITH {ADS} SELECT node_id, similarity, CASE WHEN similarity > 0.5 THEN [0] ELSE [] END AS centroids FROM cand")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return routing.find_candidates(routing.advertise(_vectors(spark, sf), 32), _query(spark, sf))


@query(
    "g6_bloom_rejection",
    f"WITH b AS (SELECT doc_id, source, i AS band, substr(m, (i * 4 + 1)::INT, 4) AS key FROM ({HEX}), range(8) t(i)), q AS (SELECT * FROM b WHERE doc_id % 50 = 0) SELECT DISTINCT q.doc_id AS query_id, b.source FROM q JOIN b USING (band, key)",
)
def g6_bloom(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes whose Bloom filters let the signature of every 50th document pass, less those that their exact bands rule out (false positives, one in a thousand or fewer)."""
    h = _hashes(spark, sf)
    index = routing.band_index(h, "source")
    asked = h.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "signature")
    passed = routing.bloom_candidates(routing.bloom_filters(index, "source", 1e-4), asked, "source")
    exact = routing.matching_bands(index, asked, "source")
    assert_none_lost = exact.join(passed, ["query_id", "source"], "left_anti").withColumn("query_id", F.lit(-1).cast("bigint"))  # a false negative would show
    return passed.join(exact.select("query_id", "source"), ["query_id", "source"], "left_semi").unionByName(assert_none_lost.select("query_id", "source"))


@query("g5_centroids", "SELECT label AS node_id, count(*) AS size, least(count(*), 4) AS centroids, true AS normal FROM embeddings GROUP BY 1")
def g5_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Advertisements of up to four k-means centroids a node."""
    ads = routing.advertise_clusters(_vectors(spark, sf), 4, 32)
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    return ads.groupBy("node_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("centroids"), F.min(F.abs(length - 1) < 1e-6).alias("normal"))


@query("g7_upsert_ads", "SELECT label AS node_id, CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END AS version FROM (SELECT DISTINCT label FROM embeddings)")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    ads = table(spark, sf, "embeddings").select(F.col("label").alias("node_id"), F.lit(1).alias("version")).distinct()
    return routing.upsert_ads(ads, ads.filter("node_id % 2 = 0").withColumn("version", F.lit(2)))


SCORES = f"scores AS (SELECT label AS node_id, vec_id % 200 AS chunk_id, round(greatest(0, {Q.cosine('embedding', 'e')}), 6) AS score FROM embeddings, (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1))"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    from seekmill.functions import text as T

    v = _vectors(spark, sf)
    q = F.lit([float(x) for x in _query(spark, sf)])
    return v.select("node_id", (F.col("vec_id") % 200).alias("chunk_id"), F.round(F.greatest(F.lit(0.0), T.cosine(F.col("embedding"), q)), 6).alias("score"))


@query("g8_merge_results", f"WITH {SCORES} SELECT chunk_id, arg_min(node_id, [-score, node_id]) AS node_id, max(score) AS score FROM scores GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 10")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    return routing.merge_results(_scores(spark, sf), 10)


QUALITY = f"""WITH {SCORES}, {ADS}, top AS (SELECT chunk_id, max(score) AS score FROM scores GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 10),
    r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, node_id) AS k, node_id % 2 = 0 AS got FROM cand),
    c AS (SELECT (count(*) FILTER (got) / count(*) + coalesce(sum(1 / k) FILTER (got), 0) / sum(1 / k)) / 2 AS coverage, count(*) AS nc FROM r),
    s AS (SELECT avg(score) AS average, CASE WHEN count(*) = 1 THEN 1 ELSE greatest(0, least(1, 1 - stddev_pop(score) / avg(score))) END AS confidence, count(*) AS n FROM top)
    SELECT round(coverage, 6) AS coverage, round(average, 6) AS average, round(confidence, 6) AS confidence, least(1.0::DOUBLE, n / nc) AS sufficiency, round(0.3::DOUBLE * coverage + 0.3::DOUBLE * average + 0.2::DOUBLE * confidence + 0.2::DOUBLE * least(1.0::DOUBLE, n / nc), 6) AS quality, n AS n_results FROM c, s"""


@query("g9_quality", QUALITY)
def g9(spark: SparkSession, sf: str) -> DataFrame:
    c = g6(spark, sf)
    return routing.quality(g8(spark, sf), c, c.filter("node_id % 2 = 0").select("node_id"))


@query("g10_widen", f"SELECT quality < 0.5 OR n_results < 3 OR average < 0.3 AS widen FROM ({QUALITY})")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return routing.widen(g9(spark, sf)).select("widen")


@query(
    "g10_adaptive_search",
    f"""WITH {SCORES}, {ADS}, head AS (SELECT chunk_id, max(score) AS score FROM scores SEMI JOIN cand USING (node_id) GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 10),
    v AS (SELECT avg(score) AS a, count(*) AS n, CASE WHEN count(*) = 1 THEN 1 ELSE greatest(0, least(1, 1 - stddev_pop(score) / avg(score))) END AS c FROM head),
    asked AS (SELECT node_id FROM cand UNION SELECT node_id FROM ads, v WHERE v.a < 0.3 OR v.n < 3 OR 0.3 + 0.3 * v.a + 0.2 * v.c + 0.2 * least(1, v.n / 5) < 0.5)
    SELECT chunk_id, arg_min(node_id, [-score, node_id]) AS node_id, max(score) AS score FROM scores SEMI JOIN asked USING (node_id) GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 10""",
)
def g10_search(spark: SparkSession, sf: str) -> DataFrame:
    return routing.adaptive_search(_scores(spark, sf), routing.advertise(_vectors(spark, sf), 32), _query(spark, sf), F.col("score"))


@query(
    "g11_domain_assignment",
    f"""WITH ring AS (SELECT n_name AS peer, ('0x' || substr(sha256('peer:' || n_name || ':' || i), 1, 15))::BIGINT AS pos FROM nation, range(150) t(i)),
    h AS (SELECT DISTINCT {Q.host("url")} AS host FROM pages), k AS (SELECT host, ('0x' || substr(sha256(host), 1, 15))::BIGINT AS key FROM h)
    SELECT host, coalesce(r.peer, (SELECT arg_min(peer, pos) FROM ring)) AS peer FROM k ASOF LEFT JOIN ring r ON k.key <= r.pos""",
)
def g11(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host")).distinct()
    return routing.assign_domains(hosts, routing.ring(table(spark, sf, "nation").select(F.col("n_name").alias("peer"))))


@query("g12_fresh_ads", "SELECT user_id AS node_id, max(ts) AS last_updated FROM events GROUP BY 1 HAVING epoch((SELECT max(ts) FROM events)::TIMESTAMP) // 1 - epoch(max(ts)::TIMESTAMP) // 1 <= 86400")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ads = e.groupBy(F.col("user_id").alias("node_id")).agg(F.max("ts").alias("last_updated"))
    now = e.agg(F.max("ts").cast("timestamp").alias("now"))  # one row
    ads = ads.withColumn("last_updated", F.col("last_updated").cast("timestamp")).crossJoin(F.broadcast(now))
    fresh = routing.fresh_ads(ads, F.col("now"), 86400)
    return fresh.select("node_id", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@query("g12_first_responses", "SELECT user_id AS request_id, event_type AS node_id, arg_min(event_id, [epoch_us(ts), event_id]) AS response_id FROM events WHERE event_type <> 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY 1, 2")
def g12_responses(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("node_id"), F.col("ts").alias("received_at"), F.col("event_id").alias("response_id"))
    asked = e.filter("node_id = 'click'").select("request_id").distinct()
    peers = e.select("node_id").distinct().filter("node_id <> 'view'")
    return routing.first_responses(e, asked.crossJoin(peers)).select("request_id", "node_id", "response_id")
