"""Distributed query: advertisements, routing, merge and quality. A node is a partition value, node_id."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekmill.functions import text as T

BANDS = 8


@dataclass
class Bloom:
    """A Bloom filter of XXH3 hashes (double hashing); serialised with its size, hash count and item count in a 16-byte head."""

    bits: np.ndarray
    k: int
    n: int = 0

    @classmethod
    def sized(cls, items: int, rate: float = 0.01) -> Bloom:
        m = max(8, math.ceil(-max(items, 1) * math.log(rate) / math.log(2) ** 2))
        return cls(np.zeros(m, bool), min(16, max(1, round(m / max(items, 1) * math.log(2)))))

    def _places(self, item: bytes) -> list[int]:
        import xxhash

        return [xxhash.xxh3_64_intdigest(item, seed=i) % len(self.bits) for i in range(self.k)]

    def add(self, item: bytes) -> None:
        self.bits[self._places(item)] = True
        self.n += 1

    def __contains__(self, item: bytes) -> bool:
        return bool(self.bits[self._places(item)].all())

    def to_bytes(self) -> bytes:
        return len(self.bits).to_bytes(8, "little") + self.k.to_bytes(4, "little") + self.n.to_bytes(4, "little") + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bloom:
        m = int.from_bytes(raw[:8], "little")
        return cls(np.unpackbits(np.frombuffer(raw[16:], np.uint8))[:m].astype(bool), int.from_bytes(raw[8:12], "little"), int.from_bytes(raw[12:16], "little"))


def band_keys(signature: Column, bands: int = BANDS) -> Column:
    """array<struct<band, key>> of a 128-bit signature: 16 bits a band."""
    per = bands // 2
    width = 64 // per
    return F.array(*(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(signature[b // per], 64 - width * (b % per + 1)).bitwiseAND((1 << width) - 1).alias("key")) for b in range(bands)))


def band_index(signatures: DataFrame, group_col: str = "node_id") -> DataFrame:
    """(node, band, key): the exact set a banded Bloom filter approximates; no false positives, nor negatives."""
    return signatures.select(group_col, F.inline(band_keys(F.col("signature")))).distinct()


def matching_bands(index: DataFrame, query: DataFrame, group_col: str = "node_id") -> DataFrame:
    """(query_id, node, bands): in how many bands a node holds a signature like the query's; no row without any."""
    q = query.select("query_id", F.inline(band_keys(F.col("signature"))))
    return q.join(index, ["band", "key"]).groupBy("query_id", group_col).agg(F.count_distinct("band").alias("bands"))


def bloom_filters(index: DataFrame, group_col: str = "node_id", rate: float = 0.01) -> DataFrame:
    """(node, bloom BINARY, items) of every node's band keys."""
    kind = index.schema[group_col].dataType.simpleString()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Bloom.sized(len(pdf), rate)
        for band, key in zip(pdf["band"], pdf["key"]):
            f.add(int(band).to_bytes(1, "little") + int(key).to_bytes(8, "little"))
        return pd.DataFrame({group_col: [pdf[group_col].iloc[0]], "bloom": [f.to_bytes()], "items": [len(pdf)]})

    return index.groupBy(group_col).applyInPandas(build, f"{group_col} {kind}, bloom binary, items bigint")


def bloom_candidates(filters: DataFrame, queries: DataFrame, group_col: str = "node_id") -> DataFrame:
    """(query_id, node) of nodes whose filter holds any band key of the query(query_id, signature); the others are rejected unasked.
    Filters, one a node, go to the blocks of queries; each is opened once a block."""
    kind, qkind = filters.schema[group_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    keys = queries.select("query_id", F.transform(band_keys(F.col("signature")), lambda k: k["key"]).alias("keys"))
    blocks = keys.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("block")).agg(F.collect_list("query_id").alias("ids"), F.collect_list("keys").alias("keys"))
    spread = filters.select(F.col(group_col).alias("node"), "bloom", F.explode(F.expr("sequence(0L, 63L)")).alias("block"))

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                f = Bloom.from_bytes(row.bloom)
                hits = [q for q, ks in zip(row.ids, row.keys) if any(b.to_bytes(1, "little") + int(k).to_bytes(8, "little") in f for b, k in enumerate(ks))]
                if hits:
                    yield pd.DataFrame({"query_id": hits, group_col: pd.Series([row.node] * len(hits), dtype=object)})

    return spread.join(blocks.hint("merge"), "block").select("node", "bloom", "ids", "keys").mapInPandas(run, f"query_id {qkind}, {group_col} {kind}")


def advertise_clusters(vectors: DataFrame, k: int = 4, dims: int | None = None, steps: int = 5, node_col: str = "node_id", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(node_id, centroid_id, centroid, size): up to k k-means centroids a node. The first centroids are the node's vectors with the smallest
    hashes of their ids; each step assigns by cosine and takes the means, which are few and written to the shared folder."""
    from seekmill.sources.store import Scratch

    scratch = Scratch(vectors.sparkSession, "ads")
    v = F.slice(vec_col, 1, dims) if dims else F.col(vec_col)
    x = vectors.select(F.col(node_col).alias("node_id"), F.col(id_col).alias("_id"), T.unit(v).alias("embedding"))
    w = Window.partitionBy("node_id").orderBy("_h", "_id")
    ads = x.withColumn("_h", F.xxhash64("_id")).withColumn("centroid_id", F.row_number().over(w) - 1).filter(F.col("centroid_id") < k).select("node_id", "centroid_id", F.col("embedding").alias("centroid"))
    ads = scratch.table(ads, "centroids0")
    for n in range(1, steps + 1):
        near = x.join(ads, "node_id").groupBy("node_id", "_id").agg(F.max_by(F.struct("centroid_id", "embedding"), F.struct(T.dot(F.col("embedding"), F.col("centroid")), -F.col("centroid_id"))).alias("b"))
        means = advertise(near.select("node_id", F.col("b.centroid_id").alias("c"), F.col("b.embedding").alias("embedding")), None, "node_id", "c")
        # a centroid without vectors stays where it was
        kept = ads.join(means.select("node_id", "centroid_id"), ["node_id", "centroid_id"], "left_anti").withColumn("size", F.lit(0).cast("bigint"))
        ads = scratch.table(means.unionByName(kept.select(*means.columns)), f"centroids{n}")
        scratch.drop(f"centroids{n - 1}")
    return ads


def advertise(vectors: DataFrame, dims: int | None = None, node_col: str = "node_id", centroid_col: str | None = None, vec_col: str = "embedding") -> DataFrame:
    """(node_id, centroid_id, centroid, size): normalised means of a node's vectors by centroid_col (of all without one), cut to dims."""
    c = F.col(centroid_col) if centroid_col else F.lit(0)
    v = F.slice(vec_col, 1, dims) if dims else F.col(vec_col)
    keyed = vectors.select(F.col(node_col).alias("node_id"), c.alias("centroid_id"), F.posexplode(v).alias("i", "x"))
    means = keyed.groupBy("node_id", "centroid_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    grouped = means.groupBy("node_id", "centroid_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"), F.max("n").alias("size"))
    return grouped.select("node_id", "centroid_id", T.unit(F.transform("p", lambda x: x["m"])).alias("centroid"), "size")


def find_candidates(ads: DataFrame, query: list[float], top: int = 5, threshold: float = 0.5, allowed: DataFrame | None = None) -> DataFrame:
    """(node_id, similarity, centroids): the top nodes by their best centroid's cosine (0 at least; vectors are cut to the shorter
    length), with the ids of centroids above threshold. allowed: nodes that a band prefilter lets pass."""
    if allowed is not None:
        ads = ads.join(allowed.select("node_id").distinct(), "node_id", "left_semi")
    q = F.lit([float(x) for x in query])
    n = F.least(F.size("centroid"), F.lit(len(query)))
    sim = F.greatest(F.lit(0.0), T.cosine(F.slice("centroid", F.lit(1), n), F.slice(q, F.lit(1), n)))
    per = ads.select("node_id", "centroid_id", sim.alias("s"))
    best = per.groupBy("node_id").agg(F.round(F.max("s"), 6).alias("similarity"), F.array_sort(F.collect_list(F.when(F.col("s") > threshold, F.col("centroid_id")))).alias("centroids"))
    return best.orderBy(F.desc("similarity"), "node_id").limit(top)


def upsert_ads(ads: DataFrame, new: DataFrame) -> DataFrame:
    """A node's new advertisement replaces its old one."""
    return ads.join(new.select("node_id").distinct(), "node_id", "left_anti").unionByName(new)


def fresh_ads(ads: DataFrame, now: Column, max_age: int = 3600) -> DataFrame:
    """Without advertisements older than max_age seconds."""
    return ads.filter(F.unix_timestamp(now) - F.unix_timestamp("last_updated") <= max_age)


def merge_results(results: DataFrame, top_k: int = 10) -> DataFrame:
    """The best score of every chunk over nodes (ties: the first node id), cut to top_k."""
    best = results.groupBy("chunk_id").agg(F.min_by(F.struct("node_id", "score"), F.struct((-F.col("score")).alias("n"), "node_id")).alias("b"))
    return best.select("chunk_id", "b.node_id", "b.score").orderBy(F.desc("score"), "chunk_id").limit(top_k)


def first_responses(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of every expected peer's responses to a request the first; unexpected peers' don't count."""
    known = responses.join(candidates.select("request_id", "node_id").distinct(), ["request_id", "node_id"], "left_semi")
    w = Window.partitionBy("request_id", "node_id").orderBy("received_at", "response_id")
    return known.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def quality(results: DataFrame, candidates: DataFrame, responded: DataFrame, expected: int | None = None) -> DataFrame:
    """One row (coverage, average, confidence, sufficiency, quality): how good an answer is. candidates(node_id, similarity) are
    ranked by similarity, responded(node_id) are those that answered."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "node_id")))  # the few candidates of a query
    c = ranked.join(responded.select("node_id", F.lit(1).alias("got")), "node_id", "left")
    cov = c.agg(F.count(F.lit(1)).alias("n_c"), F.sum(F.coalesce("got", F.lit(0))).alias("n_r"), F.sum(F.when(F.col("got") == 1, 1 / F.col("rank"))).alias("w_r"), F.sum(1 / F.col("rank")).alias("w"))
    res = results.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    one = res.crossJoin(cov)
    coverage = F.when(F.col("n_c") == 0, 1.0).otherwise((F.col("n_r") / F.col("n_c") + F.coalesce("w_r", F.lit(0.0)) / F.col("w")) / 2)
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    confidence = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, 1.0).when(F.col("mean") > 0, clamp(1 - F.col("sd") / F.col("mean"))).otherwise(0.0)
    sufficiency = F.lit(1.0) if expected == 0 else clamp(F.col("n") / F.greatest(F.lit(expected).cast("double") if expected else F.col("n_c").cast("double"), F.lit(1.0)))
    parts = one.select(coverage.alias("coverage"), F.coalesce("mean", F.lit(0.0)).alias("average"), confidence.alias("confidence"), sufficiency.alias("sufficiency"), "n")
    total = 0.3 * F.col("coverage") + 0.3 * F.col("average") + 0.2 * F.col("confidence") + 0.2 * F.col("sufficiency")
    r = lambda x: F.round(x, 6)
    return parts.select(*(r(F.col(x)).alias(x) for x in ("coverage", "average", "confidence", "sufficiency")), r(total).alias("quality"), F.col("n").alias("n_results"))


def widen(quality_row: DataFrame, min_quality: float = 0.5, min_results: int = 3, min_average: float = 0.3) -> DataFrame:
    """Whether a second round is to ask further nodes."""
    return quality_row.withColumn("widen", (F.col("quality") < min_quality) | (F.col("n_results") < min_results) | (F.col("average") < min_average))


def adaptive_search(shards: DataFrame, ads: DataFrame, query: list[float], score: Column, top_k: int = 10, first: int = 5, second: int = 10) -> DataFrame:
    """Search the best nodes' shards(node_id, chunk_id, ...), and up to `second` further nodes if the answer is poor. The node list
    prunes partitions, so only the nodes asked are read."""
    ranked = [r.node_id for r in find_candidates(ads, query, first + second).collect()]  # at most 15 rows
    ask = lambda nodes: merge_results(shards.filter(F.col("node_id").isin(nodes)).select("node_id", "chunk_id", score.alias("score")), top_k)
    got, head = ask(ranked[:first]), ranked[:first]
    c = find_candidates(ads, query, first)
    verdict = widen(quality(got, c, c.select("node_id"))).first()
    return ask(ranked) if verdict.widen and ranked[first:] else ask(head)


# the domain ring


def ring_hash(text: Column) -> Column:
    """The first 60 bits of the SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def ring(peers: DataFrame, vnodes: int = 150) -> DataFrame:
    """(peer, pos) of every virtual node. Joining or leaving is a row more or less in peers."""
    keyed = peers.select("peer", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    return keyed.select("peer", ring_hash(F.concat_ws(":", F.lit("peer"), F.col("peer"), F.col("i").cast("string"))).alias("pos"))


def assign_domains(hosts: DataFrame, ring_: DataFrame, host_col: str = "host") -> DataFrame:
    """Hosts with their peer: the first virtual node at or after the host's hash, else the first of all. The ring (vnodes times
    peers) is one sorted array row; each host finds its place by binary search in the array, without a shuffle."""
    packed = ring_.agg(F.array_sort(F.collect_list(F.struct("pos", "peer"))).alias("r"))
    own = hosts.withColumn("_h", ring_hash(F.col(host_col))).crossJoin(F.broadcast(packed))  # one row of vnodes * peers entries
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0).alias("lo"), F.size("r").alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.col("r")[F.floor((s["lo"] + s["hi"]) / 2).cast("int")]["pos"] < F.col("_h"), F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))),
        lambda s: s["lo"],
    )
    return own.withColumn("_at", found).withColumn("peer", F.when(F.size("r") > 0, F.get("r", F.col("_at") % F.greatest(F.size("r"), F.lit(1)))["peer"])).drop("_h", "_at", "r")
