"""Exact and near duplicates by SimHash, and the document registry.

Equal SimHashes are one node before any join, so copies never pair up with one another. Two hashes that differ in at most t
of 64 bits agree on at least CHOOSE of t + CHOOSE blocks; the join keys are therefore all choices of CHOOSE blocks: exact, as is a join
on 8 bands of 8 bits for t <= 7, but with keys of 32 bits at t = 3 and not of 8, which at billions of documents decides between
a few candidates and millions. Beyond a threshold of 5 the keys are of two blocks, 10 bits at t = 10, so that candidates grow with the square of
the different hashes divided by 2 ** 10: exact, and meant for the reference's scales, not for billions. Those are compared as arrays of numbers, without a row for each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekmill.functions import identity, urls
from seekmill.sources.store import Scratch

THRESHOLD = 3
CHOOSE = 3
MIN_BYTES = 100


def with_identity(docs: DataFrame, text_col: str = "text", hash_name: str = "md5") -> DataFrame:
    """docs with content_hash and simhash."""
    return docs.withColumns({"content_hash": identity.content_hash(F.col(text_col)), "simhash": identity.simhash(F.col(text_col), hash_name)})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", hash_col: str = "content_hash") -> DataFrame:
    """(id, first_id): every document whose normalised text an earlier one has. One aggregate and one join, no window
    over all copies of a text."""
    docs = Scratch(docs.sparkSession, "exact").table(docs.select(id_col, hash_col), "hashes")  # or both sides would hash the texts
    first = docs.groupBy(hash_col).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return docs.select(id_col, hash_col).join(first, hash_col).filter(F.col(id_col) > F.col("first_id")).select(id_col, "first_id")


def block_masks(threshold: int) -> list[int]:
    """The bits of every choice of blocks, as signed 64-bit masks."""
    choose = CHOOSE if threshold <= 5 else CHOOSE - 1  # no more than about 60 keys a hash, up to a threshold of 9
    n = threshold + choose
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice) for choice in itertools.combinations(range(n), choose)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distinct(nodes: DataFrame, sim_col: str) -> DataFrame:
    """The distinct hashes, written: both sides of a self-join would compute the hashes' UDF again."""
    return Scratch(nodes.sparkSession, "simhash").table(nodes.select(sim_col).distinct(), "nodes")


def _keyed(nodes: DataFrame, masks: list[int], sim_col: str) -> DataFrame:
    """(s, c, key): every hash under every mask."""
    return _distinct(nodes, sim_col).filter(F.col(sim_col).isNotNull()).select(F.col(sim_col).alias("s"), F.posexplode(F.transform(F.lit(masks), lambda m: F.col(sim_col).bitwiseAND(m))).alias("c", "key"))


def near_pairs(nodes: DataFrame, threshold: int = THRESHOLD, sim_col: str = "simhash") -> DataFrame:
    """(a, b, distance) of distinct hashes a < b that differ in 1 to threshold bits."""
    masks = block_masks(threshold)
    if threshold > 5:
        return _agreeing(nodes, masks, threshold, sim_col)
    keyed = _keyed(nodes, masks, sim_col)
    # planned by the size of the hashes' file it would be a broadcast, of a row for every key
    a, b = keyed.alias("a"), keyed.hint("merge").alias("b")
    pairs = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.s") < F.col("b.s")))
    pairs = pairs.select(F.col("a.s").alias("a"), F.col("b.s").alias("b"), identity.hamming(F.col("a.s"), F.col("b.s")).alias("distance"))
    return pairs.filter(F.col("distance") <= threshold).distinct()


def _agreeing(nodes: DataFrame, masks: list[int], threshold: int, sim_col: str) -> DataFrame:
    """(a, b, distance) of distinct hashes a < b that differ in at most threshold bits and agree on all bits of one of the masks, for short
    keys, under which many meet: hashes come in order of their keys, and those of a key are compared as arrays. A task holds the hashes of
    one key and of one batch; of each pair only the first mask on which it agrees tells."""
    bits = np.array(masks, np.int64)

    def close(s: np.ndarray, c: np.ndarray, end: np.ndarray) -> Iterator[pd.DataFrame]:
        """end: where the run of rows with the same key ends, for each row."""
        i, shift = np.arange(len(s)), 0
        while True:
            shift += 1
            i = i[i + shift < end[i]]
            if not len(i):
                return
            x = s[i] ^ s[i + shift]
            hit = np.flatnonzero(np.bitwise_count(x.view(np.uint64)) <= threshold)
            hit = hit[((x[hit, None] & bits) == 0).argmax(1) == c[i[hit]]]
            if len(hit):
                a, b = s[i[hit]], s[i[hit] + shift]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": np.bitwise_count(x[hit].view(np.uint64)).astype(np.int32)})

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # the rows of the key that may go on, a piece a batch
        for pdf in batches:
            rows = pdf[["s", "c", "key"]].to_numpy(np.int64)
            if not len(rows):
                continue
            if held and (held[-1][-1, 1:] == rows[-1, 1:]).all():  # all of it is of the key that is held
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            cut = np.append(np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(1)) + 1, len(rows))
            last = cut[-2] if len(cut) > 1 else 0
            held = [rows[last:].copy()]
            ends = np.repeat(cut[:-1], np.diff(cut[:-1], prepend=0))
            yield from close(rows[:last, 0].copy(), rows[:last, 1], ends)
        if held:
            rows = np.concatenate(held)
            yield from close(rows[:, 0].copy(), rows[:, 1], np.full(len(rows), len(rows)))

    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    rows = _keyed(nodes, masks, sim_col).repartition(tasks, "c", "key").sortWithinPartitions("c", "key")
    return rows.mapInPandas(kernel, "a bigint, b bigint, distance int")


def banded_pairs(nodes: DataFrame, threshold: int, bands: int = 8, sim_col: str = "simhash") -> DataFrame:
    """D2 by bands of 64 / bands bits, as an index of buckets does it; loses pairs once threshold >= bands. Below that every near pair shares
    a band, and longer keys find the same pairs among fewer."""
    if threshold < bands:
        return near_pairs(nodes, threshold, sim_col)
    width = 64 // bands
    masks = [((1 << width) - 1) << (64 - width * (i + 1)) for i in range(bands)]
    return _agreeing(nodes, [m - (1 << 64) if m >> 63 else m for m in masks], threshold, sim_col)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def classify(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """D3: (id, status, match_id, distance) against all earlier documents: exact (same normalised text), near (the closest hash,
    then the earliest document) or new. docs has content_hash and simhash."""
    docs = Scratch(docs.sparkSession, "classify").table(docs.select(id_col, "content_hash", "simhash"), "ids")  # read four times below
    nodes = docs.groupBy("simhash").agg(F.min(id_col).alias("first"))
    texts = docs.groupBy("content_hash").agg(F.min(id_col).alias("first_text"))
    pairs = _both_ways(near_pairs(nodes, threshold)).join(nodes.select(F.col("simhash").alias("b"), F.col("first").alias("other")), "b")
    near = pairs.groupBy("a").agg(F.collect_list(F.struct("distance", "other")).alias("near")).withColumnRenamed("a", "simhash")
    x = docs.select(id_col, "content_hash", "simhash").join(texts, "content_hash").join(nodes, "simhash").join(near, "simhash", "left")
    mine = F.col(id_col)
    best = F.array_min(F.filter("near", lambda p: p["other"] < mine))
    status = F.when(F.col("first_text") < mine, "exact").when((F.col("first") < mine) | best.isNotNull(), "near").otherwise("new")
    match = F.when(F.col("first_text") < mine, F.col("first_text")).when(F.col("first") < mine, F.col("first")).otherwise(best["other"])
    distance = F.when(F.col("first") < mine, 0).otherwise(best["distance"])
    return x.select(id_col, status.alias("status"), match.alias("match_id"), distance.cast("int").alias("distance"))


def entries(nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Of nodes(simhash, first) those that found a registry entry: a node does unless an earlier entry is near. The rule is
    sequential; here all undecided nodes without an undecided earlier neighbour are decided at once, round by round, each
    round written to the shared folder."""
    named = pairs.join(nodes.withColumnsRenamed({"simhash": "a", "first": "fa"}), "a").join(nodes.withColumnsRenamed({"simhash": "b", "first": "fb"}), "b")
    a_first = F.struct("fa", "a") < F.struct(F.col("fb").alias("fa"), F.col("b").alias("a"))
    edges = scratch.table(named.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("late")), "edges")
    open_ = scratch.table(edges.select(F.col("late").alias("simhash")).distinct(), "open0")
    done = nodes.join(open_, "simhash", "left_anti").select("simhash", F.lit(True).alias("entry"))
    done, n = scratch.table(done, "done0"), 0
    while open_.take(1):
        n += 1
        about = edges.join(open_.withColumnRenamed("simhash", "late"), "late", "left_semi")
        about = about.join(done.withColumnRenamed("simhash", "early"), "early", "left").groupBy("late").agg(F.max(F.coalesce("entry", F.lit(False))).alias("hit"), F.max(F.col("entry").isNull()).alias("waits"))
        decided = scratch.table(about.filter("hit OR NOT waits").select(F.col("late").alias("simhash"), (~F.col("hit")).alias("entry")), f"decided{n}")
        done = done.unionByName(decided)
        open_ = scratch.table(open_.join(decided, "simhash", "left_anti"), f"open{n}")
    return nodes.join(done.filter("entry").select("simhash"), "simhash", "left_semi")


def process(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, update_near: bool = True, dedup: bool = True, hash_name: str = "md5", scratch: Scratch | None = None) -> DataFrame:
    """(id, status, entry_id, distance) as if the documents had come one by one in the order of their ids: skipped (too short, or near with
    update_near off), indexed, metadata_updated (the entry's latest text again) or content_updated."""
    scratch = scratch or Scratch(docs.sparkSession, "process")
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.octet_length(F.coalesce("text", F.lit(""))) >= min_bytes
    short = x.filter(~long).select("id", F.lit("skipped").alias("status"), F.lit(None).cast("bigint").alias("entry_id"), F.lit(None).cast("int").alias("distance"))
    if not dedup:
        return x.filter(long).select("id", F.lit("indexed").alias("status"), F.col("id").cast("bigint").alias("entry_id"), F.lit(0).alias("distance")).unionByName(short).withColumnRenamed("id", id_col)
    ids = with_identity(x.filter(long), "text", hash_name).select("id", "content_hash", "simhash")
    y = _in_order(ids, threshold, update_near, scratch)
    return y.unionByName(short).withColumnRenamed("id", id_col)


def _in_order(ids: DataFrame, threshold: int, update_near: bool, scratch: Scratch) -> DataFrame:
    """(id, status, entry_id, distance) of ids(id, content_hash, simhash), as if they had come one by one."""
    ids = scratch.table(ids, "ids")
    nodes = scratch.table(ids.groupBy("simhash").agg(F.min("id").alias("first")), "nodes")
    pairs = scratch.table(near_pairs(nodes, threshold), "pairs")
    found = scratch.table(entries(nodes, pairs, scratch), "entries")
    own = found.select("simhash", F.col("first").alias("own"))
    near = _both_ways(pairs).join(found.select(F.col("simhash").alias("b"), F.col("first").alias("other")), "b").groupBy("a").agg(F.collect_list(F.struct("distance", "other")).alias("near"))
    y = ids.join(own, "simhash", "left").join(near.withColumnRenamed("a", "simhash"), "simhash", "left")
    best = F.array_min(F.filter("near", lambda p: p["other"] < F.col("id")))
    y = y.select("id", "content_hash", F.coalesce("own", best["other"]).alias("entry_id"), F.when(F.col("own").isNotNull(), 0).otherwise(best["distance"]).cast("int").alias("distance"))
    y = scratch.table(y, "placed")
    turns = _turns(y)
    status = F.when(F.col("id") == F.col("entry_id"), "indexed").when(F.col("again"), "metadata_updated").otherwise("content_updated" if update_near else "skipped")
    return turns.select("id", status.alias("status"), "entry_id", "distance")


def _turns(y: DataFrame) -> DataFrame:
    """y(id, content_hash, entry_id) with again: the text before it in its entry, by id, is the same.

    Entries are sorted in a range partitioning of (entry_id, id), which cuts hot ones; the rows before the first of each partition come
    from a table of the partitions' last rows, one a partition.
    """
    scratch = Scratch(y.sparkSession, "turns")
    parts = scratch.table(y.repartitionByRange("entry_id", "id").sortWithinPartitions("entry_id", "id").withColumn("part", F.spark_partition_id()), "sorted")
    w = Window.partitionBy("part").orderBy("entry_id", "id")
    last = parts.groupBy("part").agg(F.max_by(F.struct("entry_id", "content_hash"), F.struct("entry_id", "id")).alias("last"))
    carried = last.withColumn("part", F.lead("part").over(Window.orderBy("part"))).filter("part IS NOT NULL")  # a row for each partition
    rows = parts.join(F.broadcast(carried), "part", "left")
    before = F.coalesce(F.lag(F.struct("entry_id", "content_hash")).over(w), F.col("last"))
    return rows.withColumn("_b", before).withColumn("again", F.coalesce((F.col("_b.entry_id") == F.col("entry_id")) & (F.col("_b.content_hash") == F.col("content_hash")), F.lit(False))).drop("_b", "last", "part")


def against_registry(docs: DataFrame, registry: DataFrame, threshold: int = THRESHOLD, update_near: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """D4 against a stored registry(entry_id, content_hash, simhash): (id, status, entry_id, distance) of docs(id, content_hash, simhash).

    A document with the text of an entry is metadata_updated; else one near an entry, the nearest, then the first by id, is content_updated (skipped without
    update_near). The others meet each other in the order of their ids, as in process(). Repeated ids are one document.
    """
    scratch = scratch or Scratch(docs.sparkSession, "registry")
    docs = scratch.table(docs.select("id", "content_hash", "simhash").dropDuplicates(["id"]), "reg_docs")
    known = scratch.table(registry.select("entry_id", "content_hash", "simhash"), "reg_known")
    same = known.groupBy("content_hash").agg(F.min("entry_id").alias("same"))
    first = known.groupBy("simhash").agg(F.min("entry_id").alias("entry"))
    both = docs.select("simhash").distinct().withColumn("new", F.lit(True)).unionByName(known.select("simhash", F.lit(False).alias("new")).distinct())
    pairs = _both_ways(near_pairs(both, threshold)).unionByName(first.select(F.col("simhash").alias("a"), F.col("simhash").alias("b"), F.lit(0).alias("distance")))
    near = pairs.join(first.withColumnRenamed("simhash", "b"), "b").groupBy("a").agg(F.min(F.struct("distance", "entry")).alias("near"))
    met = docs.join(same, "content_hash", "left").join(near.withColumnRenamed("a", "simhash"), "simhash", "left")
    met = scratch.table(met.select("id", "content_hash", "simhash", "same", "near"), "reg_met")
    hit = F.col("same").isNotNull()
    old = met.filter(hit | F.col("near").isNotNull()).select(
        "id",
        F.when(hit, "metadata_updated").otherwise("content_updated" if update_near else "skipped").alias("status"),
        F.coalesce("same", "near.entry").alias("entry_id"),
        F.when(hit, 0).otherwise(F.col("near.distance")).cast("int").alias("distance"),
    )
    rest = met.filter("same IS NULL AND near IS NULL").select("id", "content_hash", "simhash")
    return old.unionByName(_in_order(rest, threshold, update_near, scratch))


def registry_stats(registry: DataFrame) -> DataFrame:
    """Documents, chunks and URLs by source_type of registry(content_id, source_type, urls array, chunk_ids array)."""
    return registry.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("chunk_ids")).alias("chunks"), F.sum(F.size("urls")).alias("urls"))


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by content_id: URLs and chunk ids are sets, source ids a map whose later values win, other fields the new ones."""
    both = registry.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    last = lambda c: F.max_by(c, "_n").alias(c)
    merged = both.groupBy("content_id").agg(
        *(last(c) for c in registry.columns if c not in ("content_id", "urls", "chunk_ids", "source_ids")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"),
        *([F.transform(F.array_sort(F.collect_list(F.struct("_n", F.map_entries("source_ids").alias("e")))), lambda s: s["e"]).alias("_maps")] if "source_ids" in registry.columns else []),
    )
    if "source_ids" in registry.columns:
        entries_ = F.flatten(F.filter("_maps", lambda m: m.isNotNull()))
        keys = F.array_distinct(F.transform(entries_, lambda e: e["key"]))
        merged = merged.withColumn("source_ids", F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries_, lambda e: e["key"] == k), -1)["value"])))
    return merged.select(*registry.columns)


def unregister(registry: DataFrame, content_ids: DataFrame) -> DataFrame:
    """Remove."""
    return registry.join(content_ids, "content_id", "left_anti")


def recent_duplicates(pages: DataFrame, id_col: str, capacity: int, hash_col: str = "content_hash") -> DataFrame:
    """Pages with status 'seen' if one of the capacity pages before, by id, has the same text, else 'new': dedup with a bounded memory in which
    a text counts from its last sight on. Pages are numbered by a range sort and a sum for each partition."""
    scratch = Scratch(pages.sparkSession, "recent")
    placed = scratch.table(pages.select(id_col, hash_col).orderBy(id_col).withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "order")
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m")).collect()):  # a row for each partition
        offsets.append((r.part, before - r.m))
        before += r.n
    offsets = pages.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, o bigint")
    rows = scratch.table(placed.join(F.broadcast(offsets), "part").select(id_col, hash_col, (F.col("m") + F.col("o")).alias("n")), "rows")
    # a text's pages in one stretch of capacity places, and the last of the stretch before, decide; so no text is sorted whole
    w = Window.partitionBy(hash_col, "stretch").orderBy("n")
    cut = rows.withColumn("stretch", F.floor(F.col("n") / capacity))
    last = cut.groupBy(hash_col, "stretch").agg(F.max("n").alias("carried")).withColumn("stretch", F.col("stretch") + 1)
    near = cut.withColumn("own", F.lag("n").over(w)).join(last, [hash_col, "stretch"], "left")
    gap = F.col("n") - F.coalesce("own", "carried")
    return near.select(id_col, hash_col, F.when(gap <= capacity, "seen").otherwise("new").alias("status"))


def url_dedup(pages: DataFrame, url_col: str = "url", order_col: str = "page_id") -> DataFrame:
    """The first page of every normalised URL."""
    keyed = pages.withColumn("norm_url", urls.normalize_url(F.col(url_col)))
    first = keyed.groupBy("norm_url").agg(F.min_by(F.struct(*pages.columns), order_col).alias("p"))
    return first.select("p.*", "norm_url")


def replace_by_url(store: DataFrame, new: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows of a URL that is indexed again give way to the new ones."""
    return store.join(new.select(url_col).distinct(), url_col, "left_anti").unionByName(new)


def migrate_registry(chunks: DataFrame, doc_col: str = "document_id", order_col: str = "ordinal", text_col: str = "content") -> DataFrame:
    """(document, text) from the chunks of a store, joined by blanks in their order, for classify()."""
    parts = chunks.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct(order_col, text_col))).alias("p"))
    return parts.select(doc_col, F.array_join(F.transform("p", lambda x: F.concat(x[text_col], F.lit(" "))), "").alias("text"))


def seen_urls(pages: DataFrame, url_col: str = "url", canonical_col: str = "canonical_url") -> DataFrame:
    """Normalised URLs that count as seen: those fetched, and canonical ones that differ."""
    both = pages.select(F.explode(F.array(F.col(url_col), F.col(canonical_col))).alias("u")).filter("u IS NOT NULL")
    return both.select(urls.normalize_url(F.col("u")).alias("norm_url")).distinct()


def empty(spark: SparkSession) -> DataFrame:
    """An empty registry."""
    return spark.createDataFrame([], "content_id string, content_hash string, title string, source_type string, urls array<string>, chunk_ids array<string>, source_ids map<string,string>")
