"""Line dedup over a suffix array of line ids, built by distributed prefix doubling (operator 8).

Documents are sequences of line ids. Documents are numbered in order of (doc_id, hash of the text) such that d + i, the start of a document and a
line of it, is a place in all of them. rank_k of a place is the place, in the suffix array sorted by the first
2 ** k lines, of the first suffix that starts with the same 2 ** k lines; rank_(k+1) follows from the pairs
(rank_k here, rank_k 2 ** k lines on). Suffixes that are alone with their prefix are dropped at every level, as no
repeated run starts there; levels end where none is left, so they reach the longest repeated run, however long.

Suffixes with equal ranks are an interval of the array whose longest common prefix is at least 2 ** k. The tree of these intervals is walked
down from the highest level: an interval (the first place with its prefix, its length) is split by the rank of what
follows, 2 ** j lines for j = top, ..., 0, and the places that aren't the first of their part go into it, 2 ** j lines longer. The first
place of a part stays behind, as it has no earlier copy of that length, and stands for the part in both. In the end a place
is in the deepest interval in which an earlier place is, so its length is that of the longest run from there on that is found earlier. Every
place looks for its copy in one interval at a time and each part is led by one place, so a step handles at most two rows a place.

Runs of at least min_words words that no longer run covers are the maximal repeated ones; all their lines are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekmill.llm.common import Scratch, fresh

MIN_WORDS = 50
#: Parts into which the continuations of one prefix are cut to be ranked.
RANK_PARTS = 4096


def needed(words: np.ndarray, min_words: int) -> np.ndarray:
    """For lines of so many words: how many lines the shortest run of min_words from each line on has; -1: there is none."""
    upto = np.cumsum(words)
    end = np.searchsorted(upto, upto - words + min_words, side="left") + 1
    return np.where(end > len(words), -1, end - np.arange(len(words)))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(known, doc_id, th, i, h, need): every line; known: the id isn't NULL (doc_id is 0 then), th the hash of the text and h of the line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                sizes, hs, needs = [], [], []
                for text in part["text"]:
                    lines = text.split("\n")
                    sizes.append(len(lines))
                    hs += [digest(x) for x in lines]
                    needs.append(needed(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), min_words))
                row = np.repeat(np.arange(len(part)), sizes)
                first = np.cumsum(sizes) - sizes
                out = {c: part[c].to_numpy()[row] for c in ("known", "doc_id", "th")}
                yield pd.DataFrame({**out, "i": np.arange(len(row)) - first[row], "h": np.array(hs, np.uint64).view(np.int64), "need": np.concatenate(needs)})

    slim = _keyed(docs, id_col, text_col).select("known", "doc_id", "th", F.col(f"`{text_col}`").alias("text"))
    return slim.mapInPandas(run, "known boolean, doc_id bigint, th bigint, i bigint, h bigint, need bigint")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(known, doc_id, th) and the text of the rows that have one; no part of the key is NULL."""
    i, t = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")
    return docs.filter(t != "").select(i.isNotNull().alias("known"), F.coalesce(i, F.lit(0)).alias("doc_id"), F.xxhash64(t).alias("th"), t)


_DOC = ["known", "doc_id", "th"]


def _starts(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """((known, doc_id, th, d): every document and the number of lines of those before it, in order; whether any is there twice).

    The range sort leaves the documents in order over its partitions; only a sum for each partition goes through the driver.
    """
    n = F.size(F.split(F.col(f"`{text_col}`"), "\n")).cast("bigint").alias("n")
    sizes = _keyed(docs, id_col, text_col).select(*_DOC, n).groupBy(*_DOC).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c"))
    placed = sizes.orderBy(*_DOC).withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    placed = scratch.table(placed, "order")
    before, offsets, most = 0, [], 1
    for r in sorted(placed.groupBy("part").agg(F.sum("n").alias("n"), F.max("c").alias("c")).collect()):  # a row for each partition
        offsets.append((r.part, before))
        before, most = before + r.n, max(most, r.c)
    offsets = docs.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, o bigint")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.withColumn("inside", inside).join(F.broadcast(offsets), "part").select(*_DOC, (F.col("o") + F.col("inside")).alias("d"))
    return scratch.table(starts, "starts"), most > 1


def _first_ranks(lines: DataFrame, starts: DataFrame, repeats: bool, scratch: Scratch) -> DataFrame:
    """(d, i, need, r): rank_0 of the places whose line is found at least twice: a prefix sum over the sorted line ids, in 4096 buckets."""
    seen = lines.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumn("b", F.shiftright("h", 52))
    seen = scratch.table(seen, "line_ids")
    totals = {r["b"]: r["c"] for r in seen.groupBy("b").agg(F.sum("c").alias("c")).collect()}  # at most 4096 rows
    offsets, at = [], 0
    for b in sorted(totals):
        offsets.append((b, at))
        at += totals[b]
    offsets = lines.sparkSession.createDataFrame(offsets or [(0, 0)], "b long, o long")
    before = F.sum("c").over(Window.partitionBy("b").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    ranks = seen.join(F.broadcast(offsets), "b").select("h", (F.col("o") + F.coalesce(before, F.lit(0))).alias("r"))
    found = lines.join(ranks.hint("merge"), "h").select(*_DOC, "i", "need", "r")
    placed = found.join(starts.hint("merge"), _DOC).select("d", "i", "need", "r")
    return placed.distinct() if repeats else placed


def _double(active: DataFrame, step: int) -> DataFrame:
    """rank_(k+1) of the places that share 2 * step lines with another.

    Only continuations found twice are ranked. Those of one prefix are ranked in parts of neighbouring ranks, so no prefix is
    sorted in one task, however many continuations it has.
    """
    there = Window.partitionBy("d").orderBy("i").rangeBetween(step, step)
    pairs = active.withColumn("r2", F.first("r").over(there)).filter("r2 IS NOT NULL").select("d", "i", "need", "r", "r2")
    groups = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    groups = groups.withColumn("b", F.pmod(F.shiftright("r2", 8), F.lit(RANK_PARTS)))
    sums = groups.groupBy("r", "b").agg(F.sum("c").alias("s"))
    outer = F.sum("s").over(Window.partitionBy("r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.sum("c").over(Window.partitionBy("r", "b").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("r", "b", F.coalesce(outer, F.lit(0)).alias("o"))
    ranks = groups.withColumn("inner", F.coalesce(inner, F.lit(0))).join(offsets.hint("merge"), ["r", "b"])
    ranks = ranks.select("r", "r2", (F.col("r") + F.col("o") + F.col("inner")).alias("new"))
    return pairs.join(ranks.hint("merge"), ["r", "r2"]).select("d", "i", "need", F.col("new").alias("r"))


def _descend(state: DataFrame | None, level: DataFrame, j: int) -> DataFrame:
    """One step of the walk: (d, i, need, length, lead) for places in intervals, an interval being (lead, length), its first place and its
    common lines; level is (d, i, need, r) of rank_j. Places that lead an interval have lead = d + i."""
    # places that are in no interval yet; a run that fits between 2 ** j and min_words at most comes to nothing later
    root = level.filter((F.col("need") > 0) & (F.col("need") < F.lit(1 << (j + 1))))
    empty = root.select("d", "i", "need", F.lit(0).cast("bigint").alias("length"), F.lit(-1).cast("bigint").alias("lead"), "r")
    if state is None:
        every = empty
    else:
        asking = state.filter("lead <> d + i").select("d", "i")
        t = level.select(F.col("d").alias("td"), F.col("i").alias("ti"), "r")
        known = state.join(t.hint("merge"), (F.col("d") == F.col("td")) & (F.col("i") + F.col("length") == F.col("ti")), "left").drop("td", "ti")
        every = known.unionByName(empty.join(asking.hint("merge"), ["d", "i"], "left_anti"))
    place = F.col("d") + F.col("i")
    parts = every.filter("r IS NOT NULL").groupBy("lead", "length", "r").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    joined = every.join(parts.hint("merge"), ["lead", "length", "r"], "left")
    stay = F.when((F.col("lead") >= 0) & (F.col("first").isNull() | (F.col("first") == place)), F.struct("length", "lead"))
    deeper = F.when(F.col("first").isNotNull(), F.struct((F.col("length") + F.lit(1 << j)).alias("length"), F.col("first").alias("lead")))
    return joined.select("d", "i", "need", F.explode(F.array_compact(F.array(stay, deeper))).alias("x")).select("d", "i", "need", "x.length", "x.lead")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(known, doc_id, th, first, length, lead): the maximal runs of lines, of min_words words or more, that an earlier place has as well; th
    is xxhash64 of the text, lead the number of the earliest such place; doc_id is 0 where the id isn't known."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    starts, repeats = _starts(docs, id_col, text_col, scratch)
    lines = scratch.table(line_table(docs, id_col, text_col, min_words), "lines")
    levels = [scratch.table(_first_ranks(lines, starts, repeats, scratch), "level0")]
    scratch.drop("order", "lines", "line_ids")
    while levels[-1].take(1):
        levels.append(scratch.table(_double(levels[-1], 1 << (len(levels) - 1)), f"level{len(levels)}"))
    state = None
    for j in range(len(levels) - 1, -1, -1):
        state = scratch.table(_descend(state, levels[j], j), f"state{j}")
        scratch.drop(f"state{j + 1}", f"level{j}")
    runs = state.filter("lead <> d + i AND length >= need")
    before = F.lag(F.col("i") + F.col("length")).over(Window.partitionBy("d").orderBy("i"))
    runs = runs.withColumn("before", before).filter("before IS NULL OR i + length > before")
    return runs.join(starts.hint("merge"), "d").select(*_DOC, F.col("i").alias("first"), "length", "lead")


def _keep_mask(runs: pd.Series) -> pd.Series:
    """Runs of a document -> whether each line stays, up to the last deleted one."""

    def one(rs) -> np.ndarray:
        delta = np.zeros(max(r["first"] + r["length"] for r in rs) + 1, np.int64)
        for r in rs:
            delta[r["first"]] += 1
            delta[r["first"] + r["length"]] -= 1
        return np.cumsum(delta)[:-1] == 0

    return runs.map(one)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counts: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """docs, in the text of which later copies of repeated runs of lines are deleted (counts=True: with n_lines and n_deleted).

    Lines are what stands between newlines, compared as they are. Blank lines belong to runs but have no words, so a run of
    nothing else is never long enough. Copies inside a document count as well, overlapping ones too. Of several copies the first, by
    (doc_id, hash of the text, line), NULL ids first, stays. Repeated rows (same id and text) are one document: they are
    treated alike. NULL and empty texts stay as they are; a document all of whose lines are deleted has the empty text; very
    long texts are taken whole. Other columns are kept whatever their names; an empty table gives an empty result.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words, scratch)
    mask = F.pandas_udf(_keep_mask, "array<boolean>")
    n, h, k, i = (fresh(docs, x) for x in ("_ld_known", "_ld_th", "_ld_keep", "_ld_id"))
    deleted = runs.groupBy(*_DOC).agg(F.collect_list(F.struct("first", "length")).alias("runs"))
    deleted = deleted.select(F.col("known").alias(n), F.col("doc_id").alias(i), F.col("th").alias(h), mask("runs").alias(k))
    text, own = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("bigint")
    same = (F.xxhash64(text) == F.col(h)) & (F.coalesce(own, F.lit(0)) == F.col(i)) & (own.isNotNull() == F.col(n))
    joined = docs.join(deleted.hint("shuffle_hash"), same, "left")
    lines = F.arrays_zip(F.split(text, "\n").alias("line"), F.col(k).alias("keep"))
    left = F.transform(F.filter(lines, lambda x: F.coalesce(x["keep"], F.lit(True))), lambda x: x["line"])
    new = F.when(F.col(k).isNull(), text).otherwise(F.array_join(left, "\n"))
    more = [F.coalesce(F.size(F.split(F.when(text != "", text), "\n")), F.lit(0)).alias(fresh(docs, "n_lines")), F.coalesce(F.size(F.filter(F.col(k), lambda x: ~x)), F.lit(0)).alias(fresh(docs, "n_deleted"))] if counts else []
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *more)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text <> '')),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto, (sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w)::BIGINT AS before FROM l),
win AS (
  SELECT a.doc_id, a.i AS s, b.i AS e FROM (SELECT doc_id, i, before + 50 AS t FROM c) a ASOF JOIN (FROM c WHERE w > 0) b ON a.doc_id = b.doc_id AND a.t <= b.upto
  UNION SELECT a.doc_id, b.i AS s, a.i AS e FROM (SELECT doc_id, i, upto - 50 AS t FROM c) a ASOF JOIN (FROM c WHERE w > 0) b ON a.doc_id = b.doc_id AND a.t >= b.before),
d AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM l GROUP BY 1),
named AS (SELECT doc_id, s, e, array_to_string(ls[s + 1 : e + 1], chr(10)) AS run FROM win JOIN d USING (doc_id)),
dup AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS n FROM named) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM dup),
left_over AS (SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text
  FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CASE WHEN x.n_lines IS NULL THEN o.text ELSE x.text END AS text, coalesce(x.n_lines, 0)::INT AS n_lines, coalesce(x.n_deleted, 0)::INT AS n_deleted
FROM documents o LEFT JOIN left_over x USING (doc_id)
"""
