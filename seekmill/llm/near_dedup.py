"""Near-duplicate documents by SetSketch registers (operator 7).

A document is the set of its shingles of SHINGLE words. Register i of its sketch is floor(1 - log_BASE(h)), truncated to
16 bits, where h is the smallest of the shingles' i-th hashes, taken as exponentially distributed with rate RATE. Registers of a union are the
larger ones of the parts, so sketches merge; equal registers are the more likely the more alike two sets are. Four
registers are a band, a 64-bit key; documents that share a key become candidates. The Jaccard similarity of a
candidate pair is estimated from the numbers of registers that are greater, less and equal, by maximum likelihood
(Ertl, SetSketch, 2021); pairs that could reach the threshold are verified on their texts, exactly, at once.

Texts equal but for case and punctuation are one node. A bucket is a star, not all its pairs: its members are compared with
one of them, the leader, who has then met everyone and leaves. Groups are the connected components of the pairs verified so far;
while the members left in a bucket belong to several groups, they meet again with WIDEN times as many leaders, members with the
most matches first. A bucket of copies costs its size, and members that are all different meet all others in the end, unless
they are of more than SPLIT groups.

What the buckets leave open (pairs without a common band, in wide buckets, or whose estimate fell short) is settled without sketches. A text can be
alike one of another group only if it shares threshold of its shingles with other groups: all shingles of all texts are counted for that
(_possible). Texts that do are joined on their sets, exactly (a prefix filter: _alike). So the groups are those of all pairs of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seekmill.llm.common import Scratch, fresh

SHINGLE = 3
THRESHOLD = 0.6
BANDS, ROWS = 32, 4
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Standard errors of the estimate below the threshold at which a pair is still verified at once; others wait for the join of what is left.
SLACK = 3.0
#: A bucket's leaders become so many times more from round to round.
WIDEN = 4
#: A bucket with more groups than SPLIT after so many rounds is left to the join.
SPLIT, SPLIT_ROUND = 256, 2
#: Characters of a block of texts, in the join of what the buckets leave open, and so many for each part of the shingles' counting.
BLOCK, PART = 4_000_000, 8_000_000
#: Characters of text that are hashed at once; such blocks fit the cache.
CACHED = 500_000

_rng = np.random.default_rng(7_2021)
_A = _rng.integers(0, 1 << 32, M, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, M, dtype=np.uint32)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(SHINGLE)]
_FOLD = np.array([ord(chr(b).lower()) if chr(b).isalnum() or b >= 128 else 32 for b in range(256)], np.uint8)
_FOLD[128:] = np.arange(128, 256)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, f, np.uint64)]), dtype=np.uint64) for f in (_MUL, _INV)]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(text: str) -> bytes:
    """Lower case, one blank between words, ASCII punctuation gone."""
    return b" ".join(_FOLD[np.frombuffer(text.lower().encode(), np.uint8)].tobytes().split())


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingle hashes of folded, non-empty texts, one after another, and where each text's begin.
    A text of fewer than SHINGLE words has one shingle, of all its words."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    power, inverse = _power(len(data) + 1)
    blank = np.flatnonzero(data == 32)
    begin = np.concatenate([[0], blank + 1])
    end = np.concatenate([blank, [len(data)]])
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    words = _mix((sums[end] - sums[begin]) * inverse[begin])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    first_word = np.searchsorted(begin, starts)
    n_words = np.diff(np.append(first_word, len(words)))
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    owner_end = np.repeat(first_word + n_words, n_words)
    at = np.arange(len(words))
    total = np.zeros(len(words), np.uint64)
    for j in range(SHINGLE):
        w = padded[j : j + len(words)]
        total += np.where(at + j < owner_end, w * _STEP[j], np.uint64(0))
    n = np.maximum(1, n_words - SHINGLE + 1)
    keep = at - np.repeat(first_word, n_words) < np.repeat(n, n_words)
    return _mix(total[keep]), np.cumsum(n) - n


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16[texts, M]: the registers of the sketches."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(first), M), np.uint32)
    for i in range(M):
        low[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], first)
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1.0 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def cardinality(k: np.ndarray) -> np.ndarray:
    """Estimated size of the sets with registers k[..., M]."""
    return M * (1 - 1 / BASE) / (RATE * math.log(BASE) * np.exp(-math.log(BASE) * k.astype(np.float64)).sum(-1))


_GRID = np.linspace(0.0, 1.0, 101)


def joint_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximum likelihood Jaccard of pairs of sketches uint16[n, M] (on a grid of hundredths)."""
    na, nb = cardinality(a), cardinality(b)
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    plus, minus = p(u - v * _GRID), p(v - u * _GRID)
    rest = np.clip(1 - plus - minus, 1e-12, 1)
    like = more * np.log(plus) + less * np.log(minus) + (M - more - less) * np.log(rest)
    like[_GRID[None, :] > np.minimum(u / v, v / u) + 0.005] = -np.inf
    return _GRID[like.argmax(1)]


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of two texts' shingle sets; 0 if one has no words."""
    a_, b_ = fold(a), fold(b)
    if not a_ or not b_:
        return 0.0
    x, y = np.unique(shingles([a_])[0]), np.unique(shingles([b_])[0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, d1, d2, sketch): the digest of the folded text and its registers, four to a 64-bit key. No row for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, size = 0, pdf["text"].str.len().to_numpy()
            while at < len(pdf):
                to, chars = at + 1, size[at]
                while to < len(pdf) and to < at + 512 and chars + size[to] < CACHED:
                    chars += size[to]
                    to += 1
                part, at = pdf.iloc[at:to], to
                folded = [fold(t) for t in part["text"]]
                has = np.array([bool(t) for t in folded])
                if has.any():
                    texts = [t for t in folded if t]
                    keys = registers(*shingles(texts)).view("<u8").view(np.int64)
                    digests = np.array([divmod(xxhash.xxh3_128_intdigest(t), 1 << 64) for t in texts], np.uint64).view(np.int64)
                    yield pd.DataFrame({"doc_id": part["doc_id"].array[has], "th": part["th"].to_numpy()[has], "d1": digests[:, 0], "d2": digests[:, 1], "sketch": list(keys)})

    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("th"), F.col(f"`{text_col}`").alias("text")).filter("text <> ''")
    return slim.mapInPandas(run, "doc_id bigint, th bigint, d1 bigint, d2 bigint, sketch array<bigint>")


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.vstack(s.to_numpy()).astype(np.int64).view(np.uint16) for s in (a, b))
    return pd.Series(joint_estimate(x, y))


def _stars(members: DataFrame, leaders: int) -> DataFrame:
    """(band, key, v, u, root, other, leads): the members of each bucket beside so many leaders u, those with the most matches, then the
    smallest nodes in even bands, the largest in odd ones; root, other: the groups of v and u; leads: v is a leader itself (leaders
    meet those before them only)."""
    if leaders == 1:
        ends = members.groupBy("band", "key").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low < high")
        lead = F.when(F.col("band") % 2 == 0, F.col("low")).otherwise(F.col("high"))
        both = members.join(ends.hint("merge"), ["band", "key"]).select("band", "key", "v", lead.alias("u"))
        return both.filter("u <> v").select("band", "key", "v", "u", F.col("v").alias("root"), F.col("u").alias("other"), F.lit(False).alias("leads"))
    order = F.when(F.col("band") % 2 == 0, F.col("v")).otherwise(-F.col("v"))
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("band", "key").orderBy(F.desc("degree"), order))).filter(F.col("r") <= leaders)
    rank = first.select("band", "key", "v", "r")
    lead = first.select("band", "key", F.col("v").alias("u"), F.col("root").alias("other"), F.col("r").alias("ur"))
    both = members.join(rank.hint("merge"), ["band", "key", "v"], "left").join(lead.hint("merge"), ["band", "key"])
    return both.filter("r IS NULL OR ur < r").select("band", "key", "v", "u", "root", "other", F.col("r").isNotNull().alias("leads"))


def _open(members: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """(band, key, v, root, degree): the members of buckets in which several groups are left; degree: the matches of v so far."""
    degree = found.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    known = members.join(degree.join(roots.hint("merge"), "v", "left").hint("merge"), "v", "left")
    known = known.select("band", "key", "v", F.coalesce("root", "v").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return _several(known)


def _several(known: DataFrame) -> DataFrame:
    """The members of buckets of several groups."""
    several = known.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "key")
    return known.join(several.hint("merge"), ["band", "key"])


def _wide(members: DataFrame) -> DataFrame:
    """(band, key): the buckets of more than SPLIT groups."""
    groups = members.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    return groups.filter(F.col("n") > SPLIT).select("band", "key")


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows of texts in blocks, 65 536 at most, and the distinct shingles of each, in order."""
    for pdf in batches:
        at, size = 0, pdf["text"].str.len().to_numpy()
        while at < len(pdf):
            begin, chars, sets = at, 0, []
            while at < len(pdf) and at < begin + 65_536 and (not sets or chars + size[at] < BLOCK):
                to, hashed = at + 1, size[at]
                while to < len(pdf) and to < begin + 65_536 and hashed + size[to] < CACHED and chars + hashed + size[to] < BLOCK:
                    hashed += size[to]
                    to += 1
                hashes, first = shingles([fold(t) for t in pdf["text"].iloc[at:to]])
                sets += [np.unique(h) for h in np.split(hashes, first[1:])]
                at, chars = to, chars + hashed
            yield pdf.iloc[begin:at], sets


def _sets(texts: DataFrame) -> DataFrame:
    """(v, root, n, h): the n distinct shingles of texts (v, root, text), as hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, hashes in _distinct(batches):
            yield pd.DataFrame({"v": part["v"].to_numpy(), "root": part["root"].to_numpy(), "n": [len(h) for h in hashes], "h": [h.view(np.int64) for h in hashes]})

    return texts.mapInPandas(run, "v bigint, root bigint, n bigint, h array<bigint>")


def _of_several(keys: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Whether another root has the key as well."""
    order = np.argsort(keys)
    k, r = keys[order], roots[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    several = np.minimum.reduceat(r, begin) != np.maximum.reduceat(r, begin)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(several, np.diff(np.append(begin, len(keys))))
    return out


def _possible(texts: DataFrame, threshold: float, parts: int) -> DataFrame:
    """v of the texts (v, root, grouped, text) that share threshold of their distinct shingles with other roots, among them all that are alike
    one of another root. grouped: there are others of that root. Texts must come in the same order when a task is run again.

    Blocks of texts send their shingles to parts by their upper bits, once each, as the lower 32 (a clash makes a shingle shared that isn't);
    those of several roots in the block are known to be shared and sent without an owner, so one that all texts hold comes once a block.
    Parts send back how many of a text's shingles other blocks hold.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of a part: h: shingles of one root, then those of several; d: the texts of the former; r: the roots of the last of them, if grouped.
        # of a block (p < 0): h: v; d: sizes; r: shingles known to be shared
        task = TaskContext.get().partitionId() << 32
        for n, (part, sets) in enumerate(_distinct(batches)):
            size = np.array([len(s) for s in sets])
            h, d = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            root, grouped = part["root"].to_numpy(), part["grouped"].to_numpy().astype(bool)
            shared = _of_several(h, root[d])
            yield pd.DataFrame({"p": [-1 - n % parts], "block": [task + n], "h": [part["v"].to_numpy().astype("<i8").tobytes()], "d": [size.astype("<i8").tobytes()],
                                "r": [np.bincount(d[shared], minlength=len(sets)).astype("<i8").tobytes()]})
            place = lambda h: ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            common, h, d = np.unique(h[shared]), h[~shared], d[~shared]
            to = 2 * place(h) + grouped[d]
            order = np.argsort(to, kind="stable")
            h, d, to = h[order].astype("<u4"), d[order], to[order]
            start, middle, m = np.searchsorted(to, 2 * np.arange(parts + 1)), np.searchsorted(to, 2 * np.arange(parts) + 1), np.searchsorted(place(common), np.arange(parts + 1))
            common, roots, d = common.astype("<u4"), root[d].astype("<i8"), d.astype("<u2")
            some = [p for p in range(parts) if start[p] < start[p + 1] or m[p] < m[p + 1]]
            yield pd.DataFrame({"p": some, "block": task + n, "h": [h[start[p] : start[p + 1]].tobytes() + common[m[p] : m[p + 1]].tobytes() for p in some],
                                "d": [d[start[p] : start[p + 1]].tobytes() for p in some], "r": [roots[middle[p] : start[p + 1]].tobytes() for p in some]})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["block", "h", "d", "r"]]
        if pdf["p"].iat[0] < 0:
            return out
        h = np.frombuffer(b"".join(pdf["h"]), "<u4")
        begin = np.cumsum([0] + [len(x) // 4 for x in pdf["h"]])
        roots, owner = -1 - np.arange(len(h)), np.full(len(h), -1)  # roots are all different, unless grouped
        for n, (at, d, r) in enumerate(zip(begin, pdf["d"], pdf["r"])):
            to = at + len(d) // 2
            roots[to - len(r) // 8 : to] = np.frombuffer(r, "<i8")
            owner[at:to] = np.frombuffer(d, "<u2") + np.int64(n << 16)
        owner, held = np.unique(owner[_of_several(h, roots) & (owner >= 0)], return_counts=True)
        at = np.searchsorted(owner, np.arange(len(out) + 1) << 16)
        d, r = (owner & 65_535).astype("<u2"), held.astype("<i8")
        return out.assign(h=b"", d=[d[a:b].tobytes() for a, b in zip(at, at[1:])], r=[r[a:b].tobytes() for a, b in zip(at, at[1:])])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        is_block = pdf["h"].str.len() > 0
        v, size, held = (np.frombuffer(pdf.loc[is_block, c].iat[0], "<i8") for c in "hdr")
        held = held.copy()
        for d, c in zip(pdf.loc[~is_block, "d"], pdf.loc[~is_block, "r"]):
            held[np.frombuffer(d, "<u2")] += np.frombuffer(c, "<i8")
        return pd.DataFrame({"v": v[held >= threshold * size - 1e-9]})

    sent = texts.mapInPandas(send, "p int, block bigint, h binary, d binary, r binary")
    counted = sent.groupBy("p").applyInPandas(count, "block bigint, h binary, d binary, r binary")
    return counted.groupBy("block").applyInPandas(add, "v bigint")


def _alike(sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of sets of different roots, among them all of a Jaccard similarity of threshold or more.

    Shingles are put in one order, those of one root first, then the rarer first. Sets of sizes s <= l and similarity t share
    t / (1 + t) * (s + l) shingles or more, hence 2t / (1 + t) * s and t * l, and all of them stand behind the first shared one in both.
    So that is one of the first of each set, and the sets meet there; no shingle is too common to count.
    """
    every = sets.select("v", "root", "n", F.explode("h").alias("h"))
    held = every.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    shared = every.join(held.filter("low < high").select("h", "c").hint("merge"), "h")
    mine = Window.partitionBy("v")
    behind = F.count(F.lit(1)).over(mine) - F.row_number().over(mine.orderBy("c", "h")) + 1  # shingles from this one on; those of one root come before
    both, slip = threshold / (1 + threshold), 1e-9
    first = scratch.table(shared.select("v", "root", "n", "h", behind.alias("k")).filter(F.col("k") >= threshold * F.col("n") - slip), "first")
    short = first.filter(F.col("k") >= 2 * both * F.col("n") - slip).toDF("a", "ra", "na", "h", "ka")
    meet = short.join(first.toDF("b", "rb", "nb", "h", "kb").hint("merge"), "h")
    meet = meet.filter((F.struct("na", "a") < F.struct("nb", "b")) & (F.col("ra") != F.col("rb")) & (F.col("na") >= threshold * F.col("nb") - slip))
    meet = meet.filter(F.least("ka", "kb") >= both * (F.col("na") + F.col("nb")) - slip)
    return meet.select("a", "b").distinct()


@F.pandas_udf(DoubleType())
def _verify(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype="float64")


def _components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, root): the smallest node of each node's component, roots left out; alternating large-star and small-star steps."""
    last, n = None, 0
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = scratch.table(small, f"{name}{n}")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if n:
            scratch.drop(f"{name}{n - 1}")
        n += 1
        if now == last:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, th, keeper_id, keeper_th): every row that is not the first, by (doc_id, hash of the text th), of its group, and the group's first.

    NULL ids come first and are allowed; rows with equal id and text are one. NULL and empty texts, and those without a
    letter, digit or non-ASCII character, belong to no group. No pair of alike texts is lost. Texts of fewer than SHINGLE words are alike if equal but for
    case and punctuation. Very long texts are sketched and verified whole. A pair whose similarity ties with the threshold is alike.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    rows = scratch.table(sketch_table(docs, id_col, text_col), "rows")
    place = F.struct("doc_id", "th")
    nodes = rows.groupBy("d1", "d2").agg(F.min(place).alias("p"), F.first("sketch").alias("sketch"))
    nodes = scratch.table(nodes.select(F.monotonically_increasing_id().alias("v"), "d1", "d2", "p", "sketch"), "nodes")
    every = nodes.select("v", F.posexplode("sketch").alias("band", "key"))
    shared = every.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    members = scratch.table(every.join(shared.hint("merge"), ["band", "key"]), "members")
    # texts of the nodes; met: in any shared bucket, so the rounds may verify them
    met = members.select("v").distinct().withColumn("met", F.lit(True))
    wanted = nodes.select("v", "p").join(met.hint("merge"), "v", "left").select("v", F.col("met").isNotNull().alias("met"), F.col("p.doc_id").alias("_i"), F.col("p.th").alias("_t"))
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_d"), F.xxhash64(f"`{text_col}`").alias("_h"), F.col(f"`{text_col}`").alias("text"))
    texts = source.join(wanted.hint("shuffle_hash"), (F.col("_h") == F.col("_t")) & F.col("_d").eqNullSafe(F.col("_i"))).select("v", "met", "text")
    every_text = scratch.table(texts.groupBy("v", "met").agg(F.first("text").alias("text")) if _repeats(rows) else texts, "texts0")
    texts = every_text.filter("met").select("v", "text")
    sketches = nodes.select("v", "sketch")
    margin = SLACK * math.sqrt(threshold * (1 - threshold) / M)
    beside = lambda left, side, table, name: left.join(table.withColumnsRenamed({"v": side, name: f"{name}_{side}"}).hint("merge"), side)
    verified = lambda pairs, texts: beside(beside(pairs, "a", texts, "text"), "b", texts, "text").filter(_verify("text_a", "text_b") >= threshold).select("a", "b")
    found = tried = roots = None
    n = 0
    while True:
        starred = scratch.table(_stars(members, WIDEN**n), f"stars{n}")
        if n and not starred.take(1):
            break
        pairs = starred.filter("root <> other").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        pairs = scratch.table(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti") if n else pairs, f"pairs{n}")
        tried = tried.union(pairs) if n else pairs
        guess = beside(beside(pairs, "a", sketches, "sketch"), "b", sketches, "sketch")
        guess = scratch.table(guess.select("a", "b", (_estimate("sketch_a", "sketch_b") >= threshold - margin).alias("likely")), f"guess{n}")
        good = scratch.table(verified(guess.filter("likely").select("a", "b"), texts), f"good{n}")
        links = good.select(F.col("a").alias("u"), F.col("b").alias("v"))
        found = found.union(good) if n else good
        if not n or good.take(1):
            roots = _components(links.union(roots.select(F.col("root").alias("u"), "v")) if n else links, scratch, f"cc{n}_")
        # leaders have met their whole buckets; the others meet again while they belong to several groups
        left = starred.filter(~F.col("leads")).select("band", "key", "v").distinct()
        now = scratch.table(_open(left, roots, found), f"open{n}")
        members = now
        if n + 1 == SPLIT_ROUND:
            buckets = scratch.table(_wide(now), "buckets")
            if buckets.take(1):
                members = scratch.table(now.join(buckets.hint("merge"), ["band", "key"], "left_anti"), f"members{n}")
        if not n:  # few are left, so what later rounds read of them is set apart
            still = members.select("v").distinct().hint("merge")
            texts, sketches = (scratch.table(x.join(still, "v", "left_semi"), f"{name}1") for x, name in ((texts, "texts"), (sketches, "sketches")))
            scratch.drop("members")
        scratch.drop(f"stars{n}")
        n += 1
    # what the rounds left open
    scratch.drop("members", "texts1", "sketches1", "buckets", *(f"{x}{m}" for x in ("stars", "pairs", "guess", "good", "open", "members") for m in range(n + 1)))
    scratch.release()
    groups = roots.union(roots.select("root", "root").distinct())
    grouped = every_text.select("v", "text").join(groups.hint("merge"), "v", "left").select("v", F.coalesce("root", "v").alias("root"), F.col("root").isNotNull().alias("grouped"), "text")
    chars = every_text.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    rest = scratch.table(_possible(grouped, threshold, 1 + chars // PART), "rest")
    scratch.release()
    if rest.take(1):
        last = scratch.table(grouped.join(rest.hint("merge"), "v", "left_semi").select("v", "root", "text"), "texts2")
        scratch.drop("texts0")
        scratch.release()
        sets = scratch.table(_sets(last), "sets")
        good = scratch.table(verified(_alike(sets, threshold, scratch), last.select("v", "text")), "good")
        if good.take(1):
            roots = _components(good.select(F.col("a").alias("u"), F.col("b").alias("v")).union(roots.select(F.col("root").alias("u"), "v")), scratch, "cc_")
    group = nodes.select("v", "d1", "d2").join(roots.hint("merge"), "v", "left").select("d1", "d2", F.coalesce("root", "v").alias("root"))
    placed = rows.select("doc_id", "th", "d1", "d2").distinct().join(group.hint("merge"), ["d1", "d2"]).select("doc_id", "th", "root")
    first = placed.groupBy("root").agg(F.min(place).alias("keeper"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    out = placed.join(first.hint("merge"), "root").filter(~place.eqNullSafe(F.col("keeper")))
    out = scratch.table(out.select("doc_id", "th", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.th").alias("keeper_th")), "groups")
    scratch.drop("rows", "nodes", "texts0", "texts2", "rest", "sets", "first", "good")
    return out


def _repeats(rows: DataFrame) -> bool:
    """Whether any (doc_id, th) is there twice."""
    return bool(rows.groupBy("doc_id", "th").count().filter("count > 1").take(1))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """docs without near duplicates: one document of each group stays, with all its columns.

    The first by (doc_id, hash of the text), NULL ids first, stays; rows with equal id and text are kept or dropped together. Rows of no
    group stay, such as those with NULL or empty texts; very long texts are compared whole. Columns of any name are kept, an empty
    table gives an empty result.
    """
    i, h = fresh(docs, "_nd_id"), fresh(docs, "_nd_th")
    gone = near_duplicates(docs, id_col, text_col, threshold, scratch).select(F.col("doc_id").alias(i), F.col("th").alias(h))
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64(f"`{text_col}`") == F.col(h))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")
