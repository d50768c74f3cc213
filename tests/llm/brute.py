"""Plain Python versions of the operators, and rows that try them."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark: SparkSession, rows: list[tuple], extra: str = "") -> DataFrame:
    """Documents of (doc_id, text, source); extra names further columns, filled with 'x'."""
    names = [n for n in extra.split() if n]
    data = [(i, t, "en", s, len(t or ""), *("x" for _ in names)) for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA + "".join(f", `{n}` string" for n in names))


def nasty(spark: SparkSession, extra: str = "") -> DataFrame:
    """NULLs in every column, empty and very long texts, repeated rows."""
    long = " ".join(f"w{n}" for n in range(60_000))
    prose = "One plain sentence stands here.\nAnother one follows it, and it is longer.\n"
    return table(spark, [(1, prose, "a"), (1, prose, "a"), (2, None, "a"), (3, "", "b"), (None, prose, None), (4, long, "b"), (5, " \n\t ", None), (6, "ß ñ 漢字 🎈", "a"), (None, None, None)], extra)


def shingles(text: str, n: int = 3) -> set[tuple[str, ...]]:
    words = re.sub(r"[^\w\s\u0080-\U0010ffff]|_", " ", text.lower()).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near(rows: list[tuple[int, str]], threshold: float) -> dict[int, int]:
    """doc -> first of its group, for those that aren't the first themselves."""
    parent = {i: i for i, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t or "")) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent if root(i) != i}


def lines(rows: list[tuple[int, str]], min_words: int) -> dict[int, str]:
    """Texts without later copies of any run of lines of at least min_words words: every two places are laid beside each other."""
    found = [(doc, text.split("\n")) for doc, text in sorted(rows) if text]
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    gone = defaultdict(set)
    for n, (doc, ls) in enumerate(found):
        words = [len(x.split()) for x in ls]
        for i, line in enumerate(ls):
            for m, k in places[line]:
                other, size = found[m][1], 0
                while i + size < len(ls) and k + size < len(other) and ls[i + size] == other[k + size]:
                    size += 1
                if sum(words[i : i + size]) >= min_words:
                    gone[doc].update(range(i, i + size))
            places[line].append((n, i))
    return {doc: "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[doc]) if text else text for doc, text in rows}


def mix(rows: list[tuple[int, str, str]], alpha: float = 0.7, seed: int = 17) -> dict[int, int]:
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len(WORD.findall(text or ""))
    most, out = max(tokens.values()), {}
    for doc, _, source in rows:
        rate = round((most / tokens[source]) ** (1 - alpha), 6) if tokens[source] else 1.0
        u = int(hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()[:8], 16) / 2**32
        out[doc] = int(rate) + (u < rate - int(rate))
    return out


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """Bins by trying every place of every item and summing the squares anew."""
    gaps: list[int] = []
    touched: list[int] = []
    out, clock = [], 0
    for s in sizes:
        best = None
        for gap in sorted({g for g in gaps if g >= s}) + [None]:
            counts = Counter(g for g in gaps if 0 < g < capacity)
            if gap is not None and gap < capacity:
                counts[gap] -= 1
            left = (capacity if gap is None else gap) - s
            if 0 < left < capacity:
                counts[left] += 1
            key = (sum(c * c for c in counts.values()), gap is None, gap or 0)
            if best is None or key < best[0]:
                best = (key, gap)
        clock += 1
        if best[1] is None:
            gaps.append(capacity - s)
            touched.append(clock)
            out.append(len(gaps) - 1)
        else:
            b = max((i for i, g in enumerate(gaps) if g == best[1]), key=lambda i: touched[i])
            gaps[b] -= s
            touched[b] = clock
            out.append(b)
    return out


def cuts(data: bytes, gear: list[int], strict: int, loose: int, low: int, normal: int, high: int) -> list[int]:
    """Chunk ends by a rolling gear hash, a byte at a time."""
    out, begin, mask32 = [], 0, (1 << 32) - 1
    hashes, h = [], 0
    for b in data:
        h = ((h << 1) + gear[b]) & mask32
        hashes.append(h)
    while begin < len(data):
        end = len(data)
        for at in range(begin + low - 1, min(begin + high, len(data))):
            bits = strict if at < begin + normal - 1 else loose
            if hashes[at] >> (32 - bits) == 0 or at == begin + high - 1:
                end = at + 1
                break
        if len(data) - begin <= low:
            end = len(data)
        out.append(end)
        begin = end
    return out


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))
