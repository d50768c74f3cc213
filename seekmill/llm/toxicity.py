"""Toxicity by noisy-channel deobfuscation (operator 2).

A character trigram model is counted over all documents. Spans in which letters may be written in disguise (digits and signs for
letters, wherever they stand, letters repeated, letters spaced out, zero-width signs) become lattices of what each sign may
stand for; Viterbi decoding under the model, with a cost for every disguise assumed, restores the likeliest text. Other text
has one reading only and stays. Documents are scored with terms learned from labelled ones, found in the text or in the restored text. Tokens without
a letter (numbers) have no lattice.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents the terms are learned from: all if there are fewer, else those with the smallest hashes of their ids.
MAX_TRAIN_ROWS = 20_000
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
LEET_COST, DROP_COST, RUN_COST, PAIR_COST = 1.5, 0.7, 0.7, 2.0
#: Natural log of the chance, under no association, up to which a term counts as toxic.
MAX_LOG_P = -12.0
CACHE_SPANS = 200_000

_SYMBOLS = 64  # 0 no letter, 1 another letter, 2 digit, then letters
_ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0xF7))) + "".join(map(chr, range(0xF8, 0x100))) + "œ"
_ID = {c: 3 + i for i, c in enumerate(_ALPHABET)}
_LUT = np.array([_ID.get(chr(c), 2 if chr(c).isdigit() else 1 if chr(c).isalpha() else 0) for c in range(0x250)], np.uint8)
_X = "".join(re.escape(c) for c in LEET)
_L = r"[^\W\d_]"
_SPACED = re.compile(rf"(?:{_L}|[{_X}])(?:[ .\-_*/]{{1,2}}(?:{_L}|[{_X}]))+").fullmatch
_FLAG_LETTER, _FLAG_LEET, _FLAG_SEP, _FLAG_OTHER = 1, 2, 4, 8
_flags: list[np.ndarray] = []
#: Signs of no width, which may stand inside words.
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_DROP_HIDDEN = re.compile(f"[{_HIDDEN}]+")
def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(codes: np.ndarray) -> np.ndarray:
    out = _LUT[np.minimum(codes, len(_LUT) - 1)]
    if len(codes) and codes.max() >= len(_LUT):
        out[codes >= len(_LUT)] = 1
        out[codes == 0x153] = _ID["œ"]
    return out


def _flag_table() -> np.ndarray:
    """What each character may be in a span; made once a worker."""
    if not _flags:
        kind = lambda c: _FLAG_LEET if c in LEET else _FLAG_LETTER if c.isalpha() else _FLAG_SEP if c in " .-_*/" else _FLAG_OTHER if c.isalnum() else 0
        _flags.append(np.fromiter(map(kind, map(chr, range(0x110000))), np.uint8, 0x110000))
    return _flags[0]


def find_spans(text: str) -> list[tuple[int, int]]:
    """Where a text may be disguised, in linear time: runs of letters and signs that hold both, or the same letter twice in a row, and
    four or more single letters or signs with one or two separators between any two."""
    codes = _codes(text)
    flags = _flag_table()[codes]
    letter = flags == _FLAG_LETTER
    sign = letter | (flags == _FLAG_LEET)
    edge = np.flatnonzero(np.diff(sign.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    letters = np.concatenate([[0], np.cumsum(letter)])
    twice = np.concatenate([[0, 0], np.cumsum(letter[1:] & (codes[1:] == codes[:-1]))])
    own = letters[end] - letters[begin]
    run = ((own > 0) & (own < end - begin)) | (twice[end] > twice[begin + 1])
    spans = list(zip(begin[run].tolist(), end[run].tolist()))
    other = np.concatenate([[False], flags == _FLAG_OTHER, [False]])
    lone = begin[(end - begin == 1) & ~other[begin] & ~other[begin + 2]]
    if len(lone) > 3:
        sep, gap = flags == _FLAG_SEP, np.diff(lone)
        near = sep[lone[:-1] + 1] & ((gap == 2) | ((gap == 3) & sep[np.minimum(lone[:-1] + 2, len(sep) - 1)]))
        edge = np.flatnonzero(np.diff(near.view(np.int8), prepend=0, append=0))
        spans += [(int(lone[a]), int(lone[b]) + 1) for a, b in zip(edge[::2], edge[1::2]) if b - a > 2]
        spans.sort()
    return spans


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts [64, 64, 64] of character trigrams of all lower-cased texts, runs of non-letters being one blank. Partial sums per task, one shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                ids = _symbols(_codes("\n\n".join(["", *pdf["text"].iloc[at : at + 128].str.lower(), ""])))
                ids = ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])].astype(np.int32)
                total += np.bincount((ids[:-2] << 12) + (ids[1:-1] << 6) + ids[2:], minlength=_SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pd.DataFrame({"code": code, "n": total[code]})

    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).filter("text <> ''").mapInPandas(run, "code bigint, n bigint")
    cube = np.zeros(_SYMBOLS**3, np.int64)
    for code, n in parts.groupBy("code").agg(F.sum("n")).toPandas().to_numpy():  # at most 64 ** 3 rows
        cube[code] = n
    return cube.reshape((_SYMBOLS,) * 3)


class CharModel:
    """Interpolated trigram model; log probabilities by (before last, last, next) symbol."""

    def __init__(self, cube: np.ndarray, strength: float = 5.0):
        c3 = cube.astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * _SYMBOLS)
        p2 = (c2 + strength * p1) / (c2.sum(1, keepdims=True) + strength)
        p3 = (c3 + strength * p2) / (c3.sum(2, keepdims=True) + strength)
        self.cost = (-np.log(p3)).ravel().tolist()
        self.cache: dict[str, str] = {}

    def __reduce__(self):
        return (_restore_model, (np.array(self.cost, np.float32),))

    def lattice(self, span: str) -> Iterator[list[tuple[str, float]]]:
        """For each place of the span the strings it may stand for and their costs."""
        spaced = _SPACED(span) is not None
        i = 0
        while i < len(span):
            c, j = span[i], i + 1
            while j < len(span) and span[j] == c:
                j += 1
            n = j - i
            options = [(c * n, 0.0)]
            if c in LEET:
                for x in LEET[c]:
                    options += [(x * m, LEET_COST * min(n, 2) + RUN_COST * (m != n)) for m in ((n,) if n == 1 else (1, 2))]
            elif c.isalpha() and n > 2:
                options = [(c, RUN_COST), (c + c, RUN_COST), *options]
            elif c.isalpha() and n == 2:
                options = [(c, PAIR_COST), *options]
            elif spaced and not c.isalnum():
                options = [(" ", 0.0), ("", DROP_COST / 4)]
            yield options
            i = j

    def decode(self, span: str) -> str:
        """The likeliest reading of a span (lower case), by exact Viterbi search over the lattice; of equally likely ones the first in order.

        Linear in the span: paths are kept as links to their beginnings, and what all paths share is written out.
        """
        if span in self.cache:
            return self.cache[span]
        cost = self.cost
        done: list[str] = []
        beams: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # state: the last two symbols; path: (path before, string)
        for options in self.lattice(span):
            if len(beams) == 1:
                (state, (_, path)), *_ = beams.items()
                done.append(_spell(path))
                if len(options) == 1:  # no choice, so no cost tells anything
                    for ch in options[0][0]:
                        x = _symbol(ch)
                        if x or state & 63:
                            state = (state & 63) << 6 | x
                    done.append(options[0][0])
                    beams = {state: (0.0, None)}
                    continue
                beams = {state: (0.0, None)}
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (total, path) in beams.items():
                for string, price in options:
                    s, t = state, total + price
                    for ch in string:
                        x = _symbol(ch)
                        if x == 0 and s & 63 == 0:
                            continue
                        t += cost[(s << 6) + x]
                        s = (s & 63) << 6 | x
                    if s not in after or t < after[s][0]:
                        after[s] = (t, (path, string))
            beams = after
        done.append(min((t + (cost[s << 6] if s & 63 else 0.0), _spell(path)) for s, (t, path) in beams.items())[1])
        best = "".join(done)
        if len(self.cache) < CACHE_SPANS and len(span) < 64:
            self.cache[span] = best
        return best

    def restore(self, texts: list[str]) -> list[str]:
        """Lower-cased texts with their disguised spans decoded, and without signs of no width."""
        joined = "\n".join(texts)
        if _DROP_HIDDEN.search(joined):
            texts = [_DROP_HIDDEN.sub("", t) for t in texts]
            joined = "\n".join(texts)
        changed: dict[int, list] = {}
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(1, int)
        spans = find_spans(joined)
        owners = np.searchsorted(begins, [b for b, _ in spans], side="right") - 1
        for (begin, end), i in zip(spans, owners.tolist()):
            span = joined[begin:end]
            if (best := self.decode(span)) != span:
                changed.setdefault(i, []).append((begin - int(begins[i]), end - int(begins[i]), best))
        out = list(texts)
        for i, edits in changed.items():
            parts, at = [], 0
            for begin, end, best in edits:
                parts += [texts[i][at:begin], best]
                at = end
            out[i] = "".join([*parts, texts[i][at:]])
        return out


def _symbol(ch: str) -> int:
    return _ID.get(ch) or (2 if ch.isdigit() else 1 if ch.isalpha() else 0)


def _spell(path: tuple | None) -> str:
    out = []
    while path:
        path, string = path
        out.append(string)
    return "".join(reversed(out))


def _restore_model(cost: np.ndarray) -> CharModel:
    model = CharModel.__new__(CharModel)
    model.cost, model.cache = cost.astype(np.float64).tolist(), {}
    return model


@dataclass
class Terms:
    """Whole words and word beginnings (ending in *) with their log odds; base is the log odds of a document without any."""

    weights: dict[str, float]
    base: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term in self.weights:
            a.add_word(term.rstrip("*"), (len(term.rstrip("*")), term.endswith("*"), term))
        if self.weights:
            a.make_automaton()
        return a

    def find(self, automaton, text: str) -> set[str]:
        """The terms of a lower-cased text: whole words, and beginnings of words that aren't terms themselves."""
        found: dict[int, str] = {}  # a word counts once, with its longest match
        for end, (n, prefix, term) in automaton.iter(text):
            begin = end - n + 1
            if (begin and text[begin - 1].isalpha()) or (not prefix and end + 1 < len(text) and text[end + 1].isalpha()):
                continue
            if begin not in found or len(term) > len(found[begin]):
                found[begin] = term
        return set(found.values())


_WORDS = re.compile(rf"{_L}+")


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in range(4, 9) if len(word) > n)]


def learn_terms(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> Terms:
    """Words and word beginnings that go with the label, from at most max_rows labelled documents.

    A term is counted by documents; toxic ones count by the different neighbourhoods of the term (the words beside it, one pair a
    document), so that copies of one document count once. It is kept if that many would come about by chance with at most
    exp(MAX_LOG_P), and four in five are toxic. A document with several labels counts as toxic if any says so.
    """
    lab = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text <> ''").join(F.broadcast(lab), "_id")  # bounded by max_rows

    def toxic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: set[tuple[str, int]] = set()
            for text in pdf["text"]:
                ws = ["", *_WORDS.findall(text.lower()), ""]
                one: dict[str, int] = {}
                for i in range(1, len(ws) - 1):
                    around = hash_pair(ws[i - 1], ws[i + 1])
                    for f in _features(ws[i]):
                        one[f] = min(one.get(f, around), around)
                seen.update(one.items())
            yield pd.DataFrame(list(seen), columns=["f", "c"])

    pos = rows.filter("_y > 0").select("text").mapInPandas(toxic, "f string, c bigint").groupBy("f").agg(F.count_distinct("c").alias("a")).filter("a >= 3").toPandas()
    candidates = set(pos["f"])

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        n = 0
        for pdf in batches:
            for text in pdf["text"]:
                n += 1
                for f in {f for w in set(_WORDS.findall(text.lower())) for f in _features(w)} & candidates:
                    counts[f] = counts.get(f, 0) + 1
        yield pd.DataFrame({"f": ["", *counts], "b": [n, *counts.values()]})

    neg = rows.filter("_y <= 0").select("text").mapInPandas(clean, "f string, b bigint").groupBy("f").agg(F.sum("b").alias("b")).toPandas()
    b = dict(zip(neg["f"], neg["b"]))
    others = b.get("", 0)
    n_toxic = rows.filter("_y > 0").count()
    if not n_toxic:
        return Terms({}, 0.0)
    share, base = (n_toxic + 0.5) / (n_toxic + others + 1), math.log((n_toxic + 0.5) / (others + 0.5))
    weights = {}
    for f, a in zip(pos["f"], pos["a"]):
        n, other = a + b.get(f, 0), b.get(f, 0)
        q = a / n
        if a < 4 * other or q <= share:
            continue
        log_p = -n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))  # Chernoff bound
        if log_p <= MAX_LOG_P:
            weights[f] = math.log((a + 0.5) / (other + 0.5)) - base
    return Terms(weights, base)


def hash_pair(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{a} {b}") >> 1


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.9) -> DataFrame:
    """(doc_id, score, toxic, terms) of every row: the probability that the restored text is toxic, rounded to 6 places, whether it
    reaches the threshold, and the terms found, sorted.

    The character model counts all texts; terms are learned from labelled documents. NULL and empty texts score 0.0, with
    no terms; so does everything if there are no toxic labels. Very long texts, and very long words, are decoded whole, in time linear in
    them. Repeated rows and NULL ids are scored each, equal texts alike; a score that ties with the threshold is toxic, of equally likely
    readings the first in order counts. Other columns are ignored; an empty table gives an empty result.
    """
    model = CharModel(trigram_counts(docs, text_col))
    terms = learn_terms(docs, labels, id_col, text_col, label_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = terms.automaton()
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at : at + 128]
                texts = [t.lower() if t else "" for t in part["text"]]
                found = [sorted(terms.find(automaton, t) | (terms.find(automaton, r) if r != t else set())) if terms.weights and t else [] for t, r in zip(texts, model.restore(texts))]
                odds = [terms.base + sum(terms.weights[f] for f in fs) for fs in found]
                score = [round(1 / (1 + math.exp(-max(-700, min(700, o)))), 6) if fs else 0.0 for o, fs in zip(odds, found)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": score, "toxic": [s >= threshold for s in score], "terms": found})

    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id bigint, score double, toxic boolean, terms array<string>")
