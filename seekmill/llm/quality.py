"""Quality classifier: a sparse ensemble of rules over text statistics (operator 6).

Boosted shallow trees are grown on statistics of labelled documents; every path from a root to a node is a
conjunctive rule. A logistic regression with an L1 penalty on the rules' 0/1 columns keeps few of them, and those are
compiled to one Spark column expression, so scoring runs inside the JVM over whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.functions.text import let
from seekmill.llm.common import fresh

#: Labelled documents that train the model: all if there are fewer, else those with the smallest hashes of their ids.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.5
NAMES = "chars word_length symbols stops commas shouts bars digits capitals distinct_words distinct_lines words_per_line".split()


def statistics(text: Column) -> Column:
    """Statistics of a whole text, a structure of the doubles NAMES; NULL counts as empty. Words stand between ASCII white space.
    What several statistics need is bound once a row."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(t)

    def of(signs: Column, pieces: Column, words: Column, lines: Column) -> Column:
        n, n_lines = F.size(words), F.size(lines)
        per = lambda pattern: F.regexp_count(signs, F.lit(pattern)) / F.greatest(chars, F.lit(1))
        found = (
            F.log1p(chars.cast("double")),
            (chars - F.size(pieces) + 1) / F.greatest(n, F.lit(1)),
            per(r"[#*%&$@~^_=+<>\\/{}\[\]]"),
            per(r"[.!?]"),
            per(r"[,;:]"),
            per("!"),
            per(r"\|"),
            per("[0-9]"),
            per(r"\p{Lu}"),
            F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)),
            F.size(F.array_distinct(lines)) / n_lines,
            F.log1p(n / n_lines),
        )
        return F.struct(*(c.cast("double").alias(name) for name, c in zip(NAMES, found)))

    signs = F.regexp_replace(t, "[a-z \n]+", "")  # none of these is counted, and the rest is short
    with_words = lambda s, p: let(F.array_remove(p, ""), lambda w: let(F.split(t, "\n"), lambda x: of(s, p, w, x)))
    return let(signs, lambda s: let(F.split(t, r"[ \t\n\x0B\f\r]"), lambda p: with_words(s, p)))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, True: above / False: at most, bound)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, bound in self.conditions:
            v = x[:, names.index(name)]
            out &= (v > bound) if above else (v <= bound)
        return out

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, ((stats[n] > F.lit(t)) if above else (stats[n] <= F.lit(t)) for n, above, t in self.conditions))


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def probability(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights):
            z += w * r.holds(x, names)
        return 1 / (1 + np.exp(-z))


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], names: list[str], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, least: int, rules: list, step: np.ndarray, rate: float) -> None:
    """One node of a boosted tree: records its path, splits it or moves its rows' margins."""
    if path:
        rules.append(Rule(path))
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for f in range(x.shape[1]):
            n = len(edges[f])
            if not n:
                continue
            b = bins[rows, f]
            gs, hs, cs = (np.cumsum(np.bincount(b, w, n + 1))[:-1] for w in (grad[rows], hess[rows], None))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(cs < least) | (len(rows) - cs < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at)
    if best[1] is None:
        step[rows] += rate * g / (h + 1)
        return
    _, f, at = best
    bound = float(edges[f][at])
    low = bins[rows, f] <= at
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _grow(x, bins, edges, names, grad, hess, part, (*path, (names[f], above, bound)), depth - 1, least, rules, step, rate)


def _simplify(rule: Rule) -> Rule:
    """At most one lower and one upper bound a statistic, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for n, above, t in rule.conditions:
        best[n, above] = (max if above else min)(t, best.get((n, above), t))
    return Rule(tuple(sorted((n, a, t) for (n, a), t in best.items())))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on the 0/1 columns z (the intercept is free), by accelerated proximal gradient."""
    n, k = z.shape
    w, b = np.zeros(k), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    v, c, t = w.copy(), b, 1.0
    vec = np.random.default_rng(0).standard_normal(k)
    for _ in range(20):  # largest curvature
        vec = z.T @ (z @ vec)
        vec /= np.linalg.norm(vec) or 1.0
    rate = 1.0 / (0.25 * (np.linalg.norm(z @ vec) ** 2 / n + 1.0) + 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
        r = (p - y) / n
        new = v - rate * (z.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb, nt = c - rate * r.sum(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, penalty: float = 5e-4, steps: int = 400, seed: int = 3) -> RuleModel:
    """A rule model of y (0/1) on the statistics x. Of a single class, or no rows: no rules, everything gets that class (1 if no rows)."""
    if not len(y) or y.min() == y.max():
        return RuleModel(10.0 if not len(y) or y[0] else -10.0, [], [])
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50), method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    margin = np.zeros(len(y))
    rules: list[Rule] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess, step = y - p, p * (1 - p), np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        if not len(rows):
            continue
        _grow(x, bins, edges, names, grad, hess, rows, (), depth, max(3, len(y) // 500), rules, step, 0.3)
        margin += step
    unique: dict[bytes, Rule] = {}
    for r in dict.fromkeys(map(_simplify, rules)):
        held = r.holds(x, names)
        if 2 < held.sum() < len(y) - 2:
            unique.setdefault(np.packbits(held if held[0] else ~held).tobytes(), r)
    chosen = list(unique.values())
    if not chosen:
        return RuleModel(10.0 if y.mean() >= 0.5 else -10.0, [], [])
    z = np.stack([r.holds(x, names) for r in chosen], 1).astype(np.float64)
    b, w = _lasso(z, y.astype(np.float64), penalty, steps)
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return RuleModel(b, [chosen[i] for i in kept], [float(w[i]) for i in kept])


def log_odds(text: Column, model: RuleModel) -> Column:
    """The model's log odds of a text. The statistics are bound once a row, so that a filter on the result doesn't repeat
    them for each rule, and the rules are no part of the generated code, whose size is limited."""
    if not model.rules:
        return F.lit(model.intercept)
    return let(statistics(text), lambda s: reduce(lambda a, b: a + b, (F.when(r.column(s), F.lit(w)).otherwise(0.0) for r, w in zip(model.rules, model.weights)), F.lit(model.intercept)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> RuleModel:
    """Fit on at most max_rows labelled documents (statistics of whole texts; a few numbers a row reach the driver).
    A document with several labels counts with the lowest, one with several rows once, with the smallest statistics; NULL ids,
    labels and texts don't train. The model depends on no order of rows."""
    lab = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y"))
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).filter("_text IS NOT NULL")
    x = let(statistics(F.col("_text")), lambda q: F.array(*(q[n] for n in NAMES)))
    rows = texts.join(F.broadcast(lab), "_id").select("_id", "_y", x.alias("x"))  # max_rows bounds the broadcast
    rows = rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.min("x").alias("x")).toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    y = (rows["_y"].to_numpy() > 0).astype(np.int64)
    order = np.lexsort((*x.T, y))  # rows come in any order; the model doesn't depend on it
    return fit_rules(x[order], y[order], NAMES)


def _cut(threshold: float) -> float:
    """The log odds of a probability."""
    return -math.inf if threshold <= 0 else math.inf if threshold >= 1 else math.log(threshold / (1 - threshold))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score", keep_col: str = "keep", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the probability of good quality (rounded to 6 places) and whether it reaches the threshold, before rounding.

    NULL and empty texts are scored as texts without words are; texts of any length are read whole. Repeated rows and NULL ids are
    scored each; equal texts get equal scores, and a score that ties with the threshold is kept. The new columns get underscores
    in front where their names are taken. An empty table gives an empty result.
    """
    z = fresh(docs, "_z")
    s, k = fresh(docs, score_col), fresh(docs, keep_col)
    scored = docs.withColumn(z, log_odds(F.col(f"`{text_col}`"), model))
    return scored.withColumns({s: F.round(1 / (1 + F.exp(-F.col(z))), 6), k: F.col(z) >= F.lit(_cut(threshold))}).drop(z)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier, trained on those of them that are labelled, doesn't reject, with all their columns.

    Rows are judged one by one, as in score(): NULL and empty texts as texts without words, very long ones whole, NULL ids and repeated
    rows each, ties with the threshold stay. Without labels, or with labels of good documents only, all stay. An empty table gives
    an empty result; no column is added, so no name can clash.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    return docs.filter(log_odds(F.col(f"`{text_col}`"), model) >= F.lit(_cut(threshold)))
