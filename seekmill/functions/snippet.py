"""Query-focused snippets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FRAGMENTS = re.compile(r"[|\t]|\n{2,}")
_ENDS = re.compile(r"[.!?](?=\s(?:[^\W\d_]|$)|$)")


def sentences_of(text: str) -> list[str]:
    out = []
    for fragment in filter(None, map(str.strip, _FRAGMENTS.split(text))):
        begin = 0
        for m in _ENDS.finditer(fragment):
            after = fragment[m.end() + 1 : m.end() + 2]
            if not after or after.isupper():
                out.append(fragment[begin : m.end()].strip())
                begin = m.end()
        out.append(fragment[begin:].strip())
    return [s for s in out if s]


def prose_quality(sentence: str, index: int, total: int) -> float:
    """How much like prose: a quarter each for length and mean word length, 0.35 for letters, 0.15 for a place before the middle."""
    n, ws = len(sentence), sentence.split()
    length = n / 30 if n < 30 else 300 / n if n > 300 else 1.0
    mean = sum(map(len, ws)) / len(ws) if ws else 0.0
    shape = mean / 3 if mean < 3 else 8 / mean if mean > 8 else 1.0
    letters = sum(c.isalpha() or c == " " for c in sentence) / n if n else 0.0
    place = 1.0 if total <= 1 else 1.0 - abs(index / (total - 1) - 0.4) * 0.5
    return 0.25 * length + 0.25 * shape + 0.35 * letters + 0.15 * place


def cut(text: str, limit: int) -> str:
    """At most limit bytes, at a word's end, with dots if cut."""
    raw = text.encode()
    if len(raw) <= limit:
        return text
    if limit < 4:
        return raw[:limit].decode(errors="ignore")
    head = raw[: limit - 3].decode(errors="ignore")
    return (head[: head.rfind(" ")] if " " in head else head) + "..."


def snippet_of(query: str, content: str | None, limit: int = 200) -> str | None:
    """The sentences that hold most of the query's terms (as substrings), best first, up to limit bytes; without any
    match the one most like prose. NULL for an empty query or content."""
    found = sentences_of(content or "") if query else []
    if not found:
        return None
    terms = set(query.lower().split())
    if not terms:
        return cut(found[0], limit)
    hits = [sum(t in s.lower() for t in terms) for s in found]
    if not any(hits):
        return cut(found[max(range(len(found)), key=lambda i: (prose_quality(found[i], i, len(found)), i))], limit)
    order = sorted(range(len(found)), key=lambda i: (-hits[i], i))
    text = found[order[0]]
    for i in order[1:]:
        if len(text.encode()) + len(found[i].encode()) + 1 > limit:
            break
        text = f"{text} {found[i]}"
    return cut(text, limit)


def snippet(query: Column, content: Column, limit: int = 200) -> Column:
    """An Arrow UDF; meant for the few rows of an answer, not for the corpus."""

    def run(qs: pd.Series, cs: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(q, c, limit) for q, c in zip(qs, cs)], dtype="object")

    return F.pandas_udf(run, "string")(query, content)
