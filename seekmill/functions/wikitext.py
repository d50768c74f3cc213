"""Wikitext to plain text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column

from seekmill.functions import pieces

_DROPPED = ("file", "image", "category", "media", "datei", "bild", "kategorie", "fichier", "catégorie", "archivo", "categoría")
_INTERWIKI = re.compile(r"^:?[a-z]{2,3}(-[a-z]+)*:[^ ]", re.I)


def _nested(text: str, opened: str, closed: str) -> str:
    """text without balanced spans; an unclosed one is cut to the end."""
    out, depth, at = [], 0, 0
    for m in re.finditer(f"{re.escape(opened)}|{re.escape(closed)}", text):
        if not depth:
            out.append(text[at : m.start()])
        if m[0] == opened:
            depth += 1
        elif depth:
            depth -= 1
        else:
            out.append(m[0])
        at = m.end()
    return "".join(out) + ("" if depth else text[at:])


def _links(text: str) -> str:
    """[[target|label]] -> label; files, categories and other wikis' pages vanish; links may nest."""
    def one(m: re.Match) -> str:
        target, _, label = m[1].partition("|")
        space = target.strip().lower().partition(":")[0]
        if ":" in target and (space in _DROPPED or _INTERWIKI.match(target.strip())):
            return ""
        return (label.rpartition("|")[2] if label else target.lstrip(":")).strip()

    while True:
        new = re.sub(r"\[\[([^\[\]]*)\]\]", one, text)
        if new == text:
            return text
        text = new


def plain_text(source: str | None, strict: bool = False) -> str:
    """Comments, references, tables, templates, links, emphasis and rules go; by default so do headings' and lists' marks,
    external links, magic words and tags. strict=True leaves those as they are, as the reference behaviour does."""
    t = re.sub(r"<!--.*?(-->|$)", "", source or "", flags=re.S)
    t = re.sub(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "", t, flags=re.S | re.I)
    t = _nested(_nested(t, "{|", "|}"), "{{", "}}")
    t = _links(t)
    t = re.sub(r"'{2,5}|^-{4,}", "", t, flags=re.M)
    if not strict:
        t = re.sub(r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]]*))?\]", lambda m: m[1] or "", t)
        t = re.sub(r"^(={1,6})\s*(.*?)\s*\1\s*$", r"\2", t, flags=re.M)
        t = re.sub(r"^[*#:;]+\s*", "", t, flags=re.M)
        t = re.sub(r"__[A-Z]+__", "", t)
        t = re.sub(r"</?[a-z][^>]*>", "", t, flags=re.I)
    lines = [" ".join(x.split()) for x in t.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def wikitext_to_text(source: Column, strict: bool = False) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([plain_text(t, strict) for t in texts], dtype="object")

    return pieces.udf(run, "string", source)
