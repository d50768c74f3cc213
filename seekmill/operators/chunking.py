"""Section-aware chunking within a token budget.

Packing is sequential within a section, so it runs in an Arrow-batched map over whole documents (no shuffle, no group);
neighbours are linked inside the same map.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekmill.functions import pieces

_HEADING = re.compile(r"^\s*(#{1,6})(?!#)\s*(.*?)\s*#*\s*$")
_SENTENCE = re.compile(r"\n{2,}|[.!?](?=\s|$) *|\n")
_WORD = re.compile(r"\w+(?:['’.]\w+)*")
_CJK = re.compile("[一-鿿㐀-䶿豈-﫿぀-ヿ가-힯]")


def heuristic_count(text: str) -> int:
    """B14 in Python, for use inside the splitter."""
    tenths = 0
    for w in _WORD.findall(text):
        cjk = 0 if w.isascii() else len(_CJK.findall(w))
        other = len(w) - cjk
        tenths += 10 * cjk + (10 + min(other, 10) if other else 0)
    return -(-tenths // 10)


@dataclass(frozen=True)
class ChunkConfig:
    chunk_size: int = 512
    overlap: float = 0.15
    min_size: int = 50


def sections_of(text: str) -> list[tuple[list[str], str]]:
    """(heading path, content) by ATX headings; deeper levels are popped first, so skipped levels collapse."""
    out: list[tuple[list[str], str]] = []
    path: list[tuple[int, str]] = []
    lines: list[str] = []

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append(([t for _, t in path], body))
        lines.clear()

    for line in text.split("\n"):
        m = _HEADING.match(line)
        if m and m[2]:
            close()
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), m[2]))
        else:
            lines.append(line)
    close()
    return out or ([([], text.strip())] if text.strip() else [])


def sentences_of(text: str) -> list[str]:
    """A lossless split after blank lines, sentence ends and single newlines (blank pieces at paragraph breaks go)."""
    out, begin = [], 0
    for m in _SENTENCE.finditer(text):
        piece = text[begin : m.end()]
        begin = m.end()
        if len(m[0]) > 1 and m[0].startswith("\n") and not piece.strip():
            continue
        out.append(piece)
    return [*out, text[begin:]] if begin < len(text) else out


def split_section(content: str, config: ChunkConfig, count: Callable[[str], int]) -> list[tuple[str, int, int]]:
    """(chunk, its tokens, tokens before it in the section), packed greedily by sentences, overlapping by whole sentences.
    Chunks below min_size are dropped unless the last; if that leaves nothing, the section is one chunk."""
    parts = sentences_of(content)
    sizes = [count(p) for p in parts]
    allowance, out, start = int(config.chunk_size * config.overlap), [], 0
    while start < len(parts):
        end, total = start, 0
        while end < len(parts) and (end == start or total + sizes[end] <= config.chunk_size):
            total += sizes[end]
            end += 1
        text = "".join(parts[start:end]).strip()
        n = count(text)
        if n >= config.min_size or end >= len(parts):
            out.append((text, n, sum(sizes[:start])))
        if end >= len(parts):
            break
        after, used = end, 0
        while after > start and used + sizes[after - 1] <= allowance:
            after -= 1
            used += sizes[after]
        start = after if after > start else end
    return out or ([(content.strip(), count(content), 0)] if sum(sizes) else [])


SCHEMA = "document_id string, chunk_id string, ordinal int, content string, token_count int, position double, section_hierarchy array<string>, preceding_chunk_id string, following_chunk_id string"


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig(), id_col: str = "id", text_col: str = "content", count: Callable[[str], int] = heuristic_count, mode: str = "sections", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks named {document}_{n}, linked to their neighbours; keep names columns to copy to every chunk.
    mode="whole" (C8): one chunk a document, with token_count 0."""
    base = docs.select(F.col(id_col).cast("string").alias("document_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    if mode == "whole":
        none = F.lit(None).cast("string")
        return base.select("document_id", F.concat("document_id", F.lit("_0")).alias("chunk_id"), F.lit(0).alias("ordinal"), F.col("text").alias("content"), F.lit(0).alias("token_count"), F.lit(0.0).alias("position"), F.array().cast("array<string>").alias("section_hierarchy"), none.alias("preceding_chunk_id"), none.alias("following_chunk_id"), *keep)
    piece = pieces.PIECE
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (batch.iloc[at : at + piece] for batch in batches for at in range(0, len(batch), piece)):
            rows, owner = [], []
            for i, (doc, text) in enumerate(zip(pdf["document_id"], pdf["text"])):
                total = count(text) or 1
                found = [(path, *c) for path, body in sections_of(text) for c in split_section(body, config, count)]
                ids = [f"{doc}_{n}" for n in range(len(found))]
                for n, (path, chunk, size, before) in enumerate(found):
                    rows.append((doc, ids[n], n, chunk, size, before / total, path, ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None))
                    owner.append(i)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for k in keep:
                out[k] = pdf[k].array[owner]
            yield out

    return base.mapInPandas(run, f"{SCHEMA}, {kept}" if kept else SCHEMA)


def link_chunks(chunks: DataFrame, doc_col: str = "document_id", order_col: str = "ordinal", id_col: str = "chunk_id") -> DataFrame:
    """C6 for chunks that come without links."""
    w = Window.partitionBy(doc_col).orderBy(order_col)
    return chunks.withColumns({"preceding_chunk_id": F.lag(id_col).over(w), "following_chunk_id": F.lead(id_col).over(w)})
