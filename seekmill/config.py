"""Configuration and its validation, all errors at once."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields


@dataclass
class IndexConfig:
    dims: int = 64


@dataclass
class ChunkingConfig:
    chunk_size: int = 512
    overlap: float = 0.15
    min_size: int = 50


@dataclass
class RetrievalConfig:
    candidates: int = 50
    rrf_k: int = 60
    rerank: bool = True
    min_multiplier: float = 0.5


@dataclass
class DedupConfig:
    enabled: bool = True
    threshold: int = 3
    update_near: bool = True


@dataclass
class CrawlConfig:
    max_depth: int = 3
    default_delay: float = 1.0
    min_delay: float = 0.5
    max_delay: float = 30.0
    per_domain: int = 10_000


@dataclass
class Config:
    index: IndexConfig = field(default_factory=IndexConfig)
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    dedup: DedupConfig = field(default_factory=DedupConfig)
    crawl: CrawlConfig = field(default_factory=CrawlConfig)

    @classmethod
    def from_toml(cls, text: str) -> Config:
        raw, out = tomllib.loads(text), cls()
        for part in fields(cls):
            for key, value in raw.get(part.name, {}).items():
                if key not in {f.name for f in fields(getattr(out, part.name))}:
                    raise ValueError([f"{part.name}.{key}: unknown"])
                setattr(getattr(out, part.name), key, value)
        return out.validate()

    def validate(self) -> Config:
        tests = [
            (1 <= self.index.dims <= 4096, "index.dims must be from 1 to 4096"),
            (self.chunking.chunk_size > 0, "chunking.chunk_size must be positive"),
            (0 <= self.chunking.overlap < 1, "chunking.overlap must be from 0 to below 1"),
            (0 <= self.chunking.min_size <= self.chunking.chunk_size, "chunking.min_size must not exceed chunk_size"),
            (self.retrieval.candidates > 0, "retrieval.candidates must be positive"),
            (self.retrieval.rrf_k > 0, "retrieval.rrf_k must be positive"),
            (0 <= self.retrieval.min_multiplier <= 1, "retrieval.min_multiplier must be from 0 to 1"),
            (0 <= self.dedup.threshold <= 64, "dedup.threshold must be from 0 to 64"),
            (self.crawl.max_depth >= 0, "crawl.max_depth must not be negative"),
            (0 < self.crawl.min_delay <= self.crawl.max_delay, "crawl.min_delay must be positive and not exceed max_delay"),
            (self.crawl.default_delay >= 0, "crawl.default_delay must not be negative"),
        ]
        errors = [message for ok, message in tests if not ok]
        if errors:
            raise ValueError(errors)
        return self
