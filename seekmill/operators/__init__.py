"""Relational operators: dedup, indexing, retrieval, fusion, routing, clustering, crawl."""
