"""Column functions: text, identity, vectors, URLs, HTML, wikitext."""
