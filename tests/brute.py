"""Plain Python versions of the registered queries that SQL can't express: name -> check(rows, tables)."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin, urlsplit

import numpy as np

CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF))


def _tokens(text: str) -> int:
    """Character by character: words of letters, digits and underscores with single apostrophes or stops inside."""
    words, word = [], ""
    for i, c in enumerate(text):
        inner = c in "'’." and word and i + 1 < len(text) and (text[i + 1].isalnum() or text[i + 1] == "_")
        if c.isalnum() or c == "_" or inner:
            word += c
        elif word:
            words.append(word)
            word = ""
    tenths = 0
    for w in [*words, word] if word else words:
        cjk = sum(any(a <= ord(c) <= b for a, b in CJK) for c in w)
        tenths += 10 * cjk + (10 + min(10, len(w) - cjk) if len(w) > cjk else 0)
    return -(-tenths // 10)


def _sentences(text: str) -> list[str]:
    out, at, begin = [], 0, 0
    while at < len(text):
        end = at + 1
        if text[at] == "\n":
            while end < len(text) and text[end] == "\n":
                end += 1
        elif text[at] in ".!?" and (end == len(text) or text[end].isspace()):
            while end < len(text) and text[end] == " ":
                end += 1
        else:
            at = end
            continue
        if text[begin:end].strip() or end - at == 1:
            out.append(text[begin:end])
        begin = at = end
    return [*out, text[begin:]] if begin < len(text) else out


def chunks(doc: str, text: str, size: int = 512, least: int = 50, overlap: float = 0.15) -> list[tuple]:
    """(chunk_id, ordinal, token_count, position, path, before, after)."""
    sections, path, body = [], [], []
    for line in [*text.split("\n"), "# end"]:
        marks = len(line) - len(line.lstrip("#"))
        title = line[marks:].strip().rstrip("#").strip()
        if 1 <= marks <= 6 and title:
            if "\n".join(body).strip():
                sections.append(([t for _, t in path], "\n".join(body).strip()))
            body, path = [], [p for p in path if p[0] < marks] + [(marks, title)]
        else:
            body.append(line)
    found = []
    for titles, content in sections:
        parts = _sentences(content)
        sizes = [_tokens(p) for p in parts]
        mine, start = [], 0
        while True:
            end = start + 1
            while end < len(parts) and sum(sizes[start : end + 1]) <= size:
                end += 1
            n = _tokens("".join(parts[start:end]).strip())
            if n >= least or end >= len(parts):
                mine.append((n, sum(sizes[:start]), titles))
            if end >= len(parts):
                break
            back = end
            while back > start and sum(sizes[back - 1 : end]) <= int(size * overlap):
                back -= 1
            start = back if back > start else end
        found += mine if mine else [(_tokens(content), 0, titles)]
    total = _tokens(text) or 1
    name = lambda n: f"{doc}_{n}" if 0 <= n < len(found) else None
    return [(name(i), i, n, before / total, titles, name(i - 1), name(i + 1)) for i, (n, before, titles) in enumerate(found)]


def c3_chunks(rows, t):
    want = {c[0]: c for doc, text in t("doc_id, text", "documents") if text and text.strip() and "#" not in text and not re.search(r"[^\w\s.,!?'’-]", text) for c in chunks(str(doc), text)}
    got = {r.chunk_id: (r.chunk_id, r.ordinal, r.token_count, r.position, r.preceding_chunk_id, r.following_chunk_id) for r in rows}
    assert len(want) > 30
    for k, (i, n, size, position, _, before, after) in want.items():
        assert got[k][:3] == (i, n, size) and abs(got[k][3] - position) < 1e-5 and got[k][4:] == (before, after), k


def c1_sections(rows, t):
    got = {r.chunk_id: (r.path, r.token_count) for r in rows}
    want = {}
    for doc, text, source in t("doc_id, text, source", "documents"):
        if text and text.strip() and "#" not in text and not re.search(r"[^\w\s.,!?'’-]", text):
            want |= {c[0]: ("/".join(c[4]), c[2]) for c in chunks(str(doc), f"# {source}\n" + text.replace("\n", "\n## part\n"), least=0)}
    assert len(want) > 30 and {k: got.get(k) for k in want} == want


def b8_fast_hash(rows, t):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    assert {r.doc_id: r.h for r in rows} == {i: signed(xxhash.xxh3_64_intdigest((text or "").encode())) for i, text in t("doc_id, text", "documents")}


def _hrefs(page: str, url: str) -> list[str]:
    page = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "", page)
    found = [urljoin(url, html.unescape(h).strip()) for h in re.findall(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", page, re.I)]
    return list(dict.fromkeys(h for h in found if h.startswith(("http://", "https://"))))


def a15_links(rows, t):
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.n)):
        got.setdefault(r.page_id, []).append(r.link)
    for i, url, page in t("page_id, url, html", "pages"):
        assert got.get(i, []) == _hrefs(page, url), i


def b22_main_text(rows, t):
    pages = {i: (url, page) for i, url, page in t("page_id, url, html", "pages")}
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        url, page = pages[r.page_id]
        assert r.n_links == len(_hrefs(page, url))
        plain = set(re.findall(r"\w+", html.unescape(re.sub(r"(?s)<[^>]*>", " ", page)) + html.unescape(re.sub(r"(?s)<[^>]*>", "", page))))
        assert set(re.findall(r"\w+", r.text)) <= plain | {"http", "https"} and "track(" not in r.text and "<p" not in r.text


def b21_aggregator_score(rows, t):
    """Pages with an article and no list of ten items or more, of 500 words: nothing but their external links counts."""
    score = {r.page_id: r.score for r in rows}
    assert all(0 <= s <= 1 for s in score.values()) and set(score) == {i for (i,) in t("page_id", "pages")}
    for i, page in t("page_id, html", "pages"):
        outside = re.findall(r"""<a\s[^>]*href=["']https?://""", page)
        if "<article" in page and not outside and "rss+xml" not in page and "atom+xml" not in page and page.count("<li") <= 10:
            assert score[i] == 0.0, i


def b24_page_metadata(rows, t):
    pages = {i: page for i, page in t("page_id, html", "pages")}
    seen = 0
    for r in rows:
        page = pages[r.page_id]
        titles = [m for m in (re.search(p, page) for p in (r'property="og:title" content="([^"]*)"', r'name="twitter:title" content="([^"]*)"', r"<title>([^<]*)</title>", r"<h1>([^<]*)</h1>")) if m]
        if "ld+json" not in page and titles and html.unescape(titles[0][1]).strip():
            assert r.title == html.unescape(titles[0][1]).strip(), r.page_id
            seen += 1
        assert r.domain == urlsplit(r.url).hostname and r.reading_time == max(1, -(-r.word_count // 200)) and r.word_count >= 20
    assert seen > 5


def i8_process_pages(rows, t):
    ids = {r.id for r in rows}
    assert rows and all(r.bytes >= 100 and r.title for r in rows) and len(ids) == len(rows)
    blocked = [url for (url,) in t("url", "pages") if urlsplit(url).path.startswith("/fr/")]
    assert len(rows) <= len(t("page_id", "pages")) - len(blocked)


def b28_wikitext(rows, t):
    got, seen = {r.doc_id: r.plain for r in rows}, 0
    for i, text, lang, source in t("doc_id, text, lang, source", "documents"):
        if text and re.fullmatch(r"[\w .,]+", text):
            assert got[i].split() == f"{source} {lang} label {text}".split(), i
            seen += 1
        assert got[i] is None or "{{" not in got[i].split("\n")[0]
    assert seen > 5


def _snippets(rows, t, terms):
    texts = dict(t("doc_id, text", "documents"))
    for r in rows:
        text = " ".join((texts[r.doc_id] or "").split())
        assert len((r.snippet or "").encode()) <= 200 + 3 and (r.snippet or not text)
        for word in re.findall(r"\w{3,}", (r.snippet or "").removesuffix("...").removesuffix("…"))[:-1]:
            assert word in text, (r.doc_id, word)
        if terms and text and (r.snippet or "").isascii():
            sentences = re.split(r"(?<=[.!?])\s+", text)
            hits = max(sum(w in s.lower() for w in terms) for s in sentences)
            assert not hits or len(r.snippet) > 0


def b32_parse_robots(rows, t):
    assert {r.host for r in rows} == {urlsplit(u).hostname for (u,) in t("url", "pages")}
    assert all((r.disallow, r.allow, r.crawl_delay) == ([f"/{r.host[:2]}"], ["/en"], 2.5) for r in rows)


def f12_citations(rows, t):
    texts = [" ".join((x or "").split()) for (x,) in t("text", "documents")]
    assert [r["index"] for r in sorted(rows, key=lambda r: r["index"])] == list(range(1, len(rows) + 1)) and 0 < len(rows) <= 10
    for r in rows:
        words = re.findall(r"\w{3,}", r.snippet.removesuffix("..."))[:-1]
        assert any(all(w in x for w in words) for x in texts) and r.title and len(r.snippet.encode()) <= 203


def a1_wiki_import(rows, t):
    want = {str(i): text for i, text in t("doc_id, text", "documents") if text and i % 2 == 0}
    got = {r.id: r for r in rows}
    assert set(got) <= set(want) and all(got[i].title == f"Page {i}" and got[i].url.endswith(f"/Page_{i}") for i in got)
    plain = {i: x for i, x in want.items() if len(x.encode()) >= 100 and re.fullmatch(r"[\w .,\n]+", x)}
    assert len(plain) > 5 and set(plain) <= set(got) and all(abs(got[i].bytes - len(x.encode())) <= x.count("\n") + x.count("  ") + 2 for i, x in plain.items())


def a2_page_filter(rows, t):
    docs = {str(i): (text, source) for i, text, source in t("doc_id, text, source", "documents")}
    got = {r.id for r in rows}
    assert all(docs[i][0] and docs[i][1] != "src1" for i in got) and all(r.title == f"Page_{r.id}" for r in rows)
    assert {i for i, (x, s) in docs.items() if x and s != "src1" and len(x) > 100 and not re.search(r"[\[{<]", x)} <= got


def h1_kmeans(rows, t):
    v = {i: np.array(e, float) for i, e in t("vec_id, embedding", "embeddings")}
    unit = lambda x: x / np.linalg.norm(x)
    group: dict = {}
    for r in rows:
        group.setdefault(r.cluster, []).append(r.vec_id)
    assert sum(map(len, group.values())) == len(v) and len(group) <= 10
    names = sorted(group)
    centers = np.stack([unit(sum(unit(v[i]) for i in group[c])) for c in names])
    moved = sum(names[int(np.argmax(centers @ unit(v[i])))] != c for c in names for i in group[c])
    assert moved <= 0.01 * len(v)  # a fixed point: every vector is with its nearest mean


def h5_cluster_documents(rows, t):
    have = {str(i) for (i,) in t("page_id", "pages")} & {str(i) for (i,) in t("vec_id", "embeddings")}
    assert {r.document_id for r in rows} == have and len({r.cluster for r in rows}) <= 8
    assert all(len({r.label for r in rows if r.cluster == c}) == 1 for c in {r.cluster for r in rows})


def j10_engine_search(rows, t):
    texts = {str(i): x or "" for i, x in t("doc_id, text", "documents")}
    rows = sorted(rows, key=lambda r: r.citation)
    assert [r.citation for r in rows] == list(range(1, len(rows) + 1)) and rows
    assert all(a.score >= b.score for a, b in zip(rows, rows[1:])) and all(0 <= r.score <= 1 and r.document_id in texts for r in rows)


def b15_bpe_tokens(rows, t):
    """Merging the pair of the lowest rank, one at a time."""
    import base64

    import regex

    from seekmill.functions.tokenizers import _PATTERN
    from seekmill.plans.text_queries import RANKS

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    sizes: dict = {}

    def size(word: str) -> int:
        parts = [bytes([b]) for b in word.encode()]
        while word.encode() not in ranks and len(parts) > 1:
            rank, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return 1 if word.encode() in ranks else len(parts)

    got = {r.doc_id: r.n_tokens for r in rows}
    for i, text in t("doc_id, text", "documents"):
        n = 0
        for w in regex.findall(_PATTERN, text or ""):
            n += sizes[w] if w in sizes else sizes.setdefault(w, size(w))
        assert got[i] == n, i


def a10_html_documents(rows, t):
    pages = {url: page for url, page in t("url, html", "pages")}
    for r in rows:
        m = re.search(r"<title>([^<]*)</title>", pages[r.url])
        if m and m[1].strip():
            assert r.title == html.unescape(m[1]).strip()


CHECKS = {k: f for k, f in globals().items() if re.match(r"[a-z]\d+_", k)}
CHECKS["b29_snippet"] = lambda rows, t: _snippets(rows, t, ("thing", "ing", "hand"))
CHECKS["b29_quality_snippets"] = lambda rows, t: _snippets(rows, t, ())
