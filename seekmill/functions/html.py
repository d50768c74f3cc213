"""HTML extraction on the standard library's parser.

One Arrow UDF parses a page once and returns its text, raw metadata, links and structure counts; what is arithmetic or a chain
of fallbacks is left to column expressions. Differences from the reference behaviour, on purpose: script and style text
is dropped, and list indentation follows the nesting.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.functions import dates, pieces, text as T, urls

VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = {"script", "style", "noscript", "template"}
NOISE = {"nav", "header", "footer", "aside", "form", *SILENT}
BLOCK = set("div br tr blockquote section header footer aside table".split())
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "pre", "blockquote"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
MAIN = (("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "post-content"), ("class", "article-content"), ("class", "entry-content"), ("class", "content"), ("id", "content"), ("class", "post"), ("class", "article"))
MIN_MAIN = 200


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack.extend(reversed(node.kids))

    def find(self, ok):
        return next((n for n in self.walk() if isinstance(n, Node) and ok(n)), None)

    def text(self) -> str:
        return "".join(n for n in self.walk() if isinstance(n, str))

    def size(self) -> int:
        return sum(len(n) if isinstance(n, str) else 2 * len(n.tag) + 5 + sum(len(k) + len(v) + 4 for k, v in n.attrs.items()) for n in self.walk())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def find_main(root: Node) -> Node:
    """The first of ten selectors whose content is long enough, else the body."""
    for kind, value in MAIN:
        ok = (lambda n: n.tag == value) if kind == "tag" else (lambda n: value in n.attrs.get("class", "").split()) if kind == "class" else (lambda n: n.attrs.get(kind) == value)
        found = root.find(ok)
        if found is not None and found.size() > MIN_MAIN:
            return found
    return root.find(lambda n: n.tag == "body") or root


HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")


def render(node: Node, noise: set[str] = SILENT) -> str:
    """Markdown-like text of a tree."""
    out: list[str] = []

    # the nodes to come, each with the depth of its list and whether it stands in pre or code; or what to do behind a node's children
    block, stack = False, [(node, 0, False)]
    while stack:
        n, depth, pre = stack.pop()
        if n is None:
            if depth == "pre":
                out.append("\n```\n\n")
            block = block or pre
        elif isinstance(n, str):
            t = n if pre else n.strip()
            if t:
                if out and not pre:
                    out.append("\n" if block else " ")
                out.append(t)
                block = False
        elif n.tag not in noise:
            if n.tag in HEADS:
                out.append(("\n\n" if out else "") + "#" * int(n.tag[1]))
                block = False
            elif n.tag == "p":
                out.append("\n\n" if out else "")
                block = False
            elif n.tag == "li":
                out.append("\n" + "  " * max(0, depth - 1) + "-")
                block = False
            elif n.tag in ("ul", "ol"):
                depth, block = depth + 1, True
            elif n.tag == "pre":
                out.append("\n\n```\n")
                block = False
            elif n.tag in BLOCK:
                block = True
            stack.append((None, n.tag, n.tag in BLOCK or n.tag in ("p", "ul", "ol", *HEADS)))
            stack += [(kid, depth, pre or n.tag in ("pre", "code")) for kid in reversed(n.kids)]
    return normalize_lines("".join(out))


def normalize_lines(text: str) -> str:
    """Blanks collapse within lines; two or more blank lines are one paragraph break, a single one is none."""
    out, blank = [], 0
    for line in text.split("\n"):
        line = " ".join(line.split())
        if not line:
            blank += 1
            continue
        if out:
            out.append("\n\n" if blank >= 1 else "\n")
        blank = 0
        out.append(line)
    return "".join(out)


def flatten_json_ld(value, into: dict[str, str]) -> dict[str, str]:
    """Strings stay, an object stands for its name, arrays are searched, later keys overwrite."""
    if isinstance(value, list):
        for x in value:
            flatten_json_ld(x, into)
    elif isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, str):
                into[k] = v
            elif isinstance(v, dict):
                if isinstance(v.get("name"), str):
                    into[k] = v["name"]
            elif isinstance(v, list):
                flatten_json_ld(v, into)
    return into


SCHEMA = (
    "text string, main_bytes int, meta map<string,string>, json_ld map<string,string>, title_tag string, h1 string, html_lang string, author_text string, time_attr string, "
    "canonical string, links array<string>, has_feed boolean, has_article boolean, n_li int, n_li_links int, external_text_bytes int"
)


def _first_text(root: Node, ok, limit: int = 1 << 30) -> str | None:
    found = root.find(ok)
    t = found.text().strip() if found else ""
    return t if t and len(t.encode()) < limit else None


def extract_one(html: str, url: str) -> tuple:
    root = parse(html)
    main = find_main(root)
    meta: dict[str, str] = {}
    ld: dict[str, str] = {}
    links: dict[str, None] = {}
    li = li_links = external = 0
    feed = article = False
    for n in root.walk():
        if isinstance(n, str):
            continue
        a = n.attrs
        if n.tag == "meta":
            for key in (a.get("name"), a.get("property")):
                if key and a.get("content", "").strip():
                    meta.setdefault(key, a["content"].strip())
        elif n.tag == "script" and a.get("type") == "application/ld+json":
            try:
                flatten_json_ld(json.loads(n.text()), ld)
            except (ValueError, RecursionError):
                pass
        elif n.tag == "link":
            feed = feed or a.get("type") in ("application/rss+xml", "application/atom+xml")
        elif n.tag == "article":
            article = True
        elif n.tag == "li":
            li += 1
            li_links += n.find(lambda x: x.tag == "a") is not None
        elif n.tag == "a" and "href" in a:
            if a["href"].startswith(("http://", "https://")):
                external += len(n.text().strip().encode())
            try:
                to = urljoin(url if "://" in (url or "") else "http://localhost/", a["href"].strip())
            except ValueError:
                continue
            if to.startswith(("http://", "https://")):
                links.setdefault(to)
    author = _first_text(root, lambda n: n.attrs.get("itemprop") == "author")
    for name in ("author", "byline", "writer"):
        author = author or _first_text(root, lambda n: name in n.attrs.get("class", "").split(), 100)  # noqa: B023
    author = author or _first_text(root, lambda n: n.attrs.get("rel") == "author", 100)
    moment = root.find(lambda n: n.tag == "time" and "datetime" in n.attrs)
    canonical = root.find(lambda n: n.tag == "link" and n.attrs.get("rel") == "canonical")
    page = root.find(lambda n: n.tag == "html")
    return (
        render(main, SILENT | (NOISE if main.tag in ("body", "#root") else set())), main.size(), meta, ld,
        _first_text(root, lambda n: n.tag == "title"), _first_text(root, lambda n: n.tag == "h1"), page.attrs.get("lang") if page else None, author,
        moment.attrs["datetime"] if moment else None, canonical.attrs.get("href") if canonical else None, list(links), feed, article, li, li_links, external,
    )


def extract(html: Column, url: Column) -> Column:
    """All that one parse of a page gives, as a struct."""

    def run(pages: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_one(h, u) for h, u in zip(pages, at)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return pieces.udf(run, SCHEMA, html, url)


def needs_js(html: Column, min_ratio: float = 0.1) -> Column:
    """Hardly any text outside tags, a framework's marks, or a short page that is still loading."""
    outside = F.regexp_replace(F.regexp_replace(html, r"<[^>]*>?", ""), f"{T.SPACE}", "")
    hints = ("window.__NEXT_DATA__", "window.__NUXT__", "ng-app", "ng-controller", '<div id="root"></div>', '<div id="app"></div>', "data-reactroot")
    out = F.length(outside) < F.octet_length(html) * min_ratio
    for h in hints:
        out = out | html.contains(h)
    return out | ((html.contains("Loading...") | html.contains("Please wait")) & (F.octet_length(html) < 5000))


def word_count(text: Column) -> Column:
    return F.size(T.words(T.normalize(text)))


def aggregator_score(x: Column) -> Column:
    """0.15 for feeds, 0.5 for the share of external link text, 0.35 for a list-like structure; x is extract()'s struct."""
    size = F.octet_length(x["text"])
    ratio = F.when(size > 0, x["external_text_bytes"] / size).otherwise(0.0)
    density = F.when(ratio < 0.05, 0.0).when(ratio >= 0.5, 1.0).otherwise((ratio - 0.05) / 0.45)
    n = word_count(x["text"])
    lists = (x["n_li"] > 10) & (x["n_li_links"] > 0.7 * x["n_li"])
    structure = F.when(x["has_article"], -0.4).otherwise(0.0) + F.when(lists, 0.5).otherwise(0.0) + F.when(n < 200, 0.3).when(n < 500, 0.1).otherwise(0.0)
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return clamp(F.when(x["has_feed"], 0.15).otherwise(0.0) + density * 0.5 + clamp(structure) * 0.35)


def schema_type(name: Column) -> Column:
    """The content type of a schema.org type; other names stay, in lower case."""
    low = F.lower(name)
    kinds = {"article": "article newsarticle blogposting technicalarticle", "product": "product", "recipe": "recipe", "video": "video videoobject", "profile": "person profilepage", "organization": "organization localbusiness", "event": "event"}
    out = low
    for kind, names in kinds.items():
        out = F.when(low.isin(names.split()), kind).otherwise(out)
    return out


def extract_pages(pages: DataFrame, min_bytes: int = 100, min_words: int = 20) -> DataFrame:
    """pages(url, html, ...) -> content and metadata by their chains of fallbacks; short pages are left out."""
    x, m, ld = F.col("_x"), lambda k: F.col("_x.meta")[k], lambda k: F.col("_x.json_ld")[k]
    out = pages.withColumn("_x", extract(F.col("html"), F.col("url"))).withColumn("_n", word_count(x["text"]))
    out = out.filter((F.octet_length(x["text"]) >= min_bytes) & (F.col("_n") >= min_words))
    published = F.coalesce(*(dates.parse_date(c) for c in (ld("datePublished"), m("date"), m("article:published_time"), x["time_attr"], m("DC.date"), m("datePublished"))))
    words = T.words(T.normalize(x["text"]))
    excerpt = F.when(F.col("_n") >= 50, F.concat(F.array_join(F.slice(words, 1, 50), " "), F.lit("..."))).when(F.col("_n") >= 10, F.array_join(words, " "))
    return out.select(
        *(c for c in pages.columns if c != "html"),
        x["text"].alias("content"),
        F.coalesce(ld("headline"), ld("name"), m("og:title"), m("twitter:title"), m("title"), x["title_tag"], x["h1"], F.lit("Untitled")).alias("title"),
        F.coalesce(ld("description"), m("og:description"), m("twitter:description"), m("description"), excerpt).alias("description"),
        F.coalesce(ld("author"), m("author"), x["author_text"]).alias("author"),
        published.alias("published"),
        dates.parse_date(ld("dateModified")).alias("modified"),
        F.coalesce(m("language"), x["html_lang"], m("og:locale")).alias("language"),
        F.coalesce(schema_type(ld("@type")), F.lit("article")).alias("content_type"),
        F.coalesce(x["canonical"], m("og:url")).alias("canonical_url"),
        urls.host(F.col("url")).alias("domain"),
        F.col("_n").alias("word_count"),
        F.greatest(F.lit(1), F.ceil(F.col("_n") / 200)).cast("int").alias("reading_time"),
        F.round(aggregator_score(x), 3).alias("aggregator_score"),
        x["links"].alias("links"),
    )
