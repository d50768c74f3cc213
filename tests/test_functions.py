"""Scalar functions on literals."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from seekmill.functions import dates, html, identity, robots, snippet, text as T, tokenizers, urls, wikitext


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalisation_and_hash(spark):
    assert one(spark, T.normalize(F.lit("  Hello \t WORLD\n"))) == "hello world"
    assert one(spark, identity.content_hash(F.lit("Hello   World"))) == hashlib.sha256(b"hello world").hexdigest()
    assert one(spark, T.normalize(F.lit(None).cast("string"))) == ""


def test_grams(spark):
    g = lambda t: one(spark, T.grams(T.words(T.normalize(F.lit(t)))))
    assert g("a b c d") == ["a b c", "b c d"] and g("a b") == ["a", "b"] and g("") == []


def test_simhash(spark):
    assert identity.simhash_of([]) == 0
    assert identity.simhash_of(["one"]) == int.from_bytes(hashlib.md5(b"one").digest()[:8], "big", signed=True)
    h = xxhash.xxh3_64_intdigest(b"a b c")
    assert identity.simhash_of(["a", "b", "c"], "xxh3") & (2**64 - 1) == h
    same = spark.createDataFrame([("The quick brown fox",), ("the  QUICK brown fox",)], "t string").select(identity.simhash(F.col("t")).alias("s")).distinct()
    assert same.count() == 1
    assert one(spark, identity.fast_hash(F.lit("abc"))) & (2**64 - 1) == xxhash.xxh3_64_intdigest(b"abc")


def test_content_id(spark):
    assert one(spark, identity.content_id(F.lit(-1).cast("bigint"))) == "f" * 16
    assert one(spark, identity.parse_content_id(F.lit("FFFFFFFFFFFFFFFE"))) == -2
    assert one(spark, identity.parse_content_id(F.lit("xyz"))) is None
    assert one(spark, identity.hamming(F.lit(5).cast("bigint"), F.lit(-1).cast("bigint"))) == 62


@pytest.mark.parametrize(("text", "n"), [("", 0), ("hello world", 3), ("漢字", 2), ("漢字 test", 4), ("a", 2), ("internationalization", 2)])
def test_heuristic_tokens(spark, text, n):
    from seekmill.operators.chunking import heuristic_count

    assert one(spark, T.heuristic_tokens(F.lit(text))) == n == heuristic_count(text)


def test_truncation(spark):
    for text, limit in (("héllo wörld", 2), ("漢字漢字", 4), ("🎈🎈", 5), ("plain", 5), ("plain", 3)):
        want = text if len(text.encode()) <= limit else text.encode()[:limit].decode(errors="ignore") + "..."
        assert one(spark, T.truncate_bytes(F.lit(text), limit)) == want
    assert one(spark, T.display(F.lit("a\nb"), 10)) == "a b"


def test_vectors(spark):
    v = lambda *x: F.lit([float(y) for y in x])
    assert one(spark, T.cosine(v(1, 0), v(1, 0))) == pytest.approx(1) and one(spark, T.cosine(v(0, 0), v(1, 0))) == 0 and one(spark, T.cosine(v(1), v(1, 0))) == 0
    assert one(spark, T.unit(v(3, 4))) == pytest.approx([0.6, 0.8]) and one(spark, T.unit(v(0, 0))) == [0, 0]
    assert one(spark, T.truncate_dims(v(3, 4, 12), 2)) == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Example.com/Page/#x", "https://example.com/page"),
        ("https://example.com/?utm_source=a&b=2&a=1&FBCLID=9", "https://example.com/?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com/a?ref=x", "https://example.com/a"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.lit(url))) == want


@pytest.mark.parametrize(
    ("path", "trap"),
    [("/a/b", False), ("/x" * 16, True), ("/2024/01/02", True), ("/2024/01/x/02", False), ("/a/b/a/b/a/b", True), ("/a/a/a", False), ("/" + "y" * 2100, True)],
)
def test_crawl_traps(spark, path, trap):
    assert one(spark, urls.is_crawl_trap(F.lit("https://e.org" + path))) is trap


def test_names(spark):
    assert one(spark, urls.dump_format(F.lit("x.XML.BZ2"))) == "wikimedia_xml" and one(spark, urls.dump_format(F.lit("x.exe"))) is None
    assert one(spark, urls.content_type(F.lit("a.MD"))) == "text" and one(spark, urls.content_type(url=F.lit("http://a/b"))) == "html"
    assert one(spark, urls.content_type(mime=F.lit("application/pdf"))) == "pdf"


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("/private/", "/private/x", True), ("/*.pdf$", "/a/b.pdf", True), ("/*.pdf$", "/a/b.pdf?x", False), ("/a*c", "/abbc/d", True), ("", "/", False), ("/x$", "/x", True), ("/x$", "/xy", False), ("/a.b", "/axb", False)],
)
def test_robots_patterns(spark, pattern, path, hit):
    assert one(spark, robots.path_matches(F.lit(path), F.lit(pattern))) is hit


def test_robots_text():
    text = "User-agent: *\nDisallow: /all\n\nUser-agent: MyBot\nDisallow: /mine # here\nAllow: /mine/ok\nCrawl-delay: 4\n\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /later"
    disallow, allow, delay = robots.parse_robots_text(text, "mybot/2.0")
    assert disallow == ["/mine # here"] and allow == ["/mine/ok"] and delay == 4
    assert robots.parse_robots_text(text, "unknown")[0] == ["/all", "/later"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-03-05", "2024-03-05 00:00:00"), ("2024-03-05T10:00:00+02:00", "2024-03-05 08:00:00"), ("Tue, 5 Mar 2024 10:00:00 +0000", "2024-03-05 10:00:00"), ("March 5, 2024", "2024-03-05 00:00:00"), ("05/03/2024", "2024-03-05 00:00:00"), ("soon", None), ("2024-13-40", None)],
)
def test_dates(spark, text, want):
    assert one(spark, F.date_format(dates.parse_date(F.lit(text)), "yyyy-MM-dd HH:mm:ss")) == want


PAGE = """<html lang="en"><head><title>T</title><meta property="og:title" content="OG"><meta name="author" content="Ann"><link rel="canonical" href="https://e.org/c">
<script type="application/ld+json">{"@type": "NewsArticle", "author": {"name": "Bob"}, "datePublished": "2024-01-02"}</script></head>
<body><nav><a href="/x">x</a></nav><article><h1>Head</h1><p>%s</p><ul><li>one<li>two</ul><script>var hidden = "</p>";</script><a href="https://o.org/p#f">out</a></article></body></html>"""


def test_html(spark):
    page = PAGE % ("Some words stand here. " * 20)
    r = html.extract_pages(spark.createDataFrame([("https://e.org/a", page)], "url string, html string")).first()
    assert r.title == "OG" and r.author == "Bob" and r.content_type == "article" and r.canonical_url == "https://e.org/c" and r.language == "en"
    assert str(r.published).startswith("2024-01-02") and r.links == ["https://e.org/x", "https://o.org/p#f"]
    assert r.content.startswith("# Head\n\nSome words") and "\n- one\n- two" in r.content and "hidden" not in r.content
    assert r.word_count > 80 and r.reading_time == 1 and r.domain == "e.org"


def test_html_oddities(spark):
    assert html.render(html.parse("<p>a<p>b<pre>x\n  y</pre>")) == "a\n\nb\n\n```\nx\ny\n```"
    assert html.flatten_json_ld({"@graph": [{"a": "1"}, {"a": "2", "b": {"name": "n"}, "c": 3}]}, {}) == {"a": "2", "b": "n"}
    assert one(spark, html.schema_type(F.lit("BlogPosting"))) == "article" and one(spark, html.schema_type(F.lit("Thing"))) == "thing"
    assert html.parse("").kids == [] and html.parse("<<>></b></i>").text()


def test_wikitext():
    source = "{{Box|x={{y}}}}'''Bold''' [[Page|label]] and [[Other]]<ref name=a>gone</ref><!-- c -->\n== Head ==\n* item\n[[File:a.png|thumb|[[x]] text]]\n{| class\n|-\n|cell\n|}\n[http://e.org site]"
    assert wikitext.plain_text(source) == "Bold label and Other\nHead\nitem\n\nsite"
    strict = wikitext.plain_text(source, strict=True)
    assert "== Head ==" in strict and "* item" in strict and "[http://e.org site]" in strict
    assert wikitext.plain_text(None) == "" and wikitext.plain_text("a {{b") == "a"


def test_snippets():
    text = "First things come here. The needle is in this sentence. Nothing else matters."
    assert snippet.snippet_of("needle", text, 40) == "The needle is in this sentence."
    assert snippet.snippet_of("needle things", text, 200).startswith("First things come here. The needle")
    assert snippet.snippet_of("qq", "Home | About\n\nThis is a proper sentence with many words in it.", 200) == "This is a proper sentence with many words in it."
    assert snippet.snippet_of("", text) is None and snippet.snippet_of("x", None) is None
    assert snippet.cut("word " * 50, 30).endswith("...") and len(snippet.cut("word " * 50, 30)) <= 30


def test_tokenizer_names(spark):
    assert tokenizers.resolve(model="text-embedding-3-small") == "cl100k_base" and tokenizers.resolve() == "heuristic" and tokenizers.resolve("o200k_base") == "o200k_base"
    with pytest.raises(ValueError):
        tokenizers.resolve("nope")
    assert one(spark, tokenizers.token_count(F.lit("hello world"), "r50k_base", "/opt/tokenizers/byte_bpe_50k.tiktoken")) == 2


def test_titles(spark):
    assert one(spark, T.text_title(F.lit("short\n# Title\nlong enough line"))) == "Title"
    assert one(spark, T.text_title(F.lit("http://x.example/long\n A proper first line \n# T"))) == "A proper first line"
