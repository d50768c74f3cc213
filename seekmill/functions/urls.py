"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekmill.functions import text as T

TRACKING = ("fbclid", "gclid", "ref", "sessionid", "sid", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
LISTING_PATHS = "archive archives author categories category label page tag tags topic".split()
LISTING_KEYS = "filter order orderby p page sort view".split()
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _URL, n)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(part(url, 2), r"^[^@]*@|:\d+$", ""))


def path(url: Column) -> Column:
    p = part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def _key(param: Column) -> Column:
    return F.lower(F.regexp_extract(param, "^([^=]*)", 1))


def normalize_url(url: Column) -> Column:
    """No fragment, no www., no trailing slash, no tracking parameters, the others sorted, lower case."""
    p = F.regexp_replace(path(url), r"(?<=.)/$", "")
    kept = F.array_sort(F.filter(F.split(part(url, 4), "&"), lambda x: ~_key(x).isin(*TRACKING)))
    query = F.array_join(F.when(part(url, 4) == "", F.array().cast("array<string>")).otherwise(kept), "&")
    return F.lower(F.concat(part(url, 1), F.lit("://"), F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""), p, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def is_crawl_trap(url: Column, max_length: int = 2048, max_depth: int = 15, max_repeats: int = 3) -> Column:
    """Too long, too deep, repeating itself, or like a calendar. A window size never exceeds half of max_depth
    segments, as deeper paths are traps already."""


    def of(s: Column) -> Column:
        n, repeats = F.size(s), F.lit(False)
        for w in range(1, max_depth // 2 + 1):
            at = F.sequence(F.lit(1), F.greatest(n - w, F.lit(1)))
            equal = F.size(F.filter(at, lambda i: F.try_element_at(s, i) == F.try_element_at(s, i + w)))  # noqa: B023
            repeats = repeats | ((n >= max(4, 2 * w)) & (equal >= max_repeats))
        calendar = F.concat(F.lit("/"), F.array_join(s, "/"), F.lit("/")).rlike(r"/\+?\d{1,10}/\+?\d{1,10}/\+?\d{1,10}/")
        return (n > max_depth) | repeats | calendar

    return (F.octet_length(url) > max_length) | T.let(segments(url), of)


def is_listing(url: Column) -> Column:
    """Tag, category, archive and like pages, or sorted, filtered and paged views."""
    in_path = F.lower(path(url)).rlike(f"/({'|'.join(LISTING_PATHS)})/")
    return in_path | F.exists(F.split(part(url, 4), "&"), lambda x: _key(x).isin(*LISTING_KEYS))


def priority(depth: Column, inlinks: Column, fresh: Column, listing: Column) -> Column:
    """B20."""
    bonus = F.when(fresh, 0.5).otherwise(0.0) - F.when(listing, 0.5).otherwise(0.0)
    return F.lit(1.2) - F.lit(0.1) * depth + F.lit(0.2) * F.least(inlinks, F.lit(10)) + bonus


def url_allowed(url: Column, seeds: list[str], stay: bool = True, exclude: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> Column:
    """I4: not a trap, of a seed domain if we stay there, no exclude pattern, any include pattern."""
    ok = ~is_crawl_trap(url)
    if stay:
        ok = ok & host(url).isin(*seeds)
    for x in exclude:
        ok = ok & ~url.rlike(x)
    if include:
        any_of = F.lit(False)
        for x in include:
            any_of = any_of | url.rlike(x)
        ok = ok & any_of
    return ok


def wiki_base_url(file_name: Column) -> Column:
    """A3."""
    out = F.lit("https://en.wikipedia.org/wiki/")
    for prefix in ("de", "fr", "es", "simple"):
        out = F.when(file_name.startswith(f"{prefix}wiki"), f"https://{prefix}.wikipedia.org/wiki/").otherwise(out)
    return out


def dump_format(name: Column) -> Column:
    """A4; NULL for an unknown format."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.xml(\.bz2)?$"), "wikimedia_xml").when(low.endswith(".zim"), "zim").when(low.rlike(r"\.warc(\.gz)?$"), "warc").when(low.rlike(r"\.(txt|md)$"), "plain_text")


def content_type(name: Column | None = None, mime: Column | None = None, url: Column | None = None) -> Column:
    """By extension, by MIME type or by URL (an URL without a known suffix is html); NULL where unknown."""
    if mime is not None:
        m = F.lower(mime)
        return F.when(m.contains("pdf"), "pdf").when(m.contains("html"), "html").when(m.contains("text/plain") | m.contains("markdown"), "text")
    low = F.lower(name if url is None else path(url))
    kind = F.when(low.endswith(".pdf"), "pdf").when(low.rlike(r"\.(txt|text|md|markdown|rst)$"), "text").when(low.rlike(r"\.(html?|xhtml)$"), "html")
    return kind if url is None else F.coalesce(kind, F.lit("html"))
