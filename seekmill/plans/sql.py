"""Pieces of the DuckDB SQL that the queries' results are checked with."""

from seekmill.functions.text import CJK, SPACE, WORD, LABEL_STOP_WORDS

S = SPACE


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{S}+', ' ', 'g'))"


def words(x: str) -> str:
    """A list of words, from normalised text."""
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


GRAMS = "CASE WHEN len(ws) < 3 THEN ws ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END"


def simhash(source: str, key: str) -> str:
    """A query for (key, simhash BIGINT) of source(key, ws LIST)."""
    return f"""
    SELECT k AS {key}, (('0b' || string_agg(b, '' ORDER BY bit))::UBIGINT::HUGEINT - CASE WHEN max(b) FILTER (bit = 0) = '1' THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS simhash FROM (
      SELECT k, bit, CASE WHEN sum(CASE WHEN ((h >> (63 - bit)::UBIGINT) & 1) = 1 THEN 1 ELSE -1 END) > 0 THEN '1' ELSE '0' END AS b
      FROM (SELECT {key} AS k, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM (SELECT {key}, unnest({GRAMS}) AS g FROM {source})), range(64) t(bit) GROUP BY 1, 2) GROUP BY 1
    """


def unit(v: str) -> str:
    return f"CASE WHEN list_sum(list_transform({v}::DOUBLE[], lambda x: x * x)) > 0 THEN list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform({v}::DOUBLE[], lambda y: y * y)))) ELSE {v}::DOUBLE[] END"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{URL_RE}', {n})"


def host(u: str) -> str:
    return f"lower(regexp_replace({url_part(u, 2)}, '^[^@]*@|:[0-9]+$', '', 'g'))"


def path(u: str) -> str:
    return f"CASE WHEN {url_part(u, 3)} = '' THEN '/' ELSE {url_part(u, 3)} END"


def norm_url(u: str) -> str:
    p = f"({path(u)})"
    track = "'fbclid', 'gclid', 'ref', 'sessionid', 'sid', 'source', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'"
    q = f"array_to_string(list_sort(list_filter(string_split({url_part(u, 4)}, '&'), lambda p: lower(split_part(p, '=', 1)) NOT IN ({track}))), '&')"
    stripped = f"CASE WHEN length({p}) > 1 AND {p} LIKE '%/' THEN left({p}, -1) ELSE {p} END"
    return f"lower({url_part(u, 1)} || '://' || regexp_replace(lower({url_part(u, 2)}), '^www\\.', '') || {stripped} || CASE WHEN {url_part(u, 4)} = '' OR {q} = '' THEN '' ELSE '?' || {q} END)"


def listing(u: str) -> str:
    return f"(regexp_matches(lower({path(u)}), '/(archive|archives|author|categories|category|label|page|tag|tags|topic)/') OR len(list_filter(string_split({url_part(u, 4)}, '&'), lambda p: lower(split_part(p, '=', 1)) IN ('filter', 'order', 'orderby', 'p', 'page', 'sort', 'view'))) > 0)"


__all__ = ["CJK", "LABEL_STOP_WORDS", "SPACE", "WORD"]
