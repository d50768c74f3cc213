"""Text and vector functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelt out: \s differs between regex engines.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
#: Words of the heuristic tokenizer: letters, digits and underscores, joined by inner apostrophes and full stops.
WORD = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"
LABEL_STOP_WORDS = (
    "about after also and are been before being between but can could did does during for from had has have her his "
    "into its just may might not our over shall should such than that the their then this through was were will with would yet your"
).split()


def normalize(text: Column) -> Column:
    """B1: lower case, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+", " "))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def grams(ws: Column, n: int = 3) -> Column:
    """Sliding windows of n words; fewer than n words stand for themselves."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(ws, i, n)))
    return F.when(F.size(ws) < n, ws).otherwise(windows)


def heuristic_tokens(text: Column) -> Column:
    """Ceiling of the sum over words: 1 a CJK character, 1 + min(length / 10, 1) for other characters.
    Tenths are summed as integers, so the ceiling is exact."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))

    def tenths(w: Column) -> Column:
        cjk = F.regexp_count(w, F.lit(CJK))
        other = F.length(w) - cjk
        return cjk * 10 + F.when(other > 0, F.lit(10) + F.least(other, F.lit(10))).otherwise(0)

    return F.ceil(F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, w: acc + tenths(w).cast("bigint")) / 10).cast("bigint")


def truncate_bytes(text: Column, limit: int, suffix: str = "...") -> Column:
    """At most limit bytes of UTF-8, cut between characters, with the suffix where something was cut."""
    raw = F.encode(text, "UTF-8")
    inner = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")  # noqa: E731  (byte n+1 continues a character)
    cut = reduce(lambda rest, n: F.when(~inner(n), n).otherwise(rest), range(max(0, limit - 3), limit + 1), F.lit(0))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"), F.lit(suffix)))


def display(text: Column, limit: int) -> Column:
    """One line of at most limit bytes."""
    return truncate_bytes(F.regexp_replace(text, "\n", " "), limit, "")


def text_title(content: Column) -> Column:
    """Of the first 10 lines the first that is a '# ' heading, or has 10 to 200 bytes and starts like prose."""
    lines = F.transform(F.slice(F.split(content, "\n"), 1, 10), lambda x: F.trim(F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")))
    heading = lambda t: F.regexp_extract(t, r"^# +(.+)$", 1)
    prose = lambda t: F.octet_length(t).between(10, 200) & ~t.rlike(r"^(#|http|//|/\*)")
    found = F.transform(F.filter(lines, lambda t: (heading(t) != "") | prose(t)), lambda t: F.when(heading(t) != "", heading(t)).otherwise(t))
    return F.try_element_at(found, F.lit(1))


def label_words(title: Column) -> Column:
    """Words of a title that may name a cluster: letters and digits only, 4 bytes or more, no stop words."""
    clean = F.transform(F.split(F.lower(F.coalesce(title, F.lit(""))), f"{SPACE}+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.filter(clean, lambda w: (F.octet_length(w) >= 4) & ~w.isin(LABEL_STOP_WORDS))


def title_case(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


# vectors: stored as FLOAT, computed in DOUBLE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: what stands inside a lambda is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    return let(norm(a) * norm(b), lambda n: F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0))


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    with_norm = let(v, lambda u: F.struct(u.cast("array<double>").alias("u"), norm(u).alias("n")))
    return let(with_norm, lambda s: F.when(s["n"] > 0, F.transform(s["u"], lambda x: x / s["n"])).otherwise(s["u"]))


def truncate_dims(v: Column, dims: int) -> Column:
    """The first dims numbers, normalised again."""
    return unit(F.slice(v, 1, dims))


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: ((h + i) mod 1000) / 500 - 1, normalised; h is the first 60 bits of the md5."""
    h = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("bigint")
    return unit(let(h, lambda k: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: ((k + i) % 1000) / 500.0 - 1.0)))
