"""robots.txt and politeness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.functions import text as T, urls


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a robots.txt pattern: a prefix, * for anything, $ at the end as an anchor."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(anchored, "$").otherwise(""))


def path_matches(path: Column, pattern: Column) -> Column:
    """B31; an empty pattern matches nothing."""
    return (pattern != "") & F.rlike(path, pattern_regex(pattern))


def parse_robots_text(content: str, user_agent: str) -> tuple[list[str], list[str], float | None]:
    """(disallow, allow, crawl delay) for an agent. A block that names the agent overrides * blocks before and after it."""
    rules: dict[str, list[str]] = {"disallow": [], "allow": []}
    delay, mine, specific, us = None, False, False, user_agent.lower()
    for line in map(str.strip, (content or "").splitlines()):
        name, colon, value = line.partition(":")
        if not colon or line.startswith("#"):
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            agent = value.lower()
            if agent == "*":
                mine = not specific
            else:
                mine = agent in us or us in agent
                if mine:
                    specific = True
                    rules = {"disallow": [], "allow": []}
        elif mine and value and name in rules:
            rules[name].append(value)
        elif mine and name == "crawl-delay":
            try:
                delay = float(value)
            except ValueError:
                pass
    return rules["disallow"], rules["allow"], delay


def parse_robots(content: Column, user_agent: str) -> Column:
    """struct(disallow, allow, crawl_delay)."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_robots_text(t, user_agent) for t in texts], columns=["disallow", "allow", "crawl_delay"])

    return F.pandas_udf(run, "disallow array<string>, allow array<string>, crawl_delay double")(content)


def allowed(requests: DataFrame, robots: DataFrame) -> DataFrame:
    """requests(url) with column allowed, by robots(host, allow, disallow): the longer match decides, ties allow, no robots allow.
    A host's patterns stay arrays and are searched row by row, so nothing is exploded."""
    longest = lambda patterns, p: F.coalesce(F.array_max(F.transform(F.filter(patterns, lambda x: path_matches(p, x)), lambda x: F.octet_length(x))), F.lit(0))
    joined = requests.withColumn("_host", urls.host(F.col("url"))).join(robots.select(F.col("host").alias("_host"), "allow", "disallow"), "_host", "left")
    none = F.array().cast("array<string>")
    ok = T.let(urls.path(F.col("url")), lambda p: longest(F.coalesce("allow", none), p) >= longest(F.coalesce("disallow", none), p))
    return joined.withColumn("allowed", ok).drop("_host", "allow", "disallow")


def delay_seconds(crawl_delay: Column, default: float = 1.0, low: float = 0.5, high: float = 30.0) -> Column:
    """The host's own delay within bounds, else the default."""
    return F.when(crawl_delay.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), crawl_delay)))


def backoff_seconds(consecutive_429: Column, retry_after: Column | None = None) -> Column:
    """30 s, doubled up to the fourth 429 in a row, at most 600 s; the server's own wish comes first."""
    own = F.lit(30.0) * F.pow(F.lit(2.0), F.least(consecutive_429, F.lit(4)) - 1)
    return F.least(F.coalesce(retry_after, own) if retry_after is not None else own, F.lit(600.0))


def fetch_decision(elapsed: Column, delay: Column, backoff_left: Column) -> Column:
    """rate_limited within a backoff, wait within the delay since the last fetch, else allowed."""
    return F.when(F.coalesce(backoff_left, F.lit(0.0)) > 0, "rate_limited").when(elapsed < delay, "wait").otherwise("allowed")
