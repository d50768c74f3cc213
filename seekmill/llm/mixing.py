"""Mixing sources to target weights (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.llm.common import Scratch, fresh, word_count

#: A rates table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def source_rates(docs: DataFrame, tokens: Column, source_col: str = "source", weights: dict[str | None, float] | None = None, alpha: float = 0.7, budget: float | None = None) -> DataFrame:
    """(source, n_tokens, rate): how often each source's tokens are to be repeated.

    With weights: rate = budget * weight / sum of weights / tokens; budget defaults to all tokens there
    are; a source without a weight gets rate 0. Without: the weights are tokens ** alpha, and the budget
    is such that the largest source is taken exactly once, so nothing is lost:
    rate = (largest / tokens) ** (1 - alpha). A source without tokens gets rate 1 (0 if it has no weight).
    Rates are rounded to 6 places, so that every engine floors alike.
    """
    spark = docs.sparkSession
    per = docs.select(F.col(f"`{source_col}`").alias("source"), tokens.alias("t")).groupBy("source").agg(F.sum("t").alias("n_tokens"))
    if weights is None:
        most = per.agg(F.max("n_tokens").alias("most"))
        rate = F.when(F.col("n_tokens") > 0, F.pow(F.col("most") / F.col("n_tokens"), F.lit(1.0 - alpha))).otherwise(1.0)
        return per.crossJoin(F.broadcast(most)).select("source", "n_tokens", F.round(rate, 6).alias("rate"))
    total = float(sum(weights.values()))
    w = spark.createDataFrame([(k, v / total) for k, v in weights.items()], "source string, w double")
    budgeted = per.crossJoin(F.broadcast(per.agg((F.lit(budget) if budget else F.sum("n_tokens")).cast("double").alias("b"))))
    joined = budgeted.alias("p").join(w.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source")), "left")
    rate = F.when(F.col("w").isNull(), 0.0).when(F.col("n_tokens") > 0, F.col("b") * F.col("w") / F.col("n_tokens")).otherwise(1.0)
    return joined.select("p.source", "n_tokens", F.round(rate, 6).alias("rate"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and id; the same on any engine, partitioning and retry."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    alpha: float = 0.7,
    budget: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    copy_col: str | None = "copy",
    tokens: Column | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """docs with each row emitted floor(rate) times plus once more if uniform(id) < fraction of the rate.

    tokens is a row's number of tokens, such as a column of token_counts() joined to docs; words of the text by default. NULL counts as 0.
    copy_col numbers the copies from 0 (None: no such column; a clash gets underscores in front). NULL is a
    source like any other. A NULL or empty text has no tokens and is repeated as its source is; a very long one counts whole. A NULL id
    draws as the string 'null'; repeated rows draw alike. All other columns are kept as they are. An empty
    table gives an empty result. The rates (one row per source) are written to the shared folder and
    counted: up to BROADCAST_ROWS they are broadcast, so that documents aren't shuffled at all.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    rates = scratch.table(source_rates(docs, F.coalesce(tokens, F.lit(0)) if tokens is not None else word_count(F.col(f"`{text_col}`")), source_col, weights, alpha, budget), "rates")
    name, rate, times = (fresh(docs, x) for x in ("_mix_source", "_mix_rate", "_mix_n"))
    rates = rates.select(F.col("source").alias(name), F.col("rate").alias(rate))
    small = rates.count() <= BROADCAST_ROWS
    copy = fresh(docs, copy_col or "copy")
    joined = docs.join(F.broadcast(rates) if small else rates, docs[f"`{source_col}`"].eqNullSafe(F.col(name)))
    whole = F.floor(rate)
    n = whole + F.when(uniform(F.col(f"`{id_col}`"), seed) < F.col(rate) - whole, 1).otherwise(0)
    out = joined.withColumn(times, n).filter(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), (F.col(times) - 1).cast("int"))))
    return out.select(*(f"`{c}`" for c in docs.columns), *([copy] if copy_col else []))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n FROM documents),
per AS (SELECT source, sum(n) AS n_tokens FROM t GROUP BY 1),
r AS (SELECT source, round(CASE WHEN n_tokens > 0 THEN pow((SELECT max(n_tokens) FROM per)::DOUBLE / n_tokens, 0.3) ELSE 1 END, 6) AS rate FROM per),
u AS (SELECT t.doc_id, t.source, floor(rate) + CASE WHEN ('0x' || substr(md5('17:' || t.doc_id), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS k
  FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, unnest(range(k::BIGINT))::INT AS copy FROM u WHERE k > 0
"""
