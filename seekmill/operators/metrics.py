"""Latency histograms and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 5000.0)


def bucket(ms: Column) -> Column:
    """The smallest bound that isn't exceeded; infinity beyond all."""
    out = F.lit(float("inf"))
    for b in reversed(BOUNDS):
        out = F.when(ms <= b, b).otherwise(out)
    return out


def histogram(samples: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, le, n, cumulative, total, mean): counts by bucket of those that occur, running sums, and the group's mean."""
    per = samples.groupBy(*by, bucket(F.col(value)).alias("le")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    whole = Window.partitionBy(*by)
    running = whole.orderBy("le")
    return per.select(*by, "le", "n", F.sum("n").over(running).alias("cumulative"), F.sum("n").over(whole).alias("total"), F.round(F.sum("s").over(whole) / F.sum("n").over(whole), 4).alias("mean"))


def prometheus(hist: DataFrame, name: str, by: str) -> DataFrame:
    """Lines of the text format, one a bucket."""
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_string("%.0f", F.col("le")))
    return hist.select(F.concat(F.lit(f'{name}_bucket{{{by}="'), F.col(by), F.lit('",le="'), le, F.lit('"} '), F.col("cumulative").cast("string")).alias("line"))
