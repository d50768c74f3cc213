"""Which entries of a query cache stay: least recently used ones go beyond a capacity, old ones at any rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep(entries: DataFrame, key: str, last_access: str, size: str, capacity: int, ttl: int) -> DataFrame:
    """Entries whose sizes, from the latest access on, sum up to capacity at most, accessed within ttl seconds before the newest.

    Two levels: sizes are summed by the second of access (as many rows as a ttl has seconds), running sums over those give each
    second its offset, and only then do entries of a second line up. No window spans all entries.
    """
    micros = F.unix_micros(F.col(last_access).cast("timestamp"))
    e = entries.withColumn("_s", F.floor(micros / 1_000_000))
    newest = e.agg(F.max(micros).alias("_newest"))
    e = e.crossJoin(F.broadcast(newest)).filter(micros >= F.col("_newest") - ttl * 1_000_000).drop("_newest")  # one row
    per = e.groupBy("_s").agg(F.sum(size).alias("_sum")).withColumn("_d", F.floor(F.col("_s") / 86400))
    days = per.groupBy("_d").agg(F.sum("_sum").alias("_day"))
    day_before = F.coalesce(F.sum("_day").over(Window.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a day
    days = days.select("_d", day_before.alias("_from_days"))
    within = F.coalesce(F.sum("_sum").over(Window.partitionBy("_d").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.withColumn("_within", within).join(F.broadcast(days), "_d").filter(F.col("_from_days") + F.col("_within") < capacity).select("_s", (F.col("_from_days") + F.col("_within")).alias("_offset"))
    line = Window.partitionBy("_s").orderBy(F.desc(last_access), key).rowsBetween(Window.unboundedPreceding, 0)
    used = e.join(offsets, "_s").withColumn("_used", F.col("_offset") + F.sum(size).over(line))
    return used.filter(F.col("_used") <= capacity).drop("_s", "_offset", "_used")
