"""Exact dedup by skew-safe combining (operator 9).

Local stage: partial aggregation inside each input partition. Salted stage: the partitions' winners
meet by (digest, salt, content), where the salt is the input partition's number, so that a text with
a billion copies is merged by ``salts`` tasks. Global stage: at most ``salts`` winners of a text meet.
The content itself is a grouping key at every stage; the digest only spreads it, so two texts with the
same digest are never taken for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _orderable(kind: str) -> bool:
    return not any(x in kind for x in ("map<", "variant", "calendarinterval"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, extra: bool = False) -> DataFrame:
    """One row per distinct text: the id of the winner (smallest) and n_copies, the rows it stands for.

    extra=True keeps the winner's other columns as well (of rows that tie on the id, the smallest row's).
    NULL texts count as copies of one another, as in GROUP BY; so do empty texts. A NULL id loses to
    any other. Repeated rows count as copies. An empty table gives an empty result. Other columns, whatever
    their names, don't take part unless extra is set; then a column called n_copies is left out.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() != "n_copies"] if extra else []
    kinds = dict(docs.dtypes)
    if others:
        whole = F.struct(F.col(f"`{id_col}`"), *(F.col(f"`{c}`") for c in others))
        order = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), *(F.col(f"`{c}`") for c in others if _orderable(kinds[c])))
    else:
        whole = order = F.col(f"`{id_col}`")
    best = F.min_by("_win", "_order") if others else F.min("_win")
    order_again = [F.min("_order").alias("_order")] if others else []
    base = docs.select(
        F.xxhash64(f"`{text_col}`").alias("_digest"),
        (F.spark_partition_id() % salts).alias("_salt"),
        F.col(f"`{text_col}`").alias("_text"),
        whole.alias("_win"),
        *([order.alias("_order")] if others else []),
    )
    salted = base.groupBy("_digest", "_salt", "_text").agg(best.alias("_win"), *order_again, F.count(F.lit(1)).alias("_n"))
    winners = salted.groupBy("_digest", "_text").agg(best.alias("_win"), *order_again, F.sum("_n").alias("n_copies"))
    if others:
        return winners.select(F.col("_win")[id_col].alias(id_col), F.col("_text").alias(text_col), *(F.col("_win")[c].alias(c) for c in others), "n_copies")
    return winners.select(F.col("_win").alias(id_col), F.col("_text").alias(text_col), "n_copies")
