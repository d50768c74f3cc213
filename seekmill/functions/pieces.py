"""Arrow UDFs in pieces: a batch may be of 10 000 long rows, and what is made for all of them takes many times their memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of which a worker holds the results at once.
PIECE = 128


def udf(run: Callable[..., pd.Series | pd.DataFrame], schema: str, *columns: Column) -> Column:
    """run over the columns, PIECE rows at a time; each piece's results leave the worker before the next piece is begun."""
    n = PIECE

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            for at in range(0, len(x), n):
                yield run(x.iloc[at : at + n])

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for xs in batches:
            for at in range(0, len(xs[0]), n):
                yield run(*(x.iloc[at : at + n] for x in xs))

    return F.pandas_udf(one if len(columns) == 1 else many, schema)(*columns)
