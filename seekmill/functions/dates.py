"""Dates in many spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format and the shape a text must have to be tried with it, so that no parser guesses.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", None),
    (r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "EEE, d MMM yyyy HH:mm:ss Z"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
)


def parse_date(text: Column) -> Column:
    """The timestamp (UTC session) of RFC 3339, RFC 2822 or plain dates; NULL for anything else."""
    tries = []
    for shape, fmt in FORMATS:
        if fmt is None:
            value = F.try_to_timestamp(F.upper(text))
        elif fmt.startswith("EEE, "):
            value = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]+, ", ""), F.lit(fmt[5:]))
        else:
            value = F.try_to_timestamp(text, F.lit(fmt))
        tries.append(F.when(text.rlike(shape), value))
    return F.coalesce(*tries)
