"""Numbers, dates and sizes from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def convert_num(c: Column) -> Column:
    """Number of a text with commas between digits, else null."""
    return F.translate(F.trim(c), ",", "").try_cast("double")


def get_date(c: Column) -> Column:
    """`3 March 1951`, `March 3, 1951`, `March 1951` -> ISO date text (first of the month without a day), else null."""
    t = F.trim(c)
    formats = ("d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy")
    return F.date_format(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]), "yyyy-MM-dd")


def size_text(c: Column) -> Column:
    """Bytes as text in steps of 1024 with one decimal."""
    out = F.format_string("%.1f TB", F.bround(c / F.lit(1024.0**4), 1))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(c < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(c / F.lit(1024.0**k), 1))).otherwise(out)
    return out


def binomial(n: Column, k: Column) -> Column:
    """n over k, 0 where n < k or k < 0; exact up to 2^53."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    product = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)
    return F.when((n < k) | (k < 0), F.lit(0)).when(k == 0, F.lit(1)).otherwise(F.round(product)).cast("bigint")


def time_literal(c: Column) -> Column:
    """`+1823-00-00T00:00:00Z` -> `1823-00-00`; a minus stays."""
    return F.regexp_replace(F.regexp_replace(c, r"^\+", ""), r"T00:00:00Z$", "")


def amount(c: Column) -> Column:
    return F.regexp_replace(c, r"^\+", "")
