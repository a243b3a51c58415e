"""Sentences with places for values, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentence(text: str, **values: Column | str) -> Column:
    """``text`` with each ``{name}`` filled in by the value of that name."""
    parts = re.split(r"\{(\w+)\}", text)
    filled = [F.lit(part) if i % 2 == 0 else values[part].cast("string") if isinstance(values[part], Column) else F.lit(values[part]) for i, part in enumerate(parts)]
    return F.concat(*filled)


def two_places(x: Column) -> Column:
    """A number from 0 up with two decimals, rounded by its exact value, ties up.

    The product with 100 is split into the rounded one and its error, so 0.995, which lies below
    its decimal form, becomes 0.99.
    """
    big = x * 134217729.0
    high = big - (big - x)
    hundredfold = x * 100.0
    error = (high * 100.0 - hundredfold) + (x - high) * 100.0
    whole = F.floor(hundredfold)
    part = hundredfold - whole
    n = whole + F.when((part > 0.5) | ((part == 0.5) & (error >= 0)), 1).otherwise(0)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
