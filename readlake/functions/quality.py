"""Quality strings: symbols, quantisation, running mean, contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quantised value of each symbol 0..127, which contexts are made of.
QUANT = (
    1, 1, 2, 2, 4, 4, 5, 6, 7, 7, 6, 6, 7, 7, 9, 9, 10, 11, 12, 12,
    11, 11, 12, 12, 14, 14, 15, 16, 17, 17, 16, 16, 17, 17, 19, 19, 20, 21, 22, 22,
    21, 21, 22, 22, 24, 24, 25, 26, 27, 27, 26, 26, 27, 27, 29, 29, 30, 31, 32, 32,
    31, 31, 32, 32, 34, 34, 35, 36, 37, 37, 36, 36, 37, 37, 39, 39, 40, 41, 42, 42,
    41, 41, 42, 42, 44, 44, 45, 46, 47, 47, 46, 46, 47, 47, 49, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 0, 0, 0,
)


def quant(q: int) -> int:
    return QUANT[q]


def quantised(q: Column) -> Column:
    return F.get(F.array(*map(F.lit, QUANT)), q.cast("int"))


def symbols(qual: Column) -> Column:
    """``ch - '!'`` of each character."""
    return F.transform(F.filter(F.split(qual, ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)
