"""Read ids: separators, tokens, and the affix match with the row before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators of an id.
SEPARATORS = r"[/:= _.,\-#\r\t\n]"


def separators(c: Column) -> Column:
    """The separators in order, without any at the first place."""
    return F.regexp_extract_all(F.substring(c, F.lit(2), F.length(c)), F.lit(SEPARATORS), F.lit(0))


def tokens(c: Column) -> Column:
    """Tokens between separators; the first keeps its leading mark."""
    rest = F.split(F.substring(c, F.lit(2), F.length(c)), SEPARATORS, -1)
    return F.transform(rest, lambda x, i: F.when(i == 0, F.concat(F.substring(c, 1, 1), x)).otherwise(x))


def prefix_length(a: Column, b: Column) -> Column:
    """Length of the common prefix: the first place where two characters differ, found in one pass over the shorter."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    at = F.array_position(F.slice(same, F.lit(1), F.greatest(n, F.lit(1))), F.lit(False))
    return F.when((n == 0) | n.isNull(), F.lit(0)).when(at > 0, at - 1).otherwise(n).cast("long")


def suffix_length(a: Column, b: Column) -> Column:
    return prefix_length(F.reverse(a), F.reverse(b))
