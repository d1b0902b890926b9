"""Aggregates whose null, tie and zero cases the built-in ones settle otherwise."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_with_null(c: Column) -> Column:
    """Number of distinct values, null being one."""
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null, not an error, against a constant.

    Moments are central ones, so that large values such as times cancel nothing.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    under = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), F.when(under > 0, under))


def entropy2(counts: list[Column]) -> Column:
    """Entropy to base 2 of counts that stand in columns."""
    total = reduce(add, counts)
    part = [F.try_divide(c.cast("double"), total) for c in counts]
    return reduce(add, [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in part])


def signed_log1p(c: Column) -> Column:
    return F.when(c < 0, -F.log1p(-c)).otherwise(F.log1p(c))


def clip(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def u01(key: Column, salt: str) -> Column:
    """A number in [0, 1) from a key and a salt, alike in every engine."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def u01_sql(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5({key} || '{salt}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
