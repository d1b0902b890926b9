"""Quantile sketches that are stored once and rolled up by any of their dimensions without the rows.

Sketches are those that Spark has (KLL): a quantile's rank is off by at most ``error(k)`` of all
values, with 99 percent of certainty. ``ranks`` is the exact way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: a few times as many numbers are kept.
K = 1600


def error(k: int = K) -> float:
    """Greatest error of a rank as a share of all values (published for these sketches)."""
    return 2.296 / k**0.9723


def sketches(frame: DataFrame, dims: dict[str, Column], numbers: dict[str, Column], k: int = K) -> DataFrame:
    """dims, number, n, sketch: of the values of each number that are not null, in one pass with partial sketches before the shuffle."""
    made = [F.struct(F.lit(name).alias("number"), F.count(c).alias("n"), F.kll_sketch_agg_double(c.cast("double"), k).alias("sketch")) for name, c in numbers.items()]
    rows = frame.groupBy(*[c.alias(name) for name, c in dims.items()]).agg(F.array(*made).alias("__all"))
    return rows.select(*dims, F.inline("__all")).filter("n > 0")


def rolled_up(sketched: DataFrame, dims: list[str], k: int = K) -> DataFrame:
    """dims, number, n, sketch: sketches merged over all other dimensions."""
    return sketched.groupBy(*dims, "number").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketched: DataFrame, places: tuple[float, ...]) -> DataFrame:
    """The sketches with ``quantiles``, an array in the order of the places."""
    picks = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in places]
    return sketched.withColumn("quantiles", F.array(*picks)).drop("sketch")
