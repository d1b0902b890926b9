"""Looking back along ordered rows without a window over a whole key.

Rows are dealt by ranges of their order, so a key that holds most rows lies in many tasks. Inside a
range a window looks back; what a range needs from those before it, the last row, the sum or whether
a value was there, comes from a table with a row for each key and range. Only keys that lie in more than
one range are in it, so it is small beside the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.selection import cut

#: Rows of a side that is broadcast at most; beyond it a join is shuffled, and split where it is skewed.
BROADCAST_ROWS = 100_000


def dealt(frame: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``__range`` and ``__place``, their range and their place in it, in the order of some columns."""
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    rows = frame.repartitionByRange(n, *by).sortWithinPartitions(*by)
    kept = cut(rows.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}))  # ids grow along a partition
    return kept.repartition(n, "__range", order[0])  # once for all that look back within a range by keys of which this is one


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join by keys that may be null to a table of one row for each: broadcast if it is small."""
    named = {c: f"__m_{i}" for i, c in enumerate(keys)}
    right = cut(right.withColumnsRenamed(named))
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(m)) for c, m in named.items()])
    return left.join(F.broadcast(right) if small else right, match, how).drop(*named.values())


def _over_ranges(rows: DataFrame, keys: list[str], each: Column, before) -> DataFrame:
    """keys, __range, __carried: what ``before`` makes of the ``each`` of the ranges before, for keys in more than one."""
    ranges = rows.groupBy(*keys, "__range").agg(each.alias("__each"))
    over = Window.partitionBy(*keys).orderBy("__range")
    return ranges.withColumn("__carried", before(F.col("__each"), over)).filter(F.col("__carried").isNotNull()).drop("__each")


def _inside(keys: list[str]):
    return Window.partitionBy("__range", *keys).orderBy("__place")


def last_before(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` of ``dealt`` with the value of the row before that has the same keys, null if there is none."""
    held = F.struct(value.alias("v"))
    carried = _over_ranges(rows, keys, F.max_by(held, "__place"), lambda each, over: F.lag(each).over(over))
    own = rows.withColumn("__own", F.lag(held).over(_inside(keys)))
    return matched(own, carried, [*keys, "__range"]).withColumn(name, F.coalesce("__own", "__carried")["v"]).drop("__own", "__carried")


def first_of(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """With 1 on the first row of its keys, 0 on the others."""
    carried = _over_ranges(rows, keys, F.lit(True), lambda each, over: F.lag(each).over(over))
    own = rows.withColumn("__own", F.row_number().over(_inside(keys)) == 1)
    return matched(own, carried, [*keys, "__range"]).withColumn(name, (F.col("__own") & F.col("__carried").isNull()).cast("int")).drop("__own", "__carried")


def sums_upto(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """With the sum of each named value over the rows of the same keys up to each; nulls add nothing."""
    each = F.struct(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])

    def before(each: Column, over) -> Column:
        past = over.rowsBetween(Window.unboundedPreceding, -1)
        return F.when(F.count("*").over(past) > 0, F.struct(*[F.sum(each[k]).over(past).alias(k) for k in sums]))

    carried = _over_ranges(rows, keys, each, before)
    upto = _inside(keys).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"__own_{k}": F.coalesce(F.sum(v).over(upto), F.lit(0)) for k, v in sums.items()})
    joined = matched(own, carried, [*keys, "__range"])
    return joined.withColumns({k: F.col(f"__own_{k}") + F.coalesce(F.col("__carried")[k], F.lit(0)) for k in sums}).drop("__carried", *[f"__own_{k}" for k in sums])


def places(frame: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``frame`` with the place of each row, from 0, among those of its keys in an order."""
    rows = sums_upto(dealt(frame, [*keys, *order]), keys, {name: F.lit(1)})
    return rows.withColumn(name, F.col(name) - 1).select(*frame.columns, name)
