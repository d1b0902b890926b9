"""Exact ranks and quantiles by groups, from counts of distinct values.

No task holds a column: values are counted, ranks come from running sums over ranges of
(group, value), and only the rows that hold a sought rank are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from tracewright.operators.selection import _running, cut

#: Groups whose sizes are broadcast at most.
BROADCAST_GROUPS = 100_000


def ranked(frame: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value, n, below, size: each distinct value, its count, values below it, and values in all of its group. Nulls are left out."""
    counts = frame.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    order = [F.col(c).asc_nulls_first() for c in (*groups, value)]
    placed = cut(_running(counts, order, F.col("n"), "__upto"))
    named = {c: f"__g_{i}" for i, c in enumerate(groups)}
    whole = placed.groupBy(*[F.col(c).alias(g) for c, g in named.items()]).agg(F.min("__upto").alias("__start"), F.sum("n").alias("size"))
    whole = cut(whole)
    small = whole.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(g)) for c, g in named.items()], F.lit(True))
    joined = placed.join(F.broadcast(whole) if small else whole, match) if groups else placed.crossJoin(F.broadcast(whole))  # without groups one row
    return joined.select(*groups, value, "n", (F.col("__upto") - F.col("__start")).alias("below"), "size")


#: Buckets of a group's values; only those that hold a sought place are ranked.
BUCKETS = 512


def quantiles(frame: DataFrame, groups: list[str], value: str, levels, linear: bool = True) -> DataFrame:
    """groups, size, quantiles: an array in the order of the levels, interpolated or of the nearest rank."""
    return of_ranks(sought(frame, groups, value, levels, linear), groups, value, levels, linear)


def sought(frame: DataFrame, groups: list[str], value: str, levels, linear: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """What ``ranked`` gives, of the values near the sought places alone.

    Values are counted by buckets of equal width between the least and the greatest of their group, those in the first of them, where
    values with a long tail gather, by the logarithm of what they exceed the least by. The values of the
    few buckets in which a place falls are counted and put in order, the others only counted.
    """
    x = F.col(value).cast("double")
    rows = frame.filter(F.col(value).isNotNull()).select(*groups, value)
    finite = F.when((F.abs(x) < float("inf")) & ~F.isnan(x), x)
    edges = rows.groupBy(*groups).agg(F.min(finite).alias("__low"), F.max(finite).alias("__high"), F.count("*").alias("__size"))
    above, spread = x - F.col("__low"), F.col("__high") - F.col("__low")
    floor = lambda share: F.coalesce(F.greatest(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.lit(0)), F.lit(0))
    even, fine = floor(above / F.nullif(spread, F.lit(0.0))), floor(F.log1p(F.greatest(above, F.lit(0.0))) / F.nullif(F.log1p(spread / buckets), F.lit(0.0)))
    place = F.when(F.isnan(x), 2 * buckets).when(even > 0, buckets + even).otherwise(fine)
    edges = cut(edges)
    met = _met(rows, edges, groups).withColumn("__bucket", place.cast("int"))
    sums = met.groupBy(*groups, "__bucket", "__size").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    low, high = _places(levels, F.col("__size"), linear)
    holds = lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("__n"))
    wanted = cut(sums.filter(F.exists(F.concat(low, high), holds)).select(*groups, "__bucket", "__before"))
    near = ranked(_met(met, wanted, [*groups, "__bucket"], "inner").select(*groups, "__bucket", value), [*groups, "__bucket"], value)
    whole = _met(_met(near, wanted, [*groups, "__bucket"]), edges.select(*groups, "__size"), groups)
    return whole.select(*groups, value, "n", (F.col("below") + F.col("__before")).alias("below"), F.col("__size").alias("size"))


def _places(levels, size: Column, linear: bool) -> tuple[Column, Column]:
    """The ranks that the levels need, below and above."""
    at = [(size - 1) * float(q) for q in levels]
    return (F.array(*[F.floor(a) for a in at]), F.array(*[F.ceil(a) for a in at])) if linear else (F.array(*[F.rint(a).cast("bigint") for a in at]),) * 2


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join to a table of one row for each of the keys, which may be null."""
    named = {c: f"__g_{i}" for i, c in enumerate(keys)}
    other = right.withColumnsRenamed(named)
    small = right.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(g)) for c, g in named.items()], F.lit(True))
    other = F.broadcast(other) if small else other
    return (left.join(other, match, how) if keys else left.crossJoin(other)).drop(*named.values())  # without keys one row


def of_ranks(ranks: DataFrame, groups: list[str], value: str, levels, linear: bool = True) -> DataFrame:
    """The same from a table of ranks: each row looks up which places lie in its stretch, however many levels there are."""
    q = np.array([float(x) for x in levels])
    shape = StructType([*ranks.select(*groups, "size", value).schema.fields, StructField("i", IntegerType()), StructField("part", DoubleType()), StructField("is_low", BooleanType())])
    names = [*shape.names[: len(groups) + 1], "__v", *shape.names[-3:]]
    shape = StructType([StructField(name, f.dataType) for name, f in zip(names, shape.fields, strict=True)])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            below, upto, size = (b.column(k).to_numpy() for k in ("__below", "__upto", "size"))
            order = np.argsort(size, kind="stable")
            starts = np.flatnonzero(np.diff(size[order], prepend=-1))
            rows, found = [], []
            for mine in np.split(order, starts[1:]) if len(order) else ():  # rows of one size have the same places
                at = (size[mine[0]] - 1) * q
                for low in (True, False):
                    sought = (np.floor(at) if low else np.ceil(at)) if linear else np.rint(at)
                    by = np.argsort(sought, kind="stable")
                    first, last = (np.searchsorted(sought[by], x[mine], "left") for x in (below, upto))
                    hit = np.flatnonzero(last > first)
                    many = (last - first)[hit]
                    i = by[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[hit], many)]
                    rows.append(np.repeat(mine[hit], many))
                    found.append((i, (at - np.floor(at))[i], np.full(len(i), low)))
            if any(map(len, rows)):
                i, part, low = (np.concatenate(x) for x in zip(*found, strict=True))
                kept = b.drop_columns(["__below", "__upto"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(i, pa.int32()), pa.array(part), pa.array(low)], names)

    hits = ranks.select(*groups, "size", F.col(value).alias("__v"), F.col("below").alias("__below"), (F.col("below") + F.col("n")).alias("__upto")).mapInArrow(held, shape)
    each = hits.groupBy(*groups, "size", "i", "part").agg(F.max(F.when(F.col("is_low"), F.col("__v"))).alias("low"), F.max(F.when(~F.col("is_low"), F.col("__v"))).alias("high"))
    picked = F.when(F.col("low") == F.col("high"), F.col("low").cast("double")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    one = picked if linear else F.col("low")
    return each.groupBy(*groups, "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("v")))), lambda x: x["v"]).alias("quantiles"))


def median(frame: DataFrame, value: Column) -> DataFrame:
    """One row with ``median``; null for an empty table."""
    found = quantiles(frame.select(value.alias("v")), [], "v", [0.5])
    return found.agg(F.max(F.col("quantiles")[0]).alias("median"))
