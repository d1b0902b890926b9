"""Aggregates over the last w rows of an object for many widths and columns at once.

Rows are numbered in the order of objects and time, by ranges. Blocks of ``BLOCK`` numbers go
to tasks, each with the rows before it that the longest width can reach, its *halo*. So an
object of any length is spread over many tasks, and a task holds a block and a halo, whatever it holds.

Within a block every column is one numpy array. Sums, extremes and central moments of 2, 4, 8, ...
rows are merged from halves (Chan's formula for moments, so nothing cancels), and a width
is put together from its powers of two. Quantiles come from a wavelet matrix, built once for a column:
it gives the k-th smallest value of any stretch in as many steps as the block has
binary digits, for all rows and widths together. A stretch that an earlier width covers already is not asked again.

Nulls and NaN are left out; an aggregate of them alone is null, a deviation of one value too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tracewright.operators.selection import _running

#: Numbers of a block; and rows of a block that leave it together.
BLOCK, OUT = 8192, 2048
#: Aggregates beside quantiles, in their order.
PLAIN = ("max", "min", "mean", "std", "sum")


class Wavelet:
    """The k-th smallest of any stretch of an array of ranks: a table of zeros before each place, for each binary digit."""

    def __init__(self, ranks: np.ndarray):
        self.digits = max(1, int(ranks.max(initial=0)).bit_length())
        self.before = []
        for digit in range(self.digits - 1, -1, -1):
            ones = (ranks >> digit) & 1
            self.before.append(np.concatenate(([0], np.cumsum(1 - ones))))
            ranks = np.concatenate((ranks[ones == 0], ranks[ones == 1]))

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Ranks of the k-th smallest, from 0, of the stretches from begin to before end."""
        out = np.zeros(len(k), np.int64)
        for before in self.before:
            low, high = before[begin], before[end]
            zeros = high - low
            one = k >= zeros
            out = 2 * out + one
            k = np.where(one, k - zeros, k)
            begin = np.where(one, before[-1] + begin - low, low)
            end = np.where(one, before[-1] + end - high, high)
        return out


def _merged(kinds: set[str], a: dict, b: dict, here: np.ndarray) -> dict:
    """Aggregates of two stretches; where ``here`` is false the second is empty."""
    out = {}
    n, m = a["n"], np.where(here, b["n"], 0)
    out["n"] = n + m
    if "max" in kinds:
        out["max"] = np.maximum(a["max"], np.where(here, b["max"], -np.inf))
    if "min" in kinds:
        out["min"] = np.fmin(a["min"], np.where(here, b["min"], np.inf))
    if "sum" in kinds:
        out["sum"] = a["sum"] + np.where(m > 0, b["sum"], 0.0)
    if "mean" in kinds or "std" in kinds:
        whole = np.maximum(out["n"], 1)
        apart = np.where(m > 0, b["mean"] - a["mean"], 0.0)
        alone = n == 0
        out["mean"] = np.where(alone, np.where(m > 0, b["mean"], 0.0), a["mean"] + apart * (m / whole))
        if "std" in kinds:
            out["m2"] = np.where(alone, np.where(m > 0, b["m2"], 0.0), a["m2"] + np.where(m > 0, b["m2"], 0.0) + apart * apart * (n * (m / whole)))
    return out


def windowed(values: np.ndarray, first: np.ndarray, widths: list[int], kinds: tuple[str, ...], quantiles: tuple[float, ...]) -> dict[tuple[int, str], np.ndarray]:
    """(width, aggregate): one array each, NaN for null; ``values`` has NaN for null, ``first`` the place where each row's object begins.

    ``kinds`` are of max, min, mean, std, sum and q.
    """
    n, out = len(values), {}
    known, needed = ~np.isnan(values), set(kinds) - {"q"}
    place = np.arange(n)
    if needed:
        plain = np.where(known, values, 0.0)
        level = {"n": known.astype(np.int64), "max": np.where(known, values, -np.inf), "min": np.where(known, values, np.inf), "sum": plain, "mean": plain, "m2": np.zeros(n)}
        ready: dict[int, tuple[dict, np.ndarray]] = {}  # what a width has so far, and the row that follows it on the left
        size = 1
        while size <= max(widths):
            for w in widths:
                if w & size:
                    if w not in ready:
                        ready[w] = (level, place - size)
                    else:
                        done, left = ready[w]
                        here = left >= first
                        at = np.where(here, left, 0)
                        ready[w] = (_merged(needed, done, {k: v[at] for k, v in level.items()}, here), left - size)
            if 2 * size <= max(widths):
                left = place - size
                here = left >= first
                at = np.where(here, left, 0)
                level = _merged(needed, level, {k: v[at] for k, v in level.items()}, here)
            size *= 2
        for w in widths:
            got, none = ready[w][0], ready[w][0]["n"] == 0
            for k in needed:
                if k == "std":
                    some = got["n"] > 1
                    out[w, k] = np.where(some, np.sqrt(got["m2"] / np.where(some, got["n"] - 1, 1)), np.nan)
                else:
                    out[w, k] = np.where(none, np.nan, got[k])
    if "q" in kinds:
        sorted_values, ranks = np.unique(values[known], return_inverse=True)
        upto = np.concatenate(([0], np.cumsum(known)))
        wavelet = Wavelet(ranks.astype(np.int64)) if len(ranks) else None
        covered, last = None, {q: np.full(n, np.nan) for q in quantiles}
        for w in sorted(widths):
            begin = np.maximum(first, place - w + 1)
            last = {q: x.copy() for q, x in last.items()}
            ask = place if covered is None else np.flatnonzero(begin != covered)
            covered = begin
            low, high = upto[begin[ask]], upto[ask + 1]
            ask, low, high = (x[high > low] for x in (ask, low, high))
            for q in quantiles:
                if len(ask):
                    last[q][ask] = _interpolated(wavelet, sorted_values, low, high, q)
                out[w, f"q{round(q * 100)}"] = last[q]
    return out


def _interpolated(wavelet: Wavelet, values: np.ndarray, begin: np.ndarray, end: np.ndarray, q: float) -> np.ndarray:
    at = (end - begin - 1) * q
    below = np.floor(at).astype(np.int64)
    low = values[wavelet.kth(begin, end, below)]
    high, between = low.copy(), at > below
    high[between] = values[wavelet.kth(begin[between], end[between], below[between] + 1)]
    return np.where(low == high, low, low + (high - low) * (at - below))


def _dealt(frame: DataFrame, keys: list[str], order: list[str], widths, block: int) -> DataFrame:
    """The rows with __at and __block, in their order, each in its block and in those whose halo holds it."""
    longest = max(widths)
    numbered = _running(frame, [F.col(c).asc_nulls_first() for c in (*keys, *order)], F.lit(1), "__at")
    own = F.floor(F.col("__at") / block)
    reach = F.floor((F.col("__at") + longest - 1) / block)  # the last block whose halo holds the row
    sent = numbered.withColumn("__block", F.explode(F.sequence(own, reach)))
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "__block").sortWithinPartitions("__block", "__at")


def rolled(
    frame: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, ...]], widths: tuple[int, ...], quantiles: tuple[float, ...], long: bool = False, block: int = BLOCK,
) -> DataFrame:
    """``frame`` with ``<column>__<aggregate>_<width>`` for each wanted column, its kinds, and each width.

    A row's frame is itself and the width - 1 rows before it that share its keys, by ``order``; rows that
    tie in it come in any order, as in a window. In the ``long`` form there is a row for each row of ``frame``, wanted column
    (``feature``) and ``width``, with all aggregates, null where the column has none, and the wanted columns themselves are left out.
    """
    widths, dealt = sorted(widths), _dealt(frame, keys, order, widths, block)
    places = [f"q{round(q * 100)}" for q in quantiles]
    of = {c: [k for kind in kinds for k in (places if kind == "q" else [kind])] for c, kinds in wanted.items()}
    names = [(c, k, w) for w in widths for c in wanted for k in of[c]]
    kept = [f for f in frame.schema.fields if not long or f.name not in wanted]
    plain, every = [f.name for f in kept], [*PLAIN, *places]
    made = [StructField("feature", StringType()), StructField("width", IntegerType()), *(StructField(k, DoubleType()) for k in every)] if long else [StructField(f"{c}__{k}_{w}", DoubleType()) for c, k, w in names]
    shape = StructType([*kept, *made])

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, "__block"):
            mine = rows.column("__at").to_numpy() // block == rows.column("__block")[0].as_py()
            if not mine.any():
                continue  # the halo of a block beyond the last row
            first = _begins(rows, keys)
            values = {c: pc.cast(rows.column(c), pa.float64()).to_numpy() for c in wanted}
            mine_rows = rows.filter(pa.array(mine)).select(plain).combine_chunks()
            parts = [slice(at, at + OUT) for at in range(0, mine_rows.num_rows, OUT)]
            still = [[mine_rows.column(c).slice(p.start, OUT).combine_chunks() for c in plain] for p in parts]
            array = lambda x: pa.array(x, from_pandas=True)
            if long:
                for c, kinds in wanted.items():
                    got = windowed(values[c], first, widths, kinds, quantiles)
                    for w in widths:
                        for p, part in zip(parts, still, strict=True):
                            m = len(mine_rows.slice(p.start, OUT))
                            columns = [array(got[w, k][mine][p]) if k in of[c] else pa.nulls(m, pa.float64()) for k in every]
                            yield pa.RecordBatch.from_arrays([*part, pa.array([c] * m), pa.array([w] * m, pa.int32()), *columns], shape.names)
            else:
                got = {(c, k, w): x[mine] for c, kinds in wanted.items() for (w, k), x in windowed(values[c], first, widths, kinds, quantiles).items()}
                for p, part in zip(parts, still, strict=True):
                    yield pa.RecordBatch.from_arrays([*part, *(array(got[name][p]) for name in names)], shape.names)

    return dealt.select(*frame.columns, "__at", "__block").mapInArrow(in_task, shape)


def rolled_means(
    frame: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, ...]], widths: tuple[int, ...], quantiles: tuple[float, ...], by: list[str], block: int = BLOCK,
) -> DataFrame:
    """by, feature, width, n and the mean of each aggregate over the rows of each group: what the long form of ``rolled`` gives, averaged.

    Tasks send a sum and a count of each aggregate for each group of a block, not the rows.
    """
    widths = sorted(widths)
    places = [f"q{round(q * 100)}" for q in quantiles]
    of = {c: [k for kind in kinds for k in (places if kind == "q" else [kind])] for c, kinds in wanted.items()}
    every = [*PLAIN, *places]
    sums = [StructField("feature", StringType()), StructField("width", IntegerType()), StructField("__n", LongType())]
    sums += [f for k in every for f in (StructField(f"__sum_{k}", DoubleType()), StructField(f"__count_{k}", LongType()))]
    shape = StructType([*(frame.schema[c] for c in by), *sums])

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, "__block"):
            mine = rows.column("__at").to_numpy() // block == rows.column("__block")[0].as_py()
            if not mine.any():
                continue
            first = _begins(rows, keys)
            own = rows.filter(pa.array(mine)).select(by).append_column("__row", pa.array(np.arange(mine.sum())))
            groups = own.group_by(by, use_threads=False).aggregate([("__row", "list")])
            held = groups.column("__row_list").combine_chunks()
            owner = np.empty(mine.sum(), np.int64)
            owner[held.flatten().to_numpy()] = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
            m = len(held)
            n = np.bincount(owner, minlength=m)
            kept = [groups.column(c).combine_chunks() for c in by]
            for c in wanted:
                got = windowed(pc.cast(rows.column(c), pa.float64()).to_numpy(), first, widths, wanted[c], quantiles)
                for w in widths:
                    columns = [pa.array([c] * m), pa.array([w] * m, pa.int32()), pa.array(n, pa.int64())]
                    for k in every:
                        x = got[w, k][mine] if k in of[c] else None
                        known = None if x is None else ~np.isnan(x)
                        columns += [pa.nulls(m, pa.float64()), pa.array(np.zeros(m, np.int64))] if x is None else [pa.array(np.bincount(owner, np.where(known, x, 0.0), m)), pa.array(np.bincount(owner, known, m).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*kept, *columns], shape.names)

    needed = list(dict.fromkeys([*keys, *by, *wanted, "__at", "__block"]))
    sent = _dealt(frame, keys, order, widths, block).select(*needed).mapInArrow(in_task, shape)
    means = [F.try_divide(F.sum(f"__sum_{k}"), F.sum(f"__count_{k}")).alias(k) for k in every]
    return sent.groupBy(*by, "feature", "width").agg(F.sum("__n").alias("n"), *means)


def _begins(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """For each row the place of the first of the rows just before it that share its keys."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in keys:
        x = rows.column(c).combine_chunks()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        same = pc.fill_null(pc.equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False)
        null = x.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (null[1:] & null[:-1]))
    return np.maximum.accumulate(np.where(new, np.arange(rows.num_rows), 0))


def _blocks(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Rows of each value of a column in turn; rows are sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        value = b.column(by).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(start, end - start)
            if held and len(part) and held[0].column(by)[0] != part.column(by)[0]:
                yield pa.Table.from_batches(held)
                held = []
            if len(part):
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)
