"""Correlations of any number of columns in one read, from blocks of their products.

Each task sums up the products of its columns about a shift of its own, a middle value of its
first rows, so that large values cancel nothing and a constant stays exactly zero. Its sums leave in
blocks of ``BLOCK`` by ``BLOCK`` columns; a block is added up in the task that it goes to, where sums about different
shifts are brought to one. Only pairs leave there: all, or those above a limit.

Pairs are complete ones: a row counts for a pair if both values are there. While a task has met no
missing value, counts and sums are those of the columns, and only products are kept for pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block, rows that are multiplied at once, tasks that sum up at most.
BLOCK, ROWS, PARTS = 128, 4096, 512
_SHAPE = "i int, j int, part int, shifts binary, whole boolean, sums binary"


class Sums:
    """Counts, sums, squares and products of columns about a shift."""

    def __init__(self, width: int):
        self.shift: np.ndarray | None = None
        self.n, self.one, self.two = 0, np.zeros(width), np.zeros(width)
        self.products = np.zeros((width, width))
        self.pairs: list[np.ndarray] | None = None  # count, sum and squares of a where b is there

    def add(self, x: np.ndarray) -> None:
        """Rows of values; what is not finite is missing."""
        known = np.isfinite(x)
        if self.shift is None:
            with np.errstate(all="ignore"):
                some = np.where(known, x, np.nan)[:101]
                middle = np.sort(some, axis=0)  # NaN last
                count = np.isfinite(some).sum(axis=0)
                self.shift = np.where(count > 0, np.nan_to_num(middle[np.maximum(count - 1, 0) // 2, np.arange(x.shape[1])]), 0.0)
        complete = known.all()
        z = np.where(known, x - self.shift, 0.0) if not complete else x - self.shift
        if not complete and self.pairs is None:
            width = x.shape[1]
            self.pairs = [np.full((width, width), float(self.n)), np.repeat(self.one[:, None], width, 1), np.repeat(self.two[:, None], width, 1)]
        if self.pairs is None:
            self.n += len(x)
            self.one += z.sum(axis=0)
            self.two += (z * z).sum(axis=0)
        else:
            there = known.astype(np.float64)
            for total, left in zip(self.pairs, (there, z, z * z), strict=True):
                total += left.T @ there
        self.products += z.T @ z

    def blocks(self, part: int, block: int) -> Iterator[tuple]:
        width = len(self.one)
        edges = [slice(a, a + block) for a in range(0, width, block)]
        for i, a in enumerate(edges):
            for j, b in enumerate(edges[i:], i):
                if self.pairs is None:
                    sums = [np.array([self.n], float), self.one[a], self.two[a], self.one[b], self.two[b], self.products[a, b]]
                else:
                    n, one, two = self.pairs
                    sums = [n[a, b], one[a, b], two[a, b], one[b, a].T, two[b, a].T, self.products[a, b]]
                yield i, j, part, np.concatenate((self.shift[a], self.shift[b])).tobytes(), self.pairs is None, np.concatenate([x.ravel() for x in sums]).tobytes()


def _expanded(shifts: np.ndarray, whole: bool, sums: np.ndarray, p: int, q: int) -> tuple[np.ndarray, ...]:
    """count, sum and squares of a, of b, products, each p by q, and both shifts."""
    if not whole:
        parts = sums.reshape(6, p, q)
    else:
        n, rest = sums[0], sums[1:]
        cuts = np.split(rest, np.cumsum([p, p, q, q]))
        parts = [np.full((p, q), n), *(np.repeat(x[:, None], q, 1) for x in cuts[:2]), *(np.repeat(x[None, :], p, 0) for x in cuts[2:4]), cuts[4].reshape(p, q)]
    return (*parts, shifts[:p], shifts[p:])


def _about(parts: tuple[np.ndarray, ...], a0: np.ndarray, b0: np.ndarray) -> list[np.ndarray]:
    """The same sums about other shifts."""
    n, a1, a2, b1, b2, ab, a, b = parts
    d, e = (a - a0)[:, None], (b - b0)[None, :]
    return [n, a1 + n * d, a2 + 2 * d * a1 + n * d * d, b1 + n * e, b2 + 2 * e * b1 + n * e * e, ab + e * a1 + d * b1 + n * d * e]


def _numbers(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as numbers c0, c1, ...; written as text, as thousands of column objects take seconds to make."""
    return frame.selectExpr(*[f"cast(`{c}` as double) c{i}" for i, c in enumerate(columns)])


def correlations(frame: DataFrame, columns: list[str], above: float | None = None, block: int = BLOCK) -> DataFrame:
    """feature, neighbor, corr for each pair in the order of names, or for those beyond ``above`` in absolute value.

    Null against a constant; null, NaN and infinite values count as missing.
    """
    names = sorted(columns)
    spark = frame.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "feature string, neighbor string, corr double")
    wide = _numbers(frame, names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = Sums(len(names))
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                sums.add(np.stack([pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False) for c in part.columns], axis=1))
        if sums.shift is not None:
            for row in sums.blocks(TaskContext.get().partitionId(), block):
                yield pa.RecordBatch.from_pylist([dict(zip(("i", "j", "part", "shifts", "whole", "sums"), row, strict=True))], pa.schema([("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()), ("shifts", pa.binary()), ("whole", pa.bool_()), ("sums", pa.binary())]))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, shifts = None, None, None
        for b in batches:
            for row in b.itertuples(index=False):
                p, q = (min(block, len(names) - k * block) for k in (row.i, row.j))
                parts = _expanded(np.frombuffer(row.shifts), row.whole, np.frombuffer(row.sums), p, q)
                if key != (row.i, row.j):
                    if key is not None:
                        yield pairs(key, total)
                    key, shifts, total = (row.i, row.j), parts[6:], list(parts[:6])
                else:
                    total = [x + y for x, y in zip(total, _about(parts, *shifts), strict=True)]
        if key is not None:
            yield pairs(key, total)

    def pairs(key: tuple[int, int], total: list[np.ndarray]) -> pd.DataFrame:
        n, a1, a2, b1, b2, ab = total
        with np.errstate(all="ignore"):
            va, vb = a2 - a1 * a1 / n, b2 - b1 * b1 / n
            corr = np.where((va > 0) & (vb > 0), (ab - a1 * b1 / n) / (np.sqrt(va) * np.sqrt(vb)), np.nan)
            corr = np.clip(corr, -1, 1)
            keep = np.ones(corr.shape, bool) if above is None else np.abs(corr) > above
        if key[0] == key[1]:
            keep &= np.triu(np.ones(corr.shape, bool), 1)
        i, j = np.nonzero(keep)
        first, second = np.array(names[key[0] * block :][:block], object), np.array(names[key[1] * block :][:block], object)
        return pd.DataFrame({"feature": first[i], "neighbor": second[j], "corr": corr[i, j]})

    sent = wide.coalesce(PARTS).mapInArrow(summed, _SHAPE)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(n, "i", "j").sortWithinPartitions("i", "j", "part")
    out = dealt.mapInPandas(added, "feature string, neighbor string, corr double")
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def products_of(frame: DataFrame, vectors: list[str], fan: int = 8) -> np.ndarray:
    """Sums of products of a one and all elements of some vector columns, over the rows in which none is null.

    Each task sends one matrix, ``fan`` tasks add them up, and as many come to the driver.
    """
    known = frame.select(*[F.col(v).cast("array<double>").alias(f"v{i}") for i, v in enumerate(vectors)]).dropna()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                x = [np.ones((len(part), 1)), *(c.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) for c in part.columns)]
                x = np.concatenate(x, axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    rows = _added(known.mapInArrow(summed, "sums binary"), fan)
    if rows is None:
        raise ValueError("no vectors")
    width = math.isqrt(len(rows))
    return rows.reshape(width, width)


def _added(sent: DataFrame, fan: int = 8) -> np.ndarray | None:
    """The sum of arrays that tasks sent as ``sums``: ``fan`` tasks add them up, and as many come to the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("sums"):
                one = np.frombuffer(x.as_buffer())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    rows = sent.repartition(fan).mapInArrow(added, "sums binary").collect()
    return sum(np.frombuffer(r["sums"]) for r in rows) if rows else None


# ---- most frequent values ----------------------------------------------------------------


def majorities(frame: DataFrame, columns: list[str]) -> DataFrame:
    """feature, candidate: of each column the one value that more than half of all rows may hold, null being a value.

    The middle of some rows is the only value that can fill more than half of them. Summed over
    all rows, by how much it exceeds the half, a value of the majority beats all others together.
    """
    wide = _numbers(frame, columns)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: list[dict[float | None, int]] = [{} for _ in columns]
        for b in batches:
            for at in range(0, len(b), ROWS):
                for i, c in enumerate(b.slice(at, ROWS).columns):
                    x, nulls = c.drop_null().to_numpy(zero_copy_only=False), c.null_count
                    if 2 * nulls > len(c):
                        found, n = None, nulls
                    elif len(x):
                        middle = np.partition(x, len(x) // 2)[len(x) // 2]
                        found = float(middle) + 0.0  # no negative zero
                        n = int((x == middle).sum()) if middle == middle else int(np.isnan(x).sum())
                    else:
                        continue
                    if 2 * n > len(c):
                        _ahead(lead[i], found, 2 * n - len(c))
        rows = [(i, float("nan") if v == "nan" else v, n) for i, held in enumerate(lead) for v, n in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())], ["i", "candidate", "lead"])

    votes = wide.mapInArrow(in_task, "i int, candidate double, lead long").groupBy("i", "candidate").agg(F.sum("lead").alias("lead"))
    best = votes.groupBy("i").agg(F.max_by(F.struct("candidate"), F.struct("lead", "candidate")).alias("best"))
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return best.select(named.alias("feature"), F.col("best.candidate").alias("candidate"))


def _ahead(held: dict, value: float | None, lead: int) -> None:
    """One value and its lead: another value takes from it, and takes its place when it is ahead."""
    value = "nan" if value is not None and value != value else value
    if not held:
        held[value] = lead
        return
    (old, n), = held.items()
    if old == value:
        held[old] = n + lead
    elif n >= lead:
        held[old] = n - lead
    else:
        held.clear()
        held[value] = lead - n


def rates(frame: DataFrame, columns: list[str]) -> dict[str, tuple[float, float | None]]:
    """For each column the share of values that are not null, and that of the most frequent one if it is more than half of all rows, else None.

    One read finds a candidate for each column, another counts; two numbers a column come to the driver. Empty for an empty table.
    """
    found = {r["feature"]: r["candidate"] for r in majorities(frame, columns).collect()}  # a row for each column
    wide = _numbers(frame, columns)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * len(columns))
        for b in batches:
            total[0] += len(b)
            for i, (name, c) in enumerate(zip(columns, b.columns, strict=True)):
                total[1 + 2 * i] += len(c) - c.null_count
                if name in found:
                    v, x = found[name], c.drop_null().to_numpy(zero_copy_only=False)
                    total[2 + 2 * i] += c.null_count if v is None else np.isnan(x).sum() if v != v else (x == v).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    total = _added(wide.mapInArrow(counted, "sums binary"))
    if total is None or not total[0]:
        return {}
    shares = total[1:].reshape(-1, 2) / total[0]
    return {c: (float(fill), float(static) if static > 0.5 else None) for c, (fill, static) in zip(columns, shares, strict=True)}


def static_rates(frame: DataFrame, columns: list[str]) -> DataFrame:
    """feature, static of ``rates``."""
    found = rates(frame, columns)
    return frame.sparkSession.createDataFrame([(c, found[c][1] if c in found else None) for c in columns], "feature string, static double")
