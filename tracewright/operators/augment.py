"""Augmenting labelled data: hash-chosen victims, classes, severities, text noise, shifts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import u01, u01_sql
from tracewright.operators import ranks, scans
from tracewright.operators.gram import products_of
from tracewright.operators.selection import cut

# Share of traces by class, and the range of severities.
FRACTIONS = {"dpi": 0.04, "ipi": 0.04, "mp": 0.03, "hallucination": 0.05, "bias": 0.04}
SEVERITY = (0.30, 1.00)
NORMAL = "NonAnomaly"


def class_of(key: Column, fractions=FRACTIONS, salt: str = "class") -> Column:
    u, upto, out = u01(key, salt), 0.0, None
    for name, share in fractions.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(NORMAL) if out is None else out.otherwise(NORMAL)


def class_sql(key: str, fractions=FRACTIONS, salt: str = "class") -> str:
    upto, cases = 0.0, []
    for name, share in fractions.items():
        upto += share
        cases.append(f"WHEN {u01_sql(key, salt)} < {upto!r}::DOUBLE THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{NORMAL}' END"


def severity_of(key: Column, label: Column, salt: str = "severity") -> Column:
    low, high = SEVERITY
    return F.when(label == NORMAL, 0.0).otherwise(low + (high - low) * u01(key, salt))


def pick(key: Column, salt: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u01(key, salt) * len(values)) + 1).cast("int"))


def tagged(spans: DataFrame) -> DataFrame:
    """Spans with step, anomaly_type, anomaly_severity and class of their trace."""
    out = scans.places(spans, ["trace_id"], ["start_time_ns", "span_id"], "step").withColumn("anomaly_type", class_of(F.col("trace_id")))
    return out.withColumn("anomaly_severity", severity_of(F.col("trace_id"), F.col("anomaly_type"))).withColumn("class", (F.col("anomaly_type") != NORMAL).cast("int"))


def corrupted(text: Column, key: Column) -> Column:
    """One of four kinds of noise at a hashed place: changed sign, repeated stretch, foreign insert, reversed tail."""
    at = (F.floor(u01(key, "place") * F.length(text)) + 1).cast("int")
    head, tail = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    recipe = F.floor(u01(key, "recipe") * 4)
    return (
        F.when(recipe == 0, F.concat(head, F.lit("#"), F.substring(tail, F.lit(2), F.length(text)))).when(recipe == 1, F.concat(head, F.repeat(F.substring(tail, 1, 8), 3), tail))
        .when(recipe == 2, F.concat(head, F.lit(" lorem ipsum "), tail)).otherwise(F.concat(head, F.reverse(tail)))
    )


def overlay(frame: DataFrame, rules: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """For rows that meet a rule, the columns it lists are replaced; the first rule that fits a column wins."""
    columns = {}
    for name in {c for _, changes in rules for c in changes}:
        columns[name] = reduce(lambda out, r: F.when(r[0], r[1][name]).otherwise(out) if name in r[1] else out, reversed(rules), F.col(name))
    return frame.withColumns(columns)


def mean_direction(frame: DataFrame, vector: str, label: str, of: str, against: str) -> DataFrame:
    """direction: mean of one class less mean of another, of length one; one row."""
    long = frame.filter(F.col(label).isin(of, against)).select(label, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy("dim").agg((F.avg(F.when(F.col(label) == of, F.col("x"))) - F.avg(F.when(F.col(label) == against, F.col("x")))).alias("d"))
    row = means.agg(F.sort_array(F.collect_list(F.struct("dim", "d")))["d"].alias("d"))
    norm = F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x))
    return row.select(F.transform("d", lambda x: x / norm).alias("direction"))


def shifted(frame: DataFrame, vector: str, direction: DataFrame, amount: Column) -> DataFrame:
    """Vectors moved along a direction; the direction is one row."""
    return frame.crossJoin(F.broadcast(direction)).withColumn(vector, F.zip_with(vector, "direction", lambda x, d: x + amount * d)).drop("direction")


# ---- profiles of cells ------------------------------------------------------------------

#: Places of the quantile grid of a dimension, and the place from which a Pareto tail takes over.
GRID = tuple(i / 200 for i in range(201))
TAIL = 0.95
#: Rows of a cell that are worked together, about; larger cells are dealt over several tasks.
CELL_ROWS = 16_384
#: Matrices of partial sums of a cell that meet at once.
FAN = 16


@dataclass(frozen=True)
class Cell:
    """Quantile grid, tails, edges and principal axes of the rank correlation of one cell's vectors."""

    grid: np.ndarray
    tail: np.ndarray  # threshold, shape and scale of each dimension
    edges: np.ndarray  # least and greatest value of each dimension
    values: np.ndarray
    axes: np.ndarray

    @classmethod
    def of(cls, row) -> Cell:
        """The cell that a row of a table of profiles holds."""
        width = row["width"]
        read = lambda name, *shape: np.frombuffer(row[name], "<f8").reshape(shape)
        return cls(read("grid", len(GRID), width), read("tail", 3, width), read("edges", 2, width), read("values", width), read("axes", width, width))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Normal scores of vectors, one a row."""
        p = np.stack([np.interp(x[:, i], self.grid[:, i], GRID) for i in range(x.shape[1])], axis=1)
        return normal_quantile(np.clip(p, 1e-6, 1 - 1e-6))

    def moved(self, x: np.ndarray, amounts: np.ndarray, lowest: np.ndarray | bool = False) -> np.ndarray:
        """Vectors displaced by Mahalanobis lengths along the strongest (or weakest) axis, back through quantiles or tails (generalised Pareto, by weighted moments)."""
        lengths = np.sqrt(np.maximum(self.values[[-1, 0]], 0.0))[:, None] * self.axes[:, [-1, 0]].T
        p = normal_cdf(self.scores(x) + amounts[:, None] * lengths[np.broadcast_to(np.asarray(lowest, int), len(x))])
        body = np.stack([np.interp(p[:, i], GRID, self.grid[:, i]) for i in range(x.shape[1])], axis=1)
        u, xi, beta = self.tail
        xi = np.where(np.abs(xi) < 1e-6, 1e-6, xi)
        far = u + beta / xi * (np.clip(1 - p, 1e-6, 1.0) ** -xi - 1)
        out = np.where(p > TAIL, far, body)
        return self.clipped(np.where(np.isfinite(out), out, self.edges[1]))

    def clipped(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, *self.edges)


_QUANTILE, _UPPER = np.frompyfunc(NormalDist().inv_cdf, 1, 1), np.frompyfunc(math.erfc, 1, 1)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    return _QUANTILE(p).astype(np.float64)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _UPPER(z / -math.sqrt(2)).astype(np.float64)


def _grids(frame: DataFrame, vector: str, edges: tuple[float, float], least: int) -> DataFrame:
    """__cell, dim, size, quantiles (the grid, the tail's threshold and both edges), b0, b1: exact, from counts of all rows."""
    keys = ["__cell", "dim"]
    long = frame.select("__cell", F.posexplode(vector).alias("dim", "x"))
    counts = cut(ranks.ranked(long, keys, "x").filter(F.col("size") >= least))
    grids = cut(ranks.of_ranks(counts, keys, "x", [*GRID, TAIL, *edges]))
    limits = grids.select(*keys, F.col("quantiles")[len(GRID)].alias("__u"))
    # as specified, the scale of the tail comes out at its floor, so that a tail holds its threshold
    # weighted moments of what exceeds the threshold: the sum of the ranks of n equal values from b on is n*b + n*(n-1)/2
    over, n = F.greatest(F.col("x") - F.col("__u"), F.lit(0.0)), F.col("n")
    place = (n * F.col("below") + n * (n - 1) / 2) / F.greatest(F.col("size") - 1, F.lit(1))
    moments = counts.join(limits, keys).groupBy(*keys).agg((F.sum(n * over) / F.max("size")).alias("b0"), (F.sum(place * over) / F.max("size")).alias("b1"))
    return grids.join(moments, keys)


def _named(frame: DataFrame, cells: list[str]) -> DataFrame:
    return frame.withColumn("__cell", F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cells)])))


def _dealt(frame: DataFrame, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``__salt``: a hash of the row among as many parts as its cell has, 0 without a profile."""
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    return frame.join(sizes, "__cell", "left").withColumn("__salt", F.pmod(F.xxhash64(*columns), parts).cast("int")).drop("__parts")


def _copied(profiles: DataFrame) -> DataFrame:
    """A copy of each profile for each part of its cell."""
    return profiles.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))


def cell_profiles(frame: DataFrame, cells: list[str], vector: str, edges: tuple[float, float] = (0.005, 0.995), least: int = 64, eps: float = 1e-8, rows: int = CELL_ROWS) -> DataFrame:
    """A table of profiles: cells, width, size and the arrays of ``Cell``; a row for each cell of at least so many rows, from all of them.

    Any number of cells takes the same reads: quantiles are ranks among counts of values, products
    of normal scores are summed by parts of a cell, then by cell. Vectors of a cell are of one width.
    """
    known = _named(frame.filter(F.col(vector).isNotNull()), cells).select("__cell", F.col(vector).cast("array<double>").alias("__v"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(cells)])
    grids = _grids(known.select("__cell", F.col("__v").alias("x")), "x", edges, least)
    # the size of a cell is the same in each of its dimensions
    margins = cut(grids.groupBy("__cell").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("dim", "quantiles", "b0", "b1"))).alias("dims")))  # a row for each dimension of a cell
    margins = margins.withColumn("__parts", F.ceil(F.col("size") / rows).cast("int"))
    own = [f"__k{i}" for i in range(len(cells))]
    counted = known.groupBy("__cell", "__v").agg(F.count("*").alias("__n"))  # one vector may fill a cell
    dealt = _dealt(counted, margins.select("__cell", "__parts"), ["__v"]).select("__cell", "__salt", "__v", "__n")

    def products(group: pa.Table, margin: pa.Table) -> pa.Table:
        if not margin.num_rows or not group.num_rows:
            return empty
        cell = _margin(margin.column("dims")[0].as_py())
        z = cell.scores(_stacked(group.column("__v")))
        z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
        first = {"__cell": group.column("__cell")[0].as_py(), "__salt": group.column("__salt")[0].as_py(), "__at": 0, "sums": ((z * group.column("__n").to_numpy()[:, None]).T @ z).tobytes()}
        return pa.Table.from_pylist([first], schema=sums_schema)

    sums_schema = pa.schema([("__cell", pa.string()), ("__salt", pa.int32()), ("__at", pa.int32()), ("sums", pa.binary())])
    empty = sums_schema.empty_table()
    shape = "__cell string, __salt int, __at int, sums binary"
    by = ["__cell", "__salt"]
    summed = dealt.groupBy(*by).cogroup(_copied(margins.select("__cell", "__parts", "dims")).groupBy(*by)).applyInArrow(products, shape)

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in group.column("sums"))
        first = {"__cell": group.column("__cell")[0].as_py(), "__salt": group.column("__salt")[0].as_py() // FAN, "__at": 0, "sums": total.tobytes()}
        return pa.Table.from_pylist([first], schema=sums_schema)

    most = margins.agg(F.max("__parts")).first()[0] or 1
    while most > FAN:  # the parts of one cell meet a few at a time
        summed = summed.withColumn("__at", F.floor(F.col("__salt") / FAN).cast("int")).groupBy("__cell", "__at").applyInArrow(added, shape)
        most = -(-most // FAN)
    whole = summed.groupBy("__cell").agg(F.collect_list("sums").alias("sums"))  # FAN at most

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                m, total = _margin(row["dims"]), sum(np.frombuffer(x, "<f8") for x in row["sums"])
                width = m.grid.shape[1]
                product = total.reshape(width + 1, width + 1)
                n, mean = product[0, 0], product[0, 1:] / product[0, 0]
                covariance = product[1:, 1:] / n - np.outer(mean, mean)
                spread = np.sqrt(np.maximum(np.diag(covariance), 1e-300))
                corr = covariance / np.outer(spread, spread)
                np.fill_diagonal(corr, 1.0)
                values, axes = np.linalg.eigh(corr + eps * np.eye(width))
                arrays = {k: np.ascontiguousarray(v, "<f8").tobytes() for k, v in zip(("grid", "tail", "edges", "values", "axes"), (m.grid, m.tail, m.edges, values, axes), strict=True)}
                yield pa.RecordBatch.from_pylist([{"__cell": row["__cell"], "width": width, **arrays}], schema=profile_schema)

    profile_schema = pa.schema([("__cell", pa.string()), ("width", pa.int32()), *((k, pa.binary()) for k in ("grid", "tail", "edges", "values", "axes"))])
    made = margins.select("__cell", "dims").join(whole, "__cell").mapInArrow(profile, "__cell string, width int, grid binary, tail binary, edges binary, values binary, axes binary")
    names = known.groupBy("__cell").agg(*[F.first(c).alias(c) for c in own])
    out = made.join(margins.select("__cell", "size", "__parts"), "__cell").join(names, "__cell")
    return cut(out.select(*[F.col(k).alias(c) for k, c in zip(own, cells, strict=True)], "__cell", "__parts", "size", "width", "grid", "tail", "edges", "values", "axes"))


def _stacked(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as a matrix; a null element is NaN."""
    x = vectors.combine_chunks()
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(x), -1)


def _margin(dims: list[dict]) -> Cell:
    """Grid, tails and edges of a cell from the rows of its dimensions."""
    table = np.array([d["quantiles"] for d in dims]).T
    n = len(GRID)
    b0, b1 = (np.array([d[k] for d in dims]) for k in ("b0", "b1"))
    apart = np.where(np.abs(b0 - 2 * b1) < 1e-9, 1e-9, b0 - 2 * b1)
    tail = np.stack([table[n], 2 - b0 / apart, np.maximum(2 * b0 * b1 / apart, 1e-9)])
    return Cell(table[:n], tail, table[n + 1 : n + 3], np.zeros(0), np.zeros(0))


def cell_shift(frame: DataFrame, cells: list[str], vector: str, amount: Column, profiles: DataFrame, lowest: Column | None = None, scoped: Column | None = None) -> DataFrame:
    """Vectors of ``scoped`` rows moved by their amount (null: clipped only) within their cell; rows of cells without a profile stay.

    Rows meet their profile by cell and part; other columns pass by as they are.
    """
    columns = frame.columns
    marked = _named(frame, cells).withColumn(vector, F.col(vector).cast("array<double>"))
    marked = marked.withColumns({"__amount": amount.cast("double"), "__lowest": F.lit(False) if lowest is None else F.coalesce(lowest, F.lit(False)), "__scoped": F.lit(True) if scoped is None else F.coalesce(scoped, F.lit(False))})
    touched = F.col("__scoped") & F.col(vector).isNotNull()
    dealt = _dealt(marked.filter(touched), profiles.select("__cell", "__parts"), columns)
    shape = marked.select(*columns).schema

    def move(rows: pa.Table, profile: pa.Table) -> pa.Table:
        out = rows.select(columns)
        if not profile.num_rows or not rows.num_rows:
            return out
        cell = Cell.of(profile.to_pylist()[0])
        x, t = _stacked(rows.column(vector)), rows.column("__amount").to_numpy()
        y = np.where(np.isnan(t)[:, None], cell.clipped(x), cell.moved(x, np.nan_to_num(t), rows.column("__lowest").to_numpy()))
        moved = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.int32()), pa.array(y.ravel(), from_pandas=True))
        return out.set_column(columns.index(vector), vector, moved)

    by = ["__cell", "__salt"]
    shifted_ = dealt.groupBy(*by).cogroup(_copied(profiles.select("__cell", "__parts", "width", "grid", "tail", "edges", "values", "axes")).groupBy(*by)).applyInArrow(move, shape)
    return shifted_.unionByName(marked.filter(~touched).select(*columns))


def copula_shift(frame: DataFrame, cell: str, vector: str, amount: str, least: int = 64) -> DataFrame:
    """Vectors moved along the strongest axis of their cell's rank correlation, back through its quantiles and tails.

    All rows of a cell make its profile. Cells with fewer than ``least`` rows, and null vectors, stay as they are.
    """
    return cell_shift(frame, [cell], vector, F.col(amount), cell_profiles(frame, [cell], vector, least=least))


# ---- shifts off the manifold --------------------------------------------------------------


@dataclass(frozen=True)
class Manifold:
    """Mean and axes of normal vectors, and the scale of what lies off them; small, so it lives on the driver."""

    mean: list[float]
    axes: list[list[float]]
    scale: float

    def off(self, direction: list[float]) -> list[float]:
        """The part of a direction off the axes, of length one."""
        axes, d = np.asarray(self.axes), np.asarray(direction, np.float64)
        rest = d - axes.T @ (axes @ d)
        return (rest / (np.linalg.norm(rest) + 1e-12)).tolist()


def fit_manifold(frame: DataFrame, vector: str, rank: int = 16) -> Manifold:
    """From the products of all vectors, summed up in the tasks."""
    product = products_of(frame, [vector])
    width = len(product) - 1
    n, mean = product[0, 0], product[0, 1:] / product[0, 0]
    values, axes = np.linalg.eigh(product[1:, 1:] / n - np.outer(mean, mean))
    return Manifold(mean.tolist(), axes[:, ::-1].T[: min(rank, width)].tolist(), float(np.sqrt(max(values[::-1][rank:].sum(), 0.0) / width)))


def off_plane(vector: Column, off: list[float], amount: Column) -> Column:
    """Vectors moved by an amount along a direction."""
    return F.zip_with(vector, F.array(*[F.lit(x) for x in off]), lambda x, d: x.cast("double") + amount * d)


# ---- classes of anomalies applied to spans --------------------------------------------------


@dataclass(frozen=True)
class Operator:
    """How a class of anomalies changes its victims: geometry, kinds of spans, scope, and which vectors move."""

    name: str
    geometry: str
    kinds: tuple[str, ...]
    scope: str = "span"
    epi: bool = True
    sem: bool = True
    direction: str = "anchor"


# The classes and what they touch.
OPERATORS = (
    Operator("dpi", "marginal_break", ("llm", "start_agent")),
    Operator("ipi", "coupling_break_edge", ("tool", "retriever", "output_request"), "edge", epi=False),
    Operator("mp", "drift", ("llm", "tool", "retriever", "chain"), "session"),
    Operator("hallucination", "residual_inflate", ("llm",), epi=False, direction="none"),
    Operator("bias", "conditional_shift", ("llm",), epi=False),
)
TAU = (0.5, 4.0)


def compound_of(key: Column, pairs: list[tuple[str, str]], share: float, fractions=FRACTIONS, salt: str = "class") -> Column:
    """The single class, or in a band of ``share`` beyond all of them a pair of classes ("a+b") chosen by a second hash."""
    single, u, whole = class_of(key, fractions, salt), u01(key, salt), sum(fractions.values())
    if not pairs or share <= 0:
        return single
    return F.when((u >= whole) & (u < whole + share), pick(key, f"{salt}-pair", [f"{a}+{b}" for a, b in pairs])).otherwise(single)


def compound_sql(key: str, pairs: list[tuple[str, str]], share: float, fractions=FRACTIONS, salt: str = "class") -> str:
    u, whole, names = u01_sql(key, salt), 0.0, ", ".join(f"'{a}+{b}'" for a, b in pairs)
    whole = sum(fractions.values())
    return f"CASE WHEN {u} >= {whole!r}::DOUBLE AND {u} < {whole + share!r}::DOUBLE THEN ([{names}])[(floor({u01_sql(key, f'{salt}-pair')} * {len(pairs)}) + 1)::INT] ELSE {class_sql(key, fractions, salt)} END"


def roles(spans: DataFrame, pairs: list[tuple[str, str]] = (), share: float = 0.0) -> DataFrame:
    """Spans with step, anomaly_type (compound ones too), anomaly_severity, class and anomaly_role of their trace."""
    out = scans.places(spans, ["trace_id"], ["start_time_ns", "span_id"], "step").withColumn("anomaly_type", compound_of(F.col("trace_id"), list(pairs), share))
    out = out.withColumn("anomaly_severity", severity_of(F.col("trace_id"), F.col("anomaly_type")))
    normal = F.col("anomaly_type") == NORMAL
    return out.withColumns({"class": (~normal).cast("int"), "anomaly_role": F.when(normal, "none").otherwise("member")})


def classes_of(label: Column) -> Column:
    """The classes that are applied to a row, one after the other."""
    return F.when(label == NORMAL, F.array().cast("array<string>")).otherwise(F.split(label, r"\+"))


def in_scope(name: Column, kind: Column, operators=OPERATORS) -> Column:
    """Whether a span of this kind is a victim of the class; others of its trace are bystanders."""
    return reduce(lambda out, o: F.when(name == o.name, F.lit(True) if o.scope == "session" else kind.isin(*o.kinds)).otherwise(out), operators, F.lit(False))


def bystanders(victims: DataFrame, scoped: DataFrame, keys=("trace_id", "span_id")) -> DataFrame:
    """Victim spans that are not touched."""
    return victims.join(scoped.select(*keys), list(keys), "left_anti")


def apply_classes(
    spans: DataFrame, profiles: DataFrame, manifold: Manifold, directions: dict[str, list[float]], epi: str = "epi_vector", sem: str = "sem_vector", operators=OPERATORS,
) -> DataFrame:
    """Move the vectors of victims; ``spans`` come from ``roles`` and have aef_kind and agent_id.

    The amount in a cell (kind, agent) follows the mean severity of the label's victims there. Epi vectors
    move through the profile of their cell and are clipped to it, sem vectors move off
    the manifold, under drift by their step's share of the last step there. Compound classes are
    applied in turn. Bystanders and normal spans stay as they are: nothing is taken apart and
    put together again.
    """
    by, out = {o.name: o for o in operators}, spans.withColumns({epi: F.col(epi).cast("array<double>"), sem: F.col(sem).cast("array<double>")})
    rounds = out.agg(F.max(F.size(classes_of(F.col("anomaly_type"))))).first()[0] or 0
    for k in range(rounds):
        name = F.get(classes_of(F.col("anomaly_type")), k)
        out = out.withColumn("__class", F.when(in_scope(name, F.col("aef_kind"), operators), name))
        cells = out.filter(F.col("__class").isNotNull()).groupBy(F.col("anomaly_type").alias("__c"), F.col("aef_kind").alias("__k"), F.col("agent_id").alias("__a"))
        cells = cut(cells.agg((TAU[0] + (TAU[1] - TAU[0]) * F.avg("anomaly_severity")).alias("__tau"), F.max("step").alias("__last")))
        match = F.col("__class").isNotNull() & (F.col("anomaly_type") == F.col("__c")) & F.col("aef_kind").eqNullSafe(F.col("__k")) & F.col("agent_id").eqNullSafe(F.col("__a"))
        small = cells.limit(ranks.BROADCAST_GROUPS + 1).count() <= ranks.BROADCAST_GROUPS
        out = out.join(F.broadcast(cells) if small else cells, match, "left")
        any_of = lambda test: F.col("__class").isin(*[o.name for o in by.values() if test(o)]) if any(test(o) for o in by.values()) else F.lit(False)
        lowest = F.coalesce(any_of(lambda o: o.geometry in ("coupling_break_edge", "residual_inflate")), F.lit(False))
        amount = F.when(any_of(lambda o: o.epi), F.col("__tau"))
        out = cell_shift(out, ["aef_kind", "agent_id"], epi, amount, profiles, lowest, F.col("__class").isNotNull())
        moved = F.col(sem)
        for o in by.values():
            if o.sem:
                ramp = F.col("step") / F.greatest(F.col("__last"), F.lit(1)) if o.geometry == "drift" else F.lit(1.0)
                off = manifold.off(directions.get(o.name, [1.0] + [0.0] * (len(manifold.mean) - 1)))
                moved = F.when(F.col("__class") == o.name, off_plane(F.col(sem), off, F.col("__tau") * manifold.scale * ramp)).otherwise(moved)
        out = out.withColumn(sem, moved).drop("__class", "__c", "__k", "__a", "__tau", "__last")
    return out


def noisy_texts(victims: DataFrame, embed, text: str = "output_text", sem: str = "sem_vector", name: str = "hallucination", operators=OPERATORS) -> DataFrame:
    """The other way to hallucinate: texts of victims in scope are corrupted and embedded anew; bystanders are kept."""
    kinds = next(o.kinds for o in operators if o.name == name)
    scoped = victims.filter(F.col("aef_kind").isin(*kinds))
    changed = scoped.withColumn(text, corrupted(F.col(text), F.concat_ws("|", "trace_id", "span_id")))
    return changed.withColumn(sem, embed(F.col(text))).unionByName(bystanders(victims, scoped))


def anchor_direction(spark, texts: list[str], embed) -> list[float]:
    """Mean vector of a class's anchor texts, of length one; a handful of texts."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(embed(F.col("t")).alias("v")).collect()
    mean = np.mean([r["v"] for r in rows], axis=0)
    return (mean / (np.linalg.norm(mean) + 1e-12)).tolist()


def rank_auc(frame: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with mean ranks for ties, from counts of distinct scores; never one window over all rows."""
    per = frame.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    from tracewright.operators.selection import _running

    placed = _running(per, [F.col("s")], F.col("n"), "below")
    return placed.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n").cast("double")).alias("auc"))
