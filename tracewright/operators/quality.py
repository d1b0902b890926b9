"""Data quality of spans by any dimensions: rates, rejection, consistency, verdicts, dynamics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import distinct_with_null
from tracewright.operators import ranks, scans
from tracewright.operators.rolling import rolled
from tracewright.operators.selection import cut
from tracewright.sources.spec import INVARIANTS, MANDATORY, SPEC, Attribute

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95)
Dims = dict[str, Column]


def starts_at(grain: str = "1 day") -> Column:
    """Time bucket of a span's start."""
    return F.window(F.timestamp_micros((F.col("start_time_ns") / 1000).cast("bigint")), grain)["start"]


def version(part: str) -> Column:
    """major, minor or patch part of the distribution version; null if it has another form."""
    pattern = {"major": r"^(\d+)", "minor": r"^(\d+\.\d+)"}.get(part)
    return F.col("nexus_distrib_ver") if pattern is None else F.nullif(F.regexp_extract("nexus_distrib_ver", pattern, 1), F.lit(""))


def grouped(frame: DataFrame, dims: Dims, *aggregates: Column) -> DataFrame:
    return frame.groupBy(*[c.alias(k) for k, c in dims.items()]).agg(*aggregates) if dims else frame.agg(*aggregates)


def rates(frame: DataFrame, flag: Callable[[Attribute], Column], dims: Dims | None = None, agg: Callable[[Column], Column] = F.avg, spec=SPEC) -> DataFrame:
    """n and, for each attribute that is not a key, an aggregate of its flag."""
    dims = dims or {}
    own = [agg(flag(a).cast("double")).alias(a.name) for a in spec if a.name not in dims]
    return grouped(frame, dims, F.count("*").alias("n"), *own)


def completeness(frame, dims=None, agg=F.avg, spec=SPEC):
    return rates(frame, lambda a: a.missing, dims, agg, spec)


def correctness(frame, dims=None, agg=F.avg, spec=SPEC):
    return rates(frame, lambda a: a.violation, dims, agg, spec)


def contamination(frame, dims=None, agg=F.avg, spec=SPEC):
    return rates(frame, lambda a: a.spoilt, dims, agg, spec)


def nulls(frame, dims=None, agg=F.sum, spec=SPEC):
    return rates(frame, lambda a: F.col(a.name).isNull(), dims, agg, spec)


def distribution(frame: DataFrame, dims: Dims | None = None) -> DataFrame:
    """n, and columns <number>_q25 to _q95 of each number and of the duration, sentinels left out; exact, from counts."""
    dims = dims or {}
    numbers = {a.name: a.real for a in SPEC if a.type in ("bigint", "float")} | {"duration_ns": F.col("end_time_ns") - F.col("start_time_ns")}
    keyed = frame.select(*[c.alias(k) for k, c in dims.items()], *[c.cast("double").alias(f"__{k}") for k, c in numbers.items()])
    each = F.array(*[F.struct(F.lit(k).alias("__number"), F.col(f"__{k}").alias("__x")) for k in numbers])
    long = keyed.select(*dims, F.inline(each)).filter(F.col("__x").isNotNull())
    found = ranks.quantiles(long, [*dims, "__number"], "__x", QUANTILES)
    wide = [F.max(F.when(F.col("__number") == k, F.col("quantiles")[i])).alias(f"{k}_q{round(100 * q)}") for k in numbers for i, q in enumerate(QUANTILES)]
    totals = grouped(frame, dims, F.count("*").alias("n"))
    if not dims:
        return totals.crossJoin(F.broadcast(found.agg(*wide)))  # one row each
    named = {k: f"__d_{i}" for i, k in enumerate(dims)}
    values = found.groupBy(*[F.col(k).alias(d) for k, d in named.items()]).agg(*wide)
    return totals.join(values, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(d)) for k, d in named.items()]), "left").drop(*named.values())


def _sum(flags: list[Column]) -> Column:
    return reduce(add, [f.cast("long") for f in flags])


def violations(attributes=SPEC) -> Column:
    return _sum([a.violation for a in attributes])


def missing(attributes=SPEC) -> Column:
    return _sum([a.missing for a in attributes])


def spoilt(attributes=SPEC) -> Column:
    return _sum([a.spoilt for a in attributes])


def absent(attributes=SPEC) -> Column:
    return _sum([F.col(a.name).isNull() for a in attributes])


def validated(frame: DataFrame, spec=SPEC) -> DataFrame:
    """The rows with a truth value for each rule."""
    return frame.select("*", *[a.validity.alias(f"{a.name}_validated") for a in spec])


def tagged(frame: DataFrame, over=MANDATORY) -> DataFrame:
    """Spans with ``rejected``: whether a span of their trace breaks a rule. Spans without a trace stay unmarked."""
    flags = frame.groupBy("trace_id").agg(F.bool_or(reduce(lambda a, b: a | b, [a.violation for a in over])).alias("rejected"))
    return frame.join(flags, "trace_id", "left")


def rejection(frame: DataFrame, dims: Dims | None = None) -> DataFrame:
    out = F.col("rejected").cast("int")
    return grouped(tagged(frame), dims or {}, F.count("*").alias("n"), F.avg(out).alias("dropped_rate"), F.sum(out).alias("dropped"), F.sum(1 - out).alias("kept"))


def trace_status(frame: DataFrame) -> DataFrame:
    """Per trace: first session and version, spans, rejected, consistent."""
    order = F.struct("start_time_ns", "span_id")
    broken = F.max(violations(MANDATORY) > 0)
    same = reduce(lambda a, b: a & b, [distinct_with_null(F.col(c)) <= 1 for c in INVARIANTS])
    return frame.groupBy("trace_id").agg(
        F.min_by("session_id", order).alias("session_id"), F.min_by("nexus_distrib_ver", order).alias("version"),
        F.count("*").alias("spans"), broken.alias("rejected"), same.alias("consistent"),
    )


def consistency(frame: DataFrame, columns=INVARIANTS) -> DataFrame:
    """Distinct values of each invariant for each trace, null being a value."""
    return frame.groupBy("trace_id").agg(*[distinct_with_null(F.col(c)).cast("long").alias(c) for c in columns if c != "trace_id"])


def trace_consistency(frame: DataFrame, columns=INVARIANTS) -> DataFrame:
    """Number of traces with more than one value."""
    return consistency(frame, columns).agg(*[F.coalesce(F.sum((F.col(c) > 1).cast("long")), F.lit(0)).alias(c) for c in columns])


def duplicates(frame: DataFrame) -> DataFrame:
    return frame.groupBy("trace_id", "span_id").count().filter("count > 1")


def verdict(frame: DataFrame, max_nulls: int = 0, max_rules: int = 0, max_dups: int = 0, max_breaks: int = 0) -> DataFrame:
    """Totals of the table and whether they keep the limits; the table is read once and summed by span, by trace and in all."""
    flags = {"nulls": absent(), "missing": missing(), "trash": spoilt(), "rules": violations()}
    code = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))  # noqa: E731  values are told apart by 64-bit hashes, which aggregate without sorting
    by_span = frame.groupBy("trace_id", "span_id").agg(
        F.count("*").alias("n"), *[F.sum(f).alias(k) for k, f in flags.items()],
        *[x for c in INVARIANTS for x in (F.min(code(c)).alias(f"__min_{c}"), F.max(code(c)).alias(f"__max_{c}"), F.max(F.col(c).isNull()).alias(f"__null_{c}"))],
    )
    # an invariant breaks if a trace has two values of it, null being one
    broken = [F.coalesce(F.min(f"__min_{c}") != F.max(f"__max_{c}"), F.lit(False)) | (F.max(f"__null_{c}") & F.min(f"__min_{c}").isNotNull()) for c in INVARIANTS]
    by_trace = by_span.groupBy("trace_id").agg(F.sum("n").alias("spans"), *[F.sum(k).alias(k) for k in flags], F.sum(F.col("n") - 1).alias("dups"), _sum(broken).alias("breaks"))
    totals = by_trace.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("spans", *flags, "dups", "breaks")])
    valid = (F.col("nulls") <= max_nulls) & (F.col("rules") <= max_rules) & (F.col("dups") <= max_dups) & (F.col("breaks") <= max_breaks)
    return totals.withColumn("valid", valid)


def is_valid(frame: DataFrame, **limits) -> bool:
    return verdict(frame, **limits).first()["valid"]


def traffic_light(valid: Column, degraded: Column) -> Column:
    return F.when(~valid, "red").when(degraded, "amber").otherwise("green")


def flow(frame: DataFrame, grain: str = "1 day") -> DataFrame:
    """Traces and validity in each time bucket."""
    return frame.groupBy(starts_at(grain).alias("ts")).agg(F.count_distinct("trace_id").alias("traces"), (1 - F.avg(violations() / len(SPEC))).alias("validity")).orderBy("ts")


def validation_stats(frame: DataFrame, spec=SPEC) -> DataFrame:
    """attribute, total, valid, invalid, pct for each attribute."""
    sums = frame.agg(F.count("*").alias("total"), *[F.coalesce(F.sum(a.violation.cast("long")), F.lit(0)).alias(a.name) for a in spec])
    long = sums.unpivot(["total"], [a.name for a in spec], "attribute", "invalid")
    return long.select("attribute", "total", (F.col("total") - F.col("invalid")).alias("valid"), "invalid", F.round(100 * F.try_divide(F.col("invalid"), F.col("total")), 2).alias("pct"))


def missingness(frame: DataFrame) -> DataFrame:
    """Columns with nulls: their number and percent."""
    sums = frame.agg(F.count("*").alias("total"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in frame.columns])
    long = sums.unpivot(["total"], frame.columns, "column", "nulls").filter("nulls > 0")
    return long.select("column", "nulls", F.round(100 * F.col("nulls") / F.col("total"), 2).alias("pct")).orderBy(F.desc("nulls"), "column")


def volume(frame: DataFrame) -> DataFrame:
    return frame.groupBy("agent_id").agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"))


def overview(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("spans"), *[F.count_distinct(c).alias(k) for c, k in (("trace_id", "traces"), ("agent_id", "agents"), ("aef_kind", "kinds"))])


def value_counts(frame: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if top is None else out.limit(top)


def label_balance(frame: DataFrame, column: str) -> DataFrame:
    counts = frame.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    total = frame.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("pct"))  # total is one row


def duration_summary(frame: DataFrame) -> DataFrame:
    s = (F.col("end_time_ns") - F.col("start_time_ns")) / 1e9
    found = ranks.quantiles(frame.select(s.alias("s")), [], "s", [0.5, 0.95])
    picks = found.agg(*[F.round(F.max(F.col("quantiles")[i]), 4).alias(k) for i, k in enumerate(("median", "q95"))])
    return frame.agg(F.round(F.avg(s), 4).alias("mean")).crossJoin(F.broadcast(picks)).select("median", "mean", "q95")  # one row each


def bounds(frame: DataFrame) -> DataFrame:
    return frame.groupBy("trace_id").agg(F.min("start_time_ns").alias("start_ns"), F.max("end_time_ns").alias("end_ns"))


def query_and_answer(frame: DataFrame, first_kind: str = "input_request", last_kind: str = "output_request", default: str = "not found") -> DataFrame:
    """Per trace: first filled input of one kind, last filled output of another."""
    order = F.struct("start_time_ns", "span_id")
    asked = F.when((F.col("aef_kind") == first_kind) & (F.col("input_text") != ""), order)
    said = F.when((F.col("aef_kind") == last_kind) & (F.col("output_text") != ""), order)
    return frame.groupBy("trace_id").agg(F.coalesce(F.min_by("input_text", asked), F.lit(default)).alias("query"), F.coalesce(F.max_by("output_text", said), F.lit(default)).alias("answer"))


def dynamics(frame: DataFrame, width: int = 5) -> DataFrame:
    """Within a trace, by start: value, running sum and mean, and mean of the last spans, of four signals."""
    signals = {
        "missing": missing().cast("double"), "invalid": violations().cast("double"),
        "duration": (F.col("end_time_ns") - F.col("start_time_ns")).cast("double"), "error": (F.col("status_code") == "STATUS_CODE_ERROR").cast("double"),
    }
    order = ["start_time_ns", "span_id"]
    slim = frame.select("trace_id", "span_id", "start_time_ns", *[c.alias(k) for k, c in signals.items()])
    sums = {f"{k}_sum": F.col(k) for k in signals} | {"step": F.col("span_id").isNotNull().cast("long")} | {f"__n_{k}": F.col(k).isNotNull().cast("long") for k in signals}
    # ranges are found from a sample, so what they order is worked out twice unless it is kept
    rows = scans.sums_upto(scans.dealt(cut(slim), ["trace_id", *order]), ["trace_id"], sums).drop("__range", "__place")
    rows = rolled(rows, ["trace_id"], order, {k: ("mean",) for k in signals}, (width,), ())
    out = ["step"]
    for k in signals:
        known = F.col(f"__n_{k}")
        out += [k, F.when(known > 0, F.col(f"{k}_sum")).alias(f"{k}_sum"), F.try_divide(f"{k}_sum", known).alias(f"{k}_mean"), F.col(f"{k}__mean_{width}").alias(f"{k}_last")]
    return rows.select("trace_id", "span_id", *out)
