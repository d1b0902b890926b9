"""How ready each group of traces is for monitoring: volume, quality, acceleration, verdict."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import clip, correlation, logistic
from tracewright.operators.quality import Dims, absent, correctness, grouped, starts_at, violations
from tracewright.operators.selection import cut
from tracewright.sources.spec import MANDATORY, SPEC

NS_PER_DAY = 86_400_000_000_000
NONE = "—"


@dataclass(frozen=True)
class Policy:
    """Weights and gates."""

    volume_target: float = 1e5
    min_eff_traces: float = 1e4
    max_loss: float = 0.30
    min_quality: float = 0.80
    ready_at: float = 0.70
    pilot_at: float = 0.50
    trend_gain: float = 3.0
    rate_target: float = 1e3
    stability_tol: float = 0.10
    ceiling_penalty: float = 0.12
    window_days: int = 30
    steepness: float = 1.5
    quality_weights: tuple[float, float, float] = (0.40, 0.20, 0.40)
    dynamics_weights: tuple[float, float, float] = (0.40, 0.40, 0.20)
    readiness_weights: tuple[float, float, float] = (0.40, 0.40, 0.20)


_FIELDS = ("volume_target", "min_eff_traces", "max_loss", "min_quality", "ready_at", "pilot_at", "trend_gain", "rate_target", "stability_tol", "ceiling_penalty")
# Presets by significance.
PRESETS = {
    "A": (1e9, 1e6, 0.02, 0.98, 0.92, 0.80, 4.0, 1e5, 0.05, 0.30),
    "B": (1e7, 1e5, 0.07, 0.93, 0.85, 0.70, 3.5, 1e4, 0.07, 0.20),
    "C": (1e5, 1e4, 0.30, 0.80, 0.70, 0.50, 3.0, 1e3, 0.10, 0.12),
    "D": (1e4, 1e3, 0.45, 0.65, 0.55, 0.35, 2.5, 1e2, 0.15, 0.07),
    "E": (1e3, 1e2, 0.60, 0.50, 0.40, 0.25, 2.0, 1e1, 0.25, 0.04),
}


def policy(level: str = "C", **overrides) -> Policy:
    """The preset of a level (an unknown one gives C), with any field overridden."""
    preset = dict(zip(_FIELDS, PRESETS.get(level, PRESETS["C"]), strict=True))
    return replace(Policy(**preset), **overrides)


def weighted(weights, *parts: Column) -> Column:
    return reduce(lambda a, b: a + b, [w * p for w, p in zip(weights, parts, strict=True)])


def multiplied(weights, *parts: Column) -> Column:
    """The alternative quality score: a weighted product."""
    return reduce(lambda a, b: a * b, [F.pow(p, F.lit(w)) for w, p in zip(weights, parts, strict=True)])


def windowed(frame: DataFrame, days: int, dims: Dims, grain: str = "1 day") -> DataFrame:
    """Per group, time bucket and trace of the last days: spans, sums of flags, and whether the trace is rejected.

    Spans are summed up before anything is joined to them, so that only these slim rows meet the
    flags of the traces, which come from the whole table. A group's traces are then counted without
    an aggregate of distinct values.
    """
    rejected = F.bool_or(reduce(lambda a, b: a | b, [a.violation for a in MANDATORY]))
    flags = cut(frame.groupBy(F.col("trace_id").alias("__trace")).agg(rejected.alias("rejected"), F.max("start_time_ns").alias("__last")))
    last = flags.agg((F.max("__last") - days * NS_PER_DAY).alias("__from"))
    recent = frame.crossJoin(F.broadcast(last)).filter(F.col("start_time_ns") >= F.col("__from"))  # one row
    sums = {"__rate": violations() / len(SPEC), "__gaps": absent(MANDATORY) / len(MANDATORY)} | {f"__broken_{a.name}": a.violation.cast("long") for a in MANDATORY}
    keys = [c.alias(f"__d_{k}") for k, c in dims.items()]
    rows = recent.groupBy(*keys, starts_at(grain).alias("ts"), F.col("trace_id").alias("__trace")).agg(F.count("*").alias("spans"), *[F.sum(c).alias(k) for k, c in sums.items()])
    joined = rows.join(flags.drop("__last"), "__trace", "left")  # spans without a trace stay unmarked
    return cut(joined.withColumnsRenamed({f"__d_{k}": k for k in dims}))


def components(win: DataFrame, p: Policy, dims: Dims) -> DataFrame:
    broken = [a.name for a in MANDATORY]
    own = {k: F.col(k) for k in dims}
    sums = ("spans", "__rate", "__gaps", *[f"__broken_{k}" for k in broken])
    traces = grouped(win, own | {"__trace": F.col("__trace"), "rejected": F.col("rejected")}, *[F.sum(c).alias(c) for c in sums])
    n, marked = F.sum("spans"), F.col("rejected").isNotNull()
    frame = grouped(
        traces, own,
        F.count("__trace").alias("traces"), F.count(F.when(~F.col("rejected"), F.col("__trace"))).alias("eff_traces"), F.coalesce(n, F.lit(0)).alias("spans"),
        (1 - F.sum("__rate") / n).alias("validity"), (1 - F.sum("__gaps") / n).alias("presence"),
        (1 - F.try_divide(F.sum(F.when(F.col("rejected"), F.col("spans")).otherwise(0)), F.sum(F.when(marked, F.col("spans"))))).alias("retention"),
        *[(F.sum(f"__broken_{k}") / n).alias(f"__broken_{k}") for k in broken],
    )
    worst = F.greatest(*[F.col(f"__broken_{k}") for k in broken])
    name = F.lit(NONE)
    for k in broken:  # on ties the last attribute in the order of the specification stands
        name = F.when(F.col(f"__broken_{k}") >= worst, F.lit(k)).otherwise(name)
    scored = frame.withColumn("worst_rule_rate", worst).withColumn("worst_rule_attr", F.when(worst <= 0, F.lit(NONE)).otherwise(name))
    scored = scored.drop(*[f"__broken_{k}" for k in broken]).withColumn("loss_rate", 1 - F.try_divide(F.col("eff_traces"), F.col("traces")))
    volume = logistic(p.steepness * (F.log10(F.col("eff_traces") + 1) - F.log10(F.lit(p.volume_target))))
    return scored.withColumn("volume_score", volume).withColumn("quality_score", weighted(p.quality_weights, F.col("validity"), F.col("presence"), F.col("retention")))


def acceleration(win: DataFrame, p: Policy, dims: Dims) -> DataFrame:
    own = {k: F.col(k) for k in dims} | {"ts": F.col("ts")}
    buckets = grouped(win, own, F.count("__trace").alias("n"), (1 - F.sum("__rate") / F.sum("spans")).alias("v"))
    frame = grouped(buckets, {k: F.col(k) for k in dims}, F.avg("n").alias("rate"), correlation(F.unix_seconds("ts"), F.col("n")).alias("trend"), F.stddev_samp("v").alias("__spread"))
    stability = F.coalesce(clip(1 - F.col("__spread") / p.stability_tol, 0.0, 1.0), F.lit(1.0))
    frame = frame.withColumn("stability", F.when(F.col("__spread").isNull(), 1.0).otherwise(stability)).withColumn("trend", F.coalesce("trend", F.lit(0.0)))
    score = weighted(p.dynamics_weights, logistic(p.trend_gain * F.col("trend")), F.col("stability"), 1 - F.exp(-F.col("rate") / p.rate_target))
    return frame.drop("__spread").withColumn("accel_score", score)


def assess(frame: DataFrame, p: Policy | None = None, dims: Dims | None = None, grain: str = "1 day") -> DataFrame:
    """One row per group: scores, readiness, verdict and its reason, the readiest first."""
    p, dims = p or Policy(), dims or {}
    win = windowed(frame, p.window_days, dims, grain)
    left, right = components(win, p, dims), acceleration(win, p, dims)
    joined = left.join(right, list(dims), "left") if dims else left.crossJoin(F.broadcast(right))  # without dims one row each
    readiness = weighted(p.readiness_weights, F.col("volume_score"), F.col("quality_score"), F.col("accel_score"))
    few, lossy, poor = F.col("eff_traces") < p.min_eff_traces, F.col("loss_rate") > p.max_loss, F.col("quality_score") < p.min_quality
    ready = F.col("readiness")
    verdict = F.when(few | lossy | poor, "not_ready").when(ready >= p.ready_at, "ready").when(ready >= p.pilot_at, "pilot").otherwise("not_ready")
    worst = F.col("worst_rule_attr")
    reason = (
        F.when(few, "too few traces").when(lossy, F.concat(F.lit("loss: "), worst)).when(poor, F.concat(F.lit("quality: "), worst))
        .when(F.col("trend") < 0, "volume falls").when(ready >= p.ready_at, "ready").when(ready >= p.pilot_at, "pilot").otherwise("accumulating")
    )
    out = joined.withColumn("readiness", readiness).withColumn("verdict", verdict).withColumn("reason", reason)
    columns = ("traces", "eff_traces", "loss_rate", "worst_rule_attr", "volume_score", "quality_score", "accel_score", "readiness", "verdict", "reason")
    return out.select(*dims, *columns).orderBy(F.desc("readiness"), *dims)


def blame(frame: DataFrame, dims: Dims | None = None) -> DataFrame:
    """Non-zero violation rates in long form."""
    dims = dims or {}
    rates = correctness(frame, dims)
    long = rates.unpivot([*dims, "n"], [a.name for a in SPEC if a.name not in dims], "attr", "violation_rate")
    return long.filter("violation_rate > 0").orderBy(F.desc("violation_rate"), "attr", *dims)


def flow_trend(buckets: DataFrame) -> DataFrame:
    """Correlation of volume with the place of its bucket."""
    from pyspark.sql import Window

    placed = buckets.withColumn("__i", F.row_number().over(Window.orderBy("ts")))  # a row for each time bucket
    return placed.agg(correlation(F.col("__i"), F.col("traces")).alias("trend"))
