"""Selecting whole traces, with a cap on spans and a reproducible holdout."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.stats import u01

A, C, M = 1_103_515_245, 12_345, 2**31
#: Buckets of the histogram that finds where a limit falls.
BUCKETS = 1024


def epoch_ns(text: str) -> int:
    """yyyy.mm.dd-hh:mm:nnnnnnnnnnn, with 11 digits of nanoseconds within the minute, to epoch nanoseconds."""
    m = re.fullmatch(r"(\d{4}\.\d{2}\.\d{2}-\d{2}:\d{2}):(\d{11})", text)
    if not m:
        raise ValueError(f"not a time: {text!r}")
    minute = datetime.strptime(m[1], "%Y.%m.%d-%H:%M").replace(tzinfo=timezone.utc)
    return int(minute.timestamp()) * 1_000_000_000 + int(m[2])


def _checked(t_min, t_max, limit, mode, method, percent, subset):
    if t_min is not None and t_max is not None and t_min > t_max:
        raise ValueError("the time range is empty")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be above 0")
    if not 0 <= percent <= 100:
        raise ValueError("holdout_percent must be from 0 to 100")
    if mode not in ("strict", "loose", "open") or method not in ("recent", "seeded", "random") or subset not in ("full", "train", "test"):
        raise ValueError("unknown mode, method or subset")


def select_traces(
    spans: DataFrame, agents: list[str] | None = None, t_min: int | None = None, t_max: int | None = None, limit: int | None = None, mode: str = "strict",
    holdout_method: str = "recent", holdout_percent: float = 0, seed: int = 0, subset: str = "full",
) -> DataFrame:
    """Spans of the chosen traces with ``holdout``.

    strict: all spans match the agents, and the trace lies within the times; loose: some span
    matches; open: matching spans alone, where ``limit`` caps rows. Else ``limit`` caps the spans
    of whole traces, earliest first. Order and positions are worked out on the table of
    traces, a row each, by ranges, not in one task.
    """
    _checked(t_min, t_max, limit, mode, holdout_method, holdout_percent, subset)
    agent = F.lit(True) if agents is None else F.coalesce(F.col("agent_id").isin(agents), F.lit(False))
    after = F.lit(True) if t_min is None else F.col("start_time_ns") >= t_min
    before = F.lit(True) if t_max is None else F.col("start_time_ns") <= t_max
    fits = agent & after & before
    traces = spans.filter(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(
        F.bool_and(agent).alias("all_agents"), F.bool_or(fits).alias("any"), F.min(F.when(fits, F.col("start_time_ns")) if mode == "open" else F.col("start_time_ns")).alias("begin"), F.max("end_time_ns").alias("end"), F.count("*").alias("n")
    )
    if mode == "strict":
        low = F.lit(True) if t_min is None else F.col("begin") >= t_min
        high = F.lit(True) if t_max is None else F.col("end") <= t_max
        traces = traces.filter(F.col("all_agents") & low & high)
    else:
        traces = traces.filter("any")
    traces = cut(traces.select("trace_id", "begin", "n"))  # a row for each trace, read several times
    if limit is not None and mode != "open":
        traces = cut(within(traces, "begin", "trace_id", F.col("n"), limit, "__fits").filter("__fits").drop("__fits"))
    marked = _held_out(traces, holdout_method, holdout_percent, seed)
    marked = {"full": marked, "train": marked.filter("not holdout"), "test": marked.filter("holdout")}[subset]
    rows = spans.filter(fits) if mode == "open" else spans
    out = rows.join(marked.select("trace_id", "holdout"), "trace_id").orderBy("trace_id", "start_time_ns", "span_id")
    return out.limit(limit) if mode == "open" and limit is not None else out


def _held_out(traces: DataFrame, method: str, percent: float, seed: int) -> DataFrame:
    total = traces.count()
    held = total - int((1 - percent / 100) * total)
    if method == "recent":
        return within(traces, "begin", "trace_id", F.lit(1), held, "holdout", newest=True)
    if method == "seeded":
        placed = _running(traces, [F.col("begin"), F.col("trace_id")], F.lit(1), "pos")  # positions from the oldest on
        step = lambda x: F.pmod(x * A, F.lit(M))
        key = F.pmod(step(F.pmod((F.col("pos") + 1) * A + seed % M, F.lit(M))) + C, F.lit(M))
        placed = _running(placed.withColumn("__key", key).drop("pos"), [F.col("__key"), F.col("trace_id")], F.lit(1), "pos")
    else:
        placed = _running(traces.withColumn("__key", F.rand()), [F.col("__key"), F.col("trace_id")], F.lit(1), "pos")
    return placed.withColumn("holdout", F.col("pos") < held)


def within(frame: DataFrame, by: str, tie: str, weight: Column, limit: int, name: str, newest: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``frame`` with whether a row and all before it, from the least ``by`` (or the greatest, if ``newest``), weigh at most ``limit`` together.

    A histogram of ``by`` finds the bucket in which the limit falls. Buckets before it fit whole and those
    after it do not; only its own rows are put in order.
    """
    low, high = frame.agg(F.min(by), F.max(by)).first()
    width = max(1, -(-(high - low + 1) // buckets)) if low is not None else 1
    place = F.floor((F.col(by) - F.lit(low or 0)) / width).cast("long")
    place = F.coalesce(buckets - place if newest else place, F.lit(buckets + 1 if newest else -1))  # nulls first, or last
    rows = frame.withColumns({"__bucket": place, "__weight": weight.cast("long")})
    full, edge = 0, None
    for bucket, size in sorted(tuple(r) for r in rows.groupBy("__bucket").agg(F.sum("__weight")).collect()):  # a row for each bucket
        if full + size > limit:
            edge = bucket
            break
        full += size
    if edge is None:
        return frame.withColumn(name, F.lit(True))
    order = [F.col(by).desc(), F.col(tie).desc()] if newest else [F.col(by), F.col(tie)]
    at_edge = _running(rows.filter(F.col("__bucket") == edge), order, F.col("__weight"), "__upto").withColumn(name, F.col("__upto") + F.col("__weight") + full <= limit)
    rest = rows.filter(F.col("__bucket") != edge).withColumn(name, F.col("__bucket") < edge)
    return rest.select(*frame.columns, name).unionByName(at_edge.select(*frame.columns, name))


def _running(frame: DataFrame, order: list, value, name: str) -> DataFrame:
    """Sum over all rows before, in a total order: sums within ranges, plus the totals of the ranges before."""
    spark = frame.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.withColumn("__v", value.cast("bigint")).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    dealt = cut(dealt)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__range").agg(F.sum("__v").alias("__s")).select("__range", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.withColumn("__own", F.coalesce(F.sum("__v").over(own), F.lit(0))).join(F.broadcast(starts), "__range")  # a row for each partition at most
    return joined.withColumn(name, F.col("__own") + F.col("__start")).select(*frame.columns, name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for all to share; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            import atexit
            import shutil
            import tempfile

            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tracewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def head(frame: DataFrame, order: list, n: int) -> DataFrame:
    """The first rows in an order; each task keeps n at most."""
    return frame.orderBy(*order).limit(n)


def sample_by(frame: DataFrame, key: str, group: str, n: int, salt: str = "shuffle") -> DataFrame:
    """Up to n rows of each group, first in a hashed order; parts of a group are cut to n before they meet."""
    place = [u01(F.col(key).cast("string"), salt), F.col(key)]
    part = F.pmod(F.xxhash64(key), F.lit(64))
    first = frame.withColumn("__i", F.row_number().over(Window.partitionBy(group, part).orderBy(*place))).filter(F.col("__i") <= n)
    return first.withColumn("__i", F.row_number().over(Window.partitionBy(group).orderBy(*place))).filter(F.col("__i") <= n).drop("__i")


def mode_of(whole_traces: bool, whole_window: bool) -> str:
    """strict if every span must fit, loose if whole traces with any fitting span are kept, else open."""
    return "strict" if whole_window else "loose" if whole_traces else "open"


def piped(frame: DataFrame, *steps) -> DataFrame:
    """Steps from frame to frame, one after the other."""
    for step in steps:
        frame = frame.transform(step)
    return frame
