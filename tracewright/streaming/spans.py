"""Streaming forms of the flow, of the rejection of traces and of duplicate removal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tracewright.operators.quality import violations
from tracewright.sources.spec import MANDATORY, SPEC


def with_time(spans: DataFrame) -> DataFrame:
    return spans.withColumn("ts", F.timestamp_micros((F.col("start_time_ns") / 1000).cast("bigint")))


def flow(spans: DataFrame, late: str = "1 day", grain: str = "1 day") -> DataFrame:
    """Spans and validity by time bucket; late spans are waited for."""
    rows = with_time(spans).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", grain)["start"].alias("bucket")).agg(F.count("*").alias("spans"), (1 - F.avg(violations() / len(SPEC))).alias("validity"))


def trace_flow(spans: DataFrame, late: str = "1 day", grain: str = "1 day") -> DataFrame:
    """bucket, traces, spans, validity: distinct traces of each time bucket, once no later span of it is waited for (append mode).

    Spans are first counted by bucket and trace, so a bucket is spread over tasks by its traces; then
    the traces of a bucket are counted.
    """
    rows = with_time(spans).withWatermark("ts", late).withColumn("__v", violations() / len(SPEC))
    by_trace = rows.groupBy(F.window("ts", grain).alias("w"), "trace_id").agg(F.count("*").alias("n"), F.sum("__v").alias("v"))
    whole = by_trace.groupBy(F.window(F.window_time("w"), grain)["start"].alias("bucket"), F.window(F.window_time("w"), grain).alias("__w"))
    return whole.agg(F.count("trace_id").alias("traces"), F.sum("n").alias("spans"), (1 - F.sum("v") / F.sum("n")).alias("validity")).drop("__w")


class _Traces(StatefulProcessor):
    """Spans of a trace so far and how many break a rule; a timer closes it when no span has come for a while."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trace", "spans long, bad long, until long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark's names
        spans, bad, until = self.state.get() if self.state.exists() else (0, 0, -1)
        was = bad > 0 if spans else None
        last = 0
        for frame in rows:
            spans += len(frame)
            bad += int(frame["bad"].sum())
            last = max(last, int(frame["ms"].max()))
        if last + self.quiet > until:
            if until >= 0:
                self.handle.deleteTimer(until)
            until = last + self.quiet
            self.handle.registerTimer(until)
        self.state.update((spans, bad, until))
        if was != (bad > 0):
            yield self._row(key, spans, bad, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        spans, bad, _ = self.state.get()
        self.state.clear()
        yield self._row(key, spans, bad, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, spans: int, bad: int, final: bool) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": [key[0]], "spans": [spans], "bad": [bad], "rejected": [bad > 0], "final": [final]})


def rejections(spans: DataFrame, late: str = "1 day", quiet_ms: int = 86_400_000) -> DataFrame:
    """trace_id, spans, bad, rejected, final: a row when a trace is first seen, when a span first breaks a mandatory rule, and when it closes.

    A trace closes when the watermark is ``quiet_ms`` past its last span; a span that comes later begins it anew. Traces
    are keys of their own, so state is spread over tasks; it needs the RocksDB state store. Spans without a trace are left out.
    """
    bad = (violations(MANDATORY) > 0).cast("int")
    rows = with_time(spans).withWatermark("ts", late).filter(F.col("trace_id").isNotNull())
    slim = rows.select("trace_id", "ts", bad.alias("bad"), F.unix_millis("ts").alias("ms"))
    return slim.groupBy("trace_id").transformWithStateInPandas(_Traces(quiet_ms), "trace_id string, spans long, bad long, rejected boolean, final boolean", "Update", "EventTime")


def deduplicate(spans: DataFrame, late: str = "1 day") -> DataFrame:
    """The first span of each (trace_id, span_id) within the watermark."""
    return with_time(spans).withWatermark("ts", late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])
