"""Cases that the given tables do not hold."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import stats
from tracewright.operators import features, prep, quality, readiness, scoring, selection
from tracewright.sources import conform, fixture
from tracewright.sources.spec import SPEC

FOLDER = "/root/testdata/sf0.001"


def test_recast_cases(spark):
    frame = spark.createDataFrame([("12", "yes", "GET", [1]), ("x", "maybe", "FETCH", None), (None, None, None, None)], "llm_total_tokens string, llm_stream string, http_method string, span_name array<int>")
    rows = conform.recast(frame).collect()
    assert [r.llm_total_tokens for r in rows] == [12, -2, -1]
    assert [r.llm_stream for r in rows] == [True, False, False]
    assert [r.http_method for r in rows] == ["GET", "TRASH", "NONE"]
    assert [r.span_name for r in rows] == [None, None, None] and len(rows[0]) == len(SPEC)


def test_correlation_with_a_constant_is_null(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, None)], "x double, y double")
    assert frame.agg(stats.correlation(F.col("x"), F.col("y")).alias("c")).first().c is None


def test_empty_spans(spark):
    none = conform.recast(fixture.raw_spans(spark, FOLDER)).limit(0)
    assert quality.verdict(none).first().valid
    assert quality.completeness(none, {"agent_id": F.col("agent_id")}).count() == 0
    assert readiness.assess(none).count() == 1
    assert selection.select_traces(none, limit=5).count() == 0
    assert features.base_features(none).count() == 0


def test_select_arguments(spark):
    spans = conform.recast(fixture.raw_spans(spark, FOLDER))
    for wrong in ({"limit": 0}, {"holdout_percent": 101}, {"mode": "other"}, {"t_min": 2, "t_max": 1}):
        with pytest.raises(ValueError):
            selection.select_traces(spans, **wrong)
    whole = selection.select_traces(spans, holdout_percent=100)
    assert whole.filter("not holdout").isEmpty()
    assert selection.epoch_ns("1970.01.01-00:01:00000000007") == 60_000_000_007


def test_rolling_alias_of_the_running_frame(spark):
    chosen = [f for f in features.definitions() if f.name == "duration"]
    base = features.base_features(conform.recast(fixture.raw_spans(spark, FOLDER)), chosen)
    out = features.rolling_features(base.select("trace_id", "agent_id", "start_time_ns", "span_id", "duration"), (3, 50, 100), chosen)
    assert out.filter("abs(duration__mean_100 - duration__mean_50) > 1e-9 or (duration__mean_100 is null) <> (duration__mean_50 is null)").isEmpty() and out.filter("duration__mean_3 <> duration__mean_50").count() > 0


def test_redundant_ties_drop_the_second(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 0.5)], "feature string, neighbor string, corr double")
    assert [r.feature for r in prep.redundant(pairs).collect()] == ["b"]


def test_sweep_of_constant_and_empty_errors(spark):
    same = spark.createDataFrame([(1.0, 1), (1.0, 0)], "e double, y int")
    assert scoring.threshold_sweep(same, "e", "y", 5).filter("tp > 0").count() == 0
    assert scoring.threshold_sweep(same.limit(0), "e", "y", 5).count() == 0


def test_streams_agree_with_batch(spark, tmp_path):
    from tracewright.streaming import spans as streams

    batch = conform.recast(fixture.raw_spans(spark, FOLDER))
    batch.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("flow", streams.flow(source), "complete"), ("once", streams.deduplicate(source), "append")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("flow").agg(F.sum("spans")).first()[0] == batch.count()
    assert spark.table("once").count() == batch.select("trace_id", "span_id").distinct().count()
