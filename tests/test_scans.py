"""Looking back by ranges equals windows, whatever one key holds; caps by histogram; documents, sketches, runs and streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import features, quality, scans, scoring, selection, sketches, stacking
from tracewright.sources import conform, document, fixture

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """Nine tenths of the rows in one trace, some without a trace."""
    rng = random.Random(1)
    rows = [("hot" if i % 10 else rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), i // 2 * 7, f"s{i:05d}", rng.choice(["tool", "llm"]), rng.choice([None, 1, 2])) for i in range(2000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "trace_id string, agent_id string, start_time_ns long, span_id string, aef_kind string, n int")


def test_scans_equal_windows(hot):
    order = ["start_time_ns", "span_id"]
    object_ = Window.partitionBy("trace_id", "agent_id").orderBy(*order)
    want = hot.withColumns(
        {
            "last": F.lag("n").over(object_), "kind": F.lag("aef_kind").over(Window.partitionBy("trace_id").orderBy(*order)),
            "first": (F.row_number().over(Window.partitionBy("trace_id", "agent_id", "n").orderBy(*order)) == 1).cast("int"),
            "sum": F.coalesce(F.sum("n").over(object_.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)), "place": F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)) - 1,
        }
    )
    rows = scans.dealt(hot, ["trace_id", *order])
    sizes = [r["count"] for r in rows.groupBy("__range").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 1200  # the hot trace lies in several ranges
    rows = scans.last_before(rows, ["trace_id", "agent_id"], F.col("n"), "last")
    rows = scans.last_before(rows, ["trace_id"], F.col("aef_kind"), "kind")
    rows = scans.first_of(rows, ["trace_id", "agent_id", "n"], "first")
    rows = scans.sums_upto(rows, ["trace_id", "agent_id"], {"sum": F.col("n")})
    rows = rows.join(scans.places(hot, ["trace_id"], order, "place").select("span_id", "place"), "span_id")
    columns = ["span_id", "last", "kind", "first", "sum", "place"]
    key = lambda r: r.span_id
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()), key=lambda r: r[0])
    assert scans.places(hot.limit(0), ["trace_id"], order, "place").count() == 0 and key


def test_features_have_no_window_over_a_trace(spark):
    base = features.base_features(conform.recast(fixture.clean_spans(spark, FOLDER)))
    plan = base._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert windows and all("__range" in w for w in windows)
    with pytest.raises(ValueError, match="delta_time"):
        features.base_features(base, [f for f in features.definitions() if f.name == "cv_delta"])


@pytest.mark.parametrize("newest", [False, True])
def test_limits_by_histogram_equal_sorting(spark, newest):
    rng = random.Random(2)
    rows = [(f"t{i}", rng.choice([None, 5, 5, 5, rng.randrange(10**18)]), rng.randrange(1, 9)) for i in range(300)]
    frame = spark.createDataFrame(rows, "trace_id string, begin long, n long")
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=newest)
    for limit in (0, 1, 17, 400, 10**6):
        total, want = 0, {}
        for t, _, n in ordered:
            total += n
            want[t] = total <= limit
        for buckets in (1, 7, 1024):
            got = {r.trace_id: r.ok for r in selection.within(frame, "begin", "trace_id", F.col("n"), limit, "ok", newest, buckets).collect()}
            assert got == want
    assert selection.within(frame.limit(0), "begin", "trace_id", F.col("n"), 5, "ok").count() == 0


def test_document_is_one_whole(spark, tmp_path):
    rows = [(f"t{i}", None if i % 3 else f'text "{i}"\nё ', float(i)) for i in range(25)]
    frame = spark.createDataFrame(rows, "trace_id string, note string, x double").repartition(6).sortWithinPartitions("trace_id")
    path = f"{tmp_path}/found.json"
    document.write_document(frame, path)
    document.write_document(frame, path)  # again, over the old one
    found = json.load(open(path, encoding="utf-8"))
    assert list(found) == ["anomalies"] and sorted((r["trace_id"], r["note"], r["x"]) for r in found["anomalies"]) == sorted(rows)
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    back = document.read_document(spark, path, "trace_id string, note string, x double")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    document.write_document(frame.limit(0), path, "found")
    assert json.load(open(path)) == {"found": []}


def test_parts_of_lost_attempts_stay_out(tmp_path):
    """Only the attempt that Spark names is copied."""
    writer = document.DocumentWriter(f"{tmp_path}/x.json", "anomalies")
    folder = tmp_path / writer.parts.rsplit("/", 1)[1]
    folder.mkdir()
    for name, text in (("00000000-1", '{"a": 1}'), ("00000000-2", '{"a": 1}'), ("00000001-3", '{"a": 2}')):
        (folder / name).write_text(text)
    writer.commit([document.Part(1, f"{folder}/00000001-3", 1), None, document.Part(0, f"{folder}/00000000-2", 1)])
    assert json.load(open(tmp_path / "x.json")) == {"anomalies": [{"a": 1}, {"a": 2}]} and not folder.exists()


def test_sketches_keep_their_bound(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(0, 3, 30_000), np.full(10_000, 5.0)])
    frame = spark.createDataFrame([(int(i % 7), int(i % 3), float(v)) for i, v in enumerate(x)], "day int, agent int, x double").repartition(8)
    daily = sketches.sketches(frame, {"day": F.col("day"), "agent": F.col("agent")}, {"x": F.col("x"), "none": F.lit(None).cast("double")})
    assert daily.count() == 21
    (row,) = sketches.quantiles(sketches.rolled_up(daily, []), (0.01, 0.5, 0.95)).collect()
    ordered = np.sort(x)
    for q, v in zip((0.01, 0.5, 0.95), row.quantiles, strict=True):
        low, high = np.searchsorted(ordered, v) / len(x), np.searchsorted(ordered, v, side="right") / len(x)
        assert low - 2 * sketches.error() <= q <= high + 2 * sketches.error()
    assert row.n == len(x) and sketches.error() < 0.002


def test_differences_of_runs(spark):
    rows = [(i, None if i % 9 == 0 else f"k{i % 4}", float(i)) for i in range(500)] + [(7, "k3", 7.0)]
    a = spark.createDataFrame(rows, "id int, k string, x double")
    assert scoring.differences(a, a.repartition(7), ["id"]).isEmpty() and scoring.same_to(a, a.withColumn("x", F.col("x") + 1e-9))
    b = a.filter("id <> 11").withColumns({"x": F.when(F.col("id") == 5, 9.0).otherwise(F.col("x") + 1e-8), "k": F.when(F.col("id") == 6, None).otherwise(F.col("k"))})
    b = b.unionByName(spark.createDataFrame([(None, "new", 1.0)], a.schema))
    found = {(r.id, r.column) for r in scoring.differences(a, b, ["id"]).collect()}
    assert found == {(11, "__row"), (5, "x"), (6, "k"), (None, "__row")} and not scoring.same_to(a, b)
    assert scoring.differing_leaves(scoring.digests(a, ["id"]), scoring.digests(a.filter("id <> 11"), ["id"])) and scoring.differences(a.limit(0), a.limit(0)).isEmpty()


def test_all_learners_and_calibration(spark):
    """Isotonic regression of margins beats their softmax on held-out rows; all five learners are stacked."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + 0.7 * rng.normal(size=600) > 0.3).astype(int)
    frame = spark.createDataFrame([(i, v.tolist(), "ab"[k]) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, label string")
    train, test = frame.filter("id % 3 > 0"), frame.filter("id % 3 = 0")
    stack = stacking.fit_stack(train, "v", "label", "id", ["a", "b"], kinds=("logreg", "svm", "mlp", "forest", "boosting"), k=2)
    found = stack.classify(test, "v").collect()
    assert len(found) == 200 and sum(r.label == r.predicted_class for r in found) > 150
    assert [c is None for c in stack.calibrations] == [True, False, True, True, False]
    from pyspark.ml.functions import array_to_vector

    raw = stacking._scores(stack.models[1], test.withColumn("__x", array_to_vector("v")), "s").withColumn("y", (F.col("label") == "b").cast("int"))
    soft = F.exp(F.col("s")[1]) / (F.exp(F.col("s")[0]) + F.exp(F.col("s")[1]))
    p = stacking._calibrated(F.col("s"), stack.calibrations[1])[1]
    brier = raw.agg(F.avg((p - F.col("y")) ** 2).alias("ours"), F.avg((soft - F.col("y")) ** 2).alias("soft")).first()
    assert brier.ours < brier.soft
    steps = stacking.fit_calibration(spark.createDataFrame([(float(i), int(i in (3, 4, 7, 8, 9))) for i in range(10)], "s double, y int"), F.col("s"), F.col("y"))
    assert steps.probabilities == sorted(steps.probabilities) and steps.probabilities[0] == 0 and steps.probabilities[-1] == 1
    assert stacking.fit_calibration(frame.limit(0), F.col("id"), F.col("id")).scores == []


def test_streams_of_traces(spark, tmp_path):
    """Distinct traces of closed buckets equal the batch, late spans included; a trace is rejected when a bad span comes."""
    from tracewright.streaming import spans as streams

    batch = conform.recast(fixture.raw_spans(spark, FOLDER))
    first, late = batch.filter("crc32(span_id) % 5 > 0"), batch.filter("crc32(span_id) % 5 = 0")
    end = batch.orderBy(F.desc("start_time_ns")).limit(1).withColumns({"trace_id": F.lit("end"), "start_time_ns": F.col("start_time_ns") + 100 * 86_400 * 10**9})
    for i, part in enumerate((first, late, end)):  # one file for each micro-batch
        part.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        files = tmp_path / "in"
        files.mkdir()
        queries_ = {}
        source = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(files))
        for name, frame, mode in (("closed", streams.trace_flow(source(), late="60 days"), "append"), ("status", streams.rejections(source(), late="60 days", quiet_ms=1), "update")):
            sink = str(tmp_path / name)
            queries_[name] = (frame, mode, sink)
        for i in range(3):
            (path,) = (tmp_path / f"part{i}").glob("*.parquet")
            path.rename(files / f"{i}.parquet")
            for name, (frame, mode, sink) in queries_.items():
                collect = lambda rows, number, name=name: rows.write.mode("append").parquet(f"{tmp_path}/{name}-out")
                frame.writeStream.foreachBatch(collect).outputMode(mode).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r.ts: r.traces for r in quality.flow(batch).collect()}
    got = {r.bucket: r.traces for r in spark.read.parquet(f"{tmp_path}/closed-out").collect()}
    assert got == want
    status = spark.read.parquet(f"{tmp_path}/status-out")
    rejected = {r.trace_id for r in quality.trace_status(batch).filter("rejected").collect()}
    final = {r.trace_id: r for r in status.filter("final").collect()}
    assert {t for t, r in final.items() if r.rejected} == rejected
    assert sum(r.spans for r in final.values()) == batch.filter("trace_id is not null").count()
    assert status.filter("not final and rejected").select("trace_id").distinct().count() >= len(rejected) - 1
