"""What must not grow faster than its input."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import features, prep, quality, ranks, scans
from tracewright.operators.rolling import rolled, rolled_means
from tracewright.plans.queries import clean

SMALL = "/root/testdata/sf0.001"


def analyzed(frame):
    return frame._jdf.queryExecution().analyzed().toString()


def test_embedding_splits_a_text_once(spark):
    rows = spark.createDataFrame([("Done. The tool is done",), ("",), (None,)], "t string").select("t", prep.hashed_embedding(F.col("t"), 8).alias("v"))
    assert analyzed(rows).count("split(") == 1
    places = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(8))).first()[0] for w in ("done", "the", "tool", "is")}
    counts = np.zeros(8)
    for w in ("done", "the", "tool", "is", "done"):
        counts[places[w]] += 1
    first, *empty = [r.v for r in rows.collect()]
    np.testing.assert_allclose(first, counts / np.linalg.norm(counts))
    assert empty == [[0.0] * 8] * 2


def test_many_levels_are_looked_up_not_tried(spark):
    rng, levels = np.random.default_rng(5), [i / 200 for i in range(201)] + [0.95, 0.005]
    groups = {"a": rng.normal(size=777), "b": rng.integers(0, 9, 1000).astype(float), "c": np.array([4.0])}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double")
    for linear, method in ((True, "linear"), (False, None)):
        found = ranks.of_ranks(ranks.ranked(rows, ["g"], "x"), ["g"], "x", levels, linear)
        assert "transform(array(" not in analyzed(found)
        got = {r.g: r.quantiles for r in found.collect()}
        for g, v in groups.items():
            at = np.rint((len(v) - 1) * np.array(levels)).astype(int)
            np.testing.assert_allclose(got[g], np.quantile(v, levels) if method else np.sort(v)[at], rtol=1e-12, atol=1e-12)


def test_means_of_rolling_aggregates_equal_those_of_the_long_form(spark):
    rng = np.random.default_rng(7)
    rows = [(f"k{i % 3}" if i % 7 else None, int(i), None if i % 5 == 0 else f"a{i % 2}", float(rng.normal()) if i % 11 else None, float(i % 4)) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, t long, a string, x double, y double")
    wanted, widths, kinds = {"x": ("max", "std", "q"), "y": ("mean", "sum")}, (3, 40), ("max", "min", "mean", "std", "sum", "q50")
    long = rolled(frame, ["k"], ["t"], wanted, widths, (0.5,), long=True, block=64)
    means = rolled_means(frame, ["k"], ["t"], wanted, widths, (0.5,), ["a"], block=64)
    expected = long.groupBy("a", "feature", "width").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in kinds])
    assert means.columns == expected.columns
    got, want = ({(r.a, r.feature, r.width): r[3:] for r in f.collect()} for f in (means, expected))
    assert got.keys() == want.keys() and len(got) == 12
    for k in want:
        assert [x is None for x in got[k]] == [x is None for x in want[k]]
        np.testing.assert_allclose([x or 0 for x in got[k]], [x or 0 for x in want[k]], rtol=1e-12, atol=1e-12)


def test_quantiles_of_an_object_are_counted_once(spark):
    chosen = [f for f in features.definitions() if f.name == "duration"]
    out = features.static_by_object(features.base_features(clean(spark, SMALL), chosen), chosen)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") <= 2 * len(features.QUANTILES)
    assert "[0.25,0.5,0.75,0.9,0.95]" in plan.replace(" ", "")


def test_only_what_features_need_is_looked_up(spark, monkeypatch):
    monkeypatch.setattr(scans, "first_of", None)  # belongs to unique_tools_local alone
    chosen = [f for f in features.definitions() if f.name in ("delta_time", "exec_gap")]
    assert features.base_features(clean(spark, SMALL).select(*features.INPUTS), chosen).count() == clean(spark, SMALL).count()


def test_looking_back_shuffles_the_rows_once(spark):
    rows = scans.dealt(clean(spark, SMALL).select(*features.INPUTS), ["trace_id", "start_time_ns", "span_id"])
    rows = scans.last_before(rows, ["trace_id", "agent_id"], F.col("aef_kind"), "a")
    rows = scans.last_before(rows, ["trace_id"], F.col("aef_kind"), "b")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_dynamics_work_out_their_signals_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(quality, "cut", lambda frame: kept.append(frame.columns) or frame)
    quality.dynamics(clean(spark, SMALL))
    assert kept and {"missing", "invalid"} <= set(kept[0])
