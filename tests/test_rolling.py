"""Rolling aggregates, correlations of many columns and static shares against numpy and Spark's own windows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import features, gram, prep, rolling

WIDTHS, KINDS, PLACES = (3, 10, 50, 1000), ("max", "min", "mean", "std", "sum", "q"), (0.25, 0.5, 0.95)


def naive(values, first, w):
    out = []
    for i in range(len(values)):
        x = values[max(first[i], i - w + 1) : i + 1]
        x = x[~np.isnan(x)]
        if not len(x):
            out.append([np.nan] * 8)
        else:
            out.append([x.max(), x.min(), x.mean(), x.std(ddof=1) if len(x) > 1 else np.nan, x.sum(), *np.quantile(x, PLACES)])
    return np.array(out).T


def test_windows_equal_numpy():
    rng = np.random.default_rng(1)
    for n in (1, 2, 700):
        values = np.round(rng.normal(size=n), 1) * 10.0 ** rng.integers(0, 9)
        values[rng.random(n) < 0.2] = np.nan
        first = np.maximum.accumulate(np.where(rng.random(n) < 0.02, np.arange(n), 0))
        got = rolling.windowed(values, first, list(WIDTHS), KINDS, PLACES)
        for w in WIDTHS:
            names = ["max", "min", "mean", "std", "sum", "q25", "q50", "q95"]
            want = naive(values, first, w)
            assert all(np.allclose(got[w, k], x, rtol=1e-9, atol=1e-6, equal_nan=True) for k, x in zip(names, want, strict=True))


def test_kth_smallest():
    rng = np.random.default_rng(2)
    ranks = rng.integers(0, 37, 500)
    wavelet = rolling.Wavelet(ranks)
    begin = rng.integers(0, 499, 2000)
    end = begin + 1 + (rng.random(2000) * (500 - begin)).astype(int)
    k = (rng.random(2000) * (end - begin)).astype(int)
    assert wavelet.kth(begin, end, k).tolist() == [sorted(ranks[b:e])[i] for b, e, i in zip(begin, end, k, strict=True)]


@pytest.mark.parametrize("block", [64, 8192])
def test_long_objects_over_blocks_equal_windows(spark, block):
    """One object with nine tenths of the rows is cut into blocks with halos, beside short ones and null keys."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 10 else (f"t{i // 50}" if i % 20 else None), "a", int(rng.integers(0, 10**6)) * 10**9 + i, f"s{i}", None if i % 7 == 0 else float(rng.normal()), i % 3, "kept") for i in range(3000)]
    frame = spark.createDataFrame(rows, "trace_id string, agent_id string, start_time_ns long, span_id string, x double, k int, text string")
    got = rolling.rolled(frame, ["trace_id", "agent_id"], ["start_time_ns", "span_id"], {"x": ("mean", "std", "q"), "k": ("max", "sum")}, (5, 100), (0.5,), block=block)
    want = frame
    for w in (5, 100):
        over = Window.partitionBy("trace_id", "agent_id").orderBy("start_time_ns", "span_id").rowsBetween(1 - w, 0)
        made = {"x__mean": F.avg("x"), "x__std": F.stddev_samp("x"), "x__q50": F.percentile("x", 0.5), "k__max": F.max("k"), "k__sum": F.sum("k")}
        want = want.withColumns({f"{k}_{w}": v.over(over).cast("double") for k, v in made.items()})
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    table = lambda f: {r.span_id: [r[c] for c in names] for r in f.collect()}
    ours, theirs = table(got), table(want)
    assert len(ours) == 3000
    for key, row in theirs.items():
        assert all(a == b or (isinstance(b, float) and abs(a - b) < 1e-9 * max(1, abs(b))) for a, b in zip(ours[key], row, strict=True)), (key, ours[key], row)
    if block == 64:
        plan = got.select("span_id", "x__mean_5").rdd.glom().map(len).collect()
        assert max(plan) < 2500  # the hot object is in several tasks
    assert rolling.rolled(frame.limit(0), ["trace_id"], ["start_time_ns"], {"x": ("mean",)}, (3,), ()).count() == 0


def test_long_form_holds_all_features(spark):
    base = spark.createDataFrame([("t", "a", i, f"s{i}", float(i), i % 2) for i in range(12)], "trace_id string, agent_id string, start_time_ns long, span_id string, duration double, is_tool int")
    chosen = [f for f in features.definitions() if f.name in ("duration", "is_tool")]
    rows = features.rolling_features(base, (3, 1000), chosen, long=True).collect()
    assert len(rows) == 12 * 2 * 2
    last = {(r.feature, r.width): r for r in rows if r.start_time_ns == 11}
    assert last["duration", 3]["sum"] == 30 and last["duration", 1000].q50 == 5.5 and last["is_tool", 3]["mean"] == pytest.approx(2 / 3) and last["is_tool", 3]["sum"] is None


def test_correlations_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 11)) @ rng.normal(size=(11, 11))
    x[:, 3] = 7.25
    x[:, 4] = 1.7e18 + 1e9 * x[:, 4]  # times in nanoseconds
    x[:, 5] = x[:, 6] * 2
    holes = x.copy()
    holes[rng.random(x.shape) < 0.1] = np.nan
    holes[:, 8] = np.nan
    for table in (x, holes):
        frame = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in table], ", ".join(f"c{i:02d} double" for i in range(11))).repartition(5)
        names = frame.columns
        got = {(r.feature, r.neighbor): r["corr"] for r in gram.correlations(frame, names[::-1], block=4).collect()}
        assert len(got) == 55 and all(a < b for a, b in got)
        for (a, b), c in got.items():
            u, v = table[:, int(a[1:])], table[:, int(b[1:])]
            both = ~(np.isnan(u) | np.isnan(v))
            constant = both.sum() < 2 or np.ptp(u[both]) == 0 or np.ptp(v[both]) == 0
            assert c is None if constant else c == pytest.approx(np.corrcoef(u[both], v[both])[0, 1], abs=1e-9)
        strong = {(r.feature, r.neighbor) for r in gram.correlations(frame, names, above=0.5, block=3).collect()}
        assert strong == {k for k, c in got.items() if c is not None and abs(c) > 0.5} and ("c05", "c06") in strong
    assert gram.correlations(frame, names[:1]).count() == 0 and all(r["corr"] is None for r in gram.correlations(frame.limit(0), names[:2]).collect())


def test_static_shares_of_majorities(spark, monkeypatch):
    monkeypatch.setattr(gram, "ROWS", 7)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1000):
        rows.append((1.0 if i < 600 else float(i), float(i), None if i % 3 else 2.0, float("nan") if i % 4 else 1.0, float(i % 2), 0.0 if rng.random() < 0.97 else -1.0, [0.0, -0.0][i % 2]))
    frame = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(7))).repartition(6)
    want = {r.feature: r.static for r in prep.static_rates(frame, frame.columns).collect()}
    got = {r.feature: r.static for r in gram.static_rates(frame, frame.columns).collect()}
    assert got == {k: pytest.approx(v) if v > 0.5 else None for k, v in want.items()} and got["c6"] == 1 and got["c1"] is None and got["c3"] == 0.75
    assert {r.static for r in gram.static_rates(frame.limit(0), frame.columns).collect()} == {None}


def test_columns_survive_at_the_whole_width(spark):
    """Columns of the whole expansion: one read for correlations, as numpy chooses."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 300))
    wide = np.concatenate([base, base[:, :40] * 3 + 1, np.ones((120, 20)), base[:, :10] * 1e8], axis=1)
    wide[rng.random(wide.shape) < 0.01] = np.nan
    frame = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in wide], ", ".join(f"c{i:04d} double" for i in range(wide.shape[1])))
    kept = prep.surviving(prep.filled(frame, frame.columns), frame.columns, most_corr=0.7)
    assert len(kept) >= 290 and not [c for c in kept if 340 <= int(c[1:]) < 360]
    x = np.nan_to_num(wide)
    corr = np.abs(np.corrcoef(x[:, [int(c[1:]) for c in kept]], rowvar=False))
    np.fill_diagonal(corr, 0)
    assert (corr <= 0.7 + 1e-9).all()


def test_fill_by_group_and_z_scores_equal_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [(["a", "b", None, "none"][i % 4], None if i % 3 == 0 or i % 4 == 3 else float(rng.normal()), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "g string, x double, i int")
    for how, pick in (("mean", np.mean), ("median", np.median)):
        got = {r.i: r.x for r in prep.filled(frame, ["x"], how, ["g"]).collect()}
        for g in ("a", "b", None):
            middle = pick([x for k, x, _ in rows if k == g and x is not None])
            assert all(got[i] == pytest.approx(x if x is not None else middle) for k, x, i in rows if k == g)
        assert all(got[i] is None for k, _, i in rows if k == "none")
        whole = {r.i: r.x for r in prep.filled(frame, ["x"], how).collect()}
        assert whole[0] == pytest.approx(pick([x for _, x, _ in rows if x is not None]))
    x = np.round(rng.normal(size=(300, 2)), 2)
    stats = {r.dim: r for r in prep.dimension_stats(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v", "zscore").collect()}
    for d in (0, 1):
        low, high = (np.sort(x[:, d])[round(299 * q)] for q in (0.01, 0.99))
        cut = np.clip(x[:, d], low, high)
        assert stats[d].shift == pytest.approx(cut.mean()) and stats[d].scale == pytest.approx(cut.std(ddof=1))


def test_small_reports(spark):
    from tracewright.operators import reports

    sweep = spark.createDataFrame([(0.1, 0.75, 0.5)], "threshold double, specificity double, recall double")
    assert tuple(reports.roc_points(sweep).first()) == (0.25, 0.5)
    held = spark.createDataFrame([({"a": 1.0, "b": 2.0},)], "m map<string,double>")
    assert sorted(map(tuple, reports.mapping(held, "m").collect())) == [("a", 1.0), ("b", 2.0)]


def test_the_whole_expansion_is_as_wide_as_specified(spark):
    """Its survivors are those that numpy chooses from the same table."""
    from tracewright.operators import selection
    from tracewright.plans import queries

    wide = selection.cut(features.expand(queries.clean(spark, "/root/testdata/sf0.001")))
    names = prep.numeric_columns(wide, ("start_time_ns",))
    assert len(names) >= 2900
    kept = prep.surviving(selection.cut(prep.filled(wide, names).select(*names)), names)
    x = np.array([[0.0 if v is None else float(v) for v in r] for r in wide.select(names).collect()])
    x = dict(zip(names, x.T, strict=True))
    varied = {c for c in names if np.unique(x[c], return_counts=True)[1].max() <= 0.95 * len(x[c])}
    assert set(kept) <= varied and all(np.abs(x[c]).max() <= 1e6 for c in kept)
    corr = np.abs(np.corrcoef(np.array([x[c] for c in kept])))
    np.fill_diagonal(corr, 0)
    assert 50 < len(kept) < len(varied) and (corr <= 0.999 + 1e-6).all()
    # what went repeats another column
    gone = sorted(varied - set(kept))[:40]
    left = np.array([x[c] for c in sorted(varied)])
    for c in gone:
        with np.errstate(invalid="ignore"):
            near = np.abs(np.corrcoef(x[c], left)[0, 1:])
        assert (near > 0.999 - 1e-6).sum() > 1 or np.abs(x[c]).max() > 1e6
