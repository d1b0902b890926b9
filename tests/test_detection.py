"""Detection and augmentation against brute force, and their edges."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import augment, detect, prep, ranks, reports, scoring, selection
from tracewright.sources import conform


@pytest.fixture(scope="module")
def traces(spark):
    rng = np.random.default_rng(3)
    plane, rows = rng.normal(size=(2, 5)), []
    for i in range(200):
        odd = i % 5 == 0
        steps = rng.normal(size=(int(rng.integers(1, 6)), 2)) @ plane + rng.normal(scale=0.05, size=(1, 5))
        steps = steps + (rng.normal(scale=3, size=5) if odd else 0)
        rows.append((f"t{i}", steps.tolist(), steps[:, :3].tolist(), odd))
    return spark.createDataFrame(rows, "trace_id string, epi_sequence array<array<double>>, sem_sequence array<array<double>>, is_anomaly boolean")


def test_detector_scores_equal_numpy(spark, traces):
    fitted = detect.fit(traces, traces, k=(2, 1, 2))
    assert detect.Detector.loads(fitted.dumps()) == fitted
    rows = {r.trace_id: r for r in detect.score(traces, fitted).collect()}
    for r in traces.limit(20).collect():
        errors, latents = [], []
        for model, steps in ((fitted.epi, r.epi_sequence), (fitted.sem, r.sem_sequence)):
            x = np.array(steps) - model.mean
            at = x @ np.array(model.axes).T
            errors.append(((x - at @ np.array(model.axes)) ** 2).sum() / len(x))
            latents.append(at.mean(axis=0))
        z = (np.concatenate(latents) - fitted.latent_mean) / fitted.latent_std
        x = z - fitted.fusion.mean
        axes = np.array(fitted.fusion.axes)
        got = rows[r.trace_id]
        assert np.allclose([got.detector_e_epi, got.detector_e_sem], errors, atol=1e-6) and np.allclose([*got.detector_z_epi, *got.detector_z_sem], z)
        assert np.isclose(got.detector_reconstruction_error, ((x - x @ axes.T @ axes) ** 2).mean()) and got.detector_is_anomaly == (got.detector_reconstruction_error > fitted.threshold)
        assert got.detector_confidence >= 0.5 and np.isclose(got.detector_confidence, max(got.detector_p_anomaly, 1 - got.detector_p_anomaly))
    found = detect.detect(traces, fitted)
    right = found.filter("is_anomaly").count()
    assert right >= 30 and found.count() - right <= 20 and "epi_sequence" not in found.columns
    odd = spark.createDataFrame([("a", None, [[1.0, 2.0, 3.0]], 7), ("b", [], [], 7), ("c", [[None, 1.0, 1.0, 1.0, 1.0]], [[0.0, 0.0, 0.0]], 7)], "trace_id string, epi_sequence array<array<double>>, sem_sequence array<array<double>>, epi int")
    scored = {r.trace_id: r for r in detect.score(odd, fitted).collect()}
    assert scored["a"].detector_e_epi is None and scored["b"].detector_is_anomaly is None and scored["c"].detector_e_epi is not None and scored["a"].epi == 7
    assert detect.detect(traces.limit(0), fitted).count() == 0


def test_huber_and_longer_sequences(spark, traces):
    fitted = detect.fit(traces, traces, k=(2, 1, 2), loss="huber", max_len=2)
    row, trace = detect.score(traces, fitted).filter("trace_id = 't5'").first(), traces.filter("trace_id = 't5'").first()
    x = np.array(trace.epi_sequence)[:2] - fitted.epi.mean
    axes = np.array(fitted.epi.axes)
    d = np.abs(x - x @ axes.T @ axes)
    assert np.isclose(row.detector_e_epi, np.where(d <= 1, 0.5 * d**2, d - 0.5).sum() / len(x), atol=1e-6)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k in ("a", None, "c") for v in np.round(rng.normal(size=int(rng.integers(1, 60))), 1)] + [("a", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    levels = [0, 0.01, 0.25, 0.5, 0.9, 1]
    for linear in (True, False):
        for r in ranks.quantiles(frame, ["k"], "v", levels, linear).collect():
            values = sorted(v for k, v in rows if k == r.k and v is not None)
            want = np.quantile(values, levels) if linear else [values[round((len(values) - 1) * q)] for q in levels]
            assert np.allclose(r.quantiles, want) and r.size == len(values)
    assert ranks.median(frame.limit(0), F.col("v")).first()["median"] is None
    assert ranks.quantiles(frame, [], "v", [0.5]).first().quantiles[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_cell_profiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + rng.exponential(size=(400, 3))
    x[:150] = x[0]  # one vector fills a large share of the cell
    frame = spark.createDataFrame([("k", "a", v.tolist()) for v in x] + [("k", "b", [1.0, 2.0, 3.0])] * 5 + [("k", "a", None)], "kind string, agent string, v array<double>")
    profiles = augment.cell_profiles(frame, ["kind", "agent"], "v", rows=90)
    row = profiles.collect()
    cell = augment.Cell.of(row[0])
    assert [(r.kind, r.agent, r.size) for r in row] == [("k", "a", 400)] and np.allclose(cell.grid, np.quantile(x, augment.GRID, axis=0)) and np.allclose(cell.edges, np.quantile(x, [0.005, 0.995], axis=0))
    u = np.quantile(x, 0.95, axis=0)
    over = np.sort(np.clip(x - u, 0, None), axis=0)
    b0, b1 = over.mean(axis=0), (np.arange(400)[:, None] / 399 * over).mean(axis=0)
    assert np.allclose(cell.tail, [u, 2 - b0 / (b0 - 2 * b1), np.maximum(2 * b0 * b1 / (b0 - 2 * b1), 1e-9)])
    corr = np.corrcoef(cell.scores(x), rowvar=False) + 1e-8 * np.eye(3)
    assert np.allclose(cell.axes @ np.diag(cell.values) @ cell.axes.T, corr)
    still = cell.moved(x, np.zeros(len(x)))
    inside = (x > cell.edges[0]) & (x < np.quantile(x, 0.94, axis=0))
    assert np.allclose(still[inside], x[inside], atol=1e-3)
    far = cell.moved(x, np.full(len(x), 3.0))
    assert (far >= cell.edges[0] - 1e-9).all() and (far <= cell.edges[1] + 1e-9).all() and not np.allclose(far, still)
    out = augment.cell_shift(frame, ["kind", "agent"], "v", F.lit(3.0), profiles).collect()
    assert np.allclose(sorted(r.v for r in out if r.agent == "a" and r.v is not None), sorted(far.tolist())) and len(out) == 406 and [r.v for r in out if r.agent == "b"][0] == [1.0, 2.0, 3.0]


def test_manifold_and_directions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 6)) + rng.normal(scale=0.1, size=(300, 6)) + 4
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    m = augment.fit_manifold(frame, "v", 2)
    centred = x - x.mean(axis=0)
    basis = np.linalg.svd(centred, full_matrices=False)[2][:2]
    rest = centred - centred @ basis.T @ basis
    assert np.allclose(m.mean, x.mean(axis=0)) and np.isclose(m.scale, np.sqrt((rest**2).sum(axis=1).mean() / 6))
    off = np.array(m.off([1.0, 0, 0, 0, 0, 0]))
    assert np.isclose(np.linalg.norm(off), 1) and np.allclose(basis @ off, 0, atol=1e-8)


def test_classes_applied(spark):
    """Victims in scope move, bystanders and normal spans stay, drift grows with the step, compound classes do both."""
    rng = np.random.default_rng(7)
    rows = [(f"t{i // 6}", f"s{i}", i, ("llm", "tool", "other")[i % 3], "a", rng.normal(size=4).tolist(), rng.normal(size=3).tolist(), f"text of {i}") for i in range(3000)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, start_time_ns long, aef_kind string, agent_id string, epi_vector array<double>, sem_vector array<double>, output_text string")
    tagged = selection.cut(augment.roles(spans, [("dpi", "mp")], 0.2))
    normal = tagged.filter("class = 0")
    manifold = augment.fit_manifold(normal, "sem_vector", 1)
    out = augment.apply_classes(tagged, augment.cell_profiles(normal, ["aef_kind", "agent_id"], "epi_vector"), manifold, {"dpi": [0.0, 1.0, 0.0]})
    before = {r[1]: r for r in rows}
    kinds = set()
    for r in out.collect():
        epi, sem = (not np.allclose(a, b) for a, b in ((r.epi_vector, before[r.span_id][5]), (r.sem_vector, before[r.span_id][6])))
        names = [] if r.anomaly_type == "NonAnomaly" else r.anomaly_type.split("+")
        touch = [o for o in augment.OPERATORS if o.name in names and (o.scope == "session" or r.aef_kind in o.kinds)]
        kinds.add(r.anomaly_type)
        assert epi <= bool(touch) and (epi or not any(o.epi for o in touch))
        assert sem == any(o.sem and not (o.geometry == "drift" and r.step == 0) for o in touch), r
        assert r.anomaly_role == ("none" if not names else "member")
    assert "dpi+mp" in kinds and len(kinds) >= 6 and out.count() == 3000
    dpi = [r for r in out.filter("anomaly_type = 'dpi' and aef_kind = 'llm'").collect()]
    tau = 0.5 + 3.5 * np.mean([r.anomaly_severity for r in dpi])
    assert np.allclose([np.array(r.sem_vector) - before[r.span_id][6] for r in dpi], tau * manifold.scale * np.array(manifold.off([0.0, 1.0, 0.0])))
    embed = lambda c: prep.hashed_embedding(c, 3)
    noisy = augment.noisy_texts(tagged.filter("class = 1"), embed).collect()
    assert len(noisy) == tagged.filter("class = 1").count() and all((r.output_text == before[r.span_id][7]) or r.aef_kind == "llm" for r in noisy)
    assert np.isclose(np.linalg.norm(augment.anchor_direction(spark, ["one text", "another"], embed)), 1)


def test_vectors_of_training_and_inference(spark):
    rows = [(f"t{i % 9}", "a", i, f"s{i}", float(i), float(2 * i), 1.0, None if i % 2 else 3.0, 1e9 * (i % 7), "some text") for i in range(90)]
    frame = spark.createDataFrame(rows, "trace_id string, agent_id string, start_time_ns long, span_id string, x double, twice double, same double, half double, big double, sem_text string")
    fitted = prep.fit_vectors(frame, ["x", "twice", "same", "half", "big"])
    assert fitted["columns"] == ["half", "twice"] and json.loads(json.dumps(fitted)) == fitted
    out = prep.inference_traces(frame.withColumn("is_anomaly", F.lit(True)), fitted, lambda c: prep.hashed_embedding(c, 4))
    assert out.columns == ["trace_id", "agent_id", "epi_sequence", "sem_sequence"] and out.count() == 9 and len(out.first().epi_sequence) == 10
    stats = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 1.0)], "dim int, shift double, scale double")
    moved = prep.normalised_sequences(out, "epi_sequence", stats).filter("trace_id = 't1'").first().epi_sequence
    assert moved[0] == [(0.0 - 1) / 2 if 1 % 2 else 1.0, 2.0 if "twice" in fitted["columns"] else 1.0]
    embed = prep.embedder(lambda texts: [[len(t), 1] for t in texts], 2)
    assert frame.limit(1).select(embed("sem_text").alias("v")).first().v == [9.0, 1.0]
    assert prep.numeric_columns(frame, ("x",)) == ["start_time_ns", "twice", "same", "half", "big"] and "big" not in prep.without(frame, "^b").columns


def test_files_of_splits_parameters_and_records(spark, tmp_path):
    frame = spark.range(30).select("id", (F.col("id") * 2).alias("v"), F.when(F.col("id") < 20, "train").otherwise("test").alias("split"))
    conform.write_splits(frame, f"{tmp_path}/splits")
    assert conform.read_split(spark, f"{tmp_path}/splits", "test", ["id"]).count() == 10
    detect.write_parameters(spark, "a", '{"x": 1}', f"{tmp_path}/parameters")
    detect.write_parameters(spark, "b", '{"x": 2}', f"{tmp_path}/parameters")
    assert detect.read_parameters(spark, f"{tmp_path}/parameters", "b") == '{"x": 2}'
    with pytest.raises(KeyError):
        detect.read_parameters(spark, f"{tmp_path}/parameters", "c")
    found = spark.createDataFrame([("t1", 0.876, "dpi"), ("t2", 0.5, None)], "trace_id string, detector_confidence double, anomaly_type string")
    bounds = spark.createDataFrame([("t1", 1_700_000_000_123_456_789, 1_700_000_001_000_000_000)], "trace_id string, start_ns long, end_ns long")
    detect.write_records(detect.enrich(found, bounds), f"{tmp_path}/records")
    rows = {r["trace_id"]: r for r in map(json.loads, spark.read.text(f"{tmp_path}/records").toPandas()["value"])}
    assert list(rows["t1"]) == list(detect.FIELDS) and rows["t1"]["starttime"] == "2023-11-14T22:13:20Z" and rows["t1"]["confidence"] == 88 and rows["t2"]["starttime"] is None and rows["t1"]["tech_details"] == ""


def test_runs_and_reports(spark):
    runs = [(p, p["a"] * 0.1) for p in scoring.grid(a=[1, 3, 3], b=["x"])]
    assert scoring.pick_best(runs) == ({"a": 3, "b": "x"}, pytest.approx(0.3))
    table = reports.runs_table(spark, runs, "f1").collect()
    assert [r.best for r in table] == [False, True, False] and json.loads(table[0].parameters) == {"a": 1, "b": "x"}
    both = reports.collected({"s2": spark.range(1).select(F.lit(0.5).alias("f1")), "s3": spark.range(1).select(F.lit(2).alias("n"))}).collect()
    assert [(r.stage, r.metric, r.value) for r in both] == [("s2", "f1", 0.5), ("s3", "n", 2.0)] and reports.formula_table(spark).count() == 4
    assert selection.mode_of(False, True) == "strict" and selection.mode_of(True, False) == "loose" and selection.mode_of(False, False) == "open"
    assert selection.piped(spark.range(5), lambda f: f.filter("id > 1"), lambda f: f.limit(2)).count() == 2


def test_correlation_of_large_values(spark):
    from tracewright.functions.stats import correlation

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=200), rng.normal(size=200)
    frame = spark.createDataFrame([(float(1.7e9 + a), float(1e9 + a + b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    assert frame.agg(correlation(F.col("x"), F.col("y")).alias("c")).first().c == pytest.approx(np.corrcoef(x, x + y)[0, 1], abs=1e-4)


def test_labels_as_specified(spark):
    rows = [("true", "unknown", None), ("unknown", "dpi", None), ("true", None, True), ("false", None, False), (None, "dpi", True), (None, "NonAnomaly", False), (None, None, None), ("true", "NonAnomaly", False), ("false", "dpi", True), (None, "unknown", None)]
    frame = spark.createDataFrame(rows, "c string, t string, want boolean")
    assert all(r.got == r.want for r in frame.select("want", conform.is_anomaly(F.col("c"), F.col("t")).alias("got")).collect())


def test_reconstruction_equals_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6)) + rng.normal(scale=0.3, size=(80, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "i int, v array<double>")
    rows = {r.i: r.error for r in scoring.reconstruction_error(frame, "v", 2).collect()}
    c = x - x.mean(axis=0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose([rows[i] for i in range(80)], ((c - c @ axes.T @ axes) ** 2).sum(axis=1)) and rows[99] is None


def test_weights_need_two_classes(spark):
    rng = np.random.default_rng(10)
    y = rng.integers(0, 2, 300)
    frame = spark.createDataFrame([(float(a + 2 * k), float(b), int(k)) for a, b, k in zip(rng.normal(size=300), rng.normal(size=300), y, strict=True)], "a double, b double, y int")
    weights, _ = scoring.fit_weights(frame, ["a", "b"], "y")
    assert weights[0] > 1 > abs(weights[1]) and scoring.fit_weights(frame.filter("y = 1"), ["a", "b"], "y") == ([0.2, 0.2], 0.0)


def test_sources_are_read_as_specified(spark, tmp_path):
    from tracewright.operators import quality, readiness
    from tracewright.sources import fixture, spec

    raw = fixture.raw_spans(spark, "/root/testdata/sf0.001")
    raw.write.parquet(f"{tmp_path}/raw")
    assert conform.scan(spark, f"{tmp_path}/raw").columns == [a.name for a in spec.SPEC] == conform.strict_scan(spark, f"{tmp_path}/raw").columns
    raw.drop("meta_tags").withColumn("odd", F.lit(1)).write.parquet(f"{tmp_path}/odd")
    with pytest.raises(ValueError, match="meta_tags.*odd"):
        conform.strict_scan(spark, f"{tmp_path}/odd")
    lenient = conform.lenient(spark.createDataFrame([("x", "9"), (None, "y")], "llm_total_tokens string, http_status_code string")).collect()
    assert [(r.llm_total_tokens, r.http_status_code) for r in lenient] == [(-1, 9), (-1, -1)]
    raw.withColumn("class", F.lit("true")).withColumn("x-UNAVAIL", F.lit(1)).write.parquet(f"{tmp_path}/labelled")
    loaded = conform.load_labelled(spark, f"{tmp_path}/labelled", f"{tmp_path}/labelled", spec=spec.SPEC)
    assert loaded.count() == 2 * raw.count() and "x-UNAVAIL" not in loaded.columns and loaded.filter("is_anomaly is not null or anomaly_type <> 'unknown'").isEmpty()
    table = spec.spec_table(spark).collect()
    assert len(table) == 46 and sum(r.mandatory for r in table) == 13
    assert not quality.is_valid(raw) and quality.is_valid(raw, max_nulls=10**6, max_rules=10**6, max_dups=10**6, max_breaks=10**6)
    product = spark.range(1).select(readiness.multiplied((0.5, 0.5), F.lit(0.25), F.lit(1.0)).alias("p")).first().p
    assert product == pytest.approx(0.5) and selection.select_traces(conform.recast(raw), holdout_method="random", holdout_percent=50).filter("holdout").count() > 0


def test_many_cells_take_the_same_reads(spark):
    """Hundreds of cells at once, a part of each in its own task, equal numpy cell by cell."""
    rng = np.random.default_rng(11)
    x = rng.gamma(2, size=(300, 70, 4)) @ rng.normal(size=(4, 4))
    rows = [(f"k{i % 20}", None if i < 3 else f"a{i // 20}", v.tolist(), f"r{i}-{j}") for i, cell in enumerate(x) for j, v in enumerate(cell)]
    frame = spark.createDataFrame(rows, "kind string, agent string, v array<double>, id string")
    table = augment.cell_profiles(frame, ["kind", "agent"], "v", rows=30)
    cells = {(r.kind, r.agent): augment.Cell.of(r) for r in table.collect()}
    assert len(cells) == 300
    for i in (0, 1, 2, 57, 299):
        cell = cells[f"k{i % 20}", None if i < 3 else f"a{i // 20}"]
        assert np.allclose(cell.grid, np.quantile(x[i], augment.GRID, axis=0))
        assert np.allclose(cell.axes @ np.diag(cell.values) @ cell.axes.T, np.corrcoef(cell.scores(x[i]), rowvar=False) + 1e-8 * np.eye(4))
    moved = {r.id: r.v for r in augment.cell_shift(frame, ["kind", "agent"], "v", F.lit(1.0), table).collect()}
    assert len(moved) == len(rows)
    for i in (1, 120):
        cell = cells[f"k{i % 20}", None if i < 3 else f"a{i // 20}"]
        assert np.allclose([moved[f"r{i}-{j}"] for j in range(70)], cell.moved(x[i], np.ones(70)))


def test_normal_scores_are_exact():
    p = np.array([1e-6, 0.01, 0.5, 0.975, 1 - 1e-6])
    assert np.allclose(augment.normal_quantile(p), [-4.753424308822899, -2.3263478740408408, 0, 1.959963984540054, 4.753424308817087]) and np.allclose(augment.normal_cdf(augment.normal_quantile(p)), p, rtol=1e-12)


def test_sought_ranks_equal_all_ranks(spark):
    """Only buckets with a sought place are ranked, whatever the spread, ties, infinite values, NaN and empty groups."""
    rng = np.random.default_rng(12)
    inf, nan = float("inf"), float("nan")
    rows = [("wide", float(v)) for v in 10.0 ** rng.uniform(-5, 18, 300)] + [("tied", float(v)) for v in rng.integers(0, 4, 200)] + [("one", 3.0)] * 50
    rows += [(None, v) for v in [inf, -inf, nan, 1.0, 2.0, nan, 5.0]] + [("none", None)] * 3 + [("odd", nan)] * 4
    frame = spark.createDataFrame(rows, "k string, v double")
    levels = [0, 0.013, 0.25, 0.5, 0.77, 1]
    key = lambda r: (r.k or "~", r.size)
    for linear in (True, False):
        every = sorted(ranks.of_ranks(ranks.ranked(frame, ["k"], "v"), ["k"], "v", levels, linear).collect(), key=key)
        for buckets in (1, 3, 512):
            few = ranks.of_ranks(ranks.sought(frame, ["k"], "v", levels, linear, buckets), ["k"], "v", levels, linear)
            assert str(sorted(few.collect(), key=key)) == str(every)
    assert ranks.sought(frame.filter("k = 'wide'"), ["k"], "v", [0.5], True).count() < 200
