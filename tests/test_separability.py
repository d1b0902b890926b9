"""Operators that SQL can't express, against plain numpy forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import reports, separability, stacking
from tracewright.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet")


def test_density(spark, vectors):
    rows = queries.sep_density(spark, FOLDER).orderBy("vec_id").collect()
    source = vectors.orderBy("vec_id").collect()
    x, label = np.array([r.embedding for r in source], float), np.array([r.label for r in source])
    normal = x[label == 0]
    centred = normal - normal.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    var = np.zeros(x.shape[1])
    var[: len(s)] = s**2 / (len(normal) - 1)
    y = x - normal.mean(0)
    p = y @ vt[:8].T
    expected = 0.5 * ((p**2 / var[:8]).sum(1) + ((y**2).sum(1) - (p**2).sum(1)) / var[8:].mean())
    assert np.allclose([r.nll for r in rows], expected, rtol=1e-5)


def test_coupling(spark, vectors):
    halves = vectors.select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    weight, covariance = separability.coupling(halves, "a", "b")
    rows = halves.orderBy("vec_id").collect()
    a, b = np.array([r.a for r in rows], float), np.array([r.b for r in rows], float)
    expected = np.linalg.solve(a.T @ a + 1e-3 * np.eye(32), a.T @ b)
    assert np.allclose(weight, expected) and np.allclose(covariance, np.cov(b - a @ expected, rowvar=False) + 1e-3 * np.eye(32))
    moved = np.array([r.b for r in separability.inflated(halves, "a", "b", weight, covariance, F.lit(3.0)).orderBy("vec_id").collect()])
    gap = moved - a @ weight
    assert np.allclose(np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(covariance), gap)), 3.0)


def test_stack_on_held_out_rows(vectors):
    # the table's own labels don't follow from its vectors (nearest centroid: 7 of 100 right), so classes are quadrants
    kind = F.concat((F.col("embedding")[0] > 0).cast("string"), (F.col("embedding")[1] > 0).cast("string"))
    rows = vectors.select("vec_id", "embedding", kind.alias("label"))
    names = sorted(r[0] for r in rows.select("label").distinct().collect())
    train, test = rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0")
    stack = stacking.fit_stack(train, "embedding", "label", "vec_id", names, k=2)
    found = stack.classify(test, "embedding").collect()
    assert len(found) == test.count() and sum(r.label == r.predicted_class for r in found) > 0.7 * len(found)
    assert all(0 < r.class_probability <= 1 for r in found)
    assert stack.classify(test.limit(0), "embedding").count() == 0


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "s double, label int")
    assert separability.energy_distance(none, "s", "label").first().energy is None
    assert separability.auc_by_class(none, "s", "label", 0).count() == 0
    odd = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert sorted(r[0] for r in odd.select(stacking.encoded(F.col("c"), ["x", "a"])).collect()) == [0, 0, 1]
    history = spark.createDataFrame([(1, "epi", 0.5, None)], "epoch int, branch string, train double, val double")
    assert {(r.split, r.loss) for r in reports.losses(history).collect()} == {("train", 0.5), ("val", None)}
