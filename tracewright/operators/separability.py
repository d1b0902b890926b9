"""How far apart classes lie: low-rank density, AUC by class, energy distance, coupling of two vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.gram import products_of
from tracewright.operators.selection import _running

# The band of AUC in which a class is neither trivial nor hidden.
BAND = (0.75, 0.92)


def density_nll(frame: DataFrame, vector: str, normal: Column, rank: int = 8, eps: float = 1e-6) -> DataFrame:
    """Rows with ``nll`` under a low-rank Gaussian that is fitted on the normal rows.

    Squares along the principal axes are divided by their variances, the rest by the mean
    variance of the other axes. Constant terms are left out. A null vector gives null.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = F.col(vector).isNotNull()
    rows = frame.filter(known).withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(rows.filter(normal))
    variances = scaler.std.toArray() ** 2
    centred = scaler.transform(rows)
    model = PCA(k=min(rank, len(variances)), inputCol="__c", outputCol="__p").fit(centred.filter(normal))
    spectrum = np.maximum(model.explainedVariance.toArray() * variances.sum(), eps)
    rest = len(variances) - len(spectrum)
    floor = max((variances.sum() - spectrum.sum()) / rest, eps) if rest else eps
    scale = F.array(*[F.lit(float(s)) for s in spectrum])  # a number for each axis
    p, c = vector_to_array(F.col("__p")), vector_to_array(F.col("__c"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    off = F.greatest(total(F.transform(c, lambda x: x * x)) - total(F.transform(p, lambda x: x * x)), F.lit(0.0))
    scored = model.transform(centred).withColumn("nll", 0.5 * (total(F.zip_with(p, scale, lambda x, s: x * x / s)) + off / floor))
    return scored.drop("__v", "__c", "__p").unionByName(frame.filter(~known).withColumn("nll", F.lit(None).cast("double")))


def auc_by_class(frame: DataFrame, score: str, label: str, normal) -> DataFrame:
    """label, n, auc of each class against the normal one; ties count half. Rows without a score or label are left out.

    Normal rows below each distinct score are counted once, for all classes together.
    """
    counts = frame.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    values = counts.groupBy("s").agg(F.coalesce(F.sum(F.when(F.col("label") == normal, F.col("n"))), F.lit(0)).alias("n0"))
    placed = _running(values, [F.col("s")], F.col("n0"), "below")
    total = values.agg(F.sum("n0").alias("all"))
    wins = counts.filter(F.col("label") != normal).join(placed, "s").groupBy("label").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("below") + F.col("n0") / 2)).alias("wins")
    )
    return wins.crossJoin(F.broadcast(total)).select("label", "n", F.try_divide("wins", F.col("n").cast("double") * F.col("all")).alias("auc"))


def gate(report: DataFrame, low: float = BAND[0], high: float = BAND[1]) -> DataFrame:
    return report.withColumn("in_band", F.col("auc").between(low, high))


def energy_distance(frame: DataFrame, score: str, label: str) -> DataFrame:
    """Energy distance of a score between rows of label 1 and rows of label 0; one row.

    All pairs count, yet none is formed: in the sum of distances a value stands once with plus for
    each smaller partner and with minus for each greater one, so counts below suffice.
    """
    per = frame.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    placed = _running(_running(per, [F.col("s")], F.col("p"), "pb"), [F.col("s")], F.col("n"), "nb")
    total = per.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    rows = placed.crossJoin(F.broadcast(total))
    p_side, n_side = (2 * F.col("pb") + F.col("p") - F.col("ps")), (2 * F.col("nb") + F.col("n") - F.col("ns"))  # below less above
    cross = F.sum(F.col("s") * (F.col("p") * n_side + F.col("n") * p_side))
    own_p, own_n = 2 * F.sum(F.col("s") * F.col("p") * p_side), 2 * F.sum(F.col("s") * F.col("n") * n_side)
    ps, ns = F.first("ps").cast("double"), F.first("ns").cast("double")
    return rows.agg((2 * F.try_divide(cross, ps * ns) - F.try_divide(own_p, ps * ps) - F.try_divide(own_n, ns * ns)).alias("energy"))


def coupling(frame: DataFrame, a: str, b: str, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Ridge weights from vector a to vector b, and the covariance of what they leave.

    Tasks sum up products of coordinates and send a matrix each, as wide as both vectors.
    """

    both = frame.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    gram = products_of(both, [a, b])
    n, d = gram[0, 0], len(both.select(a).first()[0])
    aa, ab, bb = gram[1 : d + 1, 1 : d + 1], gram[1 : d + 1, d + 1 :], gram[d + 1 :, d + 1 :]
    weight = np.linalg.solve(aa + ridge * np.eye(d), ab)
    left = bb - weight.T @ ab - ab.T @ weight + weight.T @ aa @ weight
    mean = (gram[0, d + 1 :] - gram[0, 1 : d + 1] @ weight) / n
    return weight, (left - n * np.outer(mean, mean)) / max(n - 1, 1) + ridge * np.eye(len(mean))


def inflated(frame: DataFrame, a: str, b: str, weight: np.ndarray, covariance: np.ndarray, tau: Column) -> DataFrame:
    """Rows whose b departs from what a predicts by exactly tau, in the direction it had; a null vector stays."""
    precision = np.linalg.inv(covariance)

    @F.pandas_udf("array<double>")
    def moved(xs: pd.Series, ys: pd.Series, taus: pd.Series) -> pd.Series:
        out = []
        for x, y, t in zip(xs, ys, taus, strict=True):
            if x is None or y is None:
                out.append(y)
                continue
            at = np.asarray(x) @ weight
            gap = np.asarray(y) - at
            out.append(at + gap * (t / np.sqrt(max(gap @ precision @ gap, 1e-12))))
        return pd.Series(out)

    return frame.withColumn(b, moved(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), tau.cast("double")))
