"""Classifying anomalies: features of a class, base learners, out-of-fold stacking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import u01
from tracewright.operators.scoring import EPS
from tracewright.operators.selection import _running, cut


def class_features(latents: list[Column], signals: list[Column], errors: dict[str, tuple[float, float]], comb: Column, threshold: float, params: list[float]) -> Column:
    """One array: latents, signals, robust z of each error (column: median, mad), margin to the threshold, parameters."""
    z = [(F.col(e) - m) / (1.4826 * mad + EPS) for e, (m, mad) in errors.items()]
    lone = F.array(*[c.cast("double") for c in (*signals, *z, comb - threshold)], *[F.lit(float(p)) for p in params])
    return F.concat(*[c.cast("array<double>") for c in latents], lone)


def encoded(label: Column, names: list[str]) -> Column:
    """Place of a class among names; 0 for an unknown one or null."""
    return F.coalesce(F.greatest(F.array_position(F.array(*[F.lit(n) for n in names]), label) - 1, F.lit(0)), F.lit(0)).cast("int")


def pool(frames: list[DataFrame], label: str, kinds: list[str]) -> DataFrame:
    """Rows of the listed kinds from all splits, which may lack columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.filter(F.col(label).isin(kinds))


def balanced_folds(frame: DataFrame, key: str, k: int = 5, salt: str = "fold") -> DataFrame:
    """Rows with ``fold``: place in a hashed order of the keys, modulo k, so folds differ by one row at most."""
    hashed = frame.withColumn("__u", u01(F.col(key).cast("string"), salt))
    placed = _running(hashed, [F.col("__u"), F.col(key)], F.lit(1), "__pos")
    return placed.withColumn("fold", F.pmod("__pos", F.lit(k)).cast("int")).drop("__u", "__pos")


def learner(kind: str, width: int, classes: int):
    """An unfitted learner by name; vectors stand in ``__x``, labels in ``__y``."""
    from pyspark.ml import classification as C

    columns = {"featuresCol": "__x", "labelCol": "__y"}
    if kind == "logreg":
        return C.LogisticRegression(regParam=1e-3, maxIter=50, **columns)
    if kind == "svm":
        return C.OneVsRest(classifier=C.LinearSVC(regParam=1e-3, maxIter=50, **columns), rawPredictionCol="rawPrediction", **columns)
    if kind == "mlp":
        return C.MultilayerPerceptronClassifier(layers=[width, 32, classes], seed=1, maxIter=100, **columns)
    if kind == "forest":
        return C.RandomForestClassifier(numTrees=20, maxDepth=6, seed=1, **columns)
    if kind == "boosting":
        return C.OneVsRest(classifier=C.GBTClassifier(maxIter=10, maxDepth=3, seed=1, **columns), rawPredictionCol="rawPrediction", **columns)
    raise ValueError(f"no learner named {kind}")


def _scores(model, rows: DataFrame, name: str) -> DataFrame:
    """Rows with an array of a score for each class: probabilities, or raw scores where a model has no other."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(*rows.columns, vector_to_array(F.col(column)).alias(name))


#: Learners whose scores are margins.
MARGINS = ("svm", "boosting")
#: Bins of scores from which a calibration is made.
BINS = 256


@dataclass(frozen=True)
class Calibration:
    """Probabilities at scores, linear between them and level beyond; they never fall."""

    scores: list[float]
    probabilities: list[float]

    def __call__(self, score: Column) -> Column:
        if not self.scores:
            return F.lit(0.0)
        table = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(p).alias("p")) for x, p in zip(self.scores, self.probabilities, strict=True)])  # BINS at most
        at = F.aggregate(table, F.lit(0), lambda n, t: n + (t["x"] <= score).cast("int"))
        low, high = F.get(table, F.greatest(at - 1, F.lit(0))), F.get(table, F.least(at, F.lit(len(self.scores) - 1)))
        share = F.coalesce(F.try_divide(score - low["x"], high["x"] - low["x"]), F.lit(0.0))
        return low["p"] + (high["p"] - low["p"]) * F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))


def fit_calibration(frame: DataFrame, score: Column, positive: Column, bins: int = BINS) -> Calibration:
    """Isotonic regression of a 0/1 label on a score, from the sums of bins of equal width.

    Neighbouring bins are pooled while their shares fall; only a row for each bin reaches the driver.
    """
    rows = frame.select(score.cast("double").alias("s"), positive.cast("double").alias("y")).dropna()
    low, high = rows.agg(F.min("s"), F.max("s")).first()
    if low is None:
        return Calibration([], [])
    place = F.least(F.floor((F.col("s") - low) / max((high - low) / bins, 1e-300)), F.lit(bins - 1))
    sums = rows.groupBy(place.alias("b")).agg(F.sum("s").alias("s"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("b").collect()
    pools: list[list[float]] = []  # sum of scores, of labels, count
    for r in sums:
        pools.append([r["s"], r["y"], r["n"]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return Calibration([s / n for s, _, n in pools], [y / n for _, y, n in pools])


def _calibrated(scores: Column, calibrations: list[Calibration] | None) -> Column:
    """Probabilities of the classes from their scores, which sum to one; equal ones where all are 0."""
    if calibrations is None:
        return scores
    each = F.array(*[c(scores[i]) for i, c in enumerate(calibrations)])
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.transform(each, lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(calibrations)))


@dataclass
class Stack:
    """Base models fitted on all rows, calibrations of margins and a meta model fitted on out-of-fold probabilities."""

    kinds: list[str]
    models: list
    meta: object
    names: list[str]
    calibrations: list[list[Calibration] | None]

    def classify(self, frame: DataFrame, features: str) -> DataFrame:
        """``frame`` with predicted_class and class_probability; an empty frame gives them empty."""
        from pyspark.ml.functions import array_to_vector

        rows = frame.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
        rows = _meta(_base(rows, self.models), self.calibrations)
        out = _scores(self.meta, rows.withColumn("__x", F.col("__meta")), "__p")
        best = F.array_max("__p")
        named = F.element_at(F.array(*[F.lit(n) for n in self.names]), F.array_position("__p", best).cast("int"))
        return out.select(*frame.columns, named.alias("predicted_class"), best.alias("class_probability"))


def _base(rows: DataFrame, models: list) -> DataFrame:
    """Rows with the scores of each model; models run one after the other over the rows, so no join is needed."""
    for i, model in enumerate(models):
        rows = _scores(model, rows, f"__s_{i}")
    return rows


def _meta(rows: DataFrame, calibrations: list[list[Calibration] | None]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    columns = [f"__s_{i}" for i in range(len(calibrations))]
    return rows.withColumn("__meta", array_to_vector(F.concat(*[_calibrated(F.col(c), k) for c, k in zip(columns, calibrations, strict=True)]))).drop(*columns)


def fit_stack(frame: DataFrame, features: str, label: str, key: str, names: list[str], kinds=("logreg", "forest"), k: int = 5, meta: str = "logreg") -> Stack:
    """Stacking: each row's meta features come from base models that never saw its fold.

    The margins of such models become probabilities by isotonic regression on the rows that the models never saw. The meta
    learner is one with probabilities of its own.
    """
    from pyspark.ml.functions import array_to_vector

    slim = frame.filter(F.col(features).isNotNull()).select(key, features, label)
    folded = balanced_folds(slim, key, k).select(
        "fold", array_to_vector(F.col(features).cast("array<double>")).alias("__x"), encoded(F.col(label).cast("string"), names).cast("double").alias("__y")
    )
    rows = cut(folded)
    width = len(slim.first()[features])
    fit = lambda kind, part: learner(kind, width, len(names)).fit(part)
    apart = None
    for f in range(k):
        inside, outside = rows.filter(F.col("fold") == f), rows.filter(F.col("fold") != f)
        one = _base(inside, [fit(kind, outside) for kind in kinds]).drop("__x", "fold")
        apart = one if apart is None else apart.unionByName(one)
    apart = cut(apart)
    of_class = lambda i, c: fit_calibration(apart, F.col(f"__s_{i}")[c], F.col("__y") == c)
    calibrations = [[of_class(i, c) for c in range(len(names))] if kind in MARGINS else None for i, kind in enumerate(kinds)]
    top = learner(meta, len(kinds) * len(names), len(names)).fit(_meta(apart, calibrations).select(F.col("__meta").alias("__x"), "__y"))
    return Stack(list(kinds), [fit(kind, rows) for kind in kinds], top, list(names), calibrations)
