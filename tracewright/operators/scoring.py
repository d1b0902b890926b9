"""Anomaly scores: thresholds, calibration, confidence, metrics, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.stats import logistic
from tracewright.operators import ranks
from tracewright.operators.selection import cut

EPS = 1e-8


def confusion(truth: Column, predicted: Column) -> list[Column]:
    names = (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
    return [F.count_if((truth == t) & (predicted == p)).alias(k) for k, t, p in names]


def metrics(frame: DataFrame, eps: float = EPS) -> DataFrame:
    """Binary metrics from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = tp / (tp + fp + eps), tp / (tp + fn + eps), tn / (tn + fp + eps)
    return frame.select(
        "*", ((tp + tn) / (tp + fp + fn + tn + eps)).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"),
        (2 * precision * recall / (precision + recall + eps)).alias("f1"), (recall + specificity - 1).alias("youden"),
    )


def evaluate(frame: DataFrame, truth: str, predicted: str) -> DataFrame:
    return metrics(frame.agg(*confusion(F.col(truth), F.col(predicted))))


def threshold_sweep(frame: DataFrame, error: str, label: str, n: int = 100) -> DataFrame:
    """Metrics at n even thresholds from the least to the greatest error; above is anomalous.

    Errors are counted by the threshold they reach last, so the table is aggregated once
    and only n rows are summed up.
    """
    low, high = frame.agg(F.min(error), F.max(error)).first()
    spark = frame.sparkSession
    if low is None:
        return metrics(spark.createDataFrame([], "i int, threshold double, tp bigint, fp bigint, fn bigint, tn bigint"))
    step = (high - low) / (n - 1) or 1.0
    grid = spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(low) + F.col("id") * F.lit(step)).alias("threshold"))
    above = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil((F.col(error) - low) / step))).cast("int")  # thresholds below the error
    # division may land a value beside its threshold: settle it by comparison
    above = above - ((above > 0) & ~(F.col(error) > low + (above - 1) * step)).cast("int") + ((above < n) & (F.col(error) > low + above * step)).cast("int")
    counts = frame.filter(F.col(error).isNotNull()).groupBy((above - 1).alias("i")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = frame.agg(F.count_if(F.col(label) == 1).alias("ap"), F.count_if(F.col(label) == 0).alias("an"))
    beyond = Window.orderBy("i").rowsBetween(0, Window.unboundedFollowing)  # n rows
    joined = grid.join(counts, "i", "left").select("i", "threshold", F.coalesce(F.sum("p").over(beyond), F.lit(0)).alias("tp"), F.coalesce(F.sum("n").over(beyond), F.lit(0)).alias("fp"))
    return metrics(joined.crossJoin(F.broadcast(total)).select("i", "threshold", "tp", "fp", (F.col("ap") - F.col("tp")).alias("fn"), (F.col("an") - F.col("fp")).alias("tn")))


def select_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    return sweep.orderBy(F.desc(metric), "threshold").limit(1)


def roc_auc(sweep: DataFrame) -> DataFrame:
    """Area under (1 - specificity, recall) by trapezoids over the points of a sweep."""
    points = sweep.select((1 - F.col("specificity")).alias("x"), F.col("recall").alias("y"))
    w = Window.orderBy("x", "y")  # a row for each threshold
    return points.select(((F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2).alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def multiclass(frame: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: precision, recall, f1 and support."""
    pairs = frame.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(True).alias("is_t")), F.struct(F.col("p").alias("c"), F.lit(False).alias("is_t")))).alias("x"), "t", "p", "n")
    out = both.groupBy("x.c").agg(
        F.sum(F.when(F.col("x.is_t") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.is_t"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("x.is_t"), F.col("n")).otherwise(0)).alias("said"),
    )
    precision, recall = F.col("tp") / (F.col("said") + EPS), F.col("tp") / (F.col("support") + EPS)
    return out.select(F.col("c").alias("label"), precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + EPS)).alias("f1"), "support")


def matrix(frame: DataFrame, truth: str, predicted: str, names: list) -> DataFrame:
    """actual, predicted, n of all pairs of the listed classes, zero counts too."""
    spark = frame.sparkSession
    grid = spark.createDataFrame([(a, b) for a in names for b in names], f"actual {frame.schema[truth].dataType.simpleString()}, predicted {frame.schema[predicted].dataType.simpleString()}")
    counts = frame.groupBy(F.col(truth).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def averages(cells: DataFrame, eps: float = EPS) -> DataFrame:
    """Macro and micro averages of the metrics from a matrix of actual, predicted, n: a row for each way."""
    both = cells.select(F.inline(F.array(F.struct(F.col("actual").alias("c"), F.lit(1).alias("side")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("side")))), "n", (F.col("actual") == F.col("predicted")).alias("hit"))
    one = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    per = both.groupBy("c").agg(one((F.col("side") == 1) & F.col("hit")).alias("tp"), one(F.col("side") == 1).alias("support"), one(F.col("side") == 0).alias("said"))
    whole = cells.agg(F.sum("n").alias("total"), one(F.col("actual") == F.col("predicted")).alias("right"))
    counts = per.crossJoin(F.broadcast(whole)).select("c", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), (F.col("total") - F.col("said") - F.col("support") + F.col("tp")).alias("tn"), "total", "right")  # whole is one row
    accuracy = (F.max("right") / (F.max("total") + eps)).alias("accuracy")
    names = ("precision", "recall", "specificity", "f1", "youden")
    macro = metrics(counts.select("tp", "fp", "fn", "tn", "total", "right"), eps).drop("accuracy").agg(accuracy, *[F.avg(c).alias(c) for c in names])
    pooled = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.max("right").alias("right"), F.max("total").alias("total"))
    micro = metrics(pooled, eps).select((F.col("right") / (F.col("total") + eps)).alias("accuracy"), *names)
    return macro.select(F.lit("macro").alias("average"), "*").unionByName(micro.select(F.lit("micro").alias("average"), "*"))


def average_precision(frame: DataFrame, score: str, label: str) -> DataFrame:
    """Mean precision over the recall gained at each distinct score, from counts of scores; never one window over all rows."""
    from tracewright.operators.selection import _running

    per = frame.filter(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label).isin(0, 1)).alias("m"))
    above = _running(per, [F.col("s")], F.col("p"), "p_above")
    placed = _running(above, [F.col("s")], F.col("m"), "m_above")
    precision = (F.col("p_above") + F.col("p")) / (F.col("m_above") + F.col("m"))
    return placed.agg(F.try_divide(F.sum(F.when(F.col("p") > 0, F.col("p") * precision)), F.sum("p")).alias("average_precision"))


def grid(**choices) -> list[dict]:
    """All combinations of the listed values, in their order."""
    from itertools import product

    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def pick_best(runs: list[tuple[dict, float]]) -> tuple[dict, float]:
    """The run of greatest metric, the first on ties."""
    return max(runs, key=lambda r: r[1])


def robust_stats(frame: DataFrame, error: str) -> DataFrame:
    """median and mad, one row."""
    middle = ranks.median(frame, F.col(error))
    apart = frame.crossJoin(F.broadcast(middle)).select(F.abs(F.col(error) - F.col("median")).alias("__d"))  # one row
    return middle.crossJoin(F.broadcast(ranks.median(apart, F.col("__d")).withColumnRenamed("median", "mad")))  # one row each


def temperature(frame: DataFrame, error: str, label: str, mad: float) -> Column:
    """Pooled sigma of the two classes, at least 1.4826 MAD; that alone if a class has fewer than two rows."""
    a, b = (F.var_samp(F.when(F.col(label) == k, F.col(error))) for k in (0, 1))
    floor = F.lit(1.4826 * mad)
    return F.coalesce(F.greatest(F.sqrt((a + b) / 2), floor), floor)


def confidence(e_epi: Column, e_sem: Column, e_comb: Column, epi: tuple, sem: tuple, threshold: float, t: float, weights=(0.2, 0.2, 0.6), bias: float = 0.0) -> dict[str, Column]:
    """z scores, probability, confidence and decision from three errors; epi and sem are (median, mad)."""
    z = [(e - m) / (1.4826 * mad + EPS) for e, (m, mad) in ((e_epi, epi), (e_sem, sem))]
    logits = (z[0] - 2, z[1] - 2, (e_comb - threshold) / (t + EPS))
    p = logistic(sum((w * x for w, x in zip(weights, logits, strict=True)), F.lit(bias)))
    return {"z_epi": z[0], "z_sem": z[1], "p_anomaly": p, "confidence": F.greatest(p, 1 - p), "is_anomaly": e_comb > threshold}


def fit_weights(frame: DataFrame, logits: list[str], label: str) -> tuple[list[float], float]:
    """Class-weighted logistic regression; the priors if there is one class only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r[0]: r[1] for r in frame.groupBy(label).count().collect()}  # two rows
    if len([c for c in (0, 1) if counts.get(c)]) < 2:
        return [0.2, 0.2, 0.6][: len(logits)], 0.0
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    rows = VectorAssembler(inputCols=logits, outputCol="__x").transform(frame).withColumn("__w", weight).withColumn("__y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=0.0).fit(rows)
    return model.coefficients.toArray().tolist(), model.intercept


def reconstruction_error(frame: DataFrame, vector: str, k: int = 8) -> DataFrame:
    """Rows with ``error``: squared distance of the vector from the k principal axes fitted on all rows; null for a null vector."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = F.col(vector).isNotNull()
    rows = frame.filter(known).withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    out = model.transform(centred)
    square = lambda c: F.aggregate(vector_to_array(F.col(c)), F.lit(0.0), lambda a, x: a + x * x)
    scored = out.withColumn("error", F.greatest(square("__c") - square("__p"), F.lit(0.0))).drop("__v", "__c", "__p")
    return scored.unionByName(frame.filter(~known).withColumn("error", F.lit(None).cast("double")))


def folds(key: Column, k: int = 5) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(k))


#: Buckets of keys whose digests are compared, and how many of them make a node of the tree above them.
LEAVES, BRANCH = 4096, 64


def digests(frame: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """node, leaf, n, digest of each bucket of keys, and of each node of buckets (leaf null); sums of row hashes, so order does not matter."""
    columns = sorted(frame.columns)
    leaf = F.pmod(F.xxhash64(*keys), F.lit(leaves))
    rows = frame.select(leaf.alias("leaf"), F.xxhash64(*columns).cast("decimal(38,0)").alias("h"))
    each = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("h").alias("digest")).withColumn("node", F.floor(F.col("leaf") / BRANCH))
    each = cut(each)
    return each.select("node", "leaf", "n", "digest").unionByName(each.groupBy("node").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest")).select("node", F.lit(None).cast("bigint").alias("leaf"), "n", "digest"))


def differing_leaves(a: DataFrame, b: DataFrame) -> list[int]:
    """Buckets whose digests differ, found from the nodes down; at most a row for each bucket reaches the driver."""
    match = F.col("x.node").eqNullSafe(F.col("y.node")) & F.col("x.leaf").eqNullSafe(F.col("y.leaf"))
    apart = ~(F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.digest").eqNullSafe(F.col("y.digest")))
    node, leaf = F.coalesce("x.node", "y.node").alias("node"), F.coalesce("x.leaf", "y.leaf").alias("leaf")
    of = lambda x, y: x.alias("x").join(y.alias("y"), match, "full").filter(apart)
    nodes = [r[0] for r in of(a.filter("leaf is null"), b.filter("leaf is null")).select(node).collect()]
    if not nodes:
        return []
    below = lambda f: f.filter(F.col("leaf").isNotNull() & F.col("node").isin(nodes))
    return sorted(r[0] for r in of(below(a), below(b)).select(leaf).collect())


def differences(a: DataFrame, b: DataFrame, keys: list[str] | None = None, tolerance: float = 1e-5, leaves: int = LEAVES) -> DataFrame:
    """keys, copy, column, a, b: cells that differ, as text; numbers within the tolerance do not, a missing row differs in the column ``__row``.

    Digests of buckets of keys are compared first, so equal tables are not shuffled; only rows of buckets that
    differ meet. Keys are all columns that are not floating numbers, if none are given. Of rows with equal keys
    the first is compared with the first, in the order of all their columns.
    """
    keys = keys or [c for c, t in a.dtypes if t not in ("double", "float") and not t.startswith(("array", "map", "struct"))]
    others = [c for c in a.columns if c not in keys]
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    b = b.select(*a.columns)
    apart = differing_leaves(digests(a, keys, leaves), digests(b, keys, leaves))
    leaf = F.pmod(F.xxhash64(*keys), F.lit(leaves))
    order = Window.partitionBy(*keys).orderBy(*others) if others else Window.partitionBy(*keys).orderBy(*keys)
    numbered = lambda f: f.filter(leaf.isin(apart) if apart else F.lit(False)).withColumn("__copy", F.row_number().over(order)).withColumn("__here", F.lit(True))
    x, y = numbered(a).alias("x"), numbered(b).alias("y")
    match = F.col("x.__copy") == F.col("y.__copy")
    for k in keys:
        match &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    types = dict(a.dtypes)
    both = F.col("x.__here").isNotNull() & F.col("y.__here").isNotNull()

    def cell(c: str) -> Column:
        u, v = F.col(f"x.{c}"), F.col(f"y.{c}")
        same = u.eqNullSafe(v)
        if types[c] in ("double", "float"):
            same |= F.coalesce(F.abs(u - v) <= tolerance, F.lit(False))
        return F.when(both & ~same, F.struct(F.lit(c).alias("column"), u.cast("string").alias("a"), v.cast("string").alias("b")))

    row = F.when(~both, F.struct(F.lit("__row").alias("column"), F.col("x.__here").cast("string").alias("a"), F.col("y.__here").cast("string").alias("b")))
    named = [F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys]
    met = x.join(y, match, "full").select(*named, F.coalesce("x.__copy", "y.__copy").alias("copy"), F.filter(F.array(row, *[cell(c) for c in others]), lambda d: d.isNotNull()).alias("__d"))
    return met.select(*keys, "copy", F.inline("__d"))


def same_to(a: DataFrame, b: DataFrame, places: int = 5) -> bool:
    """Whether two tables agree but for floating numbers less than one in that decimal place apart."""
    return differences(a, b, tolerance=10.0**-places).isEmpty()
