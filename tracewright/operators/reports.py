"""Tables behind reports, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def long(frame: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "score") -> DataFrame:
    """One row for each listed column; numbers as double, null kept."""
    typed = frame.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return typed.unpivot(ids, values, name, value)


def losses(history: DataFrame, branch: Column | str = "branch", epoch: str = "epoch") -> DataFrame:
    """epoch, branch, split, loss from columns train and val."""
    return long(history.withColumnsRenamed({branch: "branch", epoch: "epoch"}), ["epoch", "branch"], ["train", "val"], "split", "loss")


def errors(frame: DataFrame, error: str, label: str) -> DataFrame:
    return frame.select(F.col(error).cast("double").alias("error"), F.when(F.col(label) == 1, "anomaly").otherwise("normal").alias("label"))


def confusion_long(counts: DataFrame) -> DataFrame:
    """actual, predicted, count from tp, fp, fn, tn."""
    cells = [("anomaly", "anomaly", "tp"), ("anomaly", "normal", "fn"), ("normal", "anomaly", "fp"), ("normal", "normal", "tn")]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).cast("long").alias("count")) for a, p, c in cells]))
    return counts.select(rows.alias("x")).select("x.*")


def sweep_long(sweep: DataFrame, metrics: list[str]) -> DataFrame:
    return long(sweep, ["threshold"], metrics)


def roc_points(sweep: DataFrame) -> DataFrame:
    return sweep.select((1 - F.col("specificity")).alias("fpr"), F.col("recall").alias("tpr"))


def mapping(frame: DataFrame, column: str) -> DataFrame:
    """key and value of each entry of a map."""
    return frame.select(F.explode(column).alias("key", "value"))


def grouped(samples: dict[str, DataFrame], column: str) -> DataFrame:
    """value and group from a column of several frames."""
    parts = [f.select(F.col(column).cast("double").alias("value"), F.lit(g).alias("group")) for g, f in samples.items()]
    return reduce(DataFrame.unionByName, parts)


def policy_values(policy) -> list[tuple[str, float]]:
    """Numbers of a policy by name; those of a tuple are numbered."""
    from dataclasses import asdict

    out = []
    for name, value in asdict(policy).items():
        out += [(f"{name}_{i}", float(v)) for i, v in enumerate(value)] if isinstance(value, tuple | list) else [(name, float(value))]
    return out


def policy_table(spark: SparkSession, policy) -> DataFrame:
    """parameter, value: one row for each number of a policy."""
    return spark.createDataFrame(policy_values(policy), "parameter string, value double")


def counts_table(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows."""
    out = None
    for name, frame in tables.items():
        one = frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


#: What the scores are made of, for readers of a report.
FORMULAS = (
    ("volume_score", "1 / (1 + exp(-steepness * (log10(eff_traces + 1) - log10(volume_target))))"),
    ("quality_score", "weighted sum of validity, presence and retention"),
    ("accel_score", "weighted sum of logistic(trend_gain * trend), stability and 1 - exp(-rate / rate_target)"),
    ("readiness", "weighted sum of volume_score, quality_score and accel_score"),
)


def formula_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMULAS), "score string, formula string")


def collected(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, metric, value: the one-row metric tables of several stages, one below the other."""
    out = None
    for name, frame in stages.items():
        numbers = [c for c, t in frame.dtypes if t in ("int", "bigint", "float", "double")]
        one = frame.select(F.inline(F.array(*[F.struct(F.lit(name).alias("stage"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])))
        out = one if out is None else out.unionByName(one)
    return out


def runs_table(spark: SparkSession, runs: list[tuple[dict, float]], metric: str) -> DataFrame:
    """run, parameters (as JSON), metric, best: a row for each run of an experiment."""
    import json

    best = max(range(len(runs)), key=lambda i: runs[i][1]) if runs else None  # the first on ties
    rows = [(i, json.dumps(p, sort_keys=True), float(v), i == best) for i, (p, v) in enumerate(runs)]
    return spark.createDataFrame(rows, f"run int, parameters string, {metric} double, best boolean")
