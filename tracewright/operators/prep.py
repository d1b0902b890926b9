"""From features to training data: column selection, sequences, splits, normalisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.stats import clip
from tracewright.operators import gram, ranks, scans


def fill_rates(frame: DataFrame, columns: list[str]) -> DataFrame:
    """feature, fill: share of values that are not null."""
    row = frame.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return row.unpivot([], columns, "feature", "fill")


def static_rates(frame: DataFrame, columns: list[str]) -> DataFrame:
    """feature, static: share of the most frequent value, null being a value."""
    long = frame.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("static"))


def useful(frame: DataFrame, columns: list[str], least_fill: float = 0.5, most_static: float = 0.95) -> DataFrame:
    """feature, fill, static of the columns that are filled and varied enough; ``static`` is null where no value fills half of the rows.

    Limits below a half need exact shares of all columns.
    """
    if most_static >= 0.5:
        found = gram.rates(frame, columns)
        both = frame.sparkSession.createDataFrame([(c, *v) for c, v in found.items()], "feature string, fill double, static double")  # a row for each column
    else:
        both = fill_rates(frame, columns).join(static_rates(frame, columns), "feature")
    return both.filter((F.col("fill") >= least_fill) & (F.coalesce("static", F.lit(0.0)) <= most_static))


def redundant(pairs: DataFrame, most: float = 0.999) -> DataFrame:
    """feature: of each strongly correlated pair, the one with more strong correlation in all; on ties, to 9 places, the second."""
    strong = pairs.filter(F.abs("corr") > most).withColumn("corr", F.round(F.abs("corr"), 9))
    both = strong.select(F.col("feature").alias("f"), "corr").unionByName(strong.select(F.col("neighbor").alias("f"), "corr"))
    sums = both.groupBy("f").agg(F.round(F.sum("corr"), 6).alias("s"))
    with_a = strong.join(sums.select(F.col("f").alias("feature"), F.col("s").alias("sa")), "feature", "left")
    with_b = with_a.join(sums.select(F.col("f").alias("neighbor"), F.col("s").alias("sb")), "neighbor", "left")
    return with_b.select(F.when(F.col("sa") > F.col("sb"), F.col("feature")).otherwise(F.col("neighbor")).alias("feature")).distinct()


def huge(frame: DataFrame, columns: list[str], most: float = 1e6) -> DataFrame:
    row = frame.selectExpr(*[f"max(abs(cast(`{c}` as double))) `{c}`" for c in columns])
    return row.unpivot([], columns, "feature", "most").filter(F.col("most") > most)


def filled(frame: DataFrame, columns: list[str], how: str | float = 0.0, group: list[str] | None = None) -> DataFrame:
    """Nulls by a constant, or by mean or median, of all or of a group; null is a group. A group without values keeps its nulls.

    Medians are ranks among counts of values, so a group may hold most rows.
    """
    if how not in ("mean", "median"):
        if isinstance(how, str) or not np.isfinite(how):
            return frame.withColumns({c: F.coalesce(F.col(c), F.lit(how)) for c in columns})
        chosen, constant = set(columns), f"double({how!r})" if isinstance(how, float) else repr(how)
        return frame.selectExpr(*[f"coalesce(`{c}`, {constant}) `{c}`" if c in chosen else f"`{c}`" for c in frame.columns])
    keys = group or []
    if how == "mean":
        found = frame.groupBy(*keys).agg(*[F.avg(F.col(c)).alias(f"__{c}") for c in columns])
    else:
        long = frame.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__x")) for c in columns])))
        middle = ranks.quantiles(long, [*keys, "__c"], "__x", [0.5])
        found = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("__c") == c, F.col("quantiles")[0])).alias(f"__{c}") for c in columns])
    met = scans.matched(frame, found, keys) if keys else frame.crossJoin(F.broadcast(found))  # without groups one row
    return met.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in sorted(columns)])


def sequences(frame: DataFrame, vectors: list[str]) -> DataFrame:
    """Per (trace, agent): vectors in order of start, whether anomalous, first known type."""
    order = F.struct("start_time_ns", "span_id", *vectors)
    rows = frame.groupBy("trace_id", "agent_id").agg(F.sort_array(F.collect_list(order)).alias("s"), F.max("is_anomaly").alias("is_anomaly"), F.min("anomaly_type").alias("anomaly_type"))
    return rows.select("trace_id", "agent_id", *[F.col("s")[v].alias(f"{v}_sequence") for v in vectors], "is_anomaly", "anomaly_type")


def sequence_stats(frame: DataFrame, column: str) -> DataFrame:
    """min, max, median, mean length of the sequences, and how many are empty."""
    n = F.size(column)
    rest = frame.agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.count_if(n == 0).alias("empty"))
    return rest.crossJoin(F.broadcast(ranks.median(frame, n))).select("min", "max", "median", "mean", "empty")  # one row each


def stratified_split(frame: DataFrame, key: str, label: str, normal: str = "NonAnomaly", train: float = 0.7, val: float = 0.15, salt: str = "split") -> DataFrame:
    """Rows with ``split``: normal ones to train, val and test, each class of others to val and test, exact counts in hash order.

    One class may hold most rows: ranks come from the counts of hash buckets and from
    windows within a bucket, not from one window over a class.
    """
    h = F.xxhash64(F.col(key).cast("string"), F.lit(salt))
    rows = frame.filter(F.col(label) != "unknown").withColumn("__h", h).withColumn("__b", F.pmod(F.shiftright("__h", 48), F.lit(4096)))
    counts = rows.groupBy(label, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(label).orderBy("__b")
    counts = counts.withColumn("__before", F.sum("__c").over(w) - F.col("__c")).withColumn("__n", F.sum("__c").over(Window.partitionBy(label)))
    own = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    placed = rows.withColumn("__own", own).join(counts, [label, "__b"]).withColumn("__i", F.col("__before") + F.col("__own"))
    upto = lambda share: F.floor(F.col("__n") * share)
    is_normal = F.col(label) == normal
    split = (
        F.when(is_normal & (F.col("__i") <= upto(train)), "train").when(is_normal & (F.col("__i") <= upto(train) + upto(val)), "val").when(is_normal, "test")
        .when(F.col("__i") <= upto(train), "val").otherwise("test")
    )
    return placed.withColumn("split", split).select(*frame.columns, "split")


def dimension_stats(frame: DataFrame, column: str, method: str = "robust", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """dim, low, high, shift, scale of the vectors in ``column``, from nearest-rank quantiles after clipping.

    All come from counts of the values of each dimension. Quartiles lie between the edges, so clipping does not move them.
    """
    long, places = frame.select(F.posexplode(column).alias("dim", "x")), [low, high, 0.5, 0.25, 0.75]
    counts = None if method == "robust" else ranks.ranked(long, ["dim"], "x")
    picks = ranks.quantiles(long, ["dim"], "x", places, linear=False) if counts is None else ranks.of_ranks(counts, ["dim"], "x", places, linear=False)
    q = lambda i: F.col("quantiles")[i]
    edges = picks.select("dim", q(0).alias("low"), q(1).alias("high"), q(2).alias("shift"), (q(4) - q(3)).alias("scale"))
    if method == "robust":
        out = edges
    else:
        cut = counts.join(F.broadcast(edges.select("dim", "low", "high")), "dim").withColumn("x", F.greatest(F.least("x", "high"), F.col("low")).cast("double"))  # a row for each dimension
        mean = cut.groupBy("dim", "low", "high").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("shift"))
        apart = cut.join(F.broadcast(mean.select("dim", "shift")), "dim")
        spread = F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("x") - F.col("shift")) ** 2), F.sum("n") - 1))
        out = apart.groupBy("dim", "low", "high", "shift").agg(spread.alias("scale"))
    return out.withColumn("scale", F.when(F.coalesce(F.col("scale"), F.lit(0.0)) < 1e-6, 1.0).otherwise(F.col("scale")))


def normalised(frame: DataFrame, column: str, stats: DataFrame) -> DataFrame:
    """Each element less its shift, by its scale; the stats are one row for each dimension."""
    row = stats.agg(F.sort_array(F.collect_list(F.struct("dim", "shift", "scale"))).alias("__s"))
    return frame.crossJoin(F.broadcast(row)).withColumn(column, F.zip_with(column, "__s", lambda x, s: (x.cast("double") - s["shift"]) / s["scale"])).drop("__s")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: what a lambda refers to is else worked out anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A vector of word counts by hash, of length one: the default text embedding."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)))
    counted = lambda held: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(held, lambda p: p == i)).cast("double"))
    norm = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda counts: _bound(norm(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return _bound(_bound(places, counted), scaled)


def clipped(c: Column, low: float, high: float) -> Column:
    return clip(c, low, high)


# ---- the whole way from features to vectors ---------------------------------------------


def surviving(frame: DataFrame, columns: list[str], least_fill: float = 0.5, most_static: float = 0.95, most_corr: float = 0.999, most: float = 1e6) -> list[str]:
    """Columns that are filled and varied enough, repeat no other one and hold no huge value, in the order of their names.

    Only names reach the driver, at most one for each column.
    """
    good = sorted(r[0] for r in useful(frame, columns, least_fill, most_static).select("feature").collect())
    if not good:
        return []
    again = {r[0] for r in redundant(gram.correlations(frame, good, most_corr), most_corr).collect()}
    rest = [c for c in good if c not in again]
    large = {r[0] for r in huge(frame, rest, most).collect()}
    return [c for c in rest if c not in large]


def fit_vectors(frame: DataFrame, columns: list[str], fill: float = 0.0, **limits) -> dict:
    """Parameters of ``vectors``: the surviving columns and what nulls are filled with."""
    return {"columns": surviving(filled(frame, columns, fill), columns, **limits), "fill": fill}


def vectors(frame: DataFrame, parameters: dict, name: str = "epi_vector", keep: list[str] | None = None) -> DataFrame:
    """``frame`` (or its columns ``keep``) with the vector of fitted columns; the same for training and inference."""
    out = filled(frame, parameters["columns"], parameters["fill"]).withColumn(name, vector(parameters["columns"]) if parameters["columns"] else F.array().cast("array<double>"))
    return out if keep is None else out.select(*keep, name)


def inference_traces(frame: DataFrame, parameters: dict, embed, text: str = "sem_text", stats: DataFrame | None = None) -> DataFrame:
    """Sequences of new spans by stored parameters; labels, if there are any, are dropped."""
    rows = vectors(frame, parameters).withColumn("sem_vector", embed(F.col(text)))
    if stats is not None:
        rows = normalised(rows, "epi_vector", stats)
    unlabelled = rows.withColumns({"is_anomaly": F.lit(None).cast("boolean"), "anomaly_type": F.lit(None).cast("string")})
    out = sequences(unlabelled, ["epi_vector", "sem_vector"])
    return out.withColumnsRenamed({"epi_vector_sequence": "epi_sequence", "sem_vector_sequence": "sem_sequence"}).drop("is_anomaly", "anomaly_type")


def normalised_sequences(frame: DataFrame, column: str, stats: DataFrame) -> DataFrame:
    """Each vector of each sequence less its shift, by its scale."""
    row = stats.agg(F.sort_array(F.collect_list(F.struct("dim", "shift", "scale"))).alias("__s"))  # a row for each dimension
    moved = F.transform(column, lambda v: F.zip_with(v, F.col("__s"), lambda x, s: (x.cast("double") - s["shift"]) / s["scale"]))
    return frame.crossJoin(F.broadcast(row)).withColumn(column, moved).drop("__s")


def embedder(function, width: int):
    """A column function from texts to vectors by a batch function (list of texts to a matrix), run in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = np.asarray(function([t or "" for t in texts]), np.float64).reshape(len(texts), width)
        return pd.Series(out.tolist())

    return embed


def anomaly_types(frame: DataFrame, label: str = "anomaly_type", normal: str = "NonAnomaly") -> DataFrame:
    """Distinct types of anomalies, sorted."""
    return frame.filter((F.col(label) != normal) & (F.col(label) != "unknown")).select(label).distinct().orderBy(label)


def fractions(frame: DataFrame, key: str, label: str, salt: str = "fraction") -> DataFrame:
    """Rows with ``__q``: place in the hash order of their label by the number of its rows, from 0 to below 1; ranks come from hash buckets as in ``stratified_split``."""
    h = F.xxhash64(F.col(key).cast("string"), F.lit(salt))
    rows = frame.withColumn("__h", h).withColumn("__b", F.pmod(F.shiftright("__h", 48), F.lit(4096)))
    counts = rows.groupBy(F.col(label).alias("__label"), F.col("__b").alias("__bucket")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy("__label").orderBy("__bucket")
    counts = counts.withColumn("__before", F.sum("__c").over(w) - F.col("__c")).withColumn("__n", F.sum("__c").over(Window.partitionBy("__label")))
    own = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)) - 1
    placed = rows.withColumn("__own", own).join(counts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b") == F.col("__bucket")))
    return placed.withColumn("__q", (F.col("__before") + F.col("__own")) / F.col("__n")).select(*frame.columns, "__q")


def cut_by_fraction(frame: DataFrame, key: str, label: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Rows with ``split``: train, val or test by their place within their label."""
    q = F.col("__q")
    split = F.when(q < train, "train").when(q < train + val, "val").otherwise("test")
    return fractions(frame, key, label).withColumn("split", split).drop("__q")


def sample(frame: DataFrame, key: str, label: str, sizes: dict, salt: str = "sample") -> DataFrame:
    """Up to so many rows of each listed label, those of least hash."""
    out = None
    for value, n in sizes.items():
        part = frame.filter(F.col(label) == value).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), key).limit(n)
        out = part if out is None else out.unionByName(part)
    return frame.limit(0) if out is None else out


def numeric_columns(frame: DataFrame, protected=()) -> list[str]:
    """Names of numeric columns but for protected ones."""
    return [c for c, t in frame.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") and c not in protected]


def without(frame: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names do not match."""
    import re

    return frame.select(*[c for c in frame.columns if not re.search(pattern, c)])
