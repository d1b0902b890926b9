"""Detecting anomalous traces: two branches of span vectors, their fusion, a calibrated score, records.

The branches are principal subspaces fitted on the spans of normal traces. A trace's error
is the loss of its reconstructed spans by its number of spans, its latent the mean of their
coordinates. Normalised latents of both branches are fused by a third subspace, whose mean
loss is the combined error; a threshold on it decides.

Cases: a null or empty sequence has null errors and is not detected; steps beyond ``max_len`` are
left out; null elements count as the mean; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import scoring
from tracewright.operators.selection import cut
from tracewright.sources.document import write_document

EPS = 1e-8


# ---- losses ---------------------------------------------------------------------------


def pointwise(a: Column, b: Column, kind: str = "mse", delta: float = 1.0) -> Column:
    """Array of losses of the elements of two arrays."""
    if kind not in ("mse", "huber"):
        raise ValueError(f"no loss named {kind}")

    def one(x: Column, y: Column) -> Column:
        d = F.abs(x - y)
        return d * d if kind == "mse" else F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))

    return F.zip_with(a, b, one)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean_loss(a: Column, b: Column, kind: str = "mse", delta: float = 1.0) -> Column:
    return total(pointwise(a, b, kind, delta)) / F.size(a)


def masked_loss(a: Column, b: Column, mask: Column, kind: str = "mse", delta: float = 1.0, eps: float = EPS) -> Column:
    """Mean loss of the elements whose mask is 1."""
    return total(F.zip_with(pointwise(a, b, kind, delta), mask, lambda x, m: x * m)) / (total(mask) + eps)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax at the place of the label, from 0 on."""
    top = F.array_max(logits)
    return F.log(total(F.transform(logits, lambda x: F.exp(x - top)))) + top - F.get(logits, label)


# ---- sequences ------------------------------------------------------------------------


def steps(frame: DataFrame, sequence: str, max_len: int | None = None) -> DataFrame:
    """A row for each step of each sequence: the other columns, step, vector; steps beyond ``max_len`` are left out."""
    rows = frame.select(*[c for c in frame.columns if c != sequence], F.posexplode(sequence).alias("step", "vector"))
    return rows if max_len is None else rows.filter(F.col("step") < max_len)


def longest(frame: DataFrame, sequence: str) -> int:
    return frame.agg(F.max(F.size(sequence))).first()[0] or 0


def normal_only(frame: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """What models are trained on; thresholds are tuned on all rows."""
    return frame.filter(~F.coalesce(F.col(label).cast("boolean"), F.lit(True)))


# ---- models ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Subspace:
    """Mean and orthonormal axes of vectors; small, so it lives on the driver."""

    mean: list[float]
    axes: list[list[float]]

    def loss(self, x: np.ndarray, kind: str, delta: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the summed loss of its reconstruction, and its coordinates."""
        centred = np.where(np.isnan(x), 0.0, x - np.asarray(self.mean))
        axes = np.asarray(self.axes)
        at = centred @ axes.T
        apart = np.abs(centred - at @ axes)
        losses = apart**2 if kind == "mse" else np.where(apart <= delta, 0.5 * apart**2, delta * (apart - 0.5 * delta))
        return losses.sum(axis=1), at


def fit_subspace(frame: DataFrame, vector: str, k: int) -> Subspace:
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    known = frame.filter(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("__a"))
    rows = cut(known).select(array_to_vector("__a").alias("__v"))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(rows)
    mean = scaler.mean.toArray()
    model = PCA(k=min(k, len(mean)), inputCol="__c", outputCol="__p").fit(scaler.transform(rows))
    return Subspace(mean.tolist(), model.pc.toArray().T.tolist())


@dataclass(frozen=True)
class Detector:
    """All that is fitted; ``dumps`` and ``loads`` keep it as JSON."""

    epi: Subspace
    sem: Subspace
    fusion: Subspace
    latent_mean: list[float]
    latent_std: list[float]
    threshold: float
    epi_stats: tuple[float, float]
    sem_stats: tuple[float, float]
    temperature: float
    weights: list[float]
    bias: float
    max_len: int
    loss: str = "mse"
    delta: float = 1.0

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Detector:
        values = json.loads(text)
        return Detector(**values | {k: Subspace(**values[k]) for k in ("epi", "sem", "fusion")} | {k: tuple(values[k]) for k in ("epi_stats", "sem_stats")})


def scored_branch(frame: DataFrame, sequence: str, model: Subspace, max_len: int, loss: str = "mse", delta: float = 1.0) -> Column:
    """struct(error, latent) of a sequence of vectors."""
    width = len(model.mean)

    @F.pandas_udf("struct<error:double,latent:array<double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sequences in batches:
            kept = [[] if s is None else [v for v in s[:max_len] if v is not None] for s in sequences]
            sizes = np.array([len(s) for s in kept])
            x = np.array([np.asarray(v, np.float64) for s in kept for v in s]).reshape(-1, width)
            losses, at = model.loss(x, loss, delta)
            owner = np.repeat(np.arange(len(kept)), sizes)
            errors = np.bincount(owner, losses, len(kept)) / (sizes + EPS)
            latents = np.zeros((len(kept), at.shape[1]))
            np.add.at(latents, owner, at)
            latents /= np.maximum(sizes, 1)[:, None]
            yield pd.DataFrame({"error": np.where(sizes > 0, errors, np.nan), "latent": [row if n else None for row, n in zip(latents.tolist(), sizes, strict=True)]})

    out = score(F.col(sequence))
    return F.struct(F.nanvl(out["error"], F.lit(None).cast("double")).alias("error"), out["latent"].alias("latent"))


def _fused(frame: DataFrame, d: Detector) -> DataFrame:
    """The frame of scored branches with ``z`` (normalised latents of both) and ``e_comb``."""
    model, loss, delta = d.fusion, d.loss, d.delta

    @F.pandas_udf("double")
    def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            known = [v is not None for v in vectors]
            out = np.full(len(vectors), np.nan)
            if any(known):
                x = np.stack([np.asarray(v, np.float64) for v in vectors if v is not None])
                out[known] = model.loss(x, loss, delta)[0] / x.shape[1]
            yield pd.Series(out)

    return _normalised(frame, d.latent_mean, d.latent_std).withColumn("e_comb", F.nanvl(error("z"), F.lit(None).cast("double")))


def _normalised(frame: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    both = F.concat("epi.latent", "sem.latent")
    scale = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(mean, std, strict=True)])  # a number for each latent
    return frame.withColumn("z", F.zip_with(both, scale, lambda x, p: (x - p["m"]) / p["s"]))


def _branches(frame: DataFrame, epi: str, sem: str, models: tuple[Subspace, Subspace], max_len: int, loss: str, delta: float) -> DataFrame:
    return frame.withColumns({"epi": scored_branch(frame, epi, models[0], max_len, loss, delta), "sem": scored_branch(frame, sem, models[1], max_len, loss, delta)})


def fit(
    train: DataFrame, val: DataFrame, epi: str = "epi_sequence", sem: str = "sem_sequence", label: str = "is_anomaly", k: tuple[int, int, int] = (4, 4, 4),
    max_len: int | None = None, loss: str = "mse", delta: float = 1.0, metric: str = "f1", thresholds: int = 10_000,
) -> Detector:
    """Fit on the normal traces of ``train``; threshold, temperature and weights come from all of ``val``."""
    normal = normal_only(train, label)
    max_len = max_len or max(longest(train, epi), longest(val, epi), 1)
    models = tuple(fit_subspace(steps(normal.select(c), c, max_len), "vector", n) for c, n in ((epi, k[0]), (sem, k[1])))
    branches = lambda f: _branches(f.select(epi, sem, label), epi, sem, models, max_len, loss, delta).select("epi", "sem", label)
    seen = cut(branches(normal))
    width = len(models[0].axes) + len(models[1].axes)
    at = lambda i: F.concat("epi.latent", "sem.latent")[i]
    row = seen.agg(*[F.avg(at(i)) for i in range(width)], *[F.stddev_pop(at(i)) for i in range(width)]).first()
    mean, std = [x or 0.0 for x in row[:width]], [(x or 0.0) + EPS for x in row[width:]]
    fusion = fit_subspace(_normalised(seen, mean, std), "z", k[2])
    stats = [tuple(scoring.robust_stats(seen.select(F.col(f"{b}.error").alias("e")), "e").first()) for b in ("epi", "sem")]
    draft = Detector(*models, fusion, mean, std, 0.0, *stats, 1.0, [], 0.0, max_len, loss, delta)
    own = _fused(seen, draft).select("e_comb")
    held = cut(_fused(branches(val), draft).select(F.col("epi.error").alias("e_epi"), F.col("sem.error").alias("e_sem"), "e_comb", F.col(label).cast("int").alias(label)))
    threshold = scoring.select_threshold(scoring.threshold_sweep(held, "e_comb", label, thresholds), metric).first()["threshold"]
    mad = scoring.robust_stats(own, "e_comb").first()["mad"]
    t = held.agg(scoring.temperature(held, "e_comb", label, mad).alias("t")).first()["t"]
    z = {f"__l_{i}": c for i, c in enumerate(_logits(F.col("e_epi"), F.col("e_sem"), F.col("e_comb"), stats[0], stats[1], threshold, t))}
    weights, bias = scoring.fit_weights(held.dropna().withColumns(z), list(z), label)
    return Detector(*models, fusion, mean, std, threshold, *stats, t, list(weights), bias, max_len, loss, delta)


def _logits(e_epi, e_sem, e_comb, epi, sem, threshold, t) -> list[Column]:
    z = [(e - m) / (1.4826 * mad + EPS) for e, (m, mad) in ((e_epi, epi), (e_sem, sem))]
    return [z[0] - 2, z[1] - 2, (e_comb - threshold) / (t + EPS)]


def score(frame: DataFrame, d: Detector, epi: str = "epi_sequence", sem: str = "sem_sequence") -> DataFrame:
    """The traces without their sequences, and detector_reconstruction_error, e_epi, e_sem, p_anomaly, confidence, z_epi, z_sem, is_anomaly."""
    kept = [c for c in frame.columns if c not in (epi, sem)]
    held = frame.select(F.struct(*kept).alias("__row"), F.col(epi).alias("__epi"), F.col(sem).alias("__sem"))
    fused = _fused(_branches(held, "__epi", "__sem", (d.epi, d.sem), d.max_len, d.loss, d.delta), d)
    c = scoring.confidence(F.col("epi.error"), F.col("sem.error"), F.col("e_comb"), d.epi_stats, d.sem_stats, d.threshold, d.temperature, d.weights, d.bias)
    first = len(d.epi.axes)
    return fused.select(
        *[F.col(f"__row.{k}").alias(k) for k in kept], F.col("e_comb").alias("detector_reconstruction_error"), F.col("epi.error").alias("detector_e_epi"), F.col("sem.error").alias("detector_e_sem"),
        c["p_anomaly"].alias("detector_p_anomaly"), c["confidence"].alias("detector_confidence"), F.slice("z", 1, first).alias("detector_z_epi"),
        F.slice("z", first + 1, len(d.sem.axes)).alias("detector_z_sem"), c["is_anomaly"].alias("detector_is_anomaly"),
    )


def detect(frame: DataFrame, d: Detector, epi: str = "epi_sequence", sem: str = "sem_sequence") -> DataFrame:
    """The traces that are anomalous, with their scores."""
    return score(frame, d, epi, sem).filter("detector_is_anomaly").drop("detector_is_anomaly")


# ---- records --------------------------------------------------------------------------

# Columns that a record has besides its own, blank where absent, and the order of its fields.
BLANKS = ("anomaly_type", "business_description", "user_query", "agent_response", "tech_details", "rca_results", "_comment")
FIELDS = ("_comment", "trace_id", "starttime", "endtime", "anomaly_type", "confidence", "business_description", "user_query", "agent_response", "tech_details", "rca_results")
ROOT_CAUSE = "-dummy-"


def utc_text(ns: str) -> Column:
    """Nanoseconds since the epoch as yyyy-MM-ddTHH:mm:ssZ, whatever the session's zone."""
    return F.expr(f"date_format(timestampadd(SECOND, {ns} div 1000000000, TIMESTAMP_NTZ '1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")


def with_root_cause(detected: DataFrame) -> DataFrame:
    """A placeholder: causes are not analysed."""
    return detected.withColumn("rca_results", F.lit(ROOT_CAUSE))


def of_detected(spans: DataFrame, detected: DataFrame) -> DataFrame:
    """The spans of detected traces."""
    return spans.join(detected.select("trace_id").distinct(), "trace_id", "left_semi")


def enrich(detected: DataFrame, bounds: DataFrame) -> DataFrame:
    """Detected traces with start and end as text, confidence in percent, and blank columns where there are none."""
    timed = detected.join(bounds.select("trace_id", F.col("start_ns").alias("__start"), F.col("end_ns").alias("__end")), "trace_id", "left")
    timed = timed.withColumns({"starttime": utc_text("__start"), "endtime": utc_text("__end"), "confidence": F.round(F.col("detector_confidence") * 100).cast("bigint")}).drop("__start", "__end")
    return timed.withColumns({c: F.lit("") for c in BLANKS if c not in timed.columns})


def records(frame: DataFrame) -> DataFrame:
    """The fields of the record of each detected trace, in their order; fields without a column are blank."""
    return frame.select(*[F.col(c) if c in frame.columns else F.lit("").alias(c) for c in FIELDS])


def write_records(frame: DataFrame, path: str) -> None:
    """One JSON record a line, nulls written."""
    records(frame).write.option("ignoreNullFields", False).json(path)


def write_records_document(frame: DataFrame, path: str) -> None:
    """All records in one JSON document, ``{"anomalies": [...]}``."""
    write_document(records(frame), path)


def write_parameters(spark: SparkSession, name: str, text: str, path: str) -> None:
    """Fitted parameters as one JSON row."""
    spark.createDataFrame([(name, text)], "name string, parameters string").coalesce(1).write.mode("append").json(path)


def read_parameters(spark: SparkSession, path: str, name: str) -> str:
    row = spark.read.schema("name string, parameters string").json(path).filter(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    return row["parameters"]
