"""Conforming tables to the specification, and checking their schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tracewright.sources.spec import SPEC, Attribute

# Texts that are read as booleans.
TRUTHY = ("true", "t", "1", "yes", "y")
FALSY = ("false", "f", "0", "no", "n")


def parse_boolean(raw: Column) -> Column:
    text = F.lower(F.trim(raw.cast("string")))
    return F.when(text.isin(*TRUTHY), True).when(text.isin(*FALSY), False)


def _nested(frame: DataFrame, name: str) -> bool:
    return isinstance(frame.schema[name].dataType, ArrayType | MapType | StructType)


def conformed(frame: DataFrame, a: Attribute, mark: bool = True) -> Column:
    """The attribute from the frame: cast, garbage to trash (if marked), null or absent to empty."""
    empty = F.lit(a.empty).cast(a.type)
    if a.name not in frame.columns or _nested(frame, a.name):
        return empty.alias(a.name)
    raw = F.col(a.name)
    cast = parse_boolean(raw) if a.type == "boolean" else raw.try_cast(a.type)
    if a.domain:
        cast = F.when(cast.isin(*a.domain), cast)
    value = F.coalesce(cast, empty)
    if mark and a.trash is not None:
        value = F.when(raw.isNotNull() & cast.isNull(), F.lit(a.trash).cast(a.type)).otherwise(value)
    return value.alias(a.name)


def recast(frame: DataFrame, spec=SPEC) -> DataFrame:
    """All attributes of the specification and no others."""
    return frame.select(*[conformed(frame, a) for a in spec])


def overlay(frame: DataFrame, spec=SPEC) -> DataFrame:
    """The same for attributes that are present; other columns stay."""
    return frame.withColumns({a.name: conformed(frame, a) for a in spec if a.name in frame.columns})


def lenient(frame: DataFrame, spec=SPEC) -> DataFrame:
    """Cast without marking garbage."""
    return frame.select(*[conformed(frame, a, mark=False) for a in spec])


def scan(spark: SparkSession, path: str, spec=SPEC) -> DataFrame:
    """Read Parquet and conform it; only columns of the specification are read."""
    return recast(spark.read.parquet(path), spec)


def strict_scan(spark: SparkSession, path: str, spec=SPEC) -> DataFrame:
    """Read Parquet that has just the columns of the specification, else raise ValueError."""
    frame = spark.read.parquet(path)
    absent, extra = {a.name for a in spec} - set(frame.columns), set(frame.columns) - {a.name for a in spec}
    if absent or extra:
        raise ValueError(f"missing columns {sorted(absent)}, extra columns {sorted(extra)}")
    return frame.select(*[F.col(a.name).cast(a.type) for a in spec])


def load_labelled(spark: SparkSession, *paths: str, spec=None) -> DataFrame:
    """Files one below another, labels defaulted to ``unknown``, ``is_anomaly`` derived, spare columns dropped."""
    frame = spark.read.parquet(*paths)
    frame = frame.select([c for c in frame.columns if not c.endswith("-UNAVAIL")])
    if spec is not None:
        frame = overlay(frame, spec)
    for label in ("class", "anomaly_type"):
        if label not in frame.columns:
            frame = frame.withColumn(label, F.lit("unknown"))
    return frame.withColumn("is_anomaly", is_anomaly(F.col("class"), F.col("anomaly_type")))


def is_anomaly(class_: Column, anomaly_type: Column) -> Column:
    """Null if either label is ``unknown``, else from the type, else, if that is null, from the class; null if both are null."""
    known = ~(F.coalesce(class_ == "unknown", F.lit(False)) | F.coalesce(anomaly_type == "unknown", F.lit(False)))
    return F.when(known, F.coalesce(anomaly_type != "NonAnomaly", class_ == "true"))


def schema_check(frame: DataFrame, spec=SPEC, penalty: float = 0.12) -> DataFrame:
    """One row per attribute and extra column: verdict ok, converted, absent, incompatible or extra; critical_ok, ceiling, degraded."""
    types = dict(frame.dtypes)
    rows = []
    for a in spec:
        got = types.get(a.name)
        verdict = "absent" if got is None else "ok" if got == a.type else "incompatible" if _nested(frame, a.name) else "converted"
        rows.append((a.name, a.type, got, a.mandatory, verdict))
    known = {a.name for a in spec}
    rows += [(c, None, t, False, "extra") for c, t in frame.dtypes if c not in known]
    critical = all(v in ("ok", "converted") for _, _, _, m, v in rows if m)
    soft = sum(not m and v in ("absent", "incompatible") for _, _, _, m, v in rows)
    ceiling = min(1.0, max(0.0, 1 - penalty * soft))
    table = frame.sparkSession.createDataFrame(rows, "attribute string, expected string, found string, mandatory boolean, verdict string")
    return table.select("*", F.lit(critical).alias("critical_ok"), F.lit(ceiling).alias("ceiling"), F.lit(ceiling < 1).alias("degraded"))


def conformed_vectors(frame: DataFrame, vectors: list[str], keys: tuple[str, ...] = ("trace_id", "session_id", "agent_id", "aef_kind"), order: str = "start_time_ns") -> DataFrame:
    """Vectors as arrays of floats, keys as texts, the order as a number; what can't be cast is null, absent columns are left out."""
    casts = {v: F.transform(v, lambda x: x.try_cast("float")) for v in vectors if v in frame.columns}
    casts |= {k: F.col(k).cast("string") for k in keys if k in frame.columns}
    if order in frame.columns:
        casts[order] = F.col(order).cast("string").try_cast("bigint")
    return frame.withColumns(casts)


def write_splits(frame: DataFrame, path: str, split: str = "split") -> None:
    """Parquet, a folder for each split; each task writes its rows as they come."""
    frame.write.partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, columns: list[str], split: str = "split") -> DataFrame:
    """Some columns of one split; only its folder and these columns are read."""
    return spark.read.parquet(path).filter(F.col(split) == name).select(*columns)


def replaced(c: Column, mapping: dict, otherwise: Column | None = None) -> Column:
    """Values by a mapping; others as they are, or as told."""
    from itertools import chain

    known = F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())]), c)
    return F.coalesce(F.when(c.isNotNull(), known), c if otherwise is None else otherwise)
