"""Spans over the given ``events`` table, in Spark and in SQL.

Each column is one expression that both engines read alike; the few functions that have
other names stand in ``_NAMES``. Planted defects follow the event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.spec import SPEC

_NAMES = {
    "spark": {"us": "unix_micros(cast(ts as timestamp))", "day": "date_format(ts, 'yyyyMMdd')", "k": "cast(get_json_object(props, '$.k') as bigint)"},
    "duck": {"us": "epoch_us(ts)", "day": "strftime(ts, '%Y%m%d')", "k": "cast(json_extract(props, '$.k') as bigint)"},
}
#: First step: what the columns are made of.
_BASE = ("event_id", "user_id", "event_type", "value", "props", "{us} as us", "{k} as k", "'u' || cast(user_id as string) || 'd' || {day} as trace_id")
_COLUMNS = {
    "trace_id": "trace_id",
    "span_id": "case when event_id % 109 = 0 then 'span id not base64!' else 'e' || cast(event_id as string) end",
    "parent_span_id": "case when event_id = root_id then 'root' else 'e' || cast(root_id as string) end",
    "origin_span_id": "case when event_id = root_id then 'outside' else 'e' || cast(root_id as string) end",
    "agent_id": "'CI' || cast(user_id % 5 + 1 as string)",
    "session_id": "'s' || cast(user_id as string)",
    "start_time_ns": "us * 1000",
    "end_time_ns": "case when event_id % 97 = 0 then us * 1000 - 1000000 else us * 1000 + cast(round(value * 1e6) as bigint) end",
    "status_code": "case event_type when 'error' then 'STATUS_CODE_ERROR' when 'signup' then 'STATUS_CODE_UNSET' else 'STATUS_CODE_OK' end",
    "status_message": "case when event_type = 'error' then 'tool failed' else '' end",
    "aef_kind": "case event_type when 'click' then 'tool' when 'view' then 'llm' when 'purchase' then 'output_request' when 'signup' then 'start_agent' else 'chain' end",
    "span_name": "event_type || '.' || cast(event_id % 7 as string)",
    "input_text": "case when event_id % 101 = 0 then '{{\"city\": \"Paris\"' else props end",
    "output_text": "case when event_id % 103 = 0 then null else 'Result ' || cast(cast(round(value) as bigint) as string) || '. ' || event_type || ' done!' end",
    "llm_model": "case when event_type = 'view' then 'm1' else '' end",
    "llm_total_tokens": "case when event_type = 'view' then 1 + event_id % 400 + k else -1 end",
    "llm_temperature": "cast(case when event_type <> 'view' then -1.0 when event_id % 113 = 0 then -0.5 else 0.5 end as float)",
    "http_method": "case when event_type = 'purchase' then 'POST' else 'NONE' end",
    "http_path": "case when event_type = 'purchase' then '/buy' else '' end",
    "http_status_code": "cast(case when event_type <> 'purchase' then -1 when event_id % 127 = 0 then 999 else 200 end as bigint)",
    "service_name": "'svc'",
    "service_version": "case when event_id % 211 = 0 then '2' else '1' end",
    "session_id_derived": "event_id % 107 = 0 or event_id % 5 < 3",
    "session_id_generated": "event_id % 107 = 0",
    "nexus_distrib_ver": "'1.' || cast(user_id % 3 as string) || '.' || cast(user_id % 2 as string)",
}
for _a in SPEC:
    if _a.name not in _COLUMNS:
        _valid = {"bigint": "0", "float": "1.0", "boolean": "false", "string": "'{{}}'"}[_a.type]
        _empty = {"bigint": "-1", "float": "-1.0", "boolean": "false", "string": "''"}[_a.type]
        _test = "event_type = 'view'" if _a.group == "LLM" else "event_type = 'purchase'" if _a.group == "HTTP" else "false"
        _COLUMNS[_a.name] = f"cast(case when {_test} then {_valid} else {_empty} end as {_a.type})"
#: Variant B: long traces of several agents, without defects.
_CLEAN = {
    "trace_id": "'u' || cast(user_id as string)",
    "agent_id": "'CI' || cast(event_id % 3 + 1 as string)",
    "span_id": "'e' || cast(event_id as string)",
    "end_time_ns": "us * 1000 + cast(round(value * 1e6) as bigint)",
    "input_text": "props",
    "output_text": "'Result ' || cast(cast(round(value) as bigint) as string) || '. ' || event_type || ' done!'",
}


def _expressions(dialect: str, columns: dict[str, str]) -> list[str]:
    names = _NAMES[dialect]
    return [f"{columns[a.name].format(**names)} as {a.name}" for a in SPEC]


def _base(dialect: str) -> list[str]:
    return [e.format(**_NAMES[dialect]) for e in _BASE]


def raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant A: short traces with planted defects; each 503rd event comes twice."""
    base = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_base("spark"))
    roots = base.groupBy("trace_id").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("root_id"))
    copies = F.explode(F.when(F.col("event_id") % 503 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return base.join(roots, "trace_id").withColumn("copy", copies).selectExpr(*_expressions("spark", _COLUMNS))


def clean_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant B: one trace for each user, three agents."""
    base = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_base("spark"), "-1 as root_id")
    return base.selectExpr(*_expressions("spark", _COLUMNS | _CLEAN))


RAW_SQL = f"""base AS (SELECT {', '.join(_base('duck'))} FROM events),
rooted AS (SELECT *, first_value(event_id) OVER (PARTITION BY trace_id ORDER BY us, event_id) AS root_id FROM base),
raw AS (SELECT {', '.join(_expressions('duck', _COLUMNS))} FROM rooted CROSS JOIN (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR event_id % 503 = 0),
spans AS (SELECT * REPLACE (coalesce(output_text, '') AS output_text) FROM raw)"""
CLEAN_SQL = f"""base AS (SELECT {', '.join(_base('duck'))}, -1 AS root_id FROM events),
spans AS (SELECT {', '.join(_expressions('duck', _COLUMNS | _CLEAN))} FROM base)"""
