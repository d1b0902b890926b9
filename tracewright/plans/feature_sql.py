"""The feature definitions in DuckDB SQL, over a table ``spans`` of conformed spans."""

from __future__ import annotations

from tracewright.operators import features
from tracewright.sources.spec import KINDS, quoted

_ORDER = "PARTITION BY trace_id, agent_id ORDER BY start_time_ns, span_id"
EPS = "1e-8::DOUBLE"


def log(e: str) -> str:
    return f"CASE WHEN ({e}) < 0 THEN -ln(1 - ({e})::DOUBLE) ELSE ln(1 + ({e})::DOUBLE) END"


#: Counts of a text ``{t}``.
TEXT = {"char": "length({t})", "word": "len(string_split({t}, ' '))"} | {k: "len(regexp_extract_all({t}, " + quoted(p) + "))" for k, p in features.PATTERNS.items()}


def counts(prefix: str, text: str) -> dict[str, str]:
    return {f"{prefix}{k}_count": log(v.replace("{t}", text)) for k, v in TEXT.items()}


_TOOK, _LLM, _TOOL = "(end_time_ns - start_time_ns)", "aef_kind = 'llm'", "aef_kind = 'tool'"
_ENTROPY = " + ".join(f"CASE WHEN k_{k} > 0 THEN -(k_{k} / n::DOUBLE) * log2(k_{k} / n::DOUBLE) ELSE 0 END" for k in KINDS)
FIRST = {
    "total_duration": log(_TOOK), "duration": log(_TOOK), "duration_diff": "0.0::DOUBLE",
    "delta_time": log(f"coalesce(start_time_ns - lag(start_time_ns) OVER ({_ORDER}), 0)"), "exec_gap": log(f"coalesce(start_time_ns - lag(end_time_ns) OVER ({_ORDER}), 0)"),
    "llm_tokens": log(f"CASE WHEN {_LLM} THEN llm_total_tokens ELSE 0 END"), "llm_duration": log(f"CASE WHEN {_LLM} THEN {_TOOK} ELSE 0 END"),
    "token_ratio": f"CASE WHEN {_LLM} AND length(output_text) > 0 THEN length(input_text) / length(output_text)::DOUBLE ELSE 0.0::DOUBLE END",
    "tool_duration": log(f"CASE WHEN {_TOOL} THEN {_TOOK} ELSE 0 END"), "tool_success": f"CASE WHEN {_TOOL} THEN (status_code = 'STATUS_CODE_OK')::INT ELSE 0 END",
    "sem_text": "coalesce(output_text, '')", "agent_prompt": "coalesce(input_text, '')",
    **counts("exec_out_", "output_text"), **{f"is_{k}": f"(aef_kind = '{k}')::INT" for k in ("llm", "tool", "chain")},
    "tool_compression": log(f"(CASE WHEN {_TOOL} THEN length(output_text) / (length(input_text) + {EPS}) ELSE -1.0::DOUBLE END)"),
    "final_output_length": log("length(last_value(output_text) OVER (PARTITION BY trace_id ORDER BY agent_id, start_time_ns, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"),
    "unique_agents": "agents::INT", "actions_per_agent": log("n / agents::DOUBLE"), "unique_tools_global": "tools::INT", "action_entropy": f"({_ENTROPY})::DOUBLE",
    "is_repeat": "coalesce((lag(aef_kind) OVER (PARTITION BY trace_id ORDER BY start_time_ns, span_id) = aef_kind)::INT, 0)",
    "first_use": f"(row_number() OVER (PARTITION BY trace_id, agent_id, CASE WHEN {_TOOL} THEN span_name END ORDER BY start_time_ns, span_id) = 1)::INT",
}
_OVER = "OVER (PARTITION BY trace_id)"
SECOND = {
    "unique_tools_local": f"(sum(first_use) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT",
    "error_flag": f"regexp_matches(lower(sem_text), {quoted(features.ERROR)})::INT",
    **counts("", "sem_text"), **counts("prompt_", "agent_prompt"),
    "avg_word_length_sem": log("length(replace(sem_text, ' ', '')) / len(string_split(sem_text, ' '))::DOUBLE"),
    "time_gap_variance": f"var_samp(delta_time) {_OVER}", "iteration_duration_variance": f"var_samp(duration) {_OVER}", "repetitive_actions": f"(sum(is_repeat) {_OVER})::BIGINT",
    "processing_time_variance": f"stddev_samp(llm_duration / (llm_tokens + {EPS})) {_OVER}",
    "cv_duration": log(f"stddev_samp(duration) {_OVER} / (avg(duration) {_OVER} + {EPS})"), "cv_delta": log(f"stddev_samp(delta_time) {_OVER} / (avg(delta_time) {_OVER} + {EPS})"),
}
#: CTEs from ``spans`` to ``f``, with the plain column of every feature.
BASE = f"""t AS (SELECT trace_id, count(*) AS n, count(DISTINCT agent_id) + max((agent_id IS NULL)::INT) AS agents, count(DISTINCT CASE WHEN {_TOOL} THEN span_name END) + max((NOT ({_TOOL}))::INT) AS tools,
  {', '.join(f"count(*) FILTER (WHERE aef_kind = '{k}') AS k_{k}" for k in KINDS)} FROM spans GROUP BY trace_id),
f1 AS (SELECT trace_id, agent_id, span_id, start_time_ns, {', '.join(f'{e} AS {k}' for k, e in FIRST.items())} FROM spans JOIN t USING (trace_id)),
f AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in SECOND.items())} FROM f1)"""
NAMES = [k for k in (*FIRST, *SECOND) if k != "first_use"]
_INTS = {"tool_success", "is_llm", "is_tool", "is_chain", "unique_agents", "unique_tools_global", "is_repeat", "unique_tools_local", "error_flag", "repetitive_actions", "sem_text", "agent_prompt"}


def shown(name: str, places: int = 6) -> str:
    return name if name in _INTS else f"round({name}, {places}) AS {name}"


def aggregate(kind: str, c: str, over: str = "") -> list[tuple[str, str]]:
    if kind == "q":
        return [(f"q{round(q * 100)}", f"quantile_cont({c}, {q}){over}") for q in features.QUANTILES]
    return [(kind, {"max": "max", "min": "min", "mean": "avg", "std": "stddev_samp", "sum": "sum"}[kind] + f"({c}::DOUBLE){over}")]


def static_sql() -> str:
    """Aggregates of each object, rounded to 5 places."""
    return ", ".join(f"round({e}, 5) AS {name}__{k}" for name, (families, _) in features.AGGREGATES.items() for kind in families for k, e in aggregate(kind, name))


def rolling_sql(names, widths) -> str:
    """Aggregates of the last spans of each width, rounded to 5 places, and their windows."""
    columns = ", ".join(f"round({e}, 5) AS {name}__{k}_{w}" for w in widths for name in names for kind in features.AGGREGATES[name][1] for k, e in aggregate(kind, name, f" OVER w{w}"))
    return f"SELECT trace_id, span_id, {columns} FROM f WINDOW " + ", ".join(f"w{w} AS ({_ORDER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in widths)


def rolling_long_sql(widths) -> str:
    """Means over the spans of an agent of every rolling aggregate of each feature and width, rounded to 5 places, from ``f``."""
    rolling = {k: v[1] for k, v in features.AGGREGATES.items() if v[1]}
    if_has = lambda kind, e: f"CASE WHEN feature IN ({', '.join(quoted(k) for k, v in rolling.items() if kind in v)}) THEN {e} END"
    columns = ", ".join(f"{if_has(kind, e)} AS {k}" for kind in ("max", "min", "mean", "std", "sum") for k, e in aggregate(kind, "v", " OVER o"))
    places = ", ".join(f"{if_has('q', f'q[{i + 1}]')} AS q{round(q * 100)}" for i, q in enumerate(features.QUANTILES))
    names = ("max", "min", "mean", "std", "sum", *(f"q{round(q * 100)}" for q in features.QUANTILES))
    of_width = lambda w: f"SELECT agent_id, feature, {w}::INT AS width, {columns}, quantile_cont(v, {list(features.QUANTILES)}) OVER o AS q FROM l WINDOW o AS (PARTITION BY feature, trace_id, agent_id ORDER BY start_time_ns, span_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    every = " UNION ALL ".join(of_width(w) for w in widths)
    plain = ", ".join(f"{k}::DOUBLE AS {k}" for k in rolling)
    return f""", l AS (SELECT * FROM (SELECT trace_id, agent_id, start_time_ns, span_id, {plain} FROM f) UNPIVOT (v FOR feature IN ({', '.join(rolling)}))),
r AS ({every}), s AS (SELECT agent_id, feature, width, max, min, mean, std, sum, {places} FROM r)
SELECT agent_id, feature, width, count(*) AS n, {', '.join(f'round(avg({k}), 5) AS {k}' for k in names)} FROM s GROUP BY agent_id, feature, width"""
