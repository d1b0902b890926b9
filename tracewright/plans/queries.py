"""Registered queries of the span library, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.stats import u01, u01_sql
from tracewright.operators import augment, features, gram, prep, quality, readiness, reports, scans, scoring, selection, separability, sketches, stacking
from tracewright.plans import feature_sql
from tracewright.sources import conform, fixture, spec
from tracewright.sources.spec import INVARIANTS, MANDATORY, SPEC

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WITH = f"WITH {fixture.RAW_SQL}"
CLEAN = f"WITH {fixture.CLEAN_SQL}"


def query(sql: str | None = None):
    def registered(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return registered


def raw(spark, sf_dir):
    return fixture.raw_spans(spark, sf_dir)


def spans(spark, sf_dir):
    return conform.recast(raw(spark, sf_dir))


def clean(spark, sf_dir):
    return conform.recast(fixture.clean_spans(spark, sf_dir))


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    return frame.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes])


def total(expressions: list[str]) -> str:
    return " + ".join(f"({e})::BIGINT" for e in expressions)


VIOLATIONS = total([a.violation_sql for a in SPEC])
BROKEN = " OR ".join(a.violation_sql for a in MANDATORY)
MISSING = total([a.missing_sql for a in SPEC])
ABSENT = total([f"{a.name} IS NULL" for a in MANDATORY])
DAY = "date_trunc('day', make_timestamp(start_time_ns // 1000))"


def each(form: str, names=None) -> str:
    return ", ".join(form.format(a=a, name=a.name, violation=a.violation_sql, missing=a.missing_sql, spoilt=a.spoilt_sql) for a in SPEC if names is None or a.name in names)


# ---- sources and rules ---------------------------------------------------------------


@query(f"{WITH} SELECT {', '.join(a.name for a in SPEC)} FROM spans")
def io_recast(spark, sf_dir):
    return spans(spark, sf_dir)


@query(f"{WITH} SELECT trace_id, span_id, CASE WHEN TRY_CAST(v AS BIGINT) IS NULL AND v IS NOT NULL THEN -2 ELSE coalesce(TRY_CAST(v AS BIGINT), -1) END AS llm_total_tokens FROM (SELECT *, CASE WHEN span_name LIKE '%.0' THEN 'x' WHEN span_name LIKE '%.1' THEN NULL ELSE llm_total_tokens::VARCHAR END AS v FROM spans)")
def io_overlay_trash(spark, sf_dir):
    marred = F.when(F.col("span_name").endswith(".0"), "x").when(F.col("span_name").endswith(".1"), None).otherwise(F.col("llm_total_tokens").cast("string"))
    return conform.overlay(spans(spark, sf_dir).withColumn("llm_total_tokens", marred)).select("trace_id", "span_id", "llm_total_tokens")


@query(f"{WITH} SELECT trace_id, span_id, CASE WHEN 'unknown' IN (coalesce(class, ''), coalesce(anomaly_type, '')) THEN NULL WHEN anomaly_type IS NOT NULL THEN anomaly_type <> 'NonAnomaly' WHEN class IS NOT NULL THEN class = 'true' END AS is_anomaly FROM (SELECT *, CASE WHEN status_code = 'STATUS_CODE_ERROR' THEN 'true' WHEN span_name LIKE '%.1' THEN 'unknown' WHEN span_name LIKE '%.2' THEN NULL ELSE 'false' END AS class, CASE WHEN span_name LIKE '%.3' THEN 'unknown' WHEN span_name LIKE '%.4' THEN 'dpi' WHEN aef_kind = 'tool' THEN 'NonAnomaly' END AS anomaly_type FROM spans)")
def io_label(spark, sf_dir):
    part = lambda k: F.col("span_name").endswith(f".{k}")
    class_ = F.when(F.col("status_code") == "STATUS_CODE_ERROR", "true").when(part(1), "unknown").when(part(2), None).otherwise("false")
    kind = F.when(part(3), "unknown").when(part(4), "dpi").when(F.col("aef_kind") == "tool", "NonAnomaly")
    return spans(spark, sf_dir).select("trace_id", "span_id", conform.is_anomaly(class_, kind).alias("is_anomaly"))


#: What is left of the spans for a check: types changed, nested, missing and extra columns.
_ODD = {"llm_total_tokens": "CAST(llm_total_tokens AS string)", "http_path": "array(http_path)", "start_time_ns": "start_time_ns"}
_ODD_LEFT = ("kafka_topic", "meta_tags")
_EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


def _schema_sql() -> str:
    row = lambda *v: "(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, float) else f"'{x}'" for x in v) + ")"
    found = {a.name: a.type for a in SPEC if a.name not in _ODD_LEFT} | {"llm_total_tokens": "string", "http_path": "array<string>"}
    verdict = {"llm_total_tokens": "converted", "http_path": "incompatible"} | dict.fromkeys(_ODD_LEFT, "absent")
    ceiling = 1 - 0.12 * (1 + len(_ODD_LEFT))
    rows = [row("spans", a.name, a.type, found.get(a.name), a.mandatory, verdict.get(a.name, "ok"), True, ceiling, True) for a in SPEC] + [row("spans", "extra", None, "int", False, "extra", True, ceiling, True)]
    rows += [row("events", a.name, a.type, None, a.mandatory, "absent", False, 0.0, True) for a in SPEC] + [row("events", c, None, t, False, "extra", False, 0.0, True) for c, t in _EVENT_TYPES.items()]
    return f"SELECT source, attribute, expected, found, mandatory, verdict, critical_ok, round(ceiling::DOUBLE, 6) AS ceiling, degraded FROM (VALUES {', '.join(rows)}) v(source, attribute, expected, found, mandatory, verdict, critical_ok, ceiling, degraded)"


def spoilt(spark, sf_dir):
    """The raw spans with some columns left out, of another type, or beyond the specification."""
    return raw(spark, sf_dir).drop(*_ODD_LEFT).withColumns({k: F.expr(e) for k, e in _ODD.items()}).withColumn("extra", F.lit(1))


@query(_schema_sql())
def io_schema_check(spark, sf_dir):
    """The spans with some columns spoilt, and a table of another kind."""
    checks = {"spans": conform.schema_check(spoilt(spark, sf_dir)), "events": conform.schema_check(spark.read.parquet(f"{sf_dir}/events.parquet"))}
    first, second = (rounded(f).withColumn("source", F.lit(k)) for k, f in checks.items())
    return first.unionByName(second)


@query(f"{WITH} SELECT {each('sum(({violation})::BIGINT)::BIGINT AS {name}')} FROM raw")
def rule_violations(spark, sf_dir):
    return raw(spark, sf_dir).agg(*[F.sum(a.violation.cast("long")).alias(a.name) for a in SPEC])


@query(f"{WITH} SELECT trace_id, span_id, {VIOLATIONS} AS violations, {MISSING} AS missing, round(({VIOLATIONS}) / {len(SPEC)}.0::DOUBLE, 6) AS rate FROM spans")
def rule_row_sums(spark, sf_dir):
    return rounded(spans(spark, sf_dir).select("trace_id", "span_id", quality.violations().alias("violations"), quality.missing().alias("missing"), (quality.violations() / len(SPEC)).alias("rate")))


@query(f"{WITH} SELECT trace_id, span_id, json_valid(input_text) AS strict, regexp_matches(input_text, {spec.quoted(spec.JSON_LIKE)}) AS alike FROM spans")
def rule_json(spark, sf_dir):
    return spans(spark, sf_dir).select("trace_id", "span_id", F.try_parse_json("input_text").isNotNull().alias("strict"), F.col("input_text").rlike(spec.JSON_LIKE).alias("alike"))


@query(f"{WITH} SELECT trace_id, span_id, {each('NOT ({violation}) AS {name}_validated')} FROM spans")
def rule_validated(spark, sf_dir):
    return quality.validated(spans(spark, sf_dir)).select("trace_id", "span_id", *[F.coalesce(f"{a.name}_validated", F.lit(False)).alias(f"{a.name}_validated") for a in SPEC])


# ---- quality --------------------------------------------------------------------------

def agent():
    return {"agent_id": F.col("agent_id")}


@query(f"{WITH} SELECT agent_id, count(*) AS n, {each('round(avg(({missing})::INT), 6) AS {name}', {a.name for a in SPEC} - {'agent_id'})} FROM spans GROUP BY agent_id")
def dq_completeness(spark, sf_dir):
    return rounded(quality.completeness(spans(spark, sf_dir), agent()))


@query(f"{WITH} SELECT agent_id, {DAY} AS ts, count(*) AS n, {each('round(avg(({violation})::INT), 6) AS {name}', {a.name for a in SPEC} - {'agent_id'})} FROM spans GROUP BY ALL")
def dq_correctness_by_day(spark, sf_dir):
    return rounded(quality.correctness(spans(spark, sf_dir), agent() | {"ts": quality.starts_at()})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"{WITH} SELECT count(*) AS n, {each('round(avg(({spoilt})::INT), 6) AS {name}')} FROM spans")
def dq_contamination(spark, sf_dir):
    return rounded(quality.contamination(spans(spark, sf_dir)))


@query(f"{WITH} SELECT regexp_extract(nexus_distrib_ver, '^([0-9]+[.][0-9]+)', 1) AS minor, count(*) AS n, {each('sum(({name} IS NULL)::INT)::DOUBLE AS {name}')} FROM raw GROUP BY 1")
def dq_nulls_by_version(spark, sf_dir):
    return quality.nulls(raw(spark, sf_dir), {"minor": quality.version("minor")})


_NUMBERS = [a for a in SPEC if a.type in ("bigint", "float")]


def _distribution_sql() -> str:
    real = [(a.name, f"CASE WHEN {a.name} <> {a.empty} THEN {a.name}::DOUBLE END" if a.empty is not None else f"{a.name}::DOUBLE") for a in _NUMBERS] + [("duration_ns", "(end_time_ns - start_time_ns)::DOUBLE")]
    cols = ", ".join(f"round(quantile_cont({e}, {q}), 3) AS {n}_q{round(100 * q)}" for n, e in real for q in quality.QUANTILES)
    return f"{WITH} SELECT aef_kind, count(*) AS n, {cols} FROM spans GROUP BY aef_kind"


_SKETCHED = [("llm_total_tokens", "CASE WHEN llm_total_tokens <> -1 THEN llm_total_tokens END"), ("duration_ns", "end_time_ns - start_time_ns")]
_SKETCHED_SQL = " UNION ALL ".join(f"SELECT agent_id, '{n}' AS number, {e} AS x FROM spans" for n, e in _SKETCHED)


@query(f"{WITH}, l AS ({_SKETCHED_SQL}) SELECT agent_id, number, p AS place, count(x) AS n, true AS within FROM l, (SELECT unnest({list(quality.QUANTILES)}::DOUBLE[]) AS p) GROUP BY ALL HAVING count(x) > 0")
def dq_sketches(spark, sf_dir):
    """Quantiles of each agent, rolled up from sketches by day and agent, and whether their exact ranks keep the bound of the sketches."""
    rows = spans(spark, sf_dir)
    numbers = {n: F.expr(e) for n, e in _SKETCHED}
    daily = selection.cut(sketches.sketches(rows, {"day": quality.starts_at(), "agent_id": F.col("agent_id")}, numbers))
    found = sketches.quantiles(sketches.rolled_up(daily, ["agent_id"]), quality.QUANTILES)
    each = F.transform(F.array(*[F.lit(float(q)) for q in quality.QUANTILES]), lambda p, i: F.struct(p.alias("place"), F.get("quantiles", i).alias("value")))
    asked = selection.cut(found.select("agent_id", "number", "n", F.inline(each)))  # a row for each agent, number and place
    long = rows.select("agent_id", F.inline(F.array(*[F.struct(F.lit(n).alias("number"), c.cast("double").alias("x")) for n, c in numbers.items()]))).filter("x is not null")
    placed = scans.matched(long, asked.groupBy("agent_id", "number", "n").agg(F.collect_list(F.struct("place", "value")).alias("asked")), ["agent_id", "number"], "inner")
    counts = placed.select("agent_id", "number", "n", "x", F.inline("asked")).groupBy("agent_id", "number", "n", "place").agg(F.sum((F.col("x") < F.col("value")).cast("long")).alias("below"), F.sum((F.col("x") <= F.col("value")).cast("long")).alias("upto"))
    slack = 2 * sketches.error() * F.col("n") + 1
    near = (F.col("below") - slack <= F.col("place") * F.col("n")) & (F.col("place") * F.col("n") <= F.col("upto") + slack)
    return counts.select("agent_id", "number", "place", "n", near.alias("within"))


@query(_distribution_sql())
def dq_distribution(spark, sf_dir):
    return rounded(quality.distribution(spans(spark, sf_dir), {"aef_kind": F.col("aef_kind")}), 3)


@query(f"{WITH}, t AS (SELECT trace_id, bool_or({BROKEN}) AS rejected FROM spans GROUP BY trace_id) SELECT agent_id, count(*) AS n, round(avg(rejected::INT), 6) AS dropped_rate, sum(rejected::INT)::BIGINT AS dropped, sum(1 - rejected::INT)::BIGINT AS kept FROM spans JOIN t USING (trace_id) GROUP BY agent_id")
def dq_rejection(spark, sf_dir):
    return rounded(quality.rejection(spans(spark, sf_dir), agent()))


@query(f"{WITH} SELECT trace_id, arg_min(session_id, (start_time_ns, span_id)) AS session_id, arg_min(nexus_distrib_ver, (start_time_ns, span_id)) AS version, count(*) AS spans, bool_or({BROKEN}) AS rejected, {' AND '.join(f'count(DISTINCT {c}) <= 1' for c in INVARIANTS)} AS consistent FROM spans GROUP BY trace_id")
def dq_trace_status(spark, sf_dir):
    return quality.trace_status(spans(spark, sf_dir))


@query(f"{WITH}, t AS (SELECT trace_id, {', '.join(f'count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS {c}' for c in INVARIANTS)} FROM spans GROUP BY trace_id) SELECT {', '.join(f'sum(({c} > 1)::INT)::BIGINT AS {c}' for c in INVARIANTS)} FROM t")
def dq_trace_consistency(spark, sf_dir):
    return quality.trace_consistency(spans(spark, sf_dir))


_VERDICT = f"""{WITH}, t AS (SELECT {', '.join(f'count(DISTINCT {c}) AS {c}' for c in INVARIANTS)} FROM raw GROUP BY trace_id),
b AS (SELECT {' + '.join(f'sum(({c} > 1)::INT)' for c in INVARIANTS)} AS breaks FROM t), d AS (SELECT sum(n - 1) AS dups FROM (SELECT count(*) AS n FROM raw GROUP BY trace_id, span_id)),
s AS (SELECT count(*) AS spans, sum({total([f'{a.name} IS NULL' for a in SPEC])}) AS nulls, sum({MISSING}) AS missing, sum({total([a.spoilt_sql for a in SPEC])}) AS trash, sum({VIOLATIONS}) AS rules FROM raw)
SELECT spans, nulls::BIGINT AS nulls, missing::BIGINT AS missing, trash::BIGINT AS trash, rules::BIGINT AS rules, dups::BIGINT AS dups, breaks::BIGINT AS breaks,
       nulls <= 0 AND rules <= 0 AND dups <= 0 AND breaks <= 0 AS valid FROM s, d, b"""


@query(_VERDICT)
def dq_verdict(spark, sf_dir):
    return quality.verdict(raw(spark, sf_dir))


@query(f"{WITH} SELECT {DAY} AS ts, count(DISTINCT trace_id) AS traces, round(1 - avg(({VIOLATIONS}) / {len(SPEC)}.0::DOUBLE), 6) AS validity FROM spans GROUP BY 1")
def dq_flow(spark, sf_dir):
    return rounded(quality.flow(spans(spark, sf_dir))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"{WITH} SELECT trace_id, span_id, count(*) AS count FROM spans GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicates(spark, sf_dir):
    return quality.duplicates(spans(spark, sf_dir))


@query(f"{WITH}, s AS (SELECT count(*) AS total, {each('sum(({violation})::INT) AS {name}')} FROM spans) SELECT attribute, total, (total - invalid)::BIGINT AS valid, invalid::BIGINT AS invalid, round(100.0::DOUBLE * invalid::DOUBLE / total, 2) AS pct FROM (UNPIVOT s ON COLUMNS(* EXCLUDE (total)) INTO NAME attribute VALUE invalid)")
def dq_validation_stats(spark, sf_dir):
    return quality.validation_stats(spans(spark, sf_dir))


@query(f"{WITH} SELECT agent_id, count(*) AS spans, count(DISTINCT trace_id) AS traces FROM spans GROUP BY 1")
def dq_volume(spark, sf_dir):
    return quality.volume(spans(spark, sf_dir))


@query(f"{WITH} SELECT count(*) AS spans, count(DISTINCT trace_id) AS traces, count(DISTINCT agent_id) AS agents, count(DISTINCT aef_kind) AS kinds FROM spans")
def dq_overview(spark, sf_dir):
    return quality.overview(spans(spark, sf_dir))


@query(f"{WITH} SELECT span_name AS value, count(*) AS n FROM spans GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def dq_top_values(spark, sf_dir):
    return quality.value_counts(spans(spark, sf_dir), "span_name", 5)


@query("SELECT quality AS label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER ()::DOUBLE, 2) AS pct FROM labels GROUP BY quality")
def dq_label_balance(spark, sf_dir):
    return quality.label_balance(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")


@query(f"{WITH}, d AS (SELECT (end_time_ns - start_time_ns) / 1e9::DOUBLE AS s FROM spans) SELECT round(median(s), 4) AS median, round(avg(s), 4) AS mean, round(quantile_cont(s, 0.95), 4) AS q95 FROM d")
def dq_durations(spark, sf_dir):
    return quality.duration_summary(spans(spark, sf_dir))


@query(f"{WITH} SELECT 'output_text' AS \"column\", count(*) - count(output_text) AS nulls, round(100.0::DOUBLE * (count(*) - count(output_text)) / count(*), 2) AS pct FROM raw")
def dq_missingness(spark, sf_dir):
    return quality.missingness(raw(spark, sf_dir))


@query(f"{WITH} SELECT trace_id, min(start_time_ns) AS start_ns, max(end_time_ns) AS end_ns FROM spans GROUP BY 1")
def dq_bounds(spark, sf_dir):
    return quality.bounds(spans(spark, sf_dir))


@query("WITH c AS (SELECT * FROM conversations) SELECT conv_id::VARCHAR AS trace_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> ''), 'not found') AS query, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant' AND text <> ''), 'not found') AS answer FROM c GROUP BY 1")
def dq_query_and_answer(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.when(F.col("role") == "user", "input_request").when(F.col("role") == "assistant", "output_request").otherwise("other")
    rows = c.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").alias("start_time_ns"), F.col("turn").cast("string").alias("span_id"), kind.alias("aef_kind"), F.col("text").alias("input_text"), F.col("text").alias("output_text"))
    return quality.query_and_answer(rows)


def _dynamics_sql(width: int = 5) -> str:
    signals = {"missing": f"({MISSING})::DOUBLE", "invalid": f"({VIOLATIONS})::DOUBLE", "duration": "(end_time_ns - start_time_ns)::DOUBLE", "error": "(status_code = 'STATUS_CODE_ERROR')::INT::DOUBLE"}
    cols = ", ".join(f"{k}, round(sum({k}) OVER r, 3) AS {k}_sum, round(avg({k}) OVER r, 3) AS {k}_mean, round(avg({k}) OVER l, 3) AS {k}_last" for k in signals)
    base = ", ".join(f"{v} AS {k}" for k, v in signals.items())
    order = "PARTITION BY trace_id ORDER BY start_time_ns, span_id ROWS BETWEEN"
    return f"{CLEAN}, s AS (SELECT trace_id, span_id, start_time_ns, {base} FROM spans) SELECT trace_id, span_id, count(span_id) OVER r AS step, {cols} FROM s WINDOW r AS ({order} UNBOUNDED PRECEDING AND CURRENT ROW), l AS ({order} {width - 1} PRECEDING AND CURRENT ROW)"


@query(_dynamics_sql())
def win_dynamics(spark, sf_dir):
    return rounded(quality.dynamics(clean(spark, sf_dir)), 3)


# ---- readiness ------------------------------------------------------------------------

DEMO = readiness.policy("E", volume_target=1e3, min_eff_traces=100)


def _readiness_sql() -> str:
    p = DEMO
    q, d, r = p.quality_weights, p.dynamics_weights, p.readiness_weights
    worst = "CASE WHEN worst <= 0 THEN '—' " + " ".join(f"WHEN b_{a.name} >= worst THEN '{a.name}'" for a in reversed(MANDATORY)) + " END"
    return f"""{WITH}, t AS (SELECT trace_id, bool_or({BROKEN}) AS rejected FROM spans GROUP BY trace_id),
w AS (SELECT *, ({VIOLATIONS}) / {len(SPEC)}.0::DOUBLE AS rate, ({ABSENT}) / {len(MANDATORY)}.0::DOUBLE AS gaps FROM spans JOIN t USING (trace_id)
      WHERE start_time_ns >= (SELECT max(start_time_ns) FROM spans) - {p.window_days * readiness.NS_PER_DAY}),
c AS (SELECT agent_id, count(DISTINCT trace_id) AS traces, count(DISTINCT CASE WHEN NOT rejected THEN trace_id END) AS eff_traces, 1 - avg(rate) AS validity,
      1 - avg(gaps) AS presence, 1 - avg(rejected::INT) AS retention, {each('avg(({violation})::INT) AS b_{name}', {a.name for a in MANDATORY})} FROM w GROUP BY agent_id),
c2 AS (SELECT *, greatest({', '.join(f'b_{a.name}' for a in MANDATORY)}) AS worst FROM c),
c3 AS (SELECT agent_id, traces, eff_traces, 1 - eff_traces / traces::DOUBLE AS loss_rate, {worst} AS worst_rule_attr,
       1 / (1 + exp(-{p.steepness}::DOUBLE * (log10(eff_traces + 1) - log10({p.volume_target}::DOUBLE)))) AS volume_score, {q[0]} * validity + {q[1]} * presence + {q[2]} * retention AS quality_score FROM c2),
b AS (SELECT agent_id, {DAY} AS ts, count(DISTINCT trace_id) AS n, 1 - avg(rate) AS v FROM w GROUP BY ALL),
a AS (SELECT agent_id, avg(n) AS rate, coalesce(corr(epoch(ts)::DOUBLE, n::DOUBLE), 0) AS trend, coalesce(greatest(0, least(1, 1 - stddev_samp(v) / {p.stability_tol})), 1) AS stability FROM b GROUP BY agent_id),
s AS (SELECT c3.*, trend, {d[0]} / (1 + exp(-{p.trend_gain} * trend)) + {d[1]} * stability + {d[2]} * (1 - exp(-rate / {p.rate_target})) AS accel_score FROM c3 LEFT JOIN a USING (agent_id)),
f AS (SELECT *, {r[0]} * volume_score + {r[1]} * quality_score + {r[2]} * accel_score AS readiness FROM s)
SELECT agent_id, traces, eff_traces, round(loss_rate, 6) AS loss_rate, worst_rule_attr, round(volume_score, 6) AS volume_score, round(quality_score, 6) AS quality_score,
  round(accel_score, 6) AS accel_score, round(readiness, 6) AS readiness,
  CASE WHEN eff_traces < {p.min_eff_traces} OR loss_rate > {p.max_loss} OR quality_score < {p.min_quality} THEN 'not_ready' WHEN readiness >= {p.ready_at} THEN 'ready' WHEN readiness >= {p.pilot_at} THEN 'pilot' ELSE 'not_ready' END AS verdict,
  CASE WHEN eff_traces < {p.min_eff_traces} THEN 'too few traces' WHEN loss_rate > {p.max_loss} THEN 'loss: ' || worst_rule_attr WHEN quality_score < {p.min_quality} THEN 'quality: ' || worst_rule_attr
    WHEN trend < 0 THEN 'volume falls' WHEN readiness >= {p.ready_at} THEN 'ready' WHEN readiness >= {p.pilot_at} THEN 'pilot' ELSE 'accumulating' END AS reason FROM f"""


@query(_readiness_sql())
def ready_assess(spark, sf_dir):
    return rounded(readiness.assess(spans(spark, sf_dir), DEMO, agent()))


@query(f"{WITH}, s AS (SELECT agent_id, count(*) AS n, {each('avg(({violation})::INT) AS {name}', {a.name for a in SPEC} - {'agent_id'})} FROM spans GROUP BY agent_id) SELECT agent_id, n, attr, round(violation_rate, 6) AS violation_rate FROM (UNPIVOT s ON COLUMNS(* EXCLUDE (agent_id, n)) INTO NAME attr VALUE violation_rate) WHERE violation_rate > 0")
def ready_blame(spark, sf_dir):
    return rounded(readiness.blame(spans(spark, sf_dir), agent()))


# ---- selection ------------------------------------------------------------------------

AGENTS = ["CI1", "CI2", "CI3"]


def _select_sql(mode: str, method: str, percent: float, limit: int | None, subset: str, seed: int = 7) -> str:
    agent = "coalesce(agent_id IN ('CI1', 'CI2', 'CI3'), false)"
    having = f"bool_and({agent})" if mode == "strict" else f"bool_or({agent})"
    begin = f"min(start_time_ns) FILTER (WHERE {agent})" if mode == "open" else "min(start_time_ns)"
    cap = f"WHERE upto <= {limit}" if limit and mode != "open" else ""
    a, c, m = selection.A, selection.C, selection.M
    key = f"(((pos * {a} + {seed % m}) % {m}) * {a} + {c}) % {m}, trace_id" if method == "seeded" else "begin DESC, trace_id DESC"
    pick = {"full": "", "train": "AND NOT holdout", "test": "AND holdout"}[subset]
    rows = f"AND {agent}" if mode == "open" else ""
    return f"""{WITH}, e AS (SELECT trace_id, {begin} AS begin, count(*) AS n FROM spans GROUP BY trace_id HAVING {having}),
k AS (SELECT *, sum(n) OVER (ORDER BY begin, trace_id ROWS UNBOUNDED PRECEDING) AS upto FROM e),
o AS (SELECT trace_id, begin, row_number() OVER (ORDER BY begin, trace_id) AS pos FROM k {cap}),
h AS (SELECT trace_id, row_number() OVER (ORDER BY {key}) <= count(*) OVER () - floor((1.0 - {percent / 100}) * count(*) OVER ()) AS holdout FROM o)
SELECT spans.trace_id, span_id, start_time_ns, holdout FROM spans JOIN h USING (trace_id) WHERE true {pick} {rows}"""


def _selection(name: str, **options):
    sql = _select_sql(options["mode"], options["holdout_method"], options["holdout_percent"], options.get("limit"), options.get("subset", "full"))

    def run(spark, sf_dir):
        return selection.select_traces(spans(spark, sf_dir), AGENTS, seed=7, **options).select("trace_id", "span_id", "start_time_ns", "holdout")

    run.__name__ = name
    query(sql)(run)


_selection("sel_strict_recent", mode="strict", holdout_method="recent", holdout_percent=20, limit=3000)
_selection("sel_strict_seeded_test", mode="strict", holdout_method="seeded", holdout_percent=25, subset="test")
_selection("sel_loose_seeded_train", mode="loose", holdout_method="seeded", holdout_percent=10, limit=2000, subset="train")
_selection("sel_open_recent", mode="open", holdout_method="recent", holdout_percent=50)


# ---- features -------------------------------------------------------------------------

_TEXT_SQL = ", ".join(f"round({e}, 6) AS {k}" for k, e in feature_sql.counts("exec_out_", "output_text").items())


@query(f"{WITH} SELECT trace_id, span_id, {_TEXT_SQL} FROM spans")
def feat_text_counts(spark, sf_dir):
    chosen = [f for f in features.definitions() if f.name.startswith("exec_out_")]
    return rounded(features.base_features(spans(spark, sf_dir), chosen).select("trace_id", "span_id", *[f.name for f in chosen]))


_log = feature_sql.log


_TIMING = f"""{CLEAN}, l AS (SELECT *, end_time_ns - start_time_ns AS took, coalesce(start_time_ns - lag(start_time_ns) OVER o, 0) AS dt, coalesce(start_time_ns - lag(end_time_ns) OVER o, 0) AS gap,
  coalesce((lag(aef_kind) OVER (PARTITION BY trace_id ORDER BY start_time_ns, span_id) = aef_kind)::INT, 0) AS is_repeat FROM spans WINDOW o AS (PARTITION BY trace_id, agent_id ORDER BY start_time_ns, span_id))
SELECT trace_id, span_id, round({_log('took')}, 6) AS duration, round({_log('dt')}, 6) AS delta_time, round({_log('gap')}, 6) AS exec_gap, is_repeat FROM l"""


@query(_TIMING)
def feat_timing(spark, sf_dir):
    chosen = [f for f in features.definitions() if f.name in ("duration", "delta_time", "exec_gap", "is_repeat")]
    return rounded(features.base_features(clean(spark, sf_dir), chosen).select("trace_id", "span_id", *[f.name for f in chosen]))


_TRACE = f"""{CLEAN}, t AS (SELECT trace_id, count(DISTINCT agent_id) AS agents, count(*) AS n, count(DISTINCT CASE WHEN aef_kind = 'tool' THEN span_name END) + max((aef_kind <> 'tool')::INT) AS tools FROM spans GROUP BY 1),
e AS (SELECT trace_id, -sum(p * log2(p)) AS h FROM (SELECT trace_id, count(*) / sum(count(*)) OVER (PARTITION BY trace_id)::DOUBLE AS p FROM spans GROUP BY trace_id, aef_kind) GROUP BY 1)
SELECT trace_id, agents::BIGINT AS unique_agents, round(ln(1 + n / agents::DOUBLE), 6) AS actions_per_agent, tools::BIGINT AS unique_tools_global, round(h, 6) AS action_entropy FROM t JOIN e USING (trace_id)"""


@query(_TRACE)
def feat_trace(spark, sf_dir):
    chosen = [f for f in features.definitions() if f.name in features.OF_TRACE]
    out = features.base_features(clean(spark, sf_dir), chosen).select("trace_id", F.col("unique_agents").cast("long").alias("unique_agents"), "actions_per_agent", F.col("unique_tools_global").cast("long").alias("unique_tools_global"), "action_entropy")
    return rounded(out).distinct()


_ROLLING = f"""{CLEAN}, l AS (SELECT trace_id, span_id, agent_id, start_time_ns, {_log('(end_time_ns - start_time_ns)')} AS d FROM spans)
SELECT trace_id, span_id, {', '.join(f'round({f}(d) OVER w{w}, 6) AS duration__{k}_{w}' for w in (3, 10) for k, f in (('max', 'max'), ('min', 'min'), ('mean', 'avg'), ('std', 'stddev_samp'), ('sum', 'sum')))},
  {', '.join(f'round(quantile_cont(d, {q}) OVER w{w}, 6) AS duration__q{round(q * 100)}_{w}' for w in (3, 10) for q in features.QUANTILES)}
FROM l WINDOW {', '.join(f'w{w} AS (PARTITION BY trace_id, agent_id ORDER BY start_time_ns, span_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)' for w in (3, 10))}"""


@query(_ROLLING)
def feat_rolling(spark, sf_dir):
    chosen = [f for f in features.definitions() if f.name == "duration"]
    base = features.base_features(clean(spark, sf_dir), chosen)
    out = features.rolling_features(base.select("trace_id", "agent_id", "start_time_ns", "span_id", "duration"), (3, 10), chosen)
    return rounded(out.select("trace_id", "span_id", *[c for c in out.columns if c.startswith("duration__")]))


@query(f"{CLEAN}, l AS (SELECT trace_id, agent_id, {_log('(end_time_ns - start_time_ns)')} AS d FROM spans) SELECT trace_id, agent_id, round(max(d), 6) AS mx, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(quantile_cont(d, 0.9), 6) AS q90 FROM l GROUP BY 1, 2")
def feat_static(spark, sf_dir):
    chosen = [f for f in features.definitions() if f.name == "duration"]
    out = features.static_by_object(features.base_features(clean(spark, sf_dir), chosen), chosen)
    return rounded(out.select("trace_id", "agent_id", F.col("duration__max").alias("mx"), F.col("duration__mean").alias("mean"), F.col("duration__std").alias("std"), F.col("duration__q90").alias("q90")))


@query(f"{CLEAN}, {feature_sql.BASE} SELECT trace_id, span_id, {', '.join(map(feature_sql.shown, feature_sql.NAMES))} FROM f")
def feat_all(spark, sf_dir):
    """All 52 features."""
    return rounded(features.base_features(clean(spark, sf_dir).select(*features.INPUTS)).select("trace_id", "span_id", *[F.col(n).cast("bigint").alias(n) if n in ("unique_tools_local", "repetitive_actions") else F.col(n) for n in feature_sql.NAMES]))


@query(f"{CLEAN}, {feature_sql.BASE} SELECT trace_id, agent_id, {feature_sql.static_sql()} FROM f GROUP BY trace_id, agent_id")
def feat_static_all(spark, sf_dir):
    """All whole-object aggregates, a row for each object."""
    out = features.static_by_object(features.base_features(clean(spark, sf_dir).select(*features.INPUTS)))
    return rounded(out.select("trace_id", "agent_id", *[F.col(c).cast("double").alias(c) for c in out.columns if "__" in c]), 5)


#: Features of each family of aggregates, at all widths.
_WIDE_ROLLING = ("duration", "is_tool", "tool_compression")


@query(f"{CLEAN}, {feature_sql.BASE} {feature_sql.rolling_sql(_WIDE_ROLLING, features.WIDTHS)}")
def feat_rolling_wide(spark, sf_dir):
    """Rolling aggregates at all widths of production, for a feature of each family."""
    chosen = [f for f in features.definitions() if f.name in _WIDE_ROLLING]
    base = features.base_features(clean(spark, sf_dir).select(*features.INPUTS), chosen).select("trace_id", "agent_id", "start_time_ns", "span_id", *_WIDE_ROLLING)
    out = features.rolling_features(base, features.WIDTHS, chosen)
    names = [c for c in out.columns if any(c.startswith(f"{n}__") for n in _WIDE_ROLLING)]
    return rounded(out.select("trace_id", "span_id", *[F.col(c).cast("double").alias(c) for c in names]), 5)


@query(f"{CLEAN}, {feature_sql.BASE} {feature_sql.rolling_long_sql(features.WIDTHS)}")
def feat_rolling_all(spark, sf_dir):
    """All rolling aggregates of all features at all widths, as their means over the spans of each agent."""
    wanted = [f for f in features.definitions() if f.rolling]
    base = features.base_features(clean(spark, sf_dir).select(*features.INPUTS)).select("trace_id", "agent_id", "start_time_ns", "span_id", *[f.name for f in wanted])
    return rounded(features.rolling_means(base, ["agent_id"], features.WIDTHS, wanted), 5)


@query("SELECT o_orderkey, 'o_totalprice' AS \"column\" FROM orders WHERE o_orderkey % 977 = 0 AND o_orderkey % 1999 <> 0 UNION ALL SELECT o_orderkey, '__row' FROM orders WHERE o_orderkey % 1999 = 0")
def ml_run_differences(spark, sf_dir):
    """Two runs over one table that differ in some numbers, in noise below the tolerance, and in missing rows."""
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    noise = F.when(F.col("o_orderkey") % 977 == 0, 1.0).when(F.col("o_orderkey") % 2 == 0, 1e-7).otherwise(0.0)
    second = first.filter("o_orderkey % 1999 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + noise)
    return scoring.differences(first, second, ["o_orderkey"]).select("o_orderkey", "column")


# ---- preparation ----------------------------------------------------------------------

_WIDE = ["llm_total_tokens", "http_status_code", "start_time_ns", "end_time_ns", "meta_langgraph_step"]


@query(f"{WITH}, l AS (SELECT feature, v FROM (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _WIDE)} FROM spans) UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(_WIDE)}))), c AS (SELECT feature, v, count(*) AS n FROM l GROUP BY 1, 2) SELECT feature, round(max(n) / sum(n)::DOUBLE, 6) AS static FROM c GROUP BY 1")
def prep_static_rates(spark, sf_dir):
    return rounded(prep.static_rates(spans(spark, sf_dir), _WIDE))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr, 'l_quantity' AS neighbor, 'l_extendedprice' AS feature FROM lineitem UNION ALL SELECT round(corr(l_quantity, l_discount), 6), 'l_quantity', 'l_discount' FROM lineitem UNION ALL SELECT round(corr(l_discount, l_extendedprice), 6), 'l_extendedprice', 'l_discount' FROM lineitem")
def prep_correlations(spark, sf_dir):
    return rounded(gram.correlations(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_discount"]))


_HOLED = "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice::DOUBLE END AS price FROM orders"


@query(f"WITH h AS ({_HOLED}) SELECT o_orderkey, round(coalesce(price, avg(price) OVER (PARTITION BY o_orderpriority)), 4) AS mean, round(coalesce(price, median(price) OVER (PARTITION BY o_orderpriority)), 4) AS median FROM h")
def prep_filled_by_group(spark, sf_dir):
    """Missing prices by the mean and by the median of their priority."""
    price = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice").cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", price.alias("mean"), price.alias("median"))
    both = prep.filled(prep.filled(rows, ["mean"], "mean", ["o_orderpriority"]), ["median"], "median", ["o_orderpriority"])
    return rounded(both.select("o_orderkey", "mean", "median"), 4)


@query(f"{CLEAN} SELECT trace_id, agent_id, count(*)::INT AS n, list(end_time_ns - start_time_ns ORDER BY start_time_ns, span_id)[1] AS first, list(end_time_ns - start_time_ns ORDER BY start_time_ns, span_id)[-1] AS last, bool_or(status_code = 'STATUS_CODE_ERROR') AS is_anomaly FROM spans GROUP BY 1, 2")
def prep_sequences(spark, sf_dir):
    rows = clean(spark, sf_dir).withColumns({"v": F.col("end_time_ns") - F.col("start_time_ns"), "is_anomaly": F.col("status_code") == "STATUS_CODE_ERROR", "anomaly_type": F.col("aef_kind")})
    out = prep.sequences(rows, ["v"])
    return out.select("trace_id", "agent_id", F.size("v_sequence").alias("n"), F.element_at("v_sequence", 1).alias("first"), F.element_at("v_sequence", -1).alias("last"), "is_anomaly")


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT label, n, CASE WHEN label = 0 THEN floor(n * 0.7)::BIGINT ELSE 0 END AS train, CASE WHEN label = 0 THEN floor(n * 0.15)::BIGINT ELSE floor(n * 0.7)::BIGINT END AS val FROM n) SELECT label::VARCHAR AS label, split, c AS n FROM (SELECT label, 'train' AS split, train AS c FROM s UNION ALL SELECT label, 'val', val FROM s UNION ALL SELECT label, 'test', n - train - val FROM s) WHERE c > 0")
def prep_split_counts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.col("label").cast("string"))
    return prep.stratified_split(rows, "vec_id", "label", normal="0").groupBy("label", "split").agg(F.count("*").alias("n"))


def _norm_sql() -> str:
    pick = lambda e, q: f"list_sort(list({e}))[(round_even((count(*) - 1) * {q}, 0) + 1)::INT]"
    return f"""WITH l AS (SELECT unnest(embedding) AS x, unnest(range(len(embedding)))::INT AS dim FROM embeddings),
e AS (SELECT dim, {pick('x', 0.01)} AS low, {pick('x', 0.99)} AS high FROM l GROUP BY dim),
c AS (SELECT dim, low, high, greatest(least(x, high), low) AS x FROM l JOIN e USING (dim)),
s AS (SELECT dim, any_value(low) AS low, any_value(high) AS high, {pick('x', 0.5)} AS shift, {pick('x', 0.75)} - {pick('x', 0.25)} AS scale FROM c GROUP BY dim)
SELECT dim, round(low::DOUBLE, 5) AS low, round(high::DOUBLE, 5) AS high, round(shift::DOUBLE, 5) AS shift, round((CASE WHEN scale < 1e-6 THEN 1 ELSE scale END)::DOUBLE, 5) AS scale FROM s"""


@query(_norm_sql())
def prep_normaliser(spark, sf_dir):
    out = prep.dimension_stats(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    return out.select("dim", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("low", "high", "shift", "scale")])


@query(_norm_sql().split("SELECT dim, round(low")[0] + """SELECT vec_id, d.dim, round((x::DOUBLE - shift::DOUBLE) / (CASE WHEN scale < 1e-6 THEN 1 ELSE scale END)::DOUBLE, 5) AS x
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding)))::INT AS dim FROM embeddings) d JOIN s USING (dim)""")
def prep_normalised(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = prep.normalised(rows, "embedding", prep.dimension_stats(rows, "embedding"))
    return rounded(out.select("vec_id", F.posexplode("embedding").alias("dim", "x")), 5)


# ---- augmentation ---------------------------------------------------------------------


@query(f"{CLEAN}, l AS (SELECT trace_id, span_id, (row_number() OVER (PARTITION BY trace_id ORDER BY start_time_ns, span_id) - 1)::INT AS step, {augment.class_sql('trace_id')} AS anomaly_type FROM spans) SELECT *, round(CASE WHEN anomaly_type = 'NonAnomaly' THEN 0 ELSE 0.3 + 0.7 * {u01_sql('trace_id', 'severity')} END, 6) AS anomaly_severity, (anomaly_type <> 'NonAnomaly')::INT AS class FROM l")
def aug_tagged(spark, sf_dir):
    return rounded(augment.tagged(clean(spark, sf_dir)).select("trace_id", "span_id", "step", "anomaly_type", "anomaly_severity", "class"))


_AT = f"(floor({u01_sql('k', 'place')} * length(text)) + 1)::INT"
_HEAD, _TAIL = f"substr(text, 1, {_AT} - 1)", f"substr(text, {_AT})"


@query(f"WITH d AS (SELECT doc_id, doc_id::VARCHAR AS k, text FROM documents), r AS (SELECT doc_id, CASE floor({u01_sql('k', 'recipe')} * 4)::INT WHEN 0 THEN {_HEAD} || '#' || substr({_TAIL}, 2) WHEN 1 THEN {_HEAD} || repeat(substr({_TAIL}, 1, 8), 3) || {_TAIL} WHEN 2 THEN {_HEAD} || ' lorem ipsum ' || {_TAIL} ELSE {_HEAD} || array_to_string(list_reverse(string_split({_TAIL}, '')), '') END AS text FROM d) SELECT doc_id, md5(text) AS md5, length(text) AS n FROM r")
def aug_text_noise(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", augment.corrupted(F.col("text"), F.col("doc_id").cast("string")).alias("t")).select("doc_id", F.md5("t").alias("md5"), F.length("t").cast("long").alias("n"))


@query("WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings WHERE label IN (0, 1)), d AS (SELECT dim, avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label = 0) AS d FROM l GROUP BY dim) SELECT list_transform(list(d / n ORDER BY dim), lambda x: round(x, 6)) AS direction FROM d, (SELECT sqrt(sum(d * d)) AS n FROM d)")
def aug_direction(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return augment.mean_direction(rows, "embedding", "label", 1, 0).select(F.transform("direction", lambda x: F.round(x, 6)).alias("direction"))


@query()
def aug_copula_shift(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("amount", u01(F.col("vec_id").cast("string"), "tau"))
    return augment.copula_shift(rows, "label", "embedding", "amount")


@query("WITH r AS (SELECT quality, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM labels JOIN documents USING (doc_id)) SELECT round((sum(rk) FILTER (WHERE quality = 1) - (count(*) FILTER (WHERE quality = 1))::DOUBLE * (count(*) FILTER (WHERE quality = 1) + 1) / 2) / ((count(*) FILTER (WHERE quality = 1))::DOUBLE * count(*) FILTER (WHERE quality = 0)), 6) AS auc FROM r")
def aug_rank_auc(spark, sf_dir):
    return rounded(augment.rank_auc(_scored(spark, sf_dir), "n_chars", "quality"))


# ---- scoring --------------------------------------------------------------------------


def _scored(spark, sf_dir) -> DataFrame:
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id")


_METRICS = """tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn + 1e-8), 6) AS accuracy, round(tp / (tp + fp + 1e-8), 6) AS precision, round(tp / (tp + fn + 1e-8), 6) AS recall, round(tn / (tn + fp + 1e-8), 6) AS specificity,
round(2 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8)) / (tp / (tp + fp + 1e-8) + tp / (tp + fn + 1e-8) + 1e-8), 6) AS f1, round(tp / (tp + fn + 1e-8) + tn / (tn + fp + 1e-8) - 1, 6) AS youden"""
_S = "s AS (SELECT quality, toxic, n_chars::DOUBLE AS e FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_S}, g AS (SELECT min(e) AS low, max(e) AS high FROM s), t AS (SELECT i::INT AS i, low + i * ((high - low) / 49) AS threshold FROM g, range(50) r(i)), c AS (SELECT i, threshold, count(*) FILTER (WHERE quality = 1 AND e > threshold) AS tp, count(*) FILTER (WHERE quality = 0 AND e > threshold) AS fp, count(*) FILTER (WHERE quality = 1 AND e <= threshold) AS fn, count(*) FILTER (WHERE quality = 0 AND e <= threshold) AS tn FROM t, s GROUP BY ALL) SELECT i, round(threshold, 6) AS threshold, {_METRICS} FROM c")
def ml_threshold_sweep(spark, sf_dir):
    return rounded(scoring.threshold_sweep(_scored(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", "quality", 50))


@query(f"WITH {_S}, g AS (SELECT min(e) AS low, max(e) AS high FROM s), t AS (SELECT i::INT AS i, low + i * ((high - low) / 9999) AS threshold FROM g, range(10000) r(i)), c AS (SELECT i, threshold, count(*) FILTER (WHERE quality = 1 AND e > threshold) AS tp, count(*) FILTER (WHERE quality = 0 AND e > threshold) AS fp, count(*) FILTER (WHERE quality = 1 AND e <= threshold) AS fn, count(*) FILTER (WHERE quality = 0 AND e <= threshold) AS tn FROM t, s GROUP BY ALL) SELECT i, round(threshold, 6) AS threshold, {_METRICS} FROM c")
def ml_threshold_sweep_all(spark, sf_dir):
    """As many thresholds as the detector tries."""
    return rounded(scoring.threshold_sweep(_scored(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", "quality", 10_000))


@query(f"WITH {_S}, c AS (SELECT count(*) FILTER (WHERE quality = 1 AND p) AS tp, count(*) FILTER (WHERE quality = 0 AND p) AS fp, count(*) FILTER (WHERE quality = 1 AND NOT p) AS fn, count(*) FILTER (WHERE quality = 0 AND NOT p) AS tn FROM (SELECT *, e > 1000 AS p FROM s)) SELECT {_METRICS} FROM c")
def ml_binary_metrics(spark, sf_dir):
    return rounded(scoring.evaluate(_scored(spark, sf_dir).withColumn("p", (F.col("n_chars") > 1000).cast("int")), "quality", "p"))


@query(f"WITH {_S}, m AS (SELECT median(e) AS median FROM s) SELECT median, (SELECT median(abs(e - m.median)) FROM s, m) AS mad FROM m")
def ml_robust_stats(spark, sf_dir):
    return scoring.robust_stats(_scored(spark, sf_dir), "n_chars")


@query("WITH p AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), c AS (SELECT DISTINCT unnest([t, p]) AS c FROM p), m AS (SELECT c, coalesce(sum(n) FILTER (WHERE t = c AND p = c), 0) AS tp, coalesce(sum(n) FILTER (WHERE t = c), 0) AS support, coalesce(sum(n) FILTER (WHERE p = c), 0) AS said FROM c, p GROUP BY c) SELECT c AS label, round(tp / (said + 1e-8), 6) AS precision, round(tp / (support + 1e-8), 6) AS recall, round(2 * (tp / (said + 1e-8)) * (tp / (support + 1e-8)) / (tp / (said + 1e-8) + tp / (support + 1e-8) + 1e-8), 6) AS f1, support::BIGINT AS support FROM m")
def ml_multiclass(spark, sf_dir):
    return rounded(scoring.multiclass(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic"))


@query(f"WITH {_S} SELECT quality, round(greatest(p, 1 - p), 6) AS confidence, round(p, 6) AS p_anomaly, e + 250 > 2000 AS is_anomaly, n FROM (SELECT quality, e, count(*) AS n, 1 / (1 + exp(-(0.2::DOUBLE * ((e - 1500) / (1.4826 * 900 + 1e-8) - 2) + 0.2 * ((e / 2 - 700) / (1.4826 * 400 + 1e-8) - 2) + 0.6 * (e + 250 - 2000) / (500 + 1e-8)))) AS p FROM s GROUP BY quality, e)")
def ml_confidence(spark, sf_dir):
    e = F.col("n_chars").cast("double")
    c = scoring.confidence(e, e / 2, e + 250, (1500.0, 900.0), (700.0, 400.0), 2000.0, 500.0)
    rows = _scored(spark, sf_dir).groupBy("quality", "n_chars").agg(F.count("*").alias("n"))
    return rounded(rows.select("quality", c["confidence"].alias("confidence"), c["p_anomaly"].alias("p_anomaly"), c["is_anomaly"].alias("is_anomaly"), "n"))


@query()
def ml_reconstruction(spark, sf_dir):
    return scoring.reconstruction_error(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding").select("vec_id", "label", "error")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY " + u01_sql("doc_id::VARCHAR", "fold") + ", doc_id) - 1 AS pos FROM (SELECT DISTINCT doc_id FROM documents)) SELECT doc_id, (pos % 5)::INT AS fold FROM r")
def ml_balanced_folds(spark, sf_dir):
    return stacking.balanced_folds(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").distinct(), "doc_id")


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 0 END::INT AS code FROM documents")
def ml_encoded_labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", stacking.encoded(F.col("lang"), ["en", "de", "fr"]).alias("code"))


@query()
def ml_stacked_classes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    names = sorted(r[0] for r in rows.select("label").distinct().collect() if r[0] is not None)  # a row for each class
    stack = stacking.fit_stack(rows, "embedding", "label", "vec_id", names, k=3)
    return stack.classify(rows, "embedding").drop("embedding")


# ---- separability ---------------------------------------------------------------------


@query()
def sep_density(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return separability.density_nll(rows, "embedding", F.col("label") == 0).select("vec_id", "label", "nll")


@query(f"WITH d AS (SELECT source, n_chars FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL), a AS (SELECT min(source) AS base FROM d), n AS (SELECT n_chars FROM d, a WHERE source = base), c AS (SELECT source, n_chars FROM d, a WHERE source <> base) SELECT source AS label, count(DISTINCT c.i) AS n, round(avg(CASE WHEN c.n_chars > n.n_chars THEN 1.0 WHEN c.n_chars = n.n_chars THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS auc, round(avg(CASE WHEN c.n_chars > n.n_chars THEN 1.0 WHEN c.n_chars = n.n_chars THEN 0.5 ELSE 0.0 END::DOUBLE), 6) BETWEEN {separability.BAND[0]} AND {separability.BAND[1]} AS in_band FROM (SELECT *, row_number() OVER () AS i FROM c) c, n GROUP BY source")
def sep_auc_by_class(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.agg(F.min("source")).first()[0]
    return separability.gate(rounded(separability.auc_by_class(docs, "n_chars", "source", base)))


@query(f"WITH {_S}, a AS (SELECT e FROM s WHERE quality = 1), b AS (SELECT e FROM s WHERE quality = 0) SELECT round(2 * (SELECT avg(abs(a.e - b.e)) FROM a, b) - (SELECT avg(abs(a.e - x.e)) FROM a, a x) - (SELECT avg(abs(b.e - x.e)) FROM b, b x), 6) AS energy")
def sep_energy(spark, sf_dir):
    return rounded(separability.energy_distance(_scored(spark, sf_dir), "n_chars", "quality"))


@query()
def sep_coupling(spark, sf_dir):
    halves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    weight, covariance = separability.coupling(halves, "a", "b")
    return separability.inflated(halves, "a", "b", weight, covariance, F.lit(3.0)).select("vec_id", "b")


# ---- reports --------------------------------------------------------------------------


@query(f"WITH {_S} SELECT e AS error, CASE WHEN quality = 1 THEN 'anomaly' ELSE 'normal' END AS label FROM s")
def rep_errors(spark, sf_dir):
    return reports.errors(_scored(spark, sf_dir), "n_chars", "quality")


@query(f"WITH {_S}, g AS (SELECT * FROM (VALUES ('anomaly'), ('normal')) a(actual), (VALUES ('anomaly'), ('normal')) p(predicted)) SELECT actual, predicted, count(e) AS count FROM g LEFT JOIN s ON (quality = 1) = (actual = 'anomaly') AND (e > 1000) = (predicted = 'anomaly') AND quality IN (0, 1) GROUP BY ALL")
def rep_confusion(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("p", (F.col("n_chars") > 1000).cast("int"))
    return reports.confusion_long(rows.agg(*scoring.confusion(F.col("quality"), F.col("p"))))


@query(f"WITH {ORACLES['ml_threshold_sweep'].removeprefix('WITH ').replace(') SELECT i, round(threshold', '), w AS (SELECT i, round(threshold')}) SELECT threshold, metric, score FROM (UNPIVOT (SELECT threshold, f1, recall, precision FROM w) ON f1, recall, precision INTO NAME metric VALUE score)")
def rep_sweep(spark, sf_dir):
    return reports.sweep_long(ml_threshold_sweep(spark, sf_dir), ["f1", "recall", "precision"])


@query("SELECT n_chars::DOUBLE AS value, coalesce(lang, 'none') AS \"group\" FROM documents")
def rep_grouped(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs = [r[0] for r in docs.select("lang").distinct().collect()]  # a row for each language
    return reports.grouped({g or "none": docs.filter(F.col("lang").eqNullSafe(g)) for g in langs}, "n_chars")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness of each agent."""
    return readiness.assess(spans(spark, sf_dir), DEMO, agent())
