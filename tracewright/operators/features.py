"""Features of spans and traces: 52 definitions, whole-object and rolling windows.

A definition has an expression, whether it is log-scaled, and which aggregates follow.
Stage 2 sees the columns of stage 1. The object is (trace_id, agent_id); rolling frames
order by (start_time_ns, span_id); they are worked out block by block, see ``rolling``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.stats import distinct_with_null, signed_log1p
from tracewright.operators import scans
from tracewright.operators.rolling import rolled, rolled_means
from tracewright.sources.spec import KINDS

OBJECT = ("trace_id", "agent_id")
#: Columns of spans that the features are made of; rows that bring no others are moved at less cost.
INPUTS = (*OBJECT, "span_id", "start_time_ns", "end_time_ns", "status_code", "aef_kind", "span_name", "input_text", "output_text", "llm_total_tokens")
WIDTHS = (3, 5, 10, 30, 50, 100, 500, 1000)
QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95)
EPS = 1e-8
# Text patterns.
PATTERNS = {
    "sentence": r"[.!?]+",
    "punctuation": r"[.,!?:;–—()\[\]{}«»\'\']",
    "uppercase": r"[А-ЯA-Z]",
    "digit": r"\d",
    "special_char": r"[^а-яА-Яa-zA-Z0-9\s]",
}
ERROR = r"\b(error|exception|fail|ошибка)\b"


@dataclass(frozen=True)
class Feature:
    """name, expression, stage, log scale, and the families of aggregates that follow."""

    name: str
    column: Column
    stage: int = 1
    log: bool = False
    static: tuple[str, ...] = ()
    rolling: tuple[str, ...] = ()


ALL = ("max", "min", "mean", "std", "sum", "q")
MEAN, NO_SUM = ("mean",), ("max", "min", "mean", "std", "q")
_COUNTS = tuple(f"{prefix}{k}_count" for prefix in ("exec_out_", "", "prompt_") for k in ("char", "word", *PATTERNS))
#: Families of aggregates by feature: over the whole object, over rolling frames.
AGGREGATES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    **{k: (ALL, ALL) for k in ("total_duration", "duration", "duration_diff", "delta_time", "exec_gap", "llm_tokens", "llm_duration", "tool_duration", *_COUNTS)},
    **{k: (MEAN, MEAN) for k in ("tool_success", "is_llm", "is_tool", "is_chain", "error_flag")},
    **{k: (NO_SUM, NO_SUM) for k in ("tool_compression", "avg_word_length_sem")},
    "token_ratio": (("mean", "std"), ()),
    "unique_tools_local": ((), ALL),
}


def _counts(prefix: str, text: str, stage: int) -> list[Feature]:
    c = F.col(text)
    out = [("char", F.char_length(c)), ("word", F.size(F.split(c, " ")))] + [(k, F.regexp_count(c, F.lit(p))) for k, p in PATTERNS.items()]
    return [Feature(f"{prefix}{k}_count", v, stage, True) for k, v in out]


def _entropy() -> Column:
    parts = [F.col(f"__k_{k}") / F.col("__n") for k in KINDS]
    return reduce(add, [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in parts])


def _tool() -> Column:
    return F.when(F.col("aef_kind") == "tool", F.col("span_name"))


#: Features that need the row before in the object or trace, the trace as a whole, or features of the trace as a whole.
LOOK_BACK = {"delta_time", "exec_gap", "is_repeat", "unique_tools_local", "time_gap_variance", "repetitive_actions", "cv_delta"}
OF_TRACE = {"final_output_length", "unique_agents", "actions_per_agent", "unique_tools_global", "action_entropy"}
OVER_TRACE = {"time_gap_variance", "iteration_duration_variance", "repetitive_actions", "processing_time_variance", "cv_duration", "cv_delta"}


def _with_look_back(spans: DataFrame, names: set[str]) -> DataFrame:
    """What the named features need of __before (start and end of the span before in its object), __kind_before (in its trace), __first_use and __tools_upto, by ranges of the order."""
    rows = scans.dealt(spans, ["trace_id", "start_time_ns", "span_id"])
    if names & {"delta_time", "exec_gap"}:
        rows = scans.last_before(rows, list(OBJECT), F.struct("start_time_ns", "end_time_ns"), "__before")
    if "is_repeat" in names:
        rows = scans.last_before(rows, ["trace_id"], F.col("aef_kind"), "__kind_before")
    if "unique_tools_local" in names:
        rows = scans.first_of(rows.withColumn("__tool", _tool()), [*OBJECT, "__tool"], "__first_use").drop("__tool")
        rows = scans.sums_upto(rows, list(OBJECT), {"__tools_upto": F.col("__first_use")})
    return rows.drop("__range", "__place")


def _with_trace(spans: DataFrame) -> DataFrame:
    """Counts and last output of the trace beside each span."""
    last = F.max_by(F.struct("output_text"), F.struct("agent_id", "start_time_ns", "span_id"))
    few = spans.groupBy("trace_id", "agent_id", "aef_kind", _tool().alias("__tool")).agg(F.count("*").alias("n"), last.alias("last"), F.max(F.struct("agent_id", "start_time_ns", "span_id")).alias("at"))
    whole = few.groupBy("trace_id").agg(
        F.sum("n").alias("__n"), distinct_with_null(F.col("agent_id")).alias("__agents"), distinct_with_null(F.col("__tool")).alias("__tools"),
        F.max_by("last", "at")["output_text"].alias("__last_output"), *[F.coalesce(F.sum(F.when(F.col("aef_kind") == k, F.col("n"))), F.lit(0)).alias(f"__k_{k}") for k in KINDS],
    )
    return scans.matched(spans, whole, ["trace_id"])


def _with_features_of_trace(frame: DataFrame, names: set[str]) -> DataFrame:
    """Variances, means and sums of features over the trace beside each span."""
    per_token = F.col("llm_duration") / (F.col("llm_tokens") + EPS) if "processing_time_variance" in names else None
    made = {
        "time_gap_variance": {"__var_gap": lambda: F.var_samp("delta_time")}, "iteration_duration_variance": {"__var_took": lambda: F.var_samp("duration")},
        "repetitive_actions": {"__repeats": lambda: F.sum("is_repeat")}, "processing_time_variance": {"__dev_token": lambda: F.stddev_samp(per_token)},
        "cv_duration": {"__cv_took": lambda: F.stddev_samp("duration") / (F.avg("duration") + EPS)}, "cv_delta": {"__cv_gap": lambda: F.stddev_samp("delta_time") / (F.avg("delta_time") + EPS)},
    }
    wanted = {k: v() for n in names for k, v in made[n].items()}
    return scans.matched(frame, frame.groupBy("trace_id").agg(*[v.alias(k) for k, v in wanted.items()]), ["trace_id"])


def definitions() -> list[Feature]:
    """The 52 features. ``duration_diff`` is always 0 and ``total_duration`` equals ``duration``, as they always were."""
    start, end = F.col("start_time_ns"), F.col("end_time_ns")
    llm, tool = F.col("aef_kind") == "llm", F.col("aef_kind") == "tool"
    said, asked = F.col("output_text"), F.col("input_text")
    took, zero = end - start, F.lit(0)
    repeat = F.coalesce((F.col("__kind_before") == F.col("aef_kind")).cast("int"), zero)
    out = [
        Feature("total_duration", took, log=True), Feature("duration", took, log=True), Feature("duration_diff", F.lit(0.0), log=True),
        Feature("delta_time", F.coalesce(start - F.col("__before.start_time_ns"), zero), log=True),
        Feature("exec_gap", F.coalesce(start - F.col("__before.end_time_ns"), zero), log=True),
        Feature("llm_tokens", F.when(llm, F.col("llm_total_tokens")).otherwise(zero), log=True),
        Feature("llm_duration", F.when(llm, took).otherwise(zero), log=True),
        Feature("token_ratio", F.when(llm & (F.length(said) > 0), F.length(asked) / F.length(said)).otherwise(0.0)),
        Feature("tool_duration", F.when(tool, took).otherwise(zero), log=True),
        Feature("tool_success", F.when(tool, (F.col("status_code") == "STATUS_CODE_OK").cast("int")).otherwise(zero)),
        Feature("sem_text", F.coalesce(said, F.lit(""))), Feature("agent_prompt", F.coalesce(asked, F.lit(""))),
        *_counts("exec_out_", "output_text", 1),
        *[Feature(f"is_{k}", (F.col("aef_kind") == k).cast("int")) for k in ("llm", "tool", "chain")],
        Feature("tool_compression", F.when(tool, F.length(said) / (F.length(asked) + EPS)).otherwise(-1.0), log=True),
        Feature("final_output_length", F.length("__last_output"), log=True),
        Feature("unique_agents", F.col("__agents")), Feature("actions_per_agent", F.col("__n") / F.col("__agents"), log=True),
        Feature("unique_tools_global", F.col("__tools")), Feature("action_entropy", _entropy()), Feature("is_repeat", repeat),
        Feature("unique_tools_local", F.col("__tools_upto"), 2),
        Feature("error_flag", F.lower("sem_text").rlike("(?U)" + ERROR).cast("int"), 2),
        *_counts("", "sem_text", 2), *_counts("prompt_", "agent_prompt", 2),
        Feature("avg_word_length_sem", F.aggregate(F.split("sem_text", " "), F.lit(0), lambda a, w: a + F.char_length(w)) / F.size(F.split("sem_text", " ")), 2, True),
        Feature("time_gap_variance", F.col("__var_gap"), 2), Feature("iteration_duration_variance", F.col("__var_took"), 2), Feature("repetitive_actions", F.col("__repeats"), 2),
        Feature("processing_time_variance", F.col("__dev_token"), 2), Feature("cv_duration", F.col("__cv_took"), 2, True), Feature("cv_delta", F.col("__cv_gap"), 2, True),
    ]
    return [replace(f, static=AGGREGATES[f.name][0], rolling=AGGREGATES[f.name][1]) if f.name in AGGREGATES else f for f in out]


def _aggregate(kind: str, c: Column) -> list[tuple[str, Column]]:
    if kind == "q":
        every = F.percentile(c, list(QUANTILES))  # one expression, so that values are counted once for all of them
        return [(f"q{round(q * 100)}", every[i]) for i, q in enumerate(QUANTILES)]
    return [(kind, {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[kind](c))]


#: What features of the trace as a whole are made of.
_MADE_OF = {"time_gap_variance": {"delta_time"}, "iteration_duration_variance": {"duration"}, "repetitive_actions": {"is_repeat"}, "processing_time_variance": {"llm_duration", "llm_tokens"}, "cv_duration": {"duration"}, "cv_delta": {"delta_time"}}


def base_features(spans: DataFrame, features: list[Feature] | None = None) -> DataFrame:
    """The spans with the plain column of every feature.

    No window spans a trace: rows look back by ranges of their order, and what belongs to a trace is
    grouped and joined. Only what the features need is worked out.
    """
    features = features or definitions()
    names, columns = {f.name for f in features}, spans.columns
    over = names & OVER_TRACE
    if lacking := set().union(*(_MADE_OF[n] for n in over)) - names:
        raise ValueError(f"features are made of {sorted(lacking)}")
    out = _with_look_back(spans, names) if names & LOOK_BACK else spans
    out = _with_trace(out) if names & OF_TRACE else out
    for stage in (1, 2):
        if stage == 2 and over:
            out = _with_features_of_trace(out, over)
        out = out.withColumns({f.name: signed_log1p(f.column.cast("double")) if f.log else f.column for f in features if f.stage == stage})
    return out.select(*columns, *[f.name for f in features if f.name not in columns])


def static_by_object(frame: DataFrame, features: list[Feature] | None = None) -> DataFrame:
    """Whole-object aggregates, a row for each object."""
    features = features or definitions()
    return frame.groupBy(*OBJECT).agg(*[a.alias(f"{f.name}__{k}") for f in features for kind in f.static for k, a in _aggregate(kind, F.col(f.name))])


def static_features(frame: DataFrame, features: list[Feature] | None = None) -> DataFrame:
    """Whole-object aggregates beside each span."""
    return scans.matched(frame, static_by_object(frame, features), list(OBJECT))


def rolling_features(frame: DataFrame, widths=WIDTHS, features: list[Feature] | None = None, long: bool = False) -> DataFrame:
    """Aggregates over the last ``w`` spans of the object for each width; in the ``long`` form a row for each span, feature and width."""
    wanted = {f.name: f.rolling for f in features or definitions() if f.rolling}
    return rolled(frame, list(OBJECT), ["start_time_ns", "span_id"], wanted, widths, QUANTILES, long)


def rolling_means(frame: DataFrame, by: list[str], widths=WIDTHS, features: list[Feature] | None = None) -> DataFrame:
    """by, feature, width, n and the mean of each rolling aggregate over the spans of each group."""
    wanted = {f.name: f.rolling for f in features or definitions() if f.rolling}
    return rolled_means(frame, list(OBJECT), ["start_time_ns", "span_id"], wanted, widths, QUANTILES, by)


def expand(spans: DataFrame, widths=WIDTHS, features: list[Feature] | None = None, keep: tuple[str, ...] = (*OBJECT, "start_time_ns", "span_id")) -> DataFrame:
    """Columns to keep, every feature, its whole-object aggregates and its rolling ones: 2,943 numbers from the 52 definitions at eight widths."""
    features = features or definitions()
    base = base_features(spans, features).select(*dict.fromkeys((*OBJECT, "start_time_ns", "span_id", *keep)), *[f.name for f in features if f.name not in keep])
    return rolling_features(static_features(base, features), widths, features)
