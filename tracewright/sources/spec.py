"""The span specification: 46 attributes, their sentinels and rules.

A rule is written once and read twice: as a Spark ``Column`` and as SQL text, which
tests and oracles use. Users may append attributes of their own.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and category lists of the specification.
BASE64 = r"^[A-Za-z0-9+/]+={0,2}$"
ELEMENT = r"^C[IE][0-9]+$"
VERSION = r"^([0-9]+|\?)\.([0-9]+|\?)\.([0-9]+|\?)$"
JSON_STRINGS = r'^\[\s*"([^"\\]|\\.)*"(\s*,\s*"([^"\\]|\\.)*")*\s*\]$'
JSON_LIKE = r"^\s*(\{[\s\S]*\}|\[[\s\S]*\])\s*$"
STATUS = ("STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR")
KINDS = ("llm", "start_agent", "chain", "tool", "retriever", "input_request", "output_request", "kafka_produce", "kafka_consume", "other", "guard")
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
EMPTY = {"string": "", "bigint": -1, "float": -1.0, "boolean": False}
TRASH = {"string": "TRASH", "bigint": -2, "float": -2.0, "boolean": None}
ROLES = {"root": "root", "outside": "outside", "unset": "STATUS_CODE_UNSET", "none": "NONE"}


def quoted(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


@dataclass(frozen=True)
class Rule:
    """A condition as a Column and as SQL."""

    make: Callable[[], Column]
    sql: str

    @property
    def column(self) -> Column:
        return self.make()

    def __or__(self, other: Rule) -> Rule:
        return Rule(lambda: self.column | other.column, f"({self.sql} OR {other.sql})")

    def __and__(self, other: Rule) -> Rule:
        return Rule(lambda: self.column & other.column, f"({self.sql} AND {other.sql})")

    def __invert__(self) -> Rule:
        return Rule(lambda: ~self.column, f"(NOT {self.sql})")


def compare(name: str, op: str, value) -> Rule:
    test = {"=": operator.eq, ">=": operator.ge, "<=": operator.le}[op]
    return Rule(lambda: test(F.col(name), value), f"({name} {op} {quoted(value)})")


def matches(name: str, pattern: str) -> Rule:
    java = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern  # Java's $ also matches before a last line end
    return Rule(lambda: F.col(name).rlike(java), f"regexp_matches({name}, {quoted(pattern)})")


def among(name: str, values) -> Rule:
    return Rule(lambda: F.col(name).isin(*values), f"({name} IN ({', '.join(map(quoted, values))}))")


def filled(name: str) -> Rule:
    return Rule(lambda: F.length(name) > 0, f"(length({name}) > 0)")


def between(name: str, low, high) -> Rule:
    return Rule(lambda: F.col(name).between(low, high), f"({name} BETWEEN {low} AND {high})")


def at_least(a: str, b: str) -> Rule:
    return Rule(lambda: F.col(a) >= F.col(b), f"({a} >= {b})")


ALWAYS = Rule(lambda: F.lit(True), "true")


def if_else(test: Rule, yes: Rule, no: Rule) -> Rule:
    return Rule(lambda: F.when(test.column, yes.column).otherwise(no.column), f"(CASE WHEN {test.sql} THEN {yes.sql} ELSE {no.sql} END)")


IS_LLM = compare("aef_kind", "=", "llm")
IS_HTTP = among("aef_kind", ("input_request", "output_request"))
IS_KAFKA = among("aef_kind", ("kafka_produce", "kafka_consume"))
IS_CONSUME = compare("aef_kind", "=", "kafka_consume")
IS_ERROR = compare("status_code", "=", "STATUS_CODE_ERROR")


@dataclass(frozen=True)
class Attribute:
    """One column of the specification."""

    name: str
    group: str
    type: str
    role: str | None
    mandatory: bool
    rule: Rule
    domain: tuple[str, ...] | None = None

    @property
    def empty(self):
        return None if self.role is None else EMPTY[self.type] if self.role == "unknown" else ROLES[self.role]

    @property
    def trash(self):
        return TRASH[self.type]

    @property
    def validity(self) -> Column:
        return F.col(self.name).isNotNull() & self.rule.column

    @property
    def violation(self) -> Column:
        """A rule without an outcome counts as broken."""
        return F.coalesce(~self.validity, F.lit(True))

    @property
    def missing(self) -> Column:
        c = F.col(self.name)
        return c.isNull() if self.empty is None else F.coalesce(c.isNull() | (c == F.lit(self.empty)), F.lit(False))

    @property
    def spoilt(self) -> Column:
        return F.lit(False) if self.trash is None else F.coalesce(F.col(self.name) == F.lit(self.trash), F.lit(False))

    @property
    def real(self) -> Column:
        """The value, or null where it is the empty sentinel."""
        c = F.col(self.name)
        return c if self.empty is None else F.when(c != F.lit(self.empty), c)

    @property
    def violation_sql(self) -> str:
        return f"coalesce(NOT ({self.name} IS NOT NULL AND {self.rule.sql}), true)"

    @property
    def missing_sql(self) -> str:
        return f"({self.name} IS NULL)" if self.empty is None else f"coalesce({self.name} IS NULL OR {self.name} = {quoted(self.empty)}, false)"

    @property
    def spoilt_sql(self) -> str:
        return "false" if self.trash is None else f"coalesce({self.name} = {quoted(self.trash)}, false)"


def _for_kind(test: Rule, name: str, rule: Rule, empty) -> Rule:
    return if_else(test, rule, compare(name, "=", empty))


def _build() -> tuple[Attribute, ...]:
    out: list[Attribute] = []

    def add(name, group, type_, role, rule, mandatory=False, domain=None):
        out.append(Attribute(name, group, type_, role, mandatory, rule, domain))

    add("trace_id", "id", "string", None, matches("trace_id", BASE64), True)
    add("span_id", "id", "string", None, matches("span_id", BASE64), True)
    for name, role in (("parent_span_id", "root"), ("origin_span_id", "outside")):
        add(name, "id", "string", role, matches(name, BASE64) | compare(name, "=", ROLES[role]), True)
    add("agent_id", "id", "string", None, matches("agent_id", ELEMENT), True)
    add("session_id", "id", "string", None, matches("session_id", BASE64), True)
    add("start_time_ns", "time", "bigint", None, compare("start_time_ns", ">=", 0), True)
    add("end_time_ns", "time", "bigint", None, at_least("end_time_ns", "start_time_ns"), True)
    add("status_code", "status", "string", "unset", among("status_code", STATUS), domain=STATUS)
    add("status_message", "status", "string", "unknown", if_else(IS_ERROR, filled("status_message"), compare("status_message", "=", "")))
    add("aef_kind", "classification", "string", None, among("aef_kind", KINDS), True, KINDS)
    add("span_name", "classification", "string", None, filled("span_name"))
    add("input_text", "text_data", "string", "unknown", compare("input_text", "=", "") | matches("input_text", JSON_LIKE), True)
    add("output_text", "text_data", "string", "unknown", ALWAYS, True)
    add("llm_model", "LLM", "string", "unknown", _for_kind(IS_LLM, "llm_model", filled("llm_model"), ""))
    for name in ("llm_prompt_tokens", "llm_completion_tokens", "llm_total_tokens", "llm_precached_prompt_tokens"):
        add(name, "LLM", "bigint", "unknown", _for_kind(IS_LLM, name, compare(name, ">=", 0), -1))
    add("llm_temperature", "LLM", "float", "unknown", _for_kind(IS_LLM, "llm_temperature", compare("llm_temperature", ">=", 0.0), -1.0))
    add("llm_top_p", "LLM", "float", "unknown", _for_kind(IS_LLM, "llm_top_p", between("llm_top_p", 0.0, 1.0), -1.0))
    add("llm_max_tokens", "LLM", "bigint", "unknown", _for_kind(IS_LLM, "llm_max_tokens", compare("llm_max_tokens", ">=", 0), -1))
    add("llm_repetition_penalty", "LLM", "float", "unknown", _for_kind(IS_LLM, "llm_repetition_penalty", compare("llm_repetition_penalty", ">=", 1.0), -1.0))
    for name in ("llm_profanity_check", "llm_stream"):
        add(name, "LLM", "boolean", "unknown", _for_kind(IS_LLM, name, among(name, (True, False)), False))
    add("http_method", "HTTP", "string", "none", _for_kind(IS_HTTP, "http_method", among("http_method", METHODS), "NONE"), domain=(*METHODS, "NONE"))
    add("http_path", "HTTP", "string", "unknown", _for_kind(IS_HTTP, "http_path", filled("http_path"), ""))
    add("http_status_code", "HTTP", "bigint", "unknown", _for_kind(IS_HTTP, "http_status_code", between("http_status_code", 100, 599), -1))
    for name in ("request_headers", "response_headers"):
        add(name, "HTTP", "string", "unknown", _for_kind(IS_HTTP, name, matches(name, JSON_LIKE), ""))
    for name in ("kafka_topic", "kafka_cluster"):
        add(name, "Kafka", "string", "unknown", _for_kind(IS_KAFKA, name, filled(name), ""))
    add("kafka_consumer_group", "Kafka", "string", "unknown", _for_kind(IS_CONSUME, "kafka_consumer_group", filled("kafka_consumer_group"), ""))
    add("kafka_bootstrap_servers", "Kafka", "string", "unknown", _for_kind(IS_KAFKA, "kafka_bootstrap_servers", matches("kafka_bootstrap_servers", JSON_STRINGS), ""))
    add("meta_langgraph_step", "LangGraph_meta", "bigint", "unknown", compare("meta_langgraph_step", ">=", -1))
    add("meta_langgraph_node", "LangGraph_meta", "string", "unknown", ALWAYS)
    for name in ("meta_langgraph_triggers", "meta_langgraph_path"):
        add(name, "LangGraph_meta", "string", "unknown", compare(name, "=", "") | matches(name, JSON_STRINGS))
    add("meta_checkpoint_ns", "LangGraph_meta", "string", "unknown", ALWAYS)
    add("meta_tags", "LangGraph_meta", "string", "unknown", compare("meta_tags", "=", "") | matches("meta_tags", JSON_STRINGS))
    add("meta_extra", "LangGraph_meta", "string", "unknown", compare("meta_extra", "=", "") | matches("meta_extra", JSON_LIKE))
    add("service_name", "service", "string", "unknown", ALWAYS)
    add("service_version", "service", "string", "unknown", ALWAYS)
    for name in ("session_id_derived", "session_id_generated"):
        both = compare("session_id_derived", "=", True) & compare("session_id_generated", "=", True)
        add(name, "meta_attrs", "boolean", None, ~both, True)
    add("nexus_distrib_ver", "service", "string", None, matches("nexus_distrib_ver", VERSION))
    return tuple(out)


SPEC: tuple[Attribute, ...] = _build()
MANDATORY = tuple(a for a in SPEC if a.mandatory)
INVARIANTS = ("agent_id", "session_id", "service_name", "service_version", "nexus_distrib_ver")


def by_name(name: str, spec=SPEC) -> Attribute:
    return next(a for a in spec if a.name == name)


def spec_table(spark, spec=SPEC):
    """The specification as rows: name, group, type, role, mandatory, rule."""
    rows = [(i, a.name, a.group, a.type, a.role, a.mandatory, a.rule.sql) for i, a in enumerate(spec, 1)]
    return spark.createDataFrame(rows, "position int, name string, `group` string, type string, role string, mandatory boolean, rule string")
