"""Secret scans, with DataFrame functions only.

Three base patterns give spans by form alone. Beside them every run of 20 or more letters,
digits and ``+/_-`` that no base span begins before is a token, and put to a battery of tests.
Its encoding is inferred from its characters (hex, base32, base36, letters and digits,
base64, and each kind without digits or letters), which gives an alphabet of k codes, and then:

* chi-squared against a uniform alphabet: X2 = k/n * sum(n_j^2) - n, held against
  its exact mean k-1 and variance 2(k-1)(n-1)/n under uniform codes;
* lag-1 serial correlation of the codes;
* runs: stretches of one class of characters, a capital before small letters being one
  with them, as words are written;
* alphabet use of the letters: how rare they are among the letters of ordinary texts, where a
  uniform alphabet has far too many rare ones.

A token is *random-like* if neither chi-squared nor serial correlation speaks
against uniform, independent codes. That alone would let many short ordinary tokens
pass, so it is combined with false-discovery control: the last two tests give p-values of
the token being ordinary (``LETTERS``, and the share of runs that ordinary tokens of
its encoding have at most, ``RUNS``). Fisher's method joins them, and the
Benjamini-Hochberg rule is applied within each encoding and class of lengths, over
all documents. Long tokens and short ones so get thresholds of their own, and so do
tokens of letters only, among which ordinary words are many. Tokens without letters are
never accepted: nothing tells them from ordinary numbers.

Cases: a null text counts as empty, and the digest of no spans is that of the empty
string; repeated rows each get their row; columns beside doc_id and text are not
read, and ``redact`` leaves them as they are, whatever their names. Offsets are code points. Very
long texts, and texts of many spans, cost their length: positions come from the lengths of
the pieces between matches, and stretches are cut from blocks of the text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group whose length counts, least length). The second and third
#: take whole runs, so that the least length can stand in the pattern itself.
BASE = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Group 1 has the token.
LONE_TOKEN = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,})"
#: The same where a text has base spans: their patterns take their own stretches first.
TOKEN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|(?<![0-9a-f])[0-9a-f]{24,}|(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,})"
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: (encoding, what its tokens look like, alphabet in the order of its codes)
ENCODINGS = (
    ("digits", r"^[0-9]+$", DIGITS),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("marked", r"^[A-Za-z+/_-]+$", UPPER + LOWER + "+/"),
    ("marked-digits", r"^[0-9+/_-]+$", DIGITS + "+/"),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^([a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOWER),
    ("alnum", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/"),
)
# Letters a to z in a thousand of ordinary text, about the mean of English, German, French and Spanish.
LETTERS_OF_TEXT = (85, 16, 34, 43, 140, 14, 18, 30, 75, 3, 5, 48, 26, 80, 55, 24, 6, 68, 68, 72, 38, 13, 9, 3, 8, 6)
#: How far the letters of ordinary tokens lie from those of text, in standard deviations: mean and spread, measured on identifiers in sources of public libraries.
LETTERS = (0.6, 1.05)
#: Runs for each letter or digit that ordinary tokens have at most in the mean, measured likewise; an encoding of one class has no runs to count.
RUNS = (("letters", 0.22), ("marked", 0.22), ("hex", 0.12), ("base32", 0.12), ("base36", 0.2), ("alnum", 0.25), ("base64", 0.27))
#: Standard deviations at which a test speaks against randomness.
AGAINST = 4.0
#: Share of false discoveries allowed in each encoding and class of lengths.
FDR = 0.01
#: Lengths from which the classes of lengths start.
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128, 256)
#: Steps of -log10(p) in which p-values are counted, and the last step.
STEPS, LAST_STEP = 4, 200
MASK = "[SECRET]"


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of one pattern: leftmost, non-overlapping, of those long enough.

    The length that counts is that of the group; for tokens the group is the span.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(whole.alias("w"), part.alias("g"), F.split(text, pattern, -1).alias("b"))
    sized = F.transform(
        F.filter(parts, lambda z: z["w"].isNotNull()),
        lambda z: F.struct(F.length(z["b"]).alias("gap"), F.length(z["w"]).alias("n"), F.length(z["g"]).alias("g"), z["w"].alias("text")),
    )
    placed = common.let(sized, lambda a: F.arrays_zip(a.alias("m"), common.sums_before(F.transform(a, lambda z: z["gap"] + z["n"])).alias("at")))
    kept = F.filter(placed, lambda z: z["m"]["g"] >= least)
    spans = F.transform(
        kept,
        lambda z: F.struct(
            (z["at"] + z["m"]["gap"]).alias("start"),
            F.lit(rank).alias("rank"),
            (z["at"] + z["m"]["gap"] + z["m"]["n"]).alias("end"),
            F.lit(kind).alias("kind"),
            z["m"]["text"].alias("text"),
        ),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,text:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _cut(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _surprise(z: Column) -> Column:
    """-ln of a bound of the upper normal tail (Mills); 0 up to one standard deviation."""
    return F.when(z > 1, z * z / 2 + F.log(F.greatest(z, F.lit(1.0))) + 0.5 * math.log(2 * math.pi)).otherwise(0.0)


def _letters_of_text() -> tuple[list[float], float, float]:
    """-ln of the share of each letter in ordinary text, with its mean and variance there."""
    shares = [x / sum(LETTERS_OF_TEXT) for x in LETTERS_OF_TEXT]
    logs = [-math.log(p) for p in shares]
    mean = sum(p * x for p, x in zip(shares, logs, strict=True))
    return logs, mean, sum(p * x * x for p, x in zip(shares, logs, strict=True)) - mean * mean


def _first_of(token: Column, choices) -> Column:
    """The value of the first (pattern, value) whose pattern matches, else null."""
    return reduce(lambda out, c: F.when(token.rlike(c[0]), c[1]).otherwise(out), reversed(list(choices)), F.lit(None).cast("string"))


def _tested(token: Column) -> Column:
    """struct(stratum of encoding and length class, random-like, step of -log10(p) of being ordinary) of a token."""
    logs, mean, variance = _letters_of_text()
    costs = F.array(*[F.lit(x) for x in (0.0, *logs)])

    def inferred(t: Column) -> Column:
        upper = t.rlike("^[0-9A-Z]+$") & t.rlike("[0-9]") & ~t.rlike("^[A-Z2-7]+$") | t.rlike("^[0-9A-F]+$") & t.rlike("[0-9]")
        sought = F.when(upper, F.lower(t)).otherwise(F.translate(t, "-_", "+/"))
        return F.struct(t.alias("token"), sought.alias("s"), _first_of(t, [(e[1], e[0]) for e in ENCODINGS]).alias("encoding"), _first_of(t, [(e[1], e[2]) for e in ENCODINGS]).alias("alphabet"))

    def spelt(t: Column) -> Column:
        chars = F.split(t["s"], "(?!^)")
        return common.let(
            chars,
            lambda c: F.struct(
                t["token"].alias("token"), t["s"].alias("s"), t["encoding"].alias("encoding"), F.length(t["alphabet"]).cast("double").alias("k"),
                F.size(c).cast("double").alias("n"), F.array_distinct(c).alias("distinct"), F.transform(c, lambda x: F.instr(t["alphabet"], x).cast("double")).alias("codes"),
            ),
        )

    def battery(t: Column) -> Column:
        codes, whole = t["codes"], F.length(t["s"])
        low = F.lower(F.regexp_replace(t["token"], "[^A-Za-z]", ""))
        near = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * b)
        return F.struct(
            t["encoding"].alias("encoding"), t["n"].alias("n"), t["k"].alias("k"),
            F.aggregate(t["distinct"], F.lit(0.0), lambda a, c: a + F.pow(whole - F.length(F.replace(t["s"], c, F.lit(""))), F.lit(2))).alias("squares"),
            F.aggregate(codes, F.lit(0.0), lambda a, x: a + x).alias("sum"),
            F.aggregate(codes, F.lit(0.0), lambda a, x: a + x * x).alias("sum2"),
            (F.aggregate(near, F.lit(0.0), lambda a, x: a + x) + F.element_at(codes, 1) * F.element_at(codes, -1)).alias("cross"),
            F.length(low).cast("double").alias("letters"),
            F.aggregate(F.split(low, "(?!^)"), F.lit(0.0), lambda a, c: a + F.get(costs, F.instr(F.lit(LOWER), c))).alias("cost"),
            F.regexp_count(t["token"], F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")).cast("double").alias("runs"),
            F.length(F.regexp_replace(t["token"], "[+/_-]", "")).cast("double").alias("body"),
        )

    def judged(s: Column) -> Column:
        n, k = s["n"], s["k"]
        chi = k / n * s["squares"] - n
        chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        spread = s["sum2"] - s["sum"] * s["sum"] / n
        serial = F.when(spread > 0, (s["cross"] - s["sum"] * s["sum"] / n) / F.nullif(spread, F.lit(0.0))).otherwise(1.0)
        serial_z = (serial + 1 / (n - 1)) * F.sqrt(n)
        z = ((s["cost"] - s["letters"] * mean) / F.sqrt(F.greatest(s["letters"], F.lit(1.0)) * variance) - LETTERS[0]) / LETTERS[1]
        usual = reduce(lambda out, e: F.when(s["encoding"] == e[0], e[1]).otherwise(out), RUNS, F.lit(1.0))
        x = F.least(s["runs"] / F.greatest(s["body"], F.lit(1.0)), F.lit(1 - 1e-9))
        apart = x * F.log(F.greatest(x, F.lit(1e-9)) / usual) + (1 - x) * F.log((1 - x) / F.greatest(1 - usual, F.lit(1e-9)))
        runs = F.when(x > usual, s["body"] * apart).otherwise(0.0)  # Chernoff bound of the binomial tail
        both = F.when(s["letters"] > 0, _surprise(z) + runs).otherwise(0.0)
        fisher = both - F.log(1 + both)
        length_class = reduce(lambda out, i: F.when(n >= LENGTHS[i], i).otherwise(out), range(len(LENGTHS)), F.lit(0))
        return F.struct(
            F.concat_ws(":", s["encoding"], length_class).alias("stratum"),
            ((F.abs(chi_z) < AGAINST) & (F.abs(serial_z) < AGAINST)).alias("random"),
            F.least(F.floor(fisher / math.log(10) * STEPS), F.lit(LAST_STEP)).cast("int").alias("step"),
        )

    return F.transform(F.transform(F.transform(F.transform(F.array(token), inferred), spelt), battery), judged)[0]


def _scanned(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, and the arrays ``__base`` and ``__tried`` of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = [_matches(text, *spec, rank).alias(f"__{spec[0]}") for rank, spec in enumerate(BASE)]
    based = documents.select(*dict.fromkeys([*keep, "text"]), *base)
    any_base = reduce(lambda a, b: a | b, [F.size(f"__{spec[0]}") > 0 for spec in BASE])
    tokens = [_matches(text, "random", pattern, 1, 20, len(BASE)) for pattern in (TOKEN, LONE_TOKEN)]
    found = based.withColumn("__token", F.when(any_base, tokens[0]).otherwise(tokens[1]))
    return found.select(
        *keep,
        F.array_sort(_cut(F.concat(*[F.col(f"__{spec[0]}") for spec in BASE]))).alias("__base"),
        F.transform("__token", lambda t: F.struct(t["start"], t["rank"], t["end"], t["kind"], _tested(t["text"]).alias("test"))).alias("__tried"),
        *[F.size(f"__{spec[0]}").cast("long").alias(f"__n_{spec[0]}") for spec in BASE],
    )


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """By encoding and length class, the least step of -log10(p) that Benjamini-Hochberg accepts.

    Only counts for each step reach the driver: at most encodings x length classes x steps.
    """
    counts = scanned.select(F.explode("__tried.test").alias("t")).groupBy("t.stratum", "t.step").count().collect()
    strata: dict[str, list[tuple[int, int]]] = {}
    for stratum, step, count in counts:
        strata.setdefault(stratum, []).append((step, count))
    accepted = {}
    for stratum, steps in strata.items():
        tests, seen = sum(c for _, c in steps), 0
        for step, count in sorted(steps, reverse=True):
            seen += count
            if 10 ** (-step / STEPS) <= fdr * seen / tests:
                accepted[stratum] = step
    return accepted


def _accepted(limits: dict[str, int]) -> Column:
    """The tried spans that the thresholds accept."""

    def passes(t: Column) -> Column:
        least = reduce(lambda out, kv: F.when(t["test"]["stratum"] == kv[0], kv[1]).otherwise(out), sorted(limits.items()), F.lit(None).cast("int"))
        return t["test"]["random"] & F.coalesce(t["test"]["step"] >= least, F.lit(False))

    return _cut(F.filter("__tried", passes))


def scan(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans: arrays of struct(start, rank, end, kind).

    One pass over the texts; the slim result is written to the shared folder, as the
    thresholds need the tests of all documents before a span can be accepted.
    """
    slim = common.stored(_scanned(documents, ["doc_id"]), "secrets")
    spans = F.array_sort(F.concat("__base", _accepted(thresholds(slim, fdr))))
    return slim.select("doc_id", *[F.col(f"__n_{spec[0]}").alias(f"n_{spec[0]}") for spec in BASE], F.col("__base").alias("base"), spans.alias("spans"))


def report(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """The scan as digests: one row for each document."""
    return scan(documents, fdr).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, fdr: float = FDR, mask: str = MASK) -> DataFrame:
    """``documents`` with each stretch of spans in the text replaced by a mask; n_chars follows.

    Texts are scanned twice, once for the thresholds and once to cut; they are never
    shuffled. A null text stays null.
    """
    limits = thresholds(common.stored(_scanned(documents, []).select("__tried"), "secret-tests"), fdr)
    columns = documents.columns
    spans = F.array_sort(F.concat("__base", _accepted(limits)))

    def clean(s: Column) -> Column:
        """Stretches between the spans, each but the last followed by the mask; spans that touch are masked as one."""
        ends = common.before(F.transform(s, lambda x: x["end"]), -1, lambda a, b: F.greatest(a, b))
        opens = F.filter(F.zip_with(s, ends, lambda x, e: F.struct(F.greatest(e, F.lit(0)).alias("start"), x["start"].alias("end"), e.alias("upto"))), lambda x: x["end"] > x["upto"])
        rest = F.struct(F.array_max(F.transform(s, lambda x: x["end"])).alias("start"), F.length("text").alias("end"), F.lit(0).alias("upto"))
        return F.array_join(common.pieces_between(F.col("text"), F.concat(opens, F.array(rest))), mask)

    masked = _scanned(documents, columns).withColumn("__spans", spans).withColumn("__any", F.size("__spans") > 0)
    out = masked.withColumn("text", F.when(F.col("__any"), common.let(F.col("__spans"), clean)).otherwise(F.col("text")))
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__any"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*columns)
