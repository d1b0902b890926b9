"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Each source gets a target share of a total budget by its weight,
stopped at ``most`` times its own size, and what is over is shared again by weight.
The repetition rate of a source is target / size: each of its documents is taken
floor(rate) times, and once more if a number hashed from its id, its text and its number
among equal rows is below the fraction.

Cases: a null text has size 0; a null source is a source of its own, sorted last; an
empty table gives an empty result; rows equal in all columns are numbered and draw apart,
so that a source of repeated rows meets its target too; rows with one id and other texts
draw apart. A source of size 0 has target and rate 0. ``mix`` leaves all columns as they
are, whatever their names; in ``mix_plan`` input columns named like one that it adds are
replaced. Columns of maps can't be compared and are not allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
SALTS = 32


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def source_rates(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, weight, target, rate."""
    sizes = documents.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    placed = common.running(sizes, [F.col("source").asc_nulls_last()], {"__place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    sources = common.saved(placed.select("source", "source_size", weight.alias("weight")))
    level = _level(sources, share, most)
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * most).cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("rate", rate)


def _level(sources: DataFrame, share: float, most: int) -> float:
    """Words for each unit of weight once no source is above its stop.

    Sources stop in the order of their stop by weight. With those before it held at their stops, each
    would raise the level to what is left by the weight that is left; the level is the greatest of these.
    """
    size, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not weight:
        return 0.0
    stop = F.col("source_size") * most
    order = [(stop / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    placed = common.running(sources, order, {"__held": F.col("source_size"), "__by": F.col("weight")})
    level = (F.lit(share * size) - F.col("__held") * most) / (F.lit(weight) - F.col("__by"))
    return placed.agg(F.max(level.cast("double"))).first()[0]


def _planned(documents: DataFrame, weights, share: float, most: int, seed: str) -> DataFrame:
    """``documents`` with the plan in columns ``__mix_...``.

    Texts are never shuffled, but for equal rows, while the table of sources is small
    enough to broadcast; beyond that both sides are joined by source and a salt, as
    one source may hold a third of all documents.
    """
    rates = source_rates(documents, weights, share, most)
    rates = common.saved(rates.select(F.col("source").alias("__source"), *[F.col(c).alias(f"__mix_{c}") for c in ("source_size", "target", "rate")]))
    numbered, small = common.numbered(documents), common.small_side(rates)
    if small is not None:
        joined = numbered.join(small, F.col("source").eqNullSafe(F.col("__source")))
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        left = numbered.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text", "__nth"), F.lit(SALTS)).cast("int"))
        right = rates.withColumn("__salt_of", salts)
        joined = left.join(right, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__salt_of"))).drop("__salt", "__salt_of")
    text = F.when(F.col("__nth") == 0, F.md5("text")).otherwise(F.concat_ws("#", F.coalesce(F.md5("text"), F.lit("null")), "__nth"))
    draw = common.uniform(F.lit(seed), F.col("doc_id"), text)
    rate = F.col("__mix_rate")
    return (
        joined.withColumn("__mix_size", words(F.col("text")))
        .withColumn("__mix_copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int"))
        .withColumn("__mix_taken", F.col("__mix_size") * F.col("__mix_copies"))
    )


def mix_plan(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Each document with size, source_size, target, rate, copies and taken."""
    added = ("size", "source_size", "target", "rate", "copies", "taken")
    plan = _planned(documents, weights, share, most, seed)
    return plan.select(*[F.col(c) for c in documents.columns if c not in added], *[F.col(f"__mix_{c}").alias(c) for c in added])


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``documents``."""
    taken = _planned(documents, weights, share, most, seed).filter("__mix_copies > 0")
    copied = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return copied.select(*[F.col(c) for c in documents.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1 AS nth, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s
), g AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(2 * source_size) OVER o, 0)::DOUBLE)
          / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w
  WINDOW o AS (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(weight * max(level) OVER (), (2 * source_size)::DOUBLE) AS target FROM g
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (floor(r.rate) + CASE WHEN
          ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || coalesce(md5(d.text), 'null') || CASE WHEN nth = 0 THEN '' ELSE '#' || nth END), 1, 13))::BIGINT
            / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
