"""Exact top-k search on binary codes by incremental multi-index hashing.

A code is an array of 64-bit words, cut into m segments of about log2(number of codes / 64) bits
that lie within its words, and each distinct
code is filed under each of its segments. In round s every open query looks up all
segment values at s flipped bits and verifies the whole codes it finds. After round s all
codes within m*(s+1)-1 bits have been seen: if they differed in more than s bits in every
segment, they would differ in m*(s+1) in all. So a query closes once its kth verified
distance is at most m*(s+1)-1, and the result is exact. Queries that never
close have looked up everything after the last round.

Equal codes are filed once, with their count and least ids, so a vector that fills a third of
the table costs one entry. Buckets are cut into arrays of at most ``CHUNK`` codes; a look-up
returns the k best of an array, so rows follow the look-ups, not the pairs.

Cases: rows with a null id or code are neither found nor queries; null elements count as not
positive; codes of fewer words than the longest are filled up with zeros; ties in distance go by id; rows that
repeat are found as often as they stand there; a query finds itself, as all rows are
searched; if there are fewer than k rows, all are returned; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

BITS = 64
K = 10
CHUNK = 1024
#: A look-up is a row that is shuffled and joined, a code in an array is one xor and a count:
#: so segments are a little narrower than log2(codes) bits.
PER_BUCKET = 64
SALTS = 64


def sign_code(vector: Column) -> Column:
    """Bit i % 64 of word i / 64 of the code: element i is positive. As many words as the vector needs, one at least."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i % BITS)).otherwise(F.lit(0).cast("long")))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(vector) - 1) / BITS), F.lit(0)).cast("int")), lambda k: F.slice(bits, k * BITS + 1, F.lit(BITS)))
    return F.transform(words, lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


Segment = tuple[int, int, int]


def segments(codes: int, words: int = 1) -> list[Segment]:
    """(word, shift, width) of the segments, so that a segment value is shared by about PER_BUCKET codes."""
    width = min(20, max(8, round(math.log2(max(2, codes / PER_BUCKET)))))
    m = math.ceil(BITS / width)
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return [(word, a, b - a) for word in range(words) for a, b in zip(edges, edges[1:], strict=False)]


def _value(code: Column, segment: Segment) -> Column:
    word, shift, width = segment
    return F.call_function("shiftrightunsigned", F.get(code, word), F.lit(shift)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _segment_values(code: Column, cut: list[Segment]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("seg"), _value(code, s).alias("value")) for i, s in enumerate(cut)])


def distance(a: Column, b: Column, words: int) -> Column:
    """Number of differing bits of two codes."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, w).bitwiseXOR(F.get(b, w))) for w in range(words)]).cast("int")


def _filled(code: Column, words: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.get(code, i), F.lit(0).cast("long")))


def _distinct_codes(items: DataFrame, k: int) -> DataFrame:
    """code, copies, ids: the k least ids of each code, first by salt, as one code may be frequent."""
    least = lambda c: F.slice(F.array_sort(c), F.lit(1), F.lit(k))
    ranked = items.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    by_id = ranked.groupBy("code", "salt", "id").agg(F.count("*").alias("n"))
    parts = by_id.groupBy("code", "salt").agg(F.sum("n").alias("n"), least(F.collect_list(F.struct("id", F.least("n", F.lit(k)).alias("n")))).alias("ids"))
    whole = parts.groupBy("code").agg(F.sum("n").alias("copies"), least(F.flatten(F.collect_list("ids"))).alias("ids"))
    repeated = F.slice(F.flatten(F.transform("ids", lambda x: F.array_repeat(x["id"], x["n"].cast("int")))), F.lit(1), F.lit(k))
    return whole.select("code", "copies", repeated.alias("ids"))


def _index(codes: DataFrame, cut: list[Segment]) -> DataFrame:
    """seg, value, codes: arrays of struct(least id, code, copies), at most about CHUNK in one."""
    filed = codes.select(F.inline(_segment_values(F.col("code"), cut)), "code", "copies", F.element_at("ids", 1).alias("id"))
    sizes = filed.groupBy("seg", "value").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = filed.join(sizes, ["seg", "value"]).withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")))
    return dealt.groupBy("seg", "value", "chunk").agg(F.collect_list(F.struct("id", "code", "copies")).alias("codes")).drop("chunk")


def search(items: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, id, distance: the k nearest items of each query.

    ``items`` and ``queries`` have the columns id and code (an array of 64-bit words). Results are whole and exact.
    """
    known = F.col("id").isNotNull() & F.col("code").isNotNull()
    words = max([f.filter(known).agg(F.max(F.size("code"))).first()[0] or 1 for f in (items, queries)])
    whole = _filled(F.col("code"), words)
    items = items.filter(known).select("id", whole.alias("code"))
    queries = queries.filter(known).select(F.col("id").alias("query_id"), whole.alias("query"))
    codes = common.saved(_distinct_codes(items, k))
    cut = segments(codes.count(), words)
    index = common.saved(_index(codes, cut))
    best_type = "array<struct<distance:int,id:{},code:array<bigint>,copies:bigint>>".format(items.schema["id"].dataType.simpleString())
    state = common.saved(queries.select("query").distinct().select("query", F.array().cast(best_type).alias("best"), F.lit(False).alias("closed")))
    for flips in range(max(w for *_, w in cut) + 1):
        open_ = state.filter("not closed")
        if open_.isEmpty():
            break
        found = _look_up(open_, index, cut, flips, k, words)
        merged = open_.join(found, "query", "left")
        best = F.slice(F.array_sort(F.array_distinct(F.concat("best", F.coalesce("found", F.array().cast(best_type))))), F.lit(1), F.lit(k))
        seen = len(cut) * (flips + 1) - 1
        judged = merged.select("query", best.alias("best")).withColumn("closed", F.coalesce(_kth(F.col("best"), k) <= seen, F.lit(False)))
        state = common.saved(state.filter("closed").unionByName(judged))
    return _expanded(state, codes, queries, k)


def _kth(best: Column, k: int) -> Column:
    """Distance of the kth item, counting copies; null if there are fewer."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("d"))
    end = F.aggregate(best, start, lambda a, x: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + x["copies"]).alias("n"), x["distance"].alias("d"))))
    return F.when(end["n"] >= k, end["d"])


def _look_up(open_: DataFrame, index: DataFrame, cut: list[Segment], flips: int, k: int, words: int) -> DataFrame:
    """query, found: the k best codes at exactly so many flipped bits in some segment."""
    looked = []
    for i, segment in enumerate(cut):
        width = segment[2]
        if flips > width:
            continue
        value = _value(F.col("query"), segment)
        chosen = [sum(1 << b for b in c) for c in combinations(range(width), flips)]
        masks = F.from_json(F.lit(str(chosen)), "array<bigint>")  # a constant, folded once
        looked.append(open_.select("query", "best", F.lit(i).alias("seg"), value.alias("own"), F.explode(masks).alias("mask")))
    probes = looked[0]
    for more in looked[1:]:
        probes = probes.unionByName(more)
    probes = probes.select("query", _kth(F.col("best"), k).alias("least"), "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    hits = probes.join(index, ["seg", "value"])
    far = F.transform("codes", lambda c: F.struct(distance(c["code"], F.col("query"), words).alias("distance"), c["id"].alias("id"), c["code"].alias("code"), c["copies"].alias("copies")))
    near = F.filter(far, lambda c: F.col("least").isNull() | (c["distance"] <= F.col("least")))
    top = hits.select("query", F.slice(F.array_sort(near), F.lit(1), F.lit(k)).alias("top")).filter(F.size("top") > 0)
    return top.groupBy("query").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("top")))), F.lit(1), F.lit(k)).alias("found"))


def _expanded(state: DataFrame, codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest ids from the k nearest codes, for each query row."""
    chosen = state.select("query", F.explode("best").alias("b")).select("query", F.col("b.distance").alias("distance"), F.col("b.code").alias("code"))
    ids = chosen.join(codes.select("code", "ids"), "code").select("query", F.transform("ids", lambda x: F.struct(F.col("distance").alias("distance"), x.alias("id"))).alias("part"))
    nearest = ids.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("part"))), F.lit(1), F.lit(k)).alias("nearest"))
    return queries.join(nearest, "query").select("query_id", F.posexplode("nearest").alias("rank", "n")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("id"), F.col("n.distance").alias("distance"))


def report(embeddings: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """The k nearest vectors, by sign code, of each vector whose id is divisible by ``every``."""
    items = embeddings.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return search(items, items.filter(F.col("id") % every == 0), k).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, len(list_filter(list_zip(q.code, c.code), lambda z: z[1] <> z[2]))::INTEGER AS distance
  FROM c q CROSS JOIN c WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d
) WHERE rank <= 10
"""
