"""Nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

1. Equal vectors are one *node*, which keeps its least ids, one more than are asked for, as
   further ones can't be among the nearest. So a vector that fills a third of the table costs one node.
2. Nodes are dealt by hash into shards of about ``SHARD`` nodes. One task builds the graph of a
   shard. Nodes are numbered by level, highest first, so layer l is the first ``sizes[l]`` of
   them and its links are one flat array of node numbers, a fixed number a node, -1 where there are fewer.
   Layers are built from the top; nodes enter in batches, search those before them, and take
   neighbours that lie nearer to them than to each other. For that, each vector has one more element,
   which brings all to one length; inner products with a query don't see it.
3. Queries, each distinct vector once, go in blocks to every shard: a beam of ``BEAM`` nodes goes
   down the layers, many queries in step. What it holds at the end is scored on the original
   vectors in double precision, and the best of each shard are merged.

Work grows as queries times shards. ``SHARD`` and ``BEAM`` set recall against cost.

Cases: vectors that are null, empty, zero, or hold null or non-finite elements take no part, nor do
rows without an id; vectors of different widths are never compared; ties go to the smaller id;
of rows that repeat, each is found, and each asks; a query's own row is left out, once; if there
are fewer than k others, all are returned; products beyond double precision are infinite and tie; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common

K = 20
EVERY = 20
#: Nodes of a shard, about.
SHARD = 12_288
#: Links of a node in the upper layers; layer 0 has twice as many.
LINKS = 16
#: Nodes that the beam holds when a graph is built, and when it is searched.
BUILD_BEAM, BEAM = 96, 200
#: Nodes that enter together, queries that go in step, nodes of a beam that are expanded at once.
BATCH, STEP, AT_ONCE = 256, 128, 6
#: Candidates that a choice of links looks at.
CHOICE = 64
#: Queries of a block, and blocks that share one copy of a graph at most.
BLOCK, BLOCKS = 256, 16


class Graph(NamedTuple):
    """Nodes in order of level, and the links of each layer, layer 0 first."""

    vectors: np.ndarray
    sizes: list[int]
    links: list[np.ndarray]


def _levels(vectors: np.ndarray, links: int) -> np.ndarray:
    """A level for each vector, from a hash of its elements: each is reached by one in ``links`` of the level below."""
    hashes = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in vectors], np.float64)
    return np.floor(-np.log((hashes + 1) / 2.0**64) / math.log(links)).astype(np.int64)


def _beam(vectors: np.ndarray, links: np.ndarray, asked: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1 where there are fewer) and scores of the beam of each query in one layer, best first.

    ``entry`` has the nodes to begin at, all different, -1 where there are fewer.
    """
    q, n, dims = len(asked), len(links), vectors.shape[1]
    seen = np.zeros((q, n + 1), bool)  # the last column stands for -1
    seen[:, n] = True
    nodes = np.full((q, width), -1, np.int64)
    scores = np.full((q, width), -np.inf, np.float32)
    done = np.ones((q, width), bool)
    entry = entry[:, :width]
    m = entry.shape[1]
    nodes[:, :m] = entry
    scores[:, :m] = np.where(entry >= 0, np.einsum("qed,qd->qe", vectors[entry], asked), -np.inf)
    done[:, :m] = entry < 0
    np.put_along_axis(seen, np.where(entry < 0, n, entry), True, axis=1)
    active = np.arange(q)
    while True:
        active = active[~done[active].all(axis=1)]
        if not len(active):
            break
        rows = active[:, None]
        open_scores = np.where(done[active], -np.inf, scores[active])
        first = min(AT_ONCE, width)
        best = np.argpartition(-open_scores, first - 1, axis=1)[:, :first] if first < width else np.broadcast_to(np.arange(width), (len(active), width))
        live = ~done[rows, best]
        chosen = np.where(live, nodes[rows, best], -1)
        done[rows, best] = True
        found = np.where((chosen >= 0)[:, :, None], links[chosen], -1).reshape(len(active), -1)
        found = np.sort(np.where(found < 0, n, found), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = n
        found[seen[rows, found]] = n
        seen[rows, found] = True
        new = found < n
        most = int(new.sum(axis=1).max())
        if not most:
            continue
        found = np.sort(found, axis=1)[:, :most]
        new = found < n
        near = np.matmul(vectors[np.where(new, found, 0).ravel()].reshape(len(active), most, dims), asked[active][:, :, None])[:, :, 0]
        all_scores = np.concatenate((scores[active], np.where(new, near, -np.inf)), axis=1)
        all_nodes = np.concatenate((nodes[active], np.where(new, found, -1)), axis=1)
        all_done = np.concatenate((done[active], ~new), axis=1)
        keep = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        at = np.arange(len(active))[:, None]
        scores[active], nodes[active], done[active] = all_scores[at, keep], all_nodes[at, keep], all_done[at, keep]
    order = np.argsort(-scores, axis=1, kind="stable")
    at = np.arange(q)[:, None]
    return np.where(scores[at, order] > -np.inf, nodes[at, order], -1), scores[at, order]


def _chosen(vectors: np.ndarray, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates of each node, best first, those nearer to it than to any chosen before, then the best others, up to ``most``."""
    b, c = candidates.shape
    known = candidates >= 0
    some = vectors[np.where(known, candidates, 0)]
    apart = np.matmul(some, some.transpose(0, 2, 1))
    taken = np.zeros((b, c), bool)
    for t in range(c):
        near = (taken[:, :t] & (apart[:, t, :t] >= scores[:, t, None])).any(axis=1)
        taken[:, t] = known[:, t] & ~near & (taken.sum(axis=1) < most)
    # chosen ones first, then the rest, each by score; what is not known last
    rank = np.argsort(np.where(taken, 0, np.where(known, 1, 2)) * c + np.arange(c), axis=1)[:, :most]
    out = np.take_along_axis(np.where(known, candidates, -1), rank, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _linked_back(vectors: np.ndarray, links: np.ndarray, first: int, batch: np.ndarray) -> None:
    """Give the nodes that a batch, from node ``first`` on, has linked to links back to it."""
    width = links.shape[1]
    source = np.repeat(np.arange(first, first + len(batch)), width)
    target = batch.ravel()
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    hit = np.unique(target)
    old = links[hit]
    target = np.concatenate((target, np.repeat(hit, width)[old.ravel() >= 0]))
    source = np.concatenate((source, old.ravel()[old.ravel() >= 0]))
    scores = np.einsum("nd,nd->n", vectors[source], vectors[target])
    order = np.lexsort((source, -scores, target))
    source, target, scores = source[order], target[order], scores[order]
    same = np.zeros(len(source), bool)  # of nodes of one batch that chose each other, one link each way
    same[1:] = (source[1:] == source[:-1]) & (target[1:] == target[:-1])
    source, target, scores = source[~same], target[~same], scores[~same]
    row = np.searchsorted(hit, target)
    place = np.arange(len(target)) - np.searchsorted(target, hit)[row]
    most = min(CHOICE, int(place.max()) + 1)
    use = place < most
    candidates, near = np.full((len(hit), most), -1, np.int64), np.full((len(hit), most), -np.inf, np.float32)
    candidates[row[use], place[use]], near[row[use], place[use]] = source[use], scores[use]
    full = (candidates >= 0).sum(axis=1) > width
    links[hit[~full]] = np.pad(candidates[~full], ((0, 0), (0, max(0, width - most))), constant_values=-1)[:, :width]
    if full.any():
        links[hit[full]] = _chosen(vectors, candidates[full], near[full], width)


def build(vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> tuple[Graph, np.ndarray]:
    """The graph of some distinct vectors, and the place of each of its nodes among them."""
    vectors = np.ascontiguousarray(vectors, np.float64)
    level = np.minimum(_levels(vectors, links), 12)
    order = np.argsort(-level, kind="stable")
    level = level[order]
    scale = max(float(np.abs(vectors).max(initial=0)), 1e-300)
    plain = (vectors[order] / scale).astype(np.float32)  # within float32, whatever the values
    squares = (plain.astype(np.float64) ** 2).sum(axis=1)
    even = np.concatenate((plain, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None].astype(np.float32)), axis=1)
    sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
    layers: list[np.ndarray] = []  # from the top
    for k in range(len(sizes) - 1, -1, -1):
        width = 2 * links if k == 0 else links
        layer = np.full((sizes[k], width), -1, np.int32)
        above = sizes[k + 1] if k + 1 < len(sizes) else 0
        at = 0
        while at < sizes[k]:
            upto = min(sizes[k], at + max(8, min(BATCH, at)))
            if at < above:
                upto = min(upto, above)
            own = even[at:upto]
            peers = own @ own.T
            np.fill_diagonal(peers, -np.inf)
            near = np.argsort(-peers, axis=1, kind="stable")[:, :CHOICE]
            found, scores = near + at, np.take_along_axis(peers, near, axis=1)
            if at:
                entry = np.zeros((len(own), 1), np.int64)
                if at >= above:
                    for upper in layers:
                        entry = _beam(even, upper, own, entry, 4)[0]
                before, score = _beam(even, layer[:at], own, entry, beam)
                found, scores = np.concatenate((found, before), axis=1), np.concatenate((scores, score), axis=1)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :CHOICE]
            found, scores = np.take_along_axis(found, best, axis=1), np.take_along_axis(scores, best, axis=1)
            found[scores == -np.inf] = -1
            batch = _chosen(even, found, scores, width)
            layer[at:upto] = batch
            _linked_back(even, layer, at, batch)
            at = upto
        layers.append(layer)
    return Graph(vectors[order], sizes, layers[::-1]), order


def nearest(graph: Graph, asked: np.ndarray, k: int, beam: int = BEAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the nodes its beam found, at most k, and their inner products in double precision, best first."""
    out = []
    scale = max(float(np.abs(graph.vectors).max(initial=0)), 1e-300)
    plain = (graph.vectors / scale).astype(np.float32)
    for first in range(0, len(asked), STEP):
        whole = asked[first : first + STEP]
        some = (whole / np.abs(whole).max(axis=1, keepdims=True)).astype(np.float32)
        entry = np.zeros((len(some), 1), np.int64)
        for k_layer in range(len(graph.sizes) - 1, 0, -1):
            entry = _beam(plain, graph.links[k_layer], some, entry, 8)[0]
        nodes, _ = _beam(plain, graph.links[0], some, entry, max(beam, k))
        for query, row in zip(whole, nodes, strict=True):
            row = row[row >= 0]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (graph.vectors[row] * query).sum(axis=1)
            best = np.argsort(-score, kind="stable")
            out.append((row[best], score[best]))
    return out


# ---- on Spark ----------------------------------------------------------------------

_GRAPH = "dims int, shard int, n int, vectors binary, sizes array<int>, links array<binary>, id_ends binary, ids binary"


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def graphs(items: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """One row for each shard of ``items`` (id, v): its graph in flat arrays, and the k + 1 least ids of each node."""
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = items.withColumn("__r", least).filter(F.col("__r") <= k + 1)
    nodes = common.stored(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    shards = max(1, math.ceil(nodes.count() / shard))
    dealt = nodes.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")

    def in_task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[np.argsort([v.tobytes() for v in group["v"]], kind="stable")]  # the same graph whatever the order of rows
        graph, order = build(np.stack(group["v"].to_numpy()))
        ids = [np.asarray(x, np.int64) for x in group["ids"]]
        ids = [ids[i] for i in order]
        return pd.DataFrame(
            {
                "dims": [group["dims"].iloc[0]], "shard": [group["shard"].iloc[0]], "n": [len(group)], "vectors": [graph.vectors.tobytes()], "sizes": [graph.sizes],
                "links": [[x.tobytes() for x in graph.links]], "id_ends": [np.cumsum([len(x) for x in ids]).astype(np.int64).tobytes()], "ids": [np.concatenate(ids).tobytes()],
            }
        )

    return common.stored(dealt.groupBy("dims", "shard").applyInPandas(in_task, _GRAPH), "graphs")


def _read(row) -> tuple[Graph, np.ndarray, np.ndarray]:
    sizes = [int(x) for x in row["sizes"]]
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])
    links = [np.frombuffer(x, np.int32).reshape(size, -1) for x, size in zip(row["links"], sizes, strict=True)]
    return Graph(vectors, sizes, links), np.frombuffer(row["id_ends"], np.int64), np.frombuffer(row["ids"], np.int64)


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
    """query_id, rank, id, score: the k nearest items of each row of ``queries`` (id, v) but for its own."""
    spark = index.sparkSession
    asks = common.saved(queries.groupBy("v", F.col("id").alias("query_id")).agg(F.count("*").alias("__n")))
    distinct = common.stored(asks.select("v").distinct().withColumn("key", F.monotonically_increasing_id()), "queries")
    blocks = max(1, math.ceil(distinct.count() / BLOCK))
    shards = common.saved(index.select("dims", "shard"))
    groups = max(math.ceil(blocks / BLOCKS), min(blocks, math.ceil(2 * common.partitions(spark) / max(1, shards.count()))))
    dealt = distinct.withColumn("dims", F.size("v")).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    sent = common.joined_by(dealt.withColumn("__dims", F.col("dims")), shards.groupBy("dims").agg(F.collect_list("shard").alias("shards")), ["dims"], "key").select("dims", F.explode("shards").alias("shard"), "group", "key", "v")
    copies = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def in_task(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        keys, scores, ids, own = [], [], [], []
        if len(graph) and len(asked):
            index_, ends, all_ids = _read(graph.iloc[0])
            begins = np.concatenate(([0], ends[:-1]))
            vectors = np.stack(asked["v"].to_numpy())
            for key, query, (nodes, score) in zip(asked["key"].tolist(), vectors, nearest(index_, vectors, k + 1, beam), strict=True):
                size = ends[nodes] - begins[nodes]
                at = np.concatenate([np.arange(b, b + s) for b, s in zip(begins[nodes], size, strict=True)])
                spread, found = np.repeat(score, size), all_ids[at]
                best = np.lexsort((found, -spread))[: k + 1]
                keys += [key] * len(best)
                scores.append(spread[best])
                ids.append(found[best])
                own.append(np.repeat((index_.vectors[nodes] == query).all(axis=1), size)[best])
        flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pd.DataFrame({"key": np.array(keys, np.int64), "score": flat(scores, np.float64), "id": flat(ids, np.int64), "own": flat(own, bool)})

    on = ["dims", "shard", "group"]
    found = copies.groupBy(*on).cogroup(sent.groupBy(*on)).applyInPandas(in_task, "key long, score double, id long, own boolean")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    order = F.struct((-F.col("score")).alias("__less"), "id", "score", "own")
    best = found.withColumn("__r", rank).filter(F.col("__r") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list(order)).alias("best"))
    keyed = common.joined_by(asks, distinct, ["v"], "query_id").select("query_id", "__n", "key")
    each = common.joined_by(keyed, best, ["key"], "query_id")
    is_own = lambda x: x["own"] & (x["id"] == F.col("query_id"))
    place = common.let(F.transform("best", is_own), lambda marks: F.array_position(marks, F.lit(True)))
    others = F.slice(F.filter(F.col("best"), lambda x, i: i + 1 != F.col("__own")), F.lit(1), F.lit(k))
    listed = each.withColumn("__own", place).withColumn("best", others).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return listed.select("query_id", F.posexplode("best").alias("rank", "n")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("id"), F.col("n.score").alias("score"))


def report(embeddings: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by ``every``."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    return search(graphs(usable, k, shard), usable.filter(F.col("id") % every == 0), k, beam).withColumnRenamed("id", "vec_id")
