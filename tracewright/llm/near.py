"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Words are runs of letters, digits and underscores in lower case; a document is the
set of its runs of five words (all its words as one, if it has fewer). Two documents are
linked if the Jaccard similarity of their sets is at least 0.8.

1. One pass over the texts makes a slim table: a key (hash of the whole set), the size
   of the set, and a hash for each band. Documents with one key are one *node*, so
   copies cost nothing further.
2. Nodes that share a band hash meet at the least of them, the *pivot*. A node keeps its
   distinct pivots, mostly one or two, at most one for each band.
3. Nodes of a pivot that has more than one block of them are first compared with the pivot
   alone. Jaccard distance is a metric, so all that lie within half the distance allowed
   are linked with each other: this *core* is counted as a whole, without its pairs.
4. Only documents that stand for a node with a pivot are read again. Their full sets are
   shuffled to their pivots. The nodes of a pivot are dealt into blocks, and each pair of
   blocks, but for two of the core, is one bounded group: intersections are counted as products
   of sparse 0/1 matrices. A pair of nodes counts only at the least pivot they share, so once.
5. A group returns for each node the weight of its links, and a spanning forest, never the
   pairs. The forests are joined to components.

A tight cluster of M texts so costs M comparisons. Numbers of links are exact, so texts of one
pivot that lie further apart have to be compared in pairs of blocks, M * M / 512 sets sent.

Bands and rows come from ``choose_bands`` for the target recall at the threshold.

Cases: null and wordless texts link with nothing; repeated rows and equal sets are
linked copies; ids may be null or repeat, as nodes are told by their sets; class_id is
the least id of the class, null if it has none; long texts are taken whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.components import components
from tracewright.llm.hashing import U64, WordHashes, mixed, ngrams

N_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_HASHES = 128
#: Most nodes in a block, and most n-grams in a block.
BLOCK_NODES, BLOCK_GRAMS = 512, 500_000
#: Bytes of the sets of hot pivots that are broadcast at most; beyond it they are joined by salt.
BROADCAST_BYTES, SALTS = 32_000_000, 32
_WORDS = re.compile(r"\w+")
_COLUMNS = 4096


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows a band as the hashes allow with the recall at the similarity.

    A pair of similarity s meets with probability 1 - (1 - s**rows) ** bands.
    """
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no bands reach the recall")


def gram_set(text: str, hashes: WordHashes, n: int = N_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text."""
    words = hashes(_WORDS.findall(text.lower()))
    return np.unique(ngrams(words, min(n, len(words)))) if len(words) else words


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of MinHash values."""
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=U64))
    least = np.full(bands * rows, np.iinfo(U64).max, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 2048):
            part = (grams[None, at : at + 2048] ^ seeds[:, None]) * U64(0x9E3779B97F4A7C15)
            least = np.minimum(least, (part ^ (part >> U64(29))).min(axis=1))
        out = np.arange(1, bands + 1, dtype=U64)
        for row in least.reshape(bands, rows).T:
            out = mixed(out * U64(0xD6E8FEB86659FD93) + row)
    return out


def set_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def sketch(documents: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, key (null without words), grams and bands of each document."""

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [gram_set(t or "", hashes, n) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "text_hash": b["text_hash"],
                    "key": [set_key(s) if len(s) else None for s in sets],
                    "grams": [len(s) for s in sets],
                    "bands": [band_hashes(s, bands, rows).astype(np.int64) if len(s) else None for s in sets],
                }
            )

    rows_in = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows_in.mapInPandas(in_task, "doc_id string, text_hash long, key binary, grams long, bands array<long>")


def join(documents: DataFrame, similarity: float = SIMILARITY, n: int = N_WORDS, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, grams, text_hash.

    ``n_links`` counts the other documents whose similarity reaches the threshold, copies
    included; ``class_id`` is the least id among the documents connected by links.
    """
    bands, rows = choose_bands(similarity, recall)
    kind = documents.schema["doc_id"].dataType
    slim = common.stored(sketch(documents, n, bands, rows).withColumn("doc_id", F.col("doc_id").cast(kind)), "sketch")
    named = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    nodes = slim.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(named).alias("text"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    nodes = common.stored(nodes, "nodes")
    found = common.stored(_found(documents, slim, nodes, similarity, n), "links")
    weights = found.groupBy("key").agg(F.sum("links").alias("links"))
    parts = components(found.filter(F.col("other").isNotNull()), "key", "other")
    in_class = nodes.select("key", "copies", "first_id").join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    in_class = common.saved(in_class)
    # each table of one row a key is written first, so that joins to hot keys are split when they run
    least = common.saved(in_class.groupBy("component").agg(F.min("first_id").alias("class_id")))
    of_node = in_class.join(least, "component").join(weights, "key", "left").select("key", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = slim.select("doc_id", "text_hash", "grams", "key").join(common.saved(of_node), "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), "grams", "text_hash",
    )


def _pivots(nodes: DataFrame) -> DataFrame:
    """key, pivots: the least node of each band bucket that holds further nodes, sorted."""
    banded = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("key").alias("pivot"), F.max("key").alias("__last")).filter(F.col("pivot") != F.col("__last")).drop("__last")
    return banded.join(common.saved(shared), "bucket").groupBy("key").agg(F.sort_array(F.collect_set("pivot")).alias("pivots"))


def _found(documents: DataFrame, slim: DataFrame, nodes: DataFrame, similarity: float, n: int) -> DataFrame:
    """key, other, links: link weights of nodes (other null) and links of a spanning forest."""
    met = common.saved(_pivots(nodes).join(nodes.select("key", "copies", "text", "grams"), "key"))
    repeated = slim.groupBy("doc_id", "text_hash").agg(F.count("*").alias("__n")).filter("__n > 1")
    once = repeated.isEmpty()  # else rows of equal id and text would send their node more than once
    at = met.select("key", "copies", "grams", "text", F.posexplode("pivots").alias("place", "pivot"))
    blocks = lambda rows: F.greatest(F.ceil(F.count(rows) / BLOCK_NODES), F.ceil(F.sum(F.when(rows.isNotNull(), F.col("grams"))) / BLOCK_GRAMS))
    hot = common.saved(at.groupBy("pivot").agg(blocks(F.col("key")).alias("__blocks")).filter("__blocks > 1").select("pivot"))
    if hot.isEmpty():
        core, sizes = None, None
    else:
        in_hot = common.joined_by(at.filter("place = 0"), hot, ["pivot"], "key")
        core = common.saved(_core(documents, in_hot.select("key", "copies", "text", "pivot"), hot, nodes, similarity, n))
        of_core = common.joined_by(at, hot, ["pivot"], "key").join(core.select("key", "pivot", F.lit(True).alias("near")), ["key", "pivot"], "left")
        rest = F.when(F.col("near").isNull(), F.col("key"))
        inner = F.when(F.col("near"), F.col("key"))
        sizes = of_core.groupBy("pivot").agg(F.coalesce(blocks(rest), F.lit(0)).cast("int").alias("rest"), F.coalesce(blocks(inner), F.lit(0)).cast("int").alias("core"))
    plan = common.saved(_plan(met, at, core, sizes))
    found = _verified(documents, plan, once, similarity, n)
    return found if core is None else found.unionByName(_core_links(core))


def _core(documents: DataFrame, members: DataFrame, hot: DataFrame, nodes: DataFrame, similarity: float, n: int) -> DataFrame:
    """key, pivot, copies of the nodes within half the distance allowed of their first pivot."""
    pivots = nodes.join(hot.withColumnRenamed("pivot", "key"), "key").select("key", "text")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            yield pd.DataFrame({"pivot": b["key"], "packed": [gram_set(t or "", hashes, n).tobytes() for t in b["plain"]]})

    sets = _with_text(documents, pivots).dropDuplicates(["key"]).select("key", "plain").mapInPandas(to_sets, "pivot binary, packed binary")
    sets = common.stored(sets, "pivots")
    own = _with_text(documents, members)
    if (sets.agg(F.sum(F.length("packed"))).first()[0] or 0) <= BROADCAST_BYTES:
        paired = own.join(F.broadcast(sets), "pivot")
    else:
        salted = own.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        paired = salted.join(sets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pivot", "__salt"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            near = []
            for text, packed in zip(b["plain"], b["packed"], strict=True):
                grams, other = gram_set(text or "", hashes, n), np.frombuffer(packed, U64)
                same = len(np.intersect1d(grams, other, assume_unique=True))
                near.append(same >= (1 + similarity) / 2 * (len(grams) + len(other) - same) + 1e-9)
            yield b.loc[near, ["key", "pivot", "copies"]]

    kept = paired.select("key", "pivot", "copies", "plain", "packed").mapInPandas(compare, "key binary, pivot binary, copies long")
    return kept.groupBy("key", "pivot").agg(F.max("copies").alias("copies"))


def _core_links(core: DataFrame) -> DataFrame:
    """The links of all pairs of each core, as weights and a star around its least node."""
    whole = core.groupBy("pivot").agg(F.sum("copies").alias("__all"), F.min("key").alias("__least"))
    each = common.saved(common.joined_by(core, whole, ["pivot"], "key"))
    weights = each.select("key", F.lit(None).cast("binary").alias("other"), (F.col("__all") - F.col("copies")).alias("links"))
    star = each.filter(F.col("key") != F.col("__least")).select("key", F.col("__least").alias("other"), F.lit(0).cast("long").alias("links"))
    return weights.filter("links > 0").unionByName(star)


def _plan(met: DataFrame, at: DataFrame, core: DataFrame | None, sizes: DataFrame | None) -> DataFrame:
    """For each node with pivots: its text's name, copies, and for each pivot whether it is in the core there, and how many blocks rest and core have."""
    one = F.struct(F.lit(False).alias("near"), F.lit(1).alias("rest"), F.lit(0).alias("core"))
    if core is None:
        dealt = F.transform("pivots", lambda p: F.struct(p.alias("pivot"), one["near"].alias("near"), one["rest"].alias("rest"), one["core"].alias("core")))
        return met.select("key", "copies", "text", dealt.alias("dealt"))
    placed = common.joined_by(at.select("key", "pivot"), sizes, ["pivot"], "key", "left").join(core.select("key", "pivot", F.lit(True).alias("near")), ["key", "pivot"], "left")
    each = F.struct("pivot", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("rest", F.lit(1)).alias("rest"), F.coalesce("core", F.lit(0)).alias("core"))
    dealt = placed.groupBy("key").agg(F.sort_array(F.collect_list(each)).alias("dealt"))
    return met.select("key", "copies", "text").join(dealt, "key")


def _with_text(documents: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` with the text that its column ``text``, of id and hash, names, as ``plain``."""
    texts = documents.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), F.col("text").alias("plain"))
    named = common.saved(named)
    small = common.small_side(named)
    match = F.col("__id").eqNullSafe(F.col("text.id")) & (F.col("__hash") == F.col("text.hash"))
    return texts.join(named if small is None else small, match).drop("__id", "__hash", "text")


def _verified(documents: DataFrame, plan: DataFrame, once: bool, similarity: float, n: int) -> DataFrame:
    """key, other, links: what the pairs of blocks hold."""
    texts = _with_text(documents, plan)
    if not once:
        texts = texts.dropDuplicates(["key"])

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            rows, size = [], 0
            for text, key, copies, dealt in zip(b["plain"], b["key"], b["copies"], b["dealt"], strict=True):
                grams = gram_set(text or "", hashes, n)
                if not len(grams) or set_key(grams) != bytes(key):
                    continue  # another text of the same hash
                own = xxhash.xxh3_64_intdigest(bytes(key))
                packed, pivots = grams.tobytes(), [bytes(d["pivot"]) for d in dealt]
                for d, pivot in zip(dealt, pivots, strict=True):
                    # blocks of the core have numbers below 0
                    if d["near"]:
                        mine = -1 - own % d["core"]
                        groups = [(i, mine) for i in range(d["rest"])]
                    else:
                        mine = own % d["rest"]
                        groups = [(min(mine, j), max(mine, j)) for j in range(d["rest"])] + [(mine, -1 - k) for k in range(d["core"])]
                    for i, j in groups:
                        rows.append((pivot, i, j, mine, bytes(key), copies, b"".join(pivots), packed))
                        size += len(packed)
                        if size > 8_000_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["pivot", "i", "j", "mine", "key", "copies", "pivots", "packed"]
    shape = "pivot binary, i int, j int, mine int, key binary, copies long, pivots binary, packed binary"
    sent = texts.select("plain", "key", "copies", "dealt").mapInPandas(to_blocks, shape)
    grouped = sent.repartition(common.partitions(documents.sparkSession), "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            out = _links(group, similarity)
            if out is not None:
                yield out

    return grouped.mapInPandas(verify, "key binary, other binary, links long")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Runs of rows with equal (pivot, i, j); a run is one bounded pair of blocks."""
    held, at = [], None
    for b in batches:
        for row in b.itertuples(index=False, name=None):
            if row[:3] != at:
                if len(held) > 1:
                    yield held
                held, at = [], row[:3]
            held.append(row)
    if len(held) > 1:
        yield held


def _links(group: list[tuple], similarity: float) -> pd.DataFrame | None:
    """Link weights and a spanning forest within one pair of blocks."""
    pivot, i, j = group[0][:3]
    sets = [np.frombuffer(row[7], U64) for row in group]
    sizes = np.array([len(s) for s in sets])
    common_grams = intersections(sets)
    linked = common_grams >= similarity * (sizes[:, None] + sizes[None, :] - common_grams) - 1e-9
    np.fill_diagonal(linked, False)
    if i != j:
        mine = np.array([row[3] for row in group])
        linked &= mine[:, None] != mine[None, :]
    if not linked.any():
        return None
    # a pair counts at the least pivot it shares
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(row[6], len(kinds)) for row in group])
    pivots = [[k[p : p + 16] for p in range(0, len(k), 16)] for k in kinds]
    here = np.array([[min(set(a) & set(b)) == pivot for b in pivots] for a in pivots])
    linked &= here[kind[:, None], kind[None, :]]
    weights = linked @ np.array([row[5] for row in group], dtype=np.int64)
    keys, rows = [row[4] for row in group], []
    root = _forest(linked)
    for a, w in enumerate(weights):
        if w:
            rows.append((keys[a], None, int(w)))
        if root[a] != a:
            rows.append((keys[a], keys[root[a]], 0))
    return pd.DataFrame(rows, columns=["key", "other", "links"]) if rows else None


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over slices of the shared members."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    members = np.concatenate(sets)
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    new = np.concatenate(([True], members[1:] != members[:-1]))
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(members)))
    shared = np.repeat(counts > 1, counts)
    column = np.cumsum(np.repeat(counts > 1, counts) & new) - 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
        part = np.zeros((len(sets), min(_COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric 0/1 matrix, the first row of its component."""
    root, seen = np.arange(len(linked)), np.zeros(len(linked), bool)
    for first in range(len(linked)):
        if seen[first] or not linked[first].any():
            continue
        front = np.zeros(len(linked), bool)
        front[first] = True
        whole = front.copy()
        while front.any():
            front = linked[front].any(axis=0) & ~whole
            whole |= front
        root[whole], seen = first, seen | whole
    return root


def report(documents: DataFrame) -> DataFrame:
    return join(documents).select("doc_id", "class_id", "n_links")


def keep_one(documents: DataFrame, similarity: float = SIMILARITY, n: int = N_WORDS) -> DataFrame:
    """One document of each class: the one with the least id; rows that repeat it are dropped too.

    Wordless documents are all kept. Columns are those of ``documents``.
    """
    found = common.stored(join(documents, similarity, n), "classes")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.max("grams").alias("grams"))
    kept = common.saved(kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), ((F.col("rows") > 1) & (F.col("grams") > 0)).alias("__again")))
    side = common.small_side(kept)
    marked = documents.withColumn("__text", F.xxhash64("text")).join(
        kept if side is None else side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    )
    once = marked.select(*documents.columns, "__again")
    if kept.filter("__again").isEmpty():
        return once.drop("__again")
    again = once.filter("__again").dropDuplicates(["doc_id", "text"])
    return once.filter("not __again").unionByName(again).drop("__again")
