"""Neighbours by graphs against all inner products."""

import numpy as np

from tracewright.llm import common, graphs


def brute(rows, k=20, every=20):
    """query id, rank, id, score; each row that asks is left out once."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, v) in enumerate(usable):
        if q % every:
            continue
        scored = [(-float((w * v).sum()), i) for m, (i, w) in enumerate(usable) if m != n and len(w) == len(v)]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)


def test_small_tables_are_exact(spark):
    for folder in ("sf0.001", "sf0.01"):
        embeddings = common.table(spark, f"/root/testdata/{folder}", "embeddings")
        same(found(graphs.report(embeddings)), brute([(r.vec_id, r.embedding) for r in embeddings.collect()]))


def test_recall_over_shards(spark):
    embeddings = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in embeddings.collect()])
    got = found(graphs.report(embeddings, shard=700))
    assert len(got) == len(want)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.97 * len(want)


def test_recall_of_uneven_and_clustered_vectors():
    rng = np.random.default_rng(5)
    clusters = rng.standard_normal((40, 32))[rng.integers(0, 40, 6000)] + 0.2 * rng.standard_normal((6000, 32))
    uneven = rng.standard_normal((6000, 32)) * rng.lognormal(0, 1, (6000, 1))
    for x in (clusters, uneven, 1e-100 * uneven, 1e100 * clusters):
        graph, order = graphs.build(x)
        asked = x[::60]
        scale = np.abs(x).max()
        scores = (asked / scale) @ (x / scale).T
        hits = 0
        for i, (nodes, _) in enumerate(graphs.nearest(graph, asked, 20)):
            hits += len(set(order[nodes[:20]].tolist()) & set(np.argsort(-scores[i], kind="stable")[:20].tolist()))
        assert hits >= 0.9 * 20 * len(asked)


def test_edges(spark):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(1, 130)]  # many ties
    rows += [(i, [1.0, 2.0, 3.0, 1.0, 0.0, 1.0]) for i in range(200, 330)]  # a vector of many rows
    rows += [(400, None), (420, []), (440, [0.0] * 6), (460, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (480, [nan] * 6), (500, [inf] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(20, [2.0] * 6), (520, [1.0] * 6), (520, [1.0] * 6), (540, [1.0, -1.0]), (541, [1.0, 1.0]), (560, [1.0] * 3), (580, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (581, [0.0, 1.0, -0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    want = brute(rows)
    same(found(graphs.report(frame)), want)
    same(found(graphs.report(frame, shard=40)), want)
    assert graphs.report(frame.limit(0)).count() == 0
    assert {r[0] for r in want} >= {20, 320, 520, 540, 580} and not {r[0] for r in want} & {400, 420, 440, 460, 480, 500, 560}
