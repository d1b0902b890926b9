"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracewright.llm import common, periods

FOLDER = "/root/testdata/sf0.001"


def brute(x, least=12):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        t = 0
        while t + q < len(x):
            if x[t] != x[t + q]:
                t += 1
                continue
            start = t
            while t + q < len(x) and x[t] == x[t + q]:
                t += 1
            if t + q - start >= max(least, 2 * q):
                found.setdefault((start, t + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def made(rng):
    n, letters = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 4])
    word = lambda most: [rng.randrange(letters) for _ in range(rng.randint(1, most))]
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(letters) for _ in range(n)]
    if kind == 1:
        return fibonacci(n)
    if kind == 2:
        x = []
        while len(x) < n:
            w = word(9)
            x += (w * 6)[: rng.randint(1, 4 * len(w))]
        return x
    w, v = word(5), word(5)
    return (w * rng.randint(1, 4) + v * rng.randint(1, 3)) * rng.randint(2, 3) + w


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(1500):
        x = made(rng)
        got = list(zip(*(a.tolist() for a in periods.runs_of(np.array(x, np.int64), least)), strict=True))
        assert got == brute(x, least), x


def test_long_texts_take_no_square_time():
    assert [a.tolist() for a in periods.runs_of(np.zeros(400_000, np.int64))] == [[0], [400_000], [1]]
    assert [a.tolist() for a in periods.runs_of(np.arange(600_000) % 7)] == [[0], [600_000], [7]]
    assert len(periods.runs_of(np.array(fibonacci(200_000)))[0]) > 10_000


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(listed), digest(kept)


def test_query_equals_brute_force(spark):
    documents = common.table(spark, FOLDER, "documents")
    short = documents.filter("n_chars < 6000")  # the brute force is quadratic
    rows = sorted(map(tuple, periods.report(short).collect()))
    assert rows == sorted(expected(r.doc_id, r.text) for r in short.select("doc_id", "text").collect())
    assert sum(r[1] > 0 for r in rows) > 5 and periods.report(documents).count() == documents.count()


def test_edges(spark, monkeypatch):
    rows = [(20, "a b " * 9, 1), (20, "a b " * 9, 1), (None, "x " * 12, 2), (3, None, None), (4, "", 0), (5, " \t\n", 0), (None, None, None), (6, "a b c a b c a b c a b", 0), (7, "w v " * 20_000, 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    want = sorted((expected(i, t if len(t or "") < 10_000 else t[:4000]) for i, t, _ in rows if i != 7), key=repr)
    assert sorted(map(tuple, periods.report(odd.filter("doc_id <> 7 or doc_id is null")).collect()), key=repr) == want
    monkeypatch.setattr(periods, "TOGETHER", 5)
    assert sorted(map(tuple, periods.report(odd.filter("doc_id <> 7 or doc_id is null")).collect()), key=repr) == want
    found = {r.doc_id: r.runs for r in periods.find_runs(odd.filter("doc_id >= 6")).collect()}
    assert found[6] == [] and [tuple(x) for x in found[7]] == [(0, 20_000, 1)]
    kept = periods.collapsed(odd)
    assert kept.columns == odd.columns
    texts = sorted((r.text for r in kept.collect()), key=repr)
    assert texts == sorted(["a b", "a b", "x", None, "", " \t\n", None, "a b c a b c a b c a b", "w v"], key=repr)
    assert periods.report(odd.limit(0)).count() == 0
