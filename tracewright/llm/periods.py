"""Periodic runs of words, by the dictionary of basic factors.

A run is a stretch of words with smallest period q and at least two periods long that
neither neighbour extends. The dictionary gives each factor of length L = 1, 2, 4, ... a
number: equal factors of one document have equal numbers, and a factor that stands once in
its document has none, so on ordinary text it ends after a few lengths.

A run of period q repeats its first factor of length L <= q < 2 * L at distance q. The
places of one factor within L of each other form an arithmetic progression, so from each place
at most two progressions lie within 2 * L. With p the smallest period of the factor, q is the
distance from the place, or from the last of its own progression, to the first, second or
last place of the next one: between first and last of both the same words break off the
period p, or the second begins before p more words. These distances are proposed; each is
extended both ways by comparing factors from the longest to the shortest, and of proposals
with one stretch the smallest period stays.

Several documents go through numpy together; their words have numbers of their own, so no
run passes from one to the next. A document is worked whole, by one task.

Cases: a null or blank text has no words and no runs; nulls and repeats in other columns do
not matter; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WORD

#: Words that a run has at least.
LEAST = 12
#: Words of the documents that are worked together at most, but for one longer document.
TOGETHER = 300_000
_WORDS = re.compile(WORD)
_FAR = np.iinfo(np.int64).max
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
Change = Callable[[list[str], int | None], list[str]]


def basic_factors(words: np.ndarray) -> list[np.ndarray]:
    """For L = 1, 2, 4, ...: at each place the number of the factor of L words that begins there, -1 if it stands nowhere else."""
    levels, n, length = [], len(words), 1
    at, keys = np.arange(n), np.asarray(words, np.int64)
    while len(at):
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = count[number] > 1
        at, number = at[again], number[again]
        if not len(at):
            break
        level = np.full(n, -1, np.int32)
        level[at] = number
        levels.append(level)
        at = at[at + length < n]
        at = at[level[at + length] >= 0]
        keys = level[at].astype(np.int64) * n + level[at + length]
        length *= 2
    return levels


def _proposals(level: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods, length <= period < 2 * length, that the progressions of one length propose."""
    at = np.flatnonzero(level >= 0)
    at = at[np.argsort(level[at], kind="stable")]
    m, kind = len(at), level[at]
    gap = np.full(m + 1, _FAR)
    gap[: m - 1] = np.where(kind[1:] == kind[:-1], at[1:] - at[:-1], _FAR)
    changes = np.concatenate((gap[1:] != gap[:-1], [True]))  # after this gap, another one
    following = np.where(changes, np.arange(m + 1), m)
    ends = np.minimum.accumulate(following[::-1])[::-1]  # last equal gap
    last = np.where(gap < _FAR, ends + 1, np.arange(m + 1))[:m]  # last place of the progression
    bases = np.flatnonzero(gap[:m] <= 2 * length)

    def near(base: np.ndarray, origins: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        has = gap[base] < _FAR
        base, origins = base[has], [o[has] for o in origins]
        first = base + 1
        second = np.where(gap[first] < _FAR, first + 1, first)
        for target in (first, second, last[first]):
            for origin in origins:
                period = at[target] - at[origin]
                fits = (period >= length) & (period < 2 * length)
                yield at[origin[fits]], period[fits]

    found = [*near(bases, (bases,)), *near(last[bases], (last[bases], bases))]
    return np.concatenate([a for a, _ in found]), np.concatenate([p for _, p in found])


def _extended(levels: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretch of each period about each place."""
    n = len(levels[0])
    a, b = start.copy(), start.copy()
    for k in range(len(levels) - 1, -1, -1):
        level, length = levels[k], 1 << k
        inside = b + period < n
        x = level[np.where(inside, b, 0)]
        same = inside & (x >= 0) & (x == level[np.where(inside, b + period, 0)])
        b[same] += length
        before = a - length
        inside = before >= 0
        x = level[np.where(inside, before, 0)]
        same = inside & (x >= 0) & (x == level[np.where(inside, before + period, 0)])
        a[same] -= length
    return a, b + period


def runs_of(words: np.ndarray, least: int = LEAST) -> Runs:
    """Starts, lengths and periods of all runs of an array of word numbers, by start, then period."""
    levels = basic_factors(words)
    starts, ends, periods = [], [], []
    for k, level in enumerate(levels):
        place, period = _proposals(level, 1 << k)
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        # a proposal within the length of the one before it belongs to the same stretch
        new = np.ones(len(place), bool)
        new[1:] = (period[1:] != period[:-1]) | (place[1:] - place[:-1] > 1 << k)
        a, b = _extended(levels, place[new], period[new])
        q = period[new]
        holds = b - a >= np.maximum(least, 2 * q)
        starts.append(a[holds])
        ends.append(b[holds])
        periods.append(q[holds])
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, end, period = (np.concatenate(x) for x in (starts, ends, periods))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def kept_words(n: int, runs: Runs) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    start, length, period = runs
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:n]) == 0


def _each(texts: list[str | None], ids: list, change: Change | None, least: int) -> Iterator[tuple[int, list[str], Runs]]:
    """Number, words and runs of each text, worked together up to TOGETHER words."""

    def worked() -> Iterator[tuple[int, list[str], Runs]]:
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        numbers, _ = pd.factorize(np.array([w for words in held for w in words], object)) if sizes.sum() else (np.zeros(0, np.int64), None)
        own = np.repeat(np.arange(len(held)), sizes) * (int(numbers.max(initial=0)) + 1) + numbers
        start, length, period = runs_of(own, least)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        cuts = np.searchsorted(start, begins)
        for i, words in enumerate(held):
            x = slice(cuts[i], cuts[i + 1])
            yield first + i, words, (start[x] - begins[i], length[x], period[x])

    held: list[list[str]] = []
    first = size = 0
    for i, text in enumerate(texts):
        words = _WORDS.findall(text or "")
        if change is not None:
            words = change(words, ids[i])
        if held and size + len(words) > TOGETHER:
            yield from worked()
            held, first, size = [], i, 0
        held.append(words)
        size += len(words)
    if held:
        yield from worked()


def find_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs: an array of (start, length, period) in words for each document."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found = [], []
            for _, words, runs in _each(b.column("text").to_pylist(), [None] * len(b), None, least):
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in zip(*(x.tolist() for x in runs), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "runs"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(in_task, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>")


def collapsed(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with their words joined by one blank, less those that a run repeats; texts without runs and nulls stay as they are."""

    @F.pandas_udf("string")
    def shorter(texts: pd.Series) -> pd.Series:
        out = list(texts)
        for i, words, runs in _each(out[:], [None] * len(out), None, least):
            if len(runs[0]):
                out[i] = " ".join([w for w, keep in zip(words, kept_words(len(words), runs).tolist(), strict=True) if keep])
        return pd.Series(out, dtype=object)

    return documents.withColumn("text", shorter("text"))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words of a tenth of the documents, chosen by the crc32 of the id, repeat a stretch to their end; a null id changes nothing."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[: n - a]


def digest(words: list[str], runs: Runs) -> tuple:
    """Number of runs, the longest with its exponent in thousandths, and digests of all runs and of the words that stay."""
    rows = list(zip(*(x.tolist() for x in runs), strict=True))
    listed = "".join([f"{s},{n},{q}\n" for s, n, q in rows])
    text = " ".join([w for w, keep in zip(words, kept_words(len(words), runs).tolist(), strict=True) if keep]) if rows else " ".join(words)
    start, length, period = min(rows, key=lambda r: (-r[1], r[0], r[2])) if rows else (None, None, None)
    hashed = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (listed, text)]
    return len(rows), start, length, period, 1000 * length // period if rows else None, *hashed


def report(documents: DataFrame, change: Change | None = planted, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of each document, some with planted repeats."""
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest(words, runs) for _, words, runs in _each(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), change, least)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, " + ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names)
    return documents.select("doc_id", "text").mapInArrow(in_task, shape)
