"""Collocations from weighted acyclic automata.

An automaton holds phrases: an arc has a word and the count of the phrase that it ends (0 if
that is only the beginning of others), and leads to a state. Equal states are one, so
the many phrases that end alike share their ends. It is stored in flat arrays beside its
sorted words.

1. Each task counts the phrases of up to ``TOGETHER`` words of its texts, a *shard*, by language. They
   come out sorted, are cut at the bounds of prefix ranges, and each range becomes an automaton as
   its sorted phrases arrive: a state is complete, and is looked up among those before it, when they pass it.
   A hot phrase so is one arc for each shard.
2. The automata of one language and range meet in one task, which unites them and adds up the
   weights. Phrases below the least count go; no part of a candidate is below it.
3. A candidate needs the counts of its parts, which lie in other ranges. Each range sends one automaton
   of all parts that it asks for to each range that holds them; that is composed with the counts there, so its
   arcs get their weights, and goes back. A frequent part is asked for once by each range.
4. Candidates are scored with whole numbers of any size, those inside a longer one go, and the best of each
   language stay.

The bounds are prefixes of two words at equal steps among distinct ones of a bounded sample; they
decide only where phrases are worked, as Spark's own ranges do.

Cases: a null text is empty; a null language is ``und``; repeated rows count each; ties are settled by the
phrase; very long texts are taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common

WORDS, LEAST, BEST = 3, 10, 2000
#: A candidate goes if a longer one holds at least this percentage of its occurrences.
INSIDE = 50
#: Words of a shard, and phrases that wait to be united.
TOGETHER, WAITING = 2_000_000, 3_000_000
#: Documents whose prefixes place the bounds, prefixes of each, ranges for each shuffle partition.
SAMPLE, PREFIXES, RANGES = 1000, 32, 2
#: Parts of a language whose best candidates are found apart.
SALTS = 32
#: Signs between pieces become one of them, letters A to Z lower ones, tabs blanks: bytes of other characters are none of these.
_SIGN = b"."
_TABLE = bytes.maketrans(b",;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", _SIGN * 9 + b" abcdefghijklmnopqrstuvwxyz")


class Level(NamedTuple):
    """Phrases of one length, sorted: the place of the phrase without its last word, that word, the count."""

    parent: np.ndarray
    word: np.ndarray
    count: np.ndarray


class Phrases(NamedTuple):
    """Sorted words, and the phrases of one, two, ... of them; each phrase's beginning is there too, perhaps with count 0."""

    words: list[str]
    levels: list[Level]


class Automaton(NamedTuple):
    """Arcs of state s: ``first[s]`` to ``first[s + 1]``, by word; state 0 is the end, the last one the start."""

    words: list[str]
    first: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    target: np.ndarray


# ---- automata --------------------------------------------------------------------


def automaton(phrases: Phrases) -> Automaton:
    """The least automaton of sorted phrases: states are merged from the ends of phrases to their beginnings."""
    firsts, arcs, register = [np.zeros(1, np.int64)], [], {b"": 0}
    at = 0
    target = np.zeros(len(phrases.levels[-1].word) if phrases.levels else 0, np.int64)  # of the arcs of a level
    for depth in range(len(phrases.levels) - 1, -1, -1):
        level = phrases.levels[depth]
        parents = len(phrases.levels[depth - 1].word) if depth else 1
        begin = np.searchsorted(level.parent, np.arange(parents + 1))
        size = np.diff(begin)
        table = np.stack((level.word, level.count, target), axis=1)
        # many states have one arc: equal ones are brought together before they are looked up
        one, own = np.flatnonzero(size == 1), np.arange(parents)
        order = one[np.lexsort(table[begin[one]].T[::-1])]
        if len(order):
            row = table[begin[order]]
            new = np.concatenate(([True], (row[1:] != row[:-1]).any(axis=1)))
            own[order] = order[new][np.cumsum(new) - 1]
        state, kept = np.zeros(parents, np.int64), []
        for p in np.flatnonzero((own == np.arange(parents)) & (size > 0)).tolist():
            key = table[begin[p] : begin[p + 1]].tobytes()
            if key not in register or not depth:  # the start is a state of its own
                register[key] = len(register)
                kept.append(p)
            state[p] = register[key]
        state = state[own]
        if kept:
            n, first = size[kept], begin[kept]
            taken = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            arcs.append(table[taken])
            firsts.append(at + np.cumsum(n))
            at += len(taken)
        target = state
    word, weight, to = np.concatenate(arcs).T if arcs else [np.zeros(0, np.int64)] * 3
    return Automaton(phrases.words, np.concatenate(([0], *firsts)), word, weight, to)


def phrases_of(a: Automaton) -> Phrases:
    """All phrases of an automaton, sorted."""
    levels, state = [], np.array([len(a.first) - 2])
    while True:
        size = a.first[state + 1] - a.first[state]
        if not size.sum():
            return Phrases(a.words, levels)
        arc = np.repeat(a.first[state] - np.cumsum(size) + size, size) + np.arange(size.sum())
        levels.append(Level(np.repeat(np.arange(len(state)), size), a.word[arc], a.weight[arc]))
        state = a.target[arc]


def composed(asked: Phrases, a: Automaton) -> Phrases:
    """The asked phrases with the weights that the automaton gives them, 0 where it has none."""
    place = {w: i for i, w in enumerate(a.words)}
    of = np.array([place.get(w, -1) for w in asked.words] or [0], np.int64)
    width, states = len(a.words) + 1, len(a.first) - 1
    keys = np.repeat(np.arange(states), np.diff(a.first)) * width + a.word
    levels, state = [], np.array([states - 1])
    for level in asked.levels:
        word, at = of[level.word], state[level.parent]
        key = at * width + word
        arc = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        met = (at > 0) & (word >= 0) & (keys[arc] == key) if len(keys) else np.zeros(len(word), bool)
        levels.append(Level(level.parent, level.word, np.where(met, a.weight[arc] if len(keys) else 0, 0)))
        state = np.where(met, a.target[arc] if len(keys) else 0, 0)
    return Phrases(asked.words, levels)


def united(parts: list[Phrases], least: int = 0) -> Phrases:
    """All phrases of the parts with the sums of their counts; below ``least`` they go, but for beginnings of others."""
    words = sorted(set().union(*(p.words for p in parts)))
    place = {w: i for i, w in enumerate(words)}
    of = [np.array([place[w] for w in p.words] or [0], np.int64) for p in parts]
    before = [np.zeros(1, np.int64) for _ in parts]  # where the phrases of the level before have gone
    levels = []
    for depth in range(max((len(p.levels) for p in parts), default=0)):
        here = [i for i, p in enumerate(parts) if len(p.levels) > depth]
        keys = np.concatenate([before[i][parts[i].levels[depth].parent] * max(1, len(words)) + of[i][parts[i].levels[depth].word] for i in here])
        counts = np.concatenate([parts[i].levels[depth].count for i in here])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        total = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(keys) else counts
        levels.append(Level(keys[new] // max(1, len(words)), keys[new] % max(1, len(words)), total))
        ends = np.cumsum([len(parts[i].levels[depth].word) for i in here])
        for i, end in zip(here, ends, strict=True):
            before[i] = number[end - len(parts[i].levels[depth].word) : end]
    return _without_rare(Phrases(words, levels), least)


def _without_rare(phrases: Phrases, least: int) -> Phrases:
    if not least:
        return phrases
    keep = [level.count >= least for level in phrases.levels]
    for depth in range(len(keep) - 1, 0, -1):  # beginnings stay
        keep[depth - 1][phrases.levels[depth].parent[keep[depth]]] = True
    levels, number = [], np.zeros(1, np.int64)
    for level, kept in zip(phrases.levels, keep, strict=True):
        levels.append(Level(number[level.parent[kept]], level.word[kept], np.where(level.count[kept] >= least, level.count[kept], 0)))
        number = np.cumsum(kept) - 1
    used = np.unique(np.concatenate([level.word for level in levels] or [np.zeros(0, np.int64)]))
    return Phrases([phrases.words[i] for i in used.tolist()], [Level(x.parent, np.searchsorted(used, x.word), x.count) for x in levels])


def sliced(phrases: Phrases, begins: list[int], ends: list[int]) -> Phrases:
    """The phrases of a range, from ``begins`` to before ``ends`` at each level.

    The range may begin after the beginning of its first phrases: that is taken along, without its count.
    """
    rows = [slice(a, b) for a, b in zip(begins, ends, strict=True)]
    for depth in range(len(rows) - 1, 0, -1):
        parent = phrases.levels[depth].parent[rows[depth]]
        if len(parent):
            own = rows[depth - 1]
            whole = own.start >= own.stop
            rows[depth - 1] = slice(int(parent[0]) if whole else min(own.start, int(parent[0])), max(own.stop, int(parent[-1]) + 1))
    used = np.zeros(len(phrases.words), bool)
    for level, x in zip(phrases.levels, rows, strict=True):
        used[level.word[x]] = True
    place, levels = np.cumsum(used) - 1, []
    for depth, (level, x) in enumerate(zip(phrases.levels, rows, strict=True)):
        if x.stop > x.start:
            count = level.count[x].copy()
            count[: max(0, begins[depth] - x.start)] = 0
            count[max(0, ends[depth] - x.start) :] = 0
            levels.append(Level(level.parent[x] - (rows[depth - 1].start if depth else 0), place[level.word[x]], count))
    return Phrases([phrases.words[i] for i in np.flatnonzero(used).tolist()], levels)


def packed(a: Automaton) -> bytes:
    """Five lengths, the words, and the arrays in the least width that holds them."""
    raw = "\n".join(a.words).encode()
    arrays = [np.diff(a.first).astype(np.uint64), a.word.astype(np.uint64), a.weight.astype(np.uint64), a.target.astype(np.uint64)]
    out, head = [raw], [len(a.words), len(raw)]
    for x in arrays:
        width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * w))
        out.append(x.astype(f"<u{width}").tobytes())
        head += [len(x), width]
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(out))


def unpacked(blob: bytes) -> Automaton:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(raw, "<i8", 10).tolist()
    at, words = 80 + head[1], raw[80 : 80 + head[1]].decode().split("\n") if head[0] else []
    arrays = []
    for n, width in zip(head[2::2], head[3::2], strict=True):
        arrays.append(np.frombuffer(raw, f"<u{width}", n, at).astype(np.int64))
        at += n * width
    return Automaton(words, np.concatenate(([0], np.cumsum(arrays[0]))), *arrays[1:])


# ---- counting --------------------------------------------------------------------


def tokens(text: str) -> list[bytes]:
    """Words in UTF-8, and ``_SIGN`` between pieces."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(_SIGN, b" . ").split()


def counted(codes: np.ndarray, words: list[str], most: int = WORDS) -> Phrases:
    """The phrases of up to ``most`` words of a row of word numbers, -1 between pieces; words are sorted."""
    levels, n = [], max(1, len(words))
    at = np.flatnonzero(codes >= 0)
    number = np.zeros(len(codes), np.int64)
    for depth in range(most):
        keys = number[at] * n + codes[at + depth]
        found, number_at, count = np.unique(keys, return_inverse=True, return_counts=True)
        if not len(found):
            break
        levels.append(Level(found // n, found % n, count))
        number[at] = number_at
        at = at[at + depth + 1 < len(codes)]
        at = at[codes[at + depth + 1] >= 0]
    return Phrases(words, levels)


def _cuts(phrases: Phrases, bounds: list[tuple[str, str]]) -> list[list[int]]:
    """For each level the first phrase of each range; bounds are prefixes of two words, and a word alone comes before it with others."""
    place, n = phrases.words, max(1, len(phrases.words))
    keys = phrases.levels[1].parent * n + phrases.levels[1].word if len(phrases.levels) > 1 else np.zeros(0, np.int64)
    cuts: list[list[int]] = [[0] for _ in phrases.levels]
    single = phrases.levels[0].word if phrases.levels else np.zeros(0, np.int64)
    for a, b in bounds:
        i = bisect.bisect_left(place, a)
        here = i < len(place) and place[i] == a
        row = int(np.searchsorted(single, i))
        has = here and row < len(single) and single[row] == i
        ends = [row + (has and b != "")]
        if len(cuts) > 1:
            ends.append(int(np.searchsorted(keys, row * n + (bisect.bisect_left(place, b) if has else 0))))
        for depth in range(2, len(cuts)):
            ends.append(int(np.searchsorted(phrases.levels[depth].parent, ends[-1])))
        for cut, end in zip(cuts, ends, strict=True):
            cut.append(end)
    for cut, level in zip(cuts, phrases.levels, strict=True):
        cut.append(len(level.word))
    return cuts


def _in_ranges(phrases: Phrases, lang: str, bounds: list[tuple[str, str, str]]) -> Iterator[tuple[int, Phrases]]:
    """Numbers of ranges and the phrases in each, but for empty ones."""
    if not phrases.levels:
        return
    first, last = bisect.bisect_left(bounds, (lang, "", "")), bisect.bisect_left(bounds, (lang + "\0", "", ""))
    cuts = _cuts(phrases, [x[1:] for x in bounds[first:last]])
    full = [k for k in range(last - first + 1) if any(cut[k + 1] > cut[k] for cut in cuts)]
    for k in full:
        yield first + k, sliced(phrases, [cut[k] for cut in cuts], [cut[k + 1] for cut in cuts])


def _bounds(documents: DataFrame, ranges: int) -> list[tuple[str, str, str]]:
    """Up to ranges - 1 prefixes (language, word, word) at equal steps among the distinct ones of a bounded sample."""
    n = documents.count()
    some = documents.filter(F.pmod(F.xxhash64(*documents.columns), F.lit(max(1, n // SAMPLE))) == 0).limit(4 * SAMPLE)

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for lang, text in zip(b["lang"], b["text"], strict=True):
                words = [w for w in tokens(text) if w != _SIGN]
                step = max(1, len(words) // PREFIXES)
                out |= {(lang, words[i].decode(), words[i + 1].decode()) for i in range(0, len(words) - 1, step)}
            yield pd.DataFrame(list(out), columns=["lang", "a", "b"])

    found = some.mapInPandas(in_task, "lang string, a string, b string").distinct().collect()  # at most 4 * SAMPLE * (PREFIXES + 1) rows of three words
    prefixes = sorted(map(tuple, found))
    return sorted({prefixes[len(prefixes) * k // ranges] for k in range(1, ranges)}) if prefixes else []


_BLOBS = "lang string, range int, n long, blob binary"
#: Bytes of automata that leave a task together, about.
SENT = 4_000_000


def _frames(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that end with an automaton, in frames of about SENT bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= SENT:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _task(work: Callable[[Iterator[pd.DataFrame]], Iterable[tuple]], names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    return lambda batches: _frames(work(batches), names)


def counts(documents: DataFrame, bounds: list[tuple[str, str, str]], most: int = WORDS, least: int = LEAST) -> DataFrame:
    """lang, range, n, blob: an automaton of the phrases of each range, and how many words were counted with it."""

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        held: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        size = 0

        def out() -> Iterator[tuple]:
            names = list(index)
            order = sorted(range(len(names)), key=names.__getitem__)
            for lang, rows in held.items():
                codes = np.concatenate(rows)
                used = np.unique(codes)
                is_used = np.zeros(len(names), bool)
                is_used[used] = True
                own = [i for i in order if is_used[i] and names[i] != _SIGN]
                rank = np.full(len(names), -1, np.int64)
                rank[own] = np.arange(len(own))
                codes = rank[codes]
                n = int((codes >= 0).sum())
                for number, part in _in_ranges(counted(codes, [names[i].decode() for i in own], most), lang, bounds):
                    yield lang, number, n, packed(automaton(part))
                    n = 0  # each word counts once

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                words = tokens(text)
                words.append(_SIGN)
                held[lang].append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size >= TOGETHER:
                    yield from out()
                    index.clear()
                    held.clear()
                    size = 0
        yield from out()

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for (lang, number), rows in _groups(batches, ["lang", "range"]):
            waiting: list[Phrases] = []
            words = size = 0
            for row in rows:
                waiting.append(phrases_of(unpacked(row.blob)))
                words += row.n
                size += sum(len(x.word) for x in waiting[-1].levels)
                if size >= WAITING and len(waiting) > 1:
                    waiting = [united(waiting)]
                    size = sum(len(x.word) for x in waiting[0].levels) // 2  # so that each union at least halves what waits
            whole = united(waiting, least)
            yield lang, number, words, packed(automaton(whole))

    names_out = ["lang", "range", "n", "blob"]
    sent = documents.mapInPandas(_task(shards, names_out), _BLOBS)
    spark = documents.sparkSession
    dealt = sent.repartition(RANGES * common.partitions(spark), "lang", "range").sortWithinPartitions("lang", "range")
    return common.stored(dealt.mapInPandas(_task(unite, names_out), _BLOBS), "counts")


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, Iterator]]:
    """Rows of each key in turn; rows are sorted by it."""
    rows = (row for b in batches for row in b.itertuples(index=False))
    return itertools.groupby(rows, key=lambda r: tuple(getattr(r, c) for c in by))


# ---- candidates ------------------------------------------------------------------


def _columns(phrases: Phrases, depth: int) -> list[np.ndarray]:
    """The word numbers of the phrases of ``depth`` words, an array for each place."""
    out, at = [], np.arange(len(phrases.levels[depth - 1].word))
    for level in phrases.levels[depth - 1 :: -1]:
        out.append(level.word[at])
        at = level.parent[at]
    return out[::-1]


def _listed(words: list[str], rows: dict[int, list[np.ndarray]], counts_of: dict[int, np.ndarray] | None = None) -> Phrases:
    """Sorted phrases from arrays of word numbers, by length; counts are 1 unless they are given."""
    parts = []
    for depth, columns in rows.items():
        n = len(columns[0])
        levels = [Level(np.arange(n) if d else np.zeros(n, np.int64), c, np.zeros(n, np.int64)) for d, c in enumerate(columns)]
        levels[-1] = levels[-1]._replace(count=np.ones(n, np.int64))
        order = np.lexsort(columns[::-1])
        parts.append(Phrases(words, [Level(x.parent if d == 0 else np.arange(n), x.word[order], x.count) for d, x in enumerate(levels)]))
    return _without_rare(united(parts), 1)


def _parts_of(phrases: Phrases) -> Phrases:
    """All parts that the cuts of the phrases of two words and more have."""
    rows: defaultdict[int, list[list[np.ndarray]]] = defaultdict(list)
    for depth in range(2, len(phrases.levels) + 1):
        counted_ = phrases.levels[depth - 1].count > 0
        columns = [c[counted_] for c in _columns(phrases, depth)]
        for k in range(1, depth):
            rows[k].append(columns[:k])
            rows[depth - k].append(columns[k:])
    return _listed(phrases.words, {k: [np.concatenate(x) for x in zip(*v, strict=True)] for k, v in rows.items()}) if rows else Phrases([], [])


def _scored(lang: str, phrases: Phrases, answers: Phrases) -> pd.DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of two words and more, by their lowest cut."""
    known = automaton(answers)
    out = []
    for depth in range(2, len(phrases.levels) + 1):
        level = phrases.levels[depth - 1]
        keep = level.count > 0
        columns = [c[keep] for c in _columns(phrases, depth)]
        a = level.count[keep].tolist()
        best = None
        for k in range(1, depth):
            left, right = (_answer(known, phrases.words, c) for c in (columns[:k], columns[k:]))
            here = [(1_000_000 * x * x // (y * z), k, y, z) for x, y, z in zip(a, left, right, strict=True)]
            best = here if best is None else [min(x, y) for x, y in zip(best, here, strict=True)]
        text = [" ".join(x) for x in zip(*([phrases.words[i] for i in c.tolist()] for c in columns), strict=True)]
        out.append(pd.DataFrame({"lang": lang, "phrase": text, "words": depth, "a": a, "l": [x[2] for x in best], "r": [x[3] for x in best], "score": [x[0] for x in best]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["lang", "phrase", "words", "a", "l", "r", "score"])


def _answer(known: Automaton, words: list[str], columns: list[np.ndarray]) -> list[int]:
    n = len(columns[0])
    asked = Phrases(words, [Level(np.arange(n) if d else np.zeros(n, np.int64), c, c) for d, c in enumerate(columns)])
    return composed(asked, known).levels[-1].count.tolist()


def candidates(table: DataFrame, bounds: list[tuple[str, str, str]]) -> DataFrame:
    """lang, phrase, words, a, l, r, score of all phrases of two words and more of a table of ``counts``."""
    n = RANGES * common.partitions(table.sparkSession)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for row in b.itertuples(index=False):
                parts = _parts_of(phrases_of(unpacked(row.blob)))
                for number, some in _in_ranges(parts, row.lang, bounds):
                    yield row.lang, number, row.range, packed(automaton(some))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for (lang, number), rows in _groups(batches, ["lang", "range"]):
            known = None
            for origin, blob in ((row[2], row.blob) for row in rows):
                if origin == -1:
                    known = unpacked(blob)
                elif known is not None:
                    yield lang, origin, number, packed(automaton(composed(phrases_of(unpacked(blob)), known)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (lang, _), rows in _groups(batches, ["lang", "range"]):
            own, found = None, []
            for origin, blob in ((row[2], row.blob) for row in rows):
                if origin == -1:
                    own = phrases_of(unpacked(blob))
                else:
                    found.append(phrases_of(unpacked(blob)))
            if found:
                yield _scored(lang, own, united(found))

    shape, names = "lang string, range int, from int, blob binary", ["lang", "range", "from", "blob"]
    held = table.select("lang", "range", F.lit(-1).alias("from"), "blob")

    def met(rows: DataFrame) -> DataFrame:
        return held.unionByName(rows).repartition(n, "lang", "range").sortWithinPartitions("lang", "range", "from")

    asked = common.stored(table.mapInPandas(_task(ask, names), shape), "asked")
    answered = met(asked).mapInPandas(_task(answer, names), shape)
    return met(answered).mapInPandas(score, "lang string, phrase string, words int, a long, l long, r long, score long")


def without_inner(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """The candidates but for those that lie in a longer one with at least ``inside`` percent of their occurrences."""
    words = F.split("phrase", " ", -1)
    places = F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(0), F.col("words") - k), lambda i: F.array_join(F.slice(F.col("__words"), i + 1, k), " ")))
    longer = found.filter("words > 2").withColumn("__words", words).select("lang", "a", F.explode(F.array_distinct(F.flatten(places))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("__most"))
    return found.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("__most") < inside * F.col("a"), F.lit(True))).drop("__most")


def mine(documents: DataFrame, best: int = BEST, most: int = WORDS, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of each language."""
    spark = documents.sparkSession
    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(rows, RANGES * common.partitions(spark))
    table = counts(rows, bounds, most, least)
    found = common.stored(candidates(table, bounds), "candidates")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # one language may have most candidates: the best of parts of it are kept, then ranked by ranges
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    kept = without_inner(found, inside).withColumn("__r", F.row_number().over(parts)).filter(F.col("__r") <= best).drop("__r")
    placed = common.saved(common.running(kept, [F.asc("lang"), *order], {"__before": F.lit(1)}))
    starts = placed.groupBy("lang").agg(F.min("__before").alias("__start"))
    n = table.groupBy("lang").agg(F.sum("n").alias("n"))
    rank = F.col("__before") - F.col("__start") + 1
    ranked = common.joined_by(placed, starts.join(n, "lang"), ["lang"], "phrase").withColumn("rank", rank.cast("long"))
    return ranked.filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(documents: DataFrame) -> DataFrame:
    return mine(documents)


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM lists, (VALUES (1), (2), (3)) AS s(k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 10
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), parts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1)
), cuts AS (
  SELECT p.lang, p.phrase, p.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * p.a * p.a) // (l.a * r.a) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.lp JOIN f r ON r.lang = p.lang AND r.phrase = p.rp
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE k = 3
  ) GROUP BY ALL
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (
  SELECT b.*, n, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b JOIN total USING (lang) LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE coalesce(100 * i.most < 50 * b.a, true)
) WHERE rank <= 2000
"""
