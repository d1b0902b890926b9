"""Chroma audio fingerprints, and alignment of recordings by them.

A recording is cut into overlapping frames; the energy of each frame's spectrum is gathered into
twelve pitch classes and brought to length one. Sixteen rectangular filters slide over this
picture. Each compares the energy of two areas, read from an integral image by four look-ups an
area, and is quantised to two bits in Gray code; so every place gives an integer of 32 bits.

Recordings with equal fingerprints are one *print*. The search is an inverted index: a *mark* is
a place of a print, with a key made of the upper bits of the integer there and of another
``GAP`` places on; while the key does not change, only its first place is a mark. Marks of
queries and prints join on the key, and each meeting is a vote for (query, print, offset). Offsets with
enough votes in these histograms are candidates, and every one is verified by its share of differing
bits over the overlap; the best of a pair counts. So work follows the meetings of keys
and the candidates, not the pairs of recordings; Spark splits hot keys when the join runs.

Cases: null, undecodable or too short media have no integers and match nothing; copies of one
print always match; silence, and one tone held, has one mark, so it matches its copies only; repeated
rows are recordings each; ties go to the fewest bit errors, then the longest overlap, then the
least id, then the least offset; an empty table gives an empty result; other columns are not
read; long recordings are taken whole, in slices of frames.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

RATE = 4000
FRAME, HOP = 1024, 256
LOWEST, HIGHEST = 100.0, 1900.0
FILTERS = 16
#: Frames that one integer looks at.
SPAN = 16
#: Log ratios at which a filter's output changes its two bits.
LEVELS = (-0.25, 0.0, 0.25)
GRAY = (0, 1, 3, 2)
#: A key is made of this many upper bits of two integers so many places apart.
KEY_BITS, GAP = 12, 8
#: Votes that make an offset worth verifying, and the share of differing bits allowed.
VOTES, BIT_ERROR = 3, 0.25
#: Frames that must overlap.
OVERLAP = 32
#: Parts in which the recordings of one print are gathered first.
COPY_PARTS = 256
#: Meetings of equal keys that are held together.
AT_ONCE = 1_000_000
_BITS = np.array([bin(x).count("1") for x in range(65536)], np.uint8)


@lru_cache(maxsize=8)
def _classes(rate: int, frame: int) -> np.ndarray:
    """Spectrum bins x 12: which pitch class a bin's frequency is nearest to."""
    hz = np.arange(frame // 2 + 1) * rate / frame
    use = (hz >= LOWEST) & (hz <= HIGHEST)
    pitch = np.round(12 * np.log2(np.where(use, hz, 440.0) / 440.0)).astype(int) % 12
    out = np.zeros((len(hz), 12), np.float32)
    out[np.flatnonzero(use), pitch[use]] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames x 12: energy by pitch class, each frame of length one (zero for silence)."""
    count = 1 + (len(samples) - frame) // hop if len(samples) >= frame else 0
    out = np.zeros((count, 12), np.float32)
    window, classes = np.hanning(frame).astype(np.float32), _classes(rate, frame)
    views = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop] if count else samples
    for at in range(0, count, 1024):
        spectrum = np.fft.rfft(views[at : at + 1024].astype(np.float32) * window)
        out[at : at + 1024] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ classes
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-3), 0)


@lru_cache(maxsize=1)
def filters() -> tuple[tuple[tuple[int, int, int, int, int], ...], ...]:
    """Areas (sign, first frame, end frame, first class, end class) of each filter, by rule.

    Four shapes in turn: classes below against above, earlier against later frames, checkers,
    and the middle against both ends; heights, widths and places step with the number of the filter.
    """
    out = []
    for i in range(FILTERS):
        shape, height, width = i % 4, (4, 6, 8, 12)[i // 4], (4, 6, 12, 8)[(i + i // 4) % 4]
        low, left = (i * 5) % (12 - height + 1), (SPAN - width) // 2
        mid, right, half = low + height // 2, left + width, left + width // 2
        top = low + height
        if shape == 0:
            areas = [(1, left, right, low, mid), (-1, left, right, mid, top)]
        elif shape == 1:
            areas = [(1, left, half, low, top), (-1, half, right, low, top)]
        elif shape == 2:
            areas = [(1, left, half, low, mid), (1, half, right, mid, top), (-1, left, half, mid, top), (-1, half, right, low, mid)]
        else:
            a, b = low + height // 4, top - height // 4
            areas = [(1, left, right, a, b), (-1, left, right, low, a), (-1, left, right, b, top)]
        out.append(tuple(areas))
    return tuple(out)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The integers of a recording, uint32, one for each frame but the last SPAN - 1."""
    picture = chroma(np.asarray(samples), rate)
    places = len(picture) - SPAN + 1
    if places <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(picture) + 1, 13))
    image[1:, 1:] = picture.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    at, out = np.arange(places), np.zeros(places, np.uint32)
    for areas in filters():
        sums = {1: 0.0, -1: 0.0}
        for sign, t0, t1, c0, c1 in areas:
            sums[sign] = sums[sign] + image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]
        level = np.digitize(np.log((1 + np.maximum(sums[1], 0)) / (1 + np.maximum(sums[-1], 0))), LEVELS)
        out = (out << np.uint32(2)) | np.array(GRAY, np.uint32)[level]
    return out


def bit_errors(a: np.ndarray, b: np.ndarray) -> float:
    """Share of differing bits of two equally long stretches of integers."""
    x = a ^ b
    return float((_BITS[x & np.uint32(0xFFFF)].sum() + _BITS[x >> np.uint32(16)].sum()) / (32 * max(1, len(x))))


def overlap(query: np.ndarray, other: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches that meet if the query starts ``offset`` frames into the other."""
    a, b = max(0, -offset), max(0, offset)
    n = min(len(query) - a, len(other) - b)
    return query[a : a + n], other[b : b + n]


def marks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): where the key of a place differs from the one before."""
    upper = (codes >> np.uint32(32 - KEY_BITS)).astype(np.int64)
    keys = (upper[:-GAP] << KEY_BITS) | upper[GAP:] if len(upper) > GAP else upper[:0]
    places = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[places], places


def voted(query: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Offsets with enough votes, ascending."""
    (a, at_a), (b, at_b) = marks(query), marks(other)
    order = np.argsort(a, kind="stable")
    a, at_a = a[order], at_a[order]
    votes = np.zeros(len(query) + len(other), np.int64)
    lo, hi = np.searchsorted(a, b), np.searchsorted(a, b, side="right")
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(b):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        n = (hi - lo)[at:upto]
        hits = np.repeat(lo[at:upto], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        votes += np.bincount(np.repeat(at_b[at:upto], n) - at_a[hits] + len(query), minlength=len(votes))
        at = upto
    return np.flatnonzero(votes >= VOTES) - len(query)


def verified(query: np.ndarray, other: np.ndarray, offsets) -> tuple[int, float, int] | None:
    """(offset, bit error, frames) of the best of the offsets, or None if no stretches agree."""
    best = None
    for offset in offsets:
        a, b = overlap(query, other, int(offset))
        if len(a) >= OVERLAP and (error := bit_errors(a, b)) <= BIT_ERROR:
            best = min(best or (2.0, 0, 0), (error, -len(a), int(offset)))
    return best and (best[2], best[0], -best[1])


def align(query: np.ndarray, other: np.ndarray) -> tuple[int, float, int] | None:
    """(offset, bit error, frames) of the best offset with enough votes, or None."""
    return verified(query, other, voted(query, other))


def pcm16(media: bytes | None) -> np.ndarray:
    """Samples of raw little-endian 16-bit audio."""
    return np.frombuffer(media or b"", "<i2", len(media or b"") // 2).astype(np.float32) / 32768


def fingerprints(recordings: DataFrame, decode: Callable = pcm16, rate: int = RATE) -> DataFrame:
    """``id`` and ``codes`` (binary, uint32 each) from the columns id and media."""

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = [fingerprint(decode(m), rate).astype("<u4").tobytes() for m in b["media"]]
            yield pd.DataFrame({"id": b["id"], "codes": codes})

    rows = recordings.select(F.col("id").cast("string").alias("id"), "media")
    return rows.mapInPandas(in_task, "id string, codes binary").withColumn("id", F.col("id").cast(recordings.schema["id"].dataType))


def _marked(prints: DataFrame, name: str) -> DataFrame:
    """key, the print's number as ``name``, place: a row for each mark."""

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [marks(np.frombuffer(c, "<u4")) for c in b["codes"]]
            yield pd.DataFrame({name: b["print"], "keys": [k for k, _ in found], "places": [p.astype(np.int32) for _, p in found]})

    listed = prints.select("print", "codes").mapInPandas(in_task, f"{name} long, keys array<long>, places array<int>")
    return listed.select(name, F.inline(F.arrays_zip("keys", "places"))).withColumnsRenamed({"keys": "key", "places": name + "_at"})


def _matches(each: DataFrame, asked: DataFrame) -> DataFrame:
    """q, p, offset, error, frames: pairs of a query's print and another print that agree; ``asked`` has prints."""
    votes = _marked(asked, "q").join(_marked(each, "p"), "key").filter("q <> p")
    tally = votes.groupBy("q", "p", (F.col("p_at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("n")).filter(F.col("n") >= VOTES)
    pairs = common.saved(tally.groupBy("q", "p").agg(F.collect_list("offset").alias("offsets")))
    codes = each.select(F.col("print").alias("p"), F.col("codes").alias("p_codes"))
    with_codes = pairs.join(asked.select(F.col("print").alias("q"), F.col("codes").alias("q_codes")), "q").join(codes, "p")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, p, mine, other, offsets in zip(b["q"], b["p"], b["q_codes"], b["p_codes"], b["offsets"], strict=True):
                found = verified(np.frombuffer(mine, "<u4"), np.frombuffer(other, "<u4"), np.sort(offsets))
                if found is not None:
                    rows.append((q, p, *found))
            yield pd.DataFrame(rows, columns=["q", "p", "offset", "error", "frames"])

    return with_codes.select("q", "p", "q_codes", "p_codes", "offsets").mapInPandas(verify, "q long, p long, offset int, error double, frames int")


def search(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n_matches, best_id, best_offset, best_bit_error: all queries against all prints.

    Both have the columns id and codes. A recording never matches itself; the print of
    each query must be among the prints.
    """
    usable = F.col("id").isNotNull() & (F.length("codes") >= 4 * OVERLAP)
    # two least ids of each print; a hot print's copies are first cut into parts
    two = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), F.lit(1), F.lit(2))
    parts = prints.filter(usable).groupBy("codes", F.pmod(F.xxhash64("id"), F.lit(COPY_PARTS)).alias("part"))
    parts = parts.agg(F.count("*").alias("copies"), two(F.collect_set("id")).alias("ids"))
    each = parts.groupBy("codes").agg(F.sum("copies").alias("copies"), two(F.flatten(F.collect_list("ids"))).alias("ids"))
    each = common.stored(each.withColumn("print", F.monotonically_increasing_id()), "each-print")
    asked = common.saved(queries.filter(usable).select("id", "codes").distinct().join(each.select("codes", "print"), "codes").select("id", "print"))
    own = common.stored(each.join(asked.select("print").distinct(), "print"), "asked-prints")
    found = _matches(each, own).select("q", "p", "offset", "error", "frames")
    itself = own.select(F.col("print").alias("q"), F.col("print").alias("p"), F.lit(0).alias("offset"), F.lit(0.0).alias("error"), (F.length("codes") / 4).cast("int").alias("frames"))
    matched = found.unionByName(itself).join(each.select(F.col("print").alias("p"), "copies", "ids"), "p")
    matched = common.saved(matched.select("q", "copies", "ids", "error", "frames", "offset"))
    total = matched.groupBy("q").agg((F.sum("copies") - 1).alias("n_matches"))
    # the best two of different ids, so that each query can pass over its own id
    ranked = matched.select("q", F.explode("ids").alias("id"), "error", "frames", "offset").select("q", F.struct("error", (-F.col("frames")).alias("frames"), "id", "offset").alias("b"))
    first = common.saved(ranked.groupBy("q").agg(F.min("b").alias("first")))
    second = ranked.join(first, "q").filter(F.col("b.id") != F.col("first.id")).groupBy("q").agg(F.min("b").alias("second"))
    of_print = common.saved(total.join(first, "q").join(second, "q", "left").withColumnRenamed("q", "print"))
    best = F.when(F.col("first.id") != F.col("id"), F.col("first")).otherwise(F.col("second"))
    out = asked.join(of_print, "print").select(F.col("id").alias("query_id"), "n_matches", best.alias("b"))
    out = out.select("query_id", "n_matches", F.col("b.id").alias("best_id"), F.col("b.offset").alias("best_offset"), F.col("b.error").alias("best_bit_error"))
    # an id with several recordings: all their matches, and the best of them
    key = F.struct("best_bit_error", "best_id", "best_offset")
    again = out.groupBy("query_id").agg(F.sum("n_matches").alias("n_matches"), F.min(F.when(F.col("best_id").isNotNull(), key)).alias("b"))
    return again.select("query_id", "n_matches", F.col("b.best_id").alias("best_id"), F.col("b.best_offset").alias("best_offset"), F.col("b.best_bit_error").alias("best_bit_error"))


# ---- recordings derived from vectors ------------------------------------------------

NOTE = 500  # samples of a note
TONES = 24  # two octaves of half tones
LOW_NOTE = 220.0


@lru_cache(maxsize=1)
def _notes() -> np.ndarray:
    t = np.arange(NOTE) / RATE
    hz = LOW_NOTE * 2 ** (np.arange(TONES) / 12)
    fade = np.minimum(1, np.minimum(np.arange(NOTE), np.arange(NOTE)[::-1]) / 50)
    return (0.4 * np.sin(2 * np.pi * hz[:, None] * t) * fade * 32767).astype("<i2")


def melody(vector) -> bytes:
    """A vector as 16-bit audio: each element one note, its pitch by the element's share of the vector's length."""
    x = np.asarray([0.0 if v is None else v for v in vector] if vector is not None else [], np.float64)
    if not len(x):
        return b""
    x = np.nan_to_num(x)  # a null element is a nan by now
    scale = np.sqrt((x**2).mean()) or 1.0
    tone = np.clip(np.floor((x / scale + 3) / 6 * TONES), 0, TONES - 1).astype(int)
    return _notes()[tone].tobytes()


def report(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """All vectors as recordings: their fingerprints, and for queries (id divisible by ``every``) their matches.

    vec_id, n_codes, codes_crc32, is_query, n_matches, best_id, best_offset, best_bit_error
    """
    recordings = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("media"))
    prints = common.stored(fingerprints(recordings, lambda v: pcm16(melody(v))), "prints")
    found = search(prints, prints.filter(F.col("id") % every == 0))
    rows = prints.select(F.col("id").alias("vec_id"), (F.length("codes") / 4).cast("long").alias("n_codes"), F.crc32("codes").alias("codes_crc32"))
    asked = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    return rows.withColumn("is_query", asked).join(found.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
