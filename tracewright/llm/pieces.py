"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding follows the model's merge rule: of all neighbouring symbols whose joined
string is a piece, the pair of best score is merged first, the leftmost on ties, until none
is left. With dropout, a keyed hash of (seed, document, place of the pair) decides for each
candidate on the agenda whether it is skipped. So a document gets one segmentation for
each seed, wherever and whenever it is encoded, another seed gives another one, and
words of equal spelling differ between their places. Every segmentation consists of
pieces of the model and decodes to the very text. Copies can be told apart by a number.

No piece holds a blank after another character, so texts are cut before blanks, and
the agendas of many short stretches run in step as numpy arrays: each step merges one
pair in each of them. Long stretches run on a heap.

Cases: null and empty texts have no pieces; characters that the model lacks, and the
sign that stands for a blank, are written as bytes; texts are taken whole; repeated rows are
encoded alike; with dropout 0 the result is that of the library, except for texts that
hold the blank's sign itself, which the library can't decode; other columns are kept.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tracewright.llm import common
from tracewright.llm.hashing import U64, mixed

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DROPOUT = 0.1
SEED = 1
BLANK = "▁"
#: Stretches up to the last of these lengths run in step, padded to the next of them.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 40)
#: Characters that are encoded together at most, but for one longer text.
TOGETHER = 400_000
_NONE = np.int32(2**30)
_ALL = 2**64 - 1


class Vocabulary:
    """Pieces of a model, the pieces of single characters, and the pairs that merge."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(names) if plain[i]}
        self.byte = np.full(256, -1, np.int32)
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.bytes = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(BLANK, " ").encode() if plain[i] else b"" for i in range(size)]
        # place of a piece in the order of merging: best score first
        order = np.argsort([-sp.get_score(i) for i in range(size)], kind="stable")
        rank = np.empty(size, np.int32)
        rank[order] = np.arange(size)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.blank = self.ids[BLANK]
        self.char[ord(BLANK)] = -1
        self.char[ord(" ")] = self.blank
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.rank = rank[self.merged]
        self.pairs = {(a, b): (int(r), c) for (a, b, c), r in zip(pairs, self.rank, strict=True)}
        for c in range(128):  # one byte, one id: such bytes need no later step
            if self.char[c] < 0:
                self.char[c] = self.byte[c]
        self._table(left * 65536 + right)

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing: slots of keys and of their places in the list of pairs."""
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        rest, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = self.slots[at] < 0
            first = np.zeros(len(rest), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slots[at[put]], self.values[at[put]] = keys[rest[put]], rest[put]
            rest, at = rest[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the list of pairs, -1 if it does not merge."""
        keys = left.astype(np.int64) * 65536 + right
        at = self._slot(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((got != keys) & (got >= 0) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out


@lru_cache(maxsize=4)
def vocabulary(model: str = MODEL) -> Vocabulary:
    return Vocabulary(model)


def document_key(seed: int, doc_id, copy: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}:{copy}" if copy else f"{seed}:{doc_id}")


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate of the characters start..middle and middle..end is skipped."""
    with np.errstate(over="ignore"):
        x = key + start.astype(U64) * U64(0x9E3779B97F4A7C15) + ((middle - start).astype(U64) << U64(32)) + (end - start).astype(U64)
    return mixed(x) < U64(_limit(dropout))


def _limit(dropout: float) -> int:
    return int(dropout * (2**64 - 1)) if dropout < 1 else _ALL


def _skipped_one(key: int, start: int, middle: int, end: int, limit: int) -> bool:
    """``skipped`` for one candidate."""
    x = (key + start * 0x9E3779B97F4A7C15 + ((middle - start) << 32) + end - start) & _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return (x ^ (x >> 31)) < limit


def encode(texts: list[str], keys: list[int], dropout: float = DROPOUT, vocab: Vocabulary | None = None) -> list[np.ndarray]:
    """Ids of each text. Memory follows ``TOGETHER`` characters or the longest text."""
    vocab, out, at = vocab or vocabulary(), [], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= TOGETHER):
            size += len(texts[upto])
            upto += 1
        out += _encode(texts[at:upto], keys[at:upto], dropout, vocab)
        at = upto
    return out


def _encode(texts: list[str], keys: list[int], dropout: float, vocab: Vocabulary) -> list[np.ndarray]:
    lengths = np.array([len(t) + 1 if t else 0 for t in texts])  # a blank goes before each text
    points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return [np.zeros(0, np.int32) for _ in texts]
    ids = vocab.char[points]
    doc_of = np.repeat(np.arange(len(texts)), lengths)
    begin = np.cumsum(lengths) - lengths
    key = np.array(keys, U64)[doc_of]
    place = np.arange(len(points)) - begin[doc_of]
    lone = (ids < 0) | vocab.is_byte[ids]
    opens = np.zeros(len(points), bool)
    blank = ids == vocab.blank
    opens[1:] = (blank[1:] & ~blank[:-1]) | lone[1:] | lone[:-1]
    opens[begin[lengths > 0]] = True
    starts = np.flatnonzero(opens)
    sizes = np.diff(np.append(starts, len(points)))
    alive = np.ones(len(points), bool)
    low = 1
    for width in WIDTHS:
        rows = starts[(sizes > low) & (sizes <= width)]
        if len(rows):
            _in_step(ids, alive, rows, sizes[(sizes > low) & (sizes <= width)], width, key, place, dropout, vocab)
        low = width
    for start, size in zip(starts[sizes > low].tolist(), sizes[sizes > low].tolist(), strict=True):
        _on_heap(ids, alive, start, size, key, place, dropout, vocab)
    return _split(ids, alive, points, doc_of, len(texts), vocab)


def _in_step(ids, alive, starts, sizes, width, key, place, dropout, vocab) -> None:
    """Merge all stretches of at most ``width`` characters together; one merge each in a step.

    Cells lie in one flat array, ``width`` and one more for each stretch, so that a
    stretch always ends in an empty cell. A symbol lives in the cell of its first character.
    """
    n, wide = len(starts), width + 1
    cells = starts[:, None] + np.arange(wide)[None, :]
    inside = np.arange(wide)[None, :] < sizes[:, None]
    symbol = np.where(inside, ids[np.minimum(cells, len(ids) - 1)], -1).astype(np.int32).ravel()
    after = np.arange(1, n * wide + 1, dtype=np.int32)
    before = np.arange(-1, n * wide - 1, dtype=np.int32)
    rank = np.full(n * wide, _NONE, np.int32)  # of the candidate that starts in a cell
    into = np.zeros(n * wide, np.int32)
    doc, base = key[starts], place[starts] - np.arange(n) * wide

    def candidates(row: np.ndarray, left: np.ndarray) -> None:
        """Put the candidates that start in cells ``left`` on the agenda."""
        right = after.take(left)
        pair = vocab.find(symbol.take(left), symbol.take(right))
        ok = np.flatnonzero(pair >= 0)
        left, pair = left.take(ok), pair.take(ok)
        if dropout > 0 and len(ok):
            row, right = row.take(ok), right.take(ok)
            at = base.take(row)
            keep = np.flatnonzero(~skipped(doc.take(row), at + left, at + right, at + after.take(right), dropout))
            left, pair = left.take(keep), pair.take(keep)
        rank[left] = vocab.rank.take(pair)
        into[left] = vocab.merged.take(pair)

    first = np.flatnonzero(inside[:, 1:].ravel())  # cells whose next one is inside, counted in rows of ``width``
    row = first // width
    candidates(row, first + row)
    live = np.arange(n)
    agenda = rank.reshape(n, wide)
    while len(live):
        column = agenda[live].argmin(axis=1)
        best = live * wide + column
        ready = rank.take(best) < _NONE
        if not ready.all():
            live, best = live[ready], best[ready]
        gone = after.take(best)
        symbol[best] = into.take(best)
        symbol[gone] = -1
        rank[gone] = rank[best] = _NONE
        then = after.take(gone)
        after[best] = then
        before[np.minimum(then, len(before) - 1)] = best
        previous = before.take(best)
        has = np.flatnonzero(previous >= live * wide)
        behind = previous.take(has)
        rank[behind] = _NONE
        candidates(np.concatenate([live, live.take(has)]), np.concatenate([best, behind]))
    inside = inside.ravel()
    flat, symbol = cells.ravel()[inside], symbol[inside]
    ids[flat] = symbol
    alive[flat] = symbol >= 0


def _on_heap(ids, alive, start, size, key, place, dropout, vocab) -> None:
    """One stretch with an agenda of its own."""
    symbol = ids[start : start + size].tolist()
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    agenda: list[tuple[int, int, int, int, int]] = []
    doc, base, limit = int(key[start]), int(place[start]), _limit(dropout)

    def candidate(left: int) -> None:
        right = after[left]
        if right >= size:
            return
        found = vocab.pairs.get((symbol[left], symbol[right]))
        if found is None:
            return
        end = after[right]
        if dropout > 0 and _skipped_one(doc, base + left, base + right, base + end, limit):
            return
        heapq.heappush(agenda, (found[0], left, right, end, found[1]))

    for left in range(size - 1):
        candidate(left)
    while agenda:
        _, left, right, end, merged = heapq.heappop(agenda)
        if symbol[left] < 0 or after[left] != right or symbol[right] < 0 or after[right] != end:
            continue
        symbol[left], symbol[right], after[left] = merged, -1, end
        if end < size:
            before[end] = left
        candidate(left)
        if before[left] >= 0:
            candidate(before[left])
    ids[start : start + size] = symbol
    alive[start : start + size] = np.array(symbol) >= 0


def _split(ids, alive, points, doc_of, n_docs, vocab) -> list[np.ndarray]:
    """Ids by document; characters without a piece become the pieces of their bytes."""
    ids, doc_of, points = ids[alive], doc_of[alive], points[alive]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        coded = [chr(p).encode("utf-8", "surrogatepass") for p in points[odd].tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[odd] = [len(c) for c in coded]
        first = np.cumsum(counts) - counts
        out = np.repeat(ids, counts)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        n = counts[odd]
        out[np.repeat(first[odd], n) + np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)] = vocab.byte[raw]
        ids, doc_of = out, np.repeat(doc_of, counts)
    ends = np.searchsorted(doc_of, np.arange(n_docs), side="right")
    return np.split(ids, ends[:-1])


def decode(ids: np.ndarray, vocab: Vocabulary | None = None) -> str:
    """The text that was encoded."""
    vocab = vocab or vocabulary()
    raw = b"".join([vocab.bytes[i] for i in ids.tolist()])
    return raw[1:].decode("utf-8", "surrogatepass")


def encode_documents(
    documents: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL, keep_text: bool = True, vary_copies: bool = False
) -> DataFrame:
    """``documents`` with ids: array<int>; a column of that name is replaced.

    Without ``keep_text`` the texts go to the tasks but don't come back, which spares copies of them.
    With ``vary_copies`` rows equal in all columns, as a mix repeats them, are numbered, and
    each gets a segmentation of its own.
    """

    rows = documents.drop("ids")
    rows = common.numbered(rows) if vary_copies else rows.withColumn("__nth", F.lit(0).cast("long"))
    rows = rows.withColumn("__key", F.col("doc_id").cast("string"))
    kept = [c for c in rows.columns if c not in ("__key", "__nth") and (keep_text or c != "text")]
    at_once = 128  # rows whose ids are held together

    def in_task(batches):
        import pyarrow as pa

        vocab = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                keys, copies, texts = (part.column(c).to_pylist() for c in ("__key", "__nth", "text"))
                ids = encode([t or "" for t in texts], [document_key(seed, d, n) for d, n in zip(keys, copies, strict=True)], dropout, vocab)
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                coded = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], coded], names=[*kept, "ids"])

    shape = StructType([*[rows.schema[c] for c in kept], StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(in_task, shape)


def decode_documents(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """``coded`` with text decoded from ids; null ids give null."""

    @F.pandas_udf("string")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(model)
        for ids in batches:
            yield pd.Series([None if i is None else decode(np.asarray(i), vocab) for i in ids], dtype=object)

    return coded.withColumn("text", plain(F.col("ids")))


def report(documents: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless: digests of the segmentation and of what it decodes to."""

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(model)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            ids = encode(texts, [document_key(seed, d) for d in b["doc_id"]], dropout, vocab)
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "n_tokens": [len(i) for i in ids],
                    "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids],
                    "lossless": [decode(i, vocab) == t for i, t in zip(ids, texts, strict=True)],
                }
            )

    kind = documents.schema["doc_id"].dataType
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    coded = rows.mapInPandas(in_task, "doc_id string, n_tokens long, ids_crc32 long, lossless boolean")
    return coded.withColumn("doc_id", F.col("doc_id").cast(kind))
