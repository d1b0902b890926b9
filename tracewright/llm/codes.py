"""Token ids in directly addressable codes.

File format. A token file is a Parquet folder; each row is a segment: some documents
in ascending order, at most ``SEGMENT_TOKENS`` tokens unless one document alone has more.
Segments are independent, so readers split and recover by rows. Columns:

    part, segment        order of the segments: range of ids, number within it
    doc_ids              bytes: int64 each; has_id: bytes, 0 where the id is null
    lengths              bytes: uint32 each, tokens of each document with its end id
    n_tokens, n_docs     counts
    levels               array of struct(chunks, more, ranks)

An id is cut into chunks of 8 bits, lowest first. Level 0 has the lowest chunk of every
token. Where more chunks follow, the token's bit in ``more`` is set, and its next chunk
stands in level 1 at the rank of that bit: the number of set bits before it.
``ranks`` holds that number at each 512th bit, so ``token_at`` reads any token with
one popcount of at most 64 bytes for each level, and decodes nothing else.

Cases: a null text is encoded as the empty one, which leaves its end id alone; null
ids come first; rows with one id are ordered by text within a range, and by their files between
ranges where they are too many for one; repeated rows are written each; an empty table gives no segments; columns beside doc_id and
text are not read; very long texts are taken whole and get a segment of their own.
"""

from __future__ import annotations

import itertools
import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
SEGMENT_TOKENS = 1_000_000
RANK_BITS = 512
#: What the tokenizer's vocabulary puts at the end of a word's last token.
WORD_END = "</w>"
#: Characters whose new pieces are learned together at most, but for one longer text.
TOGETHER = 2_500_000
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_SEGMENT = (
    "part int, segment int, doc_ids binary, has_id binary, lengths binary, n_tokens long, n_docs long, "
    "levels array<struct<chunks:binary,more:binary,ranks:binary>>"
)


# ---- the codes -------------------------------------------------------------------


def pack(ids: np.ndarray) -> list[dict]:
    """Levels of an array of ids below 2**32."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        higher = rest >> np.uint32(8)
        more = higher > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(_POPCOUNT[bits].astype(np.uint32), np.arange(0, len(bits), RANK_BITS // 8)) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4") if len(ones) else ones
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.tobytes()})
        if not more.any():
            return levels
        rest = higher[more]


def unpack(levels: list[dict]) -> np.ndarray:
    """All ids of packed levels."""
    ids, at = None, None
    for depth, level in enumerate(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8)
        if ids is None:
            ids, at = np.zeros(len(chunks), np.uint32), np.arange(len(chunks))
        ids[at] |= chunks.astype(np.uint32) << np.uint32(8 * depth)
        at = at[np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(chunks), bitorder="little").astype(bool)]
    return ids


def token_at(levels: list[dict], place: int) -> int:
    """One id, by rank directories only."""
    out = 0
    for depth, level in enumerate(levels):
        out |= level["chunks"][place] << (8 * depth)
        byte, bit = divmod(place, 8)
        more = level["more"]
        if not more[byte] >> bit & 1:
            break
        block = place // RANK_BITS
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        before = np.frombuffer(more[block * RANK_BITS // 8 : byte], np.uint8)
        place = rank + int(_POPCOUNT[before].sum()) + bin(more[byte] & ((1 << bit) - 1)).count("1")
    return out


# ---- encoding --------------------------------------------------------------------


class _Recent(dict):
    """A map of at most about ``most`` entries, and as many older ones, which come back when they are asked for."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def lacks(self, keys: Iterable) -> list:
        """Those of the keys that it does not hold, each once."""
        return list(itertools.filterfalse(self.old.__contains__, itertools.filterfalse(self.__contains__, dict.fromkeys(keys))))

    def make_room(self, n: int) -> bool:
        """Let the older entries go if so many more don't fit; whether they went."""
        if len(self) + n <= self.most:
            return False
        self.old = dict(self)
        self.clear()
        return True


def _cut(piece: str) -> tuple[str, ...]:
    """Parts of a piece that the tokenizer encodes apart: signs after letters; letters alone in lower case."""
    if piece.isascii() and piece.isalpha():
        return (piece.lower(),)
    head = piece.rstrip(string.punctuation)
    if not head.isalpha() or not (low := head.lower()).isalpha() or not unicodedata.is_normalized("NFC", head):
        return (piece,)
    tail, head = piece[len(head) :], head if "Σ" in head else low
    return (head, tail) if tail else (head,)


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str = TOKENIZER, most: int = 650_000):
    """A function from a list of texts to a list of id bytes (uint32), without end ids.

    Blanks and line ends part tokens for this tokenizer whatever stands around them, so
    texts are looked up piece by piece, and only new pieces go to the library. Parts of pieces
    are pieces themselves, so one map holds both.
    A worker keeps it, with the pieces it met lately, for the tasks that follow.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    names = tokenizer.get_vocab()
    closes = np.zeros(max(names.values()) + 1, bool)
    closes[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
    known = _Recent(most)

    def ids_of(strings: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def ids_of_words(words: list[str]) -> list[bytes]:
        """Words of letters alone go as one text; the signs of their ends part them again."""
        raw = ids_of([" ".join(words)])[0]
        ends = [0, *(4 * (np.flatnonzero(closes[np.frombuffer(raw, "<u4")]) + 1)).tolist()]
        return [raw[x:y] for x, y in itertools.pairwise(ends)] if len(ends) == len(words) + 1 else ids_of(words)

    def learn(pieces: list[str]) -> None:
        new = known.lacks(pieces)
        if known.make_room(2 * len(new)):
            new = known.lacks(pieces)
        cuts = [_cut(p) for p in new]
        words, others = [], []
        for x in known.lacks(itertools.chain.from_iterable(cuts)):
            (words if x.isalpha() and (x.isascii() or unicodedata.is_normalized("NFC", x)) else others).append(x)
        known.update(zip(words, ids_of_words(words), strict=True) if words else ())
        known.update(zip(others, ids_of(others), strict=True))
        for p, c in zip(new, cuts, strict=True):
            if len(c) > 1:
                known[p] = known[c[0]] + known[c[1]]
            elif c[0] != p:
                known[p] = known[c[0]]

    def encode_together(texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.values.dictionary_encode()
        pieces, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        learn(pieces)
        values = list(map(known.__getitem__, pieces))  # each piece of the texts once
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat(first[at] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[split.offsets.to_numpy()].tolist()
        return [out[x:y].tobytes() for x, y in itertools.pairwise(ends)]

    def encode(texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= TOGETHER):
                size += len(texts[upto])
                upto += 1
            out += encode_together(texts[at:upto])
            at = upto
        return out

    return encode


# ---- files -----------------------------------------------------------------------


def write(documents: DataFrame, path: str, tokenizer_path: str = TOKENIZER, end: int = END, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode all documents, in ascending order of their ids, into a token file."""
    n = common.partitions(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    # an id that fills many rows is dealt over several ranges
    dealt = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(n, order[0], "__place").sortWithinPartitions(*order)
    dealt = dealt.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text")

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, tail, part_of = encoder(tokenizer_path), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        ids, has, coded, size, number = [], [], [], 0, 0
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                for doc, known, code in zip(part["doc_id"], part["has_id"], encode(list(part["text"])), strict=True):
                    ids.append(doc)
                    has.append(known)
                    coded.append(code + tail)
                    size += len(code) // 4 + 1
                    if size >= segment_tokens:
                        yield _segment(part_of, ids, has, coded, number)
                        ids, has, coded, size, number = [], [], [], 0, number + 1
        if ids:
            yield _segment(part_of, ids, has, coded, number)

    dealt.mapInPandas(in_task, _SEGMENT).write.parquet(path)


def _segment(part: int, ids: list, has: list, coded: list[bytes], number: int) -> pd.DataFrame:
    tokens = np.frombuffer(b"".join(coded), "<u4")
    lengths = np.array([len(c) // 4 for c in coded], "<u4")
    return pd.DataFrame(
        {
            "part": [part], "segment": [number], "doc_ids": [np.array(ids, "<i8").tobytes()], "has_id": [np.array(has, np.uint8).tobytes()],
            "lengths": [lengths.tobytes()], "n_tokens": [len(tokens)], "n_docs": [len(ids)], "levels": [pack(tokens)],
        }
    )


def read(spark, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32.

    Starts come from the counts of the segments alone, summed over their global order.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)
    heads = segments.select("part", "segment", "n_tokens")
    order = [F.col("part"), F.col("segment")]
    starts = common.saved(common.running(heads, order, {"start": F.col("n_tokens")}).drop("n_tokens"))
    small = common.small_side(starts)
    placed = segments.join(starts if small is None else small, ["part", "segment"])

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(unpack(row.levels).astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                ids = pd.array(np.frombuffer(row.doc_ids, "<i8"), dtype="Int64")
                ids[np.frombuffer(row.has_id, np.uint8) == 0] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": row.start + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs})

    columns = ("doc_ids", "has_id", "lengths", "levels", "start")
    return placed.select(*columns).mapInPandas(in_task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, position, token for each wanted (doc_id, position); positions count from 0 within a document.

    Documents are found by the lists of ids and lengths alone. Of the codes only the segments
    that hold a wanted token are read, and in them only the bytes that ``token_at`` touches are
    decoded. A position beyond its document has no row; rows of one id are all looked up.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)

    def documents_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                lengths, has = np.frombuffer(row.lengths, "<u4").astype(np.int64), np.frombuffer(row.has_id, np.uint8) > 0
                ids = np.frombuffer(row.doc_ids, "<i8")
                yield pd.DataFrame({"part": row.part, "segment": row.segment, "doc_id": ids, "first": np.cumsum(lengths) - lengths, "n": lengths})[has]

    places = segments.select("part", "segment", "doc_ids", "has_id", "lengths").mapInPandas(documents_of, "part int, segment int, doc_id long, first long, n long")
    small = common.small_side(wanted.select("doc_id", "position").distinct())
    asked = wanted.select("doc_id", "position").distinct() if small is None else small
    at = places.join(asked, "doc_id").filter((F.col("position") >= 0) & (F.col("position") < F.col("n")))
    at = at.select("part", "segment", "doc_id", "position", (F.col("first") + F.col("position")).alias("place"))

    def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                found = [token_at(row.levels, w["place"]) for w in row.wanted]
                yield pd.DataFrame({"doc_id": [w["doc_id"] for w in row.wanted], "position": [w["position"] for w in row.wanted], "token": found})

    by_segment = at.groupBy("part", "segment", F.floor(F.col("place") / 65536).alias("stretch")).agg(F.collect_list(F.struct("doc_id", "position", "place")).alias("wanted"))
    return segments.select("part", "segment", "levels").join(by_segment, ["part", "segment"]).select("levels", "wanted").mapInPandas(tokens_of, "doc_id long, position long, token long")


def report(documents: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """Write the documents as a token file in the shared folder, and read it back."""
    import uuid

    spark = documents.sparkSession
    path = f"{common.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents, path, tokenizer_path)
    return read(spark, path)
