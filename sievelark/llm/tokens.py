"""Token ids in patched frame-of-reference blocks.

Documents are range-partitioned by id, so that shards follow one another in id order. A shard is a
Parquet part file written and committed by Spark; its rows are segments of whole documents with about
``SEGMENT_IDS`` ids. The payload of a segment is a series of blocks of ``BLOCK_IDS`` ids:

    base u32 | count u16 | exceptions u16 | width u8 | packed low bits | u16 places | u32 high bits

(little-endian). A block subtracts its minimum and packs the ``width`` low bits, where ``width`` holds the
``PERCENTILE`` of its values; larger values put their remaining bits on the exception list.
``block_starts`` indexes the blocks of a payload, ``start`` the first position of the segment in its
shard, ``docs`` the documents with their numbers of ids. A reader that needs one position reads
one block; a reader that needs only the index does not touch the payload.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelark.llm import text as texts
from sievelark.plans.shared import new_path

END_ID = 2
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 16
PERCENTILE = 0.99
GROUP_BYTES = 1 << 23
MOST_CACHED, LONGEST_CACHED = 1_000_000, 64
"""Distinct pieces whose ids a worker process remembers, some 150 bytes each, and the longest of them."""

_HEADER = struct.Struct("<IHHB")
SEGMENTS = ("shard int, segment int, start long, n_ids long, docs array<struct<doc_id: long, n_tokens: long>>, "
            "block_starts array<int>, payload binary")


def _pack(values: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def _unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.zeros((count, 32), dtype=np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65,535 ids."""
    base = int(ids.min())
    rest = ids - np.uint32(base)
    at = max(0, int(np.ceil(percentile * len(rest))) - 1)
    width = int(np.partition(rest, at)[at]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    places = np.flatnonzero(high)
    low = rest & np.uint32((1 << width) - 1)
    return b"".join([_HEADER.pack(base, len(ids), len(places), width), _pack(low, width),
                     places.astype("<u2").tobytes(), high[places].astype("<u4").tobytes()])


def decode_block(payload: bytes, at: int = 0) -> np.ndarray:
    """The ids of the block that begins at ``at``."""
    base, count, exceptions, width = _HEADER.unpack_from(payload, at)
    at += _HEADER.size
    end = at + (count * width + 7) // 8
    ids = _unpack(payload[at:end], count, width)
    places = np.frombuffer(payload, "<u2", exceptions, end)
    high = np.frombuffer(payload, "<u4", exceptions, end + 2 * exceptions)
    if exceptions:
        ids[places] |= high << np.uint32(width)
    return ids + np.uint32(base)


def _kinds() -> np.ndarray:
    """Marks of bytes: 1 visible ASCII, 2 ASCII letter or digit, 4 ASCII punctuation, 8 may begin a character from A1 to 24F."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = 1
    for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        kinds[low:high] |= 2
    kinds[0x21:0x7F] |= np.where(kinds[0x21:0x7F] & 2, 0, 4).astype(np.uint8)
    kinds[0xC2:0xCA] |= 8
    return kinds


_KINDS = _kinds()


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 text where a byte-level tokenizer with the usual split surely begins a new token, whatever lies around.

    Before a space that a visible character follows; between a letter or digit and punctuation; behind a single line
    break between visible characters. Nothing to the left of such a place can change the tokens to its right, or the other way round.
    """
    kinds = np.append(_KINDS[data], np.zeros(2, np.uint8))
    after = np.append(data, np.zeros(2, np.uint8))
    lead, second = after[:-1], after[1:]
    accented = (lead >= 0xC3) & (lead <= 0xC8) | (lead == 0xC2) & (second >= 0xA1) | (lead == 0xC9) & (second <= 0x8F)
    visible = (kinds[:-1] & 1 > 0) | accented
    letter = kinds[: len(data)] & 2 > 0  # of the byte: it ends a letter or digit
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    starts = (data == 32) & visible[1 : len(data) + 1]
    starts[1:] |= (kinds[1 : len(data)] & 4 > 0) & letter[:-1]
    ends = letter | (kinds[: len(data)] & 4 > 0)
    starts[2:] |= (data[1:-1] == 10) & ends[:-2] & visible[2 : len(data)]
    return starts


class Encoder:
    """Whole texts to ids, equal to ``Tokenizer.encode`` of each text.

    A byte-level tokenizer without normaliser works on words and punctuation one by one. Texts are cut where
    ``piece_starts`` allows, Arrow numbers the distinct pieces of a group, each new one is encoded once with the library and
    remembered, and ids are gathered by number: only distinct pieces become Python objects.
    Texts that hold a special token, and all texts of other tokenizers, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        own = self.tokenizer.pre_tokenizer
        self.by_piece = (isinstance(own, pre_tokenizers.ByteLevel) and own.use_regex and not own.add_prefix_space
                         and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each token
        for token, number in vocabulary.items():
            self.width[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.limits = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # of all known pieces

    def _whole(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(values, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _spaced(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with a space and a visible character: encoded as one text and cut where they end."""
        found = self.tokenizer.encode_batch_fast(["".join(values)], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(v.encode()) for v in values])) + 1
        return ids, np.diff(ends, prepend=0)

    def _numbers(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each distinct piece in a pool of ids, the ids and their limits. Long pieces are not remembered."""
        if len(self.known) > MOST_CACHED:
            self._forget()
        number = list(map(self.known.get, pieces, repeat(-1)))
        new = np.flatnonzero(np.array(number) < 0).tolist()
        if not new:
            return np.array(number, np.int64), self.ids, self.limits
        spaced = [k for k in new if pieces[k][0] == " " and pieces[k][1:2].strip()]
        other = [k for k in new if not (pieces[k][0] == " " and pieces[k][1:2].strip())]
        spare: list[int] = []  # long pieces, known for this call only
        more: list[tuple[np.ndarray, np.ndarray]] = []
        for encode, own in ((self._spaced, spaced), (self._whole, other)):
            short = [k for k in own if len(pieces[k]) <= LONGEST_CACHED]
            long = [k for k in own if len(pieces[k]) > LONGEST_CACHED]
            if short:
                ids, counts = encode([pieces[k] for k in short])
                for n, k in enumerate(short, len(self.limits) - 1):
                    self.known[pieces[k]] = number[k] = n
                self.limits = np.concatenate([self.limits, self.limits[-1] + np.cumsum(counts)])
                self.ids = np.concatenate([self.ids, ids])
            if long:
                spare += long
                more.append(encode([pieces[k] for k in long]))
        for n, k in enumerate(spare, len(self.limits) - 1):
            number[k] = n
        ends = [self.limits[-1] + np.cumsum(np.concatenate([counts for _, counts in more]))] if more else []
        return (np.array(number, np.int64), np.concatenate([self.ids, *(ids for ids, _ in more)]), np.concatenate([self.limits, *ends]))

    def _by_piece(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = texts.text_bytes(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        edge = np.append(piece_starts(data), True)
        edge[offsets] = True  # a text begins a piece, whatever the end of the one before looks like
        limits = np.flatnonzero(edge)
        pieces = pa.Array.from_buffers(pa.large_string(), len(limits) - 1, [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(data)])
        coded = pc.dictionary_encode(pieces)
        number, pool, ends = self._numbers(coded.dictionary.to_pylist())
        place = coded.indices.to_numpy()
        begins, counts = ends[:-1].astype(np.int32)[number], np.diff(ends).astype(np.int32)[number]
        begins, counts = begins[place], counts[place]
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        ids = pool[np.repeat(begins - upto[:-1].astype(np.int32), counts) + np.arange(upto[-1], dtype=np.int32)]
        return ids, np.diff(upto[np.searchsorted(limits, offsets)])

    def encode(self, values: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_column(pa.array(values, pa.large_string()))
        return [part.astype("<u4").tobytes() for part in texts.split(ids, counts)]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        column = column.cast(pa.large_string())
        if not self.by_piece or not len(column):
            return self._whole(column.to_pylist())
        if not self.special:
            return self._by_piece(column)
        special = pc.match_substring_regex(column, self.special).to_numpy(zero_copy_only=False).astype(bool)
        if not special.any():
            return self._by_piece(column)
        parts = [None, None]
        for kind, encode in enumerate((self._by_piece, lambda c: self._whole(c.to_pylist()))):
            ids, counts = encode(column.filter(pa.array(special == bool(kind))))
            parts[kind] = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(())
        found = [next(parts[int(k)]) for k in special]
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder a worker process: its tasks share the vocabulary and what was learned."""
    return Encoder(path)


def _segment(shard: int, number: int, start: int, keys: pa.Array, counts: np.ndarray, ids: np.ndarray, percentile: float) -> pa.RecordBatch:
    blocks = [encode_block(ids[k : k + BLOCK_IDS], percentile) for k in range(0, len(ids), BLOCK_IDS)]
    starts = np.cumsum([0, *map(len, blocks[:-1])])
    docs = pa.StructArray.from_arrays([keys, pa.array(counts)], names=["doc_id", "n_tokens"])
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
         pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), docs), pa.array([starts.tolist()], pa.list_(pa.int32())),
         pa.array([b"".join(blocks)], pa.binary())],
        names=["shard", "segment", "start", "n_ids", "docs", "block_starts", "payload"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, percentile: float = PERCENTILE) -> None:
    """Encode every whole text and write the shards to ``path`` in ascending order of ids.

    NULL texts count as empty: such a document is its end id alone. Rows with equal ids are ordered by the
    hash of their text; NULL ids come first. An empty table writes no segments. Only the two columns
    are read, so others cannot clash.
    """
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_for(tokenizer), TaskContext.get().partitionId()
        number = start = held = 0
        keys: list[pa.Array] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, start, held
            row = _segment(shard, number, start, pa.concat_arrays(keys), np.concatenate(counts), np.concatenate(ids), percentile)
            number, start, held = number + 1, start + held, 0
            for part in (keys, counts, ids):
                part.clear()
            return row

        for batch in batches:
            offsets = texts.text_bytes(batch.column(1))[1]
            for low, high in texts.groups(offsets, GROUP_BYTES):
                found, sizes = encoder.encode_column(batch.column(1).slice(low, high - low))
                ends = np.cumsum(sizes)
                found, sizes = np.insert(found, ends, np.uint32(end_id)), sizes + 1
                ends = np.cumsum(sizes)
                at = taken = 0
                while at < len(sizes):  # a segment ends with the document that fills it
                    last = min(int(np.searchsorted(ends, taken + SEGMENT_IDS - held)) + 1, len(sizes))
                    keys.append(batch.column(0).slice(low + at, last - at))
                    counts.append(sizes[at:last])
                    ids.append(found[taken : ends[last - 1]])
                    held += int(ends[last - 1]) - taken
                    at, taken = last, int(ends[last - 1])
                    if held >= SEGMENT_IDS:
                        yield flush()
        if held:
            yield flush()
        pa.default_memory_pool().release_unused()

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                          F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encoded, SEGMENTS).write.option("compression", "none").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``base``, the number of ids in all shards before theirs.

    The running sum is over one row a shard.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return segments.join(F.broadcast(shards), "shard")


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files; with ``ids`` also
    the ids themselves."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(batch.schema.names.index(name)) for name in ("payload", "block_starts", "docs", "base", "start")}
            for n in range(batch.num_rows):
                payload, starts = column["payload"][n].as_buffer().to_pybytes(), column["block_starts"][n].values.to_numpy()
                docs = column["docs"][n].values
                values = np.concatenate([decode_block(payload, at) for at in starts.tolist()])
                counts = docs.field("n_tokens").to_numpy()
                limits = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(values.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[a:b]) for a, b in pairwise((4 * limits).tolist())]
                columns = [docs.field("doc_id"), pa.array(limits[:-1] + column["base"][n].as_py() + column["start"][n].as_py()),
                           pa.array(counts), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(texts.lists(values.astype(np.int64), counts, pa.int64()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return read_segments(spark, path).mapInArrow(decoded, schema)


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token ids (to a new place in the shared folder if ``path`` is not given) and read the
    files back: doc_id, start, n_tokens, ids_crc32."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_documents(docs.sparkSession, path)
