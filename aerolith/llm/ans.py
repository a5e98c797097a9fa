"""Token ids in files of static range asymmetric numeral system (rANS) segments (op8).

Documents are put in order of their id by a range partitioning. Each partition is cut at document
ends into segments; a segment has one frequency table, shared by its blocks. A block's tokens go
round-robin to LANES interleaved coder states. Its states and the place of its words are a
checkpoint, and it has a checksum, so every block can be decoded alone and at once with the others.

A file is Parquet with one row per segment: part, segment, start (ids before it in its part), the
documents' ids and lengths, and the coded segment. A segment, little-endian: magic, counts, the
zstd-packed table (token ids, frequencies), then for each block its states, word places and crc32,
then 32-bit words.

Edge cases: null text is empty and so has the end id only; documents of null id come first; repeated
ids keep one row each; an empty table gives empty files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import pieces, released, shared_folder, table, utf8
from ._tokens import BYTE_LEVEL, encoder, resolved

END_ID = 2
SEGMENT_TOKENS, BLOCK_TOKENS, LANES = 2 << 20, 32 << 10, 64
#: Text bytes in a partition, on average.
PART_BYTES = 24 << 20
_MAGIC, _HEAD = b"RANS", "<4sIIIIIQQ"
_LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)


class Corrupt(ValueError):
    pass


def quantized(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2 ** bits."""
    freq = np.maximum(1, (counts * (float(1 << bits) / counts.sum())).astype(np.int64))
    over = int(freq.sum()) - (1 << bits)
    if over < 0:
        freq[np.argmax(freq)] -= over
    while over > 0:
        top = np.argsort(freq, kind="stable")[::-1][: max(1, min(over, len(freq) // 2))]
        take = np.minimum(freq[top] - 1, max(1, over // len(top)))
        take[np.cumsum(take) > over] = 0
        freq[top] -= take
        over -= int(take.sum())
    return freq


def encode_segment(ids: np.ndarray, *, block_tokens: int = BLOCK_TOKENS, lanes: int = LANES) -> bytes:
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[symbols] = np.arange(len(symbols))
    index, counts = place[ids], counts[symbols]
    bits = max(12, min(24, int(len(ids) - 1).bit_length(), 20), int(len(symbols)).bit_length())
    freq = quantized(counts, bits)
    n_blocks = -(-len(ids) // block_tokens)
    steps = -(-len(ids) // (n_blocks * lanes))
    padded = np.full(n_blocks * steps * lanes, np.argmax(freq), np.int64)
    padded[: len(ids)] = index
    grid = padded.reshape(n_blocks, steps, lanes)
    f_of, c_of = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    state = np.full((n_blocks, lanes), _LOW, np.uint64)
    words = np.zeros((n_blocks, steps, lanes), np.uint32)
    sent = np.zeros((n_blocks, steps, lanes), bool)
    shift, wide = np.uint64(bits), np.uint64(63 - bits)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        f = f_of[s]
        full = state >= f << wide
        words[:, t], sent[:, t] = state.astype(np.uint32), full
        state = np.where(full, state >> _U32, state)
        q = state // f
        state = (q << shift) + (state - q * f) + c_of[s]
    places = np.concatenate(([0], np.cumsum(sent.sum((1, 2))))).astype("<u8")
    size = steps * lanes
    checks = np.array([zlib.crc32(ids[b * size : (b + 1) * size].astype("<u4").tobytes()) for b in range(n_blocks)], "<u4")
    packed = zstandard.ZstdCompressor(level=3).compress(np.diff(symbols.astype("<u4"), prepend=np.uint32(0)).tobytes() + freq.astype("<u4").tobytes())
    head = struct.pack(_HEAD, _MAGIC, n_blocks, steps, lanes, bits, len(symbols), len(ids), len(packed))
    return b"".join((head, packed, state.astype("<u8").tobytes(), places.tobytes(), checks.tobytes(), words[sent].astype("<u4").tobytes()))


def decode_segment(coded: bytes, blocks: tuple[int, int] | None = None) -> np.ndarray:
    """The ids of blocks[0] up to blocks[1], by default all; raises Corrupt if a checksum is wrong."""
    if len(coded) < struct.calcsize(_HEAD):
        raise Corrupt("a segment is cut short")
    magic, n_blocks, steps, lanes, bits, n_symbols, n_ids, n_packed = struct.unpack_from(_HEAD, coded)
    if magic != _MAGIC:
        raise Corrupt("no segment")
    at = struct.calcsize(_HEAD)
    raw = zstandard.ZstdDecompressor().decompress(coded[at : at + n_packed])
    symbols = np.cumsum(np.frombuffer(raw, "<u4", n_symbols), dtype=np.uint32)
    freq = np.frombuffer(raw, "<u4", n_symbols, 4 * n_symbols).astype(np.int64)
    at += n_packed
    states = np.frombuffer(coded, "<u8", n_blocks * lanes, at).reshape(n_blocks, lanes)
    at += 8 * n_blocks * lanes
    places = np.frombuffer(coded, "<u8", n_blocks + 1, at).astype(np.int64)
    at += 8 * (n_blocks + 1)
    checks = np.frombuffer(coded, "<u4", n_blocks, at)
    words = np.frombuffer(coded, "<u4", -1, at + 4 * n_blocks).astype(np.uint64)
    lo, hi = blocks or (0, n_blocks)
    words = np.append(words, np.uint64(0))
    of_slot = np.repeat(np.arange(n_symbols, dtype=np.int32), freq)
    f_of, c_of = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    state, place = states[lo:hi].copy(), places[lo:hi].copy()
    out = np.empty((hi - lo, steps, lanes), np.int32)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    for t in range(steps):
        slot = state & mask
        s = of_slot[slot.astype(np.int64)]
        out[:, t] = s
        state = f_of[s] * (state >> shift) + slot - c_of[s]
        low = state < _LOW
        order = np.cumsum(low, axis=1)
        state = np.where(low, (state << _U32) | words[np.minimum(place[:, None] + order - 1, len(words) - 1)], state)
        place += order[:, -1]
    size = steps * lanes
    ids = symbols[out.reshape(-1)][: max(0, min(n_ids, hi * size) - lo * size)]
    for b in range(lo, hi):
        if zlib.crc32(ids[(b - lo) * size : (b - lo + 1) * size].astype("<u4").tobytes()) != checks[b]:
            raise Corrupt(f"block {b} has a wrong checksum")
    return ids


_SCHEMA = "part int, segment int, start long, n_tokens long, null_ids binary, doc_ids binary, lengths binary, coded binary"


def write(docs: DataFrame, path: str, *, tokenizer: str = BYTE_LEVEL, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS, part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of all texts, each with end_id, in ascending order of an integer id."""
    vocabulary = resolved(tokenizer)
    n = pieces(docs.agg(F.sum(F.octet_length(F.col(text_col)) + 32)).first()[0], part_bytes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        ids, lengths, doc_ids, held, segment, start = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            nulls = np.packbits([x is None for x in doc_ids]).tobytes()
            keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
            values = (part, segment, start, len(whole), nulls, keys, np.concatenate(lengths).astype("<u4").tobytes(), encode_segment(whole))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, types)], [x.split()[0] for x in _SCHEMA.split(", ")])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, found, counts in own.encode(batch.column(1).to_pylist()):
                ends = np.cumsum(counts)
                whole = np.insert(found, ends, end_id).astype(np.uint32)
                ends = ends + np.arange(1, j - i + 1)
                a = 0
                while a < j - i:
                    here = ends[a - 1] if a else 0
                    b = min(j - i, int(np.searchsorted(ends, here + segment_tokens - held, "left")) + 1)
                    ids.append(whole[here : ends[b - 1]])
                    lengths.append(counts[a:b] + 1)
                    doc_ids += keys[i + a : i + b]
                    held += int(ends[b - 1] - here)
                    a = b
                    if held >= segment_tokens:
                        yield row()
                        segment, start = segment + 1, start + held
                        ids, lengths, doc_ids, held = [], [], [], 0
        if doc_ids:
            yield row()
        released()

    ordered = docs.select(F.col(id_col).cast("long").alias("_id"), utf8(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    # rows of one id, or of none, are cut by the hash of their text; so ties have an order that a repeated task keeps
    ordered = ordered.repartitionByRange(n, "_id", "_hash").sortWithinPartitions("_id", "_hash").drop("_hash")
    ordered.mapInArrow(coded, _SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Of files that write() made: id, start, n_tokens (long), ids (binary: little-endian unsigned 32 bits).

    The sums of the parts are broadcast: one row per partition that was written.
    """
    files = spark.read.schema(_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    schema = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(x, T.LongType()) for x in ("start", "n_tokens")), T.StructField("ids", T.BinaryType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                ids = decode_segment(at["coded"]).astype("<u4")
                lengths = np.frombuffer(at["lengths"], "<u4").astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(lengths)))
                nulls = np.unpackbits(np.frombuffer(at["null_ids"], np.uint8), count=len(lengths)).astype(bool)
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer((ends * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(at["doc_ids"], "<i8"), pa.int64(), mask=nulls), pa.array(ends[:-1] + at["start"] + at["before"], pa.int64()), pa.array(lengths, pa.int64()), held.cast(pa.binary())], schema.names)

    return files.join(F.broadcast(before), "part").select("start", "before", "null_ids", "doc_ids", "lengths", "coded").mapInArrow(decoded, schema)


def op8_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "rans")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_rans_tokens": op8_rans_tokens}
ORACLE_SQL: dict[str, str] = {}
