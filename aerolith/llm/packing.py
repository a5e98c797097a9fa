"""Packing of token sequences with minimum bin slack (op7).

Method: bins are filled one after another. The longest piece left opens a bin; a subset-sum dynamic
program over a bitset of reachable fill levels, fed with the lengths still available, finds the
fullest combination for the rest of the bin, and its pieces are removed. Pieces are spread at random
over groups of bounded size that are packed independently, so the work is spread and a group wastes
part of one bin of thousands. Which pieces a group has depends on their documents' ids and their
tokens, so rows that share an id, or have none, spread like others; a group orders its pieces by the
same, and those that agree in all can take each other's place, so a repeated task gives the same answer.

Edge cases: a null or empty text has its end id only; repeated rows are packed as often as they
occur; null ids are packed like others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import pieces, released, table, utf8, without
from ._tokens import WORD_LEVEL, encoder, resolved
from ._words import sliced

CAPACITY = 4096
END_ID = 1
#: Pieces that are packed together, on average.
GROUP_PIECES = 30_000
#: Bytes of text that a worker takes from Arrow and encodes together, and how many in the pipeline, where it needs less memory but somewhat more time.
TEXTS, FEWER_TEXTS = 4 << 20, 1 << 20


def token_pieces(docs: DataFrame, *, tokenizer: str = WORD_LEVEL, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cut_bytes: int = TEXTS) -> DataFrame:
    """One row per piece: id, piece (int), start, length (long), ids (binary: little-endian unsigned 32 bits)."""
    path = resolved(tokenizer)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def whole(owners: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(counts + 1)
        ended = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
        n_pieces = -(-(counts + 1) // capacity)
        of = np.repeat(np.arange(len(owners)), n_pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        start = piece * capacity
        length = np.minimum((counts + 1)[of] - start, capacity)
        offsets = np.concatenate((((ends - counts - 1)[of] + start), ends[-1:])) * 4
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(ended.tobytes())])
        return pa.RecordBatch.from_arrays([owners.take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), held.cast(pa.binary())], [id_col, "piece", "start", "length", "ids"])

    def cuts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        first = 0
        for _, texts in sliced(batch, cut_bytes):
            yield first, texts
            first += len(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for first, texts in cuts(batch):
                for i, j, ids, counts in own.encode(texts):
                    yield whole(batch.column(0).slice(first + i, j - i), ids, counts)
        released()

    return docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(cut, schema)


def fullest(lengths: list[int], counts: list[int], gap: int) -> list[int]:
    """Lengths, at most counts[l] of each, whose sum is the largest that is not over gap.

    lengths: those available, longest first.
    """
    full = 1 << gap
    below = (full << 1) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > gap:
            continue
        left, many = min(counts[length], gap // length), 1
        while left > 0:
            many = min(many, left)
            wider = (reach | (reach << (many * length))) & below
            if wider != reach:
                steps.append((reach, length, many))
                reach = wider
            left -= many
            many *= 2
        if reach & full:
            break
    level, out = reach.bit_length() - 1, []
    for before, length, many in reversed(steps):
        if not before >> level & 1:
            out += [length] * many
            level -= length * many
    return out


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there. Items of equal length are taken in their order."""
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    by_length = np.argsort(lengths, kind="stable")
    next_at = (np.cumsum(counts) - counts).tolist()
    there = [x for x in range(capacity, 0, -1) if counts[x]]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    of_bin = 0
    while there:
        first = there[0]
        counts[first] -= 1
        rest = [] if first == capacity else [capacity - first] if counts[capacity - first] else fullest(there, counts, capacity - first)
        for x in rest:
            counts[x] -= 1
        at = 0
        for x in (first, *rest):
            item = by_length[next_at[x]]
            next_at[x] += 1
            bins[item], offsets[item] = of_bin, at
            at += x
        of_bin += 1
        if not all(counts[x] for x in (first, *rest)):
            there = [x for x in there if counts[x]]
    return bins, offsets


def pack(rows: DataFrame, n_groups: int, *, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """rows, which have a `length` of 1 to capacity, with sequence_id and offset (long); keys order them within a group."""
    rows = without(rows, "sequence_id", "offset", "_group")
    out = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = rows.columns

    def packed(t: pa.Table) -> pa.Table:
        group = t["_group"][0].as_py()
        t = t.sort_by([(k, "ascending") for k in keys]).select(names)
        bins, offsets = minimum_bin_slack(np.asarray(t["length"].to_numpy(), np.int64), capacity)
        return t.append_column("sequence_id", pa.array(bins + (group << 36), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return rows.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(n_groups)).cast("long")).groupBy("_group").applyInArrow(packed, out)


def groups_for(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY) -> int:
    """How many groups give about GROUP_PIECES pieces each; bytes are taken as half a token."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)))).first()
    return pieces(n + (size or 0) // (2 * capacity), GROUP_PIECES)


def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame, cut_bytes: int = TEXTS) -> DataFrame:
    docs = docs.select("doc_id", "text")
    cut = token_pieces(docs, cut_bytes=cut_bytes).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut, groups_for(docs), keys=["doc_id", "piece", "length", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs, FEWER_TEXTS)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


QUERIES = {"op7_minimum_bin_slack": op7_minimum_bin_slack}
ORACLE_SQL: dict[str, str] = {}
