"""Removal of byte strings that an earlier document already has (op2).

Method: a distributed merge sort of suffixes that is aware of common prefixes. Every window of
`window` bytes picks an anchor by content (see _grams), so the suffixes at the anchors, each with
the bytes before it that its windows need, stand for all windows. Each chunk of documents sorts its
suffixes to a run, front-codes it and sends it out cut by key range; the receivers merge the runs
with a loser tree that compares strings only beyond the prefix known to be equal, and so learn the
common prefix of neighbours. From these follow the groups of equal windows and their smallest
document. What goes back to a chunk is one bit for each window of each suffix.

Before that, one exchange of anchor fingerprints finds the anchors that more than one chunk has;
all other suffixes are settled inside their chunk and never sent. A suffix that a chunk holds often
is sent once. So a passage that a third of all documents share costs each receiver one entry per
chunk.

Edge cases: null text is empty; texts shorter than the window are kept whole; matches never cross
documents; documents of equal id don't affect each other; a null id counts as larger than all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._grams import Anchors, _slide, anchors, fingerprints, gram_length
from ._spark import pieces, released, table, trimmed, utf8, without

WINDOW = 50
#: Text of a chunk, and of what a key range gets suffixes of, on average.
CHUNK_BYTES, RANGE_BYTES = 5 << 20, 12 << 20
#: Larger chunks find more suffixes settled inside and so send fewer, but a worker needs more memory; rows of the
#: query are an id and a text, those of the pipeline whole documents.
QUERY_CHUNK_BYTES = 8 << 20
#: Suffixes whose bytes a chunk has spread out at once, and bytes of texts that are counted at once.
PART, BLOCK = 1 << 15, 1 << 18
_LAST = np.iinfo(np.int64).max
#: Suffixes are ordered by the fingerprint of their first gram, big-endian, then by their bytes:
#: so ranges of equal width hold equally many of them, whatever the language.
_KEY = 8


# ---------------------------------------------------------------- suffixes of a chunk


class Chunk:
    """The texts of one chunk end to end, and their anchors."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, ids: np.ndarray, window: int):
        flat = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if isinstance(flat, pa.ChunkedArray):
            flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.large_binary())
        flat = flat.cast(pa.large_binary())
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        held = flat.buffers()[2] if len(flat) else None
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        self.bounds = (offsets - offsets[0]).astype(np.int64)
        self.data = data[int(offsets[0]) : int(offsets[-1])]
        self.ids, self.window = ids, window
        self.anchors = anchors(self.data, self.bounds, window)
        self.keys = fingerprints(self.data, self.anchors.at, gram_length(window))

    def suffixes(self, picked: np.ndarray) -> Suffixes:
        a, w = Anchors(*(x[picked] for x in self.anchors)), self.window
        back = w - gram_length(w)
        padded = np.concatenate((np.zeros(back, np.uint8), self.data, np.zeros(w, np.uint8)))
        right, left = np.empty((len(a.at), w), np.uint8), np.empty((len(a.at), back), np.uint8)
        for i in range(0, len(a.at), 1 << 12):
            s = slice(i, i + (1 << 12))
            around = padded[a.at[s, None] + np.arange(back + w)]
            left[s], right[s] = around[:, :back], around[:, back:]
        n_right, n_left = a.last + w - a.at, a.at - a.first
        right[np.arange(w) >= n_right[:, None]] = 0
        left[np.arange(back)[::-1] >= n_left[:, None]] = 0
        owner = np.searchsorted(self.bounds, a.at, "right") - 1
        return Suffixes(self.keys[picked], right, n_right.astype(np.uint8), left, n_left.astype(np.uint8), self.ids[owner])


class Suffixes:
    """Suffixes at anchors: key, bytes from the anchor on, bytes before it (at the right end), document."""

    def __init__(self, keys, right, n_right, left, n_left, docs):
        self.keys, self.right, self.n_right, self.left, self.n_left, self.docs = keys, right, n_right, left, n_left, docs

    def __len__(self) -> int:
        return len(self.keys)

    def take(self, order: np.ndarray) -> Suffixes:
        return Suffixes(*(x[order] for x in (self.keys, self.right, self.n_right, self.left, self.n_left, self.docs)))

    def strings(self) -> np.ndarray:
        return np.concatenate((self.keys.astype(">u8").view(np.uint8).reshape(len(self), _KEY), self.right), axis=1)

    def order(self) -> np.ndarray:
        whole = np.concatenate((self.strings(), self.n_right[:, None] + 1, self.left, self.n_left[:, None] + 1), axis=1)
        return np.argsort(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel(), kind="stable")

    def same_as_before(self) -> np.ndarray:
        """Whether a sorted suffix has the bytes and windows of the one before."""
        same = np.zeros(len(self), bool)
        same[1:] = (self.keys[1:] == self.keys[:-1]) & (self.n_right[1:] == self.n_right[:-1]) & (self.n_left[1:] == self.n_left[:-1]) & (self.right[1:] == self.right[:-1]).all(1) & (self.left[1:] == self.left[:-1]).all(1)
        return same


def common_prefixes(strings: np.ndarray) -> np.ndarray:
    """Of each sorted string with the one before; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        differs = strings[1:] != strings[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), strings.shape[1])
    return out


def earlier_windows(prefixes, n_right, left, n_left, docs, window: int) -> np.ndarray:
    """For each suffix, sorted, bit d: another one has the window d bytes before the anchor, in a smaller document."""
    found = np.zeros(len(docs), np.uint64)
    before = np.zeros(len(docs), np.uint64)
    for d in range(left.shape[1] + 1):
        if d:
            before = (before ^ (left[:, -d].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            before ^= before >> np.uint64(29)
        at = np.flatnonzero((n_left >= d) & (n_right >= window - d))
        if len(at) < 2:
            continue
        group = np.cumsum(prefixes < _KEY + window - d)[at].astype(np.uint64)
        key = (group * np.uint64(0xD6E8FEB86659FD93)) ^ before[at]
        order = np.argsort(key, kind="stable")
        key, own = key[order], docs[at][order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.concatenate((starts, [len(key)]))))
        hit = at[order[least < own]]
        found[hit] |= np.uint64(1 << d)
    return found


# ---------------------------------------------------------------- front-coded runs


def pack_run(run: Suffixes) -> bytes:
    strings = run.strings()
    prefixes = common_prefixes(strings)
    ends = run.n_right.astype(np.int64) + _KEY
    place = np.arange(strings.shape[1])
    rest = strings[(place >= prefixes[:, None]) & (place < ends[:, None])]
    left = run.left[np.arange(run.left.shape[1])[::-1] < run.n_left[:, None].astype(np.int64)]
    raw = b"".join(x.tobytes() for x in (np.array([len(run), len(rest), len(left)], np.int64), prefixes.astype(np.uint8), run.n_right, run.n_left, run.docs.astype(np.int64), left, rest))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_run(packed: bytes, window: int):
    """prefixes, n_right, n_left, docs, left, and the strings themselves, rebuilt from the front coding."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, n_rest, n_bytes = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24
    prefixes, n_right, n_left = (np.frombuffer(raw, np.uint8, n, at + i * n) for i in range(3))
    docs = np.frombuffer(raw, np.int64, n, at + 3 * n)
    back = window - gram_length(window)
    left = np.zeros((n, back), np.uint8)
    left[np.arange(back)[::-1] < n_left[:, None].astype(np.int64)] = np.frombuffer(raw, np.uint8, n_bytes, at + 11 * n)
    rest = raw[at + 11 * n + n_bytes : at + 11 * n + n_bytes + n_rest]
    strings, last, here, width = [], b"", 0, _KEY + window
    for prefix, end in zip(prefixes.tolist(), (n_right.astype(np.int64) + _KEY).tolist()):
        new = max(0, end - prefix)
        last = (last[:prefix] + rest[here : here + new]).ljust(width, b"\0")
        here += new
        strings.append(last)
    return prefixes, n_right, n_left, docs, left, strings


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs with a loser tree.

    runs: each run's strings and the common prefix of each with the one before in its run. Returns the
    run that each output entry came from, and its common prefix with the entry before. At each node
    stands a loser with its common prefix with the winner that passed; of two contenders the one with
    the longer prefix is smaller, and only contenders with equal prefixes are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ends = [len(r[0]) for r in runs] + [0] * (k - len(runs))
    heads = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (k - len(runs))
    known = [0 if n else -1 for n in ends]
    at = [0] * k
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        la, lb = known[a], known[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        x, y = heads[a][la:], heads[b][la:]
        if x == y:
            if a > b:
                a, b = b, a
            known[b] = la + len(x)
            return a, b
        n = 0
        while x[n : n + 8] == y[n : n + 8]:
            n += 8
        while x[n] == y[n]:
            n += 1
        if x[n] > y[n]:
            a, b = b, a
        known[b] = la + n
        return a, b

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    out_run, out_prefix = [], []
    for _ in range(sum(ends)):
        out_run.append(best)
        out_prefix.append(known[best])
        at[best] = i = at[best] + 1
        if i < ends[best]:
            heads[best] = runs[best][0][i]
            known[best] = runs[best][1][i]
        else:
            known[best] = -1
        node = (best + k) >> 1
        while node:
            other = tree[node]
            la, lb = known[best], known[other]
            if la < lb:
                tree[node], best = best, other
            elif la == lb and la >= 0:
                best, tree[node] = play(best, other)
            node >>= 1
    return out_run, out_prefix


# ---------------------------------------------------------------- Spark


def _range_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of those of n equal key ranges that have keys."""
    of = _range_of(sorted_keys, n)
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    yield from zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)])


def _parts(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring pieces, whose bounds the edges are, together: of no more than most, but for a larger piece."""
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, "right")) - 1)
        yield i, j
        i = j


def _ids(column) -> np.ndarray:
    return np.asarray(column.fill_null(_LAST).to_numpy(), np.int64)


def _shared(chunk: Chunk, marks: pa.Table, n: int) -> np.ndarray:
    """Which anchors have a key that other chunks also have."""
    unique, inverse = np.unique(chunk.keys, return_inverse=True)
    flags = np.zeros(len(unique), bool)
    sent = {r: (a, b) for r, a, b in _cuts(unique, n)}
    for r, bits in zip(marks["range"].to_pylist(), marks["bits"].to_pylist()):
        a, b = sent[r]
        flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return flags[inverse]


def _gone(spots: np.ndarray, masks: np.ndarray, length: int, window: int) -> np.ndarray:
    """Which of the bytes are in a window that masks tells of: bit d of a mask is the window d bytes before its spot."""
    at = np.flatnonzero(masks)
    spots, masks = spots[at], masks[at]
    begins = np.zeros(length + window - 1, bool)
    for d in range(window - gram_length(window) + 1):
        begins[spots[(masks >> np.uint64(d)) & np.uint64(1) > 0] - d + window - 1] = True
    return _slide(begins, window, np.logical_or)


def _tally(marked: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """How many bytes of each text are marked."""
    out = np.zeros(len(bounds) - 1, np.int64)
    for i, j in _parts(bounds, block):
        own = marked[bounds[i] : bounds[j]]
        full = np.flatnonzero(np.diff(bounds[i : j + 1])) + i
        if len(full):
            out[full] = np.add.reduceat(own, bounds[full] - bounds[i], dtype=np.int32)
    return out


def _whole_characters(data: np.ndarray, gone: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> None:
    """Adds to gone the other bytes of each UTF-8 character that it cuts."""
    for i, j in _parts(bounds, block):
        a, b = int(bounds[i]), int(bounds[j])
        own = gone[a:b]
        if own.any():
            first = (data[a:b] & 0xC0) != 0x80
            begins = bounds[i:j] - a
            first[begins[begins < b - a]] = True
            character = np.cumsum(first, dtype=np.int32)
            cut = np.zeros(int(character[-1]) + 1, bool)
            cut[character[own]] = True
            own[:] = cut[character]


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES, part: int = PART, characters: bool = False) -> DataFrame:
    """docs without text_col, and n_bytes, n_removed, n_spans (long), kept (binary: the bytes that stay).

    range_bytes: text whose suffixes a key range gets on average; runs are cut by ranges, not by chunks.
    part: suffixes that a chunk sorts at once; those of one key range, or of one key, stay together.
    characters: kept leaves out the rest of a character that removal cuts in two; the counts don't
    change. Columns of docs that have one of these names are left out.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)) + 64)).first()[0]
    n, ranges = pieces(total, chunk_bytes), pieces(total, range_bytes)
    rest = without(docs, text_col, "n_bytes", "n_removed", "n_spans", "kept", "_chunk", "_text", "_id")
    others = rest.columns
    base = docs.select(*[F.col(f"`{c}`") for c in others], F.col(id_col).cast("long").alias("_id"), utf8(text_col).alias("_text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int").alias("_chunk"))
    chunked = base.repartition(n, "_chunk")
    chunks = chunked.groupBy("_chunk")

    @trimmed
    def keys_of(t: pa.Table) -> pa.Table:
        chunk = Chunk(t["_text"], _ids(t["_id"]), window)
        unique = np.unique(chunk.keys)
        cut = list(_cuts(unique, ranges))
        return pa.table({"range": pa.array([x[0] for x in cut], pa.int32()), "_chunk": pa.array([t["_chunk"][0].as_py()] * len(cut), pa.int32()), "keys": pa.array([unique[a:b].tobytes() for _, a, b in cut], pa.binary())})

    @trimmed
    def in_many(t: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()]
        every = np.concatenate(lists)
        every.sort()
        twice = every[:-1][every[1:] == every[:-1]]
        bits = []
        for x in lists:
            at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
            bits.append(np.packbits(twice[at] == x) if len(twice) else np.zeros(0, np.uint8))
        kept = [i for i, x in enumerate(bits) if x.any()]
        return pa.table({"_chunk": t["_chunk"].take(pa.array(kept, pa.int64())), "range": t["range"].take(pa.array(kept, pa.int64())), "bits": pa.array([bits[i].tobytes() for i in kept], pa.binary())}).cast(pa.schema([("_chunk", pa.int32()), ("range", pa.int32()), ("bits", pa.binary())]))

    marks = chunks.applyInArrow(keys_of, "range int, _chunk int, keys binary").groupBy("range").applyInArrow(in_many, "_chunk int, range int, bits binary")

    def run_of(chunk: Chunk, shared: np.ndarray) -> Iterator[tuple[Suffixes, np.ndarray, np.ndarray]]:
        """By parts of whole key ranges: the suffixes that go out, each once and with its smallest document; which anchors, in which order and as which entry."""
        picked = np.flatnonzero(shared)
        picked = picked[np.argsort(chunk.keys[picked], kind="stable")]
        edges = np.array([0, *(b for _, _, b in _cuts(chunk.keys[picked], ranges))])
        for i, j in _parts(edges, part):
            own = picked[edges[i] : edges[j]]
            s = chunk.suffixes(own)
            order = s.order()
            s = s.take(order)
            first = ~s.same_as_before()
            starts = np.flatnonzero(first)
            run = s.take(starts)
            run.docs = np.minimum.reduceat(s.docs, starts)
            yield run, own[order], np.cumsum(first) - 1

    @trimmed
    def runs_of(t: pa.Table, m: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, bytes]] = []
        if t.num_rows and m.num_rows:
            chunk = Chunk(t["_text"], _ids(t["_id"]), window)
            done = 0
            for run, _, _ in run_of(chunk, _shared(chunk, m, ranges)):
                rows += [(r, t["_chunk"][0].as_py(), done + a, pack_run(run.take(np.arange(a, b)))) for r, a, b in _cuts(run.keys, ranges)]
                done += len(run)
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.table({"range": pa.array(cols[0], pa.int32()), "_chunk": pa.array(cols[1], pa.int32()), "first": pa.array(cols[2], pa.int64()), "run": pa.array(cols[3], pa.binary())})

    @trimmed
    def merged(t: pa.Table) -> pa.Table:
        runs = [unpack_run(x, window) for x in t["run"].to_pylist()]
        of, prefixes = merge_runs([(r[5], r[0].tolist()) for r in runs])
        of = np.array(of, np.int64)
        by_run = np.argsort(of, kind="stable")
        n_right, n_left, docs_, left = (np.concatenate([r[i] for r in runs]) for i in (1, 2, 3, 4))
        to = np.empty(len(of), np.int64)
        to[by_run] = np.arange(len(of))
        found = earlier_windows(np.array(prefixes, np.int64), n_right[to], left[to], n_left[to], docs_[to], window)
        back = np.empty(len(of), np.uint64)
        back[to] = found
        ends = np.cumsum([len(r[5]) for r in runs])
        masks = np.split(back, ends[:-1])
        kept = [i for i, x in enumerate(masks) if x.any()]
        compress = zstandard.ZstdCompressor(level=1).compress
        return pa.table({"_chunk": t["_chunk"].take(pa.array(kept, pa.int64())), "first": t["first"].take(pa.array(kept, pa.int64())), "range": pa.array([-1] * len(kept), pa.int32()), "bits": pa.array([compress(masks[i].tobytes()) for i in kept], pa.binary())}).cast(pa.schema([("_chunk", pa.int32()), ("first", pa.int64()), ("range", pa.int32()), ("bits", pa.binary())]))

    by_chunk = marks.groupBy("_chunk")
    runs = chunks.cogroup(by_chunk).applyInArrow(runs_of, "range int, _chunk int, first long, run binary")
    answers = runs.groupBy("range").applyInArrow(merged, "_chunk int, first long, range int, bits binary")
    told = answers.unionByName(marks.withColumn("first", F.lit(-1).cast("long")))

    def removed(t: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(t["_text"], _ids(t["_id"]), window)
        kinds = np.asarray(told["range"].to_numpy(), np.int64) if told.num_rows else np.zeros(0, np.int64)
        shared = _shared(chunk, told.filter(pa.array(kinds >= 0)), ranges) if told.num_rows else np.zeros(len(chunk.keys), bool)
        masks = np.zeros(len(chunk.keys), np.uint64)
        if shared.any():
            answer = np.zeros(int(shared.sum()), np.uint64)
            replies = told.filter(pa.array(kinds < 0))
            for first, bits in zip(replies["first"].to_pylist(), replies["bits"].to_pylist()):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint64)
                answer[first : first + len(x)] = x
            done = 0
            for run, at, entry in run_of(chunk, shared):
                masks[at] = answer[done + entry]
                done += len(run)
                del run
            del answer, replies
        _, inverse, counts = np.unique(chunk.keys, return_inverse=True, return_counts=True)
        own = np.flatnonzero(counts[inverse] > 1)
        own = own[np.argsort(inverse[own], kind="stable")]
        # windows are equal only where keys are
        edges = np.concatenate(([0], np.cumsum(counts[counts > 1])))
        for i, j in _parts(edges, part):
            some = own[edges[i] : edges[j]]
            s = chunk.suffixes(some)
            order = s.order()
            s = s.take(order)
            masks[some[order]] |= earlier_windows(common_prefixes(s.strings()), s.n_right, s.left, s.n_left, s.docs, window)
            del s, order
        del inverse, counts
        spots = chunk.anchors.at
        data, bounds = chunk.data, chunk.bounds
        del chunk, own
        gone = _gone(spots, masks, len(data), window)
        del spots, masks
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = bounds[:-1][bounds[:-1] < len(gone)]
        begins[inner] = gone[inner]
        n_gone, n_spans = _tally(gone, bounds), _tally(begins, bounds)
        del begins
        if characters:
            _whole_characters(data, gone, bounds)
        sizes = np.diff(bounds)
        ends = np.concatenate(([0], np.cumsum(sizes - (_tally(gone, bounds) if characters else n_gone)))).astype(np.int64)
        np.logical_not(gone, out=gone)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data[gone])])
        del data, gone
        released()
        out = {c: t[c] for c in others}
        return pa.table(out | {"n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": kept.cast(pa.binary())})

    fields = [f for f in base.schema.fields if f.name in others] + [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]
    return chunks.cogroup(told.groupBy("_chunk")).applyInArrow(lambda t, m: removed(t, m) if t.num_rows else _none(fields), T.StructType(fields))


def _none(fields: list[T.StructField]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType(fields)).empty_table()


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, chunk_bytes=QUERY_CHUNK_BYTES).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text keeps the bytes that no earlier document has; a character cut in two goes whole. n_chars is counted
    anew where docs has it; a null text comes back empty; other columns, whatever their names, stay as they are."""
    rest = F.struct(F.col("doc_id"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    out = dedup(docs.select("doc_id", "text", rest.alias("_row")), characters=True).withColumn("_kept", F.col("kept").cast("string"))
    own = {"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast("long")}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
#: SQL over all windows took 129 s on 1,000 documents, so a brute-force version in the tests stands in for it.
ORACLE_SQL: dict[str, str] = {}
