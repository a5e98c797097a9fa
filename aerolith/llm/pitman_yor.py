"""A hierarchical Pitman-Yor language model and its scores of texts (op6).

Model: a word is drawn in the restaurant of its context, the word before (or the start of the text). All
context restaurants share one parent, the restaurant of words, whose base spells words byte by byte: the
restaurant of a byte after two bytes, its parent after one, its parent after none, and at last the
uniform distribution. Customers are the training tokens; each table is a customer of the parent.

Method: chunks of documents send each different (word, context) pair once, with its training count, to
the bucket of its word, so no word and no context gathers rows: a frequent context is spread over all
buckets, and counts are summed before they are sent. Given the totals of all restaurants and the
spelling model, words are independent, so each bucket seats its words by Gibbs sweeps of its own. The
totals of contexts, which grow with the corpus, are then summed anew by a shuffle: each bucket sends its
part for each of its contexts to the shard of the context's hash, which sends the whole back to those
that asked. Totals of at most 257**3 byte triples come to the driver, which seats the spelling model.
After SWEEPS such rounds the buckets average the predictive probability of each pair over SAMPLES
seatings and send it back to the chunks that asked. Contexts are known by 64-bit hashes. In each sweep all
customers of a dish get up and are seated anew by the Chinese restaurant process, whose waiting times between
new tables are drawn exactly. What chunks and buckets hold is written once as tables bucketed by what they are
grouped by, so the rounds move totals alone.

Edge cases: a null or empty text is its end token alone; words that training doesn't have are one
event, as in the base, which has what the spelling model leaves; repeated rows count as often as they occur; a null id is trained on; without any training
documents all words are spelled by the uniform distribution.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import LARGE_ROWS, bucketed, checkpointed, forgotten, pieces, released, small_batches, table, trimmed, utf8
from ._words import NOT_SPACE, by_text, sliced, words

FOLDS, HELD_OUT = 5, 1
CHUNK_BYTES, BUCKET_BYTES = 14 << 20, 18 << 20
SWEEPS, LOCAL, BURN, SAMPLES = 3, 3, 2, 4
STRENGTH = 1.0
#: Dishes that are followed one by one, and customers that draw together.
SINGLE, FOLLOWED = 64, 1 << 18
#: Symbols of spellings are bytes and START, which stands before the first and is the end of a word, too.
START, CONTEXTS = 256, 257


def held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of their first bytes, second bytes and so on, which compress better."""
    sizes = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64)
    planes = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join((sizes.tobytes(), *planes)))


def unpack(packed: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [np.ascontiguousarray(np.frombuffer(raw[e - s : e], np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for s, e, t in zip(sizes.tolist(), ends.tolist(), types)]


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and for each key its place among them; keys are sorted where they lie."""
    order = np.argsort(keys)
    keys[:] = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], at


# ---------------------------------------------------------------- seating


def tables(customers: np.ndarray, discount: float, strength: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes by the Chinese restaurant process; strength: the weight of a new table of the dish.

    With s customers at t tables the next opens a table with chance a / (a + s - discount * t), and those after it
    with a / (a + s + 1 - discount * t) and so on: how many come until one does is beta-geometric, and drawn as such
    for all dishes at once. The few with most tables are followed customer by customer, which is the same law.
    """
    out = (customers > 0).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    seated = np.ones(len(at))
    with np.errstate(divide="ignore", over="ignore"):
        while len(at) > SINGLE:
            chance = rng.beta(np.maximum(strength[at], 1e-300), np.maximum(seated - discount * out[at], 1e-9))
            seated += np.maximum(np.ceil(np.log(1 - rng.random(len(at))) / np.log1p(-chance)), 1)
            goes_on = seated <= customers[at]
            at, seated = at[goes_on], seated[goes_on]
            out[at] += 1
    for k, s in zip(at.tolist(), seated.astype(np.int64).tolist()):
        out[k] = _followed(s, int(out[k]), int(customers[k]), discount, float(strength[k]), rng)
    return out


def _followed(seated: int, t: int, customers: int, discount: float, a: float, rng: np.random.Generator) -> int:
    """Tables of one dish when all its customers are seated: with t tables one opens if t is over what its draw asks for."""
    while seated < customers:
        s = np.arange(seated, min(customers, seated + FOLLOWED), dtype=np.float64)
        asks = (s - a * (1 / (1 - rng.random(len(s))) - 1)) / discount
        for x in asks[asks < s].tolist():
            if t > x:
                t += 1
        seated += len(s)
    return t


class Spelling:
    """Restaurants of bytes: cells are (a * 257 + b) * 257 + c, c after a and b."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, rng: np.random.Generator):
        order = np.argsort(cells)
        self.cells, c2 = cells[order], counts[order].astype(np.int64)
        ctx2, low = self.cells // CONTEXTS, self.cells % (CONTEXTS * CONTEXTS)
        p1 = np.full(CONTEXTS * CONTEXTS, 1 / CONTEXTS)
        p0 = np.full(CONTEXTS, 1 / CONTEXTS)
        t2 = np.minimum(c2, 1)
        n2 = np.bincount(ctx2, c2, CONTEXTS * CONTEXTS)
        d2 = discount_of(c2)
        symbol = np.arange(CONTEXTS * CONTEXTS) % CONTEXTS
        for _ in range(LOCAL):
            open2 = np.bincount(ctx2, t2, CONTEXTS * CONTEXTS)
            t2 = tables(c2, d2, (STRENGTH + d2 * open2[ctx2]) * p1[low], rng)
            c1 = np.bincount(low, t2, CONTEXTS * CONTEXTS).astype(np.int64)
            d1 = discount_of(c1)
            own = np.repeat(np.bincount(np.arange(CONTEXTS * CONTEXTS) // CONTEXTS, np.minimum(c1, 1), CONTEXTS), CONTEXTS)
            t1 = tables(c1, d1, (STRENGTH + d1 * own) * p0[symbol], rng)
            c0 = np.bincount(symbol, t1, CONTEXTS).astype(np.int64)
            d0 = discount_of(c0)
            t0 = tables(c0, d0, np.full(CONTEXTS, (STRENGTH + d0 * np.count_nonzero(c0)) / CONTEXTS), rng)
            p0 = (c0 - d0 * t0 + (STRENGTH + d0 * t0.sum()) / CONTEXTS) / (STRENGTH + c0.sum())
            n1, open1 = c1.reshape(CONTEXTS, -1).sum(1), t1.reshape(CONTEXTS, -1).sum(1)
            p1 = ((c1 - d1 * t1).reshape(CONTEXTS, -1) + (STRENGTH + d1 * open1)[:, None] * p0) / (STRENGTH + n1)[:, None]
            p1 = p1.ravel()
        self.seen = ((c2 - d2 * t2) / (STRENGTH + n2[ctx2])).astype(np.float64)
        self.back = (STRENGTH + d2 * np.bincount(ctx2, t2, CONTEXTS * CONTEXTS)) / (STRENGTH + n2)
        self.p1 = p1

    def probability(self, cells: np.ndarray) -> np.ndarray:
        p = self.back[cells // CONTEXTS] * self.p1[cells % (CONTEXTS * CONTEXTS)]
        if len(self.cells):
            at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
            p += np.where(self.cells[at] == cells, self.seen[at], 0.0)
        return p


def discount_of(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def spelled(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all words with their ends, and where each word's begin; 257**3 cells fit 32 bits."""
    ends = np.cumsum(lengths + 1)
    begins = np.concatenate(([0], ends))
    symbol = np.full(int(begins[-1]), START, np.int32)
    symbol[np.arange(len(text)) + np.repeat(np.arange(len(lengths)), lengths)] = text
    one, two = np.full_like(symbol, START), np.full_like(symbol, START)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    # before a word stands the end of the one before it, which is START; two back from its first byte is START by rule
    two[begins[:-1]] = START
    for x in (one, symbol):
        two *= CONTEXTS
        two += x
    return two, begins


class State:
    """What all words share: totals of the restaurant of words and the spelling model."""

    def __init__(self, word_customers, word_tables, spelling, discounts, unseen=1.0):
        self.n0, self.t0, self.spelling, self.discounts, self.unseen = word_customers, word_tables, spelling, discounts, unseen


def packed_pairs(text, lengths, contexts, word, context, count) -> bytes:
    """A bucket's arrays; word is sorted, and kept by its steps."""
    return pack(text, lengths.astype(np.uint32), contexts, *[x.astype(np.uint32) for x in (np.diff(word, prepend=word.dtype.type(0)), context, count)])


class Bucket:
    """Words with their spelling, sorted hashes of contexts, and pairs (word, place of the context) with training counts."""

    def __init__(self, text, lengths, contexts, word, context, count):
        self.text, self.lengths, self.contexts, self.word, self.context, self.count = text, lengths, contexts, word, context, count

    @staticmethod
    def of(packed: bytes) -> Bucket:
        text, lengths, contexts, *pairs = unpack(packed, np.uint8, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32)
        step, context, count = pairs
        return Bucket(text, lengths.astype(np.int64), contexts, np.cumsum(step, dtype=np.int32), context.astype(np.int32), count)

    def packed(self) -> bytes:
        return packed_pairs(self.text, self.lengths, self.contexts, self.word, self.context, self.count)

    @cached_property
    def begins(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.lengths + 1)))

    @cached_property
    def different(self) -> tuple[np.ndarray, np.ndarray]:
        return places(spelled(self.text, self.lengths.astype(np.int64))[0])

    def different_cells(self) -> tuple[np.ndarray, np.ndarray]:
        return self.different

    def base(self, s: State) -> np.ndarray:
        """Of words in training the probability of the spelling; others are one event, with all that is left."""
        cells, inverse = self.different_cells()
        logs = np.log(np.maximum(s.spelling.probability(cells), 1e-300))[inverse]
        spelled_ = np.exp(np.add.reduceat(logs, self.begins[:-1])) if len(self.lengths) else np.zeros(0)
        return np.where(np.bincount(self.word, self.count, len(self.lengths)) > 0, spelled_, s.unseen)

    def sweeps(self, s: State, n1: np.ndarray, t1: np.ndarray, n: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[], np.ndarray]]]:
        """n seatings: tables of pairs, tables of words, what gives the probability of each pair; n1, t1: customers and tables of the contexts."""
        d1, d0 = s.discounts
        base = self.base(s)
        customers = np.bincount(self.word, np.minimum(self.count, 1), len(self.lengths)).astype(np.int64)
        word_tables = np.minimum(customers, 1)
        new_context = d1 * t1[self.context]
        new_context += STRENGTH

        def likely() -> np.ndarray:
            out = d1 * own
            np.subtract(self.count, out, out=out)
            part = p[self.word]
            part *= new_context
            out += part
            np.add(n1[self.context], STRENGTH, out=part)
            out /= part
            return out

        for _ in range(n):
            p = (customers - d0 * word_tables + (STRENGTH + d0 * s.t0) * base) / (STRENGTH + s.n0)
            strength = p[self.word]
            strength *= new_context
            own = tables(self.count, d1, strength, rng)
            del strength
            customers = np.bincount(self.word, own, len(self.lengths)).astype(np.int64)
            word_tables = tables(customers, d0, (STRENGTH + d0 * s.t0) * base, rng)
            p = (customers - d0 * word_tables + (STRENGTH + d0 * s.t0) * base) / (STRENGTH + s.n0)
            yield own, word_tables, likely


# ---------------------------------------------------------------- chunks


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """Of each token of a chunk the token with its context; all texts end with their end, so that the last token is one."""
    return tokens.astype(np.int64) << 32 | np.roll(tokens, 1)


def counted(tokens: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of pairs_of in order, as tokens and contexts, and how often each occurs where trained is set.

    One array is sorted where it lies: a token has 32 bits of it, its context 31, and trained the last one.
    """
    keys = tokens.astype(np.int64)
    keys <<= 32
    low = np.roll(tokens, 1)
    low <<= np.uint32(1)
    low |= trained
    keys |= low
    del low
    keys.sort()
    trained = (keys & 1).astype(np.uint8)
    keys >>= 1
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    keys = keys[at]
    return (keys >> 31).astype(np.uint32), (keys & 0x7FFFFFFF).astype(np.uint32), np.add.reduceat(trained, at, dtype=np.uint32)


class Gathered:
    """The documents of one chunk: tokens by rank, since frequent ones then take few bytes; pairs by bucket."""

    def __init__(self, n_buckets: int):
        self.n_buckets, self.size = n_buckets, 0
        self.forms: dict[bytes, int] = {b"": 0}
        self.ids, self.counts, self.tokens = [], [], []

    def add(self, ids: list, texts: list[bytes]) -> None:
        w = words(texts, NOT_SPACE, lower=True)
        own = np.array([self.forms.setdefault(x, len(self.forms)) for x in w.forms.to_pylist()], np.int64)
        n = np.diff(w.first)
        place = np.arange(len(w.codes)) + np.repeat(np.arange(len(texts)), n)
        # form 0 is the end of a text, and as a context its start
        token = np.zeros(len(w.codes) + len(texts), np.int64)
        token[place] = own[w.codes] if len(w.codes) else 0
        self.ids += ids
        self.counts.append(n + 1)
        self.tokens.append(token.astype(np.uint32))
        self.size += len(w.data) + 16 * len(texts)

    def rows(self, chunk: int) -> pa.Table:
        return pa.Table.from_batches(self.parts(chunk))

    def parts(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The chunk's rows one by one, each packed when it is asked for; what was gathered is given up on the way."""
        import xxhash

        forms = list(self.forms)
        self.forms.clear()
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, forms), np.uint64, len(forms))
        bucket = (hashed % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        to = np.empty(len(forms), np.uint32)
        to[order] = np.arange(len(forms))
        tokens = to[np.concatenate(self.tokens)]
        counts = np.concatenate(self.counts)
        out = np.array([held_out(x) for x in self.ids], bool)
        self.tokens.clear()
        often = np.argsort(-np.bincount(tokens, minlength=len(forms)), kind="stable").astype(np.uint32)
        rank = np.empty(len(forms), np.uint32)
        rank[often] = np.arange(len(forms))
        row = lambda bucket, packed, ids: pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["chunk", "bucket", "packed", "ids"])
        yield row(-1, pack(counts.astype(np.int64), out, often, rank[tokens]), self.ids)
        del often, rank
        word, context, trained = counted(tokens, np.repeat(~out, counts))
        del tokens
        bucket = bucket[order]
        sizes = np.array([len(x) for x in forms], np.int64)[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
            i, j = np.searchsorted(word, np.array([a, z], np.uint32))
            text = np.frombuffer(b"".join(forms[k] for k in order[a:z].tolist()), np.uint8)
            contexts, at = np.unique(hashed[order[context[i:j]]], return_inverse=True)
            yield row(int(bucket[a]), packed_pairs(text, sizes[a:z], contexts, word[i:j] - np.uint32(a), at, trained[i:j]), None)


def gathered(docs: DataFrame, n_buckets: int, chunk_bytes: int) -> DataFrame:
    """Rows (key, chunk, bucket, packed, ids): of bucket -1 a chunk's documents, of others its pairs of that bucket.

    key: what the row is grouped by later, the bucket, or of documents their chunk.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 24, 0
        held = Gathered(n_buckets)
        for batch in rows:
            for ids, texts in sliced(batch):
                held.add(ids, texts)
                del ids, texts
                if held.size >= chunk_bytes:
                    yield from held.parts(first + done)
                    done, held = done + 1, Gathered(n_buckets)
        if held.ids:
            yield from held.parts(first + done)
        del held
        released()

    rows = docs.mapInArrow(run, "chunk long, bucket int, packed binary, ids array<long>")
    return rows.withColumn("key", F.when(F.col("bucket") < 0, F.col("chunk")).otherwise(F.col("bucket").cast("long")))


def joined(packed: Iterable[bytes]) -> tuple[Bucket, list[np.ndarray], list[np.ndarray]]:
    """All parts of a bucket as one; for each part its words and its pairs in the whole."""
    forms: dict[bytes, int] = {}
    contexts, of_words, of_pairs, counts, begin = [], [], [], [], 0
    for x in packed:
        p = Bucket.of(x)
        ends = np.cumsum(p.lengths).tolist()
        raw = p.text.tobytes()
        own = np.array([forms.setdefault(raw[a:z], len(forms)) for a, z in zip([0, *ends], ends)], np.int32)
        of_words.append(own)
        of_pairs.append((own[p.word], (begin + p.context).astype(np.int32)))
        counts.append(p.count.astype(np.uint32))
        contexts.append(p.contexts)
        begin += len(p.contexts)
    del p, x
    every = np.concatenate(contexts)
    contexts.clear()
    contexts, at = places(every)
    del every
    bounds = np.cumsum([0, *(len(x) for x in counts)])
    keys = np.empty(bounds[-1], np.int64)
    for i, (word, context) in enumerate(of_pairs):
        keys[bounds[i] : bounds[i + 1]] = word.astype(np.int64) << 32 | at[context]
    of_pairs.clear()
    pairs, inverse = places(keys)
    del keys, at
    count = np.bincount(inverse, np.concatenate(counts), len(pairs)).astype(np.uint32)
    whole = Bucket(np.frombuffer(b"".join(forms), np.uint8), np.array([len(x) for x in forms], np.int64), contexts, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), count)
    return whole, of_words, np.split(inverse, bounds[1:-1])


def _sums(rows: DataFrame) -> dict[str, dict[int, int]]:
    """Sums of (kind, key, n) rows; kinds have at most 257**3 keys."""
    out: dict[str, dict[int, int]] = {}
    for r in rows.where("kind is not null").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.kind, {})[r.key] = r.n
    return out


_KINDS = "bucket int, shard int, packed binary, kind string, key long, n long"


def _told(bucket: int, b: Bucket, own: np.ndarray, n_shards: int, kinds: dict[str, tuple[np.ndarray, np.ndarray]], first: bool = False) -> pa.Table:
    """Sums by kind and key; and for each shard of contexts, in the order of their hashes, their tables here.

    first: the hashes and the customers here, too, which don't change later.
    """
    names = [k for k, (keys, _) in kinds.items() for _ in range(len(keys))]
    sums = pa.table({"kind": pa.array(names, pa.string()), "key": pa.array(np.concatenate([np.asarray(k, np.int64) for k, _ in kinds.values()])), "n": pa.array(np.concatenate([np.asarray(n, np.int64) for _, n in kinds.values()]))})
    told = [np.bincount(b.context, x, len(b.contexts)).astype(np.uint32) for x in ((own, b.count) if first else (own,))]
    shard = ((b.contexts >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
    cut = np.searchsorted(shard, np.arange(n_shards + 1)).tolist()
    rows = [(k, pack(*[x[i:j] for x in (told + [b.contexts] if first else told)])) for k, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]
    parts = pa.table({"bucket": pa.array([bucket] * len(rows), pa.int32()), "shard": pa.array([k for k, _ in rows], pa.int32()), "packed": pa.array([x for _, x in rows], pa.binary())})
    schema = pa.schema([*parts.schema, *sums.schema])
    return pa.concat_tables([pa.table({f.name: t[f.name] if f.name in t.column_names else pa.nulls(len(t), f.type) for f in schema}, schema) for t in (parts, sums)])


def context_totals(first: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Rows (bucket, shard, what, packed): for a bucket's contexts in a shard, in their order, the tables (what = 0) everywhere.

    first: what _told gave in the first round; told: in a later one. Without told the customers (what = 1) are given, too.
    """

    def add(t: pa.Table, u: pa.Table | None = None) -> pa.Table:
        buckets = t["bucket"].to_pylist()
        parts = [unpack(x, np.uint32, np.uint32, np.uint64) for x in t["packed"].to_pylist()]
        _, inverse = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        if u is None:
            values = [[p[k] for p in parts] for k in (0, 1)]
        else:
            later = dict(zip(u["bucket"].to_pylist(), u["packed"].to_pylist()))
            values = [[unpack(later[x], np.uint32)[0] for x in buckets]]
        out = []
        for x in values:
            whole = np.bincount(inverse, np.concatenate(x)).astype(np.int64)[inverse]
            out += [pack(y) for y in np.split(whole, np.cumsum([len(y) for y in x])[:-1])]
        n, k = len(buckets), len(values)
        return pa.table({"bucket": pa.array(buckets * k, pa.int32()), "shard": pa.array(t["shard"].to_pylist() * k, pa.int32()), "what": pa.array([i // n for i in range(n * k)], pa.int32()), "packed": pa.array(out, pa.binary())})

    schema, of = "bucket int, shard int, what int, packed binary", lambda x: x.where("shard is not null").select("bucket", "shard", "packed").groupBy("shard")
    if told is None:
        return checkpointed(of(first).applyInArrow(trimmed(lambda t: add(t)), schema))
    return checkpointed(of(first).cogroup(of(told)).applyInArrow(trimmed(lambda t, u: add(t, u)), schema))


def _totals_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of a bucket's contexts."""
    parts = sorted(zip(t["what"].to_pylist(), t["shard"].to_pylist(), t["packed"].to_pylist()))
    held = [[unpack(x, np.int64)[0] for what, _, x in parts if what == k] for k in (1, 0)]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in held)


def fitted(buckets: DataFrame, n_shards: int, seed: int = 11) -> tuple[State, DataFrame, int, int]:
    """The state after SWEEPS rounds over the buckets (bucket, packed); totals of contexts; tokens and different tokens in training."""

    def first(t: pa.Table) -> pa.Table:
        b = Bucket.of(t["packed"][0].as_py())
        of_word = np.bincount(b.word, b.count, len(b.lengths)).astype(np.int64)
        one = np.minimum(b.count, 1)
        contexts = np.bincount(b.word, one, len(b.lengths)).astype(np.int64)
        cells, inverse = b.different_cells()
        return _told(t["bucket"][0].as_py(), b, one, n_shards, first=True, kinds={
            "whole": (np.arange(3), [of_word.sum(), np.count_nonzero(of_word), contexts.sum()]),
            "pairs": ([1, 2], [(b.count == 1).sum(), (b.count == 2).sum()]), "words": ([1, 2], [(contexts == 1).sum(), (contexts == 2).sum()]),
            "cells": (cells, np.bincount(inverse, np.repeat(np.minimum(of_word, 1), np.diff(b.begins)), len(cells))),
        })

    def spelling_of(sums: dict[int, int] | None, rng: np.random.Generator) -> Spelling:
        sums = {k: n for k, n in (sums or {}).items() if n}
        return Spelling(np.array(list(sums), np.int64), np.array(list(sums.values()), np.int64), rng)

    rng = np.random.default_rng(seed)
    told = checkpointed(buckets.groupBy("bucket").applyInArrow(trimmed(first), _KINDS))
    sums, start, totals = _sums(told), told, context_totals(told)
    customers = totals.where("what = 1")
    forgotten(buckets)
    whole = sums.get("whole", {})
    n, v, seated = (int(whole.get(k, 0)) for k in range(3))
    share = lambda kind: min(0.95, max(0.05, (one := sums.get(kind, {}).get(1, 0)) / max(1, one + 2 * sums.get(kind, {}).get(2, 0))))
    state = State(seated, v, spelling_of(sums.get("cells"), rng), (share("pairs"), share("words")))
    for sweep in range(SWEEPS):

        def seat(t: pa.Table, around: pa.Table, *, state: State = state, sweep: int = sweep) -> pa.Table:
            bucket, b = t["bucket"][0].as_py(), Bucket.of(t["packed"][0].as_py())
            for own, of_word, _ in b.sweeps(state, *_totals_of(around), LOCAL, np.random.default_rng([seed, sweep, bucket])):
                pass
            cells, inverse = b.different_cells()
            return _told(bucket, b, own, n_shards, {"whole": ([0, 1, 2], [own.sum(), of_word.sum(), int(b.base(state)[of_word > 0].sum() * 1e15)]), "cells": (cells, np.bincount(inverse, np.repeat(of_word, np.diff(b.begins)), len(cells)))})

        told = checkpointed(buckets.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(trimmed(seat), _KINDS))
        sums, totals = _sums(told), context_totals(start, told).unionByName(customers)
        forgotten(buckets)
        whole = sums.get("whole", {})
        state = State(int(whole.get(0, 0)), int(whole.get(1, 0)), spelling_of(sums.get("cells"), rng), state.discounts, min(1.0, max(1e-6, 1 - whole.get(2, 0) / 1e15)))
    return state, totals, n, v


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, seed: int = 11) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)) + 16)).first()[0]
    n_buckets = pieces(total, bucket_bytes)
    found = gathered(docs.select(F.col(id_col).cast("long"), utf8(text_col).alias("_text")), n_buckets, chunk_bytes)
    with small_batches(docs.sparkSession):
        rows = bucketed(found.repartition(n_buckets, "key"), "key", n_buckets, "pitman_yor_rows", LARGE_ROWS)
    forgotten(docs)
    asked = rows.where("bucket >= 0").select("key", "bucket", "chunk", "packed")

    def merge(t: pa.Table) -> pa.Table:
        b, _, _ = joined(x.as_py() for x in t["packed"])
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "packed": pa.array([b.packed()], pa.binary())})

    with small_batches(docs.sparkSession):
        buckets = bucketed(asked.groupBy("key").applyInArrow(trimmed(merge), "bucket int, packed binary"), "bucket", n_buckets, "pitman_yor_buckets", LARGE_ROWS)
        state, totals, n, v = fitted(buckets, n_buckets, seed)

    def answer(t: pa.Table, around: pa.Table) -> pa.Table:
        b, of_words, of_pairs = joined(x.as_py() for x in t["packed"])
        mean = np.zeros(len(b.count))
        for i, (_, _, likely) in enumerate(b.sweeps(state, *_totals_of(around), BURN + SAMPLES, np.random.default_rng([seed, t["bucket"][0].as_py()]))):
            if i >= BURN:
                p = likely()
                p /= SAMPLES
                mean += p
                del p
        logs = np.log10(np.maximum(mean, 1e-300)).astype(np.float32)
        counts = np.bincount(b.word, b.count, len(b.lengths)).astype(np.int64)
        packed = [pack(logs[q], counts[w]) for w, q in zip(of_words, of_pairs)]
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "packed": pa.array(packed, pa.binary())})

    def finish(t: pa.Table, replies: pa.Table) -> pa.Table:
        told = sorted(zip(replies["bucket"].to_pylist(), replies["packed"].to_pylist()))
        held = [unpack(x, np.float32, np.int64) for _, x in told]
        logs, known = (np.concatenate([h[i] for h in held]) if held else np.zeros(0) for i in (0, 1))
        base = np.log10((known + 0.5) / (n + 0.5 * (v + 1)))
        out: list[list] = [[] for _ in range(7)]
        for packed, ids in zip(t["packed"].to_pylist(), t["ids"].to_pylist()):
            counts, away, often, token = unpack(packed, np.int64, bool, np.uint32, np.uint32)
            token = often[token]
            _, pair = places(pairs_of(token))
            bounds = np.concatenate(([0], np.cumsum(counts)))
            add = lambda x: np.add.reduceat(x, bounds[:-1])
            columns = (ids, away.tolist(), counts.tolist(), by_text(known[token] > 0, bounds).tolist(), [n] * len(ids), add(base[token]).tolist(), add(logs[pair].astype(np.float64)).tolist())
            for o, c in zip(out, columns):
                o += c
        return pa.table([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

    forgotten(docs)
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    replies = asked.groupBy("key").cogroup(totals.withColumn("key", F.col("bucket").cast("long")).groupBy("key")).applyInArrow(trimmed(answer), "chunk long, bucket int, packed binary")
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, (T.LongType(), T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()))])
    return rows.where("bucket < 0").select("key", "packed", "ids").groupBy("key").cogroup(replies.groupBy("chunk")).applyInArrow(trimmed(finish), schema)


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_pitman_yor": op6_pitman_yor}
ORACLE_SQL: dict[str, str] = {}
