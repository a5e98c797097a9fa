"""Benchmark decontamination with a positional inverted index of the documents (op9).

Method: documents are dealt to blocks; each block stores, for every term that the benchmark uses, the
positions at which its documents have the term. A window of the benchmark is looked up by starting
from the postings of its rarest term in the block, shifted back by the term's offset, and intersecting
with the next rarest term's shifted postings until all its terms have been met (exact phrase) or, with
a slack, until each term was found near its place (proximity). The benchmark is the stated query set:
it is taken in parts of bounded size, each broadcast to all blocks.

Documents are laid end to end with a gap that no match can bridge, and a match is its rarest term's document's.

Edge cases: a null text has no words; a document without words is not contaminated; an item without
words has no window; items of a null id mark words but are not listed; repeated rows of documents
give a row each, repeated items count once by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import pieces, rows_left, table, utf8
from ._words import LETTERS, batches, words

WINDOW, SHARE = 13, 20
#: How far from its place a term may stand in a proximity match.
SLACK = 2
BLOCK_BYTES, QUERY_BYTES = 32 << 20, 16 << 20
#: Candidate places that are intersected at once.
CANDIDATES = 1 << 20


class Queries:
    """Windows of one part of the benchmark: rows of term numbers, by length, and the items of each."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = words([text], LETTERS, lower=True)
            forms = [self.terms.setdefault(x, len(self.terms)) for x in w.forms.to_pylist()]
            seq = [forms[c] for c in w.codes.tolist()]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                found.setdefault(tuple(seq[i : i + window]), set()).update(() if item is None else (str(item),))
        self.windows: list[tuple[np.ndarray, list[list[str]]]] = []
        for n in sorted({len(x) for x in found}):
            own = [x for x in found if len(x) == n]
            self.windows.append((np.array(own, np.int64), [sorted(found[x]) for x in own]))


def index(docs: DataFrame, terms: list[bytes], *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, gap: int = 1) -> DataFrame:
    """Rows (block, term, part, docs, positions): a term's postings, as int32 positions in the part's stream of
    words; term -1 has the part's documents: ids, and where each begins in the stream.

    A block is what a task reads, or about block_bytes of it; its parts are laid one after another by search().
    """
    known = {x: i for i, x in enumerate(terms)}
    id_type = docs.schema[id_col].dataType.simpleString()

    def post(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, part = TaskContext.get().partitionId() << 24, 0, 0
        for batch in rows:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                w = words(texts[a:b], LETTERS, lower=True)
                term = np.array([known.get(x, -1) for x in w.forms.to_pylist()], np.int64)[w.codes] if len(w.codes) else np.zeros(0, np.int64)
                # a gap after each document, so that no match runs on into the next
                begins = w.first + gap * np.arange(b - a + 1)
                place = np.arange(len(term)) + np.repeat(gap * np.arange(b - a), np.diff(w.first))
                hit = np.flatnonzero(term >= 0)
                order = np.argsort(term[hit], kind="stable")
                ordered, place = term[hit][order], place[hit][order].astype(np.int32)
                cut = np.flatnonzero(np.diff(ordered, prepend=-1))
                k = len(cut) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([first + held // block_bytes] * k, pa.int64()),
                    pa.array([-1, *ordered[cut].tolist()], pa.int32()),
                    pa.array([part] * k, pa.int32()),
                    pa.array([batch.column(0).slice(a, b - a).to_pylist(), *[None] * (k - 1)], pa.list_(batch.schema.field(0).type)),
                    pa.array([begins.astype(np.int32).tobytes(), *[place[i:j].tobytes() for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(ordered)])]], pa.binary()),
                ], ["block", "term", "part", "docs", "positions"])
                held, part = held + len(w.data), part + 1

    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).alias("_id")
    return docs.select(own, utf8(text_col).alias("_text")).mapInArrow(post, f"block long, term int, part int, docs array<struct<id: {id_type}, digest: long>>, positions binary")


def _near(keys: np.ndarray, wanted: np.ndarray, slack: int) -> np.ndarray:
    """Whether sorted keys have one from wanted - slack to wanted + slack."""
    return np.searchsorted(keys, wanted - slack, "left") < np.searchsorted(keys, wanted + slack, "right")


def occurrences(keys: np.ndarray, counts: np.ndarray, begins: np.ndarray, windows: np.ndarray, size: int, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, place of its rarest term) of each occurrence. keys: term * size + position, sorted; counts, begins: of terms."""
    held = counts[windows]
    alive = np.flatnonzero(held.min(axis=1) > 0)
    rank = np.argsort(held[alive], axis=1, kind="stable")
    out_w, out_s, out_p = [], [], []
    each = held[alive, rank[:, 0]] if len(alive) else np.zeros(0, np.int64)
    bound = np.concatenate(([0], np.cumsum(each)))
    a = 0
    while a < len(alive):
        b = max(a + 1, int(np.searchsorted(bound, bound[a] + CANDIDATES, "right")) - 1)
        own, ranked = alive[a:b], rank[a:b]
        rare = windows[own, ranked[:, 0]]
        of = np.repeat(np.arange(b - a), each[a:b])
        spot = np.repeat(begins[rare] - (bound[a:b] - bound[a]), each[a:b]) + np.arange(int(each[a:b].sum()))
        start = keys[spot] - np.repeat(rare * size + ranked[:, 0], each[a:b])
        place = keys[spot] - np.repeat(rare, each[a:b]) * size
        fits = (start >= -slack) & (start + windows.shape[1] <= size + slack)
        of, start, place = of[fits], start[fits], place[fits]
        for k in range(1, windows.shape[1]):
            offset = ranked[of, k]
            there = _near(keys, windows[own[of], offset] * size + start + offset, slack)
            of, start, place = of[there], start[there], place[there]
        out_w.append(own[of])
        out_s.append(start)
        out_p.append(place)
        a = b
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_w), np.concatenate(out_s), np.concatenate(out_p)) if out_w else (none, none, none)


def search(postings: DataFrame, queries: Queries, slack: int = 0, *, near: int = 0, gap: int = 1) -> DataFrame:
    """Per document of the index: block, ord, id, digest (of its text), n_words, spans (of words that are in a match), items,
    near_items (items of which a window's terms all stand within `near` of their places; none where near is 0).

    gap: that of the index; with a slack or near it must be over their double and the longest window.
    """
    id_type = postings.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    shared = postings.sparkSession.sparkContext.broadcast(queries)

    def run(t: pa.Table) -> pa.Table:
        own = shared.value
        terms, parts = np.asarray(t["term"].to_numpy(), np.int64), t["part"].to_pylist()
        raw = t["positions"].to_pylist()
        at_docs = sorted(np.flatnonzero(terms < 0).tolist(), key=lambda i: parts[i])
        base, size, doc_begin, ids = {}, 0, [], []
        lists = t["docs"]
        for i in at_docs:
            begins = np.frombuffer(raw[i], np.int32).astype(np.int64)
            base[parts[i]] = size
            doc_begin.append(begins[:-1] + size)
            size += int(begins[-1])
            ids += lists[i].as_py()
        doc_begin = np.concatenate([*doc_begin, [size]])
        lengths = np.diff(doc_begin) - gap
        keys = [np.frombuffer(raw[i], np.int32).astype(np.int64) + (base[parts[i]] + terms[i] * size) for i in np.flatnonzero(terms >= 0).tolist()]
        keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        counts = np.bincount(keys // max(size, 1), minlength=max(len(own.terms), 1))
        begins = np.cumsum(counts) - counts
        cover = np.zeros(size + 1, np.int32)
        held: list[set[str]] = [set() for _ in ids]
        close: list[set[str]] = [set() for _ in ids]
        for windows, items in own.windows:
            n = windows.shape[1]
            which, start, place = occurrences(keys, counts, begins, windows, size, slack)
            doc = np.searchsorted(doc_begin, place, "right") - 1
            cover += np.bincount(np.maximum(start, doc_begin[doc]), minlength=size + 1).astype(np.int32)
            cover -= np.bincount(np.minimum(start + n, doc_begin[doc + 1] - gap), minlength=size + 1).astype(np.int32)
            for pair in np.unique(doc * len(windows) + which).tolist():
                held[pair // len(windows)].update(items[pair % len(windows)])
            if near:
                which, _, place = occurrences(keys, counts, begins, windows, size, near)
                doc = np.searchsorted(doc_begin, place, "right") - 1
                for pair in np.unique(doc * len(windows) + which).tolist():
                    close[pair // len(windows)].update(items[pair % len(windows)])
        hit = np.cumsum(cover)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        span_doc = np.searchsorted(doc_begin, edge[::2], "right") - 1
        spans: list[list[dict]] = [[] for _ in ids]
        for d, a, b in zip(span_doc.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
            spans[d].append({"begin": a - int(doc_begin[d]), "end": b - int(doc_begin[d])})
        return pa.table({
            "block": pa.array([t["block"][0].as_py()] * len(ids), pa.int64()), "ord": pa.array(np.arange(len(ids))),
            "id": pa.array([x["id"] for x in ids], t.schema.field("docs").type.value_type[0].type), "digest": pa.array([x["digest"] for x in ids], pa.int64()), "n_words": pa.array(lengths),
            "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), "items": pa.array([sorted(x) for x in held], pa.list_(pa.string())), "near_items": pa.array([sorted(x) for x in close], pa.list_(pa.string())),
        })

    return postings.groupBy("block").applyInArrow(run, f"block long, ord long, id {id_type}, digest long, n_words long, spans array<struct<begin: long, end: long>>, items array<string>, near_items array<string>")


def matched(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slack: int = 0, near: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, n_hit (long), items, near_items (sorted arrays of strings), spans (of words), digest (of the text).

    The benchmark comes to the driver in parts of about query_bytes, one at a time.
    """
    n_parts = pieces(benchmark.agg(F.sum(F.octet_length(F.col(item_text)))).first()[0], query_bytes)
    gap = window + 2 * max(slack, near) + 1
    items = benchmark.select(F.col(item_col).alias("item"), utf8(item_text).alias("text"))
    found = []
    for part in range(n_parts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)) == part)
        queries = Queries([(r.item, bytes(r.text)) for r in own.collect()], window)
        found.append(search(index(docs, list(queries.terms), id_col=id_col, text_col=text_col, block_bytes=block_bytes, gap=gap), queries, slack, near=near, gap=gap))
    out = found[0]
    if n_parts > 1:
        # repeated rows have the same matches, so they are merged by id and text and come back as often as they were
        every = reduce(DataFrame.unionByName, found).groupBy("id", "digest", "n_words")
        merged = every.agg((F.count(F.lit(1)) / n_parts).cast("int").alias("_copies"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in ("items", "near_items")])
        out = merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, s: F.struct((a.n + F.greatest(F.lit(0).cast("long"), s.end - F.greatest(s.begin, a.end))).alias("n"), F.greatest(a.end, s.end).alias("end")), lambda a: a.n)
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "near_items", "spans", "digest")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go; rows of one id are judged each by its own text. Edge cases are
    as above; other columns of docs, whatever their names, stay as they are."""
    found = matched(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where(contaminated())
    return rows_left(docs, found.select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_hash")))


QUERIES = {"op9_positional_index": op9_positional_index}
ORACLE_SQL = {
    "op9_positional_index": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS r(i)),
m AS (SELECT doc_id, i, g.n, item_id FROM g JOIN q ON g.win = q.win AND g.n = q.n),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(range(0, n)) AS u(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
