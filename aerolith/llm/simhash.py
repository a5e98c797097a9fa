"""Near-duplicate groups by SimHash, found exactly with vantage-point trees (op4).

Method: documents of equal fingerprint are one. The different fingerprints are dealt to shards by a
vantage-point tree: each level splits at the median Hamming distance from a vantage point. A pair
within the radius differs by at most the radius in its distances (triangle inequality), so beside its
home a fingerprint visits only the shards across a boundary that is that close, and only on the far
side, so that each pair meets at least once and all others are pruned. Each shard grows its own tree
below, prunes by the same bound down to small leaves, and there compares all. It returns a spanning
forest of the links it found, so a dense group costs no more rows than it has members. Components
are then joined over all shards by minimum labels.

Edge cases: a null or empty text has fingerprint zero, which links like any other; repeated rows and
equal texts share a fingerprint; a null id counts only if no other is in its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_sets
from ._links import by_component, distance, forest_within
from ._spark import checkpointed, released, rows_left, small_batches, table, utf8
from ._words import NOT_SPACE, batches, words

SEED, RADIUS, WORDS = 42, 4, 4
#: Fingerprints in a shard, on average, before those that visit.
SHARD = 30_000
#: Fingerprints from which the split distances are taken.
SAMPLE = 20_000


def fingerprints_of(texts: list[bytes], n_words: int = WORDS, seed: int = SEED) -> np.ndarray:
    import xxhash

    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in batches(texts):
        w = words(texts[a:b], NOT_SPACE, lower=True)
        n = np.diff(w.first)
        sizes = w.ends - w.starts
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        keep = NOT_SPACE[w.data]
        tidy = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        tidy[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))] = w.data[keep]
        tidy = tidy.tobytes()
        each = np.where(n >= n_words, n - n_words + 1, np.minimum(n, 1))
        bound = np.concatenate(([0], np.cumsum(each)))
        first = np.repeat(w.first[:-1] - bound[:-1], each) + np.arange(bound[-1])
        last = np.minimum(first + n_words - 1, np.repeat(w.first[1:] - 1, each))
        for i in range(0, b - a, 4000):
            j = min(b - a, i + 4000)
            part = slice(int(bound[i]), int(bound[j]))
            hashed = np.fromiter((digest(tidy[s:e], seed) for s, e in zip(starts[first[part]].tolist(), ends[last[part]].tolist())), np.uint64, part.stop - part.start)
            bits = np.unpackbits(hashed.astype(">u8").view(np.uint8)).reshape(-1, 64)
            at = np.flatnonzero(each[i:j])
            if not len(at):
                continue
            sums = np.add.reduceat(bits, bound[i:j][at] - bound[i], axis=0, dtype=np.int32)
            ones = 2 * sums > each[i:j][at][:, None]
            out[a + i + at] = np.packbits(ones, axis=1).view(">u8").ravel()
    return out


def fingerprinted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long)."""
    schema = docs.select(id_col).schema.add("fp", "long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1).to_pylist()).view(np.int64))], [id_col, "fp"])
        released()

    return docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- trees


def vantage_tree(sample: np.ndarray, depth: int, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each level one vantage point, and for each node of the level the median distance from it."""
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, depth, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, depth).astype(np.uint64)
    cuts, node = [], np.zeros(len(sample), np.int64)
    for level in range(depth):
        d = distance(sample, points[level]).astype(np.int64)
        own = np.full(1 << level, 31, np.int64)
        for k in range(1 << level):
            if (here := d[node == k]).size:
                own[k] = int(np.median(here))
        cuts.append(own)
        node = 2 * node + (d > own[node])
    return points, cuts


def shards_of(values: np.ndarray, points: np.ndarray, cuts: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, whether at home) for each shard that each value is in: its own, and those with a
    smaller distance at the first level where they part, if a partner may be there."""
    index, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    for level, own in enumerate(cuts):
        d, cut = distance(values[index], points[level]).astype(np.int64), own[node]
        outer = d > cut
        # at home: the own side, and as a visitor the inner side if the boundary is near
        stay = (index, 2 * node + outer, home)
        visit = outer & home & (d - radius <= cut)
        # visitors go wherever a partner may be
        other = ~home & np.where(outer, d - radius <= cut, d + radius > cut)
        more = visit | other
        index, node, home = (np.concatenate(x) for x in zip(stay, (index[more], 2 * node[more] + ~outer[more], np.zeros(int(more.sum()), bool))))
    return index, node, home


def links(prints: DataFrame, total: int, *, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) among the different values of `fp` that join just what pairs within the radius join.

    prints: one row per value; total: how many there are. Split distances come from at most about
    SAMPLE of them; they set the balance of the shards, never what is found.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, total) / shard))))
    share = min(1.0, SAMPLE / max(1, total))
    sample = [r.fp for r in prints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").limit(4 * SAMPLE).collect()] if depth else []
    points, cuts = vantage_tree(np.array(sample, np.int64).view(np.uint64), depth)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            values = batch.column(0).to_numpy()
            index, node, home = shards_of(values.view(np.uint64), points, cuts, radius)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(values[index]), pa.array(home)], ["shard", "fp", "home"])

    def join(t: pa.Table) -> pa.Table:
        values = np.ascontiguousarray(t["fp"].to_numpy())
        order = np.argsort(values, kind="stable")
        values, home = values[order], np.asarray(t["home"].to_numpy(zero_copy_only=False), bool)[order]
        pairs = forest_within(values.view(np.uint64), home, radius)
        return pa.table({"a": pa.array(values[pairs[:, 0]]), "b": pa.array(values[pairs[:, 1]])})

    dealt = prints.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(join, "a long, b long")


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """id, fingerprint (hex), component_id (the smallest id that links lead to)."""
    rows = checkpointed(fingerprinted(docs, id_col=id_col, text_col=text_col))
    prints = checkpointed(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")))
    found = by_component(rows, prints, links(prints, prints.count(), radius=radius, shard=shard), id_col)
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups are joined by pairs of texts whose five-word shingles are 0.8 similar or more (see near_sets).
    Of each group the document of the smallest id stays, and of the same id that of the smallest hash;
    of its rows of equal id and text, one. A row is known by its id and the hash of its text, so rows that
    merely share an id, or have none, are judged each by its own text. Other columns stay as they are."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    with small_batches(spark):
        found = checkpointed(near_sets.grouped(docs.select(key.alias("_key"), "text")))
    twins = found.groupBy("_key").count().where("count > 1").select(F.col("_key.id").alias("_gone_id"), F.col("_key.hash").alias("_gone_hash"))
    gone = found.where("_key <> component_id").select(F.col("_key.id").alias("_gone_id"), F.col("_key.hash").alias("_gone_hash"))
    return rows_left(docs, gone, twins=twins)


QUERIES = {"op4_simhash_groups": op4_simhash_groups}
ORACLE_SQL: dict[str, str] = {}
