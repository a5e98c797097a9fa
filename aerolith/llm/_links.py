"""Links among fingerprints: vantage-point trees inside a task, and connected components over all tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed, join_hot

#: Pairs that are compared at once, and pivots of which the one with the most others near is taken.
LEAF_PAIRS, PIVOTS = 1 << 20, 8


def distance(values: np.ndarray, point) -> np.ndarray:
    """Bits that differ; fingerprints are of one word, or of several along the last axis."""
    return np.bitwise_count(values ^ point)


def _apart(values: np.ndarray, point: np.ndarray, wide: bool) -> np.ndarray:
    d = distance(values, point)
    return d.sum(axis=-1, dtype=np.int64) if wide else d.astype(np.int64)


def roots(edges: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n is connected to."""
    label = np.arange(n)
    while len(edges):
        a, b = label[edges[:, 0]], label[edges[:, 1]]
        differ = a != b
        if not differ.any():
            break
        edges = edges[differ]
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def forest(links: np.ndarray, n: int) -> np.ndarray:
    """Each connected index with the smallest of its component."""
    root = roots(links, n)
    at = np.flatnonzero(root != np.arange(n))
    return np.stack((at, root[at]), axis=1)


def forest_within(values: np.ndarray, home: np.ndarray, radius: int, seed: int = 1) -> np.ndarray:
    """Links of a spanning forest among pairs of which at least one is at home, as pairs of indexes.

    Those near one pivot are linked by it, so pairs among them are not looked at again: a group of near
    copies costs what it has members, not its square.
    """
    rng = np.random.default_rng(seed)
    wide = values.ndim == 2
    found: list[np.ndarray] = []
    held = 0
    left, right = np.flatnonzero(home), np.arange(len(values))
    if len(left) > 2:
        near = [_apart(values, values[p], wide) <= radius for p in left[:: max(1, len(left) // PIVOTS)][:PIVOTS]]
        k = int(np.argmax([x.sum() for x in near]))
        pivot, members = left[:: max(1, len(left) // PIVOTS)][k], np.flatnonzero(near[k])
        members = members[members != pivot]
        found.append(np.stack((members, np.full(len(members), pivot)), axis=1))
        # those near the pivot still meet the visitors that are not
        settled, visitors = left[near[k][left]], np.flatnonzero(~home & ~near[k])
        stack = [(left[~near[k][left]], right, 0), (settled, visitors, 0)]
    else:
        stack = [(left, right, 0)]
    while stack:
        left, right, stuck = stack.pop()
        if not len(left) or not len(right):
            continue
        if len(left) * len(right) <= LEAF_PAIRS or stuck > 4:
            step = max(1, LEAF_PAIRS // len(right))
            for i in range(0, len(left), step):
                part = left[i : i + step]
                a, b = np.nonzero(_apart(values[part][:, None], values[right][None, :], wide) <= radius)
                links = np.stack((part[a], right[b]), axis=1)
                links = links[links[:, 0] != links[:, 1]]
                if len(links):
                    found.append(links)
                    held += len(links)
                if held > 4 * len(values) + LEAF_PAIRS:
                    found = [forest(np.concatenate(found), len(values))]
                    held = 0
            continue
        point = values[left[rng.integers(len(left))]]
        near, far = _apart(values[left], point, wide), _apart(values[right], point, wide)
        cut = int(np.median(far))
        inner, outer = (left[near <= cut], right[far <= cut + radius]), (left[near > cut], right[far > cut - radius])
        gained = max(len(inner[0]) * len(inner[1]), len(outer[0]) * len(outer[1])) < 0.9 * len(left) * len(right)
        stack += [(*inner, 0 if gained else stuck + 1), (*outer, 0 if gained else stuck + 1)]
    return forest(np.concatenate(found), len(values)) if found else np.zeros((0, 2), np.int64)


def components(edges: DataFrame) -> DataFrame:
    """Per node of edges (a, b): node, root (the smallest node of its component).

    Large-star and small-star rounds; only minima are gathered by node, so a hub is no hot key of an
    aggregation. Ends when a round changes nothing.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = checkpointed(small)
        if after.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(after, ["a", "b"], "left_anti").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = after


def by_component(rows: DataFrame, prints: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """rows (id, fp) with component_id, the smallest id that edges lead to; prints: fp with its smallest id (least) and number of rows (n)."""
    n_prints, total = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = prints.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "n", "least", "root")
    by_root = own.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    facts = checkpointed(join_hot(own, by_root, ["root"], "m", n_prints).select("fp", "n", "component_id"))
    return join_hot(rows, facts, ["fp"], "n", total).select(id_col, "fp", "component_id")
