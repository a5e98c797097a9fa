"""Outlier trees and augmentation of feature tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups of features and the range by which a copy scales each of them.
SCALES = {"vibe_": (0.6, 1.4), "motor_spread": (0.7, 1.3), "bat_curr": (0.8, 1.2), "ekf_": (0.5, 1.5)}
_NODES = "tree int, node long, feature int, bound double, depth int, size long"


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the parts alone decide, so that a task run again gives it again."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def isolation_trees(rows: DataFrame, key: str, columns: list[str], trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation trees as rows of nodes: tree, node (root 1, children 2n and 2n + 1), feature (-1: a leaf), bound, depth, size.

    Each tree is fitted on the `sample` rows of least hash for it, the bounded sample of the published method, in
    a task of its own. A row joins a tree's draw by a bound on its hash that lets twice the sample through on
    average, so no tree sees more than that. Nulls count as 0.
    """
    n = max(1, rows.count())
    share = min(1.0, 2 * sample / n)
    data = rows.select(F.col(key).alias("_k"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(columns)])
    drawn = data.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _uniform(F.col("_k"), t, F.lit(seed)) < share)))
    drawn = drawn.withColumn("_h", F.xxhash64("_k", "tree", F.lit(seed + 1)))
    names, deepest = [f"f{i}" for i in range(len(columns))], int(np.ceil(np.log2(max(2, sample))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_h", "_k"]).head(sample)
        tree = int(part["tree"].iloc[0])
        rng, x, out = np.random.default_rng([seed, tree]), part[names].to_numpy(), []
        todo = [(1, x, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= deepest or len(own) < 2 or not len(wide):
                out.append((tree, node, -1, 0.0, depth, len(own)))
                continue
            f = int(rng.choice(wide))
            bound = float(rng.uniform(low[f], high[f]))
            left = own[:, f] <= bound
            if left.all():
                bound, left = float(low[f]), own[:, f] <= low[f]
            out.append((tree, node, f, bound, depth, len(own)))
            todo += [(2 * node, own[left], depth + 1), (2 * node + 1, own[~left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "bound", "depth", "size"])

    return drawn.groupBy("tree").applyInPandas(grow, _NODES)


def _average(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / n, n - 1)


def isolation_scores(rows: DataFrame, trees: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `score` in (0, 1]: near 1 for outliers. The trees' nodes (at most 511 a tree) are the model, read by the driver and sent to the tasks."""
    model = trees.toPandas()
    own = []
    for _, t in model.groupby("tree"):
        at = {n: i for i, n in enumerate(t["node"])}
        child = lambda side: np.array([at.get(2 * n + side, 0) for n in t["node"]])  # noqa: B023, E731
        own.append((t["feature"].to_numpy(), t["bound"].to_numpy(), child(0), child(1), (t["depth"] + _average(t["size"].to_numpy())).to_numpy(), at[1], int(t["size"].max())))
    usual = float(np.mean([_average(np.array([t[6]]))[0] for t in own])) if own else 1.0

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x, total = part.to_numpy(dtype=float), np.zeros(len(part))
            for feature, bound, left, right, length, root, _ in own:
                at = np.full(len(x), root)
                while (inner := feature[at] >= 0).any():
                    f = np.maximum(feature[at], 0)
                    at = np.where(inner, np.where(x[np.arange(len(x)), f] <= bound[at], left[at], right[at]), at)
                total += length[at]
            yield pd.Series(2.0 ** -(total / max(1, len(own)) / max(usual, 1e-9)))

    return rows.withColumn("score", score(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(columns)])))


def outliers(rows: DataFrame, key: str, columns: list[str], healthy: Column, trees: int = 200, sample: int = 256, share: float = 0.05, k: int = 5, seed: int = 42) -> DataFrame:
    """key, anomaly_score (over 0: an outlier), is_outlier and the k farthest features of each row (see deviations).

    Trees, means, deviations and the cut are those of the healthy rows: `share` of them lies beyond the cut, by
    approximate rank (one in 10,000). Where no row is healthy nothing is known: score 0, no outlier, no deviations.
    """
    usual = rows.where(healthy)
    moments = usual.agg(*[f(F.coalesce(F.col(c), F.lit(0.0))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if moments["m0"] is None:
        far = F.array().cast("array<struct<size: double, feature: string, value: double>>")
        return rows.select(key, F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_outlier"), far.alias("deviations"))
    model = isolation_trees(usual, key, columns, trees, sample, seed)
    scored = isolation_scores(rows, model, columns)
    cut = scored.where(healthy).agg(F.percentile_approx("score", 1 - share, 10_000)).first()[0]
    out = deviations(scored, columns, {c: moments[f"m{i}"] for i, c in enumerate(columns)}, {c: moments[f"s{i}"] for i, c in enumerate(columns)}, k)
    return out.select(key, (F.col("score") - cut).alias("anomaly_score"), (F.col("score") > cut).alias("is_outlier"), "deviations")


def deviations(rows: DataFrame, columns: list[str], means: dict[str, float], stds: dict[str, float], k: int = 5) -> DataFrame:
    """rows with `deviations`: the k features farthest from their mean in deviations, array<struct<size, feature, value>>."""
    each = [F.struct(F.abs((F.coalesce(F.col(c), F.lit(0.0)) - means[c]) / (stds[c] or 1.0)).alias("size"), F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    return rows.withColumn("deviations", F.slice(F.reverse(F.array_sort(F.array(*each))), 1, k))


def augmented(rows: DataFrame, key: str, columns: list[str], copies: int, least: float = 0.01, most: float = 0.05, seed: int = 42) -> DataFrame:
    """rows, as copy 0, and `copies` more of each: scaled by group, with Gaussian noise relative to each value.

    A copy has one factor per group of SCALES and one relative deviation between `least` and `most`. All chance is
    a hash of key, copy, column and seed. Nulls stay null.
    """
    every = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    level = least + (most - least) * _uniform(F.col("copy"), F.lit(seed), F.lit("level"))
    made = {}
    for c in columns:
        u, v = (_uniform(F.col(key), F.col("copy"), F.lit(c), F.lit(seed), F.lit(part)) for part in ("a", "b"))
        noise = 1 + level * F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * v)
        factor = F.lit(1.0)
        for prefix, (low, high) in SCALES.items():
            if c.startswith(prefix):
                factor = low + (high - low) * _uniform(F.col("copy"), F.lit(prefix), F.lit(seed))
        made[c] = F.when(F.col("copy") == 0, F.col(c).cast("double")).otherwise(F.col(c) * factor * noise)
    return every.withColumns(made)
