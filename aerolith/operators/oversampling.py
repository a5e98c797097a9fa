"""More rows for small classes: new ones between a row and one of its nearest neighbours in its class.

The different vectors of a class are dealt by a hash to blocks of bounded size, and each two blocks of a class meet in a
task of their own, so no class is in one task, and copies of a vector are searched for and found as one. How many new rows a row gives, which neighbour and how far towards
it are hashes of its key, so a task run again gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS, BLOCK = 5, 4096
#: Queries of a block that are multiplied at once, and parts in which the keys of one vector are gathered.
STRIP, SALTS = 256, 32


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def numbered(rows: DataFrame, group: str, key: str, name: str = "at", cell: int = 100_000) -> DataFrame:
    """rows with `name`, from 0 without gaps in each group. Rows are counted in cells of the key's hash, then within a
    cell, so no window has a whole group; the counts of the cells are few."""
    cells = max(1, -(-rows.count() // cell))
    own = rows.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(cells)))
    counts = own.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(group).alias("_g"), F.col("_cell").alias("_d"), (F.sum("_n").over(Window.partitionBy(group).orderBy("_cell")) - F.col("_n")).alias("_before"))
    within = own.withColumn("_in", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(key)) - 1)
    out = within.join(F.broadcast(before) if cells <= 1000 else before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_d")))
    return out.withColumn(name, F.col("_before") + F.col("_in")).drop("_cell", "_g", "_d", "_before", "_in")


def _closest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, distance) of the k ids closest to each row of x; those of row i of y are ids[first[i] : first[i + 1]].

    Products of matrices choose, with what rounding may hide; distances are then summed as they are written."""
    own, others = (x**2).sum(1), (y**2).sum(1)
    d = own[:, None] - 2 * x @ y.T + others[None]
    d[np.isnan(d)] = np.inf
    m = min(k, len(y))
    slack = 1e-9 * (own + np.max(others, initial=0.0, where=np.isfinite(others)))
    r, c = np.nonzero(d <= (np.partition(d, m - 1, axis=1)[:, m - 1] + slack)[:, None])
    exact = np.zeros(len(r))
    for j in range(x.shape[1]):
        diff = x[r, j] - y[c, j]
        exact += diff * diff
    n = first[c + 1] - first[c]
    at = np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    r, exact, found = np.repeat(r, n), np.repeat(np.sqrt(exact), n), ids[at]
    order = np.lexsort((found, exact, r))
    r, exact, found = r[order], exact[order], found[order]
    best = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
    return r[best], found[best], exact[best]


def nearest_in_class(rows: DataFrame, key: str, label: str, vector: str, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """label, key, neighbour, place (from 1): the k nearest others of each row's class, ties by key. Keys are integers."""
    own = rows.select(F.col(label).alias("_l"), F.col(key).cast("long").alias("_k"), F.transform(vector, lambda x: x.cast("double")).alias("_v")).where("_k IS NOT NULL AND _v IS NOT NULL")
    # a vector is known by two hashes
    own = own.withColumns({"_a": F.xxhash64("_v"), "_h": F.xxhash64(F.lit(1), F.col("_v"))})
    # itself, as often as it is there, is left out at the end
    most = k + (own.groupBy("_l", "_k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1)
    some = own.groupBy("_l", "_a", "_h", F.pmod(F.xxhash64("_k"), F.lit(SALTS)).alias("_s")).agg(F.first("_v").alias("_v"), F.slice(F.sort_array(F.collect_list("_k")), 1, most).alias("_i"))
    vectors = some.groupBy("_l", "_a", "_h").agg(F.first("_v").alias("_v"), F.slice(F.sort_array(F.flatten(F.collect_list("_i"))), 1, most).alias("_i"))
    blocks = vectors.groupBy(F.col("_l").alias("_m")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    dealt = vectors.join(blocks, F.col("_l").eqNullSafe(F.col("_m"))).withColumn("_b", F.pmod("_a", "_n").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pairs = dealt.select("_l", F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"), "_b", "_a", "_h", "_v", "_i")

    def best(t: pa.Table) -> pa.Table:
        lists = t["_i"].combine_chunks()
        values, keys, b = t["_v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1), lists.flatten().to_numpy(), t["_b"].to_numpy()
        first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        p, q = np.flatnonzero(b == t["_p"][0].as_py()), np.flatnonzero(b == t["_q"][0].as_py())
        out = []
        for x, y in [(p, q)] if t["_p"][0] == t["_q"][0] else [(p, q), (q, p)]:
            if not len(x) or not len(y):
                continue
            n = first[y + 1] - first[y]
            bounds = np.concatenate(([0], np.cumsum(n)))
            ids = keys[np.repeat(first[y] - bounds[:-1], n) + np.arange(int(bounds[-1]))]
            for i in range(0, len(x), STRIP):
                r, found, d = _closest(values[x[i : i + STRIP]], values[y], ids, bounds, most)
                out.append((x[i + r], found, d))
        at, found, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"_l": t["_l"].combine_chunks().take(pa.array(at)), "_a": t["_a"].to_numpy()[at], "_h": t["_h"].to_numpy()[at], "neighbour": found, "d": d})

    schema = pairs.select("_l", "_a", "_h").schema.add("neighbour", "long").add("d", "double")
    found = pairs.groupBy("_l", "_p", "_q").applyInArrow(best, schema)
    near = found.groupBy("_l", "_a", "_h").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "neighbour"))), 1, most).alias("_near"))
    near = near.withColumnRenamed("_l", "_m")
    each = own.drop("_v").join(near, ["_a", "_h"]).where(F.col("_l").eqNullSafe(F.col("_m"))).select("_l", "_k", F.explode(F.slice(F.filter("_near", lambda x: x["neighbour"] != F.col("_k")), 1, k)).alias("_x"))
    place = F.row_number().over(Window.partitionBy("_k").orderBy("_x.d", "_x.neighbour"))
    return each.withColumn("place", place).where(F.col("place") <= k).select(F.col("_l").alias("label"), F.col("_k").alias("key"), F.col("_x.neighbour").alias("neighbour"), "place")


def oversampled(rows: DataFrame, key: str, label: str, vector: str, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """rows and new ones, so that all classes are as large as the largest: key, label, vector, copy (0: a given row).

    A class of one row is doubled as it is; of a class of n rows at most n - 1 neighbours count.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    small = counts.where(F.col("_n") < most).select(F.col(label).alias("_l"), "_n")
    own = numbered(rows.select(key, label, vector), label, key).join(F.broadcast(small), F.col(label).eqNullSafe(F.col("_l")))
    missing = F.lit(most) - F.col("_n")
    share = F.floor(missing / F.col("_n")) + (F.col("at") < missing % F.col("_n")).cast("long")
    wanted = own.withColumn("_copies", share).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    near = nearest_in_class(own.select(key, label, vector), key, label, vector, k).groupBy(F.col("key").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("place", "neighbour"))).alias("_near"))
    of = wanted.join(near, F.col(key) == F.col("_of"), "left")
    pick = F.floor(_uniform(F.col(key), F.col("copy"), F.lit(seed), F.lit("which")) * F.size("_near")).cast("int")
    of = of.withColumn("_other", F.get("_near", pick)["neighbour"])
    vectors = rows.select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    far = _uniform(F.col(key), F.col("copy"), F.lit(seed), F.lit("far"))
    made = of.join(vectors, F.col("_other") == F.col("_k"), "left")
    between = F.when(F.col("_v").isNull(), F.col(vector)).otherwise(F.transform(F.arrays_zip(F.col(vector).alias("a"), F.col("_v").alias("b")), lambda z: z["a"] + far * (z["b"] - z["a"])))
    new = made.select(key, label, between.alias(vector), "copy")
    return rows.select(key, label, vector, F.lit(0).cast("long").alias("copy")).unionByName(new)
