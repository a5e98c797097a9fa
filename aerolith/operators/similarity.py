"""Similar past cases by cosine, exact, block against block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block that are multiplied at once.
STRIP = 256


def _blocks(rows: DataFrame, key: str, vector: str, size: int, prefix: str) -> DataFrame:
    """Rows dealt by the hash of their key into blocks of about `size`: one row per block, its ids and vectors."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(n)).alias("_b"), F.struct(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).alias("_s"))
    return dealt.groupBy("_b").agg(F.collect_list("_s").alias("_l")).select(F.col("_b").alias(f"{prefix}_block"), F.col("_l.k").alias(f"{prefix}_ids"), F.col("_l.v").alias(f"{prefix}_vectors"))


def similar_cases(queries: DataFrame, cases: DataFrame, log_id: str, case_id: str, vector: str, least: float = 0.5, k: int = 3, block: int = 8192) -> DataFrame:
    """The k most similar cases of each query with a cosine (4 digits) over `least`; ties by case id, itself left out.

    A stated query set against all cases: both sides are dealt into blocks, each pair of blocks is one product of
    matrices in strips, and of each query only its k best per pair go on. A task holds two blocks and a strip. What is
    moved falls with the size of the blocks, which is as large as a task can hold. Null
    vectors take no part; those of length zero are like nothing. Ids are integers, vectors of equal lengths.
    """
    pairs = _blocks(queries, log_id, vector, block, "q").crossJoin(_blocks(cases, case_id, vector, block, "c"))

    def best(pair: pd.DataFrame) -> pd.DataFrame:
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, np.inf)
        every, ids, out = np.asarray(pair["q_ids"][0]), np.asarray(pair["c_ids"][0]), []
        left, right = unit(np.vstack(pair["q_vectors"][0])), unit(np.vstack(pair["c_vectors"][0])).T
        by_id = np.argsort(ids, kind="stable")
        ids, right = ids[by_id], right[:, by_id]
        for i in range(0, len(every), STRIP):
            own, score = every[i : i + STRIP], np.round(left[i : i + STRIP] @ right, 4)
            score[own[:, None] == ids[None, :]] = -2
            # of equal cosines the smaller id comes first, as ids ascend
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(own)), order.shape[1])
            found = pd.DataFrame({"log": own[rows], "case_id": ids[order.ravel()], "cosine": score[rows, order.ravel()]})
            out.append(found[found["cosine"] > least])
        return pd.concat(out)

    found = pairs.groupBy("q_block", "c_block").applyInPandas(best, "log long, case_id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("log").orderBy(F.desc("cosine"), "case_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("log").alias(log_id), "case_id", "cosine", "rank")
