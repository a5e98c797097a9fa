"""Shards of nearly equal bytes by Karmarkar-Karp differencing (op10). Law: bytes.

Method: documents of equal text are one group and are not divided. Differencing keeps a heap of
partial partitions; the two of the widest spread are combined in opposite order, the fullest part of
one with the emptiest of the other, until one partition is left. That is done in two levels. Groups
are dealt by hash to buckets, and each bucket differences its groups into bundles of three grades of
size; then the bundles of all buckets, and the groups too large for a bundle, are differenced into
the shards. Where there are more than MOST_BUCKETS buckets, their bundles are in turn dealt to buckets and
bundled, as often as it takes, so how many bundles and large groups come together is bounded by parameters,
not by the data.

Edge cases: a null text has no bytes and crc 0, and null texts are one group; with fewer groups than
shards some shards stay empty; repeated rows each have a slot; a third of all rows in one group make
one large shard and leave the others equal.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, join_hot, pieces, table, utf8

SHARDS, OVERHEAD = 40, 16
#: Groups of a bucket on average; most buckets whose bundles are differenced together; bundles of each grade, all buckets together; a group
#: of over 1/LARGE of all bytes is no part of a bundle.
BUCKET_GROUPS, MOST_BUCKETS, BUNDLES, LARGE = 4_000, 4096, 8192, 16_384
#: Of each 64 groups, those that go to bundles of the second and of the third grade.
_SECOND, _THIRD = 8, 2


def differenced(sizes: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each item; the sums of the parts are close to each other."""
    if k < 2:
        return [0] * len(sizes)
    # a partial partition: sums of its parts in ascending order, and for each the items as a chain
    heap = [(-s, i, [(s, (i, None, None))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        # parts that are not listed are empty; x's fullest meet y's emptiest
        rest, empty = y[::-1], k - len(x)
        merged = rest[:empty] + [(a + b, (-1, p, q)) for (a, p), (b, q) in zip(x, rest[empty:])] + x[max(0, len(rest) - empty) :]
        merged.sort(key=lambda part: part[0])
        spread = merged[-1][0] - (merged[0][0] if len(merged) == k else 0)
        serial += 1
        heapq.heappush(heap, (-spread, serial, merged))
    out = [0] * len(sizes)
    if heap:
        for part, (_, chain) in enumerate(heap[0][2]):
            stack = [chain]
            while stack:
                item, left, right = stack.pop()
                if item >= 0:
                    out[item] = part
                else:
                    stack += [left, right]
    return out


def shards_of_groups(groups: DataFrame, k: int) -> DataFrame:
    """key, shard of each group; groups: key, bytes. One row per bundle and per large group of the last level comes to the driver."""
    n, whole = groups.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    if not n:
        return groups.select("key", F.lit(0).alias("shard"))
    large = F.col("bytes") > int(whole) // LARGE
    buckets = pieces(n, BUCKET_GROUPS)
    per_grade = max(2, BUNDLES // buckets)

    def bundle(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), ("key", "ascending")])
        keys, sizes, bucket = t["key"], t["bytes"].to_pylist(), t["bucket"][0].as_py()
        grades: tuple[list[int], ...] = ([], [], [])
        for i in range(len(sizes)):
            grades[2 if i % 64 < _THIRD else 1 if i % 64 < _THIRD + _SECOND else 0].append(i)
        of = [0] * len(sizes)
        for g, items in enumerate(grades):
            for i, part in zip(items, differenced([sizes[i] for i in items], per_grade)):
                of[i] = (bucket * 3 + g) * per_grade + part
        return pa.table({"key": keys, "bytes": t["bytes"], "bundle": pa.array(of, pa.int64())})

    small = groups.where(~large).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long"))
    bundled = checkpointed(small.groupBy("bucket").applyInArrow(bundle, "key string, bytes long, bundle long"))
    if buckets > MOST_BUCKETS:
        # too many bundles to come together: each is a group of the next level, beside the large groups
        above = bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).select(F.concat(F.lit("b"), F.col("bundle").cast("string")).alias("key"), "bytes")
        above = checkpointed(above.unionByName(groups.where(large).select(F.concat(F.lit("g"), F.col("key")).alias("key"), "bytes")))
        placed = checkpointed(shards_of_groups(above, k)).select(F.substring("key", 1, 1).alias("kind"), F.expr("substring(key, 2)").alias("key"), "shard")
        of_bundle = placed.where("kind = 'b'").select(F.col("key").cast("long").alias("bundle"), "shard")
        return bundled.join(of_bundle, "bundle").select("key", "shard").unionByName(placed.where("kind = 'g'").select("key", "shard"))
    sums = [(r.bundle, None, r.bytes) for r in bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()]
    alone = [(None, r.key, r.bytes) for r in groups.where(large).select("key", "bytes").orderBy("key").collect()]
    every = sums + alone
    parts = differenced([x[2] for x in every], k)
    spark = groups.sparkSession
    of_bundle = spark.createDataFrame([(x[0], p) for x, p in zip(every, parts) if x[0] is not None], "bundle long, shard int")
    of_key = spark.createDataFrame([(x[1], p) for x, p in zip(every, parts) if x[0] is None], "key string, shard int")
    return bundled.join(F.broadcast(of_bundle), "bundle").select("key", "shard").unionByName(of_key)


def sharded(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (long), text_crc32 (long), shard (int), slot (long, from 0 without gaps in each shard)."""
    key = F.when(F.col(text_col).isNull(), F.lit("")).otherwise(F.sha2(F.col(text_col).cast("binary"), 256))
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(OVERHEAD)
    rows = checkpointed(docs.select(F.col(id_col), key.alias("key"), size.cast("long").alias("size"), F.crc32(utf8(text_col)).alias("text_crc32")))
    groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total = rows.count()
    facts = shards_of_groups(groups, shards).join(groups.select("key", "n"), "key")
    placed = checkpointed(join_hot(rows, facts, ["key"], "n", total).select(id_col, "size", "text_crc32", "shard", "key"))
    # slots: rows are counted in even cells of each shard, then within a cell
    cells = pieces(total, 200_000)
    placed = placed.withColumn("cell", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(cells)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(id_col, "key"))
    return placed.withColumn("at", within - 1).join(before, ["shard", "cell"]).select(id_col, "size", "text_crc32", "shard", (F.col("before") + F.col("at")).alias("slot"))


def op10_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_differencing": op10_differencing}
ORACLE_SQL: dict[str, str] = {}
