"""What the operators of this subpackage share: tables, checkpoints, chunks and hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with over 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows of two numbers that are broadcast at most.
FEW = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that is unset and one machine does all is it a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_root(df.sparkSession))
    return df.checkpoint()


#: Of tables whose rows are packed and large: sizes are looked at after each row, as a reader holds a row group at once and a writer, too.
LARGE_ROWS = {"compression": "none", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def bucketed(df: DataFrame, column: str, n: int, name: str, options: dict | None = None) -> DataFrame:
    """df as a written table of n buckets by column: grouping by it afterwards moves none of its rows."""
    spark, table_name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.options(**(options or {})).bucketBy(n, column).option("path", shared_folder(spark, name)).saveAsTable(table_name)
    return spark.table(table_name)


def released() -> None:
    """Gives memory that a worker no longer uses back to the system, so that the workers of an executor fit beside it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forgotten(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more."""
    df.sparkSession.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """What runs inside moves between JVM and workers in Arrow batches of about this size, not of up to 64 MB.

    Of a batch each task holds its buffers in the JVM, twice while they grow, and a copy in the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed(work):
    """work, a function of Arrow tables, after which its worker gives memory back."""

    def run(*tables):
        out = work(*tables)
        released()
        return out

    # the number of arguments tells Spark whether the function also takes the key
    return (lambda t: run(t)) if work.__code__.co_argcount == 1 else (lambda t, u: run(t, u))


def utf8(column: str | Column) -> Column:
    """A string's UTF-8 bytes; null is empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("binary"), F.lit(b""))


def pieces(total: int | None, each: int) -> int:
    return max(1, -(-int(total or 0) // each))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, whatever their case."""
    low = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with facts (one row per key; `size` tells how many of the `total` rows have it).

    Facts of hot keys are broadcast; by the share that makes them hot there are at most HOT_SHARE.
    The rows of all other keys are shuffled, with at most 1/HOT_SHARE of the rows on one key.
    """
    least = total / HOT_SHARE
    hot, rest = facts.where(F.col(size) > least), facts.where(F.col(size) <= least)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    left = marked.where("_hot is null").drop("_hot").join(rest, keys, how)
    right = marked.where("_hot").drop("_hot").join(F.broadcast(hot), keys, "inner")
    return left.unionByName(right)


def rows_left(docs: DataFrame, gone: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", twins: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose id and hash of the text gone has (_gone_id, _gone_hash); of each that twins has, too, one.

    All columns of docs come back as they were, whatever their names. Ids and hashes are broadcast up to
    FEW of them, and joined by a shuffle beyond that.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.col(id_col).alias("_own_id"), F.xxhash64(text_col).alias("_own_hash"), row.alias("_row"))
    same = F.col("_own_id").eqNullSafe(F.col("_gone_id")) & (F.col("_own_hash") == F.col("_gone_hash"))

    def small(df: DataFrame) -> DataFrame:
        df = checkpointed(df.distinct())
        return F.broadcast(df) if df.count() <= FEW else df

    left = keyed.join(small(gone), same, "left_anti")
    if twins is not None:
        twins = small(twins)
        left = left.join(twins, same, "left_anti").unionByName(left.join(twins, same, "left_semi").dropDuplicates(["_own_id", "_own_hash"]))
    return left.select("_row.*")
