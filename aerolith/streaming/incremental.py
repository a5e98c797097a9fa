"""The same operators on arriving data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.sources.sinks import exists


def windowed(events: DataFrame, time: str, key: str, value: str, size: str = "5 seconds", step: str = "2.5 seconds", late: str = "10 minutes") -> DataFrame:
    """Sliding-window statistics, for a stream or a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size, step), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows of keys that weren't seen within the watermark; state stays bounded by it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that has arrived, writes it and ends."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def new_rows(stream: DataFrame, table: str, keys: list[str], checkpoint: str) -> None:
    """Appends to `table` (Parquet, by batch) those rows of what has arrived whose keys no earlier run has, and ends.

    The table is the state: it holds the keys of all runs, so what was seen once is never emitted again, and it can
    be read by any later run. A batch that is run again replaces its own part, and isn't held against it. Of rows
    with equal keys in a batch the first in order of all columns stays; null keys are equal to each other.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(rows: DataFrame, batch: int) -> None:
        order = [F.col(f"`{c}`") for c in rows.columns]
        own = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_r")).select("_r.*")
        if exists(spark, table):
            seen = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(table).where(F.col("batch") < batch).select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            own = own.join(seen, same, "left_anti")
        own.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily(spark: SparkSession, landing: str, schema: str, table: str, keys: list[str], checkpoint: str) -> None:
    """One run over the JSON lines that have landed since the last one, in folders day=YYYY-MM-DD: their new rows."""
    rows = spark.readStream.schema(f"{schema}, day date").option("basePath", landing).json(f"{landing}/day=*")
    new_rows(rows, table, keys, checkpoint)
