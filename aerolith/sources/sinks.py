"""What jobs leave behind: tables by batch, a JSON record per log, and lists that grow.

A second run of a batch replaces its part and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators.oversampling import numbered


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_batch(rows: DataFrame, path: str, batch: str) -> None:
    """rows as the part `batch` of the table at path."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_import(tables: dict[str, DataFrame], path: str, batch: str) -> None:
    """The manifests of an import (inventory, clean, rejected, ...), each a table below path, the batch a part of it."""
    for name, rows in tables.items():
        write_batch(rows, f"{path}/{name}", batch)


def write_report(summary: DataFrame, records: DataFrame, path: str, batch: str) -> None:
    """A batch's summary as CSV with a header, and its records (record: JSON) as lines of text."""
    summary.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").csv(f"{path}/summary", header=True)
    records.select("record", F.lit(batch).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(f"{path}/records")


def batch_summary(verdicts: DataFrame) -> DataFrame:
    """The columns of a batch's summary, from the row of verdicts of each log (filename is its id)."""
    top = F.coalesce(F.col("failure_type"), F.lit("-"))
    return verdicts.select(F.col("log_id").cast("string").alias("filename"), F.col("batch").alias("status"), top.alias("top_diagnosis"), F.format_number(F.coalesce("confidence", F.lit(0.0)), 2).alias("confidence"), F.coalesce(F.get("final", F.lit(0))["severity"], F.lit("-")).alias("severity"), (F.col("status") == "uncertain").alias("requires_review"))


def record(verdicts: DataFrame) -> DataFrame:
    """log_id and `record`: what is said of a log, as JSON."""
    parts = F.struct("vehicle", "extracted", F.struct("status", "failure_type", "confidence", "reasons", "why").alias("decision"), F.col("final").alias("diagnoses"), "hypotheses")
    return verdicts.select("log_id", F.to_json(parts).alias("record"))


def feature_tables(matrix: DataFrame, labels: DataFrame, path: str, batch: str) -> None:
    """Features and labels (both by log_id) of a training set, row by row alike: only logs that both have."""
    both = matrix.join(labels.select("log_id"), "log_id", "left_semi")
    write_batch(both, f"{path}/features", batch)
    write_batch(labels.join(matrix.select("log_id"), "log_id", "left_semi"), f"{path}/labels", batch)


def write_benchmark(tables: dict[str, DataFrame], path: str, batch: str) -> None:
    """The tables of a benchmark run (overall, per_label, confusion, errors, ...) as JSON lines below path, the batch a part of each."""
    for name, rows in tables.items():
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(f"{path}/{name}")


def append_known(cases: DataFrame, path: str, key: str) -> None:
    """Appends cases with an `id` known_001, known_002, ..., on from those that the table has, without gaps.

    The cases are numbered by counts of cells of the key's hash, so no task sees them all; the longest ids set the width.
    """
    spark = cases.sparkSession
    have = spark.read.parquet(path).count() if exists(spark, path) else 0
    rows = numbered(cases.withColumn("_all", F.lit(0)), "_all", key, "_at").drop("_all")
    number = (F.col("_at") + F.lit(have + 1)).cast("string")
    rows.withColumn("id", F.concat(F.lit("known_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))).drop("_at").write.mode("append").parquet(path)
