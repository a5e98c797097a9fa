"""Decoded telemetry as a long table, and small files beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("msg_type", T.StringType()), T.StructField("time_us", T.LongType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])


def read_messages(spark: SparkSession, path: str, families: list[str] | None = None) -> DataFrame:
    """Messages of many logs; the families are filtered at the scan."""
    rows = spark.read.schema(MESSAGES).parquet(path)
    return rows.where(F.col("msg_type").isin(families)) if families else rows


def read_logs(spark: SparkSession, path: str, families: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Logs below path, a file each, and their messages: every file is a log, also one that can't be read or is empty.

    logs: log_id (the file's name without its suffix), path, size_bytes, n and counts (messages, by family). The
    families are filtered at the scan; a file that is no Parquet file gives no messages and n 0.
    """
    name = lambda column: F.regexp_extract(column, r"([^/]+?)(\.[^./]*)?$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size_bytes"))
    rows = spark.read.schema(MESSAGES).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
    rows = rows.where(F.col("msg_type").isin(families)) if families else rows
    rows = rows.withColumn("log_id", name(F.col("_metadata.file_path")))
    each = rows.groupBy("log_id", "msg_type").agg(F.count(F.lit(1)).alias("n")).groupBy("log_id").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("msg_type", "n")))).alias("counts"))
    logs = files.withColumn("log_id", name(F.col("path"))).join(each, "log_id", "left")
    return logs.select("log_id", "path", "size_bytes", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("counts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("counts")), rows


def thresholds(table: DataFrame, most: int = 1000) -> dict[str, float]:
    """A table of thresholds (name, value), the last of a name in order of its value; at most `most` rows are read."""
    rows = table.groupBy("name").agg(F.max(F.col("value").cast("double")).alias("value")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} thresholds")
    return {r["name"]: r["value"] for r in rows if r["value"] is not None}


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table with a header, all strings; a missing file is empty."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON document's logs[]."""
    return spark.read.json(path, multiLine=True).select(F.explode("logs").alias("log")).select("log.*")


def scan_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Files below root by suffix, in any case: path, size, SHA-256 and first bytes; contents are dropped early."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower("path").endswith(suffix.lower())).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 16).alias("head"))


def harmonised(manifests: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Union of manifests; each column is the first of its sources that isn't blank."""
    out = None
    for name, df in manifests.items():
        have = set(df.columns)
        picked = [F.coalesce(*[F.nullif(F.trim(F.col(s).cast("string")), F.lit("")) for s in sources if s in have], F.lit(None).cast("string")).alias(c) for c, sources in columns.items()]
        own = df.select(*picked, F.lit(name).alias("manifest"))
        out = own if out is None else out.unionByName(own)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as telemetry: log_id, seq, time_us, msg_type, value, code."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), F.col("event_type").alias("msg_type"), "value", F.get_json_object("props", "$.k").cast("int").alias("code"))
