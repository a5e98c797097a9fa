"""Motor outputs: samples with a `channels` array of valid outputs, and the loss of thrust from runs at full output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def measured(samples: DataFrame) -> DataFrame:
    """samples with `most`, `least`, `spread` and `width` of their channels; samples without channels keep nulls."""
    most, least = F.array_max("channels"), F.array_min("channels")
    return samples.select("*", most.alias("most"), least.alias("least"), (most - least).alias("spread"), F.size("channels").alias("width"))


def first_times(samples: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Per log the time of its first row in file order, `_first`."""
    return samples.groupBy(key).agg(F.min_by(time, order).alias("_first"))


def motor_features(samples: DataFrame, key: str, time: str, order: str, hover: DataFrame | None = None, skip: int = 10_000_000, uneven: float = 400.0, saturated: float = 1900.0, high: float = 1800.0) -> DataFrame:
    """Ten features per log from one partial aggregation; outputs are summed per sample, so no row is multiplied.

    The spread leaves out the first `skip` of a log. hover(key, thrust) gives the output at hover; without it the
    ratio is 0. std is that of the population; `spread_onset` is -1 where the spread never passes `uneven`.
    """
    s = measured(samples).where("width > 0").join(first_times(samples, key, time, order), key)
    late = F.col(time) >= F.col("_first") + skip
    spread = F.when(late, F.col("spread"))
    total = F.aggregate("channels", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("channels", F.lit(0.0), lambda a, x: a + x * x)
    share = lambda holds: F.avg(holds.cast("double"))
    out = s.groupBy(key).agg(
        F.avg(spread).alias("spread_mean"), F.max(spread).alias("spread_max"), F.stddev_pop(spread).alias("spread_std"),
        F.sum(total).alias("_t"), F.sum(squares).alias("_q"), F.sum("width").alias("_n"), F.max("most").alias("output_max"),
        F.coalesce(F.min_by(time, F.when(late & (F.col("spread") > uneven), F.col(order))).cast("double"), F.lit(-1.0)).alias("spread_onset"),
        share(F.col("most") > saturated).alias("saturated"), share((F.col("width") >= 4) & (F.col("least") > high)).alias("all_high"))
    mean = F.col("_t") / F.col("_n")
    out = out.withColumn("output_mean", mean).withColumn("output_std", F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean))).drop("_t", "_q", "_n")
    if hover is None:
        return out.withColumn("hover_ratio", F.lit(0.0)).fillna(0.0)
    return out.join(hover.where("thrust > 0"), key, "left").withColumn("hover_ratio", F.col("output_mean") / F.col("thrust")).drop("thrust").fillna(0.0)


def thrust_loss(samples: DataFrame, altitudes: DataFrame, key: str, time: str, order: str, altitude: str, pegged: float = 1900.0, lasting: int = 3_000_000, fall: float = 1.0) -> DataFrame:
    """Logs whose four or more motors all stay at `pegged` for `lasting` while the altitude falls: key, onset.

    The onset is the begin of the first run that does. Altitudes from the run's begin to the sample count: the first
    one is found from the begin onwards, the last one up to the sample, both by frames that only grow over the log
    in time order, so a long run costs no more than a short one.
    """
    full = (F.col("width") >= 4) & (F.col("least") >= pegged)
    by_file = Window.partitionBy(key).orderBy(order)
    runs = measured(samples).where("width > 0").withColumn("_on", full).withColumn("_run", F.sum((~F.col("_on")).cast("long")).over(by_file))
    runs = runs.where("_on").select(key, time, "_run", F.min_by(time, order).over(Window.partitionBy(key, "_run")).alias("_begin"))
    none = F.lit(None).cast("struct<t: bigint, o: bigint, a: double>")
    point = F.struct(F.col(time).cast("bigint").alias("t"), F.col(order).cast("bigint").alias("o"), F.col(altitude).cast("double").alias("a"))
    seen = altitudes.where(F.col(altitude).isNotNull()).select(key, F.col(time).alias("_at"), point.alias("_p"), F.lit(None).cast("bigint").alias("_begin"), F.lit(None).cast("bigint").alias("_end"), F.lit(None).cast("bigint").alias("_run"))
    begins = runs.select(key, F.col("_begin").alias("_at"), none.alias("_p"), "_begin", F.lit(None).cast("bigint").alias("_end"), "_run").dropDuplicates([key, "_run"])
    ends = runs.where(F.col(time) - F.col("_begin") >= lasting).select(key, F.col(time).alias("_at"), none.alias("_p"), "_begin", F.col(time).alias("_end"), "_run")
    grown = lambda by: Window.partitionBy(key).orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = seen.unionByName(begins).unionByName(ends)
    every = every.withColumn("_next", F.min("_p").over(grown(F.desc("_at")))).withColumn("_last", F.max("_p").over(grown(F.asc("_at"))))
    first = every.where("_begin is not null and _end is null").select(key, "_run", F.col("_next").alias("_start"))
    hits = every.where("_end is not null").select(key, "_run", "_begin", "_end", "_last").join(first, [key, "_run"])
    fell = (F.col("_start.t") <= F.col("_end")) & (F.col("_last.t") >= F.col("_begin")) & (F.col("_last.a") < F.col("_start.a") - fall)
    return hits.where(fell).groupBy(key).agg(F.min_by("_begin", F.col("_end")).cast("double").alias("onset"))


def evidence(*items: tuple[Column, str, Column, float]) -> Column:
    """Array of struct(feature, value, threshold) of the items (holds, feature, value, threshold) that hold."""
    each = [F.when(holds, F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))) for holds, name, value, limit in items]
    return F.filter(F.array(*each), lambda x: x.isNotNull())
