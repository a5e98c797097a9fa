"""Statistics and sequences of one quantity per log. `order` is the order of the file, `time` the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(df: DataFrame, key: str, value: str, time: str, order: str, threshold: float | None = None, above: bool = True, sigmas: float = 2.0) -> DataFrame:
    """mean, max, min, std (population), range, the time of the maximum and of the first crossing.

    Without a threshold the bound is the log's mean plus, or minus, `sigmas` deviations: one more pass,
    joined by key. Where nothing crosses, the onset is -1. Salting isn't needed: all are partial aggregates.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull())
    base = [F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("range"), F.max_by(time, F.struct(v, -F.col(order))).alias("max_time")]
    crossed = (lambda bound: v > bound) if above else (lambda bound: v < bound)
    onset = lambda bound: F.coalesce(F.min_by(F.col(time), F.when(crossed(bound), F.col(order))).cast("double"), F.lit(-1.0)).alias("onset")
    if threshold is not None:
        return rows.groupBy(key).agg(*base, onset(F.lit(threshold)))
    first = rows.groupBy(key).agg(*base)
    bound = F.col("mean") + (1 if above else -1) * sigmas * F.col("std")
    bounds = first.select(key, bound.alias("_bound"))
    return first.join(rows.join(bounds, key).groupBy(key).agg(onset(F.col("_bound"))), key)


def change_count(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """How often a value differs from the one before it."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.select(key, (F.col(value) != before).alias("_c")).groupBy(key).agg(F.count_if("_c").alias("changes"))


def early_maximum(df: DataFrame, key: str, value: Column, time: str, order: str, within: float, limit: float, unit: float = 1e6) -> DataFrame:
    """Of each log: the maximum in its first `within` seconds, and the seconds to the first value over `limit` (-1: none)."""
    first = df.groupBy(key).agg(F.min_by(time, order).alias("_first"))
    rows = df.join(first, key)
    t = (F.col(time) - F.col("_first")) / unit
    return rows.groupBy(key).agg(F.coalesce(F.max(F.when(t <= within, value)), F.lit(0.0)).alias("early_max"), F.coalesce(F.min_by(t, F.when(value > limit, F.col(order))), F.lit(-1.0)).alias("first_over"))


def sustained_runs(df: DataFrame, key: str, holds: Column, time: str, order: list[str]) -> DataFrame:
    """Unbroken runs of rows where `holds`: key, begin, end (time), rows."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_on", F.coalesce(holds, F.lit(False))).withColumn("_run", F.sum((~F.col("_on")).cast("long")).over(w))
    return marked.where("_on").groupBy(key, "_run").agg(F.min(time).alias("begin"), F.max(time).alias("end"), F.count(F.lit(1)).alias("rows")).drop("_run")


def slices(df: DataFrame, key: str, time: str, size: int, step: int) -> DataFrame:
    """Each row once for every window it is in; windows start at the log's first time and end by its last."""
    ends = df.groupBy(key).agg(F.min(time).alias("_a"), F.max(time).alias("_z"))
    rows = df.join(ends, key)
    at = F.col(time) - F.col("_a")
    last = F.greatest(F.lit(0), F.floor((F.col("_z") - F.col("_a") - size) / step))
    low = F.greatest(F.lit(0).cast("long"), F.floor((at - size) / step) + 1)
    high = F.least(F.floor(at / step), last)
    return rows.where(low <= high).withColumn("window", F.explode(F.sequence(low, high))).drop("_a", "_z")


def with_slices(df: DataFrame, key: str, time: str, size: int, step: int) -> DataFrame:
    """A log as a whole and its windows, as training takes them: each row with kind full and window null, and once per window with kind slice."""
    whole = df.withColumn("kind", F.lit("full")).withColumn("window", F.lit(None).cast("long"))
    return whole.unionByName(slices(df, key, time, size, step).withColumn("kind", F.lit("slice")))


def downsampled(df: DataFrame, key: str, order: list[str], points: int) -> DataFrame:
    """Every max(1, n // points)-th row of each log."""
    own = Window.partitionBy(key)
    rows = df.withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    return rows.where(F.pmod(F.col("_i"), F.greatest(F.lit(1), F.floor(F.col("_n") / points))) == 0).drop("_i", "_n")


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, value: str, ties: str) -> DataFrame:
    """left with the value of the right row nearest in time of the same key; the earlier one if two are as near.

    Both sides are sorted by key and time, once each way, so that every frame only grows; `ties` orders right
    rows of one time.
    """
    point = F.struct(F.col(time).alias("t"), F.col(ties).alias("o"), F.col(value).alias("v"))
    kind = f"struct<t: bigint, o: bigint, v: {dict(right.dtypes)[value]}>"
    other = right.select(key, time, point.cast(kind).alias("_r"), F.lit(False).alias("_left"))
    every = left.withColumn("_r", F.lit(None).cast(kind)).withColumn("_left", F.lit(True)).unionByName(other, allowMissingColumns=True)
    past = F.last("_r", True).over(Window.partitionBy(key).orderBy(time, F.col("_left"), F.col("_r.o").desc()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.min("_r").over(Window.partitionBy(key).orderBy(F.desc(time)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = every.withColumn("_p", past).withColumn("_f", after).where("_left")
    take = F.col("_f").isNull() | (F.col("_p").isNotNull() & (F.col(time) - F.col("_p.t") <= F.col("_f.t") - F.col(time)))
    return out.withColumn("nearest", F.when(take, F.col("_p.v")).otherwise(F.col("_f.v"))).drop("_r", "_left", "_p", "_f")


def arbitrated(candidates: DataFrame, key: str, second: float = 1e6) -> DataFrame:
    """Root cause per log from (label, onset, confidence); at most one candidate per label. Onsets are in microseconds.

    In order of onset, a later one takes over if it comes within 5 s of the earliest and is surer, or
    within 30 s with confidence 0.85 or more and over 0.15 above the best.
    """
    timed = candidates.where("onset > 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("onset", (-F.col("confidence")).alias("minus"), "label"))).alias("c"))
    first = F.col("c")[0]

    def step(best: Column, x: Column) -> Column:
        gap, sure, had = x["onset"] - first["onset"], -x["minus"], -best["minus"]
        wins = ((gap <= 5 * second) & (sure > had)) | ((gap <= 30 * second) & (sure >= 0.85) & (sure > had + 0.15))
        return F.when(wins, x).otherwise(best)

    best = F.aggregate(F.slice("c", 2, 1 << 20), first, step)
    return timed.select(key, best["label"].alias("root_cause"), best["onset"].alias("onset"), (-best["minus"]).alias("confidence"), first["onset"].alias("earliest"))
