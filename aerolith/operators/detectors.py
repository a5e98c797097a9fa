"""Four detectors on their own: one aggregation per log, then a verdict.

Each returns one row per log: fault, fault_type (null without a fault), confidence, evidence
array<struct<feature, value, threshold>>, first_fault_s (seconds from the log's first sample). Logs with fewer
samples than `samples` get no fault. Where nothing is found confidence is 0 and evidence is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.motors import evidence, first_times, measured


def _verdict(rows: DataFrame, key: str, samples: int, at_least: float, parts: list[tuple[Column, float]], types: list[tuple[Column, str]], items: list, onset: Column) -> DataFrame:
    total = F.round(F.least(F.lit(1.0), sum((F.when(holds, F.lit(add)).otherwise(0.0) for holds, add in parts), F.lit(0.0))), 3)
    kind = F.coalesce(*[F.when(holds, F.lit(name)) for holds, name in types])
    found = (F.col("_samples") >= samples) & (total >= at_least)
    none = F.array().cast("array<struct<feature: string, value: double, threshold: double>>")
    return rows.select(key, found.alias("fault"), F.when(found, kind).alias("fault_type"), F.when(found, total).otherwise(0.0).alias("confidence"), F.when(found, evidence(*items)).otherwise(none).alias("evidence"), F.when(found, F.round((onset - F.col("_first")) / 1e6, 2)).alias("first_fault_s"))


def _first(time: str, order: str, holds: Column) -> Column:
    return F.min_by(time, F.when(holds, F.col(order)))


def _outputs(samples: DataFrame, key: str, time: str, order: str, saturated: float, high: float, skip: int) -> DataFrame:
    s = measured(samples).join(first_times(samples, key, time, order), key)
    some, full = F.col("width") > 0, F.col("most") >= saturated
    every = (F.col("width") >= 4) & (F.col("least") >= high)
    spread = F.when(some & (F.col(time) >= F.col("_first") + skip), F.col("spread"))
    share = lambda holds: F.coalesce(F.avg(F.when(some, holds.cast("double"))), F.lit(0.0))
    return s.groupBy(key).agg(F.count(F.lit(1)).alias("_samples"), F.min("_first").alias("_first"), share(full).alias("saturated"), share(every).alias("all_high"), F.coalesce(F.max(spread), F.lit(0.0)).alias("spread_max"), F.coalesce(F.avg(spread), F.lit(0.0)).alias("spread_mean"), _first(time, order, full | every).alias("_onset"))


def motor_faults(samples: DataFrame, key: str, time: str, order: str, saturated: float = 1900.0, high: float = 1800.0, skip: int = 10_000_000) -> DataFrame:
    """thrust_loss from saturated outputs or motor_imbalance from a lasting spread."""
    rows = _outputs(samples, key, time, order, saturated, high, skip)
    sat, every, most, mean = (F.col(c) for c in ("saturated", "all_high", "spread_max", "spread_mean"))
    uneven = (most >= 400) & (mean >= 200)
    parts = [(sat > 0.25, 0.45), ((sat > 0.2) & (sat <= 0.25), 0.25), (every > 0.15, 0.25), (uneven, 0.45)]
    items = [(sat > 0.2, "saturated", F.round(sat, 4), 0.2), (every > 0.15, "all_high", F.round(every, 4), 0.15), (uneven, "spread_max", F.round(most, 1), 400), (uneven, "spread_mean", F.round(mean, 1), 200)]
    return _verdict(rows, key, 10, 0.4, parts, [((sat > 0.2) | (every > 0.15), "thrust_loss"), (uneven, "motor_imbalance")], items, F.col("_onset"))


def vibration_faults(samples: DataFrame, key: str, time: str, order: str, warn: float = 30.0, fail: float = 60.0) -> DataFrame:
    """vibration_high from samples with vibe_x, vibe_y, vibe_z and clips."""
    axes = [f"vibe_{a}" for a in "xyz"]
    cross = [c for a in axes for c in (_first(time, order, F.col(a) > warn).alias(f"_w_{a}"), _first(time, order, F.col(a) > fail).alias(f"_f_{a}"))]
    rows = samples.groupBy(key).agg(F.count(F.lit(1)).alias("_samples"), F.min_by(time, order).alias("_first"), *[F.max(a).alias(a) for a in axes], F.sum("clips").alias("clips"), *cross)
    v, clips = {a: F.col(a) for a in axes}, F.col("clips")
    parts = [p for a in axes for p in ((v[a] > fail, 0.2), ((v[a] > warn) & (v[a] <= fail), 0.1))] + [(clips > 0, 0.3), (clips > 100, 0.2)]
    items = [i for a in axes for i in ((v[a] > fail, f"{a}_max", F.round(v[a], 2), fail), ((v[a] > warn) & (v[a] <= fail), f"{a}_max", F.round(v[a], 2), warn))] + [(clips > 0, "vibe_clip", clips, 0)]
    onset = F.least(*[F.when(v[a] > fail, F.col(f"_f_{a}")).otherwise(F.col(f"_w_{a}")) for a in axes])
    return _verdict(rows, key, 5, 0.25, parts, [(F.lit(True), "vibration_high")], items, onset)


def gps_faults(samples: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """gps_loss if over half of the samples (status, hdop, nsats) have no fix, else gps_quality_poor."""
    rows = samples.groupBy(key).agg(F.count(F.lit(1)).alias("_samples"), F.min_by(time, order).alias("_first"), F.avg((F.col("status") >= 3).cast("double")).alias("fix"), F.avg("hdop").alias("hdop"), F.min("nsats").alias("nsats"), _first(time, order, F.col("status") < 3).alias("_lost"), _first(time, order, F.col("nsats") < 6).alias("_few"))
    fix, hdop, sats = F.col("fix"), F.col("hdop"), F.col("nsats")
    poor, few = fix < 0.95, (sats >= 0) & (sats < 6)
    parts = [(poor & (1 - fix > 0.5), 0.7), (poor & (1 - fix <= 0.5), 0.5), (few, 0.4), (hdop > 5, 0.4), ((hdop > 2) & (hdop <= 5), 0.2)]
    items = [(poor, "gps_fix", F.round(fix, 4), 0.95), (few, "gps_nsats", sats, 6), (hdop > 5, "gps_hdop", F.round(hdop, 3), 5), ((hdop > 2) & (hdop <= 5), "gps_hdop", F.round(hdop, 3), 2)]
    onset = F.coalesce(F.when(poor, F.col("_lost")), F.when(few, F.col("_few")))
    return _verdict(rows, key, 5, 0.3, parts, [(poor & (1 - fix > 0.5), "gps_loss"), (F.lit(True), "gps_quality_poor")], items, onset)


def thrust_faults(samples: DataFrame, control: DataFrame, key: str, time: str, order: str, saturated: float = 1900.0, high: float = 1800.0) -> DataFrame:
    """thrust_loss from motor outputs together with control samples (throttle, alt_error) of the same log."""
    full = F.col("throttle") >= 0.95
    c = control.groupBy(key).agg(F.avg(full.cast("double")).alias("throttle"), F.max("alt_error").alias("alt_error"), _first(time, order, full).alias("_full"))
    rows = _outputs(samples, key, time, order, saturated, high, 10_000_000).join(c, key, "left")
    sat, every, throttle, error = (F.col(x) for x in ("saturated", "all_high", "throttle", "alt_error"))
    parts = [(sat > 0.25, 0.45), ((sat > 0.2) & (sat <= 0.25), 0.25), (every > 0.15, 0.25), (throttle > 0.2, 0.2), (error > 5, 0.1)]
    items = [(sat > 0.2, "saturated", F.round(sat, 4), 0.2), (every > 0.15, "all_high", F.round(every, 4), 0.15), (throttle > 0.2, "throttle_sat", F.round(throttle, 4), 0.2), (error > 5, "alt_error_max", F.round(error, 2), 5)]
    return _verdict(rows, key, 10, 0.4, parts, [(F.lit(True), "thrust_loss")], items, F.least(F.col("_onset"), F.when(throttle > 0.2, F.col("_full"))))
