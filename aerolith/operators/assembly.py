"""All features of a log at once: one row per log from three readings of the messages.

What doesn't depend on neighbours (statistics, counts, first crossings, facts, parameters) is summed
up partially before anything moves. What follows the file's order (motor runs with the altitude, lane
switches, the first seconds, the drop of the voltage) needs the messages of a log together: eight
kinds of them are dealt once by log, and all windows and the aggregation use that. Boot texts are few.

Older firmware writes other families: the estimator is read from XKF4, else NKF4; the supply from BAT,
else CURR, whose numbers are hundredths where they are too large to be volts or amperes; the altitude
from GPS, else CTUN. The vehicle decides which families count. A log with neither duration nor three
families is not extracted.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.columns import channels, number

from . import logs as facts
from .features import FAMILIES, _either, _of, _onset, _present, _value

# The kinds of messages that count as families of a log.
KEPT = ["MAG", "VIBE", "BAT", "GPS", "RCOU", "XKF4", "NKF4", "IMU", "ERR", "EV", "MODE", "ATT", "CURR", "POWR", "CTUN", "FTN1", "PM", "MSG", "PARM", "RATE"]
# Numbers of the older supply family over these are hundredths.
CENTIVOLTS, CENTIAMPS = 100.0, 500.0
# Names of features outside this library, in their order, and the column that each is.
CATALOGUE = {
    "vibe_x_mean": "vibe_x_mean", "vibe_y_mean": "vibe_y_mean", "vibe_z_mean": "vibe_z_mean", "vibe_x_max": "vibe_x_max", "vibe_y_max": "vibe_y_max", "vibe_z_max": "vibe_z_max", "vibe_z_std": "vibe_z_std", "vibe_clip_total": "vibe_clip", "vibe_z_tanomaly": "vibe_onset",
    "mag_field_mean": "mag_mean", "mag_field_max": "mag_max", "mag_field_range": "mag_range", "mag_field_std": "mag_std", "mag_x_range": "mag_x_range", "mag_y_range": "mag_y_range", "mag_tanomaly": "mag_onset",
    "bat_volt_min": "volt_min", "bat_volt_max": "volt_max", "bat_volt_range": "volt_range", "bat_volt_std": "volt_std", "bat_curr_mean": "curr_mean", "bat_curr_max": "curr_max", "bat_curr_std": "curr_std", "bat_margin": "volt_margin", "bat_sag_ratio": "volt_sag", "volt_tanomaly": "volt_onset",
    "gps_hdop_mean": "gps_hdop", "gps_hdop_max": "gps_hdop_max", "gps_nsats_mean": "gps_nsats", "gps_nsats_min": "gps_nsats_min", "gps_fix_pct": "gps_fix", "gps_hdop_tanomaly": "gps_onset",
    "motor_spread_mean": "spread_mean", "motor_spread_max": "spread_max", "motor_spread_std": "spread_std", "motor_output_mean": "output_mean", "motor_output_std": "output_std", "motor_max_output": "output_max", "motor_hover_ratio": "motor_hover_ratio", "motor_spread_tanomaly": "spread_onset", "motor_saturation_pct": "saturated", "motor_all_high_pct": "all_high",
    "att_roll_std": "roll_std", "att_pitch_std": "pitch_std", "att_roll_max": "roll_max", "att_pitch_max": "pitch_max", "att_desroll_err": "roll_error", "att_early_divergence": "early_divergence", "att_time_to_crash_sec": "time_to_crash",
    "ekf_vel_var_mean": "ekf_vel_mean", "ekf_vel_var_max": "ekf_vel_max", "ekf_pos_var_mean": "ekf_pos_mean", "ekf_pos_var_max": "ekf_pos_max", "ekf_hgt_var_mean": "ekf_hgt_mean", "ekf_hgt_var_max": "ekf_hgt_max", "ekf_compass_var_mean": "ekf_mag_mean", "ekf_compass_var_max": "ekf_mag_max", "ekf_flags_error_pct": "ekf_bad", "ekf_lane_switch_count": "ekf_switches", "ekf_pos_var_tanomaly": "ekf_onset",
    "imu_acc_x_std": "acc_x_std", "imu_acc_y_std": "acc_y_std", "imu_acc_z_std": "acc_z_std", "imu_gyr_x_std": "gyr_x_std", "imu_gyr_y_std": "gyr_y_std", "imu_gyr_z_std": "gyr_z_std",
    "ctrl_thr_out_mean": "throttle_mean", "ctrl_thr_hover_ratio": "hover_ratio", "ctrl_alt_error_max": "alt_error_max", "ctrl_alt_error_std": "alt_error_std", "ctrl_climb_rate_std": "climb_std", "ctrl_thr_saturated_pct": "throttle_sat",
    "sys_long_loops": "long_loops", "sys_max_loop_time": "loop_max", "sys_cpu_load_mean": "load_mean", "sys_internal_errors": "internal_error", "sys_vcc_min": "vcc_min", "sys_vcc_range": "vcc_range", "sys_vservo_min": "vservo_min",
    "evt_error_count": "errors", "evt_failsafe_count": "failsafes", "evt_mode_change_count": "mode_changes", "evt_unexpected_mode_changes": "unexpected_modes", "evt_crash_detected": "crashes", "evt_gps_lost_count": "gps_lost", "evt_rc_lost_count": "rc_lost", "evt_radio_failsafe_count": "radio_failsafe",
    "fft_dominant_freq_x": "peak_mean", "fft_dominant_freq_y": "peak_mean", "fft_dominant_freq_z": "peak_mean", "fft_peak_power_x": "noise_x", "fft_peak_power_y": "noise_y", "fft_peak_power_z": "noise_z", "fft_noise_floor": "noise_floor",
}
#: Columns that come from the motors' messages; LEFT_OUT names them with the families.
MOTORS = ["spread_mean", "spread_max", "spread_std", "output_mean", "output_std", "output_max", "spread_onset", "saturated", "all_high", "thrust_onset", "thrust_descent", "motor_hover_ratio"]
_SEQUENCES = ["RCOU", "ATT", "XKF4", "NKF4", "BAT", "CURR", "GPS", "CTUN"]
_SKIP, _EARLY, _LASTING = 10_000_000, 5_000_000, 3_000_000


def _parameter(name: str) -> Column:
    """The last value of a parameter."""
    own = (F.col("msg_type") == "PARM") & (F.try_element_at("fields", F.lit("Name")) == name)
    return F.max_by(_value("Value"), F.when(own, F.col("seq")))


@lru_cache(maxsize=1)
def _plain(application: str) -> list[Column]:
    """The aggregates of plain, built once in an application: they are a few thousand calls to the JVM."""
    both = ("BAT", "CURR")
    out = {n: c for f in FAMILIES.values() for n, c in f.aggregates().items()}
    out["mag_max"] = F.max(_of("MAG", F.sqrt(_value("MagX") ** 2 + _value("MagY") ** 2 + _value("MagZ") ** 2)))
    out["ekf_onset"] = _either(("XKF4", "NKF4"), lambda m: _onset(m, _value("SP") > 1.0))
    out["_older"] = ~_present(both[0]) & _present(both[1])
    kinds = F.expr("CASE msg_type " + " ".join(f"WHEN '{k}' THEN {1 << i}" for i, k in enumerate(KEPT)) + " END")
    out |= {"n": F.count(F.lit(1)), "families": F.coalesce(F.bit_count(F.bit_or(kinds)), F.lit(0)), "_first": F.min_by("time_us", "seq"), "_last": F.max_by("time_us", "seq")}
    out |= {f"_has_{name}": F.max(F.coalesce((F.col("msg_type") == "PARM") & (F.try_element_at("fields", F.lit("Name")) == name), F.lit(False))) for name, _ in facts.PARAMETERS}
    out |= {"_low": _parameter("BATT_LOW_VOLT"), "_hover": _parameter("MOT_THST_HOVER")}
    return [c.alias(n) for n, c in out.items()]


def plain(messages: DataFrame) -> DataFrame:
    """One row per log of all that needs no neighbours; the buffers are numbers only, so it is hashed, not sorted."""
    return messages.groupBy("log_id").agg(*_plain(messages.sparkSession.sparkContext.applicationId))


def sequences(messages: DataFrame) -> DataFrame:
    """One row per log of what follows the file's order; the messages are dealt once."""
    kind, time = F.col("msg_type"), F.col("time_us")
    own = F.when(kind == "RCOU", channels(F.col("fields")))
    real = lambda *names: F.coalesce(*[number(F.try_element_at("fields", F.lit(n)), None) for n in names])
    rows = messages.where(kind.isin(_SEQUENCES)).select(
        "log_id", "seq", "time_us", "msg_type", F.array_max(own).alias("most"), F.array_min(own).alias("least"), F.coalesce(F.size(own), F.lit(0)).alias("width"),
        F.aggregate(own, F.lit(0.0), lambda a, x: a + x).alias("total"), F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x).alias("squares"),
        F.when(kind == "ATT", F.abs(_value("Roll") - _value("DesRoll"))).alias("off"), F.when(kind == "ATT", F.greatest(F.abs(_value("Roll")), F.abs(_value("Pitch")))).alias("tilt"),
        F.when(kind.isin("XKF4", "NKF4"), _value("PI")).alias("lane"), F.when(kind.isin("BAT", "CURR"), _value("Volt")).alias("volt"),
        F.when(kind == "GPS", real("Alt")).alias("height"), F.when(kind == "CTUN", real("Alt", "DAlt")).alias("other"),
    ).where(~kind.isin("GPS", "CTUN") | F.col("height").isNotNull() | F.col("other").isNotNull())
    whole = Window.partitionBy("log_id")
    file = whole.orderBy("seq")
    so_far, before = file.rowsBetween(Window.unboundedPreceding, Window.currentRow), file.rowsBetween(Window.unboundedPreceding, -1)
    rising, falling = (whole.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("time_us"), F.desc("time_us")))
    valid = F.coalesce(F.col("width") > 0, F.lit(False)) & (kind == "RCOU")
    full = valid & (F.col("width") >= 4) & (F.col("least") >= 1900)
    of = lambda k, c: F.when(kind == k, c)
    # heights: the first at or after each time, and the last until it
    for name, column in (("g", "height"), ("c", "other")):
        point = F.when(F.col(column).isNotNull(), F.struct(time.alias("t"), F.col("seq").alias("o"), F.col(column).alias("a")))
        rows = rows.withColumn(f"_next_{name}", F.min(point).over(falling)).withColumn(f"_last_{name}", F.max(point).over(rising))
    rows = rows.withColumns({f"_{f}_{k}": fn(of(k, F.col("volt"))).over(whole) for k in ("BAT", "CURR") for f, fn in (("mean", F.avg), ("std", F.stddev_pop))})
    rows = rows.withColumns({"_motor": F.first(of("RCOU", time), True).over(so_far), "_tilt": F.first(of("ATT", time), True).over(so_far), "_full": F.last(F.when(valid, full), True).over(before)} | {f"_lane_{k}": F.last(of(k, F.col("lane")), True).over(before) for k in ("XKF4", "NKF4")})
    start = F.when(full & ~F.coalesce("_full", F.lit(False)), F.struct(time.alias("t"), "_next_g", "_next_c"))
    rows = rows.withColumn("_run", F.last(start, True).over(so_far))
    began = F.col("_run.t")

    def fell(name: str) -> Column:
        first, last = F.col(f"_run._next_{name}"), F.col(f"_last_{name}")
        return F.min_by(began, F.when(full & (time - began >= _LASTING) & (first["t"] <= time) & (last["t"] >= began) & (last["a"] < first["a"] - 1.0), F.col("seq")))

    late = valid & (time >= F.col("_motor") + _SKIP)
    spread = F.when(late, F.col("most") - F.col("least"))
    share = lambda holds: F.avg(F.when(valid, holds.cast("double")))
    drop = {k: F.min_by(time, F.when((kind == k) & (F.col("volt") < F.col(f"_mean_{k}") - 2 * F.col(f"_std_{k}")), F.col("seq"))) for k in ("BAT", "CURR")}
    switches = {k: F.count_if((kind == k) & (F.col("lane") != F.col(f"_lane_{k}"))).cast("double") for k in ("XKF4", "NKF4")}
    since = F.min_by((time - F.col("_tilt")) / 1e6, F.when(F.col("tilt") > 60, F.col("seq")))
    out = rows.groupBy("log_id").agg(
        F.avg(spread).alias("spread_mean"), F.max(spread).alias("spread_max"), F.stddev_pop(spread).alias("spread_std"), F.sum("total").alias("_t"), F.sum("squares").alias("_q"), F.sum("width").alias("_w"), F.max("most").alias("output_max"),
        F.when(_present("RCOU"), F.when(F.count(spread) > 0, F.coalesce(F.min_by(time, F.when(spread > 400, F.col("seq"))).cast("double"), F.lit(-1.0))).otherwise(-1.0)).alias("spread_onset"),
        share(F.col("most") > 1900).alias("saturated"), share((F.col("width") >= 4) & (F.col("least") > 1800)).alias("all_high"),
        F.when(F.count("height") > 0, fell("g")).otherwise(fell("c")).cast("double").alias("_thrust"),
        F.max(F.when(time <= F.col("_tilt") + _EARLY, F.col("off"))).alias("early_divergence"), F.when(_present("ATT"), F.coalesce(since, F.lit(-1.0))).alias("time_to_crash"),
        _either(("XKF4", "NKF4"), lambda k: switches[k]).alias("ekf_switches"), _either(("BAT", "CURR"), lambda k: F.coalesce(drop[k].cast("double"), F.lit(-1.0))).alias("volt_onset"))
    mean = F.try_divide(F.col("_t"), F.col("_w"))
    out = out.withColumns({"output_mean": mean, "output_std": F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_q"), F.col("_w")) - mean * mean)), "thrust_onset": F.coalesce("_thrust", F.lit(-1.0)), "thrust_descent": F.when(F.col("_thrust").isNotNull(), 1.0)})
    return out.drop("_t", "_q", "_w", "_thrust")


def boot(messages: DataFrame) -> DataFrame:
    """Vehicle and version by the last boot text that names one."""
    text = F.coalesce(F.try_element_at("fields", F.lit("Message")), F.lit(""))
    kind = F.coalesce(*[F.when(F.lower(text).contains(word), name) for word, name in facts.BOOT_WORDS.items()])
    words = F.split(text, " +")
    own = messages.where("msg_type = 'MSG'").select("log_id", "seq", kind.alias("vehicle"), F.when(F.lower(words[0]).rlike("|".join(facts.BOOT_WORDS)), F.try_element_at(words, F.lit(2))).alias("version"))
    # no filter: pushed below, it would make each text's map of fields anew for every word
    return own.groupBy("log_id").agg(F.max_by(F.struct("vehicle", "version"), F.when(F.col("vehicle").isNotNull(), F.col("seq"))).alias("_boot"))


@lru_cache
def _names(family: str) -> list[str]:
    return list(FAMILIES[family].aggregates())


def assembled(messages: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """All features of each log, and its vehicle, version, n, families, duration (s) and extracted.

    messages: log_id, seq, time_us, msg_type, fields. Onsets are in microseconds, -1 if none, 0 where the family is
    missing. logs (log_id), if given, are the logs that get a row.
    """
    messages = facts.timed(messages)
    rows = plain(messages).join(sequences(messages), "log_id", "left").join(boot(messages), "log_id", "left")
    if logs is not None:
        rows = logs.select("log_id").join(rows, "log_id", "left")
    by_parameter = F.coalesce(*[F.when(F.col(f"_has_{name}"), kind) for name, kind in facts.PARAMETERS], F.lit("Unknown"))
    duration = F.greatest(F.coalesce((F.col("_last") - F.col("_first")) / 1e6, F.lit(0.0)), F.lit(0.0))
    scaled = {}
    for column, limit in (("volt", CENTIVOLTS), ("curr", CENTIAMPS)):
        by = F.when(F.coalesce("_older", F.lit(False)) & (F.col(f"{column}_max") > limit), 100.0).otherwise(1.0)
        scaled |= {c: F.col(c) / by for c in rows.columns if c in (f"{column}_{k}" for k in ("mean", "max", "min", "std", "range"))}
    rows = rows.withColumns({"vehicle": F.coalesce("_boot.vehicle", by_parameter), "version": F.col("_boot.version"), "duration": duration, "n": F.coalesce("n", F.lit(0)), "families": F.coalesce("families", F.lit(0))}).withColumns(scaled)
    rows = rows.withColumns({
        "extracted": ~((F.col("duration") == 0) & (F.col("families") < 3)), "volt_margin": F.when(F.col("volt_min") > 0, F.col("volt_min") - F.col("_low")), "noise_floor": F.lit(0.0),
        "motor_hover_ratio": F.when(F.col("_hover") > 0, F.col("output_mean") / F.col("_hover")), "thrust_onset": F.coalesce("thrust_onset", F.lit(-1.0))})
    names = {f: _names(f) for left in facts.LEFT_OUT.values() for f in left if f != "motors"} | {"motors": MOTORS}
    rows = facts.routed_features(rows.drop("_boot", "_older", "_first", "_last", "_low", "_hover", *[f"_has_{p}" for p, _ in facts.PARAMETERS]), "vehicle", names)
    return rows.fillna(0.0)


def matrix(features: DataFrame) -> DataFrame:
    """log_id and the features under the names and in the order of the catalogue."""
    return features.select("log_id", *[F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(n) for n, c in CATALOGUE.items()])


# Parameters that should not stay at these values in a vehicle that oscillates.
UNTUNED = {"ATC_RAT_RLL_P": 0.135, "ATC_RAT_PIT_P": 0.135}


def parameter_warnings(features: DataFrame, parameters: DataFrame) -> DataFrame:
    """log_id, name, value: parameters (log_id, name, value) of a copter that oscillates that are still as delivered."""
    shakes = (F.col("vibe_z_max") >= 30) | (F.col("roll_std") >= 8) | (F.col("pitch_std") >= 8)
    logs = features.where((F.lower("vehicle") == "copter") & shakes).select("log_id")
    given = F.create_map(*[F.lit(x) for pair in UNTUNED.items() for x in pair])[F.col("name")]
    return parameters.where(F.col("name").isin(list(UNTUNED)) & (F.abs(F.col("value") - given) <= 1e-6)).join(logs, "log_id").select("log_id", "name", "value")
