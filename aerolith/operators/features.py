"""Feature families of a log's messages, all from one aggregation of the long table.

A family names the messages that it reads and its aggregates; the filter at the scan follows from the
families asked for. Fields are text in a map; what is no number counts as 0, a family that a log lacks
gives 0 everywhere, also for onsets.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.columns import any_bit_unset, magnitude, number


class Family(NamedTuple):
    messages: tuple[str, ...]
    aggregates: Callable[[], dict[str, Column]]


def _value(field: str) -> Column:
    # one expression, as columns.number has it: building hundreds of columns call by call takes seconds
    return F.expr(f"coalesce(nanvl(try_cast(try_element_at(fields, '{field}') AS double), CAST(NULL AS double)), 0D)")


def _of(message: str, value: Column) -> Column:
    return F.when(F.expr(f"msg_type = '{message}'"), value)


def _present(message: str) -> Column:
    return F.expr(f"count_if(msg_type = '{message}') > 0")


def _onset(message: str, holds: Column) -> Column:
    """Time of the first row, in file order, that holds; -1 if none."""
    first = F.min_by("time_us", F.when((F.col("msg_type") == message) & holds, F.col("seq"))).cast("double")
    return F.when(_present(message), F.coalesce(first, F.lit(-1.0)))


def _span(message: str, field: str) -> Column:
    return F.max(_of(message, _value(field))) - F.min(_of(message, _value(field)))


def _either(messages: tuple[str, ...], fn: Callable[[str], Column]) -> Column:
    """The aggregate over the first of these messages that the log has."""
    out = F.when(_present(messages[0]), fn(messages[0]))
    for m in messages[1:]:
        out = out.when(_present(m), fn(m))
    return out


def _vibration() -> dict[str, Column]:
    out = {f"vibe_{a}_{n}": fn(_of("VIBE", _value(f"Vibe{a.upper()}"))) for a in "xyz" for n, fn in (("mean", F.avg), ("max", F.max))}
    clips = sum((_value(f"Clip{i}") for i in range(3)), F.lit(0.0))
    return out | {"vibe_z_std": F.stddev_pop(_of("VIBE", _value("VibeZ"))), "vibe_clip": F.sum(_of("VIBE", clips)), "vibe_onset": _onset("VIBE", _value("VibeZ") > 30)}


def _compass() -> dict[str, Column]:
    field = magnitude(_value("MagX"), _value("MagY"), _value("MagZ"))
    own = _of("MAG", field)
    return {"mag_mean": F.avg(own), "mag_range": F.max(own) - F.min(own), "mag_std": F.stddev_pop(own), "mag_x_range": _span("MAG", "MagX"), "mag_y_range": _span("MAG", "MagY"), "mag_onset": _onset("MAG", field > 200)}


def _power() -> dict[str, Column]:
    both = ("BAT", "CURR")
    own = {f"{n}_{k}": _either(both, lambda m, f=f, fn=fn: fn(_of(m, _value(f)))) for n, f in (("volt", "Volt"), ("curr", "Curr")) for k, fn in (("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_pop))}
    span = _either(both, lambda m: _span(m, "Volt"))
    return own | {"volt_range": span, "volt_sag": F.coalesce(F.try_divide(span, own["volt_max"]), F.lit(0.0))}


def _gps() -> dict[str, Column]:
    out = {f"gps_{n}": fn(_of("GPS", _value(f))) for n, f, fn in (("hdop", "HDop", F.avg), ("hdop_max", "HDop", F.max), ("nsats", "NSats", F.avg), ("nsats_min", "NSats", F.min))}
    return out | {"gps_fix": F.avg(_of("GPS", (_value("Status") >= 3).cast("double"))), "gps_onset": _onset("GPS", _value("HDop") > 2)}


def _attitude() -> dict[str, Column]:
    out = {f"{a.lower()}_{n}": fn(_of("ATT", F.abs(_value(a)))) for a in ("Roll", "Pitch") for n, fn in (("std", F.stddev_pop), ("max", F.max))}
    return out | {"roll_error": F.avg(_of("ATT", F.abs(_value("Roll") - _value("DesRoll"))))}


def _ekf() -> dict[str, Column]:
    both = ("XKF4", "NKF4")
    out = {f"ekf_{n}_{k}": _either(both, lambda m, f=f, fn=fn: fn(_of(m, _value(f)))) for n, f in (("vel", "SV"), ("pos", "SP"), ("hgt", "SH"), ("mag", "SM")) for k, fn in (("mean", F.avg), ("max", F.max))}
    bad = any_bit_unset(_value("SS").cast("int"), 31).cast("double")
    return out | {"ekf_bad": _either(both, lambda m: F.avg(_of(m, bad)))}


def _inertial() -> dict[str, Column]:
    return {f"{n}_{a}_std": F.stddev_pop(_of("IMU", _value(f"{f}{a.upper()}"))) for n, f in (("acc", "Acc"), ("gyr", "Gyr")) for a in "xyz"}


def _control() -> dict[str, Column]:
    throttle, hover = _value("ThO"), F.try_element_at("fields", F.lit("ThH"))
    error = F.abs(_value("Alt") - _value("DAlt"))
    over_hover = F.coalesce(F.try_divide(F.avg(_of("CTUN", throttle)), F.avg(_of("CTUN", F.when(hover.isNotNull(), number(hover))))), F.lit(0.0))
    return {"throttle_mean": F.avg(_of("CTUN", throttle)), "hover_ratio": over_hover, "alt_error_max": F.max(_of("CTUN", error)), "alt_error_std": F.stddev_pop(_of("CTUN", error)), "climb_std": F.stddev_pop(_of("CTUN", _value("CRt"))), "throttle_sat": F.avg(_of("CTUN", (throttle > 0.95).cast("double")))}


def _system() -> dict[str, Column]:
    out = {"long_loops": F.sum(_of("PM", _value("NLon"))), "loop_max": F.max(_of("PM", _value("MaxT"))), "load_mean": F.avg(_of("PM", _value("Load"))), "internal_error": F.max(_of("PM", (_value("IErr") > 0).cast("double"))), "vcc_min": F.min(_of("POWR", _value("Vcc"))), "vcc_range": _span("POWR", "Vcc"), "vservo_min": F.min(_of("POWR", _value("VServo")))}
    return {n: F.when(_present("PM"), c) for n, c in out.items()}


def _spectrum() -> dict[str, Column]:
    return {n: F.avg(_of("FTN1", _value(f))) for n, f in (("peak_mean", "PkAvg"), ("noise_x", "SnX"), ("noise_y", "SnY"), ("noise_z", "SnZ"))}


def _incidents() -> dict[str, Column]:
    """Errors, failsafes by subsystem, changes of mode; the landing modes are 6 and 9."""
    system = F.when(F.col("msg_type") == "ERR", _value("Subsys").cast("int"))
    mode = _of("MODE", number(F.try_element_at("fields", F.lit("ModeNum")), -1.0).cast("int"))
    mode = F.when(mode >= 0, mode).otherwise(_of("MODE", _value("Mode").cast("int")))
    reason = number(F.try_element_at("fields", F.lit("Reason")), -1.0).cast("int")
    lands = mode.isin(6, 9)
    n = lambda holds: F.count_if(holds).cast("double")
    return {"errors": n(F.col("msg_type") == "ERR"), "failsafes": n(system.isin(FAILSAFES)), "mode_changes": n(F.col("msg_type") == "MODE"), "unexpected_modes": n(lands & (reason != 0)), "crashes": F.max((F.coalesce(system == 12, F.lit(False))).cast("double")), "gps_lost": n(_of("EV", _value("Id")) == 19), "rc_lost": n(lands & (reason == 2)), "radio_failsafe": n(system == 5)}


# Subsystem codes of failsafes, and the labels that the code of an error stands for.
FAILSAFES = [5, 6, 8, 9, 17, 20, 23, 26, 27, 29, 31]
ERROR_LABELS = {3: "compass_interference", 6: "power_instability", 11: "gps_quality_poor", 12: "crash_detected", 16: "ekf_failure", 17: "ekf_failure", 24: "ekf_failure", 25: "motor_imbalance", 29: "vibration_high"}

FAMILIES = {
    "vibration": Family(("VIBE",), _vibration), "compass": Family(("MAG",), _compass), "power": Family(("BAT", "CURR"), _power), "gps": Family(("GPS",), _gps), "attitude": Family(("ATT",), _attitude),
    "ekf": Family(("XKF4", "NKF4"), _ekf), "inertial": Family(("IMU",), _inertial), "control": Family(("CTUN",), _control), "system": Family(("PM", "POWR"), _system), "spectrum": Family(("FTN1",), _spectrum),
    "incidents": Family(("ERR", "EV", "MODE"), _incidents),
}


def extracted(messages: DataFrame, logs: DataFrame | None = None, families: list[str] | None = None) -> DataFrame:
    """One row of features per log; logs (log_id) without such messages, if given, get zeros."""
    own = [FAMILIES[f] for f in families or FAMILIES]
    rows = messages.where(F.col("msg_type").isin(sorted({m for f in own for m in f.messages})))
    out = rows.groupBy("log_id").agg(*[c.alias(n) for f in own for n, c in f.aggregates().items()])
    return (logs.select("log_id").join(out, "log_id", "left") if logs is not None else out).fillna(0.0)


def error_labels(messages: DataFrame) -> DataFrame:
    """Labels that a log's errors stand for: log_id, label, n, first_us (time of the first in file order). Of GPS errors only those of code 2."""
    names = F.create_map(*[F.lit(x) for pair in ERROR_LABELS.items() for x in pair])
    rows = messages.where("msg_type = 'ERR'").select("log_id", "seq", "time_us", F.try_element_at(names, _value("Subsys").cast("int")).alias("label"), (_value("Subsys") != 11) | (_value("ECode") == 2))
    return rows.toDF("log_id", "seq", "time_us", "label", "_counts").where("label is not null and _counts").groupBy("log_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min_by("time_us", "seq").alias("first_us"))


def error_label_lists(messages: DataFrame) -> DataFrame:
    """log_id and `labels`: those of error_labels, each once, in the order in which they first occur in the file."""
    names = F.create_map(*[F.lit(x) for pair in ERROR_LABELS.items() for x in pair])
    label = F.try_element_at(names, _value("Subsys").cast("int"))
    rows = messages.where("msg_type = 'ERR'").select("log_id", "seq", label.alias("label"), ((_value("Subsys") != 11) | (_value("ECode") == 2)).alias("_counts"))
    first = rows.where("label is not null and _counts").groupBy("log_id", "label").agg(F.min("seq").alias("_at"))
    return first.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "label"))), lambda x: x["label"]).alias("labels"))


def derived(features: DataFrame) -> DataFrame:
    """features with seven ratios; where a divisor is 0, or a feature is absent, the ratio is 0."""
    own = set(features.columns)
    f = lambda name: F.col(name) if name in own else F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    made = {"thrust_weight": ratio(f("output_mean"), f("hover_ratio")), "resistance": ratio(f("volt_range"), f("curr_max")), "tracking": ratio(f("roll_error_max"), f("roll_std")), "ekf_health": f("ekf_vel_max") + f("ekf_pos_max") + f("ekf_hgt_max"), "motor_symmetry": ratio(f("spread_std"), f("output_mean")), "vibe_per_clip": ratio(f("vibe_z_max"), f("vibe_clip") + 1), "gps_reliability": ratio((1 - f("gps_flag_errors")) * f("gps_nsats_min"), f("gps_hdop"))}
    return features.withColumns(made)
