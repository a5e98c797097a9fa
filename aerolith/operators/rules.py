"""More failure rules over feature rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .diagnosis import PRIORITIES, RULES, THRESHOLDS, _rule


def _hit(label: str, gate: Column, confidence: Column, critical: Column | float, warning: float = 0.3) -> Column:
    c = F.least(F.lit(1.0), confidence)
    grave = critical if isinstance(critical, Column) else c > critical
    severity = F.when(grave, "critical").when(c > warning, "warning").otherwise("info")
    return F.when(F.coalesce(gate, F.lit(False)) & (c > 0), F.struct(F.lit(label).alias("failure_type"), c.alias("confidence"), severity.alias("severity"), F.lit("rule").alias("method")))


def _sum(*parts: tuple[Column, float]) -> Column:
    return sum((F.when(cond, F.lit(add)).otherwise(0.0) for cond, add in parts), F.lit(0.0))


def _over(c: Column, *steps: tuple[float, float]) -> list[tuple[Column, float]]:
    """The part of the highest of descending bounds that c is over."""
    out, top = [], None
    for bound, add in steps:
        out.append(((c > bound) & (c <= top) if top is not None else c > bound, add))
        top = bound
    return out


def mechanical() -> Column:
    mean, top, tilt, ekf = F.col("spread_mean"), F.col("spread_max"), F.greatest("roll_max", "pitch_max"), F.greatest("ekf_vel_max", "ekf_pos_max")
    return _rule("mechanical_failure", (mean >= 400) | (top >= 800), [(mean >= 800, 0.55), ((mean >= 400) & (mean < 800), 0.45), (top >= 900, 0.40), (tilt > 40, 0.25), (ekf >= 0.9, 0.15)], 0.7, 0.55)


def imbalance(t: dict[str, float] = THRESHOLDS) -> Column:
    mean, top, std, roll = (F.col(x) for x in ("spread_mean", "spread_max", "spread_std", "roll_std"))
    gate, both = (top > t["spread"]) | (mean > t["spread_mean"]), (top > t["spread"]) & (mean > t["spread_mean"])
    tuning = (std < 25) & (roll > 10)
    parts = _sum((top >= 1.5 * t["spread"], 0.55), ((top < 1.5 * t["spread"]) & both, 0.30), ((top > t["spread"]) & (top < 1.5 * t["spread"]) & ~both, 0.15), (mean >= 1.5 * t["spread_mean"], 0.40), ((mean > t["spread_mean"]) & (mean < 1.5 * t["spread_mean"]), 0.25), ((std > 80) & (roll < 4), 0.1), (tuning, 0.25))
    hit = _hit("motor_imbalance", gate, F.greatest(F.lit(0.55), parts), 0.75)
    return F.when(hit.isNotNull(), F.struct(F.when(tuning, "pid_tuning_issue").otherwise("motor_imbalance").alias("failure_type"), hit["confidence"].alias("confidence"), hit["severity"].alias("severity"), hit["method"].alias("method")))


def thrust_loss() -> Column:
    sat, high, onset = F.col("saturated"), F.col("all_high"), F.col("thrust_onset")
    timed = onset > 0
    parts = _sum((timed & (F.col("thrust_descent") > 0), 0.55), *_over(sat, (0.25, 0.45), (0.10, 0.25)), (high > 0.15, 0.25), (F.col("throttle_sat") > 0.15, 0.20), (F.col("alt_error_max") > 5, 0.10), (F.col("volt_sag") > 0.15, 0.15), (F.col("curr_max") > 25, 0.15))
    c = F.greatest(F.lit(0.4), parts)
    return _hit("thrust_loss", (sat >= 0.10) | (high >= 0.05) | (onset >= 0), c, (c > 0.6) | timed)


def setup_error() -> Column:
    off, crash = F.col("early_divergence"), F.col("time_to_crash")
    return _rule("setup_error", off >= 20, [*_over(off, (45, 0.55), (20, 0.35)), ((crash > 0) & (crash < 5), 0.35), ((crash >= 5) & (crash < 10), 0.15)], 0.6, 0.4)


def compass(t: dict[str, float] = THRESHOLDS) -> Column:
    span, std = F.col("mag_range"), F.col("mag_std")
    quiet = ~((F.col("saturated") > 0.3) | (F.col("all_high") > 0.2))
    strong = _sum(*_over(span, (800, 0.65), (t["mag_range"], 0.35)), *_over(std, (100, 0.2), (t["mag_std"], 0.1)))
    low = (span > 80) & (std > 20)
    c = F.least(F.lit(0.65), F.when(strong > 0, strong).when(low, 0.55).otherwise(0.1))
    return _hit("compass_interference", ((span > t["mag_range"]) | (std > t["mag_std"]) | low) & quiet, c, F.lit(False), 0.5)


def ekf(warn: float = 1.05, fail: float = 1.5) -> Column:
    """Needs two failing variances, a lane switch, or one failing by half as much again."""
    own, switches, bad = [F.col(f"ekf_{x}_max") for x in ("vel", "pos", "mag")], F.col("ekf_switches"), F.col("ekf_bad")
    count = lambda *conds: sum((c.cast("int") for c in conds), F.lit(0))
    fails, warns, worst = count(*[v > fail for v in own]), count(*[(v > warn) & (v <= fail) for v in own]), F.greatest(*own)
    base = F.greatest(F.when(worst > fail * 1.5, 0.85).when(worst > fail, 0.65).otherwise(0.0), F.when(warns >= 2, 0.55).otherwise(0.0), F.when(fails >= 2, 0.90).otherwise(0.0))
    c = F.least(F.lit(1.0), base + _sum((switches > 0, 0.2), (bad > 0.1, 0.1)))
    gate = ((worst > warn) | (switches > 0) | (bad >= 0.1)) & ((fails >= 2) | (switches > 0) | (worst >= fail * 1.5))
    return _hit("ekf_failure", gate, c, c >= 0.8, 0.0)


def system_load(t: dict[str, float] = THRESHOLDS) -> Column:
    loops, load, error = F.col("long_loops") > 2 * t["long_loops"], F.col("load_mean") > t["load"] + 10, F.col("internal_error") > 0
    return _rule("mechanical_failure", error | (loops & load), [(loops, 0.4), (load, 0.45), (error, 0.7)], 0.85, 0.7)


def rc_failsafe() -> Column:
    radio, count, lost = F.col("radio_failsafe"), F.col("failsafes"), F.col("rc_lost")
    c = F.when(radio > 0, 0.9).when(count > 0, 0.65).otherwise(0.0) + _sum((lost > 0, 0.15))
    return _hit("rc_failsafe", (radio > 0) | (count > 0) | (lost > 0), c, F.lit(True))


def crash(labels: str | None = None) -> Column:
    """A crash with a failsafe, or several crashes. labels names an array of labels that the log's errors stand for:
    one with advice of its own is a hit, too, and the surer of both is it."""
    n = F.col("crashes")
    own = _hit("crash_unknown", (n >= 2) | ((n > 0) & (F.col("failsafes") > 0)), F.when(n >= 2, 0.85).otherwise(0.7), n >= 2)
    if labels is None:
        return own
    known = F.array_min(F.array_intersect(F.col(labels), F.array(*[F.lit(x) for x in PRIORITIES])))
    told = F.when(known.isNotNull(), F.struct(known.alias("failure_type"), F.lit(0.78).alias("confidence"), F.lit("critical").alias("severity"), F.lit("rule").alias("method")))
    return F.when(n >= 2, own).otherwise(F.coalesce(told, own))


def tuning() -> Column:
    roll, pitch = F.col("roll_std"), F.col("pitch_std")
    calm = ~((F.col("vibe_z_max") > 30) | (F.col("throttle_sat") > 0.2) | (F.col("saturated") > 0.2))
    parts = _sum(*_over(roll, (10, 0.4), (5, 0.25)), *_over(pitch, (10, 0.4), (5, 0.25)), (F.col("spread_std") < 30, 0.1), (F.col("alt_error_std") > 2, 0.15))
    return _hit("pid_tuning_issue", ((roll > 5) | (pitch > 5)) & calm, F.greatest(F.lit(0.45), parts), F.lit(False))


MORE = {"mechanical": mechanical, "imbalance": imbalance, "thrust_loss": thrust_loss, "setup_error": setup_error, "compass": compass, "ekf": ekf, "system_load": system_load, "rc_failsafe": rc_failsafe, "crash": crash, "tuning": tuning}
ALL = RULES | MORE


def with_thresholds(t: dict[str, float]) -> dict:
    """ALL, where the rules read these thresholds (of diagnosis.with_public)."""
    read = {"vibration_high", "gps_quality_poor", "power_instability", "imbalance", "compass", "system_load"}
    bound = {name: (lambda rule=ALL[name]: rule(t)) for name in read}
    return {name: bound.get(name, rule) for name, rule in ALL.items()} | {"ekf": lambda: ekf(0.7 * t["ekf_fail"], t["ekf_fail"])}


#: What the rules of MORE read.
FEATURES = ["spread_mean", "spread_max", "spread_std", "saturated", "all_high", "thrust_onset", "thrust_descent", "roll_max", "pitch_max", "roll_std", "pitch_std", "early_divergence", "time_to_crash", "mag_range", "mag_std", "ekf_vel_max", "ekf_pos_max", "ekf_mag_max", "ekf_switches", "ekf_bad", "long_loops", "load_mean", "internal_error", "radio_failsafe", "failsafes", "rc_lost", "crashes", "vibe_z_max", "throttle_sat", "alt_error_max", "alt_error_std", "volt_sag", "curr_max"]
