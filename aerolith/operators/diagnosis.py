"""Rules over feature rows, fusion with a classifier, and the decision per log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the rules.
THRESHOLDS = {"vibe_warn": 30.0, "vibe_fail": 60.0, "clip_many": 100.0, "hdop": 2.0, "nsats": 6.0, "fix": 0.95, "volt_range": 2.0, "volt_min": 10.0, "vcc": 4.5, "margin": 0.5, "sag_warn": 0.05, "sag_fail": 0.08, "mag_range": 600.0, "mag_std": 50.0, "spread": 400.0, "spread_mean": 200.0, "ekf_fail": 1.5, "long_loops": 50.0, "load": 80.0}


# Names of thresholds in a table of them, and the name here.
PUBLIC = {"vibe_max_warn": "vibe_warn", "vibe_max_fail": "vibe_fail", "gps_hdop_limit": "hdop", "gps_nsats_min": "nsats", "bat_volt_range_limit": "volt_range", "volt_min_absolute": "volt_min", "powr_vcc_min": "vcc", "mag_range_limit": "mag_range", "mag_std_limit": "mag_std", "motor_spread_limit": "spread", "spread_mean_limit": "spread_mean", "ekf_variance_fail": "ekf_fail", "long_loops_limit": "long_loops", "cpu_load_limit": "load"}


def with_public(given: dict[str, float]) -> dict[str, float]:
    """THRESHOLDS, replaced by those given under their public names; other names are ignored."""
    return THRESHOLDS | {PUBLIC[n]: v for n, v in given.items() if n in PUBLIC}


def _rule(label: str, gate: Column, parts: list[tuple[Column, float]], critical: float, floor: float = 0.0) -> Column:
    """A rule's result: gate, then added confidence, at most 1; null under the gate or the floor."""
    total = sum((F.when(cond, F.lit(add)).otherwise(0.0) for cond, add in parts), F.lit(0.0))
    confidence = F.least(F.lit(1.0), F.greatest(total, F.lit(floor)))
    severity = F.when(confidence > critical, "critical").when(confidence > 0.3, "warning").otherwise("info")
    return F.when(F.coalesce(gate, F.lit(False)) & (confidence > 0), F.struct(F.lit(label).alias("failure_type"), confidence.alias("confidence"), severity.alias("severity"), F.lit("rule").alias("method")))


def vibration(t: dict[str, float] = THRESHOLDS) -> Column:
    axes = [F.col(f"vibe_{a}_max") for a in "xyz"]
    clip = F.col("vibe_clip")
    parts = [p for a in axes for p in ((a > t["vibe_fail"], 0.2), ((a > t["vibe_warn"]) & (a <= t["vibe_fail"]), 0.1))]
    return _rule("vibration_high", (F.greatest(*axes) > t["vibe_warn"]) | (clip > 0), [*parts, (clip > 0, 0.3), (clip > t["clip_many"], 0.2)], 0.7)


def gps(t: dict[str, float] = THRESHOLDS) -> Column:
    """Silent only in a log without any satellite, dilution or fix; it is the fewest satellites that count."""
    hdop, sats, least, fix, lost = (F.col(f"gps_{x}") for x in ("hdop", "nsats", "nsats_min", "fix", "lost"))
    bad = [(hdop > t["hdop"], 0.4), ((least > 0) & (least < t["nsats"]), 0.5), (fix < t["fix"], 0.6), (lost > 0, 0.8)]
    return _rule("gps_quality_poor", (hdop != 0) | (sats != 0) | (fix != 0), bad, 0.7)


def power(t: dict[str, float] = THRESHOLDS) -> Column:
    """A brownout is critical, other trouble a warning, however sure."""
    span, low, vcc, margin, sag = (F.col(x) for x in ("volt_range", "volt_min", "vcc_min", "volt_margin", "volt_sag"))
    noisy = (F.col("volt_std") > 0.8) & (F.col("curr_max") > 20)
    brown = (vcc > 0) & (vcc < t["vcc"])
    parts = [(span > t["volt_range"], 0.5), (brown, 0.8), ((margin > 0) & (margin < t["margin"]), 0.4), ((low > 0) & (low < t["volt_min"]), 0.3), (sag > t["sag_fail"], 0.35), ((sag > t["sag_warn"]) & (sag <= t["sag_fail"]), 0.2), (noisy, 0.15)]
    hit = _rule("power_instability", F.lit(True), parts, 2.0)
    kind, severity = F.when(brown, "brownout").otherwise("power_instability"), F.when(brown, "critical").otherwise("warning")
    return F.when(hit.isNotNull(), F.struct(kind.alias("failure_type"), hit["confidence"].alias("confidence"), severity.alias("severity"), F.lit("rule").alias("method")))


RULES = {"vibration_high": vibration, "gps_quality_poor": gps, "power_instability": power}


# Which label comes first of equally sure ones.
PRIORITIES = {"mechanical_failure": 6, "thrust_loss": 6, "vibration_high": 5, "compass_interference": 5, "motor_imbalance": 5, "gps_quality_poor": 4, "power_instability": 4, "brownout": 4, "ekf_failure": 4, "pid_tuning_issue": 3, "rc_failsafe": 2, "crash_unknown": 1}
# The rules that two kinds of vehicle have; the others have all.
ROUTES = {"rover": ["compass", "power_instability", "gps_quality_poor", "ekf", "system_load", "rc_failsafe", "crash"], "sub": ["compass", "power_instability", "ekf", "system_load", "rc_failsafe", "crash"]}
# The part of the vehicle that a failure points to.
SUBSYSTEMS = {"vibration_high": "Vibration/Mounts", "compass_interference": "Magnetics/EMI", "power_instability": "Power/Battery", "brownout": "Power/Battery", "gps_quality_poor": "GPS/Antenna", "motor_imbalance": "Propulsion/Motors", "thrust_loss": "Propulsion/Thrust", "pid_tuning_issue": "Control/PID", "mechanical_failure": "Hardware/Frame", "ekf_failure": "Navigation/EKF", "rc_failsafe": "Radio/Receiver"}


def rule_array(rules: dict | None = None, vehicle: str | None = None) -> Column:
    """The rules that fire, as an array of structs. vehicle names a column of kinds by which rules are left out."""
    def routed(name: str, hit: Column) -> Column:
        without = [kind for kind, names in ROUTES.items() if name not in names]
        return hit if vehicle is None or not without else F.when(~F.coalesce(F.lower(vehicle), F.lit("")).isin(without), hit)

    return F.filter(F.array(*[routed(name, rule()) for name, rule in (rules or RULES).items()]), lambda x: x.isNotNull())


def rule_hits(features: DataFrame, key: str, rules: dict | None = None, vehicle: str | None = None) -> DataFrame:
    """One row per log and rule that fires; nulls in features count as 0."""
    return features.fillna(0.0).select(key, F.explode(rule_array(rules, vehicle)).alias("h")).select(key, "h.*")


def subsystems(hits: DataFrame, key: str) -> DataFrame:
    """Per log and subsystem the greatest confidence, ranked; types without a subsystem are Unknown."""
    names = F.create_map(*[F.lit(x) for pair in SUBSYSTEMS.items() for x in pair])
    own = hits.where("confidence > 0").groupBy(key, F.coalesce(F.try_element_at(names, F.col("failure_type")), F.lit("Unknown")).alias("subsystem")).agg(F.max("confidence").alias("likelihood"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("likelihood"), "subsystem")))


def in_context(hits: DataFrame, features: DataFrame, key: str, probabilities: DataFrame | None = None) -> DataFrame:
    """Classifier hits where vibration and compass are told apart by the features vibe_[xyz]_max, vibe_clip, mag_range, mag_std.

    In a calm log with a wide field, vibration goes; without a compass hit one takes its place, as sure as the
    probabilities (key, failure_type, confidence), if given, say, 0.35 at least. In a log that clips or shakes
    strongly, compass goes if vibration is there too. Other hits stay.
    """
    peak = F.greatest(*[F.coalesce(f"vibe_{a}_max", F.lit(0.0)) for a in "xyz"])
    clip, wide, std = (F.coalesce(c, F.lit(0.0)) for c in ("vibe_clip", "mag_range", "mag_std"))
    flags = features.select(key, ((clip <= 0) & (peak < 65) & (wide > 320) & (std > 35)).alias("_calm"), ((clip > 100) | (peak > 80)).alias("_rough"))
    has = hits.groupBy(key).agg(*[F.max(F.when(F.col("failure_type") == t, F.col("confidence"))).alias(c) for t, c in (("vibration_high", "_v"), ("compass_interference", "_c"))])
    if probabilities is None:
        probabilities = hits
    sure = probabilities.where("failure_type = 'compass_interference'").groupBy(key).agg(F.max("confidence").alias("_p"))
    rows = hits.join(has.join(flags, key, "left").join(sure, key, "left"), key)
    calm, rough, both = F.coalesce("_calm", F.lit(False)), F.coalesce("_rough", F.lit(False)), F.col("_v").isNotNull() & F.col("_c").isNotNull()
    of = lambda t: F.col("failure_type") == t
    swap = of("vibration_high") & calm & F.col("_c").isNull()
    gone = (of("vibration_high") & calm & both & ~rough) | (of("compass_interference") & both & rough)
    out = rows.where(~gone).withColumn("_swap", swap)
    return out.withColumn("failure_type", F.when(F.col("_swap"), "compass_interference").otherwise(F.col("failure_type"))).withColumn("confidence", F.when(F.col("_swap"), F.greatest(F.lit(0.35), F.coalesce("_p", F.lit(0.0)))).otherwise(F.col("confidence"))).drop("_v", "_c", "_p", "_calm", "_rough", "_swap")


def merged(rule: DataFrame, model: DataFrame, key: str, least: float = 0.45) -> DataFrame:
    """Rule and classifier hits of one type: 0.65 model + 0.35 rule; either alone counts 0.85. With severity and reason."""
    a = rule.groupBy(key, "failure_type").agg(F.min("confidence").alias("_r"))
    b = model.groupBy(key, "failure_type").agg(F.max("confidence").alias("_m"))
    both = a.join(b, [key, "failure_type"], "full_outer")
    c = F.when(F.col("_r").isNotNull() & F.col("_m").isNotNull(), 0.65 * F.col("_m") + 0.35 * F.col("_r")).otherwise(0.85 * F.coalesce("_r", "_m"))
    method = F.when(F.col("_r").isNotNull() & F.col("_m").isNotNull(), "rule+ml").when(F.col("_r").isNotNull(), "rule").otherwise("ml")
    out = both.select(key, "failure_type", F.least(c, F.lit(1.0)).alias("confidence"), method.alias("method")).where(F.col("confidence") >= least)
    severity = F.when(F.col("confidence") > 0.6, "critical").when(F.col("confidence") > 0.3, "warning").otherwise("info")
    return out.withColumn("severity", severity).withColumn("reason", F.when(F.col("confidence") >= 0.7, "confirmed").otherwise("uncertain"))


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """rank of each hit of a log: surest first, then found by both, by the model, by a rule, then the label's priority, then its name."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), *by_priority())))


def by_priority() -> list[Column]:
    method = F.when(F.col("method") == "rule+ml", 0).when(F.col("method") == "ml", 1).otherwise(2)
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair]), F.col("failure_type")), F.lit(0))
    return [method, label.desc(), F.col("failure_type")]


def decisions(hits: DataFrame, logs: DataFrame, key: str) -> DataFrame:
    """healthy, uncertain or confirmed per log, with the reasons for doubt."""
    tops = ranked(hits, key).groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.struct("confidence", "method", "failure_type"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("second"), F.count_if(F.col("confidence") >= 0.5).alias("strong"))
    rows = logs.select(key).join(tops, key, "left")
    c = F.col("top.confidence")
    doubts = F.filter(F.array(F.when(c < 0.65, "low_confidence"), F.when(c - F.col("second") < 0.15, "close_second"), F.when(F.col("strong") >= 2, "several_strong"), F.when((F.col("top.method") == "ml") & (c < 0.75), "model_only")), lambda x: x.isNotNull())
    status = F.when(F.col("top").isNull(), "healthy").when(F.size(doubts) > 0, "uncertain").otherwise("confirmed")
    return rows.select(key, status.alias("status"), F.col("top.failure_type").alias("failure_type"), c.alias("confidence"), F.when(F.col("top").isNull(), F.array().cast("array<string>")).otherwise(doubts).alias("reasons"))
