"""The assembly of features and the verdicts of a log, on messages whose results are known by hand."""

import pytest
from pyspark.sql import functions as F

from aerolith.operators import assembly, diagnosis, hybrid, logs, rules

SCHEMA = "log_id long, seq long, time_us long, msg_type string, fields map<string,string>"


def messages(spark, *parts):
    rows = []
    for log_id, kind, each in parts:
        for t, fields in each:
            rows.append((log_id, len(rows), t, kind, {k: str(v) for k, v in fields.items()}))
    return spark.createDataFrame(rows, SCHEMA)


def row(spark, *parts):
    return {r.log_id: r for r in assembly.assembled(messages(spark, *parts)).collect()}


def test_catalogue_has_all_columns(spark):
    out = assembly.matrix(assembly.assembled(messages(spark, (1, "VIBE", [(1, {"VibeZ": 3})]))))
    assert len(out.columns) == 95 and out.columns[1] == "vibe_x_mean" and out.columns[-1] == "fft_noise_floor"
    assert out.first().vibe_z_max == 3.0


def test_lanes_are_those_of_the_newer_estimator(spark):
    steady = lambda v: [(i * 10, {"PI": v, "SP": 0.2}) for i in range(20)]
    mixed = [part for i in range(20) for part in ((1, "XKF4", [(i * 10, {"PI": 0, "SP": 0.2})]), (1, "NKF4", [(i * 10, {"PI": 1, "SP": 9})]))]
    got = row(spark, *mixed, (2, "NKF4", [*steady(0), *steady(1), (500, {"PI": 0, "SP": 1.5})]))
    assert got[1].ekf_switches == 0 and got[1].ekf_pos_max == 0.2 and got[1].ekf_onset == -1
    assert got[2].ekf_switches == 2 and got[2].ekf_onset == 500


def test_older_supply_in_hundredths(spark):
    volts = lambda *v: [(i, {"Volt": x, "Curr": y}) for i, (x, y) in enumerate(v)]
    out = assembly.assembled(messages(spark, (1, "CURR", volts((1180, 600), (1170, 700), (1160, 800))), (2, "BAT", volts((1180, 600), (1120, 700))), (3, "CURR", volts((12, 400), (11, 420))))).cache()
    got = {r.log_id: r for r in out.collect()}
    assert got[1].volt_range == pytest.approx(0.2) and got[1].curr_max == pytest.approx(8.0)
    # the newer family is taken as it is, and small numbers are no hundredths
    assert got[2].volt_range == 60.0 and got[3].volt_max == 12.0 and got[3].curr_max == 420.0
    assert diagnosis.rule_hits(out.where("log_id = 1"), "log_id").collect() == []


def test_onset_of_a_drop_in_voltage(spark):
    volts = [12.0] * 20 + [9.0, 12.0, 8.0]
    got = row(spark, (1, "BAT", [(100 + i, {"Volt": v}) for i, v in enumerate(volts)]), (2, "BAT", [(i, {"Volt": 12.0}) for i in range(5)]), (3, "VIBE", [(1, {"VibeZ": 1})]))
    # 9.0 is within two deviations of the mean, 8.0 is not or both are: computed as the definition says
    mean = sum(volts) / len(volts)
    std = (sum((v - mean) ** 2 for v in volts) / len(volts)) ** 0.5
    first = next(i for i, v in enumerate(volts) if v < mean - 2 * std)
    assert got[1].volt_onset == 100 + first and got[2].volt_onset == -1 and got[3].volt_onset == 0


def test_loss_of_thrust_with_any_altitude(spark):
    motors = [(second * 1_000_000, {"C1": 1910, "C2": 1915, "C3": 1920, "C4": 1912}) for second in range(2, 7)]
    broken = [*motors[:2], (3_500_000, {"C1": 1500, "C2": 1915, "C3": 1920, "C4": 1912}), *motors[2:]]
    blind, parts = [(second * 1_000_000, {"HDop": 1}) for second in range(7)], []
    for i, (kind, field) in enumerate((("GPS", "Alt"), ("CTUN", "Alt"), ("CTUN", "DAlt"))):
        heights = [(second * 1_000_000, {field: 100 - second}) for second in range(2, 7)]
        # falls; stays level; a sample below full output ends the run
        for k, (run, alt) in enumerate(((motors, heights), (motors, [(t, {field: 50}) for t, _ in heights]), (broken, heights))):
            parts += [(10 * i + k, "RCOU", run), (10 * i + k, kind, alt)] + ([(10 * i + k, "GPS", blind)] if kind == "CTUN" else [])
    got = row(spark, *parts)
    for i in (0, 10, 20):
        assert (got[i].thrust_onset, got[i].thrust_descent) == (2_000_000, 1.0)
        assert got[i + 1].thrust_onset == got[i + 2].thrust_onset == -1 and got[i + 1].thrust_descent == 0


def test_rovers_and_boats_lack_families(spark):
    rover = [(1, "MSG", [(0, {"Message": "XRover V4.2"})]), (1, "VIBE", [(1_000_000, {"VibeX": 50, "VibeY": 50, "VibeZ": 90})]), (1, "RCOU", [(1_000_000, {"C1": 1950, "C2": 1950, "C3": 1950, "C4": 1950})]), (1, "CTUN", [(1_000_000, {"ThO": 0.99, "Alt": 10, "DAlt": 20})]), (1, "ATT", [(1_000_000, {"Roll": 70})])]
    sub = [(2, k, e) for _, k, e in rover[1:]] + [(2, "MSG", [(0, {"Message": "Xsub V3"})]), (2, "GPS", [(1, {"HDop": 9})])]
    got = row(spark, *rover, *sub)
    assert got[1].vibe_z_max == got[1].saturated == got[1].throttle_sat == 0.0 and got[1].roll_max == 70.0 and got[1].vehicle == "Rover"
    assert got[2].vibe_z_max == 90.0 and got[2].saturated == got[2].gps_hdop == 0.0
    found = {(r.log_id, r.failure_type) for r in hybrid.reported(hybrid.verdicts(assembly.assembled(messages(spark, *rover, *sub)))).collect()}
    assert not {f for _, f in found} & {"vibration_high", "thrust_loss", "gps_quality_poor"}


def test_logs_without_data(spark):
    some = messages(spark, (1, "MSG", [(None, {"Message": "nothing"})]), (2, "GPS", [(5, {"HDop": "x"}), (None, {"_timestamp": "2000005"})]))
    got = {r.log_id: r for r in assembly.assembled(some, spark.createDataFrame([(1,), (2,), (3,)], "log_id long")).collect()}
    assert not got[1].extracted and got[2].extracted and got[2].duration == 2.0 and not got[3].extracted
    assert got[3].n == 0 and got[3].vehicle == "Unknown" and got[2].gps_hdop == 0.0
    assert {r.status for r in hybrid.verdicts(assembly.assembled(some)).where("log_id = 1").collect()} == {"not_extracted"}


def features(spark, rows):
    """A row of features per dict, zero but for what is given."""
    names = sorted(set(assembly.CATALOGUE.values()) | {"thrust_onset", "thrust_descent"})
    data = [(i, "Copter", True, *[float(r.get(n, -1.0 if n == "thrust_onset" else 0.0)) for n in names]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "log_id long, vehicle string, extracted boolean, " + ", ".join(f"{n} double" for n in names))


def test_thrust_before_estimator(spark):
    both = {"saturated": 0.5, "thrust_onset": 13e6, "thrust_descent": 1, "ekf_pos_max": 2.4, "ekf_vel_max": 1.6, "ekf_onset": 16e6}
    got = hybrid.verdicts(features(spark, [both, {}])).orderBy("log_id").collect()
    assert [h.failure_type for h in got[0].hypotheses] == ["thrust_loss", "ekf_failure", "mechanical_failure"][:len(got[0].hypotheses)]
    assert got[0].arbitrated and got[0].why == "thrust_loss 3.0 s before ekf_failure" and got[0].failure_type == "thrust_loss"
    assert got[1].status == "healthy" and got[1].why == "nothing is sure enough"


def test_gate_keeps_hits_of_outliers_and_of_rules(spark):
    rows = features(spark, [{"vibe_z_max": 70, "vibe_clip": 200}, {}, {}, {}])
    model = spark.createDataFrame([(i, "ekf_failure", 0.9) for i in range(4)], "log_id long, failure_type string, confidence double")
    scores = spark.createDataFrame([(0, False), (1, False), (2, True), (3, None)], "log_id long, is_outlier boolean")
    got = {r.log_id: r.status for r in hybrid.verdicts(rows, model, scores).collect()}
    assert got[0] != "healthy" and got[1] == "healthy" and got[2] == "confirmed" and got[3] == "healthy"
    assert {r.status for r in hybrid.verdicts(rows, model).where("log_id > 0").collect()} == {"confirmed"}
    rule = diagnosis.rule_hits(rows, "log_id")
    assert {r.log_id for r in hybrid.gated(model, rule, scores, "log_id").collect()} == {0, 2}


def test_verdicts_agree_with_the_joined_way(spark):
    import random

    pick = random.Random(4)
    names = ["vibe_z_max", "vibe_clip", "mag_range", "mag_std", "ekf_pos_max", "ekf_vel_max", "saturated", "spread_mean", "spread_max", "early_divergence", "volt_range", "roll_std"]
    rows = [{n: pick.choice([0, 0, 1, 2.3]) * {"vibe_z_max": 40, "vibe_clip": 60, "mag_range": 300, "mag_std": 30, "spread_mean": 200, "spread_max": 350, "early_divergence": 20, "roll_std": 5}.get(n, 1) for n in names} for _ in range(150)]
    df = features(spark, rows).cache()
    model = spark.createDataFrame([(i, pick.choice(["ekf_failure", "vibration_high", "brownout"]), pick.random()) for i in range(150) if i % 3], "log_id long, failure_type string, confidence double")
    want = diagnosis.merged(diagnosis.rule_hits(df, "log_id", rules.ALL), model, "log_id")
    got = hybrid.verdicts(df, model)
    flat = got.select("log_id", F.explode("merged").alias("h")).select("log_id", "h.failure_type", F.round("h.confidence", 6).alias("c"), "h.method")
    assert {tuple(r) for r in flat.collect()} == {tuple(r) for r in want.select("log_id", "failure_type", F.round("confidence", 6), "method").collect()}
    # without onsets both ways report the same
    chosen = hybrid.selected(want.withColumn("onset", F.lit(-1.0)), "log_id").select("log_id", "place", "failure_type")
    assert {tuple(r) for r in hybrid.reported(got).select("log_id", "place", "failure_type").collect()} == {tuple(r) for r in chosen.collect()}


def test_labels_of_events_are_hits(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, ["vibration_high"]), (2, 2.0, 0.0, ["vibration_high"]), (3, 0.0, 0.0, ["crash_detected"]), (4, 0.0, 0.0, ["gps_quality_poor", "ekf_failure"]), (5, 1.0, 1.0, None)], "log_id long, crashes double, failsafes double, labels array<string>")
    got = {r.log_id: (r.h.failure_type, r.h.confidence) if r.h else None for r in rows.select("log_id", rules.crash("labels").alias("h")).collect()}
    assert got == {1: ("vibration_high", 0.78), 2: ("crash_unknown", 0.85), 3: None, 4: ("ekf_failure", 0.78), 5: ("crash_unknown", 0.7)}


def test_warnings_about_parameters(spark):
    parts = [(1, "PARM", [(1, {"Name": "ATC_RAT_RLL_P", "Value": 0.2}), (2, {"Name": "ATC_RAT_RLL_P", "Value": 0.135}), (3, {"Name": "ATC_RAT_PIT_P", "Value": 0.2}), (3, {"Name": "FRAME_CLASS", "Value": 1})]), (1, "VIBE", [(5, {"VibeZ": 40})])]
    own = messages(spark, *parts, *[(2, k, e) for k, e in (("PARM", parts[0][2]), ("VIBE", [(5, {"VibeZ": 20})]))])
    got = assembly.parameter_warnings(assembly.assembled(own), logs.parameters(own)).collect()
    assert [tuple(r) for r in got] == [(1, "ATC_RAT_RLL_P", 0.135)]
