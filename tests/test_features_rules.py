import pytest
from aerolith.operators import diagnosis, features, rules

SCHEMA = "log_id string, seq long, msg_type string, time_us long, fields map<string,string>"


def _extract(spark, rows, families=None):
    logs = spark.createDataFrame([("a",), ("none",)], "log_id string")
    df = spark.createDataFrame([("a", i, m, i * 1_000_000, f) for i, (m, f) in enumerate(rows)], SCHEMA)
    return {r.log_id: r.asDict() for r in features.extracted(df, logs, families).collect()}


def test_vibration_ekf_and_fallback(spark):
    rows = [("VIBE", {"VibeX": "10", "VibeY": "20", "VibeZ": "30", "Clip0": "1", "Clip1": "2", "Clip2": "0"})]
    rows += [("NKF4", {"SV": "0.5", "SP": "0.2", "SH": "0.1", "SM": "bad", "SS": "1"})] * 2 + [("CURR", {"Volt": "12"}), ("CURR", {"Volt": "10"})]
    out = _extract(spark, rows)
    a = out["a"]
    assert (a["vibe_x_mean"], a["vibe_z_max"], a["vibe_clip"], a["vibe_onset"]) == (10, 30, 3, -1)
    assert (a["ekf_vel_mean"], a["ekf_mag_max"], a["ekf_bad"]) == (0.5, 0, 1)
    assert (a["volt_range"], round(a["volt_sag"], 6)) == (2, round(2 / 12, 6))
    assert all(v == 0 for k, v in out["none"].items() if k != "log_id")


def test_onset_is_first_in_file_order(spark):
    a = _extract(spark, [("MAG", {"MagX": "100"}), ("MAG", {"MagX": "201"}), ("MAG", {"MagX": "300"})], ["compass"])["a"]
    assert (a["mag_onset"], a["mag_range"], a["mag_x_range"]) == (1_000_000, 200, 200)


def _fired(spark, **given):
    row = {n: 0.0 for n in rules.FEATURES} | {"thrust_onset": -1.0, "time_to_crash": -1.0, "spread_std": 50.0} | given
    df = spark.createDataFrame([("a", *row.values())], ["log_id", *row])
    return sorted((r.failure_type, round(r.confidence, 6), r.severity) for r in diagnosis.rule_hits(df, "log_id", rules.MORE).collect())


@pytest.mark.parametrize(
    "given, want",
    [
        ({}, {}),
        ({"spread_mean": 800.0, "spread_max": 900.0, "spread_std": 90.0}, {"mechanical_failure": (0.95, "critical"), "motor_imbalance": (1.0, "critical")}),
        ({"spread_max": 450.0, "spread_mean": 250.0, "spread_std": 20.0, "roll_std": 12.0}, {"pid_tuning_issue": [(0.8, "critical"), (0.5, "warning")]}),
        ({"thrust_onset": 13.0, "thrust_descent": 1.0, "saturated": 0.3}, {"thrust_loss": (1.0, "critical")}),
        ({"early_divergence": 50.0, "time_to_crash": 4.0}, {"setup_error": (0.9, "critical")}),
        ({"mag_range": 700.0, "mag_std": 60.0}, {"compass_interference": (0.45, "info")}),
        ({"mag_range": 100.0, "mag_std": 25.0}, {"compass_interference": (0.55, "warning")}),
        ({"mag_range": 900.0, "saturated": 0.05, "all_high": 0.25}, {"thrust_loss": (0.4, "warning")}),
        ({"ekf_vel_max": 1.6, "ekf_pos_max": 1.7}, {"ekf_failure": (0.9, "critical")}),
        ({"ekf_vel_max": 1.6}, {}),
        ({"ekf_switches": 1.0}, {"ekf_failure": (0.2, "warning")}),
        ({"internal_error": 1.0}, {"mechanical_failure": (0.7, "warning")}),
        ({"long_loops": 200.0, "load_mean": 50.0}, {}),
        ({"radio_failsafe": 1.0, "rc_lost": 1.0}, {"rc_failsafe": (1.0, "critical")}),
        ({"crashes": 1.0}, {}),
        ({"crashes": 2.0}, {"crash_unknown": (0.85, "critical")}),
        ({"roll_std": 6.0, "vibe_z_max": 40.0}, {}),
    ],
)
def test_rules(spark, given, want):
    assert _fired(spark, **given) == sorted((label, *hit) for label, hits in want.items() for hit in (hits if isinstance(hits, list) else [hits]))
