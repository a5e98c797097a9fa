"""The detection operators on a few rows, with nulls, ties, empty logs and clashing columns."""

import numpy as np
import pytest
from aerolith.operators import detectors, diagnosis, features, learning, motors, similarity
from pyspark.sql import functions as F

S = "log string, seq long, t long, channels array<double>"
FULL, FREE = [1950.0] * 4, [1500.0] * 4


def test_thrust_loss_starts_at_the_first_run_that_falls(spark):
    rows = [("a", i, i * 1_000_000, FULL if 2 <= i <= 6 or i >= 9 else FREE) for i in range(14)]
    rows += [("b", i, i * 1_000_000, FULL) for i in range(6)] + [("c", 0, 0, None)]
    s = spark.createDataFrame(rows, S)
    alt = spark.createDataFrame([("a", 2_000_000, 0, 50.0), ("a", 6_000_000, 1, 50.0), ("a", 10_000_000, 2, 50.0), ("a", 13_000_000, 3, 40.0), ("b", 0, 0, None)], "log string, t long, seq long, alt double")
    out = motors.thrust_loss(s, alt, "log", "t", "seq", "alt").collect()
    assert [(r["log"], r["onset"]) for r in out] == [("a", 9_000_000.0)]


def test_motor_features_of_a_log(spark):
    rows = [("a", i, i * 6_000_000, [1000.0, 1000.0 + 100 * i, 700.0 + 400 * i]) for i in range(4)] + [("e", 0, 0, [])]
    s = spark.createDataFrame(rows, S).withColumn("channels", F.filter("channels", lambda x: x > 800))
    out = {r["log"]: r for r in motors.motor_features(s, "log", "t", "seq", spark.createDataFrame([("a", 0.5)], "log string, thrust double")).collect()}
    every = [x for _, _, _, c in rows[:4] for x in c if x > 800]
    assert list(out) == ["a"]
    assert out["a"]["output_mean"] == pytest.approx(np.mean(every)) and out["a"]["output_std"] == pytest.approx(np.std(every))
    assert out["a"]["spread_mean"] == pytest.approx(np.mean([500, 900])) and out["a"]["spread_onset"] == 12_000_000.0
    assert out["a"]["hover_ratio"] == pytest.approx(np.mean(every) / 0.5)


def test_detectors_need_enough_samples(spark):
    few = spark.createDataFrame([("a", i, i, FULL) for i in range(9)], S)
    assert not detectors.motor_faults(few, "log", "t", "seq").first()["fault"]
    many = spark.createDataFrame([("a", i, i * 2_000_000, FULL if i > 3 else FREE) for i in range(12)], S)
    got = detectors.motor_faults(many, "log", "t", "seq").first()
    assert (got["fault_type"], got["confidence"], got["first_fault_s"]) == ("thrust_loss", 0.7, 8.0)
    assert [e["feature"] for e in got["evidence"]] == ["saturated", "all_high"]


def test_detectors_on_an_empty_table(spark):
    none = spark.createDataFrame([], S)
    assert detectors.motor_faults(none, "log", "t", "seq").count() == 0
    assert motors.motor_features(none, "log", "t", "seq").count() == 0


def test_gps_loss(spark):
    rows = spark.createDataFrame([("a", i, i * 1_000_000, 1 if i > 1 else 3, 1.0, 9) for i in range(6)], "log string, seq long, t long, status int, hdop double, nsats int")
    got = detectors.gps_faults(rows, "log", "t", "seq").first()
    assert (got["fault_type"], got["confidence"], got["first_fault_s"]) == ("gps_loss", 0.7, 2.0)


def test_vehicles_leave_rules_out(spark):
    rows = spark.createDataFrame([("a", "Rover", 90.0), ("b", "Copter", 90.0), ("c", None, 90.0)], "log string, kind string, vibe_x_max double")
    rows = rows.select("*", *[F.lit(0.0).alias(c) for c in ("vibe_y_max", "vibe_z_max", "vibe_clip", "gps_hdop", "gps_nsats", "gps_nsats_min", "gps_fix", "gps_lost", "volt_range", "volt_min", "vcc_min", "volt_margin", "volt_sag", "volt_std", "curr_max")])
    assert {r["log"] for r in diagnosis.rule_hits(rows, "log", vehicle="kind").collect()} == {"b", "c"}


def test_context_tells_vibration_from_compass(spark):
    hits = spark.createDataFrame([("calm", "vibration_high", 0.8), ("both", "vibration_high", 0.8), ("both", "compass_interference", 0.6), ("rough", "vibration_high", 0.8), ("rough", "compass_interference", 0.6), ("none", "ekf_failure", 0.5)], "log string, failure_type string, confidence double")
    f = spark.createDataFrame([("calm", 10.0, 0.0), ("both", 10.0, 0.0), ("rough", 90.0, 0.0)], "log string, vibe_x_max double, vibe_clip double").select("*", F.lit(0.0).alias("vibe_y_max"), F.lit(None).cast("double").alias("vibe_z_max"), F.lit(400.0).alias("mag_range"), F.lit(40.0).alias("mag_std"))
    out = sorted((r["log"], r["failure_type"], r["confidence"]) for r in diagnosis.in_context(hits, f, "log").collect())
    assert out == [("both", "compass_interference", 0.6), ("calm", "compass_interference", 0.35), ("none", "ekf_failure", 0.5), ("rough", "vibration_high", 0.8)]


def test_derived_ratios(spark):
    got = features.derived(spark.createDataFrame([(10.0, 0.0)], "volt_range double, curr_max double")).first()
    assert got["resistance"] == 0.0 and got["thrust_weight"] == 0.0


def test_similar_cases_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5))
    v[7] = v[3]
    v[9] = 0
    e = spark.createDataFrame([(i, [float(x) for x in r], "x") for i, r in enumerate(v)] + [(90, None, "x")], "id long, e array<double>, cosine string")
    got = {}
    for r in similarity.similar_cases(e.where("id % 3 = 0"), e, "id", "id", "e", 0.1, 4, block=16).collect():
        got.setdefault(r["id"], []).append((r["case_id"], r["cosine"]))
    n = np.linalg.norm(v, axis=1)
    for i in range(0, 90, 3):
        c = [(-round(float(v[i] @ v[j] / (n[i] * n[j])), 4), j) for j in range(90) if j != i and n[i] * n[j] > 0]
        assert got.get(i, []) == [(j, -s) for s, j in sorted(c)[:4] if -s > 0.1]


def test_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(900, 25.0, -25.0), (901, None, 0.0)]
    data = spark.createDataFrame(rows, "id long, a double, b double")
    trees = learning.isolation_trees(data, "id", ["a", "b"], trees=20)
    scored = {r["id"]: r["score"] for r in learning.isolation_scores(data, trees, ["a", "b"]).collect()}
    assert len(scored) == 302 and max(scored, key=scored.get) == 900 and scored[900] > 0.7
    assert all(0 < s <= 1 for s in scored.values())


def test_augmented_copies_are_near_and_repeat(spark):
    data = spark.createDataFrame([(i, float(i), 5.0, "x") for i in range(40)], "id long, vibe_x double, other double, label string")
    run = lambda: sorted(learning.augmented(data, "id", ["vibe_x", "other"], 2).collect())
    a = run()
    assert len(a) == 120 and a == run()
    assert all(abs(r["other"] - 5) < 5 * 0.05 * 6 for r in a) and sum(r["copy"] == 0 for r in a) == 40
