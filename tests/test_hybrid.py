"""From hits to reported diagnoses, on rows whose results are known by hand."""

from aerolith.operators import diagnosis, hybrid, logs, rules


def hits(spark, rows):
    return spark.createDataFrame(rows, "log_id long, failure_type string, confidence double, method string, severity string, onset double")


def test_equally_sure_hits_go_by_method_then_label(spark):
    rows = [(1, "gps_quality_poor", 0.6, "rule", "warning", -1.0), (1, "crash_unknown", 0.6, "ml", "warning", -1.0), (1, "rc_failsafe", 0.6, "rule+ml", "warning", -1.0), (1, "thrust_loss", 0.6, "ml", "warning", -1.0)]
    out = diagnosis.ranked(hits(spark, rows), "log_id").orderBy("rank").collect()
    assert [r.failure_type for r in out] == ["rc_failsafe", "thrust_loss", "crash_unknown", "gps_quality_poor"]


def test_the_earlier_loss_of_thrust_comes_before_the_estimator(spark):
    rows = [(1, "ekf_failure", 0.75, "rule", "critical", 16e6), (1, "thrust_loss", 0.9, "rule", "critical", 13e6), (1, "vibration_high", 0.5, "ml", "warning", -1.0)]
    out = hybrid.advised(hybrid.selected(hits(spark, rows), "log_id")).orderBy("place").collect()
    assert [(r.failure_type, r.arbitrated) for r in out] == [("thrust_loss", True), ("ekf_failure", False)] and out[0].advice.startswith("[ARB]")
    # within five seconds the surer one wins, later only one that is much surer
    for gap, sure, cause in ((4e6, 0.6, "b"), (6e6, 0.6, "a"), (20e6, 0.9, "b"), (40e6, 0.9, "a")):
        two = [(1, "a", 0.5, "ml", "warning", 1e6), (1, "b", sure, "ml", "warning", 1e6 + gap)]
        assert hybrid.selected(hits(spark, two), "log_id").where("place = 1").first().failure_type == cause


def test_without_onsets_near_and_critical_hits_stay(spark):
    rows = [(1, "a", 0.8, "ml", "critical", -1.0), (1, "b", 0.75, "ml", "critical", -1.0), (1, "c", 0.74, "rule", "critical", -1.0), (2, "a", 0.8, "ml", "critical", -1.0), (2, "b", 0.65, "rule", "critical", -1.0), (3, "a", 0.8, "ml", "critical", 5.0)]
    out = {(r.log_id, r.place): (r.failure_type, r.why) for r in hybrid.selected(hits(spark, rows), "log_id").collect()}
    assert out == {(1, 1): ("a", "surest"), (1, 2): ("b", "near the surest"), (2, 1): ("a", "surest"), (2, 2): ("b", "critical rule"), (3, 1): ("a", "surest")}


def features(spark, **values):
    names = ["gps_hdop", "gps_nsats", "gps_nsats_min", "gps_fix", "gps_lost", "volt_range", "volt_min", "vcc_min", "volt_margin", "volt_sag", "volt_std", "curr_max", *[f"vibe_{a}_max" for a in "xyz"], "vibe_clip"]
    return spark.createDataFrame([(1, *[float(values.get(n, 0)) for n in names])], "log_id long, " + ", ".join(f"{n} double" for n in names))


def test_rules_of_satellites_and_supply(spark):
    fired = lambda **v: {r.failure_type: (round(r.confidence, 3), r.severity) for r in diagnosis.rule_hits(features(spark, **v), "log_id").collect()}
    # only a log without any satellite, dilution and fix is left out; the fewest satellites count
    assert fired() == {} and fired(gps_fix=0.5) == {"gps_quality_poor": (0.6, "warning")}
    assert fired(gps_nsats=12, gps_nsats_min=4, gps_fix=1, gps_hdop=1) == {"gps_quality_poor": (0.5, "warning")}
    # noise of the voltage under current; a warning however slight, and critical only as a brownout
    assert fired(gps_nsats=9, gps_nsats_min=9, gps_fix=1, volt_std=1, curr_max=21) == {"power_instability": (0.15, "warning")}
    assert fired(gps_nsats=9, gps_nsats_min=9, gps_fix=1, vcc_min=4.2) == {"brownout": (0.8, "critical")}


def test_messages_become_a_decision(spark):
    rows = []
    for i in range(20):
        t = i * 1_000_000
        rows += [(1, 10 * i, t, "VIBE", {"VibeX": "70", "VibeY": "70", "VibeZ": "80", "Clip0": "200"}), (1, 10 * i + 1, t, "GPS", {"HDop": "1", "NSats": "12", "Status": "3", "Alt": str(100 - 5 * i)}), (1, 10 * i + 2, t, "RCOU", {f"C{k}": "1950" for k in range(1, 5)})]
        rows += [(2, 10 * i, t, "GPS", {"HDop": "0.8", "NSats": "14", "Status": "3", "Alt": "10"}), (2, 10 * i + 1, t, "RCOU", {f"C{k}": str(1500 + k) for k in range(1, 5)})]
    rows += [(3, 1, None, "MSG", {"Message": "none"})]
    messages = spark.createDataFrame(rows, "log_id long, seq long, time_us long, msg_type string, fields map<string,string>")
    decided, chosen = hybrid.diagnosed(messages)
    rows = {r.log_id: r for r in decided.collect()}
    assert (rows[2].status, rows[2].failure_type, rows[2].batch) == ("healthy", None, "HEALTHY")
    assert (rows[3].status, rows[3].batch, rows[3].hypotheses) == ("not_extracted", "ERROR", [])
    # vibration: 3 x 0.2 + 0.3 + 0.2, at most 1; thrust: 0.45 + 0.25, as its run begins at time 0, which is no onset
    one = rows[1]
    assert [(h.failure_type, h.onset, h.confidence) for h in one.hypotheses] == [("vibration_high", 0.0, 0.85), ("thrust_loss", 0.0, 0.595)]
    assert (one.status, one.failure_type, one.batch, one.why) == ("confirmed", "vibration_high", "CRITICAL", "surest")
    assert [(r.place, r.failure_type, round(r.confidence, 4)) for r in chosen.where("log_id = 1").orderBy("place").collect()] == [(1, "vibration_high", 0.85)]
    facts = {r.log_id: r for r in logs.facts(messages).collect()}
    assert facts[1].duration == 19.0 and not facts[3].extracted and facts[3].vehicle == "Unknown"
    assert len(rules.ALL) == 13
