"""Queries on motors, incidents, detectors and routing. Orders are samples: a day is a second, the lines' quantities are outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import detectors, diagnosis, features, motors
from aerolith.plans import flight
from aerolith.sources.messages import events

_DAY = 86_400


def _samples(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("log_id"), F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / _DAY).alias("time_us"), "o_totalprice")
    c = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_quantity") * 4 + 1850).alias("channels"))
    rows = o.join(c, "o_orderkey", "left").withColumnRenamed("o_orderkey", "seq")
    return rows.withColumn("channels", F.coalesce("channels", F.array().cast("array<double>")))


def motor_features(spark, sf_dir):
    out = motors.motor_features(_samples(spark, sf_dir), "log_id", "time_us", "seq", uneven=150.0, saturated=2000.0, high=1900.0)
    return out.select("log_id", "spread_onset", *[F.round(c, 6).alias(c) for c in ("spread_mean", "spread_max", "output_mean", "output_max", "saturated", "all_high")])


def thrust_loss(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return motors.thrust_loss(s, s.withColumn("altitude", F.col("o_totalprice") / 1000), "log_id", "time_us", "seq", "altitude")


def _shown(found):
    return found.select("log_id", "fault", "fault_type", "confidence", F.array_join(F.transform("evidence", lambda x: x["feature"]), ",").alias("evidence"), F.floor("first_fault_s").alias("first_fault_s"))


def motor_faults(spark, sf_dir):
    return _shown(detectors.motor_faults(_samples(spark, sf_dir), "log_id", "time_us", "seq", saturated=2040.0, high=1880.0))


def thrust_faults(spark, sf_dir):
    s = _samples(spark, sf_dir)
    control = s.withColumn("throttle", F.col("o_totalprice") / 350000).withColumn("alt_error", F.col("o_totalprice") / 95000)
    return _shown(detectors.thrust_faults(s, control, "log_id", "time_us", "seq", saturated=2040.0, high=1880.0))


def vibration_faults(spark, sf_dir):
    e = events(spark, sf_dir).select("log_id", "seq", "time_us", (F.col("value") / 5).alias("vibe_x"), (F.col("value") / 9).alias("vibe_y"), F.col("code").cast("double").alias("vibe_z"), F.greatest(F.lit(0.0), F.col("value") - 400).alias("clips"))
    return _shown(detectors.vibration_faults(e, "log_id", "time_us", "seq"))


def gps_faults(spark, sf_dir):
    e = events(spark, sf_dir).where("msg_type = 'error'").select("log_id", "seq", "time_us", (F.col("code") % 7).alias("status"), (F.col("value") / 15).alias("hdop"), F.col("code").alias("nsats"))
    return _shown(detectors.gps_faults(e, "log_id", "time_us", "seq"))


def _incidents(spark, sf_dir):
    kind = F.when(F.col("msg_type") == "error", "ERR").when(F.col("msg_type") == "signup", "EV").otherwise("MODE")
    field = lambda sql: F.expr(sql).cast("string")
    fields = F.create_map(F.lit("Subsys"), field("code % 32"), F.lit("ECode"), field("code % 4"), F.lit("Id"), field("code % 20"), F.lit("Mode"), field("code % 10"), F.lit("Reason"), field("code % 3"))
    return events(spark, sf_dir).select("log_id", "seq", "time_us", kind.alias("msg_type"), fields.alias("fields"))


_COUNTS = ["errors", "failsafes", "mode_changes", "unexpected_modes", "crashes", "gps_lost", "rc_lost", "radio_failsafe"]


def incidents(spark, sf_dir):
    return features.extracted(_incidents(spark, sf_dir), families=["incidents"]).select("log_id", *_COUNTS)


def error_labels(spark, sf_dir):
    return features.error_labels(_incidents(spark, sf_dir))


def routed_rules(spark, sf_dir):
    rows = flight.feature_rows(spark, sf_dir).withColumn("vehicle", F.element_at(F.array(F.lit("Copter"), F.lit("Rover"), F.lit("Sub")), (F.col("log_id") % 3 + 1).cast("int")))
    hits = diagnosis.rule_hits(rows, "log_id", vehicle="vehicle")
    return hits.select("log_id", "failure_type", F.round("confidence", 6).alias("confidence"))


def subsystems(spark, sf_dir):
    hits = diagnosis.rule_hits(flight.feature_rows(spark, sf_dir), "log_id").withColumn("confidence", F.round("confidence", 6))
    return diagnosis.subsystems(hits, "log_id")


_S = f"o AS (SELECT o_orderkey AS seq, o_custkey AS log_id, (epoch_us(o_orderdate) // {_DAY})::BIGINT AS time_us, o_totalprice AS price FROM orders), c AS (SELECT l_orderkey AS seq, list(l_quantity * 4 + 1850) AS ch, max(l_quantity * 4 + 1850) AS hi, min(l_quantity * 4 + 1850) AS lo, count(*) AS w, sum(l_quantity * 4 + 1850) AS t FROM lineitem GROUP BY 1), f AS (SELECT log_id, arg_min(time_us, seq) AS t0, count(*) AS n FROM o GROUP BY 1), s AS (SELECT o.*, hi, lo, w, t, hi - lo AS spread, t0, n FROM o JOIN f USING (log_id) LEFT JOIN c USING (seq))"
_OUT = f"{_S}, m AS (SELECT log_id, any_value(t0) AS t0, any_value(n) AS n, coalesce(avg((hi >= 2040)::INT) FILTER (WHERE w > 0), 0) AS sat, coalesce(avg((w >= 4 AND lo >= 1880)::INT) FILTER (WHERE w > 0), 0) AS high, coalesce(max(spread) FILTER (WHERE time_us >= t0 + 10000000), 0) AS smax, coalesce(avg(spread) FILTER (WHERE time_us >= t0 + 10000000), 0) AS smean, arg_min(time_us, seq) FILTER (WHERE hi >= 2040 OR (w >= 4 AND lo >= 1880)) AS onset, avg((price / 350000 >= 0.95)::INT) AS thr, max(price / 95000) AS err, arg_min(time_us, seq) FILTER (WHERE price / 350000 >= 0.95) AS tfull FROM s GROUP BY log_id)"


def _verdict(source: str, conf: str, samples: int, least: float, kind: str, items: list[tuple[str, str]], onset: str) -> str:
    named = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in items) + ")"
    return f"WITH {source}, v AS (SELECT *, round(least(1, {conf}), 3)::DOUBLE AS conf FROM m), k AS (SELECT *, n >= {samples} AND conf >= {least} AS fault FROM v) SELECT log_id, fault, CASE WHEN fault THEN {kind} END AS fault_type, CASE WHEN fault THEN conf ELSE 0 END::DOUBLE AS confidence, CASE WHEN fault THEN {named} ELSE '' END AS evidence, CASE WHEN fault THEN floor(round(({onset} - t0) / 1e6, 2))::BIGINT END AS first_fault_s FROM k"


_SAT = "CASE WHEN sat > 0.25 THEN 0.45 WHEN sat > 0.2 THEN 0.25 ELSE 0 END + CASE WHEN high > 0.15 THEN 0.25 ELSE 0 END"
_AXES = {"vibe_x": "value / 5", "vibe_y": "value / 9", "vibe_z": "code"}
_E = "e AS (SELECT user_id AS log_id, event_id AS seq, epoch_us(ts) AS time_us, event_type, value, json_extract_string(props, '$.k')::INT AS code FROM events)"
_VIBE = f"{_E}, m AS (SELECT log_id, count(*) AS n, arg_min(time_us, seq) AS t0, sum(greatest(0, value - 400)) AS clips, " + ", ".join(f"max({x}) AS {a}, arg_min(time_us, seq) FILTER (WHERE {x} > 30) AS w_{a}, arg_min(time_us, seq) FILTER (WHERE {x} > 60) AS f_{a}" for a, x in _AXES.items()) + " FROM e GROUP BY log_id)"
_GPS = f"{_E}, m AS (SELECT log_id, count(*) AS n, arg_min(time_us, seq) AS t0, avg((code % 7 >= 3)::INT) AS fix, avg(value / 15) AS hdop, min(code) AS sats, arg_min(time_us, seq) FILTER (WHERE code % 7 < 3) AS lost, arg_min(time_us, seq) FILTER (WHERE code < 6) AS few FROM e WHERE event_type = 'error' GROUP BY log_id)"
_I = f"{_E}, i AS (SELECT *, CASE event_type WHEN 'error' THEN 'ERR' WHEN 'signup' THEN 'EV' ELSE 'MODE' END AS m, code % 32 AS sub, code % 10 IN (6, 9) AS lands FROM e)"
_LABELS = " ".join(f"WHEN {c} THEN '{n}'" for c, n in features.ERROR_LABELS.items())
_SUBS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in diagnosis.SUBSYSTEMS.items())

QUERIES = {
    "motor_features": (motor_features, f"WITH {_S} SELECT log_id, coalesce(arg_min(time_us, seq) FILTER (WHERE time_us >= t0 + 10000000 AND spread > 150), -1)::DOUBLE AS spread_onset, round(coalesce(avg(spread) FILTER (WHERE time_us >= t0 + 10000000), 0), 6) AS spread_mean, round(coalesce(max(spread) FILTER (WHERE time_us >= t0 + 10000000), 0), 6) AS spread_max, round(sum(t) / sum(w), 6) AS output_mean, max(hi) AS output_max, round(avg((hi > 2000)::INT), 6) AS saturated, round(avg((w >= 4 AND lo > 1900)::INT), 6) AS all_high FROM s WHERE w > 0 GROUP BY log_id"),
    "thrust_loss_onset": (thrust_loss, f"WITH {_S}, r AS (SELECT *, (w >= 4 AND lo >= 1900) AS pegged, sum((NOT (w >= 4 AND lo >= 1900))::INT) OVER (PARTITION BY log_id ORDER BY seq) AS run FROM s WHERE w > 0), b AS (SELECT log_id, run, arg_min(time_us, seq) AS st FROM r WHERE pegged GROUP BY ALL), h AS (SELECT r.log_id, st, r.time_us, arg_min(a.price, (a.time_us, a.seq)) AS first, arg_max(a.price, (a.time_us, a.seq)) AS last FROM r JOIN b USING (log_id, run) JOIN o a ON a.log_id = r.log_id AND a.time_us BETWEEN st AND r.time_us WHERE pegged AND r.time_us - st >= 3000000 GROUP BY r.log_id, st, r.time_us, r.seq) SELECT log_id, arg_min(st, time_us)::DOUBLE AS onset FROM h WHERE last / 1000 < first / 1000 - 1 GROUP BY log_id"),
    "motor_faults": (motor_faults, _verdict(_OUT, f"{_SAT} + CASE WHEN smax >= 400 AND smean >= 200 THEN 0.45 ELSE 0 END", 10, 0.4, "CASE WHEN sat > 0.2 OR high > 0.15 THEN 'thrust_loss' ELSE 'motor_imbalance' END", [("sat > 0.2", "saturated"), ("high > 0.15", "all_high"), ("smax >= 400 AND smean >= 200", "spread_max"), ("smax >= 400 AND smean >= 200", "spread_mean")], "onset")),
    "thrust_faults": (thrust_faults, _verdict(_OUT, f"{_SAT} + CASE WHEN thr > 0.2 THEN 0.2 ELSE 0 END + CASE WHEN err > 5 THEN 0.1 ELSE 0 END", 10, 0.4, "'thrust_loss'", [("sat > 0.2", "saturated"), ("high > 0.15", "all_high"), ("thr > 0.2", "throttle_sat"), ("err > 5", "alt_error_max")], "least(onset, CASE WHEN thr > 0.2 THEN tfull END)")),
    "vibration_faults": (vibration_faults, _verdict(_VIBE, " + ".join(f"CASE WHEN {a} > 60 THEN 0.2 WHEN {a} > 30 THEN 0.1 ELSE 0 END" for a in _AXES) + " + CASE WHEN clips > 0 THEN 0.3 ELSE 0 END + CASE WHEN clips > 100 THEN 0.2 ELSE 0 END", 5, 0.25, "'vibration_high'", [*[(f"{a} > 30", f"{a}_max") for a in _AXES], ("clips > 0", "vibe_clip")], "least(" + ", ".join(f"CASE WHEN {a} > 60 THEN f_{a} ELSE w_{a} END" for a in _AXES) + ")")),
    "gps_faults": (gps_faults, _verdict(_GPS, "CASE WHEN fix < 0.95 AND 1 - fix > 0.5 THEN 0.7 WHEN fix < 0.95 THEN 0.5 ELSE 0 END + CASE WHEN sats < 6 THEN 0.4 ELSE 0 END + CASE WHEN hdop > 5 THEN 0.4 WHEN hdop > 2 THEN 0.2 ELSE 0 END", 5, 0.3, "CASE WHEN fix < 0.95 AND 1 - fix > 0.5 THEN 'gps_loss' ELSE 'gps_quality_poor' END", [("fix < 0.95", "gps_fix"), ("sats < 6", "gps_nsats"), ("hdop > 2", "gps_hdop")], "coalesce(CASE WHEN fix < 0.95 THEN lost END, CASE WHEN sats < 6 THEN few END)")),
    "incident_counts": (incidents, f"WITH {_I} SELECT log_id, " + ", ".join(f"(count(*) FILTER (WHERE {c}))::DOUBLE AS {n}" for n, c in {"errors": "m = 'ERR'", "failsafes": f"m = 'ERR' AND sub IN {tuple(features.FAILSAFES)}", "mode_changes": "m = 'MODE'", "unexpected_modes": "m = 'MODE' AND lands AND code % 3 <> 0", "gps_lost": "m = 'EV' AND code % 20 = 19", "rc_lost": "m = 'MODE' AND lands AND code % 3 = 2", "radio_failsafe": "m = 'ERR' AND sub = 5"}.items()) + ", max((m = 'ERR' AND sub = 12)::INT)::DOUBLE AS crashes FROM i GROUP BY log_id"),
    "error_labels": (error_labels, f"WITH {_I}, l AS (SELECT *, CASE sub {_LABELS} END AS label FROM i WHERE m = 'ERR') SELECT log_id, label, count(*) AS n, arg_min(time_us, seq) AS first_us FROM l WHERE label IS NOT NULL AND (sub <> 11 OR code % 4 = 2) GROUP BY ALL"),
    "routed_rules": (routed_rules, f"WITH {flight._FEATURES} SELECT log_id, failure_type, round(confidence, 6) AS confidence FROM hits WHERE log_id % 3 = 0 OR failure_type IN ('power_instability', 'brownout') OR (log_id % 3 = 1 AND failure_type = 'gps_quality_poor')"),
    "subsystem_ranking": (subsystems, f"WITH {flight._FEATURES}, u AS (SELECT log_id, coalesce(CASE failure_type {_SUBS} END, 'Unknown') AS subsystem, max(round(confidence, 6)) AS likelihood FROM hits WHERE confidence > 0 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY likelihood DESC, subsystem) AS rank FROM u"),
}
