"""Queries on the way from messages to reported diagnoses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import diagnosis, features, hybrid, logs, rules, series
from aerolith.sources.messages import events

from . import flight


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _onset_hits(spark, sf_dir):
    """Hits per log and kind of event with an onset: kinds stand for labels, found by a rule, the model or both."""
    label = F.expr("CASE failure_type WHEN 'click' THEN 'thrust_loss' WHEN 'view' THEN 'vibration_high' WHEN 'purchase' THEN 'ekf_failure' WHEN 'signup' THEN 'rc_failsafe' ELSE 'gps_quality_poor' END")
    own = flight._candidates(spark, sf_dir).withColumn("confidence", F.least(F.lit(1.0), F.floor(F.col("confidence") * 100) / 100)).withColumn("failure_type", label)
    method = F.expr("CASE CAST(round(confidence * 100) AS INT) % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'ml' ELSE 'rule+ml' END")
    severity = F.when(F.col("confidence") > 0.6, "critical").when(F.col("confidence") > 0.3, "warning").otherwise("info")
    # of every third log no onset is known
    onset = F.when(F.col("log_id") % 3 == 0, F.lit(-1.0)).otherwise(F.col("onset"))
    return own.select("log_id", "failure_type", "confidence", method.alias("method"), severity.alias("severity"), onset.alias("onset"))


def hypothesis_order(spark, sf_dir):
    out = hybrid.hypotheses(_onset_hits(spark, sf_dir), "log_id", shown=3)
    return out.select("log_id", "place", "failure_type", "confidence")


def ranked_hits(spark, sf_dir):
    return diagnosis.ranked(_onset_hits(spark, sf_dir), "log_id").select("log_id", "rank", "failure_type")


def selected_hits(spark, sf_dir):
    return hybrid.selected(_onset_hits(spark, sf_dir), "log_id")


def advised_hits(spark, sf_dir):
    out = hybrid.advised(hybrid.selected(_onset_hits(spark, sf_dir), "log_id"))
    return out.groupBy("failure_type", "advice").agg(F.count(F.lit(1)).alias("n"))


def gated_hits(spark, sf_dir):
    found = diagnosis.rule_hits(flight.feature_rows(spark, sf_dir), "log_id").where("confidence >= 0.6")
    scores = events(spark, sf_dir).groupBy("log_id").agg((F.count(F.lit(1)) % 5 == 0).alias("is_outlier"))
    return hybrid.gated(flight._model_hits(spark, sf_dir), found, scores, "log_id").select("log_id", "failure_type")


_MSG = {"view": "VIBE", "click": "RCOU", "purchase": "GPS", "signup": "ATT", "error": "ERR"}


def _messages(spark, sf_dir):
    """The driver's events as messages; every 40th event is a parameter, every 41st a boot text, every 43rd a mode."""
    kind = F.create_map(*[F.lit(x) for pair in _MSG.items() for x in pair])[F.col("msg_type")]
    kind = F.when(F.col("seq") % 40 == 0, "PARM").when(F.col("seq") % 41 == 0, "MSG").when(F.col("seq") % 43 == 0, "MODE").otherwise(kind)
    sql = {"VibeX": "value", "VibeZ": "value / 4", "HDop": "value / 15", "NSats": "code", "Status": "code % 5", "Alt": "1000 - value", "Roll": "value - 32", "Pitch": "value / 2", "DesRoll": "code", "Subsys": "code % 32", "ECode": "code % 4", "Mode": "code % 10", "Reason": "code % 3", "C1": "1500 + value", "C2": "1500 + 3 * value", "C3": "1900 + code", "C4": "1900 + value", "Value": "10 + code"}
    pairs = [x for name, e in sql.items() for x in (F.lit(name), F.expr(e).cast("double").cast("string"))]
    names = F.element_at(F.array(*[F.lit(n) for n, _ in logs.PARAMETERS], F.lit("BATT_LOW_VOLT")), (F.col("code") % 7 + 1).cast("int"))
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("XCopter", "XRover", "XSub", "Frame")]), (F.col("code") % 4 + 1).cast("int")), F.lit(" V4."), (F.col("code") % 10).cast("string"))
    fields = F.create_map(*pairs, F.lit("Name"), names, F.lit("Message"), text)
    return events(spark, sf_dir).select("log_id", "seq", "time_us", kind.alias("msg_type"), fields.alias("fields"))


def log_facts(spark, sf_dir):
    return logs.facts(logs.timed(_messages(spark, sf_dir))).withColumn("duration", F.round("duration", 6))


def last_parameters(spark, sf_dir):
    return logs.parameters(_messages(spark, sf_dir))


def event_timeline(spark, sf_dir):
    return logs.timeline(_messages(spark, sf_dir))


def rescaled_series(spark, sf_dir):
    own = events(spark, sf_dir).select("log_id", "seq", "value")
    return logs.rescaled(own, "log_id", "value", 400.0).groupBy("log_id").agg(F.round(F.sum("value"), 6).alias("total"))


def routed_columns(spark, sf_dir):
    own = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("vibe"), (F.col("o_totalprice") / 2).alias("mag"), F.element_at(F.array(F.lit("Copter"), F.lit("Rover"), F.lit("Sub")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("vehicle"))
    return logs.routed_features(own, "vehicle", {"vibration": ["vibe"], "compass": ["mag"]}).groupBy("vehicle").agg(F.round(F.sum("vibe"), 2).alias("vibe"), F.round(F.sum("mag"), 2).alias("mag"))


_ROWS = {"spread_mean": "q * 22", "spread_max": "q * 20 + k % 500", "spread_std": "k % 120", "saturated": "d * 5", "all_high": "d * 2", "thrust_onset": "CASE WHEN k % 4 = 0 THEN p ELSE -1 END", "thrust_descent": "k % 2", "roll_max": "q", "pitch_max": "q + 5", "roll_std": "k % 14", "pitch_std": "k % 13", "early_divergence": "q * 1.1", "time_to_crash": "k % 12", "mag_range": "q * 22", "mag_std": "q * 2.5", "ekf_vel_max": "q / 20", "ekf_pos_max": "q / 18", "ekf_mag_max": "q / 30", "ekf_switches": "CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END", "ekf_bad": "d * 2", "vibe_z_max": "q * 1.5", "throttle_sat": "d * 4", "alt_error_max": "q / 5", "alt_error_std": "q / 15", "volt_sag": "d * 2", "curr_max": "q"}


def damage_rules(spark, sf_dir):
    """The rules on motors, compass, estimator and tuning over rows of lineitem taken as features."""
    own = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("log_id"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("p"), (F.col("l_partkey") % 1000).alias("k"))
    rows = own.select("log_id", *[F.expr(e).cast("double").alias(n) for n, e in _ROWS.items()])
    some = {n: rules.MORE[n] for n in ("mechanical", "imbalance", "thrust_loss", "compass", "ekf")}
    hits = diagnosis.rule_hits(rows, "log_id", some)
    return hits.groupBy("failure_type", "severity", F.round("confidence", 4).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def explained(spark, sf_dir):
    model, hits = flight._model_hits(spark, sf_dir), _onset_hits(spark, sf_dir)
    rule = diagnosis.rule_hits(flight.feature_rows(spark, sf_dir), "log_id")
    out = hybrid.explained(model.select("log_id").distinct(), rule, model, hits, hybrid.selected(hits, "log_id"), "log_id")
    return out.select("log_id", F.to_json(F.struct("rule", "model", "hypotheses", "final", "reason")).alias("record"))


_H = flight._CANDIDATES + """, h AS (SELECT log_id, CASE failure_type WHEN 'click' THEN 'thrust_loss' WHEN 'view' THEN 'vibration_high' WHEN 'purchase' THEN 'ekf_failure' WHEN 'signup' THEN 'rc_failsafe' ELSE 'gps_quality_poor' END AS failure_type, least(1.0, floor(confidence * 100) / 100)::DOUBLE AS confidence,
 CASE round(least(1.0, floor(confidence * 100) / 100) * 100)::INT % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'ml' ELSE 'rule+ml' END AS method, CASE WHEN least(1.0, floor(confidence * 100) / 100) > 0.6 THEN 'critical' WHEN least(1.0, floor(confidence * 100) / 100) > 0.3 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN log_id % 3 = 0 THEN -1 ELSE onset END AS onset FROM c)"""
_K = _H + """, k AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY confidence DESC, CASE method WHEN 'rule+ml' THEN 0 WHEN 'ml' THEN 1 ELSE 2 END, CASE failure_type WHEN 'thrust_loss' THEN 6 WHEN 'vibration_high' THEN 5 WHEN 'rc_failsafe' THEN 2 ELSE 4 END DESC, failure_type) AS rank FROM h)"""
_SEL = _K + """, g AS (SELECT log_id, list({'o': onset, 'm': -confidence, 'l': failure_type} ORDER BY onset, -confidence, failure_type) AS c FROM h WHERE onset > 0 GROUP BY log_id),
b AS (SELECT log_id, (list_reduce(c, lambda b, x: CASE WHEN (x.o - c[1].o <= 5e6 AND -x.m > -b.m) OR (x.o - c[1].o <= 3e7 AND -x.m >= 0.85 AND -x.m > -b.m + 0.15) THEN x ELSE b END)).l AS cause FROM g),
f AS (SELECT k.*, count(*) OVER (PARTITION BY k.log_id) > 1 AND cause IS NOT NULL AS timed, cause, max(confidence) OVER (PARTITION BY k.log_id) AS first FROM k LEFT JOIN b ON k.log_id = b.log_id),
l AS (SELECT *, CASE WHEN timed THEN failure_type = cause ELSE rank = 1 END AS leads, method = 'rule' AND severity = 'critical' AS hard, first - confidence <= 0.1 AND (method = 'rule' OR confidence >= 0.7) AS near FROM f),
s AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY leads DESC, rank) AS place FROM l WHERE leads OR hard OR (NOT timed AND near)),
w AS (SELECT log_id, place, failure_type, confidence, method, severity, timed AND leads AS arbitrated, CASE WHEN timed AND leads THEN 'earliest onset' WHEN leads THEN 'surest' WHEN hard THEN 'critical rule' ELSE 'near the surest' END AS why FROM s WHERE place <= 2)"""
_ADVICE = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in hybrid.ADVICE.items())
_M = flight._E + """, m AS (SELECT *, CASE WHEN seq % 40 = 0 THEN 'PARM' WHEN seq % 41 = 0 THEN 'MSG' WHEN seq % 43 = 0 THEN 'MODE' """ + " ".join(f"WHEN msg_type = '{k}' THEN '{v}'" for k, v in _MSG.items()) + " END AS kind FROM e)"
_PARM = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate([*logs.PARAMETERS, ("BATT_LOW_VOLT", "")]))
_BY_PARM = " ".join(f"WHEN max((kind = 'PARM' AND code % 7 = {i})::INT) = 1 THEN '{v}'" for i, (_, v) in enumerate(logs.PARAMETERS))
_ERRORS = {k: " ".join(f"WHEN {c} THEN '{v[k]}'" for c, v in logs.ERROR_EVENTS.items()) for k in (0, 1)}
_ROW = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _ROWS.items())
_RULES = """
r AS (SELECT 'mechanical_failure' AS failure_type, greatest(0.55, (CASE WHEN spread_mean >= 800 THEN 0.55 WHEN spread_mean >= 400 THEN 0.45 ELSE 0 END) + (CASE WHEN spread_max >= 900 THEN 0.4 ELSE 0 END) + (CASE WHEN greatest(roll_max, pitch_max) > 40 THEN 0.25 ELSE 0 END) + (CASE WHEN greatest(ekf_vel_max, ekf_pos_max) >= 0.9 THEN 0.15 ELSE 0 END)) AS c, 0.7 AS crit, NULL::BOOLEAN AS hard FROM f WHERE spread_mean >= 400 OR spread_max >= 800
UNION ALL SELECT CASE WHEN spread_std < 25 AND roll_std > 10 THEN 'pid_tuning_issue' ELSE 'motor_imbalance' END, greatest(0.55, (CASE WHEN spread_max >= 600 THEN 0.55 WHEN spread_max > 400 AND spread_mean > 200 THEN 0.3 WHEN spread_max > 400 THEN 0.15 ELSE 0 END) + (CASE WHEN spread_mean >= 300 THEN 0.4 WHEN spread_mean > 200 THEN 0.25 ELSE 0 END) + (CASE WHEN spread_std > 80 AND roll_std < 4 THEN 0.1 ELSE 0 END) + (CASE WHEN spread_std < 25 AND roll_std > 10 THEN 0.25 ELSE 0 END)), 0.75, NULL FROM f WHERE spread_max > 400 OR spread_mean > 200
UNION ALL SELECT 'thrust_loss', greatest(0.4, (CASE WHEN thrust_onset > 0 AND thrust_descent > 0 THEN 0.55 ELSE 0 END) + (CASE WHEN saturated > 0.25 THEN 0.45 WHEN saturated > 0.1 THEN 0.25 ELSE 0 END) + (CASE WHEN all_high > 0.15 THEN 0.25 ELSE 0 END) + (CASE WHEN throttle_sat > 0.15 THEN 0.2 ELSE 0 END) + (CASE WHEN alt_error_max > 5 THEN 0.1 ELSE 0 END) + (CASE WHEN volt_sag > 0.15 THEN 0.15 ELSE 0 END) + (CASE WHEN curr_max > 25 THEN 0.15 ELSE 0 END)), 0.6, thrust_onset > 0 FROM f WHERE saturated >= 0.1 OR all_high >= 0.05 OR thrust_onset >= 0
UNION ALL SELECT 'compass_interference', greatest(0.1, least(0.65, CASE WHEN mag_range > 600 OR mag_std > 50 THEN (CASE WHEN mag_range > 800 THEN 0.65 WHEN mag_range > 600 THEN 0.35 ELSE 0 END) + (CASE WHEN mag_std > 100 THEN 0.2 WHEN mag_std > 50 THEN 0.1 ELSE 0 END) WHEN mag_range > 80 AND mag_std > 20 THEN 0.55 ELSE 0.1 END)), 9, NULL FROM f WHERE (mag_range > 600 OR mag_std > 50 OR (mag_range > 80 AND mag_std > 20)) AND NOT (saturated > 0.3 OR all_high > 0.2))"""

QUERIES = {
    "hypothesis_order": (hypothesis_order, f"WITH {_H}, p AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY CASE WHEN onset > 0 THEN onset ELSE 'inf'::DOUBLE END, confidence DESC, failure_type) AS place FROM h) SELECT log_id, place, failure_type, confidence FROM p WHERE place <= 3"),
    "ranked_hits": (ranked_hits, f"WITH {_K} SELECT log_id, rank, failure_type FROM k"),
    "selected_hits": (selected_hits, f"WITH {_SEL} SELECT * FROM w"),
    "advised_hits": (advised_hits, f"WITH {_SEL} SELECT failure_type, CASE WHEN arbitrated THEN '[ARB] ' ELSE '' END || CASE failure_type {_ADVICE} END AS advice, count(*) AS n FROM w GROUP BY ALL"),
    "gated_hits": (gated_hits, f"WITH {flight._MERGED}, z AS (SELECT log_id FROM e GROUP BY log_id HAVING count(*) % 5 <> 0) SELECT log_id, failure_type FROM ml WHERE log_id NOT IN (SELECT log_id FROM z) OR log_id IN (SELECT log_id FROM hits WHERE confidence >= 0.6)"),
    "log_facts": (log_facts, f"WITH {_M}, b AS (SELECT log_id, arg_max(code, seq) AS code FROM m WHERE kind = 'MSG' AND code % 4 < 3 GROUP BY 1), f AS (SELECT log_id, count(*) AS n, count(DISTINCT kind) AS families, greatest(0, (arg_max(time_us, seq) - arg_min(time_us, seq)) / 1e6) AS duration, CASE {_BY_PARM} ELSE 'Unknown' END AS by_parm FROM m GROUP BY log_id) SELECT f.log_id, n, families, round(duration, 6) AS duration, coalesce(CASE b.code % 4 WHEN 0 THEN 'Copter' WHEN 1 THEN 'Rover' WHEN 2 THEN 'Sub' END, by_parm) AS vehicle, 'V4.' || (b.code % 10) AS version, NOT (duration = 0 AND families < 3) AS extracted FROM f LEFT JOIN b ON f.log_id = b.log_id"),
    "last_parameters": (last_parameters, f"WITH {_M} SELECT log_id, CASE code % 7 {_PARM} END AS name, arg_max((10 + code)::DOUBLE, seq) AS value FROM m WHERE kind = 'PARM' GROUP BY ALL"),
    "event_timeline": (event_timeline, f"""WITH {_M}, o AS (SELECT log_id, coalesce({", ".join(f"arg_min(time_us, seq) FILTER (WHERE kind = '{k}')" for k in ("VIBE", "GPS", "ERR", "MODE", "EV"))}) AS origin, coalesce(arg_max(time_us, seq) FILTER (WHERE kind = 'VIBE'), arg_max(time_us, seq) FILTER (WHERE kind = 'GPS'), max(time_us)) AS fin FROM m GROUP BY log_id),
u AS (SELECT m.log_id, time_us, seq, 'error' AS kind, coalesce(CASE code % 32 {_ERRORS[0]} END, 'Error') AS label, coalesce(CASE code % 32 {_ERRORS[1]} END, 'warning') AS severity FROM m WHERE kind = 'ERR'
UNION ALL SELECT log_id, time_us, seq, 'mode', 'Mode ' || (code % 10)::DOUBLE, CASE WHEN code % 3 <> 0 THEN 'warning' ELSE 'normal' END FROM m WHERE kind = 'MODE'
UNION ALL SELECT log_id, arg_min(time_us, seq), min(seq), 'vibe_spike', 'Vibration Spike', 'warning' FROM m WHERE kind = 'VIBE' AND value / 4 > 30 GROUP BY log_id
UNION ALL SELECT log_id, fin, 4611686018427387904, 'end', 'Log End', 'crash' FROM o),
t AS (SELECT u.log_id, round((time_us - origin) / 1e6, 2) AS t, u.kind, label, severity, seq FROM u JOIN o ON u.log_id = o.log_id WHERE origin IS NOT NULL)
SELECT log_id, t, kind, label, severity, row_number() OVER (PARTITION BY log_id ORDER BY t, seq, kind) AS place FROM t"""),
    "rescaled_series": (rescaled_series, f"WITH {flight._E}, m AS (SELECT log_id, max(value) AS top, sum(value) AS s FROM e GROUP BY 1) SELECT log_id, round(CASE WHEN top > 400 THEN s / 100 ELSE s END, 6) AS total FROM m"),
    "routed_columns": (routed_columns, "WITH o AS (SELECT o_totalprice AS p, ['Copter', 'Rover', 'Sub'][o_orderkey % 3 + 1] AS vehicle FROM orders) SELECT vehicle, round(sum(CASE WHEN vehicle <> 'Rover' THEN p ELSE 0 END), 2) AS vibe, round(sum(p / 2), 2) AS mag FROM o GROUP BY vehicle"),
    "damage_rules": (damage_rules, f"""WITH l AS (SELECT l_quantity AS q, l_discount AS d, l_extendedprice AS p, l_partkey % 1000 AS k FROM lineitem), f AS (SELECT {_ROW} FROM l), {_RULES},
x AS (SELECT *, greatest(ekf_vel_max, ekf_pos_max, ekf_mag_max) AS worst, (ekf_vel_max > 1.5)::INT + (ekf_pos_max > 1.5)::INT + (ekf_mag_max > 1.5)::INT AS fails, (ekf_vel_max > 1.05 AND ekf_vel_max <= 1.5)::INT + (ekf_pos_max > 1.05 AND ekf_pos_max <= 1.5)::INT + (ekf_mag_max > 1.05 AND ekf_mag_max <= 1.5)::INT AS warns FROM f),
y AS (SELECT 'ekf_failure' AS failure_type, greatest(CASE WHEN worst > 2.25 THEN 0.85 WHEN worst > 1.5 THEN 0.65 ELSE 0 END, CASE WHEN warns >= 2 THEN 0.55 ELSE 0 END, CASE WHEN fails >= 2 THEN 0.9 ELSE 0 END) + (CASE WHEN ekf_switches > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN ekf_bad > 0.1 THEN 0.1 ELSE 0 END) AS c FROM x WHERE (worst > 1.05 OR ekf_switches > 0 OR ekf_bad >= 0.1) AND (fails >= 2 OR ekf_switches > 0 OR worst >= 2.25)),
h AS (SELECT failure_type, least(1, c)::DOUBLE AS c, CASE WHEN coalesce(hard, false) OR least(1, c) > crit THEN 'critical' WHEN failure_type = 'compass_interference' AND c <= 0.5 THEN 'info' ELSE 'warning' END AS severity FROM r UNION ALL SELECT failure_type, least(1, c)::DOUBLE, CASE WHEN least(1, c) >= 0.8 THEN 'critical' ELSE 'warning' END FROM y WHERE c > 0)
SELECT failure_type, severity, round(c, 4) AS confidence, count(*) AS n FROM h GROUP BY ALL"""),
    "explained": (explained, None),
}
