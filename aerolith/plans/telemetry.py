"""Queries on feature families and the wider rules, with the driver's events as messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import diagnosis, features, rules
from aerolith.sources.messages import events

_KINDS = {"view": "VIBE", "click": "MAG", "purchase": "GPS", "signup": "ATT", "error": "CTUN"}
_FIELDS = {"VibeX": "value", "VibeY": "value / 2", "VibeZ": "value / 4", "Clip0": "code", "MagX": "value * 4", "MagY": "value * 2", "MagZ": "code", "HDop": "value / 15", "NSats": "code", "Status": "code % 5", "Roll": "value - 32", "Pitch": "value / 2 - 16", "DesRoll": "code", "ThO": "value / 70", "Alt": "value", "DAlt": "code", "CRt": "value / 8"}


def _messages(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    fields = F.create_map(*[x for name, sql in _FIELDS.items() for x in (F.lit(name), F.expr(sql).cast("double").cast("string"))])
    return events(spark, sf_dir).select("log_id", "seq", "time_us", kind[F.col("msg_type")].alias("msg_type"), fields.alias("fields"))


def _families(spark, sf_dir):
    return features.extracted(_messages(spark, sf_dir), families=["vibration", "compass", "gps", "attitude", "control"])


_SHOWN = ["vibe_x_mean", "vibe_y_max", "vibe_z_std", "vibe_clip", "vibe_onset", "mag_mean", "mag_range", "mag_onset", "gps_hdop", "gps_nsats_min", "gps_fix", "roll_std", "pitch_max", "roll_error", "throttle_mean", "alt_error_max", "climb_std", "throttle_sat"]


def feature_families(spark, sf_dir):
    return _families(spark, sf_dir).select("log_id", *[c if c.endswith("onset") else F.round(c, 9).alias(c) for c in _SHOWN])


_BOUND = {"roll_std": "alt_error_max / 4", "pitch_std": "roll_error / 4", "early_divergence": "pitch_max + roll_error", "time_to_crash": "gps_hdop * 3", "crashes": "floor(gps_nsats_min / 2)", "failsafes": "floor(vibe_clip / 300)", "radio_failsafe": "floor(vibe_clip / 600)", "rc_lost": "floor(gps_nsats_min / 3)", "long_loops": "vibe_clip", "load_mean": "mag_range / 4", "spread_std": "vibe_x_mean"}


def wider_rules(spark, sf_dir):
    """setup_error, rc_failsafe, crash, system load and tuning over rounded feature families."""
    rows = feature_families(spark, sf_dir).selectExpr("log_id", *[f"cast({sql} as double) as {n}" for n, sql in _BOUND.items()], "vibe_z_std as vibe_z_max", "throttle_sat / 4 as throttle_sat", "0D as saturated", "0D as internal_error", "climb_std as alt_error_std")
    own = {n: rules.MORE[n] for n in ("setup_error", "rc_failsafe", "crash", "system_load", "tuning")}
    hits = diagnosis.rule_hits(rows, "log_id", own)
    return hits.select("log_id", "failure_type", F.round("confidence", 6).alias("confidence"), "severity")


def _sql_features() -> str:
    kind = " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in _KINDS.items())
    fields = ", ".join(f"({sql})::DOUBLE AS {n}" for n, sql in _FIELDS.items())
    of = lambda fn, x, m: f"coalesce({fn}({x}) FILTER (WHERE m = '{m}'), 0)"
    onset = lambda cond, m: f"CASE WHEN count(*) FILTER (WHERE m = '{m}') = 0 THEN 0 ELSE coalesce(arg_min(time_us, seq) FILTER (WHERE m = '{m}' AND {cond}), -1) END::DOUBLE"
    mag = "sqrt(MagX * MagX + MagY * MagY + MagZ * MagZ)"
    cols = {"vibe_x_mean": of("avg", "VibeX", "VIBE"), "vibe_y_max": of("max", "VibeY", "VIBE"), "vibe_z_std": of("stddev_pop", "VibeZ", "VIBE"), "vibe_clip": of("sum", "coalesce(Clip0, 0)", "VIBE"), "vibe_onset": onset("VibeZ > 30", "VIBE"),
            "mag_mean": of("avg", mag, "MAG"), "mag_range": f"{of('max', mag, 'MAG')} - {of('min', mag, 'MAG')}", "mag_onset": onset(f"{mag} > 200", "MAG"), "gps_hdop": of("avg", "HDop", "GPS"), "gps_nsats_min": of("min", "NSats", "GPS"), "gps_fix": of("avg", "(Status >= 3)::INT", "GPS"),
            "roll_std": of("stddev_pop", "abs(Roll)", "ATT"), "pitch_max": of("max", "abs(Pitch)", "ATT"), "roll_error": of("avg", "abs(Roll - DesRoll)", "ATT"), "throttle_mean": of("avg", "ThO", "CTUN"), "alt_error_max": of("max", "abs(Alt - DAlt)", "CTUN"), "climb_std": of("stddev_pop", "CRt", "CTUN"), "throttle_sat": of("avg", "(ThO > 0.95)::INT", "CTUN")}
    return f"WITH b AS (SELECT user_id AS log_id, event_id AS seq, epoch_us(ts) AS time_us, event_type, value, json_extract_string(props, '$.k')::INT AS code FROM events), m AS (SELECT log_id, seq, time_us, CASE event_type {kind} END AS m, {fields} FROM b), f AS (SELECT log_id, " + ", ".join(f"{c if n.endswith('onset') else f'round({c}, 9)::DOUBLE'} AS {n}" for n, c in cols.items()) + " FROM m WHERE m IS NOT NULL GROUP BY log_id)"


def _sql_rules() -> str:
    bound = ", ".join(f"({sql})::DOUBLE AS {n}" for n, sql in _BOUND.items())
    axis = lambda x: f"(CASE WHEN {x} > 10 THEN 0.4 WHEN {x} > 5 THEN 0.25 ELSE 0 END)"
    return f"""{_sql_features()}, g AS (SELECT log_id, {bound}, vibe_z_std AS vibe_z_max, throttle_sat / 4 AS throttle_sat, climb_std AS alt_error_std FROM f),
r AS (SELECT log_id, 'setup_error' AS failure_type, greatest(0.4, (CASE WHEN early_divergence > 45 THEN 0.55 WHEN early_divergence > 20 THEN 0.35 ELSE 0 END) + (CASE WHEN time_to_crash > 0 AND time_to_crash < 5 THEN 0.35 WHEN time_to_crash >= 5 AND time_to_crash < 10 THEN 0.15 ELSE 0 END)) AS c, 0.6 AS crit FROM g WHERE early_divergence >= 20
UNION ALL SELECT log_id, 'rc_failsafe', least(1, (CASE WHEN radio_failsafe > 0 THEN 0.9 WHEN failsafes > 0 THEN 0.65 ELSE 0 END) + (CASE WHEN rc_lost > 0 THEN 0.15 ELSE 0 END)), -1 FROM g WHERE radio_failsafe > 0 OR failsafes > 0 OR rc_lost > 0
UNION ALL SELECT log_id, 'crash_unknown', CASE WHEN crashes >= 2 THEN 0.85 ELSE 0.7 END, 0.8 FROM g WHERE crashes >= 2 OR (crashes > 0 AND failsafes > 0)
UNION ALL SELECT log_id, 'mechanical_failure', 0.4::DOUBLE + 0.45::DOUBLE, 0.85 FROM g WHERE long_loops > 100 AND load_mean > 90
UNION ALL SELECT log_id, 'pid_tuning_issue', least(1, greatest(0.45, {axis('roll_std')} + {axis('pitch_std')} + (CASE WHEN spread_std < 30 THEN 0.1 ELSE 0 END) + (CASE WHEN alt_error_std > 2 THEN 0.15 ELSE 0 END))), 2 FROM g WHERE (roll_std > 5 OR pitch_std > 5) AND vibe_z_max <= 30 AND throttle_sat <= 0.2)
SELECT log_id, failure_type, round(c, 6)::DOUBLE AS confidence, CASE WHEN c > crit THEN 'critical' WHEN c > 0.3 THEN 'warning' ELSE 'info' END AS severity FROM r"""


QUERIES = {
    "feature_families": (feature_families, _sql_features() + " SELECT * FROM f"),
    "wider_rules": (wider_rules, _sql_rules()),
}
