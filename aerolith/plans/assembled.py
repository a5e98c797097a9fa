"""From messages of two firmwares and all vehicles to features, verdicts and warnings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import assembly, hybrid, logs
from aerolith.operators.diagnosis import PRIORITIES, ROUTES
from aerolith.sources.messages import events

from . import flight
from .hybrid import _RULES

_KINDS = ["VIBE", "MAG", "SUPPLY", "GPS", "RCOU", "RCOU", "RCOU", "EKF", "ATT", "ATT", "IMU", "CTUN", "PM", "POWR", "ERR", "MODE", "EV", "FTN1", "PARM", "PARM", "MSG", "RCOU"]
_PARAMETERS = [*(n for n, _ in logs.PARAMETERS), "BATT_LOW_VOLT", "MOT_THST_HOVER", "ATC_RAT_RLL_P", "OTHER"]
_BOOT = ["XCopter V4.1", "XRover V4.2", "Xsub V3.5", "Xplane V4.0", "Frame 7"]
# every third log has the older supply, of these every other one in hundredths; older estimators, both, and heights that
# only the other family has; every 29th log is a boot text without time
_OLD = "log_id % 3 = 0"
_FIELDS = {
    "VibeX": "value / 3", "VibeY": "value / 5", "VibeZ": "value / 4", "Clip0": "code % 3 * (log_id % 2)", "MagX": "value + 100", "MagY": "code * 3", "MagZ": "50",
    "Volt": "(12.6 - code / 50) * CASE WHEN log_id % 6 = 0 THEN 100 ELSE 1 END", "Curr": "value / 10 * CASE WHEN log_id % 6 = 0 THEN 100 ELSE 1 END", "HDop": "0.8 + code / 60", "NSats": "5 + code % 10", "Status": "2 + code % 3",
    "Alt": "CASE WHEN kind = 'GPS' AND log_id % 3 = 1 THEN NULL WHEN kind = 'CTUN' AND log_id % 4 = 0 THEN NULL ELSE 500 - (time_us / 1000000) % 400 END", "DAlt": "value / 20 + 50",
    "C1": "CASE WHEN log_id % 5 = 0 AND code > 20 THEN 1900 + code % 40 ELSE 1400 + code * 3 END", "C2": "CASE WHEN log_id % 5 = 0 AND code > 20 THEN 1910 ELSE 1500 + code END", "C3": "CASE WHEN log_id % 5 = 0 THEN 1950 ELSE 1450 + code * 2 END", "Ch4": "CASE WHEN log_id % 7 = 1 THEN NULL ELSE 1900 + code END", "C5": "700", "Cx": "9999",
    "PI": "code % 2", "SV": "value / 100", "SP": "code / 70", "SH": "value / 200", "SM": "code / 60", "SS": "CASE WHEN code % 5 = 0 THEN 15 ELSE 31 + 32 * (code % 2) END", "Roll": "code - 40", "Pitch": "code / 3", "DesRoll": "code / 2 - 20",
    "AccX": "value", "AccY": "code", "AccZ": "value - code", "GyrX": "code / 10", "GyrY": "code / 20", "GyrZ": "value / 9", "ThO": "code / 100", "ThH": "CASE WHEN code % 4 = 0 THEN NULL ELSE 0.3 + code / 500 END", "CRt": "value / 10",
    "NLon": "code % 7 * 20", "MaxT": "value * 10", "Load": "50 + code / 2", "IErr": "CASE WHEN log_id % 7 = 0 AND code > 50 THEN 1 ELSE 0 END", "Vcc": "4.3 + code / 80", "VServo": "5 + code / 50", "PkAvg": "value", "SnX": "code", "SnY": "code / 2", "SnZ": "code / 3",
    "Subsys": "code % 32", "Id": "CASE WHEN code % 3 = 0 THEN 19 ELSE code END", "Mode": "code % 10", "ModeNum": "CASE WHEN code % 2 = 0 THEN code % 10 ELSE NULL END", "Reason": "code % 3", "Value": "CASE WHEN code % 10 = 8 THEN 0.135 ELSE 10 + code % 3 END",
}
_KIND = f"CASE WHEN log_id % 29 = 0 THEN 'MSG' WHEN k = 'SUPPLY' THEN CASE WHEN {_OLD} THEN 'CURR' ELSE 'BAT' END WHEN k = 'EKF' THEN CASE WHEN log_id % 4 = 2 OR (log_id % 4 = 3 AND seq % 2 = 0) THEN 'NKF4' ELSE 'XKF4' END ELSE k END"
_TIME = "CASE WHEN log_id % 29 = 0 THEN NULL ELSE CAST(floor(time_us / 10000) AS BIGINT) END"


def _pick(names, at) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (at % len(names) + 1).cast("int"))


def messages(spark, sf_dir):
    """The driver's events as messages of two firmwares, all kinds of vehicles and some empty logs."""
    own = events(spark, sf_dir).withColumn("k", _pick(_KINDS, F.col("seq") * 7 + F.col("log_id"))).withColumn("kind", F.expr(_KIND)).withColumn("time_us", F.expr(_TIME))
    pairs = [x for n, e in _FIELDS.items() for x in (F.lit(n), F.expr(e).cast("double").cast("string"))]
    fields = F.map_filter(F.create_map(*pairs, F.lit("Name"), _pick(_PARAMETERS, F.col("code")), F.lit("Message"), _pick(_BOOT, F.col("code"))), lambda k, v: v.isNotNull())
    return own.select("log_id", "seq", "time_us", F.col("kind").alias("msg_type"), fields.alias("fields"))


def _scores(spark, sf_dir):
    """Which logs are outliers; of every tenth log it isn't known."""
    n = events(spark, sf_dir).groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where("log_id % 10 <> 0").select("log_id", (F.col("n") % 3 == 0).alias("is_outlier"))


def feature_matrix(spark, sf_dir):
    out = assembly.matrix(assembly.assembled(messages(spark, sf_dir)))
    return out.select("log_id", *[F.round(F.col(c) + 1e-7, 5).alias(c) for c in assembly.CATALOGUE])


def log_features(spark, sf_dir):
    out = assembly.assembled(messages(spark, sf_dir))
    return out.select("log_id", "vehicle", "version", "n", "families", "extracted", F.round("duration", 3).alias("duration"), F.round("thrust_onset", 3).alias("thrust_onset"), "thrust_descent")


def diagnosed(spark, sf_dir):
    """The whole way from messages to decisions: features, thirteen rules, the gate, fusion, onsets, arbitration."""
    rows, _ = hybrid.diagnosed(messages(spark, sf_dir), flight._model_hits(spark, sf_dir), _scores(spark, sf_dir))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["failure_type"]), ",")
    return rows.select("log_id", "vehicle", "status", "batch", "failure_type", F.round("confidence", 5).alias("confidence"), F.array_join("reasons", ",").alias("reasons"), "why", "arbitrated", names("final").alias("final"), names("hypotheses").alias("hypotheses"))


def parameter_warnings(spark, sf_dir):
    own = logs.timed(messages(spark, sf_dir))
    return assembly.parameter_warnings(assembly.assembled(own), logs.parameters(own))


def _value(field: str, kind: str) -> str:
    return f"CASE WHEN kind = '{kind}' THEN coalesce(f_{field}, 0) END"


def _has(kind: str) -> str:
    return f"count(*) FILTER (WHERE kind = '{kind}') > 0"


def _either(kinds, made) -> str:
    return "CASE " + " ".join(f"WHEN {_has(k)} THEN {made(k)}" for k in kinds) + " END"


def _onset(kind: str, holds: str) -> str:
    return f"CASE WHEN {_has(kind)} THEN coalesce(arg_min(time_us, seq) FILTER (WHERE kind = '{kind}' AND {holds}), -1) END"


def _feature_sql() -> dict[str, str]:
    v = _value
    out = {f"vibe_{a}_{n}": f"{fn}({v('Vibe' + a.upper(), 'VIBE')})" for a in "xyz" for n, fn in (("mean", "avg"), ("max", "max"))}
    out |= {"vibe_z_std": f"stddev_pop({v('VibeZ', 'VIBE')})", "vibe_clip": f"sum({v('Clip0', 'VIBE')})", "vibe_onset": _onset("VIBE", "f_VibeZ > 30")}
    field = "CASE WHEN kind = 'MAG' THEN sqrt(f_MagX * f_MagX + f_MagY * f_MagY + f_MagZ * f_MagZ) END"
    out |= {"mag_mean": f"avg({field})", "mag_max": f"max({field})", "mag_range": f"max({field}) - min({field})", "mag_std": f"stddev_pop({field})", "mag_x_range": f"max({v('MagX', 'MAG')}) - min({v('MagX', 'MAG')})", "mag_y_range": f"max({v('MagY', 'MAG')}) - min({v('MagY', 'MAG')})", "mag_onset": _onset("MAG", "sqrt(f_MagX * f_MagX + f_MagY * f_MagY + f_MagZ * f_MagZ) > 200")}
    for name, f in (("volt", "Volt"), ("curr", "Curr")):
        out |= {f"{name}_{n}": _either(("BAT", "CURR"), lambda k, fn=fn, f=f: f"{fn}({v(f, k)})") for n, fn in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_pop"))}
    out |= {"gps_hdop": f"avg({v('HDop', 'GPS')})", "gps_hdop_max": f"max({v('HDop', 'GPS')})", "gps_nsats": f"avg({v('NSats', 'GPS')})", "gps_nsats_min": f"min({v('NSats', 'GPS')})", "gps_fix": "avg(CASE WHEN kind = 'GPS' THEN (f_Status >= 3)::INT END)", "gps_onset": _onset("GPS", "f_HDop > 2")}
    for a in ("Roll", "Pitch"):
        out |= {f"{a.lower()}_{n}": f"{fn}(abs({v(a, 'ATT')}))" for n, fn in (("std", "stddev_pop"), ("max", "max"))}
    out["roll_error"] = "avg(CASE WHEN kind = 'ATT' THEN abs(f_Roll - f_DesRoll) END)"
    both = ("XKF4", "NKF4")
    out |= {f"ekf_{n}_{k}": _either(both, lambda m, f=f, fn=fn: f"{fn}({v(f, m)})") for n, f in (("vel", "SV"), ("pos", "SP"), ("hgt", "SH"), ("mag", "SM")) for k, fn in (("mean", "avg"), ("max", "max"))}
    out |= {"ekf_bad": _either(both, lambda m: f"avg(CASE WHEN kind = '{m}' THEN ((f_SS::INT & 31) <> 31)::INT END)"), "ekf_onset": _either(both, lambda m: _onset(m, "f_SP > 1"))}
    out |= {f"{n}_{a}_std": f"stddev_pop({v(f + a.upper(), 'IMU')})" for n, f in (("acc", "Acc"), ("gyr", "Gyr")) for a in "xyz"}
    error = "CASE WHEN kind = 'CTUN' THEN abs(f_DAlt - coalesce(f_Alt, 0)) END"
    out |= {"throttle_mean": f"avg({v('ThO', 'CTUN')})", "hover_ratio": f"avg({v('ThO', 'CTUN')}) / nullif(avg(CASE WHEN kind = 'CTUN' THEN f_ThH END), 0)", "alt_error_max": f"max({error})", "alt_error_std": f"stddev_pop({error})", "climb_std": f"stddev_pop({v('CRt', 'CTUN')})", "throttle_sat": "avg(CASE WHEN kind = 'CTUN' THEN (f_ThO > 0.95)::INT END)"}
    system = {"long_loops": f"sum({v('NLon', 'PM')})", "loop_max": f"max({v('MaxT', 'PM')})", "load_mean": f"avg({v('Load', 'PM')})", "internal_error": "max(CASE WHEN kind = 'PM' THEN (f_IErr > 0)::INT END)", "vcc_min": f"min({v('Vcc', 'POWR')})", "vcc_range": f"max({v('Vcc', 'POWR')}) - min({v('Vcc', 'POWR')})", "vservo_min": f"min({v('VServo', 'POWR')})"}
    out |= {n: f"CASE WHEN {_has('PM')} THEN {e} END" for n, e in system.items()}
    out |= {"peak_mean": f"avg({v('PkAvg', 'FTN1')})", "noise_x": f"avg({v('SnX', 'FTN1')})", "noise_y": f"avg({v('SnY', 'FTN1')})", "noise_z": f"avg({v('SnZ', 'FTN1')})", "noise_floor": "0"}
    n = lambda w: f"count(*) FILTER (WHERE {w})"
    mode = "kind = 'MODE' AND coalesce(f_ModeNum, f_Mode)::INT IN (6, 9)"
    out |= {"errors": n("kind = 'ERR'"), "failsafes": n("kind = 'ERR' AND f_Subsys::INT IN (5, 6, 8, 9, 17, 20, 23, 26, 27, 29, 31)"), "mode_changes": n("kind = 'MODE'"), "unexpected_modes": n(f"{mode} AND f_Reason::INT <> 0"), "crashes": f"({n("kind = 'ERR' AND f_Subsys::INT = 12")} > 0)::INT", "gps_lost": n("kind = 'EV' AND f_Id::INT = 19"), "rc_lost": n(f"{mode} AND f_Reason::INT = 2"), "radio_failsafe": n("kind = 'ERR' AND f_Subsys::INT = 5")}
    return out


_GONE = {"vibration": [f"vibe_{x}" for x in ("x_mean", "y_mean", "z_mean", "x_max", "y_max", "z_max", "z_std", "clip", "onset")], "gps": ["gps_hdop", "gps_hdop_max", "gps_nsats", "gps_nsats_min", "gps_fix", "gps_onset"], "control": ["throttle_mean", "hover_ratio", "alt_error_max", "alt_error_std", "climb_std", "throttle_sat"], "spectrum": ["peak_mean", "noise_x", "noise_y", "noise_z"], "motors": assembly.MOTORS}


def _assembled_sql() -> str:
    listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    fields = ", ".join(f"({e})::DOUBLE AS f_{n}" for n, e in _FIELDS.items())
    kinds = " | ".join(f"max((kind = '{k}')::INT) * {1 << i}" for i, k in enumerate(assembly.KEPT))
    parm = lambda n: f"arg_max(f_Value, seq) FILTER (WHERE kind = 'PARM' AND pname = '{n}')"
    has = " ".join(f"WHEN count(*) FILTER (WHERE kind = 'PARM' AND pname = '{n}') > 0 THEN '{kind}'" for n, kind in logs.PARAMETERS)
    features = ",\n ".join(f"{e} AS {n}" for n, e in _feature_sql().items())
    older = "NOT new AND old"
    scale = lambda c, limit: f"CASE WHEN {older} AND {c}_max > {limit} THEN 100 ELSE 1 END"
    supply = ", ".join(f"{c}_{k} / {scale(c, limit)} AS {c}_{k}" for c, limit in (("volt", 100), ("curr", 500)) for k in ("mean", "max", "min", "std"))
    columns = sorted(set(assembly.CATALOGUE.values()) | {"thrust_onset", "thrust_descent"})

    def routed(c: str) -> str:
        gone = [f"'{v}'" for v, left in (("Rover", ["vibration", "motors", "control", "spectrum"]), ("Sub", ["gps", "motors", "control", "spectrum"])) for f in left if c in _GONE[f]]
        return f"CASE WHEN vehicle IN ({', '.join(gone)}) THEN 0 ELSE coalesce({c}, 0) END::DOUBLE AS {c}" if gone else f"coalesce({c}, 0)::DOUBLE AS {c}"

    return f"""{flight._E},
m0 AS (SELECT log_id, seq, value, code, {_TIME} AS time_us, {_KIND} AS kind, {listed(_PARAMETERS)}[code % {len(_PARAMETERS)} + 1] AS pname, {listed(_BOOT)}[code % {len(_BOOT)} + 1] AS text FROM (SELECT *, {listed(_KINDS)}[(seq * 7 + log_id) % {len(_KINDS)} + 1] AS k FROM e)),
m AS MATERIALIZED (SELECT log_id, seq, kind, pname, text, coalesce(time_us, 0) AS time_us, {fields} FROM m0),
b AS (SELECT log_id, arg_max(text, seq) AS boot FROM m WHERE kind = 'MSG' AND text NOT LIKE 'Frame%' GROUP BY log_id),
a AS MATERIALIZED (SELECT log_id, count(*) AS n, bit_count(({kinds})::BIGINT) AS families, greatest(0, (arg_max(time_us, seq) - arg_min(time_us, seq)) / 1e6) AS duration, CASE {has} ELSE 'Unknown' END AS by_parm,
 {parm("BATT_LOW_VOLT")} AS low, {parm("MOT_THST_HOVER")} AS hover, {_has("BAT")} AS new, {_has("CURR")} AS old, arg_min(time_us, seq) FILTER (WHERE kind = 'RCOU') AS t_motor, arg_min(time_us, seq) FILTER (WHERE kind = 'ATT') AS t_tilt,
 count(*) FILTER (WHERE kind = 'GPS' AND f_Alt IS NOT NULL) > 0 AS by_gps,
 {features} FROM m GROUP BY log_id),
r AS MATERIALIZED (SELECT log_id, seq, time_us, list_max(c) AS most, list_min(c) AS least, len(c) AS width, list_sum(c) AS total, list_sum(list_transform(c, lambda x: x * x)) AS squares, len(c) >= 4 AND list_min(c) >= 1900 AS pegged
 FROM (SELECT log_id, seq, time_us, list_filter([f_C1, f_C2, f_C3, f_Ch4, f_C5], lambda x: x > 800) AS c FROM m WHERE kind = 'RCOU') WHERE len(c) > 0),
mo AS (SELECT log_id, avg(most - least) FILTER (WHERE late) AS spread_mean, max(most - least) FILTER (WHERE late) AS spread_max, stddev_pop(most - least) FILTER (WHERE late) AS spread_std, sum(total) / sum(width) AS output_mean, sqrt(greatest(0, sum(squares) / sum(width) - (sum(total) / sum(width)) ** 2)) AS output_std, max(most) AS output_max,
 coalesce(arg_min(time_us, seq) FILTER (WHERE late AND most - least > 400), -1) AS spread_onset, avg((most > 1900)::INT) AS saturated, avg((width >= 4 AND least > 1800)::INT) AS all_high FROM (SELECT r.*, r.time_us >= t_motor + 10000000 AS late FROM r JOIN a USING (log_id)) GROUP BY log_id),
ru AS (SELECT *, sum((NOT pegged)::INT) OVER (PARTITION BY log_id ORDER BY seq) AS run FROM r),
rb AS (SELECT log_id, run, arg_min(time_us, seq) AS began FROM ru WHERE pegged GROUP BY ALL),
h AS (SELECT m.log_id, m.time_us, m.seq, coalesce(f_Alt, CASE WHEN kind = 'CTUN' THEN f_DAlt END) AS alt FROM m JOIN a USING (log_id) WHERE kind = CASE WHEN by_gps THEN 'GPS' ELSE 'CTUN' END AND coalesce(f_Alt, CASE WHEN kind = 'CTUN' THEN f_DAlt END) IS NOT NULL),
th AS (SELECT log_id, arg_min(began, seq) AS thrust FROM (SELECT ru.log_id, ru.seq, began, arg_min(alt, (h.time_us, h.seq)) AS a0, arg_max(alt, (h.time_us, h.seq)) AS a1 FROM ru JOIN rb USING (log_id, run) JOIN h ON h.log_id = ru.log_id AND h.time_us BETWEEN began AND ru.time_us WHERE pegged AND ru.time_us - began >= 3000000 GROUP BY ALL) WHERE a1 < a0 - 1 GROUP BY log_id),
ti AS (SELECT m.log_id, max(abs(f_Roll - f_DesRoll)) FILTER (WHERE time_us <= t_tilt + 5000000) AS early_divergence, coalesce(arg_min((time_us - t_tilt) / 1e6, seq) FILTER (WHERE greatest(abs(f_Roll), abs(f_Pitch)) > 60), -1) AS time_to_crash FROM m JOIN a USING (log_id) WHERE kind = 'ATT' GROUP BY m.log_id),
la AS (SELECT log_id, kind, count(*) FILTER (WHERE c) AS n FROM (SELECT log_id, kind, f_PI <> lag(f_PI) OVER (PARTITION BY log_id, kind ORDER BY seq) AS c FROM m WHERE kind IN ('XKF4', 'NKF4')) GROUP BY ALL),
sw AS (SELECT log_id, arg_max(n, kind) AS ekf_switches FROM la GROUP BY log_id),
vo AS (SELECT m.log_id, coalesce(arg_min(time_us, seq) FILTER (WHERE f_Volt < a.volt_mean - 2 * a.volt_std), -1) AS volt_onset FROM m JOIN a USING (log_id) WHERE kind = CASE WHEN new THEN 'BAT' ELSE 'CURR' END GROUP BY m.log_id),
j AS (SELECT a.* EXCLUDE (volt_mean, volt_max, volt_min, volt_std, curr_mean, curr_max, curr_min, curr_std), {supply}, mo.* EXCLUDE (log_id), early_divergence, time_to_crash, ekf_switches, volt_onset, coalesce(thrust, -1) AS thrust_onset, CASE WHEN thrust IS NOT NULL THEN 1 ELSE 0 END AS thrust_descent,
 coalesce(CASE WHEN boot LIKE 'XC%' THEN 'Copter' WHEN boot LIKE 'XR%' THEN 'Rover' WHEN boot LIKE 'Xs%' THEN 'Sub' WHEN boot LIKE 'Xp%' THEN 'Plane' END, by_parm) AS vehicle, split_part(boot, ' ', 2) AS version
 FROM a LEFT JOIN mo USING (log_id) LEFT JOIN ti USING (log_id) LEFT JOIN sw USING (log_id) LEFT JOIN vo USING (log_id) LEFT JOIN th USING (log_id) LEFT JOIN b USING (log_id)),
f0 AS (SELECT *, volt_max - volt_min AS volt_range, (volt_max - volt_min) / nullif(volt_max, 0) AS volt_sag, CASE WHEN volt_min > 0 THEN volt_min - low END AS volt_margin, CASE WHEN hover > 0 THEN output_mean / hover END AS motor_hover_ratio, NOT (duration = 0 AND families < 3) AS extracted FROM j),
f AS MATERIALIZED (SELECT log_id, vehicle, version, n, families, duration, extracted, {", ".join(routed(c) for c in columns)} FROM f0)"""


def _rules_sql() -> str:
    """What the thirteen rules say, as hits (log_id, failure_type, confidence, rule)."""
    own = _RULES.replace("(SELECT '", "(SELECT log_id, '", 1).replace("UNION ALL SELECT ", "UNION ALL SELECT log_id, ")
    named = {"mechanical_failure": "mechanical", "motor_imbalance": "imbalance", "pid_tuning_issue": "imbalance", "thrust_loss": "thrust_loss", "compass_interference": "compass"}
    step = lambda c, *s: "CASE " + " ".join(f"WHEN {c} > {b} THEN {v}" for b, v in s) + " ELSE 0 END"
    add = lambda w, v: f"CASE WHEN {w} THEN {v} ELSE 0 END"
    more = {
        ("vibration_high", "vibration_high"): ("greatest(vibe_x_max, vibe_y_max, vibe_z_max) > 30 OR vibe_clip > 0", " + ".join([step(f"vibe_{a}_max", (60, 0.2), (30, 0.1)) for a in "xyz"] + [add("vibe_clip > 0", 0.3), add("vibe_clip > 100", 0.2)])),
        ("gps_quality_poor", "gps_quality_poor"): ("gps_hdop <> 0 OR gps_nsats <> 0 OR gps_fix <> 0", " + ".join([add("gps_hdop > 2", 0.4), add("gps_nsats_min > 0 AND gps_nsats_min < 6", 0.5), add("gps_fix < 0.95", 0.6), add("gps_lost > 0", 0.8)])),
        ("CASE WHEN vcc_min > 0 AND vcc_min < 4.5 THEN 'brownout' ELSE 'power_instability' END", "power_instability"): ("true", " + ".join([add("volt_range > 2", 0.5), add("vcc_min > 0 AND vcc_min < 4.5", 0.8), add("volt_margin > 0 AND volt_margin < 0.5", 0.4), add("volt_min > 0 AND volt_min < 10", 0.3), step("volt_sag", (0.08, 0.35), (0.05, 0.2)), add("volt_std > 0.8 AND curr_max > 20", 0.15)])),
        ("setup_error", "setup_error"): ("early_divergence >= 20", f"greatest(0.4, {step('early_divergence', (45, 0.55), (20, 0.35))} + {add('time_to_crash > 0 AND time_to_crash < 5', 0.35)} + {add('time_to_crash >= 5 AND time_to_crash < 10', 0.15)})"),
        ("mechanical_failure", "system_load"): ("internal_error > 0 OR (long_loops > 100 AND load_mean > 90)", f"greatest(0.7, {add('long_loops > 100', 0.4)} + {add('load_mean > 90', 0.45)} + {add('internal_error > 0', 0.7)})"),
        ("rc_failsafe", "rc_failsafe"): ("radio_failsafe > 0 OR failsafes > 0 OR rc_lost > 0", f"CASE WHEN radio_failsafe > 0 THEN 0.9 WHEN failsafes > 0 THEN 0.65 ELSE 0 END + {add('rc_lost > 0', 0.15)}"),
        ("crash_unknown", "crash"): ("crashes >= 2 OR (crashes > 0 AND failsafes > 0)", "CASE WHEN crashes >= 2 THEN 0.85 ELSE 0.7 END"),
        ("pid_tuning_issue", "tuning"): ("(roll_std > 5 OR pitch_std > 5) AND NOT (vibe_z_max > 30 OR throttle_sat > 0.2 OR saturated > 0.2)", f"greatest(0.45, {step('roll_std', (10, 0.4), (5, 0.25))} + {step('pitch_std', (10, 0.4), (5, 0.25))} + {add('spread_std < 30', 0.1)} + {add('alt_error_std > 2', 0.15)})"),
    }
    arms = [f"SELECT log_id, {t if t.startswith('CASE') else repr(t)} AS failure_type, least(1, {c})::DOUBLE AS confidence, '{rule}' AS rule FROM f WHERE ({gate})" for (t, rule), (gate, c) in more.items()]
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in named.items())
    arms.append(f"SELECT log_id, failure_type, least(1, c)::DOUBLE, CASE failure_type {known} END FROM r1")
    arms.append("SELECT log_id, 'ekf_failure', least(1, greatest(CASE WHEN worst > 2.25 THEN 0.85 WHEN worst > 1.5 THEN 0.65 ELSE 0 END, CASE WHEN warns >= 2 THEN 0.55 ELSE 0 END, CASE WHEN fails >= 2 THEN 0.9 ELSE 0 END) + (CASE WHEN ekf_switches > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN ekf_bad > 0.1 THEN 0.1 ELSE 0 END))::DOUBLE, 'ekf' FROM x1 WHERE (worst > 1.05 OR ekf_switches > 0 OR ekf_bad >= 0.1) AND (fails >= 2 OR ekf_switches > 0 OR worst >= 2.25)")
    out = " OR ".join(f"(lower(vehicle) = '{v}' AND rule NOT IN ({', '.join(repr(n) for n in names)}))" for v, names in ROUTES.items())
    return own.strip().replace("r AS (", "r1 AS (", 1) + f""",
x1 AS (SELECT *, greatest(ekf_vel_max, ekf_pos_max, ekf_mag_max) AS worst, (ekf_vel_max > 1.5)::INT + (ekf_pos_max > 1.5)::INT + (ekf_mag_max > 1.5)::INT AS fails, (ekf_vel_max > 1.05 AND ekf_vel_max <= 1.5)::INT + (ekf_pos_max > 1.05 AND ekf_pos_max <= 1.5)::INT + (ekf_mag_max > 1.05 AND ekf_mag_max <= 1.5)::INT AS warns FROM f),
ha AS ({" UNION ALL ".join(arms)}),
hr AS MATERIALIZED (SELECT ha.log_id, failure_type, min(confidence) AS rule_c FROM ha JOIN f USING (log_id) WHERE confidence > 0 AND extracted AND NOT ({out}) GROUP BY ALL)"""


def _verdict_sql() -> str:
    first = " ".join(f"WHEN '{t}' THEN {p}" for t, p in PRIORITIES.items())
    onset = " ".join(f"WHEN '{t}' THEN {c}" for t, c in hybrid.ONSETS.items())
    return f"""ev AS (SELECT log_id, count(*) AS n, max(value) AS top FROM e GROUP BY log_id),
ml AS (SELECT log_id, CASE WHEN n % 2 = 0 THEN 'vibration_high' ELSE 'ekf_failure' END AS failure_type, least(1, top / 100)::DOUBLE AS ml_c FROM ev WHERE log_id IN (SELECT log_id FROM f WHERE extracted) AND (log_id IN (SELECT log_id FROM hr) OR (log_id % 10 <> 0 AND n % 3 = 0))),
p AS (SELECT log_id, failure_type, coalesce(rule_c, 0) AS rule_c, coalesce(ml_c, 0) AS ml_c FROM hr FULL JOIN ml USING (log_id, failure_type)),
q AS MATERIALIZED (SELECT p.*, round(least(1, CASE WHEN rule_c > 0 AND ml_c > 0 THEN 0.65 * ml_c + 0.35 * rule_c ELSE 0.85 * greatest(rule_c, ml_c) END)::DOUBLE, 9) AS c, CASE WHEN rule_c > 0 AND ml_c > 0 THEN 'rule+ml' WHEN rule_c > 0 THEN 'rule' ELSE 'ml' END AS method, CASE failure_type {onset} ELSE -1 END AS onset FROM p JOIN f USING (log_id)),
hy AS (SELECT log_id, string_agg(failure_type, ',' ORDER BY CASE WHEN onset > 0 THEN onset ELSE 'inf'::DOUBLE END, CASE WHEN c >= 0.45 THEN c ELSE round(greatest(rule_c, ml_c)::DOUBLE, 9) END DESC, failure_type) AS hypotheses FROM q GROUP BY log_id),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY c DESC, CASE method WHEN 'rule+ml' THEN 0 WHEN 'ml' THEN 1 ELSE 2 END, CASE failure_type {first} ELSE 0 END DESC, failure_type) AS rank, count(*) OVER (PARTITION BY log_id) AS cnt FROM q WHERE c >= 0.45),
g AS (SELECT log_id, list({{'o': onset, 'm': -c, 'k': rank, 'l': failure_type}} ORDER BY onset, -c, rank) AS t FROM k WHERE onset > 0 AND cnt > 1 GROUP BY log_id),
ca AS (SELECT log_id, t, (list_reduce(t, lambda b, x: CASE WHEN (x.o - t[1].o <= 5e6 AND -x.m > -b.m) OR (x.o - t[1].o <= 3e7 AND -x.m >= 0.85 AND -x.m > -b.m + 0.15) THEN x ELSE b END)).l AS cause FROM g),
w AS (SELECT k.*, cause, t, coalesce(failure_type = cause, rank = 1) AS leads, max(c) OVER (PARTITION BY k.log_id) AS best FROM k LEFT JOIN ca USING (log_id)),
s AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY leads DESC, rank) AS place FROM w WHERE leads OR (method = 'rule' AND c > 0.6) OR (cause IS NULL AND best - c <= 0.1 AND (method = 'rule' OR c >= 0.7))),
fi AS (SELECT log_id, string_agg(failure_type, ',' ORDER BY place) AS final, max(c) FILTER (WHERE place = 1) AS c1, max(c) FILTER (WHERE place = 2) AS c2, max(method) FILTER (WHERE place = 1) AS m1, max(failure_type) FILTER (WHERE place = 1) AS failure_type, count(*) FILTER (WHERE c >= 0.5) AS strong, any_value(cause) AS cause, any_value(t) AS t FROM s WHERE place <= 2 GROUP BY log_id),
d AS (SELECT f.log_id, vehicle, extracted, fi.* EXCLUDE (log_id), coalesce(hypotheses, '') AS hypotheses, concat_ws(',', CASE WHEN c1 < 0.65 THEN 'low_confidence' END, CASE WHEN c1 - c2 < 0.15 THEN 'close_second' END, CASE WHEN strong > 1 THEN 'several_strong' END, CASE WHEN m1 = 'ml' AND c1 < 0.75 THEN 'model_only' END) AS reasons FROM f LEFT JOIN fi USING (log_id) LEFT JOIN hy USING (log_id))
SELECT log_id, vehicle, CASE WHEN NOT extracted THEN 'not_extracted' WHEN c1 IS NULL THEN 'healthy' WHEN reasons <> '' THEN 'uncertain' ELSE 'confirmed' END AS status, CASE WHEN NOT extracted THEN 'ERROR' WHEN c1 IS NULL THEN 'HEALTHY' WHEN c1 > 0.6 THEN 'CRITICAL' ELSE 'WARNING' END AS batch, failure_type, round(c1, 5) AS confidence, reasons,
 CASE WHEN len(t) > 1 THEN cause || ' ' || printf('%.1f', (t[2].o - t[1].o) / 1e6) || ' s before ' || t[2].l WHEN cause IS NOT NULL THEN 'earliest onset' WHEN c1 IS NOT NULL THEN 'surest' ELSE 'nothing is sure enough' END AS why, cause IS NOT NULL AS arbitrated, coalesce(final, '') AS final, hypotheses FROM d"""


_F = _assembled_sql()
QUERIES = {
    "feature_matrix": (feature_matrix, f"WITH {_F} SELECT log_id, " + ", ".join(f"round({c} + 1e-7, 5) AS {n}" for n, c in assembly.CATALOGUE.items()) + " FROM f"),
    "log_features": (log_features, f"WITH {_F} SELECT log_id, vehicle, version, n, families::INT AS families, extracted, round(duration, 3) AS duration, thrust_onset, thrust_descent FROM f"),
    "diagnosed": (diagnosed, f"WITH {_F}, {_rules_sql()}, {_verdict_sql()}"),
    "parameter_warnings": (parameter_warnings, f"WITH {_F}, lp AS (SELECT log_id, pname AS name, arg_max(f_Value, seq) AS value FROM m WHERE kind = 'PARM' GROUP BY ALL) SELECT log_id, name, value FROM lp JOIN f USING (log_id) WHERE name IN ('ATC_RAT_RLL_P', 'ATC_RAT_PIT_P') AND value = 0.135 AND vehicle = 'Copter' AND (vibe_z_max >= 30 OR roll_std >= 8 OR pitch_std >= 8)"),
}
