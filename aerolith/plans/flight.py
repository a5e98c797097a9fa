"""Queries on telemetry: statistics, sequences, rules and decisions, on the driver's events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import diagnosis, series
from aerolith.sources.messages import events

_E = "e AS (SELECT user_id AS log_id, event_id AS seq, epoch_us(ts) AS time_us, event_type AS msg_type, value, json_extract_string(props, '$.k')::INT AS code FROM events)"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def series_stats(spark, sf_dir):
    return _rounded(series.stats(events(spark, sf_dir), "log_id", "value", "time_us", "seq", 90.0), "mean", "std", "max", "min", "range")


def series_adaptive(spark, sf_dir):
    out = series.stats(events(spark, sf_dir), "log_id", "value", "time_us", "seq", None, above=True, sigmas=1.5)
    return _rounded(out.select("log_id", "mean", "std", "onset"), "mean", "std")


def family_counts(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("msg_type").isin("click", "view", "error")).groupBy("log_id", "msg_type").agg(F.count(F.lit(1)).alias("n"))


def change_counts(spark, sf_dir):
    return series.change_count(events(spark, sf_dir), "log_id", "msg_type", ["time_us", "seq"])


def early_window(spark, sf_dir):
    return _rounded(series.early_maximum(events(spark, sf_dir), "log_id", F.abs("value"), "time_us", "seq", 86400.0, 95.0), "early_max", "first_over")


def sustained(spark, sf_dir):
    return series.sustained_runs(events(spark, sf_dir), "log_id", F.col("value") > 20.0, "time_us", ["time_us", "seq"]).where("rows >= 3")


def window_slices(spark, sf_dir):
    out = series.slices(events(spark, sf_dir), "log_id", "time_us", 172_800_000_000, 86_400_000_000)
    return out.groupBy("log_id", "window").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("msg_type").alias("families")).where("families >= 3")


def downsample(spark, sf_dir):
    return series.downsampled(events(spark, sf_dir), "log_id", ["time_us", "seq"], 10).select("log_id", "seq")


def nearest_point(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("msg_type = 'error'").select("log_id", "seq", "time_us")
    right = e.where("msg_type = 'view'").select("log_id", F.col("seq").alias("at"), "time_us", "value")
    return series.nearest(left, right, "log_id", "time_us", "value", "at").select("log_id", "seq", F.round("nearest", 6).alias("nearest"))


def _candidates(spark, sf_dir):
    """Hits with onsets: per log and kind of event the first time over 30, an hour of the log for a second of a flight."""
    e = events(spark, sf_dir).where("value > 30")
    first = e.groupBy("log_id", F.col("msg_type").alias("failure_type")).agg(F.min("time_us").alias("t"), F.round(F.max("value") / 100, 6).alias("confidence"))
    begin = e.groupBy("log_id").agg(F.min("time_us").alias("t0"))
    return first.join(begin, "log_id").select("log_id", "failure_type", ((F.col("t") - F.col("t0")) / 3600 + 1e6).alias("onset"), "confidence")


def arbitration(spark, sf_dir):
    return _rounded(series.arbitrated(_candidates(spark, sf_dir).withColumnRenamed("failure_type", "label"), "log_id"), "onset", "earliest")


def lookup(spark, sf_dir):
    e, n = events(spark, sf_dir).select("code"), _t(spark, sf_dir, "nation")
    named = e.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), F.col("code") == F.col("n_nationkey"), "left")
    return named.select(F.coalesce("n_name", F.concat(F.lit("UNKNOWN_"), F.col("code").cast("string"))).alias("name"), "n")


def channel_spread(spark, sf_dir):
    own = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"), F.avg((F.col("l_quantity") > 45).cast("double")).alias("saturated"), F.count(F.lit(1)).alias("channels"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return _rounded(own.join(o, own["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("log_id")).agg(F.avg(F.col("hi") - F.col("lo")).alias("spread_mean"), F.max(F.col("hi") - F.col("lo")).alias("spread_max"), F.avg(((F.col("channels") >= 4) & (F.col("lo") > 10)).cast("double")).alias("all_high")), "spread_mean", "spread_max", "all_high")


def feature_rows(spark, sf_dir):
    """Events as features of the rules: one conditional aggregation."""
    e, v = events(spark, sf_dir), F.col("value")
    of = lambda kind, fn: F.coalesce(fn(F.when(F.col("msg_type") == kind, v)), F.lit(0.0))
    return e.groupBy("log_id").agg(
        of("view", F.max).alias("vibe_x_max"), of("click", F.max).alias("vibe_y_max"), of("purchase", F.max).alias("vibe_z_max"), F.count_if(v > 80).cast("double").alias("vibe_clip"),
        (of("signup", F.avg) / 10).alias("gps_hdop"), F.countDistinct("code").cast("double").alias("gps_nsats"), F.countDistinct("code").cast("double").alias("gps_nsats_min"), F.avg((v > 1).cast("double")).alias("gps_fix"), F.lit(0.0).alias("gps_lost"),
        ((of("error", F.max) - of("error", F.min)) / 40).alias("volt_range"), (of("error", F.min) + 8).alias("volt_min"), F.lit(5.0).alias("vcc_min"), F.lit(1.0).alias("volt_margin"), F.lit(0.03).alias("volt_sag"), ((of("error", F.max) - of("error", F.min)) / 80).alias("volt_std"), of("purchase", F.max).alias("curr_max"))


def rules_fired(spark, sf_dir):
    return _rounded(diagnosis.rule_hits(feature_rows(spark, sf_dir), "log_id"), "confidence").select("log_id", "failure_type", "confidence", "severity")


def _model_hits(spark, sf_dir):
    e = events(spark, sf_dir)
    top = e.groupBy("log_id").agg(F.max("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return top.select("log_id", F.when(F.col("n") % 2 == 0, "vibration_high").otherwise("ekf_failure").alias("failure_type"), F.least(F.lit(1.0), F.col("m") / 100).alias("confidence"))


def fused(spark, sf_dir):
    return _rounded(diagnosis.merged(diagnosis.rule_hits(feature_rows(spark, sf_dir), "log_id"), _model_hits(spark, sf_dir), "log_id"), "confidence")


def decided(spark, sf_dir):
    features = feature_rows(spark, sf_dir)
    hits = diagnosis.merged(diagnosis.rule_hits(features, "log_id"), _model_hits(spark, sf_dir), "log_id")
    return _rounded(diagnosis.decisions(hits.withColumn("confidence", F.round("confidence", 6)), features, "log_id").withColumn("reasons", F.array_join("reasons", ",")), "confidence")


def flagship(spark, sf_dir):
    """Per log: since when its vibration is high, the longest run of it, and how sure we are."""
    e = events(spark, sf_dir)
    stats = series.stats(e, "log_id", "value", "time_us", "seq", 30.0)
    runs = series.sustained_runs(e, "log_id", F.col("value") > 30.0, "time_us", ["time_us", "seq"]).groupBy("log_id").agg(F.max("rows").alias("longest_run"))
    sure = decided(spark, sf_dir).select("log_id", "status", "confidence")
    return stats.where("onset >= 0").select("log_id", "onset", F.round("max", 6).alias("max")).join(runs, "log_id", "left").join(sure, "log_id", "left")


_FEATURES = _E + """, f AS (SELECT log_id, coalesce(max(value) FILTER (WHERE msg_type = 'view'), 0) AS x, coalesce(max(value) FILTER (WHERE msg_type = 'click'), 0) AS y, coalesce(max(value) FILTER (WHERE msg_type = 'purchase'), 0) AS z,
 count(*) FILTER (WHERE value > 80) AS clip, coalesce(avg(value) FILTER (WHERE msg_type = 'signup'), 0) / 10 AS hdop, count(DISTINCT code) AS nsats, avg((value > 1)::INT) AS fix,
 (coalesce(max(value) FILTER (WHERE msg_type = 'error'), 0) - coalesce(min(value) FILTER (WHERE msg_type = 'error'), 0)) / 40 AS vr, coalesce(min(value) FILTER (WHERE msg_type = 'error'), 0) + 8 AS vm, max(value) AS m, count(*) AS n FROM e GROUP BY log_id),
r AS (SELECT log_id, 'vibration_high' AS failure_type, least(1, (CASE WHEN x > 60 THEN 0.2 WHEN x > 30 THEN 0.1 ELSE 0 END) + (CASE WHEN y > 60 THEN 0.2 WHEN y > 30 THEN 0.1 ELSE 0 END) + (CASE WHEN z > 60 THEN 0.2 WHEN z > 30 THEN 0.1 ELSE 0 END) + (CASE WHEN clip > 0 THEN 0.3 ELSE 0 END) + (CASE WHEN clip > 100 THEN 0.2 ELSE 0 END)) AS c, 0.7 AS crit, greatest(x, y, z) > 30 OR clip > 0 AS gate FROM f
 UNION ALL SELECT log_id, 'gps_quality_poor', least(1, (CASE WHEN hdop > 2 THEN 0.4 ELSE 0 END) + (CASE WHEN nsats > 0 AND nsats < 6 THEN 0.5 ELSE 0 END) + (CASE WHEN fix < 0.95 THEN 0.6 ELSE 0 END)), 0.7, hdop <> 0 OR nsats <> 0 OR fix <> 0 FROM f
 UNION ALL SELECT log_id, 'power_instability', least(1, (CASE WHEN vr > 2 THEN 0.5 ELSE 0 END) + (CASE WHEN vm > 0 AND vm < 10 THEN 0.3 ELSE 0 END) + (CASE WHEN vr / 2 > 0.8 AND z > 20 THEN 0.15 ELSE 0 END)), 2, true FROM f),
hits AS (SELECT log_id, failure_type, c::DOUBLE AS confidence, CASE WHEN c > crit THEN 'critical' WHEN c > 0.3 OR failure_type = 'power_instability' THEN 'warning' ELSE 'info' END AS severity FROM r WHERE gate AND c > 0)"""
_MERGED = _FEATURES + """, ml AS (SELECT log_id, CASE WHEN n % 2 = 0 THEN 'vibration_high' ELSE 'ekf_failure' END AS failure_type, least(1, m / 100) AS confidence FROM f),
pair AS (SELECT coalesce(a.log_id, b.log_id) AS log_id, coalesce(a.failure_type, b.failure_type) AS failure_type,
 CASE WHEN a.confidence IS NOT NULL AND b.confidence IS NOT NULL THEN 0.65 * b.confidence + 0.35 * a.confidence ELSE 0.85 * coalesce(a.confidence, b.confidence) END AS confidence,
 CASE WHEN a.confidence IS NOT NULL AND b.confidence IS NOT NULL THEN 'rule+ml' WHEN a.confidence IS NOT NULL THEN 'rule' ELSE 'ml' END AS method
 FROM hits a FULL JOIN ml b ON a.log_id = b.log_id AND a.failure_type = b.failure_type),
merged AS (SELECT log_id, failure_type, round(confidence, 6) AS confidence, method, CASE WHEN confidence > 0.6 THEN 'critical' WHEN confidence > 0.3 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN confidence >= 0.7 THEN 'confirmed' ELSE 'uncertain' END AS reason FROM pair WHERE confidence >= 0.45)"""

_CANDIDATES = _E + """, o AS (SELECT * FROM e WHERE value > 30), c AS (SELECT f.log_id, failure_type, (t - t0) / 3600 + 1e6 AS onset, confidence FROM (SELECT log_id, msg_type AS failure_type, min(time_us) AS t, round(max(value) / 100, 6) AS confidence FROM o GROUP BY ALL) f JOIN (SELECT log_id, min(time_us) AS t0 FROM o GROUP BY 1) b ON f.log_id = b.log_id)"""

QUERIES = {
    "series_stats": (series_stats, f"WITH {_E} SELECT log_id, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min, round(stddev_pop(value), 6) AS std, round(max(value) - min(value), 6) AS range, arg_max(time_us, (value, -seq)) AS max_time, coalesce(arg_min(time_us, seq) FILTER (WHERE value > 90), -1)::DOUBLE AS onset FROM e GROUP BY log_id"),
    "series_adaptive_onset": (series_adaptive, f"WITH {_E}, s AS (SELECT log_id, avg(value) AS mean, stddev_pop(value) AS std FROM e GROUP BY log_id) SELECT s.log_id, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, coalesce(arg_min(time_us, seq) FILTER (WHERE value > mean + 1.5 * std), -1)::DOUBLE AS onset FROM e JOIN s USING (log_id) GROUP BY s.log_id"),
    "family_counts": (family_counts, f"WITH {_E} SELECT log_id, msg_type, count(*) AS n FROM e WHERE msg_type IN ('click', 'view', 'error') GROUP BY ALL"),
    "change_counts": (change_counts, f"WITH {_E}, l AS (SELECT log_id, msg_type <> lag(msg_type) OVER (PARTITION BY log_id ORDER BY time_us, seq) AS c FROM e) SELECT log_id, count(*) FILTER (WHERE c) AS changes FROM l GROUP BY log_id"),
    "early_window": (early_window, f"WITH {_E}, s AS (SELECT log_id, arg_min(time_us, seq) AS t0 FROM e GROUP BY log_id), r AS (SELECT log_id, seq, abs(value) AS v, (time_us - t0) / 1e6 AS t FROM e JOIN s USING (log_id)) SELECT log_id, round(coalesce(max(v) FILTER (WHERE t <= 86400), 0), 6) AS early_max, round(coalesce(arg_min(t, seq) FILTER (WHERE v > 95), -1), 6) AS first_over FROM r GROUP BY log_id"),
    "sustained_runs": (sustained, f"WITH {_E}, m AS (SELECT *, sum((NOT value > 20)::INT) OVER (PARTITION BY log_id ORDER BY time_us, seq) AS run FROM e) SELECT log_id, min(time_us) AS begin, max(time_us) AS \"end\", count(*) AS rows FROM m WHERE value > 20 GROUP BY log_id, run HAVING count(*) >= 3"),
    "window_slices": (window_slices, f"WITH {_E}, s AS (SELECT log_id, min(time_us) AS a, max(time_us) AS z FROM e GROUP BY log_id), w AS (SELECT log_id, a, unnest(range(0, greatest(0, (z - a - 172800000000) // 86400000000) + 1)) AS win FROM s) SELECT w.log_id, win AS \"window\", count(*) AS n, count(DISTINCT msg_type) AS families FROM w JOIN e ON e.log_id = w.log_id AND time_us - a >= win * 86400000000 AND time_us - a < win * 86400000000 + 172800000000 GROUP BY ALL HAVING families >= 3"),
    "downsample": (downsample, f"WITH {_E}, r AS (SELECT log_id, seq, row_number() OVER (PARTITION BY log_id ORDER BY time_us, seq) - 1 AS i, count(*) OVER (PARTITION BY log_id) AS n FROM e) SELECT log_id, seq FROM r WHERE i % greatest(1, n // 10) = 0"),
    "nearest_point": (nearest_point, f"WITH {_E}, p AS (SELECT a.log_id, a.seq, b.value, row_number() OVER (PARTITION BY a.log_id, a.seq ORDER BY abs(a.time_us - b.time_us) NULLS LAST, b.time_us, b.seq) AS n FROM e a LEFT JOIN e b ON a.log_id = b.log_id AND b.msg_type = 'view' WHERE a.msg_type = 'error') SELECT log_id, seq, round(value, 6) AS nearest FROM p WHERE n = 1"),
    "onset_arbitration": (arbitration, f"""WITH {_CANDIDATES}, g AS (SELECT log_id, list({{'o': onset, 'm': -confidence, 'l': failure_type}} ORDER BY onset, -confidence, failure_type) AS c FROM c GROUP BY log_id),
b AS (SELECT log_id, c[1].o AS earliest, list_reduce(c, lambda b, x: CASE WHEN (x.o - c[1].o <= 5e6 AND -x.m > -b.m) OR (x.o - c[1].o <= 3e7 AND -x.m >= 0.85 AND -x.m > -b.m + 0.15) THEN x ELSE b END) AS r FROM g)
SELECT log_id, r.l AS root_cause, round(r.o, 6) AS onset, -r.m AS confidence, round(earliest, 6) AS earliest FROM b"""),
    "code_lookup": (lookup, "SELECT coalesce(n_name, 'UNKNOWN_' || k) AS name, count(*) AS n FROM (SELECT json_extract_string(props, '$.k')::INT AS k FROM events) LEFT JOIN nation ON k = n_nationkey GROUP BY 1"),
    "channel_spread": (channel_spread, "WITH s AS (SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS d, min(l_quantity) AS lo, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_custkey AS log_id, round(avg(d), 6) AS spread_mean, round(max(d), 6) AS spread_max, round(avg((n >= 4 AND lo > 10)::INT), 6) AS all_high FROM s JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "rules_fired": (rules_fired, f"WITH {_FEATURES} SELECT log_id, failure_type, round(confidence, 6) AS confidence, severity FROM hits"),
    "fused_diagnoses": (fused, f"WITH {_MERGED} SELECT * FROM merged"),
    "decisions": (decided, f"""WITH {_MERGED}, k AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY confidence DESC, CASE method WHEN 'rule+ml' THEN 0 WHEN 'ml' THEN 1 ELSE 2 END, CASE failure_type WHEN 'vibration_high' THEN 5 ELSE 4 END DESC, failure_type) AS rank FROM merged),
t AS (SELECT log_id, max(confidence) FILTER (WHERE rank = 1) AS c, max(method) FILTER (WHERE rank = 1) AS method, max(failure_type) FILTER (WHERE rank = 1) AS failure_type, max(confidence) FILTER (WHERE rank = 2) AS second, count(*) FILTER (WHERE confidence >= 0.5) AS strong FROM k GROUP BY log_id),
q AS (SELECT f.log_id, failure_type, c, concat_ws(',', CASE WHEN c < 0.65 THEN 'low_confidence' END, CASE WHEN c - second < 0.15 THEN 'close_second' END, CASE WHEN strong >= 2 THEN 'several_strong' END, CASE WHEN method = 'ml' AND c < 0.75 THEN 'model_only' END) AS reasons FROM f LEFT JOIN t USING (log_id))
SELECT log_id, CASE WHEN c IS NULL THEN 'healthy' WHEN reasons <> '' THEN 'uncertain' ELSE 'confirmed' END AS status, failure_type, c AS confidence, reasons FROM q"""),
}
