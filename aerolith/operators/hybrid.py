"""From rule and classifier hits of a log to what is reported: gate, onsets, arbitration, selection and its record.

Hits are rows (key, failure_type, confidence, method, severity); onsets are in microseconds, and only those
over 0 count. At most SHOWN diagnoses are reported per log, by the feature's definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import diagnosis, rules, series
from .assembly import assembled

SHOWN, STRONG, NEAR = 2, 0.70, 0.10
# The feature that tells since when a failure shows.
ONSETS = {"vibration_high": "vibe_onset", "compass_interference": "mag_onset", "power_instability": "volt_onset", "gps_quality_poor": "gps_onset", "motor_imbalance": "spread_onset", "mechanical_failure": "spread_onset", "thrust_loss": "thrust_onset", "ekf_failure": "ekf_onset"}
# What to do about a failure, in our words.
ADVICE = {
    "vibration_high": "Balance propellers and check mounts and bearings.", "compass_interference": "Move the compass away from currents and calibrate it again.", "power_instability": "Test the battery under load and check connectors.",
    "brownout": "Check the board's supply before the next flight.", "gps_quality_poor": "Give the antenna a free view of the sky and keep it away from noise.", "motor_imbalance": "Compare motors, propellers and weight distribution.",
    "thrust_loss": "Reduce weight or fit a stronger drive.", "pid_tuning_issue": "Tune the attitude controller again.", "mechanical_failure": "Inspect frame, arms and drive for damage.", "ekf_failure": "Look for the sensor that the estimator rejects.",
    "rc_failsafe": "Check receiver, antennas and range.", "setup_error": "Check motor order, direction and orientation settings.", "crash_unknown": "Review the log by hand around the end.",
}
OTHERWISE = "Review the log by hand."


def gated(model: DataFrame, rule: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Classifier hits of the logs that a rule fires for or that are outliers (scores: key, is_outlier); a log
    without a score is none."""
    kept = scores.where("is_outlier").select(key).unionByName(rule.select(key)).distinct()
    return model.join(kept, key, "left_semi")


def with_onsets(hits: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """hits with `onset`, by the feature of their type; -1 where there is none."""
    own = set(features.columns)
    map_ = F.create_map(*[x for t, c in ONSETS.items() if c in own for x in (F.lit(t), F.col(c).cast("double"))])
    return hits.join(features.select(key, map_.alias("_o")), key, "left").withColumn("onset", F.coalesce(F.try_element_at("_o", F.col("failure_type")), F.lit(-1.0))).drop("_o")


def hypotheses(hits: DataFrame, key: str, shown: int | None = None) -> DataFrame:
    """hits with `place` in their log: those with an onset first, the earliest first, then the surest."""
    late = F.when(F.col("onset") > 0, F.col("onset")).otherwise(F.lit(float("inf")))
    out = hits.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(late, F.desc("confidence"), "failure_type")))
    return out if shown is None else out.where(F.col("place") <= shown)


def selected(hits: DataFrame, key: str) -> DataFrame:
    """The hits that are reported: `place` from 1, `arbitrated` for a root cause found by onsets, `why`.

    With two hits or more and an onset among them the root cause (see series.arbitrated) comes first, then
    critical hits of rules alone. Otherwise the first by rank, then those that are critical hits of rules, or near
    it in confidence and either of a rule or strong.
    """
    ranked = diagnosis.ranked(hits, key)
    facts = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("_first"))
    cause = series.arbitrated(hits.withColumnRenamed("failure_type", "label"), key).select(key, "root_cause", F.col("onset").alias("_since"))
    rows = ranked.join(facts.join(cause, key, "left"), key)
    timed = (F.col("_n") > 1) & F.col("root_cause").isNotNull()
    rule = F.col("method") == "rule"
    hard = rule & (F.col("severity") == "critical")
    near = (F.col("_first") - F.col("confidence") <= NEAR) & (rule | (F.col("confidence") >= STRONG))
    leads = F.when(timed, F.col("failure_type") == F.col("root_cause")).otherwise(F.col("rank") == 1)
    stays = leads | hard | (~timed & near)
    out = rows.where(stays).withColumn("_leads", leads).withColumn("arbitrated", timed & leads)
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_leads"), "rank"))).where(F.col("place") <= SHOWN)
    why = F.when(F.col("arbitrated"), "earliest onset").when(leads, "surest").when(hard, "critical rule").otherwise("near the surest")
    return out.withColumn("why", why).select(key, "place", "failure_type", "confidence", "method", "severity", "arbitrated", "why")


def advised(hits: DataFrame) -> DataFrame:
    """hits with `advice`; arbitrated ones are marked."""
    texts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair]), F.col("failure_type")), F.lit(OTHERWISE))
    return hits.withColumn("advice", F.when(F.col("arbitrated"), F.concat(F.lit("[ARB] "), texts)).otherwise(texts))


def _listed(df: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), *columns))).alias("_l")).select(key, F.transform("_l", lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("l"))


def explained(logs: DataFrame, rule: DataFrame, model: DataFrame, hits: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """One record per log: its rule hits, classifier hits, hypotheses in order, what was chosen and why.

    A log has at most as many of each as there are labels.
    """
    sure = (-F.col("confidence")).alias("at")
    parts = {"rule": _listed(rule, key, sure, "failure_type", "confidence"), "model": _listed(model, key, sure, "failure_type", "confidence"),
             "hypotheses": _listed(hypotheses(hits, key), key, F.col("place"), "failure_type", "onset", "confidence"), "final": _listed(chosen, key, F.col("place"), "failure_type", "confidence", "why")}
    out = logs.select(key)
    for name, part in parts.items():
        out = out.join(part.withColumnRenamed("l", name), key, "left")
    why = F.coalesce(F.try_element_at("final", F.lit(1))["why"], F.lit("nothing is sure enough"))
    return out.withColumn("reason", why)


def _ranked(hits: Column) -> Column:
    """hits, surest first, then found by both, by the model, by a rule, then by priority of the label, then its name."""
    method = lambda x: F.when(x["method"] == "rule+ml", 0).when(x["method"] == "ml", 1).otherwise(2)
    first = F.create_map(*[F.lit(x) for pair in diagnosis.PRIORITIES.items() for x in pair])
    keyed = F.transform(hits, lambda x: F.struct((-x["confidence"]).alias("a"), method(x).alias("b"), (-F.coalesce(F.try_element_at(first, x["failure_type"]), F.lit(0))).alias("c"), x["failure_type"].alias("d"), x.alias("h")))
    return F.transform(F.array_sort(keyed), lambda x: x["h"])


def _least(hits: Column, label: Column) -> Column:
    return F.array_min(F.transform(F.filter(hits, lambda h: h["failure_type"] == label), lambda h: h["confidence"]))


def _settled(rows: DataFrame) -> DataFrame:
    """rows whose columns are computed once here: the optimiser doesn't merge what follows with what they are made of,
    which would double nested expressions again and again."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in rows.columns]))))


def verdicts(features: DataFrame, model: DataFrame | None = None, scores: DataFrame | None = None, key: str = "log_id", least: float = 0.45, table: dict | None = None) -> DataFrame:
    """All that is said of a log, in its one row: nothing is shuffled but the model's hits and scores.

    features: of assembly.assembled, with vehicle and extracted; model: key, failure_type, confidence; scores: key,
    is_outlier; table: the rules, if not rules.ALL. A log has at most as many hits as there are labels, so they are kept in arrays:

    rules, model: the hits (the model's only behind the gate: of a log with a rule's hit or that is an outlier)
    merged: 0.65 model + 0.35 rule, either alone 0.85, from `least` on, in order of rank; to nine digits, so that equal
    sums are equal
    hypotheses: all types with their onset, the timed ones first, then by confidence
    final: what is reported, the root cause first; `why` tells how it was found
    status: healthy, uncertain, confirmed, or not_extracted; reasons for doubt; batch: the status in a batch
    """
    one = "array<struct<failure_type: string, confidence: double>>"
    rows = features.fillna(0.0).withColumn("_rules", F.when(F.coalesce("extracted", F.lit(True)), diagnosis.rule_array(table or rules.ALL, "vehicle")).otherwise(F.array()))
    onsets = F.create_map(*[x for t, c in ONSETS.items() for x in (F.lit(t), F.col(c).cast("double"))])
    rows = rows.select(key, "vehicle", "extracted", F.transform("_rules", lambda x: F.struct(x["failure_type"].alias("failure_type"), x["confidence"].cast("double").alias("confidence"), x["severity"].alias("severity"))).alias("rules"), onsets.alias("_onsets"))
    if model is None:
        rows = rows.withColumn("_told", F.array().cast(one))
    else:
        told = model.groupBy(key, "failure_type").agg(F.max("confidence").cast("double").alias("confidence")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("failure_type", "confidence"))).alias("_told"))
        rows = rows.join(told, key, "left").withColumn("_told", F.coalesce("_told", F.array().cast(one)))
    # nothing is said of a log that could not be extracted
    rows = rows.withColumn("_told", F.when(F.coalesce("extracted", F.lit(True)), F.col("_told")).otherwise(F.array().cast(one)))
    if scores is not None:
        rows = rows.join(scores.groupBy(key).agg(F.max("is_outlier").alias("is_outlier")), key, "left")
        rows = rows.withColumn("_told", F.when((F.size("rules") > 0) | F.coalesce("is_outlier", F.lit(False)), F.col("_told")).otherwise(F.array().cast(one)))
    rows = _settled(rows)
    kinds = F.array_sort(F.array_distinct(F.concat(F.transform("rules", lambda x: x["failure_type"]), F.transform("_told", lambda x: x["failure_type"]))))

    def about(label: Column) -> Column:
        rule, told = F.coalesce(_least(F.col("rules"), label), F.lit(0.0)), F.coalesce(_least(F.col("_told"), label), F.lit(0.0))
        return F.struct(label.alias("failure_type"), rule.alias("rule"), told.alias("model"), F.coalesce(F.try_element_at("_onsets", label), F.lit(-1.0)).alias("onset"))

    def fused(x: Column) -> Column:
        both = (x["rule"] > 0) & (x["model"] > 0)
        c = F.round(F.least(F.lit(1.0), F.when(both, 0.65 * x["model"] + 0.35 * x["rule"]).otherwise(0.85 * F.greatest(x["rule"], x["model"]))), 9)
        method = F.when(both, "rule+ml").when(x["rule"] > 0, "rule").otherwise("ml")
        severity = F.when(c > 0.6, "critical").when(c > 0.3, "warning").otherwise("info")
        return F.struct(x["failure_type"].alias("failure_type"), c.alias("confidence"), method.alias("method"), severity.alias("severity"), x["onset"].alias("onset"), F.round(F.greatest(x["rule"], x["model"]), 9).alias("alone"))

    rows = _settled(rows.withColumn("_all", F.transform(F.transform(kinds, about), fused)))
    merged = _ranked(F.filter("_all", lambda x: x["confidence"] >= least))
    late = lambda x: F.when(x["onset"] > 0, x["onset"]).otherwise(F.lit(float("inf")))
    sure = lambda x: F.when(x["confidence"] >= least, x["confidence"]).otherwise(x["alone"])
    stories = F.array_sort(F.transform("_all", lambda x: F.struct(late(x).alias("a"), (-sure(x)).alias("b"), x["failure_type"].alias("failure_type"), x["method"].alias("method"), x["onset"].alias("onset"), sure(x).alias("confidence"))))
    rows = _settled(rows.withColumn("merged", merged).withColumn("hypotheses", F.transform(stories, lambda x: F.struct(*[x[c].alias(c) for c in ("failure_type", "method", "onset", "confidence")]))))
    # those with an onset, by onset, then by rank
    timed = F.array_sort(F.filter(F.transform("merged", lambda x, i: F.struct(x["onset"].alias("a"), (-x["confidence"]).alias("b"), i.alias("i"), x.alias("h"))), lambda x: x["a"] > 0))
    rows = _settled(rows.withColumn("_timed", F.when(F.size("merged") > 1, F.transform(timed, lambda x: x["h"])).otherwise(F.array())))
    first, second = F.get("_timed", F.lit(0)), F.get("_timed", F.lit(1))

    def step(best: Column, x: Column) -> Column:
        gap = x["onset"] - first["onset"]
        wins = ((gap <= 5e6) & (x["confidence"] > best["confidence"])) | ((gap <= 30e6) & (x["confidence"] >= 0.85) & (x["confidence"] > best["confidence"] + 0.15))
        return F.when(wins, x).otherwise(best)

    rows = _settled(rows.withColumn("_cause", F.when(F.size("_timed") > 0, F.aggregate("_timed", first, step))))
    cause, top = F.col("_cause"), F.get("merged", F.lit(0))
    leader = F.coalesce(cause, top)
    hard = lambda x: (x["method"] == "rule") & (x["severity"] == "critical")
    near = lambda x: (top["confidence"] - x["confidence"] <= NEAR) & ((x["method"] == "rule") | (x["confidence"] >= STRONG))
    others = F.filter("merged", lambda x: (x["failure_type"] != leader["failure_type"]) & (hard(x) | (cause.isNull() & near(x))))
    rows = _settled(rows.withColumn("final", F.when(F.size("merged") > 0, F.slice(F.concat(F.array(leader), others), 1, SHOWN)).otherwise(F.array())))
    ahead = F.format_string("%s %.1f s before %s", cause["failure_type"], (second["onset"] - first["onset"]) / 1e6, second["failure_type"])
    why = F.when(cause.isNotNull() & second.isNotNull(), ahead).when(cause.isNotNull(), "earliest onset").when(F.size("merged") > 0, "surest").otherwise("nothing is sure enough")
    a, b = F.get("final", F.lit(0)), F.get("final", F.lit(1))
    strong = F.size(F.filter("final", lambda x: x["confidence"] >= 0.5)) > 1
    doubts = F.filter(F.array(F.when(a["confidence"] < 0.65, "low_confidence"), F.when(a["confidence"] - b["confidence"] < 0.15, "close_second"), F.when(strong, "several_strong"), F.when((a["method"] == "ml") & (a["confidence"] < 0.75), "model_only")), lambda x: x.isNotNull())
    status = F.when(~F.coalesce("extracted", F.lit(True)), "not_extracted").when(a.isNull(), "healthy").when(F.size(doubts) > 0, "uncertain").otherwise("confirmed")
    batch = F.when(~F.coalesce("extracted", F.lit(True)), "ERROR").when(a.isNull(), "HEALTHY").when(a["severity"] == "critical", "CRITICAL").otherwise("WARNING")
    return _settled(rows.select(key, "vehicle", "extracted", status.alias("status"), batch.alias("batch"), a["failure_type"].alias("failure_type"), a["confidence"].alias("confidence"), F.when(a.isNull(), F.array().cast("array<string>")).otherwise(doubts).alias("reasons"), why.alias("why"), cause.isNotNull().alias("arbitrated"), "rules", F.col("_told").alias("model"), "merged", "hypotheses", "final"))


def reported(rows: DataFrame, key: str = "log_id") -> DataFrame:
    """A row for each reported diagnosis of verdicts, with its place and advice."""
    out = rows.select(key, "arbitrated", "why", F.posexplode("final").alias("place", "h"))
    out = out.select(key, (F.col("place") + 1).alias("place"), *[F.col(f"h.{c}").alias(c) for c in ("failure_type", "confidence", "method", "severity", "onset")], (F.col("arbitrated") & (F.col("place") == 0)).alias("arbitrated"), "why")
    return advised(out)


def diagnosed(messages: DataFrame, model: DataFrame | None = None, scores: DataFrame | None = None, logs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole way from messages: the row of verdicts of each log, and the reported diagnoses with advice.

    model: classifier hits (log_id, failure_type, confidence); scores: outliers (log_id, is_outlier).
    """
    rows = verdicts(assembled(messages, logs), model, scores)
    return rows, reported(rows)
