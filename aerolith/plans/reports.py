"""Queries on results of runs: failures, confusions, calibration, engines and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import curation, diagnosis, evaluation, hybrid

from . import curate, flight
from .hybrid import _SEL, _onset_hits


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_counters(spark, sf_dir):
    l = _t(spark, sf_dir, "labels").select("doc_id")
    d = _t(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select("doc_id", (F.col("n_chars") > 400).alias("extracted"), (F.col("n_chars") % 6 > 0).alias("diagnosed"))
    return evaluation.run_counters(evaluation.outcomes(l, curation.best_row(d, "doc_id", [F.col("extracted"), F.col("diagnosed")]), "doc_id"))


def _results(spark, sf_dir):
    return curate._results(spark, sf_dir)


def confusion_rows(spark, sf_dir):
    out = evaluation.confusions(_results(spark, sf_dir), "doc_id", "truth", "predicted")
    return out.select("doc_id", F.array_join("missed", ",").alias("missed"), F.array_join("added", ",").alias("added"))


def confusion_sample(spark, sf_dir):
    return evaluation.confusions(_results(spark, sf_dir), "doc_id", "truth", "predicted", most=10).select("doc_id")


def _probabilities(spark, sf_dir):
    l, d = _t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    own = l.join(d, "doc_id")
    return own.select(F.lit("good").alias("class"), (F.col("n_chars") % 11 / 10).alias("p"), (F.col("quality") == 1).alias("hit")).unionByName(own.select(F.lit("toxic").alias("class"), (F.col("n_chars") % 7 / 10).alias("p"), (F.col("toxic") == 1).alias("hit")))


def class_bins(spark, sf_dir):
    return evaluation.class_bins(_probabilities(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("confidence", "accuracy")})


def class_error(spark, sf_dir):
    return evaluation.class_error(_probabilities(spark, sf_dir)).withColumn("ece", F.round("ece", 6))


def _reviewed(spark, sf_dir):
    """Results with severities, healthy where neither label holds; and a decision for each."""
    rows = _results(spark, sf_dir).withColumn("truth", F.when(F.size("truth") == 0, F.array(F.lit("healthy"))).otherwise(F.col("truth")))
    rows = rows.withColumn("severities", F.transform("predicted", lambda x: F.when((x == "toxic") & (F.col("confidence") > 0.5), "critical").otherwise("warning")))
    return rows, rows.select(F.when(F.col("confidence") < 0.3, "uncertain").otherwise("confirmed").alias("status"), (F.col("doc_id") % 10 == 0).alias("needs_review"))


def calibration_report(spark, sf_dir):
    rows, decisions = _reviewed(spark, sf_dir)
    out = evaluation.calibration_report(rows, decisions, "truth", "predicted", "severities", "confidence")
    return out.withColumns({c: F.round(c, 6) for c in ("ece", "abstention", "false_critical_rate")})


def critical_audit(spark, sf_dir):
    rows = _results(spark, sf_dir).select((F.col("doc_id") % 12 > 0).alias("readable"), F.array_contains("predicted", "toxic").alias("critical"))
    return evaluation.critical_audit(rows).withColumn("rate", F.round("rate", 6))


def metric_gates(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in ("good", "toxic", "unused")], "label string")
    metrics = evaluation.label_metrics(_results(spark, sf_dir), "truth", "predicted", labels)
    named = metrics.select(F.concat("label", F.lit("_recall")).alias("name"), F.col("recall").alias("value")).unionByName(evaluation.macro_f1(metrics).select(F.lit("macro_f1").alias("name"), F.col("macro_f1").alias("value")))
    targets = spark.createDataFrame([("macro_f1", 0.99), ("good_recall", 0.1), ("toxic_recall", 0.999), ("parse_rate", 0.97)], "name string, target double")
    return evaluation.gates(named, targets).withColumn("value", F.round("value", 6))


def label_rates(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    metrics = o.groupBy(F.date_format("o_orderdate", "yyyy").alias("run"), F.col("o_orderpriority").alias("label")).agg(F.count_if(F.expr("o_orderstatus = 'F' and o_orderdate < '1997-01-01'")).alias("tp"), F.count_if(F.expr("o_orderstatus = 'O' and o_orderdate < '1997-01-01'")).alias("fp"), F.count(F.lit(1)).alias("support"))
    return evaluation.label_rates(metrics, "run").withColumn("rate", F.round("rate", 6))


def engine_scores(spark, sf_dir):
    r = _results(spark, sf_dir)
    every = r.select("truth", "predicted").withColumn("engine", F.lit("hybrid")).unionByName(r.select("truth", F.when(F.col("confidence") > 0.5, F.col("predicted")).otherwise(F.array().cast("array<string>")).alias("predicted"), F.lit("rule").alias("engine"))).unionByName(r.select("truth", F.array(F.lit("good")).alias("predicted"), F.lit("ml").alias("engine")))
    labels = spark.createDataFrame([(x,) for x in ("good", "toxic", "unused")], "label string")
    out = evaluation.engine_scores(every, "engine", "truth", "predicted", labels)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "engine"})


def first_classes(spark, sf_dir):
    return evaluation.first_class(_t(spark, sf_dir, "labels"), ["toxic", "quality"]).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def labels_over(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", F.col("l_linestatus"), F.col("l_linenumber").cast("string")).alias("label"), (F.col("l_quantity") / 50).alias("p"))
    thresholds = spark.createDataFrame([("NO1", 0.2), ("AF1", 0.9), ("RF2", 0.7)], "label string, threshold double")
    return evaluation.labels_over(p, "l_orderkey", thresholds)


def batch_status(spark, sf_dir):
    hits = _onset_hits(spark, sf_dir)
    chosen = hybrid.selected(hits.where("confidence < 0.9"), "log_id")
    return evaluation.batch_status(chosen, hits.select("log_id").distinct(), "log_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def incident_clusters(spark, sf_dir):
    chosen = hybrid.selected(_onset_hits(spark, sf_dir), "log_id").where("place = 1")
    return evaluation.clusters(chosen, "failure_type", "log_id")


def analysis_records(spark, sf_dir):
    """A JSON record per log: features, reported diagnoses with advice, decision."""
    rows = flight.feature_rows(spark, sf_dir)
    chosen = hybrid.advised(hybrid.selected(_onset_hits(spark, sf_dir), "log_id"))
    listed = chosen.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("place", "failure_type", "confidence", "severity", "advice"))).alias("diagnoses"))
    decided = diagnosis.decisions(chosen, rows, "log_id").select("log_id", F.struct("status", "failure_type", "reasons").alias("decision"))
    own = rows.select("log_id", F.struct(*[c for c in rows.columns if c != "log_id" and not c.startswith("_")]).alias("features"))
    return own.join(listed, "log_id", "left").join(decided, "log_id", "left").select("log_id", F.to_json(F.struct("features", "diagnoses", "decision")).alias("record"))


def class_splits(spark, sf_dir):
    """Rows of classes with two rows or more, as training takes them."""
    m = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("class"))
    return curation.common_classes(m, "class", 2).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def upserted_labels(spark, sf_dir):
    l = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    return curation.upserted(l, l.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality")), "doc_id")


def latest_expert(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return evaluation.latest(o, "o_custkey", "at").select("o_custkey", F.col("at.o_orderkey").alias("o_orderkey"))


def confidence_order(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("level"))
    return c.where(C.ordinal(F.col("level"), ["building", "machinery", "household"], "machinery") >= 1).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


_R, _B = curate._R, curate._B
_P = "p AS (SELECT 'good' AS class, n_chars % 11 / 10 AS p, quality = 1 AS hit FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'toxic', n_chars % 7 / 10, toxic = 1 FROM labels JOIN documents USING (doc_id)), b AS (SELECT class, floor(p * 10)::INT AS bin, count(*) AS n, avg(p) AS confidence, avg(hit::INT) AS accuracy FROM p WHERE p < 1 GROUP BY ALL)"
_X = f"{_R}, q AS (SELECT *, len(truth) = 0 AS healthy, list_contains(predicted, 'toxic') AND confidence > 0.5 AS critical FROM r)"

QUERIES = {
    "run_counters": (run_counters, "WITH d AS (SELECT doc_id, bool_and(n_chars > 400) AS a, min((n_chars > 400)::INT * 2 + (n_chars % 6 > 0)::INT) AS k FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1), o AS (SELECT CASE WHEN d.doc_id IS NULL OR k < 2 THEN 'x' WHEN k = 2 THEN 'd' ELSE 'ok' END AS o FROM labels l LEFT JOIN d ON l.doc_id = d.doc_id) SELECT count(*) FILTER (WHERE o <> 'd') AS total, count(*) FILTER (WHERE o = 'ok') AS extracted, count(*) FILTER (WHERE o = 'x') AS failed_extractions, count(*) FILTER (WHERE o = 'd') AS failed_diagnoses FROM o"),
    "confusion_rows": (confusion_rows, f"WITH {_R} SELECT doc_id, array_to_string(list_sort(list_filter(truth, lambda x: NOT list_contains(predicted, x))), ',') AS missed, array_to_string(list_sort(list_filter(predicted, lambda x: NOT list_contains(truth, x))), ',') AS added FROM r WHERE list_sort(truth) <> list_sort(predicted)"),
    "confusion_sample": (confusion_sample, f"WITH {_R} SELECT doc_id FROM r WHERE list_sort(truth) <> list_sort(predicted) ORDER BY doc_id LIMIT 10"),
    "class_bins": (class_bins, f"WITH {_P} SELECT class, bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b"),
    "class_error": (class_error, f"WITH {_P}, g AS (SELECT class, sum(n * abs(confidence - accuracy)) AS gap FROM b GROUP BY 1), s AS (SELECT class, count(*) AS rows FROM p GROUP BY 1) SELECT round(avg(coalesce(gap, 0) / rows), 6) AS ece, count(*) AS classes FROM s LEFT JOIN g ON s.class = g.class"),
    "calibration_report": (calibration_report, f"""WITH {_X}, t AS (SELECT least(floor(confidence * 10), 9) AS bin, confidence, (CASE WHEN len(truth) = 0 THEN predicted[1] = 'healthy' ELSE list_contains(truth, predicted[1]) END)::INT AS ok FROM q WHERE len(predicted) > 0), u AS (SELECT count(*) AS n, abs(avg(ok) - avg(confidence)) AS gap FROM t GROUP BY bin), e AS (SELECT coalesce(sum(n * gap) / sum(n), 0) AS ece FROM u),
f AS (SELECT count(*) AS samples, avg((confidence < 0.3 OR doc_id % 10 = 0)::INT) AS abstention, count(*) FILTER (WHERE healthy) AS healthy, coalesce(avg(critical::INT) FILTER (WHERE healthy), 0) AS rate FROM q) SELECT samples, round(ece, 6) AS ece, round(abstention, 6) AS abstention, healthy, round(rate, 6) AS false_critical_rate, ece <= 0.08 AS ece_met, rate <= 0.1 AS rate_met FROM e, f"""),
    "critical_audit": (critical_audit, f"WITH {_R} SELECT count(*) AS logs, count(*) FILTER (WHERE doc_id % 12 = 0) AS errors, round(avg((doc_id % 12 > 0 AND list_contains(predicted, 'toxic'))::INT), 6) AS rate FROM r"),
    "metric_gates": (metric_gates, f"WITH {_R}, c AS (SELECT label, count(*) FILTER (WHERE list_contains(truth, label) AND list_contains(predicted, label)) AS tp, count(*) FILTER (WHERE NOT list_contains(truth, label) AND list_contains(predicted, label)) AS fp, count(*) FILTER (WHERE list_contains(truth, label) AND NOT list_contains(predicted, label)) AS fn FROM r, unnest(['good', 'toxic', 'unused']) AS u(label) GROUP BY label), v AS (SELECT label || '_recall' AS name, coalesce(tp / nullif(tp + fn, 0), 0) AS value FROM c UNION ALL SELECT 'macro_f1', avg(2 * tp / (2 * tp + fp + fn)) FROM c WHERE tp + fn > 0 OR fp > 0), t AS (SELECT * FROM (VALUES ('macro_f1', 0.99), ('good_recall', 0.1), ('toxic_recall', 0.999), ('parse_rate', 0.97)) AS x(name, target)) SELECT t.name, target::DOUBLE AS target, round(value, 6) AS value FROM t LEFT JOIN v ON t.name = v.name WHERE value IS NULL OR value < target"),
    "label_rates": (label_rates, "WITH m AS (SELECT strftime(o_orderdate, '%Y') AS run, o_orderpriority AS label, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < '1997-01-01') AS p, count(*) AS s FROM orders GROUP BY ALL), t AS (SELECT *, sum(p) OVER (PARTITION BY run) AS tp, sum(s) OVER (PARTITION BY run) AS ts FROM m) SELECT run, label, round(p / CASE WHEN tp > 0 THEN tp ELSE ts END, 6) AS rate FROM t"),
    "engine_scores": (engine_scores, f"""WITH {_R}, e AS (SELECT 'hybrid' AS engine, truth, predicted FROM r UNION ALL SELECT 'rule', truth, CASE WHEN confidence > 0.5 THEN predicted ELSE [] END FROM r UNION ALL SELECT 'ml', truth, ['good'] FROM r),
c AS (SELECT engine, label, count(*) FILTER (WHERE list_contains(truth, label) AND list_contains(predicted, label)) AS tp, count(*) FILTER (WHERE list_contains(truth, label) <> list_contains(predicted, label)) AS miss FROM e, unnest(['good', 'toxic', 'unused']) AS u(label) GROUP BY ALL), f AS (SELECT engine, avg(2 * tp / (2 * tp + miss)) AS macro_f1 FROM c WHERE tp + miss > 0 GROUP BY 1),
a AS (SELECT engine, avg(list_has_any(truth, predicted)::INT) AS any_match, avg(coalesce(list_contains(truth, predicted[1]), false)::INT) AS top1, avg((list_sort(truth) = list_sort(predicted))::INT) AS exact_match FROM e GROUP BY 1) SELECT a.engine, round(any_match, 6) AS any_match, round(top1, 6) AS top1, round(exact_match, 6) AS exact_match, round(macro_f1, 6) AS macro_f1 FROM a LEFT JOIN f ON a.engine = f.engine"""),
    "first_classes": (first_classes, "SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'quality' ELSE 'healthy' END AS class, count(*) AS n FROM labels GROUP BY 1"),
    "labels_over": (labels_over, "WITH l AS (SELECT l_orderkey, l_returnflag || l_linestatus || l_linenumber AS label, l_quantity / 50 AS p FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, label) AS place FROM l WHERE p >= CASE label WHEN 'NO1' THEN 0.2 WHEN 'AF1' THEN 0.9 WHEN 'RF2' THEN 0.7 ELSE 0.5 END) SELECT l_orderkey, label, p, place FROM k WHERE place <= 3"),
    "batch_status": (batch_status, "WITH " + _SEL.replace(" FROM h)", " FROM h WHERE confidence < 0.9)").replace("FROM h WHERE onset > 0", "FROM h WHERE confidence < 0.9 AND onset > 0") + ", a AS (SELECT DISTINCT log_id FROM h) SELECT CASE WHEN w.failure_type IS NULL THEN 'HEALTHY' WHEN severity = 'critical' THEN 'CRITICAL' ELSE 'WARNING' END AS status, count(*) AS n FROM a LEFT JOIN (SELECT * FROM w WHERE place = 1) w USING (log_id) GROUP BY 1"),
    "incident_clusters": (incident_clusters, f"WITH {_SEL}, io AS (SELECT failure_type, log_id FROM w WHERE place = 1), it AS (SELECT failure_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, failure_type) AS place FROM io GROUP BY failure_type) SELECT failure_type, n, place, log_id FROM it JOIN io USING (failure_type)"),
    "analysis_records": (analysis_records, None),
    "class_splits": (class_splits, "SELECT o_orderpriority || strftime(o_orderdate, '%Y-%m-%d') AS class, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2"),
    "upserted_labels": (upserted_labels, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels"),
    "latest_expert": (latest_expert, "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1"),
    "confidence_order": (confidence_order, "SELECT lower(c_mktsegment) AS level, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1"),
}
