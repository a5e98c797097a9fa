"""Multi-label metrics, calibration and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_metrics(results: DataFrame, truth: str, predicted: str, labels: DataFrame) -> DataFrame:
    """Per label of the small table labels(label): tp, fp, fn, tn, support, precision, recall, f1 (0 where empty)."""
    t, p = F.array_contains(truth, F.col("label")), F.array_contains(predicted, F.col("label"))
    rows = results.select(truth, predicted).crossJoin(F.broadcast(labels))
    out = rows.groupBy("label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count_if(t).alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(metrics: DataFrame) -> DataFrame:
    """Mean F1 over labels that occur or were predicted."""
    return metrics.where("support > 0 or fp > 0").agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("active_labels"))


def accuracies(results: DataFrame, truth: str, predicted: str) -> DataFrame:
    any_ = F.arrays_overlap(truth, predicted)
    top = F.coalesce(F.array_contains(truth, F.try_element_at(F.col(predicted), F.lit(1))), F.lit(False))
    exact = F.array_sort(truth) == F.array_sort(predicted)
    return results.agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for c, n in ((any_, "any_match"), (top, "top1"), (exact, "exact_match"))])


def reliability(df: DataFrame, confidence: Column, correct: Column, bins: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per bin (the last one closed): n, mean confidence, accuracy."""
    b = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    return df.select(*keys, b.alias("bin"), confidence.alias("_c"), correct.cast("double").alias("_a")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("confidence"), F.avg("_a").alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error of reliability()."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def trend(rates: DataFrame, key: str, run: str, rate: str, samples: str, least_change: float = 0.10, least_samples: int = 5) -> DataFrame:
    """First and last run of each key; flagged if the rate moved and either run has enough samples."""
    out = rates.groupBy(key).agg(F.min_by(rate, run).alias("first_rate"), F.max_by(rate, run).alias("last_rate"), F.min_by(samples, run).alias("first_n"), F.max_by(samples, run).alias("last_n"))
    delta = F.col("last_rate") - F.col("first_rate")
    return out.withColumn("delta", delta).withColumn("flagged", (F.abs(delta) >= least_change) & ((F.col("first_n") >= least_samples) | (F.col("last_n") >= least_samples)))


def changes(rates: DataFrame, runs: DataFrame, label: str, run: str, rate: str, samples: str, least_change: float = 0.10, least_samples: int = 5) -> DataFrame:
    """Labels of the first or the last run: first_rate, last_rate (0 where a run lacks the label), delta, rising.

    runs: run, samples, one row of each; first and last are by the order of run. rising: up by `least_change`
    or more, and one of the two runs has `least_samples`.
    """
    ends = runs.agg(F.min(run).alias("_a"), F.max(run).alias("_z"), F.min_by(samples, run).alias("_an"), F.max_by(samples, run).alias("_zn"))
    own = rates.join(F.broadcast(ends)).where((F.col(run) == F.col("_a")) | (F.col(run) == F.col("_z")))
    of = lambda end: F.coalesce(F.max(F.when(F.col(run) == F.col(end), F.col(rate))), F.lit(0.0))
    out = own.groupBy(label).agg(of("_a").alias("first_rate"), of("_z").alias("last_rate"), F.max(F.greatest("_an", "_zn")).alias("_n"))
    delta = F.col("last_rate") - F.col("first_rate")
    return out.withColumn("delta", delta).withColumn("rising", (F.round(delta, 9) >= least_change) & (F.col("_n") >= least_samples)).drop("_n")


def gates(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Metrics (name, value) that fall below targets (name, target), or are missing."""
    return F.broadcast(targets).join(metrics, "name", "left").where("value is null or value < target")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def outcomes(truth: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Each truth row with `outcome`: ok, EXTRACTION_FAILED (no features, or not extracted) or DIAGNOSIS_FAILED.

    features: key, extracted, diagnosed.
    """
    rows = truth.join(features.select(key, "extracted", "diagnosed", F.lit(True).alias("_there")), key, "left")
    failed = F.col("_there").isNull() | ~F.coalesce("extracted", F.lit(False))
    return rows.withColumn("outcome", F.when(failed, "EXTRACTION_FAILED").when(~F.coalesce("diagnosed", F.lit(False)), "DIAGNOSIS_FAILED").otherwise("ok")).drop("_there", "extracted", "diagnosed")


def run_counters(rows: DataFrame) -> DataFrame:
    """Counts of a run by outcome; failed diagnoses were extracted, but no part of the total."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return rows.agg((n("ok") + n("EXTRACTION_FAILED")).alias("total"), n("ok").alias("extracted"), n("EXTRACTION_FAILED").alias("failed_extractions"), n("DIAGNOSIS_FAILED").alias("failed_diagnoses"))


def confusions(results: DataFrame, key: str, truth: str, predicted: str, most: int | None = None) -> DataFrame:
    """Rows whose sets of labels differ: key, missed, added (sorted); with `most` the first ones, as a report shows them."""
    out = results.where(F.array_sort(F.array_distinct(truth)) != F.array_sort(F.array_distinct(predicted)))
    out = out.select(key, F.array_sort(F.array_except(truth, predicted)).alias("missed"), F.array_sort(F.array_except(predicted, truth)).alias("added"))
    return out if most is None else out.orderBy(key).limit(most)


def class_bins(probabilities: DataFrame, bins: int = 10) -> DataFrame:
    """Per class and half-open bin of (class, p, hit): n, confidence, accuracy. A p of 1 falls out of all bins."""
    rows = probabilities.where((F.col("p") >= 0) & (F.col("p") < 1)).withColumn("bin", F.floor(F.col("p") * bins).cast("int"))
    return rows.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def class_error(probabilities: DataFrame, bins: int = 10) -> DataFrame:
    """Mean over classes of the calibration error of each; rows out of all bins count in the number of rows."""
    size = probabilities.groupBy("class").agg(F.count(F.lit(1)).alias("rows"))
    gap = class_bins(probabilities, bins).groupBy("class").agg(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("gap"))
    return size.join(gap, "class", "left").agg(F.avg(F.coalesce("gap", F.lit(0.0)) / F.col("rows")).alias("ece"), F.count(F.lit(1)).alias("classes"))


def review_rate(decisions: DataFrame) -> DataFrame:
    """Share of decisions that are uncertain or want a person."""
    return decisions.agg(F.coalesce(F.avg(((F.col("status") == "uncertain") | F.coalesce("needs_review", F.lit(False))).cast("double")), F.lit(0.0)).alias("abstention"))


def false_criticals(results: DataFrame, truth: str, severities: str) -> DataFrame:
    """Of healthy logs the share with a critical diagnosis, and how many there are of both."""
    own = results.where(F.array_contains(truth, "healthy"))
    bad = F.array_contains(severities, "critical")
    return own.agg(F.count(F.lit(1)).alias("healthy"), F.count_if(bad).alias("critical"), F.coalesce(F.avg(bad.cast("double")), F.lit(0.0)).alias("rate"))


def critical_audit(rows: DataFrame) -> DataFrame:
    """False criticals over a reference set, in which logs that could not be read count as healthy and calm; rows: readable, critical."""
    return rows.agg(F.count(F.lit(1)).alias("logs"), F.count_if(~F.col("readable")).alias("errors"), F.coalesce(F.avg((F.col("readable") & F.col("critical")).cast("double")), F.lit(0.0)).alias("rate"))


def critical_details(rows: DataFrame, key: str, diagnoses: str) -> DataFrame:
    """What is behind critical_audit, a row for each critical diagnosis of a healthy log and each log that could not be read.

    rows: readable, diagnoses (array of failure_type, confidence, severity). Columns: key, finding (false_critical or
    parse_error), failure_type, confidence.
    """
    bad = F.filter(diagnoses, lambda d: d["severity"] == "critical")
    read = rows.where("readable").select(key, F.lit("false_critical").alias("finding"), F.inline(F.transform(bad, lambda d: F.struct(d["failure_type"].alias("failure_type"), d["confidence"].alias("confidence")))))
    return read.unionByName(rows.where("not readable").select(key, F.lit("parse_error").alias("finding")), allowMissingColumns=True)


def calibration_report(results: DataFrame, decisions: DataFrame, truth: str, predicted: str, severities: str, confidence: str, ece: float = 0.08, rate: float = 0.10) -> DataFrame:
    """One row: samples, healthy, ece (of the first diagnosis), abstention, false criticals, and whether both targets are met."""
    top = results.where(F.size(predicted) > 0)
    error = calibration_error(reliability(top, F.col(confidence), F.array_contains(F.col(truth), F.try_element_at(F.col(predicted), F.lit(1))))).select(F.coalesce("ece", F.lit(0.0)).alias("ece"))
    out = results.agg(F.count(F.lit(1)).alias("samples")).join(F.broadcast(error)).join(F.broadcast(review_rate(decisions))).join(F.broadcast(false_criticals(results, truth, severities).select("healthy", F.col("rate").alias("false_critical_rate"))))
    return out.withColumn("ece_met", F.col("ece") <= ece).withColumn("rate_met", F.col("false_critical_rate") <= rate)


def label_rates(metrics: DataFrame, run: str) -> DataFrame:
    """Per run and label the share of all predictions (tp + fp), or of the support where a run predicts nothing."""
    whole = metrics.groupBy(run).agg(F.sum(F.col("tp") + F.col("fp")).alias("_p"), F.sum("support").alias("_s"))
    total = F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.col("_s"))
    return metrics.join(whole, run).where(total > 0).select(run, "label", ((F.col("tp") + F.col("fp")) / total).alias("rate"))


def flat_rates(rows: DataFrame, run: str, predicted: str, top: str) -> DataFrame:
    """Per run and label the share of its rows: by `predicted`, else by `top`, else healthy. Empty texts count as none."""
    label = F.coalesce(F.nullif(F.col(predicted), F.lit("")), F.nullif(F.col(top), F.lit("")), F.lit("healthy"))
    counts = rows.groupBy(run, label.alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.groupBy(run).agg(F.sum("_n").alias("_t"))
    return counts.join(whole, run).select(run, "label", (F.col("_n") / F.col("_t")).alias("rate"))


def engine_scores(results: DataFrame, engine: str, truth: str, predicted: str, labels: DataFrame) -> DataFrame:
    """Per engine: macro F1 over labels that occur or were predicted, any match, top 1, exact match. One job for all engines."""
    t, p = F.array_contains(truth, F.col("label")), F.array_contains(predicted, F.col("label"))
    rows = results.select(engine, truth, predicted).join(F.broadcast(labels))
    counts = rows.groupBy(engine, "label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")).where("tp + fp + fn > 0")
    macro = counts.groupBy(engine).agg(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"))
    top = F.coalesce(F.array_contains(truth, F.try_element_at(F.col(predicted), F.lit(1))), F.lit(False))
    shares = {"any_match": F.arrays_overlap(truth, predicted), "top1": top, "exact_match": F.array_sort(truth) == F.array_sort(predicted)}
    return results.groupBy(engine).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in shares.items()]).join(macro, engine, "left")


def first_class(rows: DataFrame, flags: list[str], none: str = "healthy") -> DataFrame:
    """rows with `class`, the first of the 0/1 columns that is set."""
    return rows.withColumn("class", F.coalesce(*[F.when(F.col(c) == 1, c) for c in flags], F.lit(none)))


def labels_over(probabilities: DataFrame, key: str, thresholds: DataFrame, shown: int = 3) -> DataFrame:
    """Classifier labels that reach their own threshold (label, threshold; else 0.5), the `shown` surest of each log."""
    own = probabilities.join(F.broadcast(thresholds), "label", "left").where(F.col("p") >= F.coalesce("threshold", F.lit(0.5)))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "label"))).where(F.col("place") <= shown).select(key, "label", "p", "place")


def batch_status(chosen: DataFrame, logs: DataFrame, key: str) -> DataFrame:
    """HEALTHY, WARNING or CRITICAL of each log, by its first diagnosis (place, failure_type, confidence, severity)."""
    first = chosen.where("place = 1").select(key, "failure_type", "confidence", "severity")
    status = F.when(F.col("failure_type").isNull(), "HEALTHY").when(F.col("severity") == "critical", "CRITICAL").otherwise("WARNING")
    return logs.select(key).join(first, key, "left").withColumn("status", status)


def clusters(first: DataFrame, label: str, key: str) -> DataFrame:
    """Incidents by their first diagnosis, a row for each log: label, n (its logs), place (by n, then name), key.

    The labels, a few, are counted and placed; the logs stay rows, so a label may have any number of them.
    """
    counts = first.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    placed = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), label)))
    return first.select(label, key).join(F.broadcast(placed), label).select(label, "n", "place", key)
