"""Classifiers of feature rows: boosted trees against a weighted forest, chosen by macro F1, calibrated class by class.

Rows are dealt to folds by a hash of their key, so all rows of a log are in one fold. Boosted trees are one
against the rest; settings are compared by the mean over folds of the macro F1 of predictions for rows that the fit
didn't see. Models are compared by the macro F1 over all classes, also those that a test lacks. The folds'
predictions also calibrate: per class the share of hits is made monotone in the score by pooling adjacent
violators, over scores of three digits, so the driver gets at most 1,001 sums a class.
"""

from __future__ import annotations

import hashlib
import json
import math
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import class_error

# The settings that are compared.
GRID = [{"maxDepth": d, "stepSize": s, "maxIter": n} for d in (3, 4, 5) for s in (0.05, 0.1, 0.2) for n in (20, 50)]
DIGITS = 3


class Boosted(NamedTuple):
    """Classes in order, for each a boosted model, the settings, and for each class the points (score, share) of its calibration."""

    classes: list[str]
    models: list
    settings: dict
    steps: list[list[tuple[float, float]]]


def prepared(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Assembles the columns (nulls count as 0) and scales them by their means and deviations in train."""
    assembler = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    return PipelineModel([assembler, scaler.fit(assembler.transform(train.fillna(0.0, columns)))])


def fold(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit("fold")), F.lit(folds)).cast("int")


def _fit(rows: DataFrame, label: str, classes: list[str], settings: dict) -> list:
    """A model per class; None for a class that train lacks, or that is all of it."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    whole = sum(counts.values())
    out = []
    for c in classes:
        if not 0 < counts.get(c, 0) < whole:
            out.append(None)
            continue
        own = rows.withColumn("_y", (F.col(label) == c).cast("double")).withColumn("_w", F.when(F.col(label) == c, whole / (2.0 * counts[c])).otherwise(whole / (2.0 * (whole - counts[c]))))
        out.append(GBTClassifier(labelCol="_y", weightCol="_w", featuresCol="features", seed=42, **settings).fit(own))
    return out


def _scores(rows: DataFrame, models: list, key: str, label: str) -> DataFrame:
    """key, label and `scores`, one per class."""
    out = rows.select(key, label, "features")
    for i, m in enumerate(models):
        if m is None:
            out = out.withColumn(f"_s{i}", F.lit(0.0))
            continue
        m = m.copy().setPredictionCol("_p").setRawPredictionCol("_r").setProbabilityCol("_q")
        out = m.transform(out).withColumn(f"_s{i}", vector_to_array("_q")[1]).drop("_p", "_r", "_q")
    return out.select(key, label, F.array(*[F.round(F.col(f"_s{i}"), DIGITS) for i in range(len(models))]).alias("scores"))


def picked(scores: DataFrame, classes: list[str]) -> DataFrame:
    """scores with `predicted`: the class of the greatest score, of equals the first."""
    at = F.array_position("scores", F.array_max("scores")).cast("int")
    return scores.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in classes]), at))


def by_class(rows: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """label, precision, recall, f1, support; 0 where undefined."""
    both = rows.select(F.col(label).alias("label"), F.lit(1).alias("t"), (F.col(label) == F.col(predicted)).cast("int").alias("hit"), F.lit(0).alias("p")).unionByName(rows.select(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(0).alias("hit"), F.lit(1).alias("p")))
    sums = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("hit").alias("_hit"), F.sum("p").alias("_p"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("label", share(F.col("_hit"), F.col("_p")).alias("precision"), share(F.col("_hit"), F.col("support")).alias("recall"), share(2 * F.col("_hit"), F.col("_p") + F.col("support")).alias("f1"), "support")


def macro_f1(rows: DataFrame, label: str, predicted: str = "predicted", classes: list[str] | None = None) -> float:
    """The mean of F1 over the classes that are true or predicted in rows; with `classes` over these, too, 0 for those that rows lack."""
    found = {r.label: r.f1 for r in by_class(rows, label, predicted).collect()}
    every = found.keys() | set(classes or [])
    return math.fsum(found.values()) / len(every) if every else 0.0


def fold_f1(rows: DataFrame, label: str, fold: str) -> float:
    """The mean over folds of each one's macro F1, a fold's over the classes that are true or predicted in it."""
    both = by_class(rows.select(F.struct(F.col(fold).alias("fold"), F.col(label).alias("c")).alias("label"), F.struct(F.col(fold).alias("fold"), F.col("predicted").alias("c")).alias("predicted")), "label")
    return float(both.groupBy("label.fold").agg(F.avg("f1").alias("f1")).agg(F.avg("f1")).first()[0] or 0.0)


def calibration_error(rows: DataFrame, label: str, classes: list[str]) -> float:
    """The mean over classes of the calibration error of `probabilities`, one per class, in ten bins."""
    each = rows.select(label, F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("c"), F.col("probabilities").alias("p"))).alias("_x"))
    return float(class_error(each.select(F.col("_x.c").alias("class"), F.col("_x.p").alias("p"), (F.col("_x.c") == F.col(label)).cast("int").alias("hit"))).first().ece or 0.0)


def pooled(sums: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """Points (score, share of hits), both ascending, from (score, rows, hits) by ascending score: adjacent ones that
    fall are pooled; a pool has its share from its first to its last score."""
    blocks: list[list[float]] = []
    for score, n, hits in sums:
        blocks.append([score, score, n, hits])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, end, m, more = blocks.pop()
            blocks[-1][1] = end
            blocks[-1][2] += m
            blocks[-1][3] += more
    return [(x, hits / n) for start, end, n, hits in blocks for x in ([start] if start == end else [start, end])]


def _step(score: Column, points: list[tuple[float, float]]) -> Column:
    """The share at the score: straight lines between points, and the first and the last one's beyond them."""
    xs, ps = F.array(*[F.lit(a) for a, _ in points]), F.array(*[F.lit(p) for _, p in points])
    below = F.size(F.filter(xs, lambda x: x <= score))
    x0, x1, p0, p1 = F.get(xs, below - 1), F.get(xs, below), F.get(ps, below - 1), F.get(ps, below)
    return F.when(below == 0, p1).when(below == len(points), p0).otherwise(p0 + (p1 - p0) * (score - x0) / (x1 - x0))


def boosted(train: DataFrame, key: str, label: str, grid: list[dict] | None = None, folds: int = 3) -> tuple[Boosted, DataFrame]:
    """The calibrated model, and a row per setting with its macro F1. train: of prepared, `features` among its columns."""
    classes = sorted(r[0] for r in train.select(label).distinct().collect())
    rows = train.select(key, label, "features").withColumn("_fold", fold(key, folds)).persist()
    found = []
    for settings in grid or GRID:
        # of each fold the scores of models that were fitted on the others
        parts = [_scores(rows.where(F.col("_fold") == k), _fit(rows.where(F.col("_fold") != k), label, classes, settings), key, label).withColumn("_fold", F.lit(k)) for k in range(folds)]
        unseen = parts[0]
        for p in parts[1:]:
            unseen = unseen.unionByName(p)
        unseen = picked(unseen, classes).persist()
        found.append((fold_f1(unseen, label, "_fold"), settings, unseen))
    best = max(range(len(found)), key=lambda i: (round(found[i][0], 9), -i))
    settings, unseen = found[best][1], found[best][2]
    sums = unseen.select(label, F.posexplode("scores").alias("c", "s")).groupBy("c", "s").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("c") + 1)).alias("hits")).collect()
    steps = [pooled(sorted((r.s, r.n, r.hits) for r in sums if r.c == i)) for i in range(len(classes))]
    model = Boosted(classes, _fit(rows, label, classes, settings), settings, steps)
    table = train.sparkSession.createDataFrame([(json.dumps(s, sort_keys=True), float(f), i == best) for i, (f, s, _) in enumerate(found)], "settings string, macro_f1 double, chosen boolean")
    for _, _, u in found:
        u.unpersist()
    rows.unpersist()
    return model, table


def calibrated(model: Boosted, scores: DataFrame) -> DataFrame:
    """scores with `probabilities`: each class's calibrated share, made to sum to 1 (all equal where all are 0)."""
    shares = F.array(*[_step(F.get("scores", F.lit(i)), s) for i, s in enumerate(model.steps)])
    out = scores.withColumn("_c", shares).withColumn("_t", F.aggregate("_c", F.lit(0.0), lambda a, x: a + x))
    return out.withColumn("probabilities", F.transform("_c", lambda x: F.when(F.col("_t") > 0, x / F.col("_t")).otherwise(1.0 / len(model.classes)))).drop("_c", "_t")


def uncalibrated(model: Boosted, rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, scores, probabilities (the scores, made to sum to 1), predicted of rows, without calibration."""
    out = picked(_scores(rows, model.models, key, label), model.classes)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("probabilities", F.transform("scores", lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(model.classes))))


def predicted(model: Boosted, rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, scores, probabilities, predicted of rows (with `features`)."""
    out = calibrated(model, _scores(rows, model.models, key, label))
    return picked(out.withColumnRenamed("scores", "_scores").withColumnRenamed("probabilities", "scores"), model.classes).withColumnRenamed("scores", "probabilities").withColumnRenamed("_scores", "scores")


def forest(train: DataFrame, label: str, columns: list[str], trees: int = 200, depth: int = 10) -> tuple[object, list[str], DataFrame]:
    """A forest with classes of equal weight, its classes in order, and the importance of each column."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    classes = sorted(counts)
    weight = F.create_map(*[F.lit(x) for c in classes for x in (c, sum(counts.values()) / (len(classes) * counts[c]))])[F.col(label)]
    own = train.withColumn("_y", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double")).withColumn("_w", weight)
    model = RandomForestClassifier(labelCol="_y", weightCol="_w", featuresCol="features", numTrees=trees, maxDepth=depth, seed=42).fit(own)
    importances = train.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, importance double")
    return model, classes, importances


def forest_predicted(model, classes: list[str], rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, predicted, probabilities (one per class) of rows."""
    out = model.copy().setPredictionCol("_p").setProbabilityCol("_q").transform(rows)
    return out.select(key, label, F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_p").cast("int") + 1).alias("predicted"), vector_to_array("_q").alias("probabilities"))


def fingerprint(names: list[str]) -> str:
    """SHA-256 of the JSON list of names."""
    return hashlib.sha256(json.dumps(names).encode()).hexdigest()


def manifest(columns: list[str], labels: list[str], thresholds: str = "") -> dict[str, str]:
    """What a stored model depends on: names of features and labels, and the text of the thresholds."""
    return {"features": fingerprint(columns), "labels": fingerprint(labels), "thresholds": hashlib.sha256(thresholds.encode()).hexdigest() if thresholds else ""}


def checked(stored: dict[str, str], columns: list[str], labels: list[str], thresholds: str = "") -> None:
    """Refuses a stored model whose manifest isn't that of this run."""
    now = manifest(columns, labels, thresholds)
    off = [k for k in now if stored.get(k, "") != now[k]]
    if off:
        raise ValueError(f"the stored model was made with other {', '.join(off)}")
