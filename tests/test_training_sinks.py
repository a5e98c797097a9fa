"""Training, oversampling, sinks, streams and sources, on small rows and folders."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import diagnosis, oversampling, rules, training
from aerolith.sources import messages, sinks
from aerolith.streaming import incremental


@pytest.fixture(scope="module")
def table(spark):
    pick = random.Random(1)
    rows = []
    for i in range(240):
        kind = ["a", "b", "c"][i % 7 % 3]
        x = {"a": (0, 0), "b": (3, 0), "c": (0, 3)}[kind]
        rows.append((i, kind, x[0] + pick.gauss(0, 1), x[1] + pick.gauss(0, 1), None))
    return spark.createDataFrame(rows, "id long, class string, x double, y double, z double").cache()


def test_boosted_trees_are_compared_by_what_they_did_not_see(spark, table):
    columns = ["x", "y", "z"]
    rows = training.prepared(table, columns).transform(table.fillna(0.0, columns))
    grid = [{"maxDepth": 1, "stepSize": 0.01, "maxIter": 1}, {"maxDepth": 3, "stepSize": 0.3, "maxIter": 5}]
    model, settings = training.boosted(rows.where("id % 4 > 0"), "id", "class", grid, folds=2)
    found = settings.collect()
    assert len(found) == 2 and sum(r.chosen for r in found) == 1 and json.loads(next(r.settings for r in found if r.chosen)) == model.settings
    assert max(r.macro_f1 for r in found) == next(r.macro_f1 for r in found if r.chosen)
    test = training.predicted(model, rows.where("id % 4 = 0"), "id", "class")
    got = test.collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in got)
    # F1 of each class, recomputed from its rows
    by = {r.label: r for r in training.by_class(test, "class").collect()}
    for c in "abc":
        hit = sum(r["class"] == c == r.predicted for r in got)
        said, are = sum(r.predicted == c for r in got), sum(r["class"] == c for r in got)
        assert by[c].f1 == pytest.approx(2 * hit / (said + are)) and by[c].support == are
    assert training.macro_f1(test, "class") > 0.7
    trees, classes, importances = training.forest(rows.where("id % 4 > 0"), "class", columns, trees=10, depth=4)
    weight = {r.feature: r.importance for r in importances.collect()}
    assert set(weight) == set(columns) and weight["z"] == 0 and sum(weight.values()) == pytest.approx(1)
    assert training.macro_f1(training.forest_predicted(trees, classes, rows.where("id % 4 = 0"), "id", "class"), "class") > 0.7


def test_macro_f1_counts_classes_that_the_test_lacks(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "b", "b")], "id long, class string, predicted string")
    f1 = (2 / 3 + 2 / 3) / 3
    assert training.macro_f1(rows, "class", classes=["a", "b", "c"]) == pytest.approx(f1)
    # a class that training lacks still counts
    assert training.macro_f1(rows, "class", classes=["a", "c"]) == pytest.approx(f1)


def test_settings_are_compared_by_the_mean_of_their_folds(spark):
    rows = [("a", "a", 0), ("b", "b", 0), ("b", "b", 0), ("a", "b", 1), ("a", "a", 1), ("b", "a", 1)]
    df = spark.createDataFrame(rows, "class string, predicted string, k int")
    # fold 0: 1; fold 1: a 2 * 1 / (2 + 2), b 0
    assert training.fold_f1(df, "class", "k") == pytest.approx((1 + (0.5 + 0) / 2) / 2)
    assert training.macro_f1(df, "class") == pytest.approx(2 / 3) != training.fold_f1(df, "class", "k")


def test_choice_has_the_error_of_calibration_of_all_three(spark, sf_dir):
    from aerolith.plans import learn

    got = {r.model: r for r in learn.model_choice(spark, sf_dir).collect()}
    assert set(got) == {"boosted", "boosted_uncalibrated", "forest"} and all(0 <= r.calibration_error <= 1 for r in got.values())
    best = "boosted" if got["boosted"].macro_f1 >= got["forest"].macro_f1 else "forest"
    assert [r.model for r in got.values() if r.taken] == [best]
    # two bins: 2 * |0.25 - 0.5| / 4 + 2 * |0.75 - 1| / 4 of one class, and the same of the other
    rows = spark.createDataFrame([("a", [0.75, 0.25]), ("a", [0.75, 0.25]), ("b", [0.25, 0.75]), ("a", [0.25, 0.75])], "class string, probabilities array<double>")
    assert training.calibration_error(rows, "class", ["a", "b"]) == pytest.approx(0.25)


def test_pooling_equals_plain_isotonic_regression():
    pick = random.Random(3)
    sums = [(i / 50, pick.randint(1, 9), 0) for i in range(50)]
    sums = [(s, n, pick.randint(0, n)) for s, n, _ in sums]
    steps = training.pooled(sums)
    assert all(a[1] <= b[1] and a[0] < b[0] for a, b in zip(steps, steps[1:]))
    # the definition: max over begins of min over ends of the mean
    n, h = np.array([x[1] for x in sums]), np.array([x[2] for x in sums])
    want = [max(min(h[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 50)) for a in range(i + 1)) for i in range(50)]
    got = np.interp([x[0] for x in sums], *zip(*steps))
    assert np.allclose(got, want)


def test_calibration_error_does_not_grow(spark):
    pick = random.Random(5)
    rows = [(i, round(pick.random(), 3)) for i in range(2000)]
    rows = [(i, s, int(pick.random() < s**3)) for i, s in rows]
    fit, rest = rows[:1000], rows[1000:]
    sums = {}
    for _, s, y in fit:
        n, h = sums.get(s, (0, 0))
        sums[s] = (n + 1, h + y)
    steps = training.pooled([(s, *v) for s, v in sorted(sums.items())])
    df = spark.createDataFrame(rest, "id long, s double, y int").withColumn("p", training._step(F.col("s"), steps))
    bins = lambda c: sum(abs(r.a - r.b) * r.n for r in df.groupBy(F.floor(F.col(c) * 10)).agg(F.avg(c).alias("a"), F.avg("y").alias("b"), F.count(F.lit(1)).alias("n")).collect()) / 1000
    assert bins("p") < 0.06 < bins("s")


def test_manifest_refuses_another_run():
    stored = training.manifest(["a", "b"], ["x"], "bounds: 1")
    training.checked(stored, ["a", "b"], ["x"], "bounds: 1")
    for other in ((["b", "a"], ["x"], "bounds: 1"), (["a", "b"], ["y"], "bounds: 1"), (["a", "b"], ["x"], "bounds: 2")):
        with pytest.raises(ValueError):
            training.checked(stored, *other)


def test_neighbours_and_new_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "big" if i < 60 else "mid" if i < 75 else "one", [float(v) for v in rng.normal(size=4)]) for i in range(76)]
    df = spark.createDataFrame(rows, "id long, class string, v array<double>")
    got = {}
    for r in oversampling.nearest_in_class(df, "id", "class", "v", k=4, block=9).collect():
        got.setdefault(r.key, {})[r.place] = r.neighbour
    for i, c, v in rows:
        others = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)), 9), j) for j, d, w in rows if d == c and j != i)
        assert [got.get(i, {}).get(p) for p in range(1, len(others[:4]) + 1)] == [j for _, j in others[:4]]
    out = oversampling.oversampled(df, "id", "class", "v", k=4)
    new = out.where("copy > 0").collect()
    assert {r["class"]: r["count"] for r in out.groupBy("class").count().collect()} == {"big": 60, "mid": 60, "one": 60}
    by = {i: np.array(v) for i, _, v in rows}
    for r in new:
        if r["class"] == "one":
            assert r.v == rows[75][2]
            continue
        ways = [(np.array(r.v) - by[r.id], by[j] - by[r.id]) for j in got[r.id].values()]
        assert any(np.allclose(a, (a @ b) / (b @ b) * b) and -1e-9 <= (a @ b) / (b @ b) <= 1 + 1e-9 for a, b in ways)
    assert sorted(map(str, new)) == sorted(map(str, oversampling.oversampled(df.repartition(7), "id", "class", "v", k=4).where("copy > 0").collect()))


def test_texts_are_read_once_for_all_fits(spark, sf_dir):
    from aerolith.plans import learn

    train, test = learn._fitted(spark, sf_dir)
    for rows in (train, test):
        assert "InMemoryTableScan" in rows._jdf.queryExecution().executedPlan().toString()
    assert train.count() + test.count() == learn._texts(spark, sf_dir).count()


def test_neighbours_are_ordered_by_the_exact_distance_and_copies_count_by_id(spark):
    import math
    import random

    rng = random.Random(5)
    # distances far below 1e-9 when squared, copies of one vector, and a class of one
    rows = [(k, k % 2, [1 + 1e-6 * rng.random() for _ in range(20)]) for k in range(60)]
    rows += [(100 + k, 0, rows[0][2]) for k in range(40)] + [(200, 7, [1.0] * 20)]
    df = spark.createDataFrame(rows, "id long, class int, v array<double>")
    want = set()
    for i, c, v in rows:
        near = sorted((math.sqrt(sum((a - b) * (a - b) for a, b in zip(v, w))), j) for j, d, w in rows if d == c and j != i)[:3]
        want |= {(c, i, j, place + 1) for place, (_, j) in enumerate(near)}
    assert {tuple(r) for r in oversampling.nearest_in_class(df, "id", "class", "v", k=3, block=11).collect()} == want


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = oversampling.numbered(df, "g", "id", cell=90).groupBy("g").agg(F.min("at").alias("a"), F.max("at").alias("z"), F.countDistinct("at").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    assert all(r.a == 0 and r.z == r.m - 1 and r.n == r.m for r in got)


def test_batches_replace_their_own_part(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    for _ in range(2):
        sinks.write_import({"clean": rows, "rejected": rows.where("id = 2")}, str(tmp_path / "m"), "b1")
    sinks.write_import({"clean": rows.where("id = 1"), "rejected": rows.limit(0)}, str(tmp_path / "m"), "b2")
    read = lambda n: sorted((r.id, r.batch) for r in spark.read.parquet(str(tmp_path / "m" / n)).collect())
    assert read("clean") == [(1, "b1"), (1, "b2"), (2, "b1")] and read("rejected") == [(2, "b1")]
    for _ in range(2):
        sinks.write_report(rows, rows.select(F.to_json(F.struct("id", "x")).alias("record")), str(tmp_path / "r"), "b1")
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "r" / "records")).collect()) == [1, 2]
    assert spark.read.csv(str(tmp_path / "r" / "summary"), header=True).count() == 2


def test_known_cases_are_numbered_on(spark, tmp_path):
    path = str(tmp_path / "known")
    sinks.append_known(spark.range(7).toDF("k"), path, "k")
    sinks.append_known(spark.range(10, 1010).toDF("k"), path, "k")
    ids = sorted((r.id for r in spark.read.parquet(path).collect()), key=lambda x: int(x[6:]))
    assert ids == [f"known_{i:03d}" for i in range(1, 1008)]


def test_new_rows_over_runs(spark, tmp_path):
    land, table, mark = (str(tmp_path / n) for n in ("land", "table", "mark"))

    def arrive(day, rows):
        spark.createDataFrame(rows, "topic string, url string").coalesce(1).write.mode("append").json(f"{land}/day={day}")

    def run():
        incremental.daily(spark, land, "topic string, url string", table, ["topic", "url"], mark)
        return sorted((r.topic, r.url or "", r.batch) for r in spark.read.parquet(table).collect())

    arrive("2024-01-01", [("a", "u1"), ("a", "u1"), ("b", None)])
    assert run() == [("a", "u1", 0), ("b", "", 0)]
    arrive("2024-01-02", [("a", "u1"), ("b", None), ("b", "u2")])
    second = [("a", "u1", 0), ("b", "", 0), ("b", "u2", 1)]
    assert run() == second and run() == second
    # a lost batch that is run again replaces its part; late rows of an old day are new rows still
    arrive("2024-01-01", [("c", "u3"), ("b", "u2")])
    assert run() == [*second, ("c", "u3", 2)]


def test_logs_that_cannot_be_read_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, "VIBE", 5, {"VibeZ": "1"}), (2, "GPS", 6, {"HDop": "1"}), (3, "GPS", 7, {})], "seq long, msg_type string, time_us long, fields map<string,string>")
    for name, own in (("one", rows), ("none", rows.limit(0))):
        own.coalesce(1).write.parquet(str(tmp_path / f"w_{name}"))
        part = next((tmp_path / f"w_{name}").glob("part-*.parquet"))
        (tmp_path / "logs").mkdir(exist_ok=True)
        part.rename(tmp_path / "logs" / f"{name}.parquet")
    (tmp_path / "logs" / "broken.parquet").write_bytes(b"no parquet at all")
    logs, own = messages.read_logs(spark, str(tmp_path / "logs"), ["GPS", "VIBE"])
    got = {r.log_id: (r.n, r.counts) for r in logs.collect()}
    assert got == {"one": (3, {"GPS": 2, "VIBE": 1}), "none": (0, {}), "broken": (0, {})}
    assert "PushedFilters: [In(msg_type" in own._jdf.queryExecution().executedPlan().toString().replace("PushedFilters: [IsNotNull(msg_type), ", "PushedFilters: [")
    assert {r.log_id for r in own.collect()} == {"one"}


def test_thresholds_of_a_table_change_results(spark):
    row = spark.createDataFrame([(1, 25.0)], "log_id long, vibe_z_max double").withColumns({c: F.lit(0.0) for c in ("vibe_x_max", "vibe_y_max", "vibe_clip")})
    given = messages.thresholds(spark.createDataFrame([("vibe_max_warn", "20"), ("vibe_max_fail", "24"), ("unknown", "1"), ("bad", None)], "name string, value string"))
    table = rules.with_thresholds(diagnosis.with_public(given))
    own = lambda t: [(r.failure_type, round(r.confidence, 3)) for r in diagnosis.rule_hits(row, "log_id", {"vibration_high": t["vibration_high"]}).collect()]
    assert own(rules.ALL) == [] and own(table) == [("vibration_high", 0.2)]
    with pytest.raises(ValueError):
        messages.thresholds(spark.range(20).selectExpr("cast(id as string) AS name", "id AS value"), most=5)
