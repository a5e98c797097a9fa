"""Text, posts, holdouts, records, trends and outliers on small rows whose results are written out."""

import html
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import curation, evaluation, features, imports, learning, logs, series, textmine
from aerolith.sources import messages, sinks

TEXTS = [
    "<p>a &amp;lt; b</p>", "&#8212;&#x2014;&#128;&#150;", "caf&eacute; &nope; & &amp", "&nbsp; x&emsp;y z ", "seen [web:3] there\n[web:12]", "", None, "&#1114112; &#55296; &#0;", "&apos;&hearts;&Aacute;&aacute;",
    "&amp;" * 3000 + "<br/>" * 2000, "no end &", "&;&#;&#x;",
]


def test_references_are_read_as_browsers_do(spark):
    got = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").select("id", C.stripped_html(F.col("t")).alias("s")).collect()
    import re

    def want(t):
        # without a semicolon, a reference stays here
        bare = re.sub(r"<[^>]+>", " ", t or "")
        out = re.sub(C.REFERENCE, lambda m: html.unescape(m.group()), bare)
        return re.sub(r"\s+", " ", re.sub(r"\s*\[web:[0-9]+\]", "", out)).strip()

    assert {r.id: r.s for r in got} == {i: want(t) for i, t in enumerate(TEXTS)}


def test_topic_links(spark):
    given = {"https://WWW.Forum.org/t/a/12/3?x#y": "https://forum.org/t/a/12", "https://forum.org/t/a [web:1]": "https://forum.org/t/a", "https://forum.org/": "https://forum.org", "https://else.org/t/a/12/": "https://else.org/t/a/12", "/t/a/1": "/t/a/1", "": "", None: "", "https://forum.org/x/t/s-l/9/t/q/4": "https://forum.org/t/s-l/9"}
    rows = spark.createDataFrame([(k, v) for k, v in given.items()], "u string, want string")
    assert rows.where(C.topic_url(F.col("u"), ["forum.org", "www.forum.org"], "https://forum.org") != F.col("want")).count() == 0


LEXICON = {"vibration_high": ["vibration", "clipping"], "gps_quality_poor": ["gps glitch", "hdop"]}


def _posts(spark):
    rows = [
        (1, 1, "ann", None, None, None, "<p>caused by vibration &amp; clipping</p>"), (1, 2, "bob", "Developer", None, False, "hdop"), (1, 3, "eve", "", "", False, "caused by vibration and clipping"),
        (2, 2, " ann ", None, None, None, "caused by GPS Glitch maybe"), (2, 1, "x", None, "core developers", None, "caused by <b>hdop</b>"), (3, 1, None, None, None, True, "hdop"), (4, 1, "", None, None, None, "caused by vibration"), (5, 1, "ann", None, None, None, None),
    ]
    return spark.createDataFrame(rows, "topic int, number int, username string, title string, `group` string, staff boolean, text string")


def test_best_expert_post_of_a_topic(spark):
    developers = spark.createDataFrame([("ann",), ("ann ",), ("",), (None,)], "username string")
    own = textmine.by_experts(_posts(spark), developers)
    assert sorted((r.topic, r.number) for r in own.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (5, 1)]
    out = textmine.expert_diagnoses(own, "topic", "number", "text", F.lit(True), LEXICON, ["caused by"], ["maybe"], html=True)
    # topic 3 has one point only
    assert sorted(out.collect()) == [(1, "vibration_high", 4, 1, "caused by vibration & clipping", "vibration"), (2, "gps_quality_poor", 3, 1, "caused by hdop", "hdop")]
    assert textmine.expert_diagnoses(own.where("false"), "topic", "number", "text", F.lit(True), LEXICON, ["caused by"], ["maybe"], html=True).count() == 0


def test_attachments_of_labelled_topics(spark):
    link = lambda *urls: " ".join(f'<a href="{u}">x</a>' for u in urls)
    posts = spark.createDataFrame([(1, 2, link("/a.bin", "/b.ZIP", "/c.png")), (1, 1, link("/d.bin", "/a.bin")), (2, 1, link("/a.bin", "https://x.org/e.bin")), (3, 1, link("/f.bin")), (2, 2, None)], "topic int, number int, html string")
    labels = spark.createDataFrame([(1, "vibration_high", 3, "p", "q"), (2, "thrust_loss", 2, "r", "s")], "topic int, label string, score int, phrase string, quote string")
    run = lambda **k: sorted((r.url, r.topic, r.number, r.place, r.label) for r in textmine.labelled_attachments(posts, labels, "topic", "number", "html", "https://f.org", **k).collect())
    every = [("https://f.org/a.bin", 1, 1, 1, "vibration_high"), ("https://f.org/b.ZIP", 1, 2, 1, "vibration_high"), ("https://f.org/d.bin", 1, 1, 0, "vibration_high"), ("https://x.org/e.bin", 2, 1, 1, "thrust_loss")]
    assert run() == every and run(archives=False) == [every[0], *every[2:]]


def test_holdout_takes_new_contents_once(spark):
    manifest = spark.createDataFrame([("old", "a", "s1"), ("n1", "a", "s1"), ("n1", "b", "s2"), ("n1", "c", "s2"), ("n2", "b", "s3"), ("n2", "a", "s2")], "batch string, name string, sha string")
    files = spark.createDataFrame([("n1", "a", 1), ("n1", "b", 2), ("n1", "c", 3), ("n2", "a", 1), ("n2", "b", 2), ("n2", "gone", 3), ("old", "a", 1)], "batch string, name string, position int")
    rows, counts = curation.holdout(files, manifest, ["old"])
    assert sorted(rows.collect()) == [("n1", "b", "s2"), ("n2", "b", "s3")]
    assert counts.first() == (2, 3, 1)
    assert curation.holdout(files.where("false"), manifest, ["old"])[1].first() == (0, 0, 0)


def test_sets_keep_and_skip(spark):
    of = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    out = curation.union_skips({"first": of("a", "a", "b", None), "second": of("a", "c", None), "third": of("c").where("false")}, "k")
    assert sorted(out.collect()) == [("first", 3, 1), ("second", 1, 2), ("third", 0, 0)]
    paths = curation.copy_paths(spark.createDataFrame([("long/x", "t"), ("b", "t"), ("a", "t"), ("z", "u")], "p string, c string"), "p", "c")
    assert sorted((r.canonical, r.path) for r in paths.collect()) == [("a", "b"), ("a", "long/x")]


def test_records_are_the_same_by_six_columns(spark):
    columns = "name string, place int, manifest string, status string, label_raw string, source_type string, thread_url string, resolved_url string, more string"
    rows = [("f", 2, "m", "downloaded", None, "s", "", "u", "later"), ("f", 1, "m", "downloaded", "", "s", None, "u", "first"), ("f", 3, "m2", "downloaded", "x", "s", "https://forum.org/1", "u", "x"), ("f", 4, "m1", "failed", "x", "s", "https://forum.org/1", "u", "x"), ("g", 5, "m3", "failed", None, None, None, None, None)]
    table = spark.createDataFrame(rows, columns)
    assert sorted((r.name, r.place) for r in imports.records(table, "name", "place").collect()) == [("f", 1), ("f", 3), ("f", 4), ("g", 5)]
    best = lambda order: [(r.name, r.place, r.more) for r in imports.best_record(table, "name", order, "forum.org", "place").collect()]
    assert best(["m", "m2"]) == [("f", 1, "first")] and best(["m1"]) == [("f", 3, "x")] and best(["m2"]) == [("f", 3, "x")]


def test_labels_that_a_run_lacks_count_as_none(spark):
    rates = spark.createDataFrame([("a", "r1", 0.5), ("b", "r1", 0.5), ("c", "r2", 1.0), ("a", "r3", 0.6), ("d", "r3", 0.4)], "label string, run string, rate double")
    runs = spark.createDataFrame([("r1", 9), ("r2", 100), ("r3", 4)], "run string, n int")
    out = {r.label: (r.first_rate, r.last_rate, r.rising) for r in evaluation.changes(rates, runs, "label", "run", "rate", "n").collect()}
    assert out == {"a": (0.5, 0.6, True), "b": (0.5, 0.0, False), "d": (0.0, 0.4, True)}
    few = runs.withColumn("n", F.lit(4))
    assert evaluation.changes(rates, few, "label", "run", "rate", "n").where("rising").count() == 0
    flat = spark.createDataFrame([("r", "", None), ("r", None, "x"), ("r", "y", "x"), ("r", "y", None)], "run string, p string, t string")
    assert sorted(evaluation.flat_rates(flat, "run", "p", "t").collect()) == [("r", "healthy", 0.25), ("r", "x", 0.25), ("r", "y", 0.5)]


def test_what_is_behind_the_audit(spark):
    rows = spark.createDataFrame([(1, True, [("a", 0.9, "critical"), ("b", 0.5, "warning"), ("c", 0.7, "critical")]), (2, False, []), (3, True, None), (4, True, [])], "id int, readable boolean, d array<struct<failure_type: string, confidence: double, severity: string>>")
    out = evaluation.critical_details(rows, "id", "d").collect()
    assert sorted(map(tuple, out), key=str) == [(1, "false_critical", "a", 0.9), (1, "false_critical", "c", 0.7), (2, "parse_error", None, None)]


def test_outliers_lie_beyond_a_share_of_the_healthy(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b), i % 2 == 0) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(900, 30.0, -30.0, False), (901, None, 0.0, False)]
    data = spark.createDataFrame(rows, "id long, a double, b double, good boolean")
    got = {r.id: r for r in learning.outliers(data, "id", ["a", "b"], F.col("good"), trees=30, k=1).collect()}
    assert len(got) == 402 and all(r.is_outlier == (r.anomaly_score > 0) for r in got.values())
    assert sum(got[i].is_outlier for i in range(0, 400, 2)) == pytest.approx(10, abs=1)
    assert got[900].is_outlier and got[900].deviations[0].feature in "ab" and max(got, key=lambda i: got[i].anomaly_score) == 900
    own = np.array([(a, b) for _, a, b, good in rows if good])
    assert got[900].deviations[0].size == pytest.approx((np.abs([30, -30] - own.mean(axis=0)) / own.std(axis=0)).max())
    unknown = learning.outliers(data, "id", ["a", "b"], F.lit(False)).collect()
    assert len(unknown) == 402 and not any(r.is_outlier or r.anomaly_score or r.deviations for r in unknown)


def test_messages_errors_and_slices(spark):
    rows = [("x", 1, "ERR", 0, {"Subsys": "12", "ECode": "1"}), ("x", 2, "ERR", 10, {"Subsys": "11", "ECode": "1"}), ("x", 3, "ERR", 20, {"Subsys": "11", "ECode": "2"}), ("x", 4, "ERR", 30, {"Subsys": "12", "ECode": "2"}), ("y", 1, None, 0, None)]
    table = spark.createDataFrame(rows, messages.MESSAGES)
    counts = {r.log_id: (r.n, r.counts) for r in logs.message_counts(table).collect()}
    assert counts == {"x": (4, {"ERR": 4}), "y": (1, {})} and logs.message_counts(table, ["GPS"]).where("log_id = 'x'").first().counts == {}
    first, then = features.ERROR_LABELS[12], features.ERROR_LABELS[11]
    assert [(r.log_id, r.labels) for r in features.error_label_lists(table).collect()] == [("x", [first, then])]
    parts = series.with_slices(table.where("log_id = 'x'"), "log_id", "time_us", 20, 10)
    assert sorted((r.kind, r.window, r.seq) for r in parts.where("kind = 'slice'").collect()) == [("slice", 0, 1), ("slice", 0, 2), ("slice", 1, 2), ("slice", 1, 3)]
    assert parts.where("kind = 'full' and window is null").count() == 4


def test_tables_of_a_benchmark_are_read_back(spark, tmp_path):
    out = str(tmp_path / "bench")
    overall, errors = spark.createDataFrame([(0.5, 3)], "macro_f1 double, total long"), spark.createDataFrame([("a.bin", "EXTRACTION_FAILED")], "file string, error string")
    for batch in ("b1", "b2", "b1"):
        sinks.write_benchmark({"overall": overall, "errors": errors}, out, batch)
    assert sorted((r.macro_f1, r.total, r.batch) for r in spark.read.json(f"{out}/overall").collect()) == [(0.5, 3, "b1"), (0.5, 3, "b2")]
    assert spark.read.json(f"{out}/errors").where("batch = 'b1'").first().error == "EXTRACTION_FAILED"


def test_small_files_beside_the_messages(spark, tmp_path):
    assert messages.read_csv(spark, str(tmp_path / "none.csv"), ["a", "b"]).columns == ["a", "b"]
    (tmp_path / "m.csv").write_text('a,b\n1,"x, y"\n,\n')
    assert [tuple(r) for r in messages.read_csv(spark, str(tmp_path / "m.csv"), ["a", "b"]).collect()] == [("1", "x, y"), (None, None)]
    (tmp_path / "truth.json").write_text(json.dumps({"version": 1, "logs": [{"filename": "a.bin", "labels": ["x"]}, {"filename": "b.bin", "labels": []}]}))
    assert [(r.filename, r.labels) for r in messages.read_ground_truth(spark, str(tmp_path / "truth.json")).orderBy("filename").collect()] == [("a.bin", ["x"]), ("b.bin", [])]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "L.BIN").write_bytes(b"abc")
    (tmp_path / "deep" / "l.txt").write_bytes(b"abc")
    found = messages.scan_files(spark, str(tmp_path), ".bin").collect()
    assert len(found) == 1 and found[0].size_bytes == 3 and bytes(found[0]["head"]) == b"abc" and found[0].sha256.startswith("ba7816bf")
