"""Queries on posts, holdouts, records, trends, outliers and training rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import curation, diagnosis, evaluation, features, imports, learning, logs, series, textmine
from aerolith.sources.messages import events

from . import curate, detect, flight
from . import imports as files

HOSTS, BASE = ["forum.example.org", "www.forum.example.org"], files.BASE


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Links as people write them, in SQL that both engines read alike.
_LINK = "CASE o_orderkey % 6 WHEN 0 THEN concat('https://WWW.forum.example.org/t/', lower(o_orderpriority), '/', o_orderkey, '/7?page=2#x') WHEN 1 THEN concat(' https://forum.example.org/t/a-b/', o_orderkey, ' [web:12]') WHEN 2 THEN concat('http://forum.example.org/c/', o_orderkey, '//') WHEN 3 THEN concat('https://other.example.org/t/a/', o_orderkey, '/') WHEN 4 THEN concat('/t/x/', o_orderkey) ELSE NULL END"


def topic_urls(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", C.topic_url(F.expr(_LINK), HOSTS, BASE).alias("url"))


#: Posts of a forum: who wrote them, and the text with markup, a reference of each kind and a mark of citation.
_POST = {"topic": "conv_id", "number": "turn", "username": "concat('u', conv_id % 37)", "title": "CASE WHEN conv_id % 11 = 0 THEN 'Core Developer ' ELSE '' END", "grp": "CASE WHEN conv_id % 13 = 0 THEN 'DEVELOPERS' END", "staff": "role = 'assistant' AND turn % 4 = 1", "html": "concat('<p class=\"x\">', text, '</p><a href=\"/uploads/', conv_id % 40, '.', CASE turn % 3 WHEN 0 THEN 'bin' WHEN 1 THEN 'zip' ELSE 'png' END, '\">caf&eacute; &#8212; &#x2014;&amp;lt; &nope;</a> [web:3]')"}


def _posts(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select(*[F.expr(e).alias(n) for n, e in _POST.items()])


def _diagnoses(spark, sf_dir):
    developers = _t(spark, sf_dir, "customer").where("c_custkey < 37 AND c_custkey % 4 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("username"))
    own = textmine.by_experts(_posts(spark, sf_dir), developers, group="grp")
    return textmine.expert_diagnoses(own, "topic", "number", "html", F.lit(True), curate._LEXICON, curate._INTENT, curate._DOUBT, html=True)


def post_diagnoses(spark, sf_dir):
    return _diagnoses(spark, sf_dir)


def topic_attachments(spark, sf_dir):
    out = textmine.labelled_attachments(_posts(spark, sf_dir), _diagnoses(spark, sf_dir), "topic", "number", "html", BASE)
    return out.select("url", "topic", "number", "place", "attachment", "label", "score", "phrase")


def duplicate_paths(spark, sf_dir):
    return curation.copy_paths(curate._files(spark, sf_dir), "path", "text")


def union_skips(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("sha"))
    return curation.union_skips({"de": d.where("lang = 'de'"), "fr": d.where("lang = 'fr'"), "other": d.where("lang not in ('de', 'fr')")}, "sha")


def _holdout(spark, sf_dir):
    m = files._manifest(spark, sf_dir)
    manifest = m.where("position % 4 < 3").groupBy("batch", "name").agg(F.min("sha").alias("sha"))
    return curation.holdout(m.where("position % 3 > 0").select("batch", "name", "position"), manifest, ["b0"])


def holdout_files(spark, sf_dir):
    return _holdout(spark, sf_dir)[0]


def holdout_counts(spark, sf_dir):
    return _holdout(spark, sf_dir)[1]


def best_records(spark, sf_dir):
    m = files._manifest(spark, sf_dir).select("name", "position", F.col("batch").alias("manifest"), "status", F.col("raw").alias("label_raw"), F.col("source").alias("source_type"), F.col("thread").alias("thread_url"), F.expr("CASE WHEN position % 5 = 2 THEN dl END").alias("resolved_url"))
    return imports.best_record(m, "name", ["b3", "b1"], "forum.example.org", "position").select("name", "position", "manifest")


def record_counts(spark, sf_dir):
    """Records of each file name when rows that agree in six columns count once."""
    m = files._manifest(spark, sf_dir).select("name", "position", F.col("batch").alias("manifest"), "status", F.lit("x").alias("label_raw"), F.col("source").alias("source_type"), F.lit(None).cast("string").alias("thread_url"), F.lit("").alias("resolved_url"))
    return imports.records(m, "name", "position").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))


def _runs(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderstatus = 'P' THEN NULL ELSE concat(o_orderstatus, o_orderkey % 7) END").alias("predicted"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END").alias("top"))


def flat_rates(spark, sf_dir):
    return evaluation.flat_rates(_runs(spark, sf_dir), "run", "predicted", "top").withColumn("rate", F.round("rate", 6))


def rate_changes(spark, sf_dir):
    rows = _runs(spark, sf_dir)
    runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    out = evaluation.changes(evaluation.flat_rates(rows, "run", "predicted", "top"), runs, "label", "run", "rate", "n", least_change=0.02)
    return out.withColumns({c: F.round(c, 6) for c in ("first_rate", "last_rate", "delta")})


def critical_details(spark, sf_dir):
    r = curate._results(spark, sf_dir)
    severity = F.when(F.col("confidence") > 0.5, "critical").otherwise("warning")
    rows = r.select("doc_id", (F.col("doc_id") % 12 > 0).alias("readable"), F.transform("predicted", lambda x: F.struct(x.alias("failure_type"), F.col("confidence"), F.when(x == "toxic", severity).otherwise("warning").alias("severity"))).alias("diagnoses"))
    return evaluation.critical_details(rows, "doc_id", "diagnoses")


_TEXT = ["chars", "words", "digits", "lines", "capitals"]


def outlier_flags(spark, sf_dir):
    """Documents that don't look like the labelled good ones."""
    d = _t(spark, sf_dir, "documents").where("text is not null").dropDuplicates(["doc_id"])
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    rows = d.select("doc_id", F.length("text").cast("double").alias("chars"), count(r"\S+").alias("words"), count("[0-9]").alias("digits"), count("\n").alias("lines"), count("[A-Z]").alias("capitals"))
    good = _t(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id").distinct().withColumn("good", F.lit(True))
    out = learning.outliers(rows.join(good, "doc_id", "left"), "doc_id", _TEXT, F.coalesce("good", F.lit(False)), trees=50)
    return out.withColumn("deviations", F.transform("deviations", lambda x: x["feature"]))


#: Classifier hits and the features that tell vibration from compass, of each order.
_SHAKE = {"vibe_x_max": "o_orderkey % 97", "vibe_y_max": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 90 END", "vibe_z_max": "o_orderkey % 61", "vibe_clip": "CASE o_orderkey % 4 WHEN 0 THEN 150 WHEN 1 THEN NULL ELSE 0 END", "mag_range": "300 + o_custkey % 60", "mag_std": "30 + o_orderkey % 20"}
_HITS = {"vibration_high": "o_orderkey % 3 < 2", "compass_interference": "o_orderkey % 7 < 3", "ekf_failure": "o_orderkey % 10 = 0"}


def context_hits(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", *[F.expr(e).cast("double").alias(n) for n, e in _SHAKE.items()])
    hits = o.select("o_orderkey", F.explode(F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("failure_type"), (F.lit(0.5) + F.col("o_orderkey") % (i + 5) / 100).alias("confidence"))) for i, (n, c) in enumerate(_HITS.items())]), lambda x: x.isNotNull())).alias("h")).select("o_orderkey", "h.*")
    sure = o.select("o_orderkey", F.lit("compass_interference").alias("failure_type"), (F.col("o_orderkey") % 100 / 200).alias("confidence"))
    return diagnosis.in_context(hits, rows, "o_orderkey", sure).withColumn("confidence", F.round("confidence", 6))


def derived_features(spark, sf_dir):
    f = features.derived(_ratios(spark, sf_dir))
    return f.select("log_id", *[F.round(c, 6).alias(c) for c in ("resistance", "vibe_per_clip", "gps_reliability")])


def _ratios(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("log_id"), (F.col("o_custkey") % 7).cast("double").alias("volt_range"), (F.col("o_orderkey") % 5).cast("double").alias("curr_max"), (F.col("o_orderkey") % 97).cast("double").alias("vibe_z_max"), (F.col("o_custkey") % 3).cast("double").alias("vibe_clip"), (F.col("o_custkey") % 14).cast("double").alias("gps_nsats_min"), (F.col("o_orderkey") % 4).cast("double").alias("gps_hdop"))


def augmented_rows(spark, sf_dir):
    """Training rows of orders with three copies each, scaled and with noise: all of them, by copy."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).cast("double").alias("vibe_z_max"), (F.col("o_custkey") % 50).cast("double").alias("bat_curr_mean"), F.lit(3.0).alias("mag_range"))
    return learning.augmented(rows, "o_orderkey", ["vibe_z_max", "bat_curr_mean", "mag_range"], 3)


def message_totals(spark, sf_dir):
    out = logs.message_counts(events(spark, sf_dir), ["click", "view", "error"])
    return out.select("log_id", "n", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


def error_label_lists(spark, sf_dir):
    return features.error_label_lists(detect._incidents(spark, sf_dir)).select("log_id", F.array_join("labels", ",").alias("labels"))


def training_slices(spark, sf_dir):
    day = 86_400_000_000
    out = series.with_slices(events(spark, sf_dir), "log_id", "time_us", 2 * day, day)
    return out.groupBy("log_id", "kind", "window").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def _sql_plain(text):
    named = {"&amp;": "&", "&eacute;": "é", "&#8212;": "—", "&#x2014;": "—", "&quot;": '"', "&middot;": "·", "&copy;": "©"}
    cases = " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in named.items())
    bare = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    read = f"array_to_string(list_transform(list_zip(regexp_split_to_array({bare}, '{C.REFERENCE}'), regexp_extract_all({bare}, '{C.REFERENCE}')), lambda p: p[1] || CASE p[2] {cases} ELSE coalesce(p[2], '') END), '')"
    return f"trim(regexp_replace(regexp_replace({read}, '{C.CITATION}', '', 'g'), '{C.SPACE}', ' ', 'g'))"


def _sql_phrase():
    found = lambda w: f"nullif(regexp_extract(lower(t), '(?:^|[^A-Za-z0-9_])({w})(?:[^A-Za-z0-9_]|$)', 1), '')"
    return "CASE b.l " + " ".join(f"WHEN '{label}' THEN coalesce({', '.join(found(w) for w in words)})" for label, words in curate._LEXICON.items()) + " END"


_SQL_POSTS = "c AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _POST.items()) + " FROM conversations)"
_HITTEXT = lambda words: curate._hit(words).replace("lower(text)", "lower(t)")
_DIAGNOSED = f"""{_SQL_POSTS}, e AS (SELECT *, {_sql_plain('html')} AS t FROM c WHERE username IN (SELECT 'u' || c_custkey FROM customer WHERE c_custkey < 37 AND c_custkey % 4 = 0) OR title <> '' OR grp IS NOT NULL OR staff),
x AS (SELECT *, (CASE WHEN {_HITTEXT(curate._INTENT)} THEN 2 ELSE 0 END) - (CASE WHEN {_HITTEXT(curate._DOUBT)} THEN 1 ELSE 0 END) AS x FROM e), s AS (SELECT topic, number, t, list_max([{curate._SCORES.replace('lower(text)', 'lower(t)')}]) AS b FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY b.s DESC, number) AS n FROM s WHERE b.s >= 2), d AS (SELECT topic, b.l AS label, b.s::INT AS score, number AS post, left(t, 420) AS quote, {_sql_phrase()} AS phrase FROM k WHERE n = 1)"""
_RUNS = "u AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, coalesce(CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus = 'P' THEN NULL ELSE concat(o_orderstatus, o_orderkey % 7) END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'healthy') AS label FROM orders), z AS (SELECT run, count(*) AS n FROM u GROUP BY 1), v AS (SELECT run, label, count(*) / any_value(z.n) AS rate FROM u JOIN z USING (run) GROUP BY ALL)"
_HOLD = f"{files._SQL}, f AS (SELECT batch, name, min(sha) AS sha FROM m WHERE position % 4 < 3 GROUP BY ALL), l AS (SELECT m.batch, m.name, m.position, f.sha, f.sha IN (SELECT sha FROM f WHERE batch = 'b0') AS old FROM m LEFT JOIN f ON m.batch = f.batch AND m.name = f.name WHERE position % 3 > 0 AND m.batch <> 'b0'), k AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY batch, position, name) AS n FROM l)"
_CONTEXT = "f AS (SELECT o_orderkey, greatest(o_orderkey % 97, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey % 90 END, o_orderkey % 61) AS peak, CASE o_orderkey % 4 WHEN 0 THEN 150 ELSE 0 END AS clip, 300 + o_custkey % 60 AS wide, 30 + o_orderkey % 20 AS std FROM orders), g AS (SELECT o_orderkey, clip <= 0 AND peak < 65 AND wide > 320 AND std > 35 AS calm, clip > 100 OR peak > 80 AS rough, o_orderkey % 3 < 2 AS v, o_orderkey % 7 < 3 AS c FROM f)"

QUERIES = {
    "topic_urls": (topic_urls, f"WITH l AS (SELECT o_orderkey, o_orderkey % 6 AS k, lower(o_orderpriority) AS p FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN '{BASE}/t/' || p || '/' || o_orderkey WHEN 1 THEN '{BASE}/t/a-b/' || o_orderkey WHEN 2 THEN '{BASE}/c/' || o_orderkey WHEN 3 THEN 'https://other.example.org/t/a/' || o_orderkey WHEN 4 THEN '/t/x/' || o_orderkey ELSE '' END AS url FROM l"),
    "post_diagnoses": (post_diagnoses, f"WITH {_DIAGNOSED} SELECT * FROM d"),
    "topic_attachments": (topic_attachments, f"WITH {_DIAGNOSED}, a AS (SELECT topic, number, u.i - 1 AS place, u.h AS attachment FROM (SELECT topic, number, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS hs FROM c) q, unnest(list_zip(hs, range(1, len(hs) + 1))) AS w(u0), (SELECT u0[1] AS h, u0[2] AS i) AS u), g AS (SELECT *, '{BASE}' || attachment AS url FROM a WHERE regexp_matches(lower(attachment), '\\.(bin|zip)') AND topic IN (SELECT topic FROM d)), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY topic, number, place) AS o FROM g) SELECT url, r.topic, number, place, attachment, label, score, phrase FROM r JOIN d ON r.topic = d.topic WHERE o = 1"),
    "duplicate_paths": (duplicate_paths, "WITH f AS (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents), k AS (SELECT sha256, arg_min(path, (length(path), path)) AS canonical FROM f GROUP BY 1) SELECT sha256, canonical, path FROM f JOIN k USING (sha256) WHERE path <> canonical"),
    "union_skips": (union_skips, "WITH f AS (SELECT sha256(text) AS sha, CASE WHEN lang IN ('de', 'fr') THEN lang ELSE 'other' END AS \"set\" FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY \"set\") AS n FROM f) SELECT \"set\", count(*) FILTER (WHERE n = 1) AS kept, count(*) FILTER (WHERE n > 1) AS skipped FROM k GROUP BY 1"),
    "holdout_files": (holdout_files, f"WITH {_HOLD} SELECT batch, name, sha FROM k WHERE sha IS NOT NULL AND NOT old AND n = 1"),
    "holdout_counts": (holdout_counts, f"WITH {_HOLD} SELECT count(*) FILTER (WHERE sha IS NOT NULL AND NOT old AND n = 1) AS selected, count(*) FILTER (WHERE sha IS NOT NULL AND (old OR n > 1)) AS overlap, count(*) FILTER (WHERE sha IS NULL) AS missing FROM k"),
    "best_records": (best_records, f"WITH {files._SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE batch WHEN 'b3' THEN 0 WHEN 'b1' THEN 1 ELSE 99 END, NOT contains(thread, 'forum.example.org'), raw = '', position) AS n FROM m WHERE status = 'downloaded') SELECT name, position, batch AS manifest FROM k WHERE n = 1"),
    "record_counts": (record_counts, f"WITH {files._SQL}, k AS (SELECT name, batch, status, source, min(position) AS p FROM m GROUP BY ALL) SELECT name, count(*) AS n, min(p) AS first FROM k GROUP BY 1"),
    "flat_rates": (flat_rates, f"WITH {_RUNS} SELECT run, label, round(rate, 6) AS rate FROM v"),
    "rate_changes": (rate_changes, f"WITH {_RUNS}, b AS (SELECT min(run) AS a, max(run) AS z FROM z), g AS (SELECT label, coalesce(max(rate) FILTER (WHERE run = a), 0) AS x, coalesce(max(rate) FILTER (WHERE run = z), 0) AS y FROM v, b WHERE run IN (a, z) GROUP BY 1) SELECT label, round(x, 6) AS first_rate, round(y, 6) AS last_rate, round(y - x, 6) AS delta, round(y - x, 9) >= 0.02 AND (SELECT max(n) FROM z, b WHERE run IN (a, z)) >= 5 AS rising FROM g"),
    "critical_details": (critical_details, f"WITH {curate._R} SELECT doc_id, 'parse_error' AS finding, NULL::VARCHAR AS failure_type, NULL::DOUBLE AS confidence FROM r WHERE doc_id % 12 = 0 UNION ALL SELECT doc_id, 'false_critical', 'toxic', confidence FROM r WHERE doc_id % 12 > 0 AND list_contains(predicted, 'toxic') AND confidence > 0.5"),
    "outlier_flags": (outlier_flags, None),
    "context_hits": (context_hits, f"""WITH {_CONTEXT} SELECT o_orderkey, CASE WHEN calm AND NOT c THEN 'compass_interference' ELSE 'vibration_high' END AS failure_type, round(CASE WHEN calm AND NOT c THEN greatest(0.35, o_orderkey % 100 / 200) ELSE 0.5 + o_orderkey % 5 / 100 END, 6) AS confidence FROM g WHERE v AND NOT (calm AND c AND NOT rough)
UNION ALL SELECT o_orderkey, 'compass_interference', round(0.5 + o_orderkey % 6 / 100, 6) FROM g WHERE c AND NOT (v AND rough) UNION ALL SELECT o_orderkey, 'ekf_failure', round(0.5 + o_orderkey % 7 / 100, 6) FROM g WHERE o_orderkey % 10 = 0"""),
    "derived_features": (derived_features, "SELECT o_orderkey AS log_id, round(coalesce((o_custkey % 7) / nullif(o_orderkey % 5, 0), 0), 6) AS resistance, round((o_orderkey % 97) / (o_custkey % 3 + 1), 6) AS vibe_per_clip, round(coalesce((o_custkey % 14) / nullif(o_orderkey % 4, 0), 0), 6) AS gps_reliability FROM orders"),
    "augmented_rows": (augmented_rows, None),
    "message_totals": (message_totals, f"WITH {flight._E}, c AS (SELECT log_id, msg_type, count(*) AS n FROM e GROUP BY ALL) SELECT log_id, sum(n)::BIGINT AS n, coalesce(string_agg(msg_type || '=' || n, ',' ORDER BY msg_type) FILTER (WHERE msg_type IN ('click', 'view', 'error')), '') AS counts FROM c GROUP BY 1"),
    "error_label_lists": (error_label_lists, f"WITH {detect._I}, l AS (SELECT log_id, CASE sub {detect._LABELS} END AS label, min(seq) AS first_at FROM i WHERE m = 'ERR' AND (sub <> 11 OR code % 4 = 2) GROUP BY ALL) SELECT log_id, string_agg(label, ',' ORDER BY first_at, label) AS labels FROM l WHERE label IS NOT NULL GROUP BY 1"),
    "training_slices": (training_slices, f"WITH {flight._E}, s AS (SELECT log_id, min(time_us) AS a, max(time_us) AS z FROM e GROUP BY log_id), w AS (SELECT log_id, a, unnest(range(0, greatest(0, (z - a - 172800000000) // 86400000000) + 1)) AS win FROM s) SELECT w.log_id, 'slice' AS kind, win AS \"window\", count(*) AS n, round(avg(value), 6) AS mean FROM w JOIN e ON e.log_id = w.log_id AND time_us - a >= win * 86400000000 AND time_us - a < win * 86400000000 + 172800000000 GROUP BY ALL UNION ALL SELECT log_id, 'full', NULL, count(*), round(avg(value), 6) FROM e GROUP BY 1"),
}
