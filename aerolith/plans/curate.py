"""Queries on files, pages, posts, labels and vectors: curation, text mining, evaluation and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import curation, evaluation, similarity, textmine
from aerolith.sources.messages import harmonised
from aerolith.streaming import incremental


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text", "source")


def dedup_by_hash(spark, sf_dir):
    return curation.by_hash(_files(spark, sf_dir), "path", "text")


def priority_union(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "lang")
    out = curation.priority_union([d.where("lang = 'de'"), d.where("lang = 'fr'"), d.where("lang not in ('de', 'fr')")], "sha256", ["doc_id"])
    return out.select("doc_id", "sha256", "priority")


def leak_check(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return curation.leaks(d.where("source <> 'src0'"), d.where("source = 'src0'"), "text", "text", "doc_id").select("doc_id", "sha256")


def unseen_holdout(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return curation.unseen(d.where("source in ('src1', 'src2', 'src3')"), d.where("source = 'src0'"), "sha256", ["doc_id"]).select("doc_id", "sha256")


def copy_names(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(".bin")).alias("name"), F.sha2(F.col("p_type"), 256).alias("sha"))
    return curation.resolved_names(p, "name", "sha").select("p_partkey", "target")


def manifests(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("file_name"), F.col("c_mktsegment").alias("topic_url"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("saved_file"), F.lit(" ").alias("thread_url"), F.col("s_name").alias("source_url"))
    every = harmonised({"customers": c, "suppliers": s}, {"file": ["file_name", "saved_file"], "url": ["topic_url", "thread_url", "source_url"]})
    return every.groupBy("manifest", "url").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first_file"))


def best_provenance(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return curation.best_row(o.where("o_orderstatus <> 'P'"), "o_custkey", [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def page_text(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(C.stripped_html(F.col("html")), 256).alias("text_sha"))


def page_urls(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", C.canonical_url(F.col("url")).alias("url"))


def page_links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(C.links(F.col("html"), "^/T")).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


def file_kinds(spark, sf_dir):
    d, p = _t(spark, sf_dir, "documents").select(F.col("text").alias("c")), _t(spark, sf_dir, "pages").select(F.col("html").alias("c"))
    every = d.unionByName(p).select(C.signature(F.col("c").cast("binary")).alias("kind"))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_LEXICON = {"mechanical_failure": ["the", "there"], "vibration_high": ["of", "and"], "gps_quality_poor": ["de", "la"], "power_instability": ["der", "und"]}
_INTENT, _DOUBT = ["is", "en"], ["that", "que"]


def post_labels(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = textmine.expert_diagnoses(c, "conv_id", "turn", "text", F.col("role") == "assistant", _LEXICON, _INTENT, _DOUBT)
    return out.select("conv_id", "label", "score", "post")


def label_distribution(spark, sf_dir):
    l = _t(spark, sf_dir, "labels").select("doc_id", F.filter(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull()).alias("labels"))
    hot = l.select("doc_id", *C.multi_hot(F.col("labels"), ["good", "toxic", "unused"]))
    return hot.agg(*[F.sum(x).cast("long").alias(x) for x in ("good", "toxic", "unused")], F.count(F.lit(1)).alias("n"))


def _results(spark, sf_dir):
    l, d = _t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    pick = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return l.join(d, "doc_id").select("doc_id", pick(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")).alias("truth"), pick(F.when(F.col("n_chars") % 5 > 0, "good"), F.when(F.col("n_chars") % 3 == 0, "toxic")).alias("predicted"), (F.col("n_chars") % 101 / 100).alias("confidence"), (F.col("quality") == 1).alias("correct"))


def label_metrics(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in ("good", "toxic", "unused")], "label string")
    out = evaluation.label_metrics(_results(spark, sf_dir), "truth", "predicted", labels)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def accuracies(spark, sf_dir):
    out = evaluation.accuracies(_results(spark, sf_dir), "truth", "predicted")
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


def reliability(spark, sf_dir):
    out = evaluation.reliability(_results(spark, sf_dir), F.col("confidence"), F.col("correct"))
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "accuracy")})


def calibration(spark, sf_dir):
    out = evaluation.calibration_error(evaluation.reliability(_results(spark, sf_dir), F.col("confidence"), F.col("correct")))
    return out.withColumn("ece", F.round("ece", 6))


def rate_trend(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("run", F.date_format("o_orderdate", "yyyy-MM"))
    rates = o.groupBy("o_orderpriority", "run").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return evaluation.trend(rates, "o_orderpriority", "run", "rate", "n").withColumns({c: F.round(c, 6) for c in ("first_rate", "last_rate", "delta")})


def similar(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return similarity.similar_cases(e.where("vec_id % 20 = 0"), e, "vec_id", "vec_id", "embedding", 0.2)


def split(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return curation.stratified(d, F.col("h"), "lang", 0.2).groupBy("lang", "in_test").agg(F.count(F.lit(1)).alias("n"))


def imputed(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return curation.median_imputed(e, ["value"]).agg(F.round(F.sum("value"), 4).alias("total"), F.count("value").alias("n"))


def windows(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.windowed(e, "ts", "event_type", "value", "2 days", "1 day")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


_R = "r AS (SELECT l.doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS truth, list_filter([CASE WHEN n_chars % 5 > 0 THEN 'good' END, CASE WHEN n_chars % 3 = 0 THEN 'toxic' END], lambda x: x IS NOT NULL) AS predicted, (n_chars % 101) / 100 AS confidence, quality = 1 AS correct FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_B = f"{_R}, b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, avg(confidence) AS confidence, avg(correct::INT) AS accuracy FROM r GROUP BY 1)"


def _hit(words):
    return " OR ".join(f"regexp_matches(lower(text), '(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)')" for w in words)


def _points(words):
    return " + ".join(f"({_hit([w])})::INT" for w in words)


_SCORES = ", ".join(f"{{'s': CASE WHEN {_points(ws)} > 0 THEN {_points(ws)} + x ELSE 0 END, 'o': {-i}, 'l': '{l}'}}" for i, (l, ws) in enumerate(_LEXICON.items()))
_REFERENCES = " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in {"&amp;": "&", "&quot;": '"', "&middot;": "·", "&copy;": "©"}.items())
_BARE = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
_READ = f"array_to_string(list_transform(list_zip(regexp_split_to_array({_BARE}, '{C.REFERENCE}'), regexp_extract_all({_BARE}, '{C.REFERENCE}')), lambda p: p[1] || CASE p[2] {_REFERENCES} ELSE coalesce(p[2], '') END), '')"

QUERIES = {
    "dedup_by_hash": (dedup_by_hash, "WITH f AS (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents) SELECT sha256, arg_min(path, (length(path), path)) AS canonical, count(*) AS copies FROM f GROUP BY sha256"),
    "priority_union": (priority_union, "WITH f AS (SELECT doc_id, sha256(text) AS sha256, CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS priority FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY priority, doc_id) AS n FROM f) SELECT doc_id, sha256, priority FROM k WHERE n = 1"),
    "leak_check": (leak_check, "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE source = 'src0' AND text IN (SELECT text FROM documents WHERE source <> 'src0')"),
    "unseen_holdout": (unseen_holdout, "WITH f AS (SELECT doc_id, source, sha256(text) AS sha256 FROM documents) SELECT min(doc_id) AS doc_id, sha256 FROM f WHERE source IN ('src1', 'src2', 'src3') AND sha256 NOT IN (SELECT sha256 FROM f WHERE source = 'src0') GROUP BY sha256"),
    "copy_names": (copy_names, "WITH p AS (SELECT p_partkey, p_brand, sha256(p_type) AS sha FROM part), r AS (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY sha) AS n FROM p) SELECT p_partkey, CASE WHEN n = 1 THEN p_brand || '.bin' ELSE p_brand || '_' || left(sha, 8) || '.bin' END AS target FROM r"),
    "manifest_union": (manifests, "SELECT 'customers' AS manifest, c_mktsegment AS url, count(*) AS n, min(c_name) AS first_file FROM customer GROUP BY 2 UNION ALL SELECT 'suppliers', s_name, count(*), min(s_name) FROM supplier GROUP BY 2"),
    "best_provenance": (best_provenance, "WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') SELECT o_custkey, o_orderkey FROM k WHERE n = 1"),
    "page_text": (page_text, f"SELECT page_id, sha256(trim(regexp_replace(regexp_replace({_READ}, '{C.CITATION}', '', 'g'), '{C.SPACE}', ' ', 'g'))) AS text_sha FROM pages"),
    "page_urls": (page_urls, "SELECT page_id, CASE WHEN regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) <> '' THEN 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^(www|m)\\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') ELSE '' END AS url FROM pages"),
    "page_links": (page_links, "SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE regexp_matches(href, '^/T') GROUP BY href"),
    "file_kinds": (file_kinds, "SELECT CASE WHEN c = '' THEN 'empty' WHEN starts_with(lower(left(c, 16)), '<!doctype') OR starts_with(lower(left(c, 16)), '<html') THEN 'html' ELSE 'binlike' END AS kind, count(*) AS n FROM (SELECT text AS c FROM documents UNION ALL SELECT html FROM pages) GROUP BY 1"),
    "post_labels": (post_labels, f"WITH x AS (SELECT *, (CASE WHEN {_hit(_INTENT)} THEN 2 ELSE 0 END) - (CASE WHEN {_hit(_DOUBT)} THEN 1 ELSE 0 END) AS x FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, turn, list_max([{_SCORES}]) AS b FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY b.s DESC, turn) AS n FROM s WHERE b.s >= 2) SELECT conv_id, b.l AS label, b.s::INT AS score, turn AS post FROM k WHERE n = 1"),
    "label_distribution": (label_distribution, "SELECT sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic, 0::BIGINT AS unused, count(*) AS n FROM labels"),
    "label_metrics": (label_metrics, f"WITH {_R}, c AS (SELECT label, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE t) AS support FROM (SELECT label, list_contains(truth, label) AS t, list_contains(predicted, label) AS p FROM r, unnest(['good', 'toxic', 'unused']) AS u(label)) GROUP BY label), m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM c) SELECT label, tp, fp, fn, tn, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM m"),
    "accuracies": (accuracies, f"WITH {_R} SELECT round(avg(list_has_any(truth, predicted)::INT), 6) AS any_match, round(avg(coalesce(list_contains(truth, predicted[1]), false)::INT), 6) AS top1, round(avg((list_sort(truth) = list_sort(predicted))::INT), 6) AS exact_match FROM r"),
    "reliability_bins": (reliability, f"WITH {_B} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b"),
    "calibration_error": (calibration, f"WITH {_B} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b"),
    "rate_trend": (rate_trend, "WITH g AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS run, avg((o_orderstatus = 'F')::INT) AS rate, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT o_orderpriority, arg_min(rate, run) AS a, arg_max(rate, run) AS z, arg_min(n, run) AS first_n, arg_max(n, run) AS last_n FROM g GROUP BY 1) SELECT o_orderpriority, round(a, 6) AS first_rate, round(z, 6) AS last_rate, first_n, last_n, round(z - a, 6) AS delta, abs(z - a) >= 0.10 AND (first_n >= 5 OR last_n >= 5) AS flagged FROM t"),
    "similar_cases": (similar, "WITH p AS (SELECT a.vec_id, b.vec_id AS case_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, case_id)::INT AS rank FROM p WHERE cosine > 0.2) SELECT * FROM k WHERE rank <= 3"),
    "stratified_split": (split, "WITH p AS (SELECT lang, percent_rank() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) < 0.2 AS in_test FROM documents) SELECT lang, in_test, count(*) AS n FROM p GROUP BY ALL"),
    "median_imputed": (imputed, "WITH v AS (SELECT CASE WHEN event_type <> 'error' THEN value END AS v FROM events) SELECT round(sum(coalesce(v, (SELECT median(v) FROM v))), 4) AS total, count(*) AS n FROM v"),
    "sliding_windows": (windows, "WITH w AS (SELECT event_type, value, epoch_us(date_trunc('day', ts)) - k * 86400000000 AS start_us FROM events, unnest([0, 1]) AS u(k)) SELECT start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL"),
}
