"""Queries on crawled files and their provenance, with their SQL. Orders stand for manifest rows, parts for paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import curation, imports

from . import flight

BASE = "https://forum.example.org"
#: A manifest row of each order, in SQL that both engines read alike.
_M = {
    "position": "o_orderkey", "price": "o_totalprice",
    "name": "concat('f', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '.zip' ELSE '.bin' END)",
    "batch": "concat('b', o_orderkey % 4)",
    "thread": "CASE WHEN o_orderkey % 7 = 0 THEN ' N/A ' WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('https://forum.example.org/t/topic/', o_orderkey % 50) END",
    "source": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'SITL_SIMULATION' ELSE '' END",
    "raw": "CASE o_orderkey % 6 WHEN 0 THEN 'Crash' WHEN 1 THEN 'Vibration' WHEN 2 THEN '' WHEN 3 THEN 'GPS Quality-Poor' WHEN 4 THEN 'unknown' ELSE 'healthy' END",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'downloaded' WHEN 'F' THEN 'failed' ELSE 'skipped' END",
    "dl": "CASE o_orderkey % 5 WHEN 0 THEN concat('/uploads/', o_orderkey, '.bin') WHEN 1 THEN concat('https://www.dropbox.com/s/', o_orderkey, '?dl=0') WHEN 2 THEN concat('https://drive.google.com/file/d/', o_orderkey, '/view') WHEN 3 THEN '' ELSE concat('//cdn.example.org/', o_orderkey) END",
}
_ALIASES, _VALID, _PROVISIONAL = {"crash": "crash_unknown", "vibration": "vibration_high"}, C.LABELS, ["unknown"]


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _manifest(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select(*[F.expr(e).alias(n) for n, e in _M.items()], F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha"))


def download_urls(spark, sf_dir):
    return _manifest(spark, sf_dir).select("position", imports.download_url(F.col("dl"), BASE).alias("url"))


def payload_kinds(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("c"))
    every = d.unionByName(_t(spark, sf_dir, "pages").select((F.col("page_id") * 4 + 3).alias("id"), F.col("html").alias("c")))
    url = F.when(F.col("id") % 4 == 0, "http://x.org/a.ZIP").when(F.col("id") % 4 == 1, "http://x.org/a.bin?x").otherwise("http://x.org/a")
    kind = imports.payload_kind(F.col("c").cast("binary"), url, F.when(F.col("id") % 8 == 2, "text/HTML; charset=utf-8"))
    return every.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_FOLDERS, _WORDS = {"economy": "vibration_high", "arge": "thrust_loss", "promo": "gps_quality_poor"}, {"cold": "ekf_failure", "widget": "motor_imbalance"}


def path_labels(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.expr("concat('Logs/', p_type, '/', p_brand, '/x.bin')").alias("path"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('a (', p_name, ') b.bin') ELSE p_name END").alias("file"))
    return p.select("p_partkey", imports.label_of_path(F.col("path"), _FOLDERS).alias("by_path"), imports.label_of_name(F.col("file"), _WORDS).alias("by_name"), imports.safe_name(F.col("file"), F.sha2("file", 256)).alias("safe"))


def _categorised(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    source = imports.source_type(F.col("source"), F.col("thread"), "forum.example.org", "forum")
    mapped = C.normalized_label(F.col("raw"), _ALIASES, _VALID)
    kind = imports.category(source, mapped, F.col("raw"), _PROVISIONAL)
    return m.withColumn("source", source).withColumn("mapped", mapped).withColumn("_k", kind).select("*", "_k.category", "_k.trainable").withColumn("thread", imports.plain_url(F.col("thread"))).drop("_k")


def import_categories(spark, sf_dir):
    return _categorised(spark, sf_dir).groupBy("category", "trainable", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("thread") == "").alias("no_thread"))


def benchmark_labels(spark, sf_dir):
    out = imports.benchmark_rows(_categorised(spark, sf_dir), "position", "mapped")
    return out.select("position", F.array_join("labels", ",").alias("labels"))


def _expert(spark, sf_dir):
    m = _manifest(spark, sf_dir).where("raw = 'Crash' and thread like 'https%'")
    return m.groupBy("thread").agg(F.concat(F.lit("u"), F.min("position").cast("string")).alias("username"), F.max("name").alias("quote"))


def provenance_links(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    out = imports.provenance(m.select("sha", "name"), m.select("name", "status", "thread", "batch", "position"), _expert(spark, sf_dir), [F.col("batch"), F.col("position")])
    return out.select("sha", "canonical", "copies", "position", "thread", "username")


def batch_audit(spark, sf_dir):
    rows = _categorised(spark, sf_dir).where("batch = 'b1'")
    one = curation.best_row(rows, "name", [F.col("position").desc()])
    manifest = one.select("name", "category", F.col("thread").alias("source_url"), F.when(F.col("position") % 3 > 0, F.col("dl")).alias("download_url"), F.when(F.col("position") % 8 > 1, F.col("sha")).alias("sha256"), F.col("source").alias("source_type"))
    return imports.audit(rows.select("name").distinct(), manifest, "name", "forum.example.org").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def unlabelled_topics(spark, sf_dir):
    m = _manifest(spark, sf_dir).where("thread like 'https%'")
    out = imports.topics(m.select("thread", "batch"), m.where("position % 50 < 9"), "thread", "batch")
    return out.select("thread", F.array_join("queries", ",").alias("queries"))


def enriched_manifest(spark, sf_dir):
    m = _manifest(spark, sf_dir).select("position", "thread", F.col("raw").alias("label"), F.col("name").alias("quote"))
    found = _expert(spark, sf_dir).select("thread", F.col("username").alias("label"), "quote")
    return imports.enriched(m, found, "thread").select("position", "label", "quote", "label_source")


def preferred_paths(spark, sf_dir):
    m = _manifest(spark, sf_dir).select(F.expr("substring(name, 1, length(name) - 4)").alias("stem"), F.expr("concat(CASE WHEN position % 4 = 0 THEN 'processed/' ELSE 'raw/' END, batch, '/', name)").alias("path"))
    return imports.preferred(m, "stem", "path").select("stem", "path")


def training_hashes(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    names = m.where("position % 10 = 0").select(F.expr("concat(batch, '__', name)").alias("file")).unionByName(m.where("position % 10 = 1").select(F.col("name").alias("file")))
    return imports.hashes_of_training(names, m.select("batch", "name", "sha"), "file")


def holdout_rows(spark, sf_dir):
    """Files of the benchmark that the manifest of their batch has, without two named batches, and not trained on."""
    m = _manifest(spark, sf_dir).where(~F.col("batch").isin("b0", "b2"))
    logs = m.where("position % 6 = 5").select("batch", "name").distinct()
    own = m.select("batch", "name", "sha", "position").join(logs, ["batch", "name"])
    return curation.unseen(own, training_hashes(spark, sf_dir), "sha", ["batch", "position"]).select("sha", "batch", "position")


def trainable_labels(spark, sf_dir):
    l = _t(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality = 1 END AS trainable", "toxic")
    flag = lambda rows, name: rows.groupBy(F.lit(name).alias("filter")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    return flag(imports.trainable(l, "trainable"), "lax").unionByName(flag(imports.trainable(l, "trainable", strict=True), "strict"))


def promoted_labels(spark, sf_dir):
    l = _t(spark, sf_dir, "labels").selectExpr("doc_id", "quality = 1 AS human_verified", "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'vibration_high' END AS auto_label", "CASE WHEN doc_id % 3 = 0 THEN 'open' ELSE 'auto_labeled_v2' END AS status", "(doc_id % 100) / 100 AS confidence")
    return imports.promoted(l).select("doc_id", "auto_label", "level")


def _inventory(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("c")).unionByName(_t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("c")))
    kind = C.signature(F.col("c").cast("binary"))
    return d.select("doc_id", F.expr("CASE WHEN doc_id % 6 = 0 THEN 'zip' ELSE 'bin' END").alias("kind"), F.sha2("c", 256).alias("sha"), kind.alias("signature"), ((kind == "binlike") & (F.col("doc_id") % 7 > 0)).alias("parsed"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'verified_labeled' WHEN 1 THEN 'provisional_labeled' ELSE 'verified_unlabeled' END").alias("category"), (F.col("doc_id") % 3 == 0).alias("trainable"))


def import_summary(spark, sf_dir):
    return imports.import_summary(_inventory(spark, sf_dir))


def rejected_files(spark, sf_dir):
    return imports.rejected(_inventory(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def probe_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("id"), F.col("event_type").alias("msg_type"))
    rows = e.withColumn("seq", F.row_number().over(Window.partitionBy("log_id").orderBy("id")) - 1)
    return imports.parseable(rows, 20)


def auto_candidates(spark, sf_dir):
    m = _manifest(spark, sf_dir).withColumn("label", C.normalized_label(F.col("raw"), _ALIASES, _VALID)).withColumn("agreed", F.col("position") % 4 > 0).withColumn("thread", imports.plain_url(F.col("thread")))
    return imports.candidates(m, "thread", "position", ["crash_unknown", "vibration_high", "healthy"], 15).select("position", "thread", "label")


def crawl_budget(spark, sf_dir):
    m = _manifest(spark, sf_dir).where("thread like 'https%'")
    return imports.first_of_each(m, "thread", [F.col("price").desc(), F.col("position")], 3).select("thread", "position")


def latest_batch(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.expr("concat('b', o_custkey % 9)").alias("batch"), F.col("o_orderdate").alias("modified"), "o_orderstatus")
    return imports.latest_batch(o.groupBy("batch").agg(F.max("modified").alias("modified")), o.where("o_orderstatus = 'P'"))


def archive_union(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    archives = m.where("name like '%.zip'").select("sha", "name", (F.col("source") != "").alias("synthetic"))
    return imports.with_archives(m.where("name like '%.bin'").select("sha", "name"), archives).groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("copies").alias("copies"), F.min("name").alias("first"))


def rare_labels(spark, sf_dir):
    m = _manifest(spark, sf_dir).select(C.normalized_label(F.col("raw"), _ALIASES, _VALID).alias("label"))
    return imports.rare_labels(m, "label", spark.createDataFrame([(x,) for x in _VALID], "label string"), 10)


def build_report(spark, sf_dir):
    reasons = [("not_downloaded", F.col("status") != "downloaded"), ("synthetic", F.col("category") == "excluded_synthetic"), ("no_label", F.col("mapped").isNull())]
    return imports.build_report(_categorised(spark, sf_dir), reasons)


def manual_labels(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").selectExpr("concat('{\"', c_name, '\": {\"label\": \"', CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END, '\", \"confidence\": \"', CASE c_custkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'odd' ELSE 'medium' END, '\"}}') AS doc")
    return imports.manual_labels(c, "doc")


def relabelled_rows(spark, sf_dir):
    hits = flight.fused(spark, sf_dir).select("log_id", "failure_type", "confidence")
    rows = hits.select("log_id").distinct().withColumn("labels", F.when(F.col("log_id") % 3 == 0, F.array(F.lit("crash_unknown"))).when(F.col("log_id") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("ekf_failure"))))
    return imports.relabelled(rows, hits, "log_id").select("log_id", F.array_join("labels", ",").alias("labels"), "changed")


def boundary_errors(spark, sf_dir):
    rows = _manifest(spark, sf_dir).select("position", F.split(F.col("raw"), " ").alias("labels"), "source")
    return imports.boundary_errors(rows, "position", ["Crash", "Vibration", "healthy", "unknown"], "source").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def page_attachments(spark, sf_dir):
    out = imports.attachments(_t(spark, sf_dir, "pages"), "page_id", "html", BASE)
    return out.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first"))


def expert_blocks(spark, sf_dir):
    found = _expert(spark, sf_dir).select("thread", F.col("username").alias("label"), "quote")
    return imports.expert_block(found, "thread")


_SQL = "m AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _M.items()) + ", sha256(o_custkey::VARCHAR) AS sha FROM orders)"
_LABEL = "CASE raw WHEN 'Crash' THEN 'crash_unknown' WHEN 'Vibration' THEN 'vibration_high' WHEN 'GPS Quality-Poor' THEN 'gps_quality_poor' WHEN 'healthy' THEN 'healthy' END"
_CAT = f"""{_SQL}, s AS (SELECT * REPLACE (CASE WHEN source = '' AND contains(thread, 'forum.example.org') THEN 'forum' ELSE source END AS source, CASE WHEN thread = ' N/A ' THEN '' ELSE thread END AS thread), {_LABEL} AS mapped FROM m),
c AS (SELECT *, CASE WHEN source = 'SITL_SIMULATION' THEN 'excluded_synthetic' WHEN mapped IS NOT NULL THEN 'verified_labeled' WHEN raw = 'unknown' THEN 'provisional_labeled' ELSE 'verified_unlabeled' END AS category, source <> 'SITL_SIMULATION' AND mapped IS NOT NULL AS trainable FROM s)"""
_EXPERT = f"{_SQL}, x AS (SELECT thread, 'u' || min(position) AS username, max(name) AS quote FROM m WHERE raw = 'Crash' AND thread LIKE 'https%' GROUP BY thread)"
_TRAIN = f"{_SQL}, h AS (SELECT DISTINCT b.sha FROM m a JOIN m b ON a.batch = b.batch AND a.name = b.name WHERE a.position % 10 = 0)"
_INV = "f AS (SELECT doc_id, text AS c FROM documents UNION ALL SELECT page_id, html FROM pages), i AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'zip' ELSE 'bin' END AS kind, sha256(c) AS sha, CASE WHEN c = '' THEN 'empty' WHEN starts_with(lower(left(c, 16)), '<!doctype') OR starts_with(lower(left(c, 16)), '<html') THEN 'html' ELSE 'binlike' END AS signature FROM f), j AS (SELECT *, signature = 'binlike' AND doc_id % 7 > 0 AS parsed FROM i)"

QUERIES = {
    "download_urls": (download_urls, f"WITH {_SQL} SELECT position, CASE position % 5 WHEN 0 THEN '{BASE}/uploads/' || position || '.bin' WHEN 1 THEN 'https://www.dropbox.com/s/' || position || '?dl=1' WHEN 2 THEN 'https://drive.google.com/uc?export=download&id=' || position WHEN 3 THEN '' ELSE 'https://cdn.example.org/' || position END AS url FROM m"),
    "payload_kinds": (payload_kinds, "WITH e AS (SELECT doc_id AS id, text AS c FROM documents UNION ALL SELECT page_id * 4 + 3, html FROM pages) SELECT CASE WHEN id % 4 = 0 THEN 'zip' WHEN starts_with(c, '<') OR id % 8 = 2 THEN 'html' WHEN id % 4 = 1 THEN 'bin' ELSE 'binary' END AS kind, count(*) AS n FROM e GROUP BY 1"),
    "path_labels": (path_labels, "WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'a (' || p_name || ') b.bin' ELSE p_name END AS file FROM part) SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'vibration_high' WHEN p_type = 'LARGE' THEN 'thrust_loss' WHEN p_type = 'PROMO' THEN 'gps_quality_poor' END AS by_path, CASE WHEN p_name LIKE '%cold%' THEN 'ekf_failure' WHEN p_name LIKE '%widget%' THEN 'motor_imbalance' END AS by_name, left(sha256(file), 10) || '__' || regexp_replace(file, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM p"),
    "import_categories": (import_categories, f"WITH {_CAT} SELECT category, trainable, source, count(*) AS n, count(*) FILTER (WHERE thread = '') AS no_thread FROM c GROUP BY ALL"),
    "benchmark_labels": (benchmark_labels, f"WITH {_CAT} SELECT position, mapped AS labels FROM c WHERE category = 'verified_labeled'"),
    "provenance_links": (provenance_links, f"WITH {_EXPERT}, l AS (SELECT DISTINCT a.sha, b.batch, b.position, b.thread FROM (SELECT DISTINCT sha, name FROM m) a JOIN m b ON a.name = b.name WHERE b.status = 'downloaded'), b AS (SELECT sha, arg_min(position, (batch, position)) AS position, arg_min(thread, (batch, position)) AS thread FROM l GROUP BY sha), o AS (SELECT sha, min(name) AS canonical, count(*) AS copies FROM m GROUP BY sha) SELECT o.sha, canonical, copies, position, b.thread, username FROM o LEFT JOIN b ON o.sha = b.sha LEFT JOIN x ON b.thread = x.thread"),
    "batch_audit": (batch_audit, f"""WITH {_CAT}, b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY position DESC) AS n FROM c WHERE batch = 'b1'), o AS (SELECT name, category = 'verified_labeled' AS found, thread, CASE WHEN position % 3 > 0 THEN dl ELSE '' END AS dl, position % 8 > 1 AS hashed, source FROM b WHERE n = 1),
i AS (SELECT unnest([CASE WHEN NOT found THEN 'missing_manifest_row' END, CASE WHEN found AND thread = '' THEN 'missing_source_url' END, CASE WHEN found AND dl = '' THEN 'missing_download_url' END, CASE WHEN found AND NOT hashed THEN 'bad_sha256' END]) AS issue FROM o) SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue"""),
    "unlabelled_topics": (unlabelled_topics, f"WITH {_SQL} SELECT thread, string_agg(DISTINCT batch, ',' ORDER BY batch) AS queries FROM m WHERE thread LIKE 'https%' AND position % 50 >= 9 GROUP BY thread"),
    "enriched_manifest": (enriched_manifest, f"WITH {_EXPERT} SELECT position, coalesce(username, raw) AS label, coalesce(quote, name) AS quote, CASE WHEN username IS NULL THEN 'crawl' ELSE 'expert' END AS label_source FROM m LEFT JOIN x ON m.thread = x.thread"),
    "preferred_paths": (preferred_paths, f"WITH {_SQL}, p AS (SELECT left(name, length(name) - 4) AS stem, CASE WHEN position % 4 = 0 THEN 'processed/' ELSE 'raw/' END || batch || '/' || name AS path FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY NOT contains(path, 'processed'), path LIKE '%.zip', path) AS n FROM p) SELECT stem, path FROM k WHERE n = 1"),
    "training_hashes": (training_hashes, f"WITH {_TRAIN} SELECT sha FROM h"),
    "holdout_rows": (holdout_rows, f"WITH {_TRAIN}, k AS (SELECT m.*, row_number() OVER (PARTITION BY sha ORDER BY batch, position) AS n FROM m WHERE batch IN ('b1', 'b3') AND sha NOT IN (SELECT sha FROM h) AND (batch, name) IN (SELECT (batch, name) FROM m WHERE position % 6 = 5)) SELECT sha, batch, position FROM k WHERE n = 1"),
    "trainable_labels": (trainable_labels, "SELECT 'lax' AS filter, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM labels WHERE doc_id % 5 = 0 OR quality = 1 UNION ALL SELECT 'strict', count(*), sum(doc_id)::BIGINT FROM labels WHERE doc_id % 5 <> 0 AND quality = 1"),
    "promoted_labels": (promoted_labels, "SELECT doc_id, 'vibration_high' AS auto_label, CASE WHEN doc_id % 100 >= 75 THEN 'high' ELSE 'medium' END AS level FROM labels WHERE quality = 1 AND doc_id % 4 <> 0 AND doc_id % 3 <> 0"),
    "import_summary": (import_summary, f"WITH {_INV} SELECT count(*) FILTER (WHERE kind = 'bin') AS total_logs, count(*) FILTER (WHERE kind = 'bin' AND parsed) AS parseable, count(DISTINCT CASE WHEN kind = 'bin' AND parsed THEN sha END) AS unique_parseable, count(*) FILTER (WHERE kind = 'bin' AND signature <> 'binlike') AS rejected, count(*) FILTER (WHERE kind = 'zip') AS archives, count(DISTINCT CASE WHEN kind = 'zip' THEN sha END) AS unique_archives, count(*) FILTER (WHERE kind = 'bin' AND doc_id % 3 = 0) AS labeled, count(*) FILTER (WHERE kind = 'bin' AND doc_id % 3 = 1) AS provisional, count(*) FILTER (WHERE kind = 'bin' AND doc_id % 3 = 2) AS unlabeled, count(*) FILTER (WHERE kind = 'bin' AND doc_id % 3 = 0) AS trainable FROM j"),
    "rejected_files": (rejected_files, f"WITH {_INV} SELECT 'signature:' || signature AS reason, count(*) AS n FROM j WHERE signature <> 'binlike' GROUP BY 1"),
    "probe_counts": (probe_counts, "WITH e AS (SELECT user_id AS log_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) SELECT log_id, count(*) AS messages, count(DISTINCT event_type) AS kinds FROM e WHERE seq < 20 GROUP BY log_id"),
    "auto_candidates": (auto_candidates, f"WITH {_SQL}, k AS (SELECT position, thread, {_LABEL} AS label, row_number() OVER (PARTITION BY thread ORDER BY position) AS n FROM m WHERE thread LIKE 'https%' AND status = 'downloaded' AND name LIKE '%.bin' AND {_LABEL} IN ('crash_unknown', 'vibration_high', 'healthy') AND position % 4 > 0) SELECT position, thread, label FROM k WHERE n = 1 ORDER BY position LIMIT 15"),
    "crawl_budget": (crawl_budget, f"WITH {_SQL}, k AS (SELECT thread, position, row_number() OVER (PARTITION BY thread ORDER BY price DESC, position) AS n FROM m WHERE thread LIKE 'https%') SELECT thread, position FROM k WHERE n <= 3"),
    "latest_batch": (latest_batch, "WITH b AS (SELECT 'b' || (o_custkey % 9) AS batch, max(o_orderdate) AS modified, bool_or(o_orderstatus = 'P') AS has FROM orders GROUP BY 1) SELECT batch FROM b WHERE has ORDER BY modified DESC, batch DESC LIMIT 1"),
    "archive_union": (archive_union, f"WITH {_SQL}, k AS (SELECT CASE WHEN name LIKE '%.bin' THEN 'log' WHEN source <> '' THEN 'synthetic' ELSE 'archive' END AS category, sha, min(name) AS name, count(*) AS copies FROM m GROUP BY ALL) SELECT category, count(*) AS files, sum(copies)::BIGINT AS copies, min(name) AS first FROM k GROUP BY category"),
    "rare_labels": (rare_labels, f"WITH {_SQL}, v AS (SELECT unnest({_VALID}) AS label), n AS (SELECT {_LABEL} AS label, count(*) AS n FROM m GROUP BY 1) SELECT v.label, coalesce(n, 0) AS n FROM v LEFT JOIN n ON v.label = n.label WHERE coalesce(n, 0) < 10"),
    "build_report": (build_report, f"WITH {_CAT} SELECT CASE WHEN status <> 'downloaded' THEN 'not_downloaded' WHEN category = 'excluded_synthetic' THEN 'synthetic' WHEN mapped IS NULL THEN 'no_label' ELSE 'processed' END AS outcome, count(*) AS n FROM c GROUP BY 1"),
    "manual_labels": (manual_labels, "SELECT c_name AS name, lower(c_mktsegment) AS label, CASE WHEN c_custkey % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM customer WHERE c_custkey % 3 <> 0"),
    "relabelled_rows": (relabelled_rows, f"WITH {flight._MERGED}, b AS (SELECT log_id, arg_min(failure_type, (-confidence, failure_type)) AS best FROM merged WHERE confidence > 0.65 AND failure_type IN ('vibration_high', 'compass_interference', 'power_instability') GROUP BY 1) SELECT DISTINCT m.log_id, CASE WHEN best IS NOT NULL THEN best WHEN m.log_id % 3 = 0 THEN 'crash_unknown' WHEN m.log_id % 3 = 1 THEN '' ELSE 'ekf_failure' END AS labels, best IS NOT NULL AS changed FROM merged m LEFT JOIN b ON m.log_id = b.log_id"),
    "boundary_errors": (boundary_errors, f"WITH {_SQL}, u AS (SELECT unnest(string_split(raw, ' ')) AS x FROM m) SELECT 'unknown label ' || x AS error, count(*) AS n FROM u WHERE x NOT IN ('Crash', 'Vibration', 'healthy', 'unknown') GROUP BY 1 UNION ALL SELECT 'simulated source', count(*) FROM m WHERE source <> ''"),
    "page_attachments": (page_attachments, f"WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages), u AS (SELECT DISTINCT page_id, CASE WHEN h = '' THEN '' WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN '{BASE}' || h ELSE '{BASE}/' || h END AS url FROM h) SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '\\.([A-Za-z0-9]{{1,4}})([?#].*)?$', 1)), ''), 'none') AS kind, count(*) AS n, min(url) AS first FROM u GROUP BY ALL"),
    "expert_blocks": (expert_blocks, f"WITH {_EXPERT} SELECT thread, upper(username) AS label, quote FROM x"),
}
