"""Curation of crawled files: URLs, kinds, labels, provenance, categories, audits and batches. All are joins, windows and column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.columns import SIGNATURES


def download_url(url: Column, base: str) -> Column:
    """Absolute, of a shared file the download itself, of a drive's file the export by its id."""
    full = F.when(F.coalesce(url, F.lit("")) == "", "").when(url.rlike("^https?://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(F.concat(F.lit(base), F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))))
    shared = F.when(full.contains("dropbox.com"), F.replace(full, F.lit("dl=0"), F.lit("dl=1"))).otherwise(full)
    drive = F.regexp_extract(shared, r"(?:/d/|[?&]id=)([A-Za-z0-9_-]+)", 1)
    return F.when(shared.contains("drive.google.com") & (drive != ""), F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive)).otherwise(shared)


def payload_kind(content: Column, url: Column, content_type: Column) -> Column:
    """zip by the URL, then by the first bytes, then html by the header, then bin by the URL, else binary."""
    head, low = F.hex(F.substring(content, 1, 4)), F.lower(F.coalesce(url, F.lit("")))
    kind = F.when(low.contains(".zip"), "zip")
    for name, first in SIGNATURES:
        if name != "pdf":
            kind = kind.when(head.startswith(first[:8]), name)
    return kind.when(head.startswith("3C"), "html").when(F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html"), "html").when(low.contains(".bin"), "bin").otherwise("binary")


def label_of_path(path: Column, labels: dict[str, str]) -> Column:
    """The label of the nearest folder above the file that has one: by its whole name, else by a part of it."""
    folders = F.reverse(F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    exact = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    part = lambda x: F.coalesce(*[F.when(x.contains(name), label) for name, label in labels.items()])
    return F.try_element_at(F.filter(F.transform(folders, lambda x: F.coalesce(F.try_element_at(exact, x), part(x))), lambda x: x.isNotNull()), F.lit(1))


def label_of_name(name: Column, labels: dict[str, str]) -> Column:
    """The first label that the text in parentheses has, without any such text the whole name."""
    inside = F.lower(F.regexp_extract(name, r"\(([^)]*)\)", 1))
    text = F.when(inside != "", inside).otherwise(F.lower(name))
    return F.coalesce(*[F.when(text.contains(word), label) for word, label in labels.items()])


def safe_name(name: Column, sha: Column) -> Column:
    return F.concat(F.substring(sha, 1, 10), F.lit("__"), F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"))


def source_type(given: Column, thread: Column, host: str, name: str) -> Column:
    own = F.trim(F.coalesce(given, F.lit("")))
    return F.when((own == "") & F.coalesce(thread, F.lit("")).contains(host), name).otherwise(own)


def plain_url(url: Column) -> Column:
    own = F.trim(F.coalesce(url, F.lit("")))
    return F.when(F.upper(own).isin("", "N/A"), "").otherwise(own)


def safe_confidence(value: Column) -> Column:
    own = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(own.isin("medium", "high"), own).otherwise("medium")


def category(source: Column, mapped: Column, raw: Column, provisional: list[str]) -> Column:
    """struct(category, trainable) of an imported file."""
    of = lambda name, trainable: F.struct(F.lit(name).alias("category"), F.lit(trainable).alias("trainable"))
    return F.when(F.upper(source) == "SITL_SIMULATION", of("excluded_synthetic", False)).when(mapped.isNotNull(), of("verified_labeled", True)).when(raw.isin(provisional), of("provisional_labeled", False)).otherwise(of("verified_unlabeled", False))


def benchmark_rows(files: DataFrame, name: str, label: str) -> DataFrame:
    """Verified files with a label, the label as a list."""
    return files.where((F.col("category") == "verified_labeled") & F.col(label).isNotNull()).select(name, F.array(label).alias("labels"))


def trainable(rows: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Rows not marked as untrainable; strict: only those marked as trainable."""
    return rows.where(F.coalesce(F.col(column), F.lit(not strict)))


def promoted(rows: DataFrame) -> DataFrame:
    """Automatic labels that a person verified; from 0.75 on their confidence is high, else medium."""
    own = rows.where(F.coalesce(F.col("human_verified"), F.lit(False)) & (F.coalesce(F.col("auto_label"), F.lit("")) != "") & F.coalesce(F.col("status"), F.lit("")).startswith("auto_labeled"))
    return own.withColumn("level", F.when(F.col("confidence") >= 0.75, "high").otherwise("medium"))


# The columns by which two rows of manifests are the same record.
RECORD = ["manifest", "status", "label_raw", "source_type", "thread_url", "resolved_url"]


def records(manifest: DataFrame, key: str, place: str) -> DataFrame:
    """Rows of manifests, of those that agree in key and RECORD the first by place; nulls count as empty."""
    same = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in RECORD]
    first = manifest.select(key, place, *same, F.struct(*manifest.columns).alias("_r")).groupBy(key, *[f"_{c}" for c in RECORD]).agg(F.min_by("_r", place).alias("_r"))
    return first.select("_r.*")


def best_record(manifest: DataFrame, key: str, priority: list[str], host: str, place: str) -> DataFrame:
    """Of each key's downloaded records the best: by its manifest's place in `priority`, then with a thread of the host, then with a label, then by place."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(priority) for x in (n, i)]), F.col("manifest")), F.lit(99))
    order = F.struct(rank, (~F.coalesce(F.col("thread_url"), F.lit("")).contains(host)).cast("int"), (F.coalesce(F.col("label_raw"), F.lit("")) == "").cast("int"), F.col(place))
    return records(manifest, key, place).where("status = 'downloaded'").select(key, F.struct(*manifest.columns).alias("_r"), order.alias("_o")).groupBy(key).agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def provenance(files: DataFrame, manifest: DataFrame, expert: DataFrame, order: list[Column]) -> DataFrame:
    """Each hash of files (sha, name) with its best downloaded manifest row, by any of its names, and the expert of that row's thread.

    manifest: name, status, thread, ...; equal rows count once. expert: thread, username, quote, one row per thread.
    """
    linked = files.select("sha", "name").distinct().join(manifest.dropDuplicates().where("status = 'downloaded'"), "name")
    best = linked.withColumn("_n", F.row_number().over(Window.partitionBy("sha").orderBy(*order))).where("_n = 1").drop("_n")
    own = files.groupBy("sha").agg(F.min("name").alias("canonical"), F.count(F.lit(1)).alias("copies"))
    return own.join(best.drop("name"), "sha", "left").join(expert, "thread", "left")


def audit(truth: DataFrame, manifest: DataFrame, name: str, host: str) -> DataFrame:
    """Issues of a batch's truth rows, one row each: name, issue."""
    m = manifest.where("category = 'verified_labeled'").withColumn("_found", F.lit(True))
    rows = truth.select(name).join(m, name, "left")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    there, of_host = F.col("_found").isNotNull(), F.lower(F.regexp_extract(text("source_url"), "^[a-zA-Z]+://([^/?#]*)", 1))
    issues = [(~there, "missing_manifest_row"), (there & (text("source_url") == ""), "missing_source_url"), (there & (text("source_url") != "") & ~of_host.contains(host), "non_forum_source"), (there & (text("download_url") == ""), "missing_download_url"), (there & (F.length(text("sha256")) != 64), "bad_sha256"), (there & F.upper(text("source_type")).rlike("SITL|SIM"), "synthetic_source")]
    return rows.select(name, F.explode(F.filter(F.array(*[F.when(c, n) for c, n in issues]), lambda x: x.isNotNull())).alias("issue"))


def topics(found: DataFrame, labelled: DataFrame, url: str, query: str) -> DataFrame:
    """Topics found by queries and not yet labelled: url, queries (sorted, each once)."""
    return found.join(labelled.select(url).distinct(), url, "left_anti").groupBy(url).agg(F.array_sort(F.collect_set(query)).alias("queries"))


def enriched(manifest: DataFrame, diagnoses: DataFrame, url: str) -> DataFrame:
    """manifest with label and quote of its topic's diagnosis; where there is none the old values stay."""
    new = diagnoses.select(url, F.col("label").alias("_label"), F.col("quote").alias("_quote"))
    rows = manifest.join(new, url, "left")
    return rows.withColumn("label", F.coalesce("_label", "label")).withColumn("quote", F.coalesce("_quote", "quote")).withColumn("label_source", F.when(F.col("_label").isNotNull(), "expert").otherwise("crawl")).drop("_label", "_quote")


def preferred(paths: DataFrame, name: str, path: str) -> DataFrame:
    """Of the paths of a file name the one to read: processed before raw, .bin before .zip, then in order."""
    order = [(~F.col(path).contains("processed")).cast("int"), F.lower(F.col(path)).endswith(".zip").cast("int"), F.col(path)]
    return paths.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(*order))).where("_n = 1").drop("_n")


def hashes_of_training(names: DataFrame, manifest: DataFrame, prefixed: str) -> DataFrame:
    """Hashes of the training files, which are named batch__file; manifest: batch, name, sha."""
    parts = F.split(F.col(prefixed), "__", 2)
    own = names.select(parts[0].alias("batch"), F.try_element_at(parts, F.lit(2)).alias("name")).where("name is not null")
    return own.join(manifest, ["batch", "name"]).select("sha").distinct()


def candidates(rows: DataFrame, url: str, position: str, valid: list[str], most: int) -> DataFrame:
    """Rows to label automatically: downloaded .bin files of an agreed valid label, of each URL the first; at most `most`."""
    own = rows.where((F.coalesce(F.col(url), F.lit("")) != "") & (F.col("status") == "downloaded") & F.lower("name").endswith(".bin") & F.col("label").isin(valid) & F.col("agreed"))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(position))).where("_n = 1").drop("_n")
    return first.orderBy(position).limit(most)


def first_of_each(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each key, as a crawl's budget has it."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def latest_batch(batches: DataFrame, datasets: DataFrame) -> DataFrame:
    """The batch modified last of those that have a dataset, too."""
    return batches.join(datasets.select("batch").distinct(), "batch", "left_semi").agg(F.max_by("batch", F.struct("modified", "batch")).alias("batch"))


def import_summary(files: DataFrame) -> DataFrame:
    """One row of counts of an import; files: kind (bin, zip), sha, parsed, signature, category, trainable."""
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    log, archive, good = F.col("kind") == "bin", F.col("kind") == "zip", F.col("parsed")
    unique = lambda c: F.count_distinct(F.when(c, F.col("sha")))
    verified = [F.col("category") == c for c in ("verified_labeled", "provisional_labeled", "verified_unlabeled")]
    return files.agg(of(log).alias("total_logs"), of(log & good).alias("parseable"), unique(log & good).alias("unique_parseable"), of(log & (F.col("signature") != "binlike")).alias("rejected"), of(archive).alias("archives"), unique(archive).alias("unique_archives"), *[of(c & log).alias(n) for c, n in zip(verified, ("labeled", "provisional", "unlabeled"))], of(log & F.col("trainable")).alias("trainable"))


def rejected(files: DataFrame) -> DataFrame:
    return files.where("signature <> 'binlike'").withColumn("reason", F.concat(F.lit("signature:"), F.col("signature")))


def parseable(messages: DataFrame, probe: int = 3000) -> DataFrame:
    """Per log that has any message among its first `probe`: messages and kinds among these, which is what a probe is."""
    return messages.where(F.col("seq") < probe).groupBy("log_id").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("msg_type").alias("kinds"))


def with_archives(logs: DataFrame, archives: DataFrame) -> DataFrame:
    """Logs and archives, each hash once, with their category."""
    one = lambda df, name: df.groupBy("sha").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies")).withColumn("category", name)
    return reduce(DataFrame.unionByName, [one(logs, F.lit("log")), one(archives.where("synthetic"), F.lit("synthetic")), one(archives.where("not synthetic"), F.lit("archive"))])


def rare_labels(rows: DataFrame, label: str, labels: DataFrame, least: int) -> DataFrame:
    """Labels (label) that fewer than `least` rows have, those of no row included."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(labels).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def build_report(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Rows per reason to skip them, the first that holds, and `processed`."""
    why = F.coalesce(*[F.when(c, n) for n, c in reasons], F.lit("processed"))
    return rows.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def manual_labels(document: DataFrame, column: str) -> DataFrame:
    """Rows of a JSON object of labels by file name, with a label and a confidence that are allowed."""
    own = document.select(F.explode(F.from_json(column, "map<string, struct<label: string, confidence: string>>")).alias("name", "v"))
    return own.where(F.trim(F.coalesce("v.label", F.lit(""))) != "").select("name", F.lower("v.label").alias("label"), safe_confidence(F.col("v.confidence")).alias("confidence"))


# Labels that are symptoms, and the causes that may take their place.
SYMPTOMS = ["mechanical_failure", "rc_failsafe", "ekf_failure", "crash_unknown"]
CAUSES = ["vibration_high", "compass_interference", "power_instability"]


def relabelled(rows: DataFrame, hits: DataFrame, key: str, symptoms: list[str] = SYMPTOMS, least: float = 0.65) -> DataFrame:
    """rows (key, labels) in which a symptom, or no label, gives way to the surest physical cause that a rule is sure of by over `least`."""
    best = hits.where((F.col("confidence") > least) & F.col("failure_type").isin(CAUSES)).groupBy(key).agg(F.min_by("failure_type", F.struct(-F.col("confidence"), F.col("failure_type"))).alias("_best"))
    own = rows.join(best, key, "left")
    weak = (F.size("labels") == 0) | F.exists("labels", lambda x: x.isin(symptoms))
    changed = weak & F.col("_best").isNotNull()
    return own.withColumn("changed", changed).withColumn("labels", F.when(F.col("changed"), F.array("_best")).otherwise(F.col("labels"))).drop("_best")


def boundary_errors(rows: DataFrame, key: str, valid: list[str], source: str) -> DataFrame:
    """Rows that have a label out of `valid`, or a simulated source: key, error."""
    labels = rows.select(key, F.explode("labels").alias("x")).where(~F.col("x").isin(valid)).select(key, F.concat(F.lit("unknown label "), F.col("x")).alias("error"))
    return labels.unionByName(rows.where(F.upper(source).contains("SIM")).select(key, F.lit("simulated source").alias("error")))


def attachments(posts: DataFrame, topic: str, html: str, base: str) -> DataFrame:
    """Attachments linked from posts: topic, url (to download, once per topic), kind by its name."""
    href = F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), F.lit(1)))
    own = posts.select(topic, href.alias("_h")).select(topic, download_url(F.col("_h"), base).alias("url")).distinct()
    return own.withColumn("kind", F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]{1,4})(?:[?#].*)?$", 1)), F.lit("")), F.lit("none")))


def expert_block(diagnoses: DataFrame, topic: str) -> DataFrame:
    """One row per labelled topic, the label in upper case."""
    return diagnoses.where("label is not null").select(topic, F.upper("label").alias("label"), "quote").dropDuplicates([topic])
