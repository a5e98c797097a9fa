"""Curation of data sets: duplicates, provenance, leaks, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_hash(files: DataFrame, path: str, content: str) -> DataFrame:
    """Per SHA-256: the canonical path (shortest, then first in order) and the number of copies."""
    sha = F.sha2(F.col(content).cast("binary"), 256)
    return files.select(F.col(path).alias("_p"), sha.alias("sha256")).groupBy("sha256").agg(F.min_by("_p", F.struct(F.length("_p"), F.col("_p"))).alias("canonical"), F.count(F.lit(1)).alias("copies"))


def copy_paths(files: DataFrame, path: str, content: str) -> DataFrame:
    """The other paths of contents that occur more than once, a row for each: sha256, canonical, path."""
    own = files.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    many = own.groupBy("sha256").agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))).alias("canonical"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return own.join(many.drop("_n"), "sha256").where("path <> canonical").select("sha256", "canonical", "path")


def union_skips(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """What priority_union keeps and skips of each set: set, kept, skipped. Sums by key, so no key's rows meet in one task."""
    names = list(sets)
    every = reduce(DataFrame.unionByName, [s.select(F.col(key).alias("_k"), F.lit(i).alias("_i")) for i, s in enumerate(sets.values())])
    per = every.groupBy("_k").agg(F.min("_i").alias("_first"), *[F.count_if(F.col("_i") == i).alias(f"_n{i}") for i in range(len(names))])
    sums = per.agg(*[F.count_if(F.col("_first") == i).alias(f"_k{i}") for i in range(len(names))], *[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_n{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(n).alias("set"), F.col(f"_k{i}").alias("kept"), (F.col(f"_n{i}") - F.col(f"_k{i}")).alias("skipped")) for i, n in enumerate(names)])
    return sums.select(F.inline(rows))


def holdout(logs: DataFrame, manifest: DataFrame, trained: list[str]) -> tuple[DataFrame, DataFrame]:
    """A holdout of the logs (batch, name, position) of all batches but `trained`, and how it came about.

    manifest: batch, name, sha, one row of each file. rows: batch, name, sha of the first log (by batch, position,
    name) of each content that no trained batch has. counts: selected, overlap (known or repeated contents) and missing
    (not in the manifest of their batch). All are sums and minima by content, whatever number of logs share one.
    """
    old = manifest.where(F.col("batch").isin(trained)).select("sha").distinct().withColumn("_old", F.lit(True))
    found = logs.where(~F.col("batch").isin(trained)).join(manifest.select("batch", "name", "sha"), ["batch", "name"], "left")
    each = found.groupBy("sha").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("batch", "position", "name")).alias("_f")).join(old, "sha", "left")
    taken = F.col("sha").isNotNull() & F.col("_old").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = each.agg(F.count_if(taken).alias("selected"), (total(F.when(F.col("sha").isNotNull(), F.col("_n"))) - F.count_if(taken)).alias("overlap"), total(F.when(F.col("sha").isNull(), F.col("_n"))).alias("missing"))
    return each.where(taken).select("_f.batch", "_f.name", "sha"), counts


def priority_union(sets: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of sets, the first set first; of rows with one key the first stays. `priority` tells the set."""
    every = reduce(DataFrame.unionByName, [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sets)])
    w = Window.partitionBy(key).orderBy("priority", *order)
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_row(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def leaks(train: DataFrame, holdout: DataFrame, train_content: str, holdout_content: str, holdout_id: str) -> DataFrame:
    """Holdout rows whose content is in the training set."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return holdout.select(holdout_id, sha(holdout_content).alias("sha256")).join(train.select(sha(train_content).alias("sha256")), "sha256", "left_semi")


def unseen(candidates: DataFrame, excluded: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Candidates of new keys, the first of each."""
    return best_row(candidates.join(excluded.select(key), key, "left_anti"), key, [F.col(c) for c in order])


def upserted(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return held.join(new.select(key), key, "left_anti").unionByName(new)


def stratified(df: DataFrame, key: Column, label: str, share: float, prefix: int = 4) -> DataFrame:
    """in_test for the rows of each label whose hash, a hex string, is among the least `share`, by percent rank.

    Counts by the hash's first digits tell in which of 16**prefix cells the cut falls; only that cell's rows are ranked.
    """
    rows = df.withColumn("_k", key).withColumn("_cell", F.substring("_k", 1, prefix))
    counts = rows.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(label)
    cells = counts.withColumn("_to", F.sum("_c").over(own.orderBy("_cell"))).withColumn("_n", F.sum("_c").over(own)).withColumn("_before", F.col("_to") - F.col("_c"))
    # ranks from 0; the cut is at share * (n - 1)
    cut = F.when(F.col("_n") > 1, share * (F.col("_n") - 1)).otherwise(F.lit(1.0))
    cells = cells.select(F.col(label).alias("_l"), "_cell", "_before", cut.alias("_cut"), F.when(F.col("_to") - 1 < cut, True).when(F.col("_before") >= cut, False).alias("_sure"))
    marked = rows.join(cells.withColumnRenamed("_cell", "_d"), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_cell") == F.col("_d")))
    sure = marked.where("_sure is not null").withColumn("in_test", F.col("_sure"))
    rank = F.rank().over(Window.partitionBy(label, "_cell").orderBy("_k")) - 1
    open_ = marked.where("_sure is null").withColumn("in_test", F.col("_before") + rank < F.col("_cut"))
    return sure.unionByName(open_).drop("_k", "_cell", "_l", "_d", "_before", "_cut", "_sure")


def common_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(counts.select(label), label, "left_semi")


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column's values: approximate ranks tell between which values it is, only those are sorted."""
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    n, ends = rows.agg(F.count(F.lit(1)), F.percentile_approx("v", [0.499, 0.501], 10_000)).first()
    if not n:
        return None
    low, high = ends
    below, within = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
    first, last = (n - 1) // 2, n // 2
    if not (below <= first and last < below + within):
        low, high, below = float("-inf"), float("inf"), 0
    middle = rows.where(F.col("v").between(low, high)).orderBy("v").offset(first - below).limit(last - first + 1).collect()
    return sum(r.v for r in middle) / len(middle)


def median_imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's exact median; a column without values stays as it is."""
    found = {c: exact_median(df, c) for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in found.items() if m is not None})


def resolved_names(files: DataFrame, name: str, sha: str) -> DataFrame:
    """Target names without collisions: from the second content of a name on, stem_sha8.ext."""
    first = files.groupBy(name).agg(F.min(sha).alias("_first"))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 1)
    other = F.concat(stem, F.lit("_"), F.substring(sha, 1, 8), ext)
    return files.join(first, name).withColumn("target", F.when(F.col(sha) == F.col("_first"), F.col(name)).otherwise(other)).drop("_first")
