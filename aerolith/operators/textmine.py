"""Labels from discussion posts by a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.columns import stripped_html

from .imports import download_url


def word(text: str) -> str:
    """A pattern for a whole word that Java and other engines read alike."""
    return f"(^|[^A-Za-z0-9_]){text}([^A-Za-z0-9_]|$)"


def lexicon_score(text: Column, lexicon: dict[str, list[str]], intent: list[str], doubt: list[str]) -> Column:
    """struct(score, order, label) of the best label: one point per pattern, two for intent, one less for doubt."""
    low = F.lower(text)
    hit = lambda words: reduce_or([low.rlike(word(w)) for w in words])
    extra = F.when(hit(intent), 2).otherwise(0) - F.when(hit(doubt), 1).otherwise(0)
    options = []
    for i, (label, words) in enumerate(lexicon.items()):
        own = sum((F.when(low.rlike(word(w)), 1).otherwise(0) for w in words), F.lit(0))
        options.append(F.struct(F.when(own > 0, own + extra).otherwise(0).alias("score"), F.lit(-i).alias("order"), F.lit(label).alias("label")))
    return F.array_max(F.array(*options))


def reduce_or(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def matched(text: Column, label: Column, lexicon: dict[str, list[str]]) -> Column:
    """The first pattern of the label's list that the text has, as it stands there; null if none."""
    low = F.lower(text)
    found = lambda w: F.nullif(F.regexp_extract(low, f"(?:^|[^A-Za-z0-9_])({w})(?:[^A-Za-z0-9_]|$)", 1), F.lit(""))
    return F.coalesce(*[F.when(label == name, F.coalesce(*[found(w) for w in words])) for name, words in lexicon.items()])


def by_experts(posts: DataFrame, developers: DataFrame, username: str = "username", title: str = "title", group: str = "group", staff: str = "staff") -> DataFrame:
    """Posts of users whom the table of developers (username) has, whose title or group says developer, or who are staff.

    Names are compared as they are, without white space at the ends. Nulls say nothing, and a user without a name is
    in no table. A developer listed twice gives no post twice.
    """
    known = developers.select(F.trim(username).alias("_d")).where("_d <> ''").distinct().withColumn("_known", F.lit(True))
    says = lambda c: F.coalesce(F.lower(F.trim(F.col(c))).contains("developer"), F.lit(False))
    rows = posts.join(known, F.trim(posts[username]) == F.col("_d"), "left")
    return rows.where(F.col("_known").isNotNull() | says(title) | says(group) | F.coalesce(F.col(staff), F.lit(False))).drop("_d", "_known")


def expert_diagnoses(posts: DataFrame, topic: str, number: str, text: str, expert: Column, lexicon: dict[str, list[str]], intent: list[str], doubt: list[str], least: int = 2, quote: int = 420, html: bool = False) -> DataFrame:
    """Per topic the best-scored expert post: label, score, post number, quote and phrase (the pattern that matched first).

    With `html` the posts are HTML and read without tags. Of posts that score alike the first counts.
    """
    own = posts.where(expert).select(topic, number, (stripped_html(F.col(text)) if html else F.col(text)).alias("_text"))
    scored = own.withColumn("_s", lexicon_score(F.col("_text"), lexicon, intent, doubt))
    said = F.struct(F.col("_s.label").alias("label"), F.col("_s.score").alias("score"), F.col(number).alias("post"), F.substring("_text", 1, quote).alias("quote"), matched(F.col("_text"), F.col("_s.label"), lexicon).alias("phrase"))
    best = F.min_by(said, F.struct(-F.col("_s.score"), F.col(number)))
    # the best post decides, so the bound is asked once per topic, not of every post's patterns again
    return scored.groupBy(topic).agg(best.alias("_b")).where(F.col("_b.score") >= least).select(topic, "_b.label", "_b.score", "_b.post", "_b.quote", "_b.phrase")


def labelled_attachments(posts: DataFrame, diagnoses: DataFrame, topic: str, number: str, html: str, base: str, wanted: str = r"\.(bin|zip)", archives: bool = True) -> DataFrame:
    """The manifest of what a crawl is to load: attachments of topics that have a diagnosis, each address once.

    Of the posts that link to an address the first in order of topic and post number counts. Columns: url, topic,
    number, place (of the link in its post), attachment (as linked), and label, score, phrase, quote of the topic.
    """
    links = posts.select(topic, number, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), F.lit(1))).alias("place", "attachment"))
    rows = links.where(F.lower("attachment").rlike(wanted)).withColumn("url", download_url(F.col("attachment"), base))
    rows = rows if archives else rows.where(~F.lower("url").contains(".zip"))
    labels = diagnoses.select(topic, "label", "score", "phrase", "quote")
    first = rows.join(labels.select(topic), topic, "left_semi").groupBy("url").agg(F.min(F.struct(topic, number, "place", "attachment")).alias("_f"))
    return first.select("url", "_f.*").join(labels, topic)
