"""Quality rules of documents and of the hosts they come from (op3).

Method: each document is held against a few rules. Failures are counted by host; each host's rate
for a rule is shrunk towards the rates of all hosts with a beta prior whose two parameters are fitted
to the hosts by moments. A host is distrusted under a rule if its shrunk rate is over DISTRUST. These
verdicts are joined back: a document that fails a rule goes if its host is distrusted under that
rule, or if it fails the rule by far, whatever its host. A document that fails no rule stays, however
bad its host is.

Edge cases: a null text has no words and fails the base; a null source is a host of its own; with no
documents there are no hosts; if all hosts have the same rate, or there is one, the prior is the
overall rate with the weight of STRONGEST documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import checkpointed, join_hot, released, rows_left, small_batches, table, utf8, without
from ._words import NOT_SPACE, batches, by_text, words

#: A rule: the two counts whose ratio it looks at, from where a document fails, and from where by far.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.05, 0.2),
    "lines": ("n_dup_lines", "n_lines", 0.3, 0.7),
    "repeats": ("n_repeat_words", "n_words", 0.3, 0.5),
    "long_words": ("word_chars", "n_words", 12.0, 25.0),
}
MIN_WORDS, MAX_REPEATS = 50, 50
DISTRUST = 0.3
STRONGEST = 10_000.0
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def measures(texts: list[bytes]) -> np.ndarray:
    """A row of _COUNTS for each text."""
    out = np.zeros((len(texts), len(_COUNTS)), np.int64)
    for a, b in batches(texts):
        w = words(texts[a:b], NOT_SPACE, lower=False)
        n = np.diff(w.first)
        inside = NOT_SPACE[w.data]
        text_of = np.repeat(np.arange(b - a), n)
        # windows of three words, as triples of codes and the text, ranked step by step
        covered = np.zeros(len(text_of), bool)
        last = len(text_of) - 2
        if last > 0:
            own = np.flatnonzero(text_of[:last] == text_of[2:])
            codes = w.codes.astype(np.int64)
            span = len(w.forms) + 1
            key = _ranked(codes[own] * span + codes[own + 1]) * span + codes[own + 2]
            key = _ranked(_ranked(key) * (b - a) + text_of[own])
            twice = own[np.bincount(key)[key] > 1] if len(own) else own
            for d in range(3):
                covered[twice + d] = True
        # lines: a text's last one has no line end
        ends = w.data == 10
        if len(w.data):
            tails = w.bounds[1:][w.bounds[:-1] < w.bounds[1:]]
            cut = np.union1d(np.flatnonzero(ends) + 1, np.concatenate(([0], tails)))
            stops = cut[1:] - ends[cut[1:] - 1]
            has = np.searchsorted(w.starts, cut[1:]) > np.searchsorted(w.starts, cut[:-1])
            raw = np.empty(2 * len(has) + 1, np.int32)
            raw[:-1:2], raw[1::2], raw[-1] = cut[:-1], stops, len(w.data)
            lines = pa.BinaryArray.from_buffers(pa.binary(), 2 * len(has), [None, pa.py_buffer(raw.tobytes()), pa.py_buffer(w.data.tobytes())])
            at = np.flatnonzero(has)
            code = lines.take(pa.array(2 * at)).dictionary_encode().indices.to_numpy().astype(np.int64)
            of = np.searchsorted(w.bounds, cut[:-1][at], "right") - 1
            out[a:b, 4] = np.bincount(of, minlength=b - a)
            pairs = np.unique(code * (b - a) + of)
            out[a:b, 3] = out[a:b, 4] - np.bincount(pairs % (b - a), minlength=b - a)
        out[a:b, 0] = n
        out[a:b, 1] = by_text(inside & ((w.data & 0xC0) != 0x80), w.bounds)
        out[a:b, 2] = by_text(_SYMBOLS[w.data], w.bounds)
        out[a:b, 5] = by_text(covered, w.first)
    return out


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text_col and with the counts of _COUNTS (long)."""
    rest = without(docs, text_col, "_text", *_COUNTS)
    names = rest.columns
    schema = rest.schema
    for c in _COUNTS:
        schema = schema.add(c, "long")

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = measures(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(np.ascontiguousarray(x)) for x in found.T)], [*names, *_COUNTS])
        released()

    return docs.select(*[F.col(f"`{c}`") for c in names], utf8(text_col).alias("_text")).mapInArrow(count, schema)


def _fails(rule: str, by_far: bool = False) -> Column:
    over, under, *least = RULES[rule]
    return F.coalesce(F.try_divide(F.col(over), F.col(under)) >= F.lit(least[by_far]), F.lit(False))


def host_verdicts(counts: DataFrame, host_col: str = "source") -> DataFrame:
    """Per host: n_docs, and for each rule rate_<rule> (shrunk) and distrusts_<rule>."""
    hosts = counts.groupBy(F.col(host_col).alias("_host")).agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(_fails(r)).alias(f"f_{r}") for r in RULES])
    moments = [F.avg(1 / F.col("n_docs")).alias("inverse")]
    for r in RULES:
        rate = F.col(f"f_{r}") / F.col("n_docs")
        moments += [(F.sum(f"f_{r}") / F.sum("n_docs")).alias(f"m_{r}"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias(f"v_{r}")]
    whole = hosts.agg(*moments)
    out = hosts.crossJoin(F.broadcast(whole))
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        spread = m * (1 - m)
        between = F.greatest(v - spread * F.col("inverse"), spread / (STRONGEST + 1))
        weight = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(spread, between), F.lit(1.0)) - 1)
        rate = (F.col(f"f_{r}") + m * weight) / (F.col("n_docs") + weight)
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"distrusts_{r}", rate > DISTRUST)
    return out.select("_host", "n_docs", *[f"{x}_{r}" for r in RULES for x in ("rate", "distrusts")])


def judged(docs: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without text_col, with the counts, base_failed and kept."""
    counts = checkpointed(measured(docs, text_col))
    hosts = checkpointed(host_verdicts(counts, host_col))
    key = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")).alias("_key")
    marked = counts.select("*", key(host_col))
    facts = hosts.select(key("_host"), F.col("n_docs").alias("_n"), *[F.col(f"distrusts_{r}").alias(f"_d_{r}") for r in RULES])
    joined = join_hot(marked, facts, ["_key"], "_n", counts.count())
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | _fails(r, by_far=True) | (_fails(r) & F.col(f"_d_{r}"))
    own = without(counts, "base_failed", "kept").columns
    return joined.select(*[F.col(f"`{c}`") for c in own], base.alias("base_failed"), (~base & ~bad).alias("kept"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep; rows of one id are judged each by its own text. Edge cases are as above;
    other columns of docs, whatever their names, stay as they are."""
    with small_batches(spark):
        judged_ = judged(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("_gone_hash")))
    return rows_left(docs, judged_.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), "_gone_hash"))


QUERIES = {"op3_host_rules": op3_host_rules}


def _sql() -> str:
    fails, far = ({r: f"coalesce({RULES[r][0]} / nullif({RULES[r][1]}, 0) >= {RULES[r][k]}, false)" for r in RULES} for k in (2, 3))
    host = ", ".join(f"count(*) FILTER (WHERE {fails[r]}) AS f_{r}" for r in RULES)
    whole = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, coalesce(var_samp(f_{r} / n), 0) AS v_{r}" for r in RULES)
    weight = {r: f"greatest(0, coalesce(m_{r} * (1 - m_{r}) / nullif(greatest(v_{r} - m_{r} * (1 - m_{r}) * inverse, m_{r} * (1 - m_{r}) / {STRONGEST + 1}), 0), 1) - 1)" for r in RULES}
    verdict = ", ".join(f"(f_{r} + m_{r} * {weight[r]}) / (n + {weight[r]}) > {DISTRUST} AS d_{r}" for r in RULES)
    bad = " OR ".join(f"{far[r]} OR ({fails[r]} AND d_{r})" for r in RULES)
    return rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 2] AS tri FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS r(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, unnest([0, 1, 2]) AS u(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
h AS (SELECT source, count(*) AS n, {host} FROM m GROUP BY source),
a AS (SELECT {whole}, avg(1 / n) AS inverse FROM h),
v AS (SELECT source, {verdict} FROM h, a),
b AS (SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATS} * n_words AS base_failed, {bad} AS bad FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM b
"""


ORACLE_SQL = {"op3_host_rules": _sql()}
