"""Toxicity by compression distance (op11).

Method: two zstandard dictionaries, one of ordinary text and one of toxic text, compress each window
of a text; how many bytes fewer the toxic one needs is the window's gain. A document's score comes
from the distribution of its windows' gains, through a logistic curve that is calibrated on labelled
documents whose text no dictionary has seen.

Training. Labelled documents are dealt by a hash of their id to three folds; two are for dictionaries,
one is for calibration. The ordinary dictionary is trained on windows of ordinary documents. Toxic
documents are mostly ordinary prose, so the toxic samples are narrowed first: what toxic text
compresses worst under the ordinary dictionary starts a dictionary in each of two folds; then each
fold takes the other's dictionary to find the windows that gain, and in these the word without which
most of the gain is lost. Words so found often enough are the next dictionary, the most frequent ones
nearest to its end. That is repeated ROUNDS times. The toxic dictionary is these words before the
ordinary dictionary's content, so both see the same ordinary prose, and ordinary windows gain nothing.

The fit reads at most DOCS labelled documents of each class and fold (smallest hashes first), whatever
the size of the table, and at most WINDOWS windows at once reach the trainer; all documents are scored by
whole texts.
Labels, lang, source and id are never inputs of a score.

Edge cases: a null or empty text has no windows and gets the score of a text without gains; repeated
rows and ids are scored each by its own text; an id labelled twice counts as toxic if any label is;
null labels are left out; without toxic or without ordinary training text nothing gains, and the score
is the smoothed share of toxic documents; an empty table gives no rows. Ids of any type are accepted.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ._spark import checkpointed, released, table, utf8

#: Documents of a class and fold that the fit reads at most, and windows that the trainer gets at once.
DOCS, WINDOWS = 4_000, 60_000
#: Bytes of a window when scored and when learned from, most of each dictionary's content.
WINDOW, LEARNED, ORDINARY, TOXIC = 48, 40, 96 << 10, 16 << 10
#: Share of toxic windows that start a dictionary; bytes that a window has to gain; rounds; how often
#: a word has to be found in a fold's windows.
HARD, GAIN, ROUNDS, TIMES = 0.3, 3, 4, 3
THRESHOLD = 0.7
#: Gains are counted from -SPAN to SPAN; larger ones count as that.
SPAN = 64
_FEATURES = 10
#: Standardised features are cut to -CLIP to CLIP, and their scales are at least these: a curve fitted on texts that are
#: much alike does not run away on others.
CLIP = 5.0
_LEAST_SCALE = np.array([0.05] * 8 + [1.0, 0.05])
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
_PARAMETERS = {"strategy": zstd.STRATEGY_LAZY2, "min_match": 4, "search_log": 5, "target_length": 64, "window_log": 17, "hash_log": 17, "chain_log": 17, "write_content_size": 0, "write_dict_id": 0}


class Model(NamedTuple):
    """Contents of both dictionaries, and the logistic curve over standardised features: weights, the last is the constant."""

    ordinary: bytes
    toxic: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]


def windows(text: bytes, size: int) -> Iterator[bytes]:
    """text, lower-cased, cut at blanks into windows of at most `size` bytes with a blank before; longer words are cut."""
    for found in re.finditer(rb"(?s)[^ ].{0,%d}(?= |$)|[^ ].{0,%d}" % (size - 1, size - 1), text.translate(_PLAIN)):
        yield b" " + found.group()


@lru_cache(maxsize=8)
def compressor(content: bytes) -> zstd.ZstdCompressor:
    parameters = zstd.ZstdCompressionParameters(**_PARAMETERS)
    if len(content) < 8:
        return zstd.ZstdCompressor(compression_params=parameters)
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def gains(parts: list[bytes], ordinary: bytes, toxic: bytes) -> list[int]:
    """By how many bytes each part is shorter with the toxic words before the ordinary content."""
    a, b = compressor(ordinary), compressor(toxic + ordinary)
    return [len(a.compress(x)) - len(b.compress(x)) for x in parts]


def histogram(text: bytes, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """How many windows of the text have each gain from -SPAN to SPAN."""
    a, b = compressor(ordinary), compressor(toxic + ordinary)
    counts = Counter(len(a.compress(x)) - len(b.compress(x)) for x in windows(text, WINDOW))
    out = np.zeros(2 * SPAN + 1)
    for gain, n in counts.items():
        out[min(max(gain, -SPAN), SPAN) + SPAN] += n
    return out


def features(counts: np.ndarray) -> list[float]:
    """Means of gains and of what they exceed by 1 and 3, means of the highest 1, 3 and 8, shares of at least 4 and 2, log of their number, mean loss."""
    n = max(counts.sum(), 1.0)
    gain = np.arange(-SPAN, SPAN + 1)
    over = lambda x: float(np.maximum(gain - x, 0) @ counts) / n
    above = np.concatenate((np.cumsum(counts[::-1])[::-1], [0.0]))
    top = lambda k: float(gain @ (np.minimum(above[:-1], k) - np.minimum(above[1:], k))) / max(min(k, counts.sum()), 1.0)
    share = lambda x: float(counts[SPAN + x :].sum()) / n
    return [float(gain @ counts) / n, over(1), over(3), top(1), top(3), top(8), share(4), share(2), float(np.log1p(counts.sum())), float(np.maximum(-gain - 1, 0) @ counts) / n]


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """The content of a dictionary trained on the samples; of too few for the trainer, the samples themselves."""
    if sum(map(len, samples)) > 8 * size:
        try:
            return zstd.train_dictionary(size + 2048, samples, level=3, **how).as_bytes()[-size:]
        except zstd.ZstdError:
            pass
    return b"".join(samples)[-size:]


def narrowed(parts: list[bytes], ordinary: bytes, toxic: bytes) -> Counter[bytes]:
    """The words that make windows gain, and how often."""
    words: Counter[bytes] = Counter()
    for part, gain in zip(parts, gains(parts, ordinary, toxic)):
        own = part[1:].split(b" ")
        if gain < GAIN or len(own) < 2:
            continue
        left = gains([b" " + b" ".join(own[:i] + own[i + 1 :]) for i in range(len(own))], ordinary, toxic)
        least = min(range(len(own)), key=left.__getitem__)
        if gain - left[least] >= GAIN - 1:
            words[b" " + own[least]] += 1
    return words


def head(words: dict[bytes, int]) -> bytes:
    """The content of a toxic dictionary: the words, the most frequent last."""
    return b"".join(w for _, w in sorted((n, w) for w, n in words.items()))[-TOXIC:]


def calibrated(rows: np.ndarray, toxic: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Mean and scale of each feature and the weights of a logistic curve with a small ridge, by Newton's method."""
    if not len(rows):
        rows, toxic = np.zeros((2, _FEATURES)), np.array([0.0, 1.0])
    mean, scale = rows.mean(0), np.maximum(rows.std(0), _LEAST_SCALE)
    x = np.c_[np.clip((rows - mean) / scale, -CLIP, CLIP), np.ones(len(rows))]
    # the constant starts at the smoothed share and is not drawn to 0
    share = (toxic.sum() + 0.5) / (len(toxic) + 1.0)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - toxic) + ridge * np.r_[w[:-1], 0.0])
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return mean.tolist(), scale.tolist(), w.tolist()


def _in_fold(column: str, mod: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit("fold")), F.lit(mod))


def _cut(docs: DataFrame) -> DataFrame:
    """toxic, fold, part, place (a hash) of all windows of docs (toxic, fold, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, fold, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = list(windows(text, LEARNED))
                yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic] * len(parts), pa.int32()), "fold": pa.array([fold] * len(parts), pa.int32()), "part": pa.array(parts, pa.binary())})

    return docs.mapInArrow(run, "toxic int, fold int, part binary").withColumn("place", F.xxhash64("part", F.monotonically_increasing_id()))


def _measured(docs: DataFrame, names: list[str], ordinary: bytes, toxic: bytes) -> DataFrame:
    """The columns `names` of docs and `features` of the text, which is the last column."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(histogram(x.as_py() or b"", ordinary, toxic)) for x in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(found, pa.list_(pa.float64()))], [*names, "features"])
        released()

    schema = docs.select(*names).schema.add("features", ArrayType(DoubleType()))
    return docs.mapInArrow(run, schema)


def toxic_dictionary(parts: DataFrame, ordinary: bytes) -> bytes:
    """The content of the toxic dictionary, from windows (fold 0 or 1, part as bytes) of toxic texts: tasks find the words."""

    def costly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = [len(compressor(ordinary).compress(x)) / (len(x) + 8) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cost, pa.float64())], ["fold", "part", "cost"])

    def found(heads: list[bytes]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold, every = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for k in (0, 1):
                    # each fold is searched with what the other one found
                    words = narrowed([x for x, f in zip(every, fold) if f == k], ordinary, heads[1 - k])
                    yield pa.RecordBatch.from_pydict({"fold": pa.array([k] * len(words), pa.int32()), "word": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64())})

        return run

    costs = checkpointed(parts.mapInArrow(costly, "fold int, part binary, cost double"))
    heads = []
    for k in (0, 1):
        own = costs.where(F.col("fold") == k)
        bound = own.agg(F.percentile_approx("cost", 1 - HARD)).first()[0]
        hard = own.where(F.col("cost") >= bound).orderBy(F.xxhash64("part"), "part").limit(WINDOWS).select("part").toArrow() if bound is not None else None
        heads.append(_trained(hard["part"].to_pylist(), TOXIC // 2, k=16, d=6) if hard is not None else b"")
    words: Counter[bytes] = Counter()
    for _ in range(ROUNDS):
        # of a bounded sample, so are the words
        rows = parts.mapInArrow(found(heads), "fold int, word binary, n long").groupBy("fold", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES).collect()
        own = [{bytes(r.word): r.n for r in rows if r.fold == k} for k in (0, 1)]
        heads = [head(w) for w in own]
        words = Counter(own[0]) + Counter(own[1])
    return head(words)


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the labelled rows of docs; labels: id, 0 or 1. What reaches the driver is bounded by DOCS and WINDOWS."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    marked = marked.withColumn("fold", _in_fold("_id", 3).cast("int"))
    chosen = None
    for fold in (0, 1, 2):
        for kind in (0, 1) if fold < 2 else (None,):
            own = marked.where((F.col("fold") == fold) & (F.lit(True) if kind is None else F.col("toxic") == kind)).orderBy(F.xxhash64("_id"), "_id").limit(DOCS)
            chosen = own if chosen is None else chosen.unionByName(own)
    # at most 5 * DOCS rows
    texts = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("toxic", "fold", utf8(text_col).alias("text"))
    every = checkpointed(_cut(texts.where("fold < 2 and not (fold = 1 and toxic = 0)")))
    plain = every.where("toxic = 0").orderBy("place", "part").limit(WINDOWS).select("part").toArrow()["part"].to_pylist()
    bad = every.where("toxic = 1").select("fold", "part")
    ordinary = _trained(plain, ORDINARY)
    toxic = toxic_dictionary(bad, ordinary) if plain else b""
    seen = _measured(texts.where("fold = 2").select("toxic", "text"), ["toxic"], ordinary, toxic).toArrow()
    rows = np.array(seen["features"].to_pylist(), float).reshape(-1, _FEATURES)
    return Model(ordinary, toxic, *calibrated(rows, seen["toxic"].to_numpy().astype(float)))


def scored(docs: DataFrame, model: Model, names: list[str], text_col: str = "text") -> DataFrame:
    """The columns `names` of docs and `score`, from 0 to 1."""
    measured = _measured(docs.select(*names, utf8(text_col).alias("_text")), names, model.ordinary, model.toxic)
    at = F.lit(float(model.weights[-1]))
    for i, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights)):
        standard = (F.col("features")[i] - F.lit(float(m))) / F.lit(float(s))
        at = at + F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), standard)) * F.lit(float(w))
    return measured.select(*names, (1 / (1 + F.exp(-at))).alias("score"))


def op11_zstd_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned where crc32 of the id's text is not 1 modulo 3; all documents are scored."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fitted(docs.where(~held), labels.where(~held))
    out = scored(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op11_zstd_dictionaries": op11_zstd_dictionaries}
ORACLE_SQL: dict[str, str] = {}
