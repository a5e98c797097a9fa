"""Product codes of vectors in whole numbers, nearest entries found in the Walsh-Hadamard domain (op12).

Method: a component x counts as floor(1024 * x). Vectors are cut into PARTS parts; each part has a
codebook of at most ENTRIES entries, which starts as the parts of the rows with the smallest ids and is
refined ROUNDS times by the rows nearest to each entry. To find the nearest entry, parts and entries
are padded with zeros to a power of two P and transformed by the integer Walsh-Hadamard matrix, whose
rows are put in order of sequency, so the first coefficients hold most of the energy. Squared
differences there sum up to exactly P times the squared distance. They are accumulated coefficient by
coefficient for all entries; an entry goes as soon as its sum is above the whole sum of one that was
measured to the end. Nothing is rounded: all sums are 64-bit integers where they are sure to fit, and
Python's integers otherwise.

Each round is one pass over the vectors; a task sends a row for each part and entry, and the driver
gets PARTS * ENTRIES rows of sums, however many vectors there are.

Edge cases: rows whose vector is null or has null or non-finite components are left out; a length that
PARTS does not divide is filled up with zeros at the end; lengths that differ are an error (ValueError),
as are components of 2**42 or more (ArithmeticError) and an error that no long holds; null ids stay and
count as the largest; of rows with one id those with the smaller vector come first; with fewer than
ENTRIES rows there are as many entries; an entry that no part is nearest to stays; null labels are one
label; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ._spark import checkpointed, join_hot, released, table
from ._vectors import finite, integers, width

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Parts that are compared with all entries at once, and coefficients before the first entries go.
_ROWS, _FIRST = 2048, 3
#: Sums up to here are kept in 64 bits.
_SAFE = 1 << 62


def transformed(x: np.ndarray) -> np.ndarray:
    """The rows of x, padded with zeros to a power of two, in the Walsh-Hadamard domain in order of sequency."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), n), x.dtype)
    y[:, : x.shape[1]] = x
    step = 1
    while step < n:
        y = y.reshape(len(x), -1, 2, step)
        y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return y[:, sequency(n)]


def sequency(n: int) -> np.ndarray:
    """The rows of the natural Hadamard matrix of size n by their number of sign changes."""
    signs = np.array([[bin(i & j).count("1") % 2 for j in range(n)] for i in range(n)])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest row of entries, of equals the first, and the squared distance."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * n * n * largest * largest >= _SAFE:
        x, entries = x.astype(object), entries.astype(object)
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    c = transformed(entries)
    for at in range(0, len(x), _ROWS):
        y = transformed(x[at : at + _ROWS])
        rows = np.arange(len(y))
        first = min(_FIRST, n)
        sums = np.zeros((len(y), len(c)), y.dtype)
        for j in range(first):
            sums += (y[:, j, None] - c[None, :, j]) ** 2
        likely = sums.argmin(1)
        bound = ((y - c[likely]) ** 2).sum(1)
        row, entry = np.nonzero(sums <= bound[:, None])
        left = sums[row, entry]
        for j in range(first, n):
            left = left + (y[row, j] - c[entry, j]) ** 2
            stays = np.flatnonzero(left <= bound[row])
            if len(stays) < len(row):
                row, entry, left = row[stays], entry[stays], left[stays]
        # the rows are in order and each has an entry left: the one that gave its bound
        starts = np.searchsorted(row, rows)
        least = np.minimum.reduceat(left, starts)
        won = np.flatnonzero(left == least[row])
        won = won[np.unique(row[won], return_index=True)[1]]
        index[at : at + len(y)] = entry[won]
        error[at : at + len(y)] = least // n
    return index, error


def _filled(x: np.ndarray, parts: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))


def codebooks(vectors: DataFrame, n: int, *, id_col: str, vec_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The entries of each part, after `rounds` rounds over all vectors, each of n components."""
    head = vectors.orderBy(F.col(id_col).asc_nulls_last(), vec_col).limit(entries).select(vec_col).toArrow()
    start = _filled(integers(head[vec_col].combine_chunks(), n), parts)
    books = np.split(start, parts, axis=1)
    each = start.shape[1] // parts
    schema = "part int, entry int, n long, sums array<long>"

    def sums_with(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = [np.zeros(len(b), np.int64) for b in books]
            total = [np.zeros(b.shape, object) for b in books]
            for batch in batches:
                for k, x in enumerate(np.split(_filled(integers(batch.column(0), n), parts), parts, axis=1)):
                    index, _ = nearest(x, books[k])
                    order = np.argsort(index, kind="stable")
                    own, starts = np.unique(index[order], return_index=True)
                    if len(own):
                        count[k][own] += np.diff(np.r_[starts, len(index)])
                        total[k][own] += np.add.reduceat(x[order], starts, axis=0).astype(object)
            for k in range(parts):
                own = np.flatnonzero(count[k])
                yield pa.RecordBatch.from_pydict({"part": pa.array([k] * len(own), pa.int32()), "entry": pa.array(own, pa.int32()), "n": pa.array(count[k][own]), "sums": pa.array(total[k][own].tolist(), pa.list_(pa.int64()))})
            released()

        return run

    for _ in range(rounds):
        rows = vectors.select(vec_col).mapInArrow(sums_with(books), schema)
        sums = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(each)]).alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in sums:
            books[r.part][r.entry] = [s // r.n for s in r.sums]
    return books


def coded(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each row with a finite vector."""
    own = finite(vectors.select(id_col, label_col, vec_col), vec_col)
    n = width(own, vec_col)
    schema = own.select(id_col, label_col).schema.add("code", StringType()).add("error", LongType())
    if n is None:
        empty = own.select(id_col, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.where(F.lit(False))
    books = codebooks(own, n, id_col=id_col, vec_col=vec_col, parts=parts, entries=entries, rounds=rounds)
    digest = hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = [], 0
            for x, book in zip(np.split(_filled(integers(batch.column(2), n), parts), parts, axis=1), books):
                index, left = nearest(x, book)
                codes.append(index)
                error = error + left
            text = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array(error.tolist(), pa.int64())], [id_col, label_col, "code", "error"])
        released()

    done = checkpointed(own.select(id_col, label_col, vec_col).mapInArrow(assign, schema))
    keyed = done.select("*", F.struct(F.col(label_col).isNull().alias("none"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("name")).alias("_key"))
    facts = keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return join_hot(keyed, facts, ["_key"], "_n", done.count()).select(id_col, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_hadamard_codes": op12_hadamard_codes}


def _sql() -> str:
    def assigned(book: str) -> str:
        d = "list_sum(list_transform(range(1, len(q.y) + 1), lambda i: (q.y[i] - c.y[i]) * (q.y[i] - c.y[i])))"
        return f"SELECT r, p, any_value(q.y) AS y, min(coalesce({d}, 0)::BIGINT * {ENTRIES} + e) AS m FROM q JOIN {book} c USING (p) GROUP BY r, p"

    out = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS y FROM v, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, y FROM q WHERE r <= {ENTRIES})"""
    for k in range(ROUNDS):
        out += f""",
a{k} AS MATERIALIZED ({assigned(f"c{k}")}),
s{k} AS MATERIALIZED (SELECT p, e, list(CAST(s - ((s % n) + n) % n AS BIGINT) // n ORDER BY i) AS y FROM (SELECT p, m % {ENTRIES} AS e, i, sum(y[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(y)) FROM q)) AS t(i) GROUP BY ALL) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN s{k} USING (p, e))"""
    return out + f""",
a AS MATERIALIZED ({assigned(f"c{ROUNDS}")}),
f AS (SELECT r, string_agg(lower(printf('%02x', m % {ENTRIES})), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (r), h
"""


ORACLE_SQL = {"op12_hadamard_codes": _sql()}
