"""Web archives with revisit records, and a capture index by external merge (op1).

Method: pages become WARC/1.1 records; of equal payloads the one with the smallest page id is a
response, the others are revisits that refer to it. Archives are gzip files that Spark writes as text
with the blank line that ends a record as line end; they are read back as a stream of such pieces and
put together by Content-Length, so a record never has to fit a line. Every archive gives its index
entries in sorted runs of bounded length (URL key, time, page id). The runs are cut at common bounds, and each
range merges its pieces of all runs with a loser tree to its part of the global order of captures.

Edge cases: null html is an empty payload, and equal to an empty one; a null url has an empty key and
target; a null page id is written as `none`, reads back as null, comes before all others in the index
and is the response only where no row of its payload has an id; repeated rows are captures of their own:
one of an id is the response, that with the first url, and the others refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import checkpointed, join_hot, pieces, shared_folder, table, utf8

BLANK = "\r\n\r\n"
#: Records in an archive file, entries in a sorted run, entries in a range of the index on average,
#: and entries looked at for each bound between ranges.
FILE_RECORDS, RUN_ENTRIES, RANGE_ENTRIES, PER_BOUND = 20_000, 50_000, 50_000, 64
#: The first capture, and the seconds from one page id to the next: pages have no time of their own.
EPOCH, STEP_SECONDS = datetime(2024, 1, 1, tzinfo=UTC), 1
_NONE = "none"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{_NONE if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    return None if urn[10:-1] == _NONE else int(urn[10:-1])


def _place(key: str, captured: str, page_id: int | None) -> tuple[str, str, bool, int]:
    """The order of captures: by URL key, time and page id, those without an id first."""
    return key, captured, page_id is not None, page_id or 0


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then port, path and query, in lower case, without scheme, www and fragment."""
    m = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^?#]*)(\?[^#]*)?", (url or "").strip())
    host, port, path, query = (x or "" for x in m.groups())
    labels = re.sub(r"^www\d*\.", "", host.lower()).split(".")
    return f"{','.join(reversed(labels))}{'' if port in (':80', ':443') else port}){(path or '/').lower()}{query.lower()}" if host else ""


def _date(page_id: int | None) -> str:
    # page ids beyond what a calendar holds share its last days
    return (EPOCH + timedelta(seconds=(max(page_id or 0, 0) % 200_000_000_000) * STEP_SECONDS)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, revisit: bool = False, refers_to: int | None = None) -> bytes:
    """A record without the blank line that ends it; a revisit tells which page's response has its payload."""
    kind = "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}{BLANK}".encode()
    block = http + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {url}", f"WARC-Date: {_date(page_id)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BLANK.encode() + block


def write(pages: DataFrame, path: str, *, file_records: int = FILE_RECORDS) -> None:
    """Writes a record for each row of pages (page_id, url, html) to gzip archives in path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), utf8("html").alias("payload"))
    rows = rows.withColumn("key", F.concat(F.sha1("payload"), F.lit("-"), F.octet_length("payload").cast("string")))
    each = rows.groupBy("key", "page_id", "url").agg(F.count(F.lit(1)).alias("c"))
    response = F.min_by(F.struct("page_id", "url", "c"), F.struct(F.col("page_id").isNull(), "page_id", "url"))
    facts = each.groupBy("key").agg(F.sum("c").alias("n"), response.alias("r")).where("n > 1")
    facts = checkpointed(facts.select("key", "n", F.col("r.page_id").alias("first"), F.col("r.url").alias("first_url"), F.col("r.c").alias("copies")))
    joined = join_hot(rows, facts, ["key"], "n", rows.count())
    own = F.coalesce(F.col("page_id").eqNullSafe(F.col("first")) & (F.col("url") == F.col("first_url")), F.lit(False))
    columns = ("page_id", "url", "payload", "first", "revisit")
    marked = joined.where(~own | (F.col("copies") == 1)).withColumn("revisit", F.col("n").isNotNull() & ~own).select(*columns)
    if not facts.where("copies > 1").isEmpty():
        # of rows that agree in everything one is the response: they are brought together before they are counted out again
        twins = joined.where(own & (F.col("copies") > 1)).groupBy("key", "page_id", "url", "first", "copies").agg(F.any_value("payload").alias("payload"))
        out = twins.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).repartition("key", "i")
        marked = marked.unionByName(out.withColumn("revisit", F.col("i") > 1).select(*columns))

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, first, revisit in zip(*(batch.column(k).to_pylist() for k in range(5))):
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                clean = re.sub(r"[\r\n]+", " ", url)
                out.append(record(page_id, clean, payload, digest, len(payload), revisit, first).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    marked.mapInArrow(text, "value string").write.option("maxRecordsPerFile", file_records).option("lineSep", BLANK).option("compression", "gzip").text(path)


def records(pieces_of_file: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(file, number in the file, header fields, block) of each record.

    Pieces are what stands between blank lines, wherever a payload put those: they are laid end to end
    again, and only Content-Length tells where a record ends.
    """
    gap = BLANK.encode()
    name, number, head, held, want = "", 0, None, bytearray(), 0
    for file, piece in pieces_of_file:
        if file != name:
            if head is not None or held.strip(b"\r\n"):
                raise ValueError(f"{name} ends within a record")
            name, number, held = file, 0, bytearray()
        held += piece + gap
        while True:
            if head is None:
                end = held.find(gap)
                if end < 0 or not held.strip(b"\r\n"):
                    break
                lines = held[:end].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"{name}: no record at number {number}")
                head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                del held[: end + len(gap)]
                want = int(head["Content-Length"])
            if len(held) < want + len(gap):
                break
            if held[want : want + len(gap)] != gap:
                raise ValueError(f"{name}: record {number} is longer than it says")
            yield name, number, head, bytes(held[:want])
            del held[: want + len(gap)]
            number, head = number + 1, None
    if head is not None or held.strip(b"\r\n"):
        raise ValueError(f"{name} ends within a record")


_ENTRY = "page_id long, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, number long"


def read(spark: SparkSession, path: str, *, run_entries: int = RUN_ENTRIES) -> DataFrame:
    """The index entries of all records, in sorted runs: _ENTRY, and run (string) and at (its place there)."""
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        task, runs, held = TaskContext.get().partitionId(), 0, []

        def run() -> pa.RecordBatch:
            held.sort(key=lambda x: _place(x[1], x[2], x[0]))
            columns = [pa.array(c, t) for c, t in zip(zip(*held), types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([f"{task}-{runs}"] * len(held)), pa.array(np.arange(len(held)))], [*names, "run", "at"])

        for file, number, head, block in records(parts()):
            page_id = _id_of(head["WARC-Record-ID"])
            http, _, payload = block.partition(BLANK.encode())
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            target = None
            if head["WARC-Type"] == "revisit":
                target = _id_of(head["WARC-Refers-To"])
            elif len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{file}: record {number} doesn't have the payload that it tells of")
            held.append((page_id, url_key(head["WARC-Target-URI"]), head["WARC-Date"], head["WARC-Type"], size, digest, target, file.rsplit("/", 1)[-1], number))
            if len(held) >= run_entries:
                yield run()
                runs, held = runs + 1, []
        if held:
            yield run()

    source = spark.read.option("lineSep", BLANK).text(path)
    return source.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(entries, f"{_ENTRY}, run string, at long")


def merged_order(runs: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) of the entries of sorted runs in ascending order, by a tree of losers."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [(r[0], i) if r else None for i, r in enumerate(runs)] + [None] * (k - len(runs))
    at, tree, winners = [0] * k, [0] * k, [0] * k + list(range(k))
    less = lambda a, b: heads[b] is None or (heads[a] is not None and heads[a] < heads[b])
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if less(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while heads and heads[best] is not None:
        yield best, at[best]
        at[best] += 1
        run = runs[best]
        heads[best] = (run[at[best]], best) if at[best] < len(run) else None
        node = (best + k) >> 1
        while node:
            if less(tree[node], best):
                best, tree[node] = tree[node], best
            node >>= 1


def capture_index(entries: DataFrame, *, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Entries of all runs with range (int) and rank (long): ordered by these, they are ordered by URL key, time and page id.

    The bounds between ranges come from about PER_BOUND entries for each; they set the balance, not the order.
    """
    total = entries.count()
    n = pieces(total, range_entries)
    share = min(1.0, n * PER_BOUND / max(total, 1))
    looked = entries.where(F.pmod(F.xxhash64("page_id", "url_key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("url_key", "captured", "page_id") if n > 1 else None
    keys = sorted(_place(r.url_key, r.captured, r.page_id) for r in looked.collect()) if looked is not None else []
    bounds = [keys[len(keys) * i // n] for i in range(1, n)] if len(keys) >= n else keys
    of_range = "range int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            triples = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url_key", "captured", "page_id")))
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, _place(*x)) for x in triples], pa.int32()), *batch.columns], ["range", *batch.schema.names])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("run", "ascending"), ("at", "ascending")])
        run = t["run"].to_pylist()
        keys = list(map(_place, t["url_key"].to_pylist(), t["captured"].to_pylist(), t["page_id"].to_pylist()))
        cut = [i for i, x in enumerate(run) if not i or x != run[i - 1]] + [len(run)]
        order = [cut[r] + i for r, i in merged_order([keys[a:b] for a, b in zip(cut, cut[1:])])]
        return t.take(pa.array(order)).append_column("rank", pa.array(np.arange(len(order))))

    dealt = entries.mapInArrow(deal, of_range)
    return dealt.groupBy("range").applyInArrow(merge, f"{of_range}, rank long").drop("run", "at")


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    found = capture_index(checkpointed(read(spark, path)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range", "rank")


QUERIES = {"op1_capture_index": op1_capture_index}
ORACLE_SQL: dict[str, str] = {}
