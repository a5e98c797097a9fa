import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
from aerolith.llm import suffix_dedup
from aerolith.llm._grams import anchors


def brute(rows, window=50):
    least = defaultdict(lambda: float("inf"))
    for d, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            least[b[p : p + window]] = min(least[b[p : p + window]], d)
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < d:
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed=3):
    r = random.Random(seed)
    words = ["the", "of", "ñandú", "ing", "édith", "a", "zz", "\n", "plain", "stone", "\0x"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, long = make(18), make(400)
    rows = [(i, make(r.randint(1, 60))) for i in range(40)]
    rows += [(100 + i, make(5) + shared + make(7)) for i in range(12)]
    rows += [(200 + i, long) for i in range(5)] + [(300, long[:300] + make(3) + long[300:]), (301, "a" * 500), (302, "a" * 70), (303, "a" * 49)]
    rows += [(304, None), (305, ""), (306, shared[:50]), (307, "ab" * 90), (308, "ab" * 60 + "c"), (309, long), (309, long), (310, make(2000))]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(x) for x in suffix_dedup.dedup(df, **how).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect())


def test_against_brute_force_in_many_chunks(spark):
    rows = texts()
    assert run(spark, rows, chunk_bytes=1500, range_bytes=1500) == brute(rows)


def test_against_brute_force_in_one_chunk_and_other_window(spark):
    rows = texts(8)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, window=21, chunk_bytes=4000, range_bytes=4000) == brute(rows, 21)


def test_rows_without_an_id_and_of_one_id_against_brute_force(spark):
    rows = texts(5) + [(None, t) for _, t in texts(6)] + [(7, t) for _, t in texts(9)]
    # a null id counts as larger than all
    big = [(float("inf") if d is None else d, t) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.dedup(df, chunk_bytes=1500, range_bytes=1500).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    got = sorted((float("inf") if r[0] is None else r[0], *r[1:]) for r in out)
    assert got == brute(big)


def test_every_window_has_one_anchor():
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    data[1000:1400] = 97
    bounds = np.array([0, 30, 700, 700, 3000, 5000])
    a = anchors(data, bounds, 50, block=600)
    covered = [p for f, z in zip(a.first, a.last) for p in range(f, z + 1)]
    assert covered == [p for b, e in zip(bounds, bounds[1:]) for p in range(b, e - 49)]
    assert all(f <= q <= f + 50 and q <= f + 26 or q >= z for q, f, z in zip(a.at, a.first, a.last))


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(2)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(10)) for _ in range(r.randint(0, 30))) for _ in range(7)]
    lcp = lambda a, b: next((i for i in range(10) if a[i] != b[i]), 10)
    of, known = suffix_dedup.merge_runs([(x, [0, *map(lcp, x, x[1:])]) for x in runs])
    at = [0] * 7
    out = []
    for i in of:
        out.append(runs[i][at[i]])
        at[i] += 1
    assert out == sorted(sum(runs, []))
    assert known[1:] == list(map(lcp, out, out[1:]))


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_removed string, lang string")
    out = suffix_dedup.dedup(df)
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "n_bytes", "n_removed", "n_spans", "kept"]
    df = spark.createDataFrame([(None, "x" * 60, "q", "en"), (4, "x" * 60, None, None)], df.schema)
    assert {(r.doc_id, r.n_removed, r.lang) for r in suffix_dedup.dedup(df).collect()} == {(None, 60, "en"), (4, 0, None)}


def test_stage_keeps_whole_characters(spark):
    text = "é" * 40 + "tail one"
    df = spark.createDataFrame([(1, text, "fr", "s", 48), (2, "x" + text[1:] + "!", "fr", "s", 49)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in suffix_dedup.stage(spark, df, "").collect()}
    assert out[1].text == text and out[2].text == "x!" and out[2].n_chars == 2


def test_parts_of_a_chunk_against_brute_force(spark):
    rows = texts(4)
    assert run(spark, rows, chunk_bytes=1500, range_bytes=1500, part=7) == brute(rows)
    assert run(spark, rows, part=40) == brute(rows)


def test_parts_keep_pieces_whole():
    edges = np.array([0, 3, 5, 6, 20, 21, 22])
    assert list(suffix_dedup._parts(edges, 5)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(suffix_dedup._parts(np.array([0]), 5)) == []


def test_a_chunk_needs_little_memory_beside_its_text():
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    held = pa.array([" ".join(r.choices(vocabulary, k=600)).encode() for _ in range(1000)], pa.binary())
    size = held.nbytes
    tracemalloc.start()
    try:
        chunk = suffix_dedup.Chunk(held, np.arange(len(held)), 50)
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        masks = np.zeros(len(chunk.keys), np.uint64)
        masks[::9] = 1
        gone = suffix_dedup._gone(chunk.anchors.at, masks, len(chunk.data), 50)
        suffix_dedup._whole_characters(chunk.data, gone, chunk.bounds)
        assert suffix_dedup._tally(gone, chunk.bounds).sum() == gone.sum() > 0
        spread = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert found < 8 * size, found / size
    assert spread < 6 * size, spread / size


def test_characters_end_with_their_document():
    data = np.frombuffer("aé".encode() + b"\xa9b" + "éé".encode(), np.uint8)
    gone = np.array([0, 0, 1, 0, 0, 1, 0, 0, 0], bool)
    suffix_dedup._whole_characters(data, gone, np.array([0, 3, 3, 9]), block=2)
    assert gone.tolist() == [False, True, True, False, False, True, True, False, False]
