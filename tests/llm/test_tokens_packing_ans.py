import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from aerolith.llm import ans, packing
from aerolith.llm._tokens import BYTE_LEVEL, WORD_LEVEL, Encoder, encoder, resolved
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ODD = ["Größe. naïve, ſtr İstanbul!! ĳ ŉ x*** ###a b.c Ça’s élan;: × ÷", "THE End.", "a  b\n\n c \t d ", " \n x", "it's don't 'tis 12345 a1b2", "foo  bar　\n z", "<|endoftext|> x <|startoftext|>", "É́ ß ſ Σ ΣΑΣ", "", " ", "\n", "a\x1cb", "tab\tx\r\ny", "end   ", "​x y", "x\x0b\x0cy  \x0bz", "a\x01b c", "x \x01 y", "  lead", "\0", "word " * 3000]


def plain(name):
    t = Tokenizer.from_file(resolved(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", [BYTE_LEVEL, WORD_LEVEL])
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    r = random.Random(4)
    texts = ODD + ["".join(r.choice(" \n\tab'é1.\xa0") for _ in range(r.randint(0, 40))) for _ in range(300)]
    whole = plain(name)
    want = [whole.encode(x, add_special_tokens=False).ids for x in texts]
    for small in (False, True):
        if small:
            monkeypatch.setattr("aerolith.llm._tokens.CACHED", 50)
            monkeypatch.setattr("aerolith.llm._tokens.BATCH", 200)
        got = []
        for _, _, ids, counts in Encoder(resolved(name)).encode([x.encode() for x in texts]):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want


def test_fullest_is_the_best_subset():
    r = random.Random(1)
    for _ in range(200):
        counts = [0] * 41
        items = [r.randint(3, 25) for _ in range(r.randint(0, 7))]
        for x in items:
            counts[x] += 1
        gap = r.randint(1, 40)
        best = max(sum(x for i, x in enumerate(items) if m >> i & 1) for m in range(1 << len(items)) if sum(x for i, x in enumerate(items) if m >> i & 1) <= gap)
        out = packing.fullest(sorted(set(items), reverse=True), counts, gap)
        assert sum(out) == best and all(out.count(x) <= counts[x] for x in out)


def test_minimum_bin_slack_is_tight_and_gapless():
    lengths = np.random.default_rng(2).integers(1, 4097, 4000)
    bins, offsets = packing.minimum_bin_slack(lengths, 4096)
    held = defaultdict(list)
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist()):
        held[b].append((o, n))
    for items in held.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 4096
    assert len(held) <= -(-lengths.sum() // 4096) * 1.02


def test_documents_are_packed_whole(spark):
    texts = [*ODD, None, "x y " * 9000]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(0, ODD[0], "q"), (None, "a", "q")], "doc_id long, text string, offset string")
    rows = packing.packed_documents(df).collect()
    t = plain(WORD_LEVEL)
    want = defaultdict(list)
    for d, text in [*enumerate(texts), (0, ODD[0]), (None, "a")]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            want[d, k, s, len(part), zlib.crc32(part.tobytes())].append(1)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(1)
    assert got == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    ends = defaultdict(int)
    for s, o, n in places:
        assert o == ends[s]
        ends[s] += n
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(ends.values()) // 4096)
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_rows_without_an_id_spread_over_groups(spark):
    df = spark.createDataFrame([(None, "word " * n) for n in range(1, 300)] + [(5, "other " * n) for n in range(1, 300)], "doc_id long, text string")
    cut = packing.token_pieces(df).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    rows = packing.pack(cut, 8, keys=["doc_id", "piece", "length", "ids_crc32"]).collect()
    for d in (None, 5):
        groups = Counter(r.sequence_id >> 36 for r in rows if r.doc_id == d)
        assert len(groups) == 8 and max(groups.values()) < 80 and sum(groups.values()) == 299


def test_segments_round_trip_and_notice_damage():
    r = np.random.default_rng(5)
    for n, spread in ((1, 1), (5, 3), (1000, 50000), (70000, 300), (50000, 2)):
        ids = np.minimum((r.pareto(0.6, n) * 3).astype(np.uint64), spread).astype(np.uint32)
        coded = ans.encode_segment(ids, block_tokens=4096, lanes=8)
        assert (ans.decode_segment(coded) == ids).all()
    blocks = -(-50000 // 4096)
    size = -(-50000 // (blocks * 8)) * 8
    assert (ans.decode_segment(coded, (2, 4)) == ids[2 * size : 4 * size]).all()
    bad = bytearray(coded)
    bad[-3] ^= 4
    with pytest.raises(ans.Corrupt):
        ans.decode_segment(bytes(bad))
    with pytest.raises(ans.Corrupt):
        ans.decode_segment(b"XX" + coded[2:])
    even = r.integers(0, 40000, 300000).astype(np.uint32)
    assert (ans.decode_segment(ans.encode_segment(even)) == even).all()


def test_files_give_back_every_document(spark, tmp_path):
    texts = ODD * 3 + [None]
    docs = [(7 * i % 101 - 3, t) for i, t in enumerate(texts)] + [(None, "null id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ans.write(df, str(tmp_path / "a"), part_bytes=9000, segment_tokens=300)
    rows = {r.doc_id: r for r in ans.read(spark, str(tmp_path / "a")).collect()}
    t = plain(BYTE_LEVEL)
    start = 0
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (rows[d].start, rows[d].n_tokens, bytes(rows[d].ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    assert len(rows) == len(docs)
    same = spark.createDataFrame([(i if i % 3 == 2 else None if i % 3 else 7, f"text {i} " * 40) for i in range(150)], "doc_id long, text string")
    ans.write(same, str(tmp_path / "c"), part_bytes=4000)
    found = ans.read(spark, str(tmp_path / "c")).orderBy("start").collect()
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and ids.count(None) == 50
    assert sorted(bytes(r.ids) for r in found) == sorted(np.array(t.encode(f"text {i} " * 40, add_special_tokens=False).ids + [2], "<u4").tobytes() for i in range(150))
    # rows without an id are in many parts
    parts = spark.read.parquet(str(tmp_path / "c")).selectExpr("part", "hex(null_ids) like 'F%' as nulls").where("nulls").select("part").distinct().count()
    assert parts > 1
    ans.write(df.limit(0), str(tmp_path / "b"))
    assert ans.read(spark, str(tmp_path / "b")).count() == 0
